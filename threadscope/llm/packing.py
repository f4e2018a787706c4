"""Documents packed into as few token sequences as possible: best fit, then a swap-based local search.

Texts are tokenized once, where they are read; only documents longer than a sequence are cut. Pieces are dealt evenly
into blocks of about ``block`` rows, which hash-sized groups or repeated ids cannot unbalance. A block is packed by best
fit in falling order of length. Then pieces move between underfull bins: the emptiest bin gives pieces away by moves,
one-for-one and two-for-one exchanges, each of which raises the sum of squared fills, until it is empty or no exchange
is left. Bins that end up nearly full are final; the pieces of the others form the blocks of the next round, dealt anew, so
that underfull bins of different blocks meet. Rounds end when one block is left, or when a round over many blocks has saved
less than one in a thousand of the sequences it was given.

Null or empty texts are the end token alone. Repeated rows are packed one by one. Ties go by length, then by row order.
An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, query, small_batches, table, utf8

LENGTH, END = 4096, 1
CACHE = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next beyond 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to what the tokenizer gives for the whole text.

    The pre-tokenizer of this vocabulary never joins text across blanks, so blank-separated chunks are encoded on their
    own and kept, up to a bounded number. It lower-cases and puts a word and the marks after it into tokens of their own;
    for Latin-1 texts, which normalization leaves alone, that is done beforehand, so that fewer chunks differ, and words of
    small letters go straight to the model. All other chunks take the tokenizer's whole path.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_str(model), {}, byte_letters()
        self.words = self.tokenizer.model

    def chunks(self, text: str) -> list[str]:
        if "<|" not in text:  # special tokens are matched before lower-casing
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.words.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new, rest = set().union(*chunks).difference(known), {".", ",", ""}.difference(known)
        words, odd = [], []
        for c in new:
            word = c.rstrip(".,")
            if word.isalpha() and (word.isascii() or max(word) < "\u0100") and word == word.lower():
                words.append(c)
                if len(c) - len(word) > 1:
                    rest.add(c[len(word):])
            else:
                odd.append(c)
        rest = [c for c in rest.union(odd) if c not in known]
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[c] = array("I", e.ids).tobytes()
        for c in words:
            word = c.rstrip(".,")
            ids = known.get(word)
            if ids is None:
                ids = known[word] = self.word(word)
            if len(word) < len(c):
                known[c] = ids + known[c[len(word):]]
        return [b"".join(map(known.__getitem__, part)) for part in chunks]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end token, cut only where too long."""
    model = Path(tokenizer).read_text()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    end = array("I", [END]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in small_batches(batches, "text", 4 << 20):
            rows, number, starts, sizes, sums = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at:at + 4 * length]
                    rows.append(row)
                    number.append(k)
                    starts.append(at // 4)
                    sizes.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", utf8(docs["text"]).alias("text"))
    return rows.mapInArrow(run, f"doc_id {doc_type}, piece int, start long, length long, ids_crc32 long")


# --- one block ------------------------------------------------------------------------------------------------------
def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers; longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces = 0  # bit s is set if some bin has s places left
    for row in sorted(range(len(sizes)), key=lambda r: -sizes[r]):
        size = sizes[row]
        fit = spaces >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            space, b = capacity, len(bins)
            bins.append([])
        bins[b].append(row)
        if space > size:
            by_space.setdefault(space - size, []).append(b)
            spaces |= 1 << (space - size)
    return bins


class Offers:
    """What a bin can put into an exchange: single rows and pairs of rows, one of every size or sum, shortest first.

    Rows of one size can stand for each other. The sizes of a bin that differ are few, however many rows it has: k of them
    need k * (k + 1) / 2 places, so a bin of 4096 holds at most 90.
    """

    def __init__(self, rows: list[int], sizes: list[int]) -> None:
        self.rows, self.by_size = rows, {}
        for r in rows:
            self.by_size.setdefault(sizes[r], []).append(r)
        self.one = sorted(self.by_size)

    def ones(self) -> tuple[list[int], dict[int, tuple]]:
        return self.one, {x: (self.by_size[x][0],) for x in self.one}

    @cached_property
    def pairs(self) -> tuple[list[int], dict[int, tuple]]:
        found = {}
        for i, x in enumerate(self.one):
            same = self.by_size[x]
            if len(same) > 1:
                found[2 * x] = (same[0], same[1])
            for y in self.one[:i]:
                found[x + y] = (same[0], self.by_size[y][0])
        return sorted(found), found


def best_exchange(give: Offers, take: Offers, space: int) -> tuple[int, tuple, tuple]:
    """(gain, rows given, rows taken back): the exchange that fills the taker most, at most by ``space``.

    A move, one for one, two for one and one for two, in this order; of equal gains the first one wins.
    """
    best: tuple[int, tuple, tuple] = (0, (), ())
    nothing = ([0], {0: ()})
    for outs, backs in ((give.ones, lambda: nothing), (give.ones, take.ones), (lambda: give.pairs, take.ones), (give.ones, lambda: take.pairs)):
        (out, out_rows), (back, back_rows) = outs(), backs()
        for b in back:
            at = bisect_right(out, space + b) - 1
            if at >= 0 and out[at] - b > best[0]:
                best = (out[at] - b, out_rows[out[at]], back_rows[b])
                if best[0] == space:
                    return best
    return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: empty the emptiest bins into the other underfull ones.

    Each exchange makes the fuller of two bins still fuller, so the sum of squared fills rises and the search ends. All
    pieces of both bins are open to an exchange.
    """
    fill = [sum(sizes[r] for r in b) for b in bins]
    held = [Offers(b, sizes) for b in bins]
    stuck: set[int] = set()
    while True:
        under = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (fill[b], b))
        room = sum(capacity - fill[b] for b in under)
        donor = next((b for b in under if b not in stuck), None)
        if donor is None or room - (capacity - fill[donor]) < fill[donor]:
            break  # what is free elsewhere cannot take a whole bin
        for b in reversed(under):  # fullest first
            if b == donor:
                continue
            while fill[donor] and fill[b] >= fill[donor] and fill[b] < capacity:
                gain, out, back = best_exchange(held[donor], held[b], capacity - fill[b])
                if not gain:
                    break
                held[donor] = Offers([r for r in held[donor].rows if r not in out] + list(back), sizes)
                held[b] = Offers([r for r in held[b].rows if r not in back] + list(out), sizes)
                fill[donor] -= gain
                fill[b] += gain
            if not fill[donor]:
                break
        if fill[donor]:
            stuck.add(donor)
        else:
            stuck.clear()
    return [b.rows for b in held if b.rows]


def pack(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    return improve(best_fit(sizes, capacity), sizes, capacity)


# --- all blocks -----------------------------------------------------------------------------------------------------
def _block_packer(columns: list[str], capacity: int, turn: int, waste: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        seq, offset, final = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        for b, members in enumerate(pack(sizes, capacity)):
            at = 0
            for r in members:
                seq[r], offset[r] = (turn << 56) + (int(key[0]) << 20) + b, at
                at += sizes[r]
            final[members] = at >= capacity * (1 - waste)
        return rows.assign(sequence_id=seq, offset=offset, final=final)[[*columns, "sequence_id", "offset", "final"]]

    return run


def packed(parts: DataFrame, capacity: int = LENGTH, block: int = 8192, waste: float = 0.005) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``. ``parts`` has to be read from storage, so that row numbers last."""
    columns, done, turn, before = parts.columns, [], 0, None
    now, left = parts, parts.count()
    while True:
        blocks = max(1, -(-left // block))

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long, final boolean"
        dealt = now.select(*columns).withColumn("place", F.monotonically_increasing_id())
        # Row numbers start anew in every partition; the hash spreads them over all blocks.
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
        result = checkpoint(dealt.groupBy("block").applyInPandas(_block_packer(columns, capacity, turn, waste), schema))
        # Sequences are numbered by round and block, so each is of one task: no shuffle of rows to count them.
        bins = result.groupBy("sequence_id").agg(F.first("final").alias("final"), F.count("*").alias("n"))
        total, open_bins, after = bins.agg(F.count("*"), F.count_if(~F.col("final")), F.coalesce(F.sum(F.when(~F.col("final"), F.col("n"))), F.lit(0))).first()
        saved = None if before is None else before - total
        if blocks == 1 or after == 0 or (saved is not None and saved * 1000 < before):
            done.append(result)
            break
        done.append(result.filter("final"))
        now, left, before, turn = result.filter(~F.col("final")), after, open_bins, turn + 1
    return reduce(DataFrame.unionAll, done).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return packed(checkpoint(pieces(docs, tokenizer or default_tokenizer(), length)), length)


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
