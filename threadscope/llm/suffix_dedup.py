"""Exact removal of repeated byte strings: what 50 bytes share with a document of a smaller id goes.

Sorting all suffixes of the corpus takes many times its size on disk, so only suffixes that can matter are sorted. In
every 50-byte string the 16-byte gram of the smallest hash is its anchor, which depends on the string alone; about one
position in 18 is an anchor. Strings that occur in two documents have the same anchor in both, so:

1. every document sends the hashes of its anchors; those in two documents are shared;
2. around each shared anchor a document sends the segment that holds all 50-byte strings with it (at most 84 bytes);
3. segments of one anchor meet in one task, which sorts their 50-byte strings, smallest document first, compares equal
   hashes byte by byte, and gives back, per segment, which of its 35 strings a smaller document has;
4. every document marks the strings, and removes the bytes they cover.

Hashes travel as packed arrays, cut by hash range; the number of ranges follows the text's size. Within a slice of text an
anchor or segment is sent once, for its smallest document; what it settles for the slice's other documents is settled
there, so a passage that a third of all documents hold is a few bytes per slice in any task. Documents without a shared
anchor keep their text to themselves: a bit table of fixed size, which lets no shared document slip, finds most of them.

Null texts are empty. A null id counts as the smallest. Rows that repeat an id are the same document: they do not
remove from each other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import Powers, checkpoint, mix, prefix_hash, query, release, shuffle_partitions, small_batches, table, text_bytes, utf8

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM  # bytes of a string before or after its anchor, at most
SEGMENT = GRAM + 2 * REACH
LOWEST = -(1 << 63)
FULL = (1 << (REACH + 1)) - 1
WORDS = 1 << 17  # 64-bit words of the bit table
KNOWN = 1 << 31


# --- anchors --------------------------------------------------------------------------------------------------------
def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[:len(out) - (width - have)], out[width - have:]) if width > have else out


class Texts:
    """Several texts end to end, with ``REACH`` zero bytes around each, so that one pass of numpy serves all of them."""

    def __init__(self, raws: list[np.ndarray]) -> None:
        gap = np.zeros(REACH, np.uint8)
        sizes = np.array([len(r) for r in raws], np.int64)
        self.data = np.concatenate([gap, *(x for r in raws for x in (r, gap))])
        self.end = np.cumsum(sizes + REACH)
        self.begin = self.end - sizes

    def anchors(self, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, hash, number of the text) of all anchors."""
        some = np.flatnonzero(self.end - self.begin >= LENGTH)
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        prefix = prefix_hash(self.data, powers)
        n = len(self.data) - GRAM + 1
        grams = mix((prefix[GRAM:] - prefix[:n]) * powers.get(n)[1][:n])
        least = _slide(grams, REACH + 1, np.minimum)  # of every 50-byte string
        edge = np.zeros(len(least) + 1, np.int8)
        edge[self.begin[some]] = 1
        edge[self.end[some] - LENGTH + 1] = -1
        least[np.cumsum(edge[:-1], dtype=np.int8) == 0] = 0  # those that are not inside a text
        pad = np.zeros(REACH, np.uint64)
        # A gram is an anchor if it is the least of some string that holds it.
        at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == grams)
        row = np.searchsorted(self.begin, at, "right") - 1
        inside = (row >= 0) & (at + GRAM <= self.end[row])  # a hash of zero
        return at[inside], grams[at[inside]], row[inside]

    def segments(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments around anchors (rows of 84 bytes, zero where the text ends), bytes before and after, and a hash of all."""
        rows = np.lib.stride_tricks.sliding_window_view(self.data, SEGMENT)[at - REACH]
        before, after = np.minimum(at - self.begin[row], REACH), np.minimum(self.end[row] - at - GRAM, REACH)
        return rows, before, after, segment_keys(rows, before, after)


def anchors(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of all anchors of one text."""
    at, h, _ = Texts([raw]).anchors(powers)
    return at - REACH, h


def _together(rows: Iterator[tuple], size, limit: int = 1 << 17) -> Iterator[list[tuple]]:
    """Rows in groups of about ``limit`` bytes, small enough for the processor's cache, and of 1,024 rows at most."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit or len(held) == 1024:
            yield held
            held, total = [], 0
    if held:
        yield held


def segment_keys(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each segment and of its sides."""
    words = np.zeros((len(rows), 96), np.uint8)
    words[:, :SEGMENT] = rows
    words[:, SEGMENT], words[:, SEGMENT + 1] = before, after
    h = np.zeros(len(rows), np.uint64)
    for column in words.view(np.uint64).T:
        h = mix(h ^ column) + np.uint64(1)
    return h


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = text_bytes(batch.column("text"))
    for row, doc in enumerate(batch.column("doc").to_pylist()):
        yield doc, data[offsets[row]:offsets[row + 1]]


def _by_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash, even where the hashes are uniform; those of anchors, which are minima, have to be mixed again."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _packed(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Rows of one range each: the range and the bytes of the arrays."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
        if high > low:
            yield (int(part[low]), *(np.ascontiguousarray(a[low:high]).tobytes() for a in arrays))


def _record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


BLOB, LONG, INT = pa.binary(), pa.int64(), pa.int32()


# --- 1: shared anchors ----------------------------------------------------------------------------------------------
def _send_anchors(ranges: int, slice_bytes: int):
    """Rows (part, hashes, numbers, docs): asked anchors by range; negative parts: shared anchors by bucket of documents.

    A hash travels as its upper 48 bits; anchors that agree in them are only candidates. A document is its number within
    the slice, ``KNOWN`` is added if the slice itself shows that the anchor is shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in small_batches(batches, "text", slice_bytes):
            found = []
            for rows in _together(_texts(batch), lambda r: len(r[1])):
                _, h, row = Texts([raw for _, raw in rows]).anchors(powers)
                found.append((h >> np.uint64(16), np.array([doc for doc, _ in rows], np.int64)[row]))
            h, doc = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            ids, doc = np.unique(doc, return_inverse=True)
            doc = doc.astype(np.uint32)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            h, doc = h[~again], doc[~again]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            lowest = doc[first]
            both = np.bincount(group[doc != lowest[group]], minlength=len(lowest)) > 0
            known = both[group]
            six = np.ascontiguousarray(h[first].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
            sent = doc[first] + np.where(both, KNOWN, 0).astype(np.uint32)
            rows = [(p, a, *_own_documents(b, ids)) for p, a, b in _packed(_by_range(mix(h[first]), ranges), six, sent)]
            mine = ids[doc[known].astype(np.int64)] if len(ids) else ids
            rows += [(-1 - p, b, b"", a) for p, a, b in _packed(_bucket(mine, ranges), mine, h[known])]
            yield _record(rows, ["part", "hashes", "numbers", "docs"], [LONG, BLOB, BLOB, BLOB])

    return run


def _own_documents(numbers: bytes, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers among the documents of one part, and these documents: a part holds few of a slice's."""
    sent = np.frombuffer(numbers, np.uint32)
    own, number = np.unique(sent & np.uint32(KNOWN - 1), return_inverse=True)
    return _tight(number.astype(np.uint32) | (sent & np.uint32(KNOWN))), ids[own].tobytes()


def _tight(blob: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob)


def _loose(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _groups(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(key, its values) of sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1 if len(keys) else []
    bounds = [0, *list(cuts), len(keys)]
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high > low:
            yield (int(keys[low]), *(v[low:high] for v in values))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """All rows of one part after the other; rows come sorted by part."""
    held, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != held:
                if rows:
                    yield held, rows
                held, rows = row["part"], []
            rows.append(row)
    if rows:
        yield held, rows


def _bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return _by_range(mix(doc.view(np.uint64)), buckets)


class _ByDocument:
    """Collects (document, columns) and gives them back packed by bucket, so that rows do not multiply with the ranges."""

    def __init__(self, buckets: int, names: list[str]) -> None:
        self.buckets, self.names, self.held, self.size = buckets, names, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def full(self) -> bool:
        return self.size > 200_000

    def flush(self) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*self.held)] if self.held else []
        rows = list(_packed(_bucket(columns[0], self.buckets), *columns)) if columns else []
        self.held, self.size = [], 0
        return _record(rows, ["part", *self.names], [LONG] + [BLOB] * len(self.names))


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document out of all rows of its bucket."""
    names = None
    for _, rows in _parts(batches):
        names = [n for n in rows[0] if n not in ("part", "docs")]
        doc, *columns = (np.frombuffer(b"".join(r[n] for r in rows), t) for n, t in zip(["docs", *names], (np.int64, np.uint64, np.int64)))
        order = np.argsort(doc, kind="stable")
        out = [(d, *(v.tobytes() for v in values)) for d, *values in _groups(doc[order], *(c[order] for c in columns))]
        yield _record(out, ["doc", *names], [LONG] + [BLOB] * len(names))


def _shared_anchors(buckets: int):
    """Rows (part, docs, hashes): the shared anchors, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _ByDocument(buckets, ["docs", "hashes"])
        for part, rows in _parts(batches):
            _ask_anchors(part, rows, out)
            if out.full():
                yield out.flush()
        yield out.flush()

    return run


def _ask_anchors(part: int, rows: list[dict], out: _ByDocument) -> None:
    if part < 0:
        for r in rows:
            out.add(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["hashes"], np.uint64))
        return
    six = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    h = wide.view("<u8").ravel().astype(np.uint64)
    numbers = [np.frombuffer(_loose(r["numbers"]), np.uint32) for r in rows]
    known = np.concatenate(numbers) >= KNOWN
    doc = np.concatenate([np.frombuffer(r["docs"], np.int64)[n & np.uint32(KNOWN - 1)] for r, n in zip(rows, numbers)])
    order = np.lexsort((doc, h))
    h, doc, known = h[order], doc[order], known[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    group = np.cumsum(first) - 1
    shared = (doc != doc[first][group])
    shared = (np.bincount(group[shared], minlength=first.sum()) > 0)[group] & ~known
    out.add(doc[shared], h[shared])


# --- 2 and 3: segments and their strings ------------------------------------------------------------------------------
def _send_segments(ranges: int, slice_bytes: int):
    """Rows (part, segs, docs, sizes): segments by range of the anchor; negative parts: settled masks by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for rows in _slices(batches, slice_bytes):
            cols = []
            for some in _together(rows, lambda r: len(r[1])):
                texts = Texts([raw for _, raw, _ in some])
                at, h, row = texts.anchors(powers)
                # An anchor's 48 bits and the number of its text fit into 64.
                flags = [np.frombuffer(f, np.uint64) | np.uint64(i << 48) for i, (_, _, f) in enumerate(some)]
                mine = np.isin((h >> np.uint64(16)) | (row.astype(np.uint64) << np.uint64(48)), np.concatenate(flags))
                row = row[mine]
                cols.append((h[mine], np.array([doc for doc, _, _ in some], np.int64)[row], *texts.segments(at[mine], row)))
            if not cols:
                continue
            h, doc, rows, before, after, key = (np.concatenate(c) for c in zip(*cols))
            order = np.lexsort((doc, key))
            first = np.ones(len(key), bool)
            first[1:] = key[order][1:] != key[order][:-1]
            again = np.zeros(len(key), bool)  # a segment counts once in a document
            again[1:] = ~first[1:] & (doc[order][1:] == doc[order][:-1])
            settled = np.zeros(len(key), bool)
            lowest = doc[order][first][np.cumsum(first) - 1]
            settled[order] = ~first & ~again & (doc[order] != lowest)
            ask = np.zeros(len(key), bool)
            ask[order] = first
            sizes = (before.astype(np.uint8), after.astype(np.uint8))
            packed = _packed(_by_range(mix(h[ask]), ranges), rows[ask], doc[ask], np.stack(sizes, 1)[ask])
            out = [(p, _tight(a), _tight(b), _tight(c)) for p, a, b, c in packed]
            mask = _possible(before, after)
            settled_rows = _packed(_bucket(doc[settled], ranges), key[settled], doc[settled], mask[settled])
            out += [(-1 - p, a, b, c) for p, a, b, c in settled_rows]
            yield _record(out, ["part", "segs", "docs", "sizes"], [LONG, BLOB, BLOB, BLOB])

    return run


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """(doc, bytes, flags) of about ``limit`` bytes of text at a time."""
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            raw = np.frombuffer(_loose(batch.column("packed")[i].as_py()), np.uint8)
            rows.append((batch.column("doc")[i].as_py(), raw, batch.column("hashes")[i].as_py()))
            held += len(raw)
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _possible(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bits of the strings that lie inside the text: bit a is the string that starts a bytes before the anchor."""
    a = np.arange(REACH + 1)
    inside = (a <= before[:, None].astype(int)) & (REACH - a <= after[:, None].astype(int))
    return (inside.astype(np.int64) << a).sum(axis=1)


def repeated(rows: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Masks of the strings that a smaller document's segment in the table has too."""
    by_doc = np.argsort(doc, kind="stable")
    rows, doc, before, after = rows[by_doc], doc[by_doc], before[by_doc], after[by_doc]
    out, possible = np.zeros(len(rows), np.int64), _possible(before, after)
    up, down = Powers().get(SEGMENT + 1)
    total = np.zeros(len(rows), np.uint64)  # of each row's string of this round, moved on by one byte a round
    for b in range(REACH, REACH + LENGTH):
        total += (rows[:, b].astype(np.uint64) + np.uint64(1)) * up[b]
    for a in range(REACH + 1):
        start = REACH - a
        if a:
            total += (rows[:, start].astype(np.uint64) + np.uint64(1)) * up[start]
            total -= (rows[:, start + LENGTH].astype(np.uint64) + np.uint64(1)) * up[start + LENGTH]
        mine = np.flatnonzero(possible >> a & 1)
        if len(mine) < 2:
            continue
        h = mix(total[mine] * down[start])
        order = np.argsort(h)
        mine, h = mine[order], h[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        lead = np.minimum.reduceat(mine, np.flatnonzero(first))[np.cumsum(first) - 1]  # rows go by document
        later = np.flatnonzero(doc[mine] != doc[lead])
        strings = rows[:, start:start + LENGTH]
        same = (strings[mine[later]] == strings[lead[later]]).all(axis=1)
        out[mine[later[same]]] |= 1 << a
        for i in later[~same]:  # equal hashes of unlike strings: compare with every row of the hash
            group = mine[h == h[i]]
            alike = group[(strings[group] == strings[mine[i]]).all(axis=1)]
            if doc[alike].min() < doc[mine[i]]:
                out[mine[i]] |= 1 << a
    back = np.zeros(len(rows), np.int64)
    back[by_doc] = out
    return back


def _settle(buckets: int):
    """Rows (part, docs, keys, masks): what smaller documents have of each segment, by bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _ByDocument(buckets, ["docs", "keys", "masks"])
        for part, rows in _parts(batches):
            if part < 0:
                for r in rows:
                    out.add(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["segs"], np.uint64), np.frombuffer(r["sizes"], np.int64))
            else:
                segs, doc, sizes = (b"".join(_loose(r[c]) for r in rows) for c in ("segs", "docs", "sizes"))
                segs, doc, sizes = np.frombuffer(segs, np.uint8).reshape(-1, SEGMENT), np.frombuffer(doc, np.int64), np.frombuffer(sizes, np.uint8).reshape(-1, 2)
                mask = repeated(segs, doc, sizes[:, 0], sizes[:, 1])
                hit = np.flatnonzero(mask)
                out.add(doc[hit], segment_keys(segs[hit], sizes[hit, 0], sizes[hit, 1]), mask[hit])
            if out.full():
                yield out.flush()
        yield out.flush()

    return run


# --- 4: removal -----------------------------------------------------------------------------------------------------
def removed(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], powers: Powers) -> Iterator[np.ndarray]:
    """Of (text, keys, masks of its segments), one after the other: which bytes of the text go."""
    texts = Texts([raw for raw, _, _ in rows])
    at, _, row = texts.anchors(powers)
    _, _, _, key = texts.segments(at, row)
    ends = np.searchsorted(row, np.arange(len(rows) + 1))
    mask = np.zeros(len(at), np.int64)
    for (_, keys, masks), low, high in zip(rows, ends[:-1], ends[1:]):
        if len(keys) and high > low:
            order = np.argsort(keys, kind="stable")
            keys, masks = keys[order], masks[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, masks = keys[starts], np.bitwise_or.reduceat(masks, starts)
            spot = np.minimum(np.searchsorted(keys, key[low:high]), len(keys) - 1)
            mask[low:high] = np.where(keys[spot] == key[low:high], masks[spot], 0)
    hit = np.flatnonzero(mask)
    anchor, a = np.nonzero(mask[hit, None] >> np.arange(REACH + 1) & 1)
    starts = np.zeros(len(texts.data) + LENGTH, np.int32)
    starts[at[hit[anchor]] - a + LENGTH] = 1
    before = np.cumsum(starts, dtype=np.int32)  # strings that start at a byte or before it, behind LENGTH zeros
    gone = before[LENGTH:] > before[:-LENGTH]
    for begin, end in zip(texts.begin, texts.end):
        yield gone[begin:end]


def _digest(raw: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
    return len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(raw[~gone].tobytes()).hexdigest()


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("doc"), utf8(docs["text"]).alias("text"))


def bit_table(docs: DataFrame) -> np.ndarray:
    """Bits of the ids in ``doc``, in ``WORDS`` words; the driver gets no more rows than words, whatever the input."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(WORDS * 64))
    words = docs.select(F.shiftright(slot, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(WORDS, np.uint64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def _in_table(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)) > 0


def _slot() -> F.Column:
    return F.pmod(F.xxhash64("doc"), F.lit(WORDS * 64)).alias("slot")


def masks(docs: DataFrame, slice_bytes: int = 1 << 21) -> DataFrame:
    """(doc, keys, masks): per document the segments that hold repeated strings, and which; ``docs`` as :func:`keyed`."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def deal(df: DataFrame, *ranges_by: str) -> DataFrame:
        return df.repartition(n, *ranges_by).sortWithinPartitions(*ranges_by)

    ranges = max(4 * n, -(-size // (8 << 20)))
    asked = docs.mapInArrow(_send_anchors(ranges, slice_bytes), "part long, hashes binary, numbers binary, docs binary")
    answered = deal(asked, "part").mapInArrow(_shared_anchors(ranges), "part long, docs binary, hashes binary")
    flags = checkpoint(deal(answered, "part").mapInArrow(_regroup, "doc long, hashes binary"))
    bits = bit_table(flags)
    shared = flags.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    del asked, answered
    release(spark)  # what the session ran last is held until it has run something else
    likely = docs.select("doc", "text", _slot()).mapInArrow(_only(bits), "doc long, packed binary")
    joined = likely.join(flags.hint("shuffle_hash"), "doc")
    ranges = max(4 * n, -(-int(shared) // 50_000))
    sent = joined.mapInArrow(_send_segments(ranges, slice_bytes), "part long, segs binary, docs binary, sizes binary")
    settled = deal(sent, "part").mapInArrow(_settle(ranges), "part long, docs binary, keys binary, masks binary")
    return deal(settled, "part").mapInArrow(_regroup, "doc long, keys binary, masks binary")


def _only(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(_in_table(bits, batch.column("slot").to_numpy())))
            packed = [_tight(t.encode()) for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("doc"), pa.array(packed, BLOB)], ["doc", "packed"])

    return run


def dedup_spans(docs: DataFrame, slice_bytes: int = 1 << 21) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    rows = keyed(docs)
    found = checkpoint(masks(rows, slice_bytes))
    bits = bit_table(found)
    release(docs.sparkSession)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that lose nothing are done; only the others' texts travel."""
        for batch in batches:
            for part in small_batches(iter([batch]), "text"):
                stays = ~_in_table(bits, part.column("slot").to_numpy())
                facts = [_digest(raw, np.zeros(len(raw), bool)) if s else (None, None, None, None) for s, (_, raw) in zip(stays, _texts(part))]
                packed = [None if s else _tight(t.encode()) for s, t in zip(stays, part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(packed, BLOB), *(pa.array(c, t) for c, t in zip(zip(*facts), (LONG, LONG, LONG, pa.string())))],
                    ["doc", "packed", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            facts, open_rows = [], []
            for row in batch.to_pylist():
                if row["packed"] is None:
                    facts.append((row["doc"], row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]))
                    continue
                open_rows.append(row)
            unpacked = ((r["doc"], np.frombuffer(_loose(r["packed"]), np.uint8), np.frombuffer(r["keys"] or b"", np.uint64),
                         np.frombuffer(r["masks"] or b"", np.int64)) for r in open_rows)
            for some in _together(unpacked, lambda r: len(r[1])):
                for (doc, raw, _, _), gone in zip(some, removed([r[1:] for r in some], powers)):
                    facts.append((doc, *_digest(raw, gone)))
            yield _record(facts, ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [LONG, LONG, LONG, LONG, pa.string()])

    split = rows.select("doc", "text", _slot()).mapInArrow(whole, "doc long, packed binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return split.join(found.hint("shuffle_hash"), "doc", "left").mapInArrow(cut, schema)


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.when(F.col("doc") != LOWEST, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
