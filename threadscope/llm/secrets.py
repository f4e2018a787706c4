"""Secret scan: rules for known forms, and a character convolutional network over every candidate in its context.

One pass over the whole texts finds the spans of the rules and all candidates: runs of at least ``SHORTEST`` characters
that keys are made of, where runs below ``LONG`` must hold a digit or one of ``+/_=`` or stand behind a colon or an equals
sign (others are plain words). Each run is cut into segments of ``BODY`` characters with the text around each, so long runs
are seen whole. The findings are kept in the shared folder. A quarter of the candidates, by hash, is held back. The network
(embedding, one convolution, maximum and mean over the window, one output; numpy only) learns on all different segments of
the others, labelled by the rules: a segment that a rule's span touches is a secret. Segments are dealt into blocks; in each
round every block goes on from the same network, and the networks of all blocks are averaged. Slope and offset of the
probabilities come from all candidates held back, each scored by its likeliest segment as in the scan, and the threshold is
the highest one that keeps the demanded recall on them. Candidates above it that no rule has found are spans of kind ``model``.

Null or empty texts hold nothing. Rows that repeat a document are scanned each. Without findings of both classes the
network adds nothing. Spans are in code points, end exclusive; spans that start together go by kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, query, small_batches, table, text_bytes, utf8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # runs are maximal, as those of [0-9a-f]+
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")
SHORTEST, LONG, BODY, BEFORE, AFTER = 8, 16, 64, 24, 8
WINDOW = BEFORE + BODY + AFTER
REACH = 30.0  # log-odds beyond it count as it
UNIT = 2.0**40  # whole numbers in which the parameters of blocks are added

KEY_BYTES = np.zeros(256, bool)
KEY_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True

#: What tells a short key from a word, and what may stand between a key's name and its value.
MARK_BYTES = np.zeros(256, bool)
MARK_BYTES[list(b"0123456789+/_=")] = True
GAP_BYTES = np.zeros(256, bool)
GAP_BYTES[list(b" \"'")] = True


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of all candidate runs, in bytes of the batch."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = KEY_BYTES[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # A run across the end of a text is two runs.
    cuts = offsets[1:-1]
    at = np.searchsorted(starts, cuts, "right") - 1
    crossing = np.unique(cuts[(at >= 0) & (starts[np.maximum(at, 0)] < cuts) & (ends[np.maximum(at, 0)] > cuts)]) if len(starts) else cuts[:0]
    starts, ends = np.sort(np.concatenate([starts, crossing])), np.sort(np.concatenate([ends, crossing]))
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    rows = np.searchsorted(offsets, starts, "right") - 1
    keep = (ends - starts >= LONG) | _marked(data, starts, ends) | _assigned(data, starts, offsets[rows])
    return rows[keep], starts[keep], ends[keep]


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a run holds a digit or one of the signs of keys."""
    before = np.concatenate([[0], np.cumsum(MARK_BYTES[data], dtype=np.int64)])
    return before[ends] > before[starts]


def _assigned(data: np.ndarray, starts: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether the last byte before a run, blanks and quotes left out, is a colon or an equals sign of the same text."""
    solid = np.where(GAP_BYTES[data], -1, np.arange(len(data)))
    last = np.concatenate([[-1], np.maximum.accumulate(solid)])[starts] if len(data) else starts
    sign = data[np.maximum(last, 0)] if len(data) else starts
    return (last >= floor) & ((sign == ord(":")) | (sign == ord("=")))


def rule_spans(text: str, raw: bytes, candidates: list[tuple[int, int]], place) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the rules' spans; ``candidates`` are the byte runs that may hold hexadecimal ones."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for start, end in candidates:
        if end - start >= 32:
            found += [(place(start + m.start()), "hex", place(start + m.end())) for m in HEX.finditer(raw[start:end])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def windows(raw: bytes, start: int, end: int) -> Iterator[bytes]:
    """A run in segments, each with what stands around it."""
    for at in range(start, end, BODY):
        stop = min(at + BODY, end)
        yield (raw[max(0, at - BEFORE):at].rjust(BEFORE, b"\0") + raw[at:stop].ljust(BODY, b"\0") + raw[stop:stop + AFTER].ljust(AFTER, b"\0"))


FINDINGS = ("doc_id {doc}, rules array<struct<start: long, kind: string, stop: long>>, "
            "cands array<struct<start: long, stop: long, label: int, touched: binary, windows: binary>>")


def touches(found: list[tuple[int, str, int]], starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether each stretch shares a character with one of the spans, which are sorted by start."""
    if not found:
        return np.zeros(len(starts), bool)
    begin = np.array([s for s, _, _ in found])
    reach = np.maximum.accumulate([e for _, _, e in found])  # farthest end so far
    before = np.searchsorted(begin, stops, "left")
    return (before > 0) & (reach[np.maximum(before - 1, 0)] > starts)


def findings(docs: DataFrame) -> DataFrame:
    """One row per document: spans of the rules, and all candidates with their label and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([
            ("doc_id", doc_type),
            ("rules", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))),
            ("cands", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.int32()), ("touched", pa.binary()),
                                          ("windows", pa.binary())])))])
        for batch in small_batches(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            rows, starts, ends = runs(data, offsets)
            first = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            rules, cands = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw, base = data[offsets[row]:offsets[row + 1]].tobytes(), offsets[row]
                spots = [(int(starts[i] - base), int(ends[i] - base)) for i in range(first[row], first[row + 1])]
                if len(raw) == len(text):
                    place = int
                else:
                    points = np.concatenate([[0], np.cumsum((data[base:offsets[row + 1]] & 0xC0) != 0x80)])
                    place = lambda b, points=points: int(points[b])
                spans = rule_spans(text, raw, spots, place)
                rules.append([{"start": s, "kind": k, "stop": e} for s, k, e in spans])
                own = []
                for start, end in spots:
                    begin = place(start)  # a run is ASCII: bytes are code points in it
                    at = begin + np.arange(0, end - start, BODY)
                    stop = begin + end - start
                    touched = touches(spans, at, np.minimum(at + BODY, stop))
                    own.append({"start": begin, "stop": stop, "label": int(touched.any()), "touched": touched.astype(np.uint8).tobytes(),
                                "windows": b"".join(windows(raw, start, end))})
                cands.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rules, types.field(1).type), pa.array(cands, types.field(2).type)], schema=types)

    doc = docs.schema["doc_id"].dataType.simpleString()
    doc_type = {"bigint": pa.int64(), "int": pa.int32()}.get(doc, pa.string())
    return docs.select("doc_id", utf8(docs["text"]).alias("text")).mapInArrow(run, FINDINGS.format(doc=doc))


# --- the network ----------------------------------------------------------------------------------------------------
def symbols(packed: list[bytes]) -> np.ndarray:
    """Windows as symbols: 0 nothing, 1-95 printable ASCII, 96 any other byte."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 31, 96))


@dataclass
class Network:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: np.ndarray

    WIDTH = 5

    @classmethod
    def new(cls, rng, dim: int = 8, filters: int = 24) -> Network:
        scale = 1 / np.sqrt(cls.WIDTH * (dim + 1))
        return cls(rng.normal(0, 0.3, (97, dim)), rng.normal(0, scale, (cls.WIDTH * (dim + 1), filters)), np.zeros(filters),
                   rng.normal(0, 0.1, 2 * filters), np.zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.out, self.offset]

    def forward(self, x: np.ndarray):
        body = np.zeros((len(x), WINDOW, 1))
        body[:, BEFORE:BEFORE + BODY] = 1  # the candidate itself, not what is around it
        e = np.concatenate([self.embed[x], body], axis=2)
        places = WINDOW - self.WIDTH + 1
        cols = np.concatenate([e[:, i:i + places] for i in range(self.WIDTH)], axis=2)
        h = np.maximum(cols @ self.conv + self.bias, 0)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return cols, h, pooled, pooled @ self.out + self.offset[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i:i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        cols, h, pooled, z = self.forward(x)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        filters = self.conv.shape[1]
        gp = g[:, None] * self.out
        gh = np.repeat(gp[:, None, filters:] / h.shape[1], h.shape[1], axis=1)
        np.put_along_axis(gh, h.argmax(axis=1)[:, None], np.take_along_axis(gh, h.argmax(axis=1)[:, None], 1) + gp[:, None, :filters], 1)
        gh *= h > 0
        flat = gh.reshape(-1, filters)
        gcols = gh @ self.conv.T
        width = gcols.shape[2] // self.WIDTH
        ge = np.zeros((len(x), WINDOW, width))
        for i in range(self.WIDTH):
            ge[:, i:i + gcols.shape[1]] += gcols[:, :, i * width:(i + 1) * width]
        gembed = np.zeros_like(self.embed)
        np.add.at(gembed, x.ravel(), ge[:, :, :-1].reshape(-1, width - 1))
        return [gembed, cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(axis=0), pooled.T @ g, np.array([g.sum()])]


@dataclass
class Detector:
    """A network, slope and offset of its probabilities, and the threshold."""

    network: Network
    slope: float
    offset: float
    threshold: float

    def probabilities(self, packed: list[bytes]) -> np.ndarray:
        """Of candidates, each that of its likeliest segment."""
        if not packed:
            return np.zeros(0)
        z = likeliest(self.network, packed)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30)))


def learn(rows: list[tuple[bytes, int]], rounds: int = 8, seed: int = 11, start: Network | None = None) -> Network:
    """A network fitted to (window, label) rows by Adam, from a new one or on from ``start``."""
    rng = np.random.default_rng(seed)
    x, y = symbols([w for w, _ in rows]), np.array([y for _, y in rows], float)
    net = Network.new(rng) if start is None else Network(*(p.copy() for p in start.parts()))
    first, second, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            t += 1
            for p, g, m, v in zip(net.parts(), net.gradients(x[order[i:i + 128]], y[order[i:i + 128]]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def likeliest(net: Network, packed: list[bytes]) -> np.ndarray:
    """Log-odds of candidates, each that of its likeliest segment, in steps of 0.001 within ``REACH``. The steps are part of the
    score, so counts by step tell all there is to know about any number of candidates."""
    first = np.cumsum([0] + [len(p) // WINDOW for p in packed[:-1]])
    z = np.concatenate([net.logits(symbols([part])) for part in _parts(b"".join(packed), 4096 * WINDOW)])
    return np.clip(np.round(np.maximum.reduceat(z, first), 3), -REACH, REACH)


def _parts(packed: bytes, size: int) -> Iterator[bytes]:
    for at in range(0, len(packed), size):
        yield packed[at:at + size]


def calibrate(net: Network, z: np.ndarray, truth: np.ndarray, recall: float = 0.98, n: np.ndarray | None = None) -> Detector:
    """Slope, offset and threshold from the log-odds of candidates that the network has not learnt from, each standing for ``n``."""
    a, b = 1.0, 0.0
    n = np.ones(len(z)) if n is None else n
    pos, neg = (n * truth).sum(), (n * (1 - truth)).sum()
    goal = np.where(truth > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    loss = lambda a, b: float((n * (np.logaddexp(0, a * z + b) - goal * (a * z + b))).sum())
    best = loss(a, b)
    for _ in range(100):  # Newton's method on the held-back log-odds; steps that go too far are halved
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v, g = n * (p * (1 - p) + 1e-6), n * (p - goal)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.linalg.solve(h, [(g * z).sum(), g.sum()])
        while np.abs(step).max() >= 1e-9 and not (now := loss(a - step[0], b - step[1])) < best:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        a, b, best = a - step[0], b - step[1], now
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    ranked = np.flatnonzero(truth > 0)[np.argsort(-p[truth > 0], kind="stable")]
    last = np.searchsorted(np.cumsum(n[ranked]), np.ceil(recall * pos))
    return Detector(net, float(a), float(b), float(p[ranked[last]]))


def train(rows: list[tuple[bytes, int]], recall: float = 0.98, rounds: int = 8, seed: int = 11) -> Detector | None:
    """Fit on (windows, label) rows of whole candidates, whose segments all take the row's label; every fourth row is held
    back for calibration and threshold."""
    fit, hold = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
    if any(len({y for _, y in part}) < 2 for part in (fit, hold)):
        return None
    net = learn([(part, y) for w, y in fit for part in _parts(w, WINDOW)], rounds, seed)
    return calibrate(net, likeliest(net, [w for w, _ in hold]), np.array([y for _, y in hold], float), recall)


def fit(found: DataFrame, max_rows: int = 3000, recall: float = 0.98) -> Detector | None:
    """Learn from all different segments of three quarters of the candidates, and calibrate on all other candidates. No row
    is left out: ``max_rows`` sets the size of a block that one task learns from, about twice as many segments."""
    every = found.select("doc_id", F.explode("cands").alias("c"))
    held = F.pmod(F.xxhash64("doc_id", "c.start"), F.lit(4)) == 0
    cut = F.transform(F.sequence(F.lit(0), F.length("c.touched") - 1), lambda i: F.struct(
        (F.substring("c.touched", i + 1, F.lit(1)) == F.lit(b"\1")).cast("int").alias("label"),
        F.substring("c.windows", i * WINDOW + 1, F.lit(WINDOW)).alias("window")))
    segments = checkpoint(every.filter(~held).select(F.inline(cut)).distinct())
    total = {r["label"]: r["n"] for r in segments.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    net = learn_all(segments, total, 2 * max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "windows"):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(likeliest(net, batch.column("windows").to_pylist()))], ["label", "z"])

    scored = every.filter(held).select("c.label", "c.windows").mapInArrow(run, "label int, z double")
    # At most one row a step and label, see likeliest.
    counts = sorted((r["z"], r["label"], r["n"]) for r in scored.groupBy("z", "label").agg(F.count(F.lit(1)).alias("n")).collect())
    if len({y for _, y, _ in counts}) < 2:
        return None
    z, y, n = (np.array(x, float) for x in zip(*counts))
    return calibrate(net, z, y, recall, n)


def learn_all(segments: DataFrame, total: dict[int, int], size: int, rounds: int = 8) -> Network:
    """A network fitted to all ``segments`` (label, window), of which there are ``total`` by label, in blocks of about ``size``.

    Segments of the rarer label are repeated until they are a quarter of all. The sums over blocks are whole numbers, so they
    do not depend on the order in which blocks end.
    """
    rare = min(total, key=lambda y: total[y])
    repeats = max(1, total[1 - rare] // (3 * total[rare]))
    blocks = -(-(total[1 - rare] + repeats * total[rare]) // size)
    again = F.sequence(F.lit(0), F.when(F.col("label") == rare, F.lit(repeats - 1)).otherwise(F.lit(0)))
    rows = segments.withColumn("pick", F.xxhash64("window", "label")).select("*", F.explode(again).alias("again"))
    rows = rows.withColumn("block", F.pmod(F.col("pick") + F.col("again"), F.lit(blocks)).cast("int"))
    dealt = checkpoint(rows.repartitionById(blocks, "block").sortWithinPartitions("pick", "window", "again").select("window", "label"))
    net = Network.new(np.random.default_rng(11))
    for turn in range(rounds):
        sums = dealt.mapInArrow(partial(_learn_block, net, turn), "place int, value long").groupBy("place").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
        mean = np.array([r["value"] / r["n"] / UNIT for r in sorted(sums.collect())])  # one row a parameter
        ends = np.cumsum([p.size for p in net.parts()])[:-1]
        net = Network(*(part.reshape(p.shape) for part, p in zip(np.split(mean, ends), net.parts())))
    return net


def _learn_block(net: Network, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters, in units, after one pass over the block of a task."""
    rows = [row for batch in batches for row in zip(batch.column("window").to_pylist(), batch.column("label").to_pylist())]
    if rows:
        flat = np.concatenate([p.ravel() for p in learn(rows, 1, turn, net).parts()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.round(flat * UNIT).astype(np.int64))], ["place", "value"])


def spans(found: DataFrame, detector: Detector | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model) of every row of ``findings``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            all_rules, all_cands = batch.column("rules").to_pylist(), batch.column("cands").to_pylist()
            unknown = [(row, c) for row, own in enumerate(all_cands) for c in own if not c["label"]] if detector is not None else []
            added: dict[int, list] = {}
            for at in range(0, len(unknown), 2000):
                part = unknown[at:at + 2000]
                for (row, c), p in zip(part, detector.probabilities([c["windows"] for _, c in part])):
                    if p >= detector.threshold:
                        added.setdefault(row, []).append((c["start"], "model", c["stop"]))
            for row, rules in enumerate(all_rules):
                base, more = [(r["start"], r["kind"], r["stop"]) for r in rules], added.get(row, [])
                counts.append([sum(k == kind for _, k, _ in base) for kind in KINDS[:3]] + [len(more)])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n[:, i]) for i in range(3)), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(n[:, 3])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    doc = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {doc}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in found)


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint(findings(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spans(found, fit(found))
