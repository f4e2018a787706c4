"""Toxicity: a linear classifier over character n-grams, each scaled by its naive Bayes log-count ratio.

Fit: a bounded sample of labelled rows (``max_rows`` per class, picked by hash of the id) gives, for every hashed n-gram,
the number of documents of either class that hold it. Its ratio r = log(p/q) is drawn towards zero by ``shrink``
standard errors, so that n-grams whose ratio may be chance are no features at all. Logistic regression is fitted on
presence times r; a second part of the sample fits slope and offset of the probabilities. They hold for classes of
equal size, so what the threshold means does not change with the share of toxic documents in a corpus. Scoring reads whole texts in numpy, a few table look-ups per character.

Null or empty texts hold no n-gram and get the score of such a text. Labels that are null, or whose document is missing,
are not learnt from; a document labelled several times counts once, toxic if any label says so, and of the rows of a
repeated id only the one whose text has the smallest hash is learnt from. Without rows of
both classes every score is the share of toxic rows (0 without rows). Only ``text`` enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import query, small_batches, table, utf8

ORDERS = (3, 4, 5)
BITS = 20
REJECT = 0.7


def ngrams(text: str) -> list[np.ndarray]:
    """Hashed n-grams of each order, repeats included; texts count in lower case between two blanks."""
    if not text:
        return []
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], points * np.uint32(0x9E3779B1)
    for n in range(2, ORDERS[-1] + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[n - 1:]
        if n in ORDERS:
            out.append((h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS))
        if len(h) < 2:
            break
    return out


def features(text: str) -> np.ndarray:
    grams = ngrams(text)
    return np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Weights of the n-grams that matter, offset of a text without any."""

    index: np.ndarray
    weight: np.ndarray
    offset: float

    def table(self) -> np.ndarray:
        full = np.zeros(1 << BITS, np.float32)
        full[self.index] = self.weight
        return full


def logit(text: str, weights: np.ndarray, offset: float) -> float:
    found = [g[weights[g] != 0] for g in ngrams(text)]
    return offset + float(weights[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else offset


def probability(z: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-np.clip(z, -40, 40))))


def learn(rows: list[tuple[np.ndarray, int]], prior: float, smooth: float = 1.0, shrink: float = 2.5, rounds: int = 12,
          penalty: float = 1e-4) -> Model:
    """Fit on (n-grams, label) rows in their order; every fifth row only sets slope and offset."""
    none = np.zeros(0, np.uint32)
    fit, hold = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    total = np.array([sum(y == c for _, y in fit) for c in (0, 1)], float)
    share = min(max(prior, 1e-6), 1 - 1e-6)
    if not total.all():
        return Model(none, none.astype(np.float32), float(np.log(share / (1 - share))))
    counts = [np.bincount(np.concatenate([x for x, y in fit if y == c]), minlength=1 << BITS) + smooth for c in (0, 1)]
    ratio = np.log(counts[1] / (total[1] + 2 * smooth)) - np.log(counts[0] / (total[0] + 2 * smooth))
    sure = np.abs(ratio) - shrink * np.sqrt(1 / counts[1] + 1 / counts[0])
    ratio = np.where(sure > 0, np.sign(ratio) * sure, 0.0)
    w, grad2, bias, bias2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    xs = [(x[ratio[x] != 0], y) for x, y in fit]
    for _ in range(rounds):  # Adagrad, one row at a time in a fixed order
        for x, y in xs:
            g = probability(float(w[x] @ ratio[x]) + bias) - y
            step = g * ratio[x] + penalty * w[x]
            grad2[x] += step * step
            w[x] -= 0.1 * step / np.sqrt(grad2[x])
            bias2 += g * g
            bias -= 0.1 * g / np.sqrt(bias2)
    weight = w * ratio
    z = np.array([weight[x].sum() + bias for x, _ in hold])
    y = np.array([y for _, y in hold], float)
    slope, offset = _platt(z, y)
    balance = -np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    index = np.flatnonzero(weight)
    return Model(index, (slope * weight[index]).astype(np.float32), float(slope * bias + offset + balance))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of log-odds by Newton's method, towards targets a little inside 0 and 1."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(z)), 1e-6)
    a, b, u = 1.0, 0.0, z / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g = np.array([((p - goal) * u).sum() + 1e-3 * a, (p - goal).sum()])
        v = p * (1 - p) + 1e-6
        h = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3) / scale, b


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2000) -> Model:
    """Learn from at most ``max_rows`` labelled documents of each class; the class shares come from all labelled rows."""
    known = labels.filter(labels["toxic"].isin(0, 1) & labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    known = known.groupBy(known["doc_id"].cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(max_rows) for c in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # 2 * max_rows rows of two numbers
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), utf8(docs["text"]).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            grams = [features(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(grams, pa.binary())], ["id", "toxic", "grams"])

    # One text an id before anything is extracted: at most 2 * max_rows rows reach the driver, however often ids repeat.
    single = texts.join(sample, "id").groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    rows = single.select("id", "toxic", "first.text").mapInArrow(extract, "id long, toxic int, grams binary").collect()
    order = np.random.default_rng(7).permutation(len(rows))
    rows = sorted(rows, key=lambda r: r["id"])
    total = sum(shares.values())
    return learn([(np.frombuffer(rows[i]["grams"], "<u4"), rows[i]["toxic"]) for i in order], shares.get(1, 0) / total if total else 0.0)


def _scores(model: Model, batches: Iterator[pa.RecordBatch], column: str):
    weights = model.table()
    for batch in small_batches(batches, column):
        yield batch, [probability(logit(t, weights, model.offset)) for t in (x or "" for x in batch.column(column).to_pylist())]


def score(docs: DataFrame, model: Model, threshold: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scores(model, batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()),
                 pa.array([int(x >= threshold) for x in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = REJECT) -> DataFrame:
    """The documents, all columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scores(model, batches, batch_name):
            yield batch.filter(pa.array([x < threshold for x in p], pa.bool_()))

    batch_name = docs.columns[at]
    return docs.mapInArrow(run, docs.schema)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
