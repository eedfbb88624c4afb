"""Toxicity by subword bags: embeddings of hashed byte n-grams and words, averaged into a softmax.

The average weighs a bucket by its rarity in the sample. A bucket of n sample texts counts by
n / (n + SHRINK) of that, so a rare word has its say without ruling; only buckets of fewer than
MIN_TEXTS sample texts, where nothing can be learnt, are left out, however large the sample.

A text is the bag of its words and of their n-grams with word borders, so a misspelling shares
most of its vectors with the words it was made from. Embeddings and the linear softmax are
trained together in numpy on a bounded sample. As averaging and the softmax layer are linear,
scoring needs one number per bucket: its embedding times the difference of the two class rows.

Null text counts as empty: the bias alone. Several labels of one id: their majority (ties: 1).
Null labels are left out; without any label every score is 0.5 or below.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import hashing as H
from framelens.llm.common import fold_of, unit_hash
from framelens.llm.quality_fm import as_bytes
from framelens.session import drop_path, written

BITS, DIM = 18, 8
NGRAMS = (3, 4, 5, 6)
#: Bound of the labelled sample, and of the share of each class in it.
SAMPLE_ROWS = 6_000
EPOCHS, BATCH, RATE, DECAY = 10, 64, 0.05, 1e-5
#: Buckets of fewer sample texts get no embedding; sample texts at which a bucket has half its weight.
MIN_TEXTS, SHRINK = 3, 20
#: Least number of steps; a small sample is gone through more often.
MIN_STEPS = 300
THRESHOLD = 0.5
#: Part of the way from the label shares of the sample to those of all labelled rows.
PRIOR_SHARE = 0.5
_WIDTH = 1 << BITS


def grams(plain: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the words, then of the n-grams of each length."""
    rolling = H.Rolling(plain)
    ws, we = H.word_spans(plain)
    shift = np.uint64(64 - BITS)
    yield ws, rolling.hashes(ws - 1, we + 1) >> shift
    spaces = np.concatenate([[0], np.cumsum(plain == 32)])
    for n in NGRAMS:
        if len(plain) < n:
            continue
        # no space inside; a border at either end belongs to the n-gram
        inner = spaces[n - 1:-1] - spaces[1:-n + 1] == 0
        at = np.flatnonzero(inner[:len(plain) - n + 1])
        yield at + 1, rolling.hashes(at, at + n) >> shift


def bags(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, row, bucket) of runs of texts, not ordered."""
    for first, end, data, starts in H.pieces(texts):
        for at, bucket in grams(H.folded(data)):
            yield first, end, np.clip(H.owner(starts, at), 0, end - first - 1), bucket


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 11) -> dict[str, np.ndarray]:
    """Adam on the softmax loss; ``rows``: (buckets, counts, label), used up."""
    rng = np.random.default_rng(seed)
    texts = np.zeros(_WIDTH, dtype=np.int64)
    for used, _, _ in rows:
        texts[used] += 1
    weight = np.log(max(len(rows), 2) / np.maximum(texts, 1)).astype(np.float32)
    weight *= (texts / (texts + SHRINK)).astype(np.float32)
    known = texts >= MIN_TEXTS
    for i, (f, x, y) in enumerate(rows):  # in place: the bags are most of the driver's memory
        rows[i] = f[known[f]], x[known[f]], y
    rows = [r for r in rows if (weight[r[0]] * r[1]).sum() > 0]
    e = rng.normal(0, 0.001, (_WIDTH, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]

    def adam(k, p, where, grad, rate):
        m, s = state[k]
        m[where] += 0.1 * (grad - m[where])
        s[where] += 0.01 * (grad * grad - s[where])
        p[where] -= rate * m[where] / (np.sqrt(s[where]) + 1e-7)

    epochs = max(EPOCHS, MIN_STEPS // -(-len(rows) // BATCH)) if rows else 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at:at + BATCH]]
            length = np.array([len(r[0]) for r in part])
            ptr = np.cumsum(length) - length
            masses = [r[1] * weight[r[0]] for r in part]
            share = np.concatenate([m / m.sum() for m in masses]).astype(np.float32)
            bucket = np.concatenate([r[0] for r in part])
            label = np.array([r[2] for r in part])
            mean = np.add.reduceat(e[bucket] * share[:, None], ptr, axis=0)
            z = mean @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), label] -= 1
            p /= len(part)
            gm = p @ w.T
            used, where = np.unique(bucket, return_inverse=True)
            gx = np.repeat(gm, length, axis=0) * share[:, None]
            ge = np.stack([np.bincount(where, gx[:, d], len(used)) for d in range(DIM)], 1)
            adam(0, e, used, ge + DECAY * e[used], rate)
            adam(1, w, slice(None), mean.T @ p, rate)
            adam(2, b, slice(None), p.sum(0), rate)
    value = np.where(known, weight * (e @ (w[:, 1] - w[:, 0])), 0)
    return {"value": value.astype(np.float64), "weight": (weight * known).astype(np.float64),
            "bias": np.array([b[1] - b[0]])}


def _counts(f: bytes, x: bytes) -> np.ndarray:
    """The counts of a bag, of 16 or 32 bits: one for each of its 32-bit buckets."""
    return np.frombuffer(x, np.uint16 if 2 * len(x) == len(f) else np.uint32)


def sample_bags(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The bags (id, label, f, x) in a fixed order, without buckets of fewer than MIN_TEXTS texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = np.zeros(_WIDTH, dtype=np.int64)
        for batch in batches:
            for f in batch.column(0).to_pylist():
                texts[np.frombuffer(f, np.int32)] += 1
        used = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(texts[used])], names=["f", "n"])

    often = found.select("f").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    known = np.zeros(_WIDTH, dtype=bool)
    known[often.where(F.col("n") >= MIN_TEXTS).select("f").toArrow().column(0).to_numpy()] = True
    shared = found.sparkSession.sparkContext.broadcast(known)  # fixed size: one flag per bucket

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], []
            for f, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                f, x = np.frombuffer(f, np.int32), _counts(f, x)
                out[0].append(f[shared.value[f]].tobytes()), out[1].append(x[shared.value[f]].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.binary()) for c in out)],
                                             names=["id", "label", "f", "x"])

    # one partition after the other: the driver's JVM never holds the whole sample
    got = sorted(((r["id"], r["f"], r["x"], r["label"]) for r in found.mapInArrow(prune, found.schema).toLocalIterator() if r["f"]),
                 reverse=True)
    return [(np.frombuffer(f, np.int32), _counts(f, x), label) for _, f, x, label in got]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, limit: int = SAMPLE_ROWS,
          text: str = "text", target: str = "toxic") -> dict[str, np.ndarray]:
    """Fit on at most about ``limit`` labelled rows, half of them of each label where there are enough."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != fold))
    one = known.groupBy("doc_id").agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, limit / 2 / totals[c]) if c in totals else 1.0 for c in (0, 1)}
    chosen = one.where(unit_hash("tox-1", F.col("doc_id")) < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            for i, t in enumerate(as_bytes(batch.column(2))):
                bucket = np.concatenate([np.zeros(0, np.uint64), *[x[3] for x in bags([t])]])
                used, count = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([used.astype(np.int32).tobytes()]),
                     pa.array([count.astype(np.uint32).tobytes()])], names=["id", "label", "f", "x"])

    # at most ``limit`` (id, label) rows are broadcast
    found, path = written(docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id")
                          .select(F.col("doc_id").cast("string").alias("id"), "label", "text")
                          .mapInArrow(run, "id string, label int, f binary, x binary"), "toxicity-bags")
    rows = sample_bags(found)
    drop_path(docs.sparkSession, path)
    model = fit(rows)
    # the sample holds more of the rarer label than all rows do
    model["bias"] = model["bias"] + PRIOR_SHARE * np.log(share[0] / share[1])
    return model


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (replaced if there was one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two floats per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, weight, bias = (shared.value[k] for k in ("value", "weight", "bias"))
        for batch in H.slices(batches):
            total, mass = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for first, end, rows, bucket in bags(as_bytes(batch.column(at))):
                total[first:end] += np.bincount(rows, value[bucket], end - first)
                mass[first:end] += np.bincount(rows, weight[bucket], end - first)
            out = bias[0] + total / np.maximum(mass, 1e-9)
            score = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    kept = docs.drop("score")
    at = kept.columns.index(text)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
