"""Text quality by a factorisation machine.

Features of a text are its hashed words (square root of their shares), structure statistics and
metadata of the text (shares of signs, capitals and digits, word and line lengths, repetition,
length), each statistic as one of a few bins. All pairs of features interact through low-rank
vectors; the sum-of-squares identity scores them in time linear in the features:
``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``. Trained in numpy by Adam on a bounded
sample; scored over Arrow batches.

Null text counts as empty; an empty text has only its bins. Several labels of one id: their
majority (ties: 1). Null labels are left out; without any label every score is 0.5.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import hashing as H
from framelens.llm.common import bounded_sample, fold_of

WORD_BITS, RANK = 16, 8
#: Bound of the labelled sample the machine is fitted on.
SAMPLE_ROWS = 10_000
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-5
THRESHOLD = 0.7
#: Least number of steps; a small sample is gone through more often.
MIN_STEPS = 480
#: Upper bin borders of each statistic.
BINS = {
    "length": [0, 50, 150, 400, 1000, 3000, 10000, 50000], "words": [0, 5, 20, 50, 150, 500, 2000, 10000],
    "signs": [0, .002, .01, .03, .06, .1, .2, .4], "junk": [0, .002, .01, .03, .06, .1, .2, .4],
    "capitals": [0, .01, .03, .06, .12, .25, .5, .8], "digits": [0, .002, .01, .03, .06, .1, .2, .4],
    "word_length": [1, 2, 3, 4, 5, 6, 8, 12], "distinct": [.02, .05, .1, .2, .4, .6, .8, .95],
    "top_share": [.02, .04, .06, .1, .15, .25, .5, .8], "same_next": [0, .002, .01, .05, .1, .3, .6, .9],
    "line_words": [1, 3, 8, 15, 30, 60, 120, 400], "bars": [0, .002, .005, .01, .02, .05, .1, .2],
    "repeats": [0, .02, .1, .2, .35, .5, .7, .9],
}
_WORDS = 1 << WORD_BITS
_STEP = max(map(len, BINS.values())) + 1
WIDTH = _WORDS + _STEP * len(BINS)


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[starts[1:]] - total[starts[:-1]]


def features(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, row, feature, value) of runs of texts; rows ascending from 0."""
    for first, end, data, starts in H.pieces(texts):
        n, plain = end - first, H.folded(data)
        ws, we = H.word_spans(plain)
        text_of = H.owner(starts, ws)
        hashes = H.Rolling(plain).hashes(ws, we)
        row, bucket, count = H.counted(text_of, hashes >> np.uint64(64 - WORD_BITS), _WORDS)
        words = np.bincount(text_of, minlength=n)
        size = np.maximum(np.diff(starts) - 1, 0)
        some, many = np.maximum(size, 1), np.maximum(words, 1)
        same = np.zeros(len(ws), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        tri = np.zeros(max(len(ws) - 2, 0), dtype=np.uint64)
        if len(tri):
            tri = H.mixed(H.mixed(hashes[:-2]) + hashes[1:-1]) + hashes[2:]
        inside = text_of[:len(tri)] == text_of[2:] if len(tri) else np.zeros(0, dtype=bool)
        trow, _, tcount = H.counted(text_of[:len(tri)][inside], (tri[inside] >> np.uint64(26)), 1 << 38)
        top = np.zeros(n)
        np.maximum.at(top, row, count)
        stat = {
            "length": size, "words": words,
            "signs": _sums((plain == 32) & (data > 32), starts) / some,
            "junk": _sums(np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8)), starts) / some,
            "capitals": _sums((data >= 65) & (data <= 90), starts) / some,
            "digits": _sums((data >= 48) & (data <= 57), starts) / some,
            "word_length": np.bincount(text_of, we - ws, n) / many,
            "distinct": np.bincount(row, minlength=n) / many,
            "top_share": top / many, "same_next": np.bincount(text_of, same, n) / many,
            "line_words": many / (_sums(data == 10, starts) + 1), "bars": _sums(data == 124, starts) / some,
            "repeats": np.bincount(trow, np.where(tcount > 1, tcount, 0), n) / many,
        }
        bins = np.stack([np.searchsorted(edges, stat[name], side="left") + _WORDS + _STEP * k
                         for k, (name, edges) in enumerate(BINS.items())], axis=1)
        rows = np.concatenate([row, np.repeat(np.arange(n), len(BINS))])
        feats = np.concatenate([bucket, bins.ravel()])
        values = np.concatenate([np.sqrt(count / many[row]), np.ones(bins.size)])
        order = np.argsort(rows, kind="stable")
        yield first, end, rows[order], feats[order], values[order].astype(np.float32)


def margins(model: dict[str, np.ndarray], ptr: np.ndarray, feats: np.ndarray, values: np.ndarray):
    """Raw outputs, and the factor sums that the gradient needs; ``ptr``: first entry of each row."""
    v = model["v"][feats] * values[:, None]
    sums = np.add.reduceat(v, ptr, axis=0)
    squares = np.add.reduceat((v * v).sum(1), ptr)
    linear = np.add.reduceat(model["w"][feats] * values, ptr)
    return model["b"][0] + linear + ((sums * sums).sum(1) - squares) / 2, sums


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the logistic loss; ``rows``: (features, values, label)."""
    rng = np.random.default_rng(seed)
    model = {"b": np.zeros(1, np.float32), "w": np.zeros(WIDTH, np.float32),
             "v": rng.normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)}
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in model.items()}
    step = 0
    for _ in range(max(EPOCHS, MIN_STEPS // -(-len(rows) // BATCH)) if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at:at + BATCH]]
            ptr = np.cumsum([0] + [len(r[0]) for r in part])[:-1]
            feats, values = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            label = np.array([r[2] for r in part], dtype=np.float32)
            out, sums = margins(model, ptr, feats, values)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label) / len(part)
            each = np.repeat(np.arange(len(part)), np.diff(np.append(ptr, len(feats))))
            gx = g[each] * values
            used, at_used = np.unique(feats, return_inverse=True)
            gv = np.empty((len(used), RANK), np.float32)
            for f in range(RANK):
                gv[:, f] = np.bincount(at_used, gx * (sums[each, f] - model["v"][feats, f] * values), len(used))
            grads = {"b": (np.zeros(1, int), np.array([g.sum()])), "w": (used, np.bincount(at_used, gx, len(used))), "v": (used, gv)}
            step += 1
            for name, (where, grad) in grads.items():
                m, s = state[name]
                grad = grad + DECAY * model[name][where]
                m[where] += 0.1 * (grad - m[where])
                s[where] += 0.01 * (grad * grad - s[where])
                model[name][where] -= RATE * m[where] / (np.sqrt(s[where]) + 1e-6)
    return model


def as_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def labelled(labels: DataFrame, target: str, folds: int, fold: int, limit: int, seed: str) -> DataFrame:
    """(doc_id, label) of a bounded sample of the labels outside one fold."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != fold))
    one = known.groupBy("doc_id").agg((F.avg(F.col(target).cast("double")) >= 0.5).cast("int").alias("label"))
    return bounded_sample(one, ["doc_id"], limit, seed)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, limit: int = SAMPLE_ROWS,
          text: str = "text", target: str = "quality") -> dict[str, np.ndarray]:
    """Fit on about ``limit`` labelled rows outside the fold; features are made by the executors."""
    chosen = labelled(labels, target, folds, fold, limit, "fm-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            for first, end, rows, feats, values in features(as_bytes(batch.column(2))):
                cut = np.searchsorted(rows, np.arange(1, end - first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first),
                     pa.array([x.astype(np.int32).tobytes() for x in np.split(feats, cut)], pa.binary()),
                     pa.array([x.tobytes() for x in np.split(values, cut)], pa.binary())], names=["id", "label", "f", "x"])

    # at most ``limit`` (id, label) rows are broadcast
    rows = (docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id")
            .select(F.col("doc_id").cast("string").alias("id"), "label", "text")
            .mapInArrow(run, "id string, label int, f binary, x binary").collect())
    rows.sort(key=lambda r: (r["id"], r["f"]))
    return fit([(np.frombuffer(r["f"], np.int32), np.frombuffer(r["x"], np.float32), r["label"]) for r in rows])


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score as ``name`` (replaced if there was one)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: WIDTH x (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            out = np.zeros(batch.num_rows)
            for first, end, rows, feats, values in features(as_bytes(batch.column(at))):
                ptr = np.searchsorted(rows, np.arange(end - first))
                out[first:end] = margins(shared.value, ptr, feats, values)[0]
            score = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    kept = docs.drop(name)
    at = kept.columns.index(text)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    out = score(docs, train(docs, labels), name=name)
    return out.where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
