"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(LEAST, TIMES * q)`` words that no neighbouring word extends keeping that period.

1. A word of a run occurs ``TIMES`` times or more inside it. Words that occur more rarely in their
   segment split it; segments of fewer than ``LEAST`` words go. Counts are taken again inside the
   new segments until nothing splits any more. Most texts end here.
2. At lag ``q`` only every ``q``-th place of a segment is compared with the next one, by the numbers of
   the 2^k-grams (2^k <= q) that begin there: a run holds two such matches in a row. Around matches
   in a row all words are compared, which gives the run's exact ends. Matches inside a run whose
   period divides the lag are passed over. So a segment of m words costs about m log m.

A text is handled inside one task, several short ones together; its memory is linear in the text.
Words are ``[^\\x20\\x09-\\x0D]+``. Null, empty and blank texts have no words: no runs, collapsed text
empty. Null ids and repeated rows are kept, each row on its own. Empty table: no rows. Columns
named runs or collapsed are replaced; all others stay.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import hashing as H
from framelens.llm.common import let, words_of

#: Least words of a run, and least repetitions of its period.
LEAST, TIMES = 6, 4
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def frequent_segments(words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches in which every word occurs TIMES times or more.

    ``words``: numbers of the words of several texts, one after the other; ``starts``: where each begins.
    """
    at = np.arange(len(words))
    fresh = np.zeros(len(words) + 1, dtype=bool)
    fresh[starts] = True
    values = int(words.max(initial=0)) + 1
    while len(at):
        new = np.concatenate([[True], np.diff(at) != 1]) | fresh[at]
        segment = np.cumsum(new) - 1
        size = np.bincount(segment)
        _, of, count = np.unique(segment * values + words[at], return_inverse=True, return_counts=True)
        stays = (count[of.ravel()] >= TIMES) & (size[segment] >= LEAST)
        if stays.all():
            first = at[new]
            return list(zip(first.tolist(), (first + size).tolist()))
        at = at[stays]
        # a split word parts its neighbours, as their places are no longer next to each other
    return []


def gram_numbers(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Numbers of the grams of 1, 2, 4, ... words at each place; equal numbers mean equal grams."""
    levels, size = [words], 1
    while 2 * size <= longest:
        last = levels[-1]
        pair = last[:-size].astype(np.int64) * (int(last.max()) + 1) + last[size:]
        levels.append(np.unique(pair, return_inverse=True)[1].ravel())
        size *= 2
    return levels


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n = len(words)
    levels = gram_numbers(words, n // TIMES)
    found = np.zeros((0, 3), dtype=np.int64)  # start, end, period
    for q in range(1, n // TIMES + 1):
        grid = levels[q.bit_length() - 1][::q]
        same = grid[1:] == grid[:-1]
        if not (same[1:] & same[:-1]).any():
            continue
        fresh = set()
        for c, d in zip(*_stretches(same)):
            if d - c < 2:
                continue
            own = found[q % found[:, 2] == 0]
            if len(own) and ((own[:, 0] <= c * q) & (d * q < own[:, 1])).any():
                continue  # a run of a smaller period
            low, high = max(0, (c - 1) * q), min(n - q, (d + 1) * q)
            for a, b in zip(*_stretches(words[low:high] == words[low + q:high + q])):
                start, end = int(low + a), int(low + b + q)
                cut = (a == 0 and low > 0) or (b == high - low and high < n - q)  # belongs to other matches
                if not cut and end - start >= max(LEAST, TIMES * q) and not (
                        (own[:, 0] == start) & (own[:, 1] == end)).any():
                    fresh.add((start, end, q))
        if fresh:
            found = np.concatenate([found, np.array(sorted(fresh), dtype=np.int64)])
    return [(int(s), int(e - s), int(q)) for s, e, q in found]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, end in frequent_segments(words, starts[sizes > 0]):
        of = int(np.searchsorted(starts, first, side="right")) - 1
        move = first - int(starts[of])
        out[of] += [(s + move, n, q) for s, n, q in lag_scan(words[first:end])]
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``runs``, an array of (start, length, period), and the ``collapsed`` text."""
    kept = df.drop("runs", "collapsed")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            texts = [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]
            found: list[list[tuple[int, int, int]]] = []
            for group in _groups(texts):
                found += runs_of(group)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found]
            left = [b" ".join(collapsed_words(w, f)).decode() for w, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _RUNS), pa.array(left, pa.string())],
                                             names=[*batch.schema.names, "runs", "collapsed"])

    long = T.LongType()
    kind = T.ArrayType(T.StructType([T.StructField(c, long) for c in ("start", "length", "period")]))
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("runs", kind),
                                              T.StructField("collapsed", T.StringType())]))


def _groups(texts: list[list[bytes]], most: int = 50_000) -> Iterator[list[list[bytes]]]:
    """Texts in order, together up to ``most`` words; a longer one alone."""
    held, size = [], 0
    for words in texts:
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def with_planted_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the texts of a tenth of the ids made periodic from some word on (null id: never)."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n > 0, F.concat_ws(" ", place)).otherwise("")

    periodic = F.when(h % 10 == 0, let(words_of(F.col(f"`{text}`")), planted)).otherwise(F.col(f"`{text}`"))
    return df.select(*[periodic.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])


def run_digest(df: DataFrame) -> DataFrame:
    """One row per document: number of runs, the greatest one, digests of all runs and of the rest."""
    found = periodic_runs(with_planted_runs(df.select("doc_id", "text")))
    # greatest length, then smallest start, then smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    return (found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
