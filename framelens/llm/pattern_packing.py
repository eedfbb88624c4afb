"""Pack token pieces into sequences of fixed length by length patterns.

The histogram of piece lengths has a fixed number of rows, so the plan is made from it alone:
patterns of a few pieces that fill a sequence are enumerated over coarse length classes, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
what is left (shares of the fit are compared, see SHARES) goes to the best-fitting free space, longest first, equal pieces together. Every
piece then looks up its place by its rank among the pieces of its length.

A document is its token ids and one end id. Longer ones than a sequence are cut into full
pieces, of which the first may be shorter. Null text counts as empty: the end id alone. Null or
repeated ids: each row is packed on its own. Empty table: no rows.
"""
from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelens.llm import hashing as H
from framelens.session import written

LENGTH, END = 2048, 0
#: Width of a length class, and most pieces in an enumerated pattern.
GRAIN, PARTS = 16, 4
#: Shares of the fitted repeats that are tried; the plan with the fewest sequences is taken, of equal ones
#: the first. The last share leaves all pieces to best fit, so patterns never cost a sequence.
SHARES = (1.0, 0.8, 0.5, 0.0)
#: Least weight of a length class in the fit; short pieces find room anyway.
SHORT_WEIGHT = 0.1
#: Pieces of one length numbered together, about.
NUMBERED = 1_000_000
#: Texts of these characters alone take the fast coder, which gives the same ids.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ſ–-…€]*")


@functools.lru_cache(maxsize=2)
def _coder(path: str):
    """text → ids as uint32, by the tokenizer file; its rank file beside it serves plain texts."""
    import base64
    import os

    from tokenizers import Tokenizer
    exact = Tokenizer.from_file(path)
    fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, disallowed_special=())
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 length: int = LENGTH, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each piece, with its ``ids`` if wanted."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _coder(path)
        for batch in H.slices(batches):
            of, piece, start, size, crc, held = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                tokens = np.append(encode(t or ""), np.uint32(END)).astype("<u4")
                at = 0
                for k, stop in enumerate(range((len(tokens) - 1) % length + 1, len(tokens) + 1, length)):
                    part = tokens[at:stop]
                    of.append(row), piece.append(k), start.append(at), size.append(stop - at)
                    crc.append(zlib.crc32(part.tobytes()))
                    if ids:
                        held.append(part.astype(np.int32))
                    at = stop
            cols = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()), pa.array(crc, pa.int64())] + ([pa.array(held, pa.list_(pa.int32()))] if ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    taken = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fields = [taken.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    return taken.mapInArrow(run, T.StructType(fields))


def patterns(total: int, parts: int) -> list[tuple[int, ...]]:
    """All multisets of at most ``parts`` positive numbers with sum ``total``, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, most: int, left: int, head: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(head)
        elif left and most * left >= rest:
            for n in range(min(rest, most), 0, -1):
                grow(rest - n, n, left - 1, (*head, n))

    grow(total, total, parts, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000, product: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """argmin ||a x - b||, x >= 0, by the active-set method of Lawson and Hanson; ``product(r)``: a quick ``a.T @ r``."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    eps = 1e-9 * max(1.0, np.abs(b).max())
    for _ in range(rounds):
        used = np.flatnonzero(x)
        rest = b - a[:, used] @ x[used]
        slope = product(rest) if product else a.T @ rest
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= eps:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            own = a[:, at]
            try:
                z = np.linalg.solve(own.T @ own, own.T @ b)
            except np.linalg.LinAlgError:
                z = np.linalg.lstsq(own, b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            step = (x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)).min()
            x[at] += step * (z - x[at])
            x[at[bad & (x[at] <= eps)]] = 0
            x[at[np.flatnonzero(bad)[np.argmin(x[at][bad])]]] = 0
            active[at[x[at] <= 0]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], length: int = LENGTH, grain: int = GRAIN, parts: int = PARTS
         ) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(piece length, times)]) groups that hold every piece of the histogram."""
    full = histogram.get(length, 0)
    counts = {n: c for n, c in histogram.items() if c > 0 and n != length}
    classes = -(-length // grain)
    need = np.zeros(classes + 1)
    for n, c in counts.items():
        need[-(-n // grain)] += c
    times = np.zeros(0)
    # lengths are rounded up to classes, so k pieces that fill a sequence may come to k - 1 classes more
    forms = [f for more in range(parts) for f in patterns(length // grain + more, parts) if len(f) > more] if counts else []
    if forms:
        a = np.zeros((classes + 1, len(forms)))
        for k, form in enumerate(forms):
            for n in form:
                a[n, k] += 1
        weight = np.clip(np.arange(classes + 1) * 8 / classes, SHORT_WEIGHT, 1)
        parts_of = np.array([[*form, *[0] * (parts - len(form))] for form in forms])  # class 0 holds nothing
        times = nnls(a * weight[:, None], need * weight / max(need.max(), 1),
                     product=lambda r: np.where(np.arange(classes + 1) > 0, r * weight, 0)[parts_of].sum(1)) * max(need.max(), 1)
    best: list[tuple[int, list[tuple[int, int]]]] | None = None
    for share in SHARES:
        groups = _filled(counts, forms, share * times, length, grain)
        if best is None or sum(m for m, _ in groups) < sum(m for m, _ in best):
            best = groups
    return ([(full, [(length, 1)])] if full else []) + (best or [])


def _filled(counts: dict[int, int], forms: list[tuple[int, ...]], times: np.ndarray, length: int, grain: int
            ) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups by the rounded repeats of the patterns; all other pieces go to the best-fitting free space."""
    left = dict(counts)
    open_: list[list] = [[] for _ in range(length + 1)]  # by free space: (count, pieces)
    for k in np.argsort(-times, kind="stable"):
        _repeat(forms[k], int(times[k]), left, open_, length, grain)
    for n in sorted(left, reverse=True):
        _best_fit(n, left[n], open_, length)
    return [g for free in open_ for g in free]


def _repeat(form: Sequence[int], times: int, left: dict[int, int], open_: list[list], length: int, grain: int) -> None:
    """Take a pattern ``times`` times at most, each class from its longest pieces down.

    The last piece is the longest that fits, and must leave less than a class free.
    """
    while times > 0:
        taken: dict[int, int] = {}
        space = length
        for k, c in enumerate(form):
            top, low = (space, space - grain) if k + 1 == len(form) else (c * grain, (c - 1) * grain)
            found = next((n for n in range(top, max(low, 0), -1) if left.get(n, 0) > taken.get(n, 0)), 0)
            if not found:
                return
            taken[found] = taken.get(found, 0) + 1
            space -= found
        runs = min(times, *(left[n] // k for n, k in taken.items()))
        for n, k in taken.items():
            left[n] -= runs * k
        open_[length - sum(n * k for n, k in taken.items())].append((runs, sorted(taken.items(), reverse=True)))
        times -= runs


def _best_fit(n: int, count: int, open_: list[list], length: int) -> None:
    """Put ``count`` pieces of one length into the least sufficient free spaces, then into new sequences."""
    for free in range(n, length):
        while count and open_[free]:
            many, pieces = open_[free].pop()
            each = min(free // n, -(-count // many))
            used = min(many, count // each)
            if used < many:
                open_[free].append((many - used, pieces))
            open_[free - n * each].append((used, [*pieces, (n, each)]))
            count -= used * each
    if count:
        each = length // n
        if count >= each:
            open_[length - n * each].append((count // each, [(n, each)]))
        if count % each:
            open_[length - n * (count % each)].append((1, [(n, count % each)]))


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times per sequence, first sequence, offset) of each slot."""
    out, ranks, base = [], {}, 0
    for many, pieces in groups:
        offset = 0
        for n, k in pieces:
            first = ranks.get(n, 0)
            ranks[n] = first + many * k
            out.append((n, first, ranks[n], k, base, offset))
            offset += n * k
        base += many
    return out


def packed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``length`` rows
    total = sum(histogram.values())
    slots = places(plan(histogram, length))
    # bounded by the histogram, whatever the number of pieces: at most ``length`` rows, whose size Spark sees
    table = spark.createDataFrame(slots, "length long, first long, stop long, times long, base long, at long")
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("first", "stop", "times", "base", "at"))).alias("slots"))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(16 + total // NUMBERED)).cast("int")
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    before, _ = written(before, "rank-offsets")
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))
    slot = F.get(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["stop"])), F.lit(0))
    found = ranked.join(by_length, "length").select(*[F.col(c) for c in pieces.columns], "rank", slot.alias("slot"))
    inside = F.col("rank") - F.col("slot.first")
    return found.select(
        *pieces.columns, (F.col("slot.base") + F.floor(inside / F.col("slot.times"))).cast("long").alias("sequence_id"),
        (F.col("slot.at") + inside % F.col("slot.times") * F.col("length")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                   length: int = LENGTH, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    pieces, _ = written(token_pieces(df, key, text, tokenizer, length, ids), "pieces")
    return packed(pieces, length)
