"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Fingerprints of 64 bits are the majority bits of the hashes of all word shingles. Two of them
link at ``RADIUS`` or fewer differing bits. Distinct fingerprints are routed by the values of two
of six blocks of bits (four differences leave two blocks untouched), so every link meets in some
bucket; a bucket that grows too large is routed on by blocks of its other bits (one of five is
untouched). Inside a bucket the fingerprints stand in order of their Gray rank, which puts
neighbours with many shared bits side by side. Runs of them become nodes that hold the bits all
members share (mask and pattern), runs of nodes become upper nodes that hold what their nodes
share. A search goes down from the top, adds up the differences found in each level's own bits,
and drops a whole group as soon as there are more than ``RADIUS``.

A bucket yields only a star per connected part, never its pairs. Null and empty texts have the
fingerprint zero, linked like any other. Equal fingerprints are one class. Documents without an
id have no component. Repeated ids: each row keeps its own fingerprint. Empty table: no rows.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelens.llm import hashing as H
from framelens.llm.components import components
from framelens.session import written

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Bits of the six blocks, from the lowest; any two of them are a bucket key.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A bucket with more fingerprints is routed on by a third block.
LARGE_BUCKET = 1500
#: Members of a leaf, and children of an upper node, of the index.
FAN = 16
#: Buckets up to this size are one leaf: compared directly.
ONE_LEAF = 48
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all ``k``-word shingles; 0 without words."""
    import xxhash
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    n = max(len(words) - k + 1, 1)
    starts, stops = [0, *ends[:n - 1]], ends[k - 1:] if len(words) >= k else ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):  # long texts in slices of shingles
        hashes = np.array([digest(line[a:b - 1], SEED) for a, b in
                           zip(starts[at:at + (1 << 15)], stops[at:at + (1 << 15)])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """(all columns but the text, ``name`` as long) of each row."""
    rest = [c for c in df.columns if c not in (text, name)]
    taken = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(0).alias("row"),
                      F.col(f"`{text}`").cast("binary").alias("text"))
    kind = taken.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in H.slices(batches):
            prints = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["row", "f"])

    out = taken.mapInArrow(run, f"row {kind}, f long")
    return out.select(*[F.col(f"row.`{c}`") for c in rest], F.col("f").alias(name))


def gray_rank(f: Column) -> Column:
    """Place of a 64-bit pattern in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, shift))
    return f


def _bits(f: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(f, start).bitwiseAND(F.lit((1 << length) - 1))


def bucket_keys(f: Column) -> list[Column]:
    """One key for each two blocks: the number of the pair, then the bits of both."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    keys = []
    for k, (i, j) in enumerate(itertools.combinations(range(len(BLOCKS)), 2)):
        keys.append(F.lit(k << 32).cast("long") + F.shiftleft(_bits(f, starts[i], BLOCKS[i]), 11)
                    + _bits(f, starts[j], BLOCKS[j]))
    return keys


def deeper_keys(key: Column, f: Column) -> Column:
    """Five keys below a bucket: its other bits in five blocks, one of which has no difference."""
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    cases = F.array()
    for k, pair in enumerate(itertools.combinations(range(len(BLOCKS)), 2)):
        free = [b for i in range(len(BLOCKS)) if i not in pair for b in range(starts[i], starts[i] + BLOCKS[i])]
        keys = []
        for part in range(5):
            mask = sum(1 << b for b in free[part::5])
            mask -= (1 << 64) if mask >> 63 else 0
            keys.append(F.xxhash64(key, F.lit(part), f.bitwiseAND(F.lit(mask).cast("long"))))
        cases = F.when(F.shiftright(key, 32) == k, F.array(*keys)).otherwise(cases if k else F.array(*keys))
    return cases


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def tree(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (own mask, pattern) from the leaves up; ``prints`` in Gray order.

    A node's own mask holds the bits its members share and its parent's members do not.
    """
    levels, all_and, all_or = [], prints, prints
    while len(all_and) > 1:
        cuts = np.arange(0, len(all_and), FAN)
        all_and, all_or = np.bitwise_and.reduceat(all_and, cuts), np.bitwise_or.reduceat(all_or, cuts)
        levels.append((~(all_and ^ all_or), all_and))
        if len(all_and) <= FAN:
            break
    out = []
    for k, (mask, pattern) in enumerate(levels):
        above = levels[k + 1][0][np.arange(len(mask)) // FAN] if k + 1 < len(levels) else np.uint64(0)
        out.append((mask & ~above, pattern))
    return out


def search(prints: np.ndarray, first: int, end: int, levels) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within ``RADIUS``, i in [first, end) and j < i, by descent from the top level."""
    if not levels:
        return np.zeros(0, int), np.zeros(0, int)
    top = len(levels[-1][0])
    q = np.repeat(np.arange(first, end), top)
    node, lost = np.tile(np.arange(top), end - first), np.zeros(len(q), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        mask, pattern = levels[k]
        lost = lost + popcount((prints[q] ^ pattern[node]) & mask[node])
        span = FAN ** (k + 1)
        keep = (lost <= RADIUS) & (node * span < q)
        q, node, lost = q[keep], node[keep], lost[keep]
        below = len(prints) if k == 0 else len(levels[k - 1][0])
        child = (node[:, None] * FAN + np.arange(FAN)).ravel()
        q, lost = np.repeat(q, FAN), np.repeat(lost, FAN)
        real = child < below
        q, node, lost = q[real], child[real], lost[real]
    near = (node < q) & (popcount(prints[q] ^ prints[node]) <= RADIUS)
    return q[near], node[near]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least label of each connected part after linking the rows a[i] and b[i]."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            root = label[label]
            if (root == label).all():
                break
            label = root
    return label


def bucket_stars(key: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Row numbers of the least linked row of each row; rows ordered by key, then Gray rank."""
    n = len(key)
    label = np.arange(n)
    edge = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([start, [n]]))
    each = np.repeat(size, size)
    left = np.repeat(start + size, size) - np.arange(n)  # rows to the end of the bucket
    at = np.flatnonzero((each > 1) & (each <= ONE_LEAF))
    found = []
    for shift in range(1, ONE_LEAF):
        at = at[left[at] > shift]
        if not len(at):
            break
        near = at[popcount(prints[at] ^ prints[at + shift]) <= RADIUS]
        found.append((near + shift, near))
    if found:
        label = merge_labels(label, *(np.concatenate(x) for x in zip(*found)))
    for b in np.flatnonzero(size > ONE_LEAF):
        lo, m = start[b], size[b]
        own, local = prints[lo:lo + m], np.arange(m)
        levels = tree(own)
        for first in range(0, m, 256):
            local = merge_labels(local, *search(own, first, min(first + 256, m), levels))
        label[lo:lo + m] = lo + local
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, f, id) sorted by key and Gray rank → links (a, b); the last bucket waits for the next batch."""
    def links(key, prints, ids):
        label = bucket_stars(key, prints)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["a", "b"])

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1], side="left")
        if cut:
            yield links(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut])
        held = [x[cut:] for x in now]
    if held is not None and len(held[0]):
        yield links(held[0], held[1].view(np.uint64), held[2])


def print_links(classes: DataFrame) -> DataFrame:
    """Star links (a, b) between the ids of near fingerprints; ``classes``: (f, id), f distinct."""
    routed = classes.select("f", "id", F.explode(F.array(*bucket_keys(F.col("f")))).alias("key"))
    large, _ = written(routed.groupBy("key").count().where(F.col("count") > LARGE_BUCKET).select(
        "key", F.lit(True).alias("large")), "large-buckets")
    marked = routed.join(large, "key", "left")
    parts = F.when(F.col("large"), deeper_keys(F.col("key"), F.col("f"))).otherwise(F.array("key"))
    ready = marked.select(F.explode(parts).alias("key"), "f", "id")
    return (ready.repartition("key").sortWithinPartitions("key", gray_rank(F.col("f")))
            .select("key", "f", "id").mapInArrow(_stars, "a long, b long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, f, component_id) of each row: component_id is the smallest id reachable, th a hash of the text."""
    prints, _ = written(with_fingerprint(df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _text_hash(text).alias("th"),
                                                   F.col(f"`{text}`").alias("text")), "text", "f"), "prints")
    classes, _ = written(prints.groupBy("f").agg(F.min("doc_id").alias("id")).where("id is not null"), "print-classes")
    roots = components(print_links(classes))
    joined = classes.join(roots, classes["id"] == roots["node"], "left").select(
        F.col("f"), F.coalesce("root", "id").alias("component_id"))
    final, _ = written(joined, "print-components")
    return (prints.join(final, "f", "left")
            .select("doc_id", "th", "f", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def fingerprint_components(df: DataFrame) -> DataFrame:
    return near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: the one of the smallest id, of several texts with that id the one with the
    least hash, of equal rows any one. Rows without an id stay."""
    groups = near_duplicates(df, key, text).where("doc_id is not null")
    same = groups.groupBy("component_id", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    leads, _ = written(same.where("doc_id = component_id").groupBy("component_id").agg(
        F.min(F.struct("th", "n")).alias("lead")), "leads")
    marked = same.join(leads, "component_id").select(
        "doc_id", "th", ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("lead.th"))).alias("first"), "n")
    # what goes, and first rows that are there more than once
    touched, _ = written(marked.where("not first or n > 1").select("doc_id", "th", "first"), "near-copies")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"),
                     _text_hash(text).alias("th")).join(touched, ["doc_id", "th"], "left")
    again = rows.where("first").groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row")
    out = rows.where("first is null").select("row").union(again)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns])
