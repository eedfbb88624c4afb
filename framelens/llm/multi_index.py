"""Near-duplicate vectors with an inverted multi-index.

Unit vectors are cut in halves, each half gets its own codebook, and the pairs of codes form a
grid of cells. A search goes to every cell that may hold a vector of cosine ``COSINE``: the least
distances of both halves to a cell (from the radii of its vectors, and from the planes between the
centres) must not exceed together what the cosine allows. So no link is missed, whatever the data;
where the bounds exclude no cell, all pairs are compared. Every candidate is verified by its cosine
in double precision.

Equal vectors are one class, so a group of copies is one candidate. Neighbouring cells form areas,
which are dealt out in blocks of bounded size. A block yields counts and one star per connected
part, never pairs. Of two areas only the lower one goes to the other; a link counts for both ends.

Vectors of each length have their own grid (of one cell if there are PER_CELL of them or fewer) and link
with none of another length. Vectors that are null, zero, or hold null or non-finite numbers link
with nothing and stay alone. A repeated id is a vector of its own in the counts.
Null ids: kept, without component. Empty table: no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import bounded_sample
from framelens.llm.components import components
from framelens.llm.simhash_gray import merge_labels
from framelens.session import written

COSINE = 0.9
#: Bound of the sample for the codebooks.
SAMPLE = 20_000
#: Wanted vectors per cell; codes per half are at most MAX_CODES.
PER_CELL, MAX_CODES = 64, 512
#: Largest squared distance of two linked unit vectors, with room for rounding.
REACH = 2 - 2 * COSINE + 1e-5
#: Centres whose planes bound the distance to other cells, and entries of one table of bounds.
PLANES, TABLE = 8, 1 << 22
#: Vectors of an area and of a block, and of a block of visitors.
MEMBERS, VISITORS = 2048, 2048


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(x: np.ndarray, codes: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of plain k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(codes, len(x)), replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


class Grid:
    """The two codebooks and the multi-sequence order of their product."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = max(1, sample.shape[1] // 2)
        parts = sample[:, :self.half], sample[:, self.half:] if sample.shape[1] > 1 else sample[:, :0]
        self.books = [codebook(p, codes, 5 + k) for k, p in enumerate(parts)]
        self.cells = len(self.books[0]) * len(self.books[1])

    def _both(self, x: np.ndarray):
        return distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self._both(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` cells of each row in multi-sequence order; not used by ``near_vectors``.

        The cell at sorted ranks (r, s) comes after all (r', s') with r' <= r and s' <= s, so
        only ranks with (r + 1) * (s + 1) <= count can be among the first ``count``.
        """
        a, b = self._both(x)
        near_a, near_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        r, s = np.nonzero((np.arange(1, a.shape[1] + 1)[:, None] * np.arange(1, b.shape[1] + 1)[None]) <= count)
        total = np.take_along_axis(a, near_a, 1)[:, r] + np.take_along_axis(b, near_b, 1)[:, s]
        first = np.argsort(total, axis=1, kind="stable")[:, :count]
        return (np.take_along_axis(near_a, r[first], 1) * b.shape[1] + np.take_along_axis(near_b, s[first], 1)).astype(np.int32)

    def spans(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row to the two centres of its cell."""
        a, b = self._both(x)
        row = np.arange(len(x))
        return a[row, cell // b.shape[1]], b[row, cell % b.shape[1]]


def least_squares(d: np.ndarray, gaps: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances from each row to the vectors of each code.

    ``d``: squared distances to the centres; ``gaps``: distances between the centres; ``low``,
    ``high``: least and largest distance of the vectors of a code to their centre. A vector of
    code k lies on k's side of the plane between k and any other centre.
    """
    far = np.sqrt(np.maximum(d, 0))
    bound = np.maximum(np.maximum(far - high, low - far), 0)
    near = np.argsort(d, axis=1, kind="stable")[:, :PLANES]
    for k in range(near.shape[1]):
        other = near[:, k]
        gap = gaps[other]
        # (almost) equal centres have no plane
        plane = np.divide(d - d[np.arange(len(d)), other][:, None], 2 * gap, out=np.zeros_like(d), where=gap > 1e-4)
        np.maximum(bound, plane, out=bound)
    return bound * bound


class Areas:
    """Areas of neighbouring cells, and which of them a vector must go to."""

    def __init__(self, grid: Grid, cells: dict[str, np.ndarray]):
        """``cells``: cell, number of vectors m, and least and largest squared distances of both halves."""
        order = np.argsort(cells["cell"])
        cells = {k: c[order] for k, c in cells.items()}
        self.grid, self.cells = grid, cells["cell"]
        start = (np.cumsum(cells["m"]) - cells["m"]) // MEMBERS
        self.area = np.unique(start, return_inverse=True)[1].astype(np.int32)
        self.first = np.flatnonzero(np.diff(self.area, prepend=-1))
        width = len(grid.books[1])
        self.codes = self.cells // width, self.cells % width
        self.bounds = []
        for book, code, low, high in zip(grid.books, self.codes, ("a0", "b0"), ("a1", "b1")):
            lows, highs = np.full(len(book), np.inf), np.zeros(len(book))
            np.minimum.at(lows, code, cells[low])
            np.maximum.at(highs, code, cells[high])
            self.bounds.append((np.sqrt(np.maximum(distances(book, book), 0)),
                                np.sqrt(np.maximum(np.where(np.isinf(lows), 0, lows), 0)), np.sqrt(highs)))

    def home(self, cell: np.ndarray) -> np.ndarray:
        return self.area[np.searchsorted(self.cells, cell)]

    def goes(self, x: np.ndarray, home: np.ndarray) -> Iterator[np.ndarray]:
        """For each row the areas from its own upwards that may hold a link."""
        step = max(1, TABLE // len(self.cells))
        for at in range(0, len(x), step):
            a, b = (least_squares(d, *known) for d, known in zip(self.grid._both(x[at:at + step]), self.bounds))
            fits = np.logical_or.reduceat(a[:, self.codes[0]] + b[:, self.codes[1]] <= REACH, self.first, axis=1)
            for row, own in zip(fits, home[at:at + step]):
                row[own] = True
                yield (own + np.flatnonzero(row[own:])).astype(np.int32)


def _all_pairs(table: pa.Table) -> pa.Table:
    """Links inside the one cell of a length with PER_CELL vectors at most."""
    x, ids, n = unit(_matrix(table.column("v").combine_chunks())), table.column("id").to_numpy(), table.column("n").to_numpy()
    near = x @ x.T >= COSINE
    np.fill_diagonal(near, False)
    label = merge_labels(np.arange(len(ids)), *np.nonzero(near))
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    return pa.table({"id": ids, "links": (near @ n).astype(np.int64), "low": low[label]})


def grid_links(classes: DataFrame, total: int) -> DataFrame:
    """(id, links, low) of the linked vectors of one length: their links, and an id of their component."""
    spark = classes.sparkSession
    taken = bounded_sample(classes, ["id"], SAMPLE, "grid-1").select("id", "v").toArrow()
    order = np.argsort(taken.column(0).to_numpy())
    sample = unit(_matrix(taken.column(1).combine_chunks()))[order]
    codes = int(min(MAX_CODES, max(2, round((total / PER_CELL) ** 0.5))))
    grid = Grid(sample, codes)
    shared = spark.sparkContext.broadcast(grid)  # fixed size: two codebooks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            x = unit(_matrix(batch.column(1)))
            cell = g.cell(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), *(pa.array(d) for d in g.spans(x, cell))],
                                             names=["id", "v", "n", "cell", "a", "b"])

    kind = classes.schema["v"].dataType.simpleString()
    placed, _ = written(classes.select("id", "v", "n").mapInArrow(
        place, f"id long, v {kind}, n long, cell int, a double, b double"), "vector-cells")
    # at most MAX_CODES^2 rows: every cell once
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.min("a").alias("a0"), F.max("a").alias("a1"),
                                       F.min("b").alias("b0"), F.max("b").alias("b1")).toArrow()
    areas = spark.sparkContext.broadcast(Areas(grid, {c: cells.column(c).to_numpy() for c in cells.column_names}))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = areas.value.home(batch.column(3).to_numpy())
            goes = list(areas.value.goes(unit(_matrix(batch.column(1))), home))
            ends = np.cumsum([0, *map(len, goes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *goes])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(home), lists], names=["id", "v", "n", "home", "goes"])

    routed, _ = written(placed.select("id", "v", "n", "cell").mapInArrow(
        route, f"id long, v {kind}, n long, home int, goes array<int>"), "vector-areas")
    members = routed.groupBy(F.col("home").alias("area")).agg(F.count(F.lit(1)).alias("m"))
    visitors = routed.select(F.explode("goes").alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("q"))
    blocks = members.join(visitors, "area").select("area", F.ceil(F.col("m") / MEMBERS).cast("int").alias("ms"),
                                                   F.ceil(F.col("q") / VISITORS).cast("int").alias("qs"))
    blocks, _ = written(blocks, "area-blocks")
    own = routed.select("id", "v", "n", "home", F.col("home").alias("area"), F.lit(True).alias("member"))
    goes = routed.select("id", "v", "n", "home", F.explode("goes").alias("area"), F.lit(False).alias("member"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = (own.join(blocks, "area").select("*", mine("ms").alias("mb"), every("qs").alias("qb"))
             .union(goes.join(blocks, "area").withColumn("mb", every("ms")).withColumn("qb", mine("qs"))))

    def verify(table: pa.Table) -> pa.Table:
        member = table.column("member").to_numpy()
        x, ids, n = (unit(_matrix(table.column("v").combine_chunks())), table.column("id").to_numpy(), table.column("n").to_numpy())
        both = table.column("home").to_numpy() != table.column("area").to_numpy()  # members do not come back
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        links = np.zeros(len(ids), dtype=np.int64)
        label = np.arange(len(ids))
        for at in range(0, len(q) if len(m) else 0, 256):
            part = q[at:at + 256]
            i, j = np.nonzero((x[part] @ x[m].T >= COSINE) & (ids[part][:, None] != ids[m][None]))
            if not len(i):
                continue
            links += np.bincount(part[i], n[m[j]], len(ids)).astype(np.int64)
            i, j = part[i], m[j]
            links += np.bincount(j[both[i]], n[i[both[i]]], len(ids)).astype(np.int64)
            label = merge_labels(label, i, j)
        # the smallest id of each part is its centre
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        out = np.flatnonzero((links > 0) | (low[label] != ids))
        return pa.table({"id": ids[out], "links": links[out], "low": low[label[out]]})

    return written(dealt.groupBy("area", "mb", "qb").applyInArrow(verify, "id long, links long, low long"), "vector-links")[0]


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = df.sparkSession
    v = F.col(f"`{vector}`")
    big = F.lit(1.7e308)
    fine = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= big))
            & F.exists(v, lambda x: x != 0))
    rows, _ = written(df.select(F.col(f"`{key}`").cast("long").alias("vec_id"),
                                F.when(F.coalesce(fine, F.lit(False)), v).alias("v")), "vectors")
    classes, _ = written(rows.where("v is not null and vec_id is not null").groupBy("v").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes")
    sized = classes.withColumn("size", F.size("v"))
    # vectors of different lengths are not compared; a length with few vectors has one cell
    lengths, _ = written(sized.groupBy("size").agg(F.count(F.lit(1)).alias("m")), "vector-lengths")
    rare = sized.join(lengths.where(F.col("m") <= PER_CELL), "size").select("size", "id", "v", "n")
    found = rare.groupBy("size").applyInArrow(_all_pairs, "id long, links long, low long")
    for row in lengths.where(F.col("m") > PER_CELL).orderBy("size").toLocalIterator():
        found = found.union(grid_links(sized.where(F.col("size") == row["size"]).select("id", "v", "n"), row["m"]))
    found, _ = written(found, "vector-links-all")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select("id", "low"))
    known = (classes.join(counts, "id", "left").join(roots, classes["id"] == roots["node"], "left")
             .select("v", F.col("n").alias("copies"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                     F.coalesce("root", "id").alias("root")))
    known, _ = written(known, "vector-parts")
    joined = rows.join(known, (rows["v"] == known["v"]) & rows["vec_id"].isNotNull(), "left")
    root = F.coalesce("root", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
                         root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
