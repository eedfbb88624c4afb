"""Distances from depth rasters and 3-D boxes built from them.

Rasters are long tables ``frame, px, py, v``; detections meet them by frame and image cell.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from framelens.functions.geometry import Box, bind
from framelens.functions.polygons import POINTS
from framelens.plans.selection import lower_medians
from framelens.session import written

# fixed values: width prior, depth cap, report bins, class sizes
WIDTH_RATIO = 0.4158
MAX_METERS = 20.0
DISTANCE_BINS = [(0, 5), (5, 8), (8, 12), (12, 18), (18, 30), (30, 999)]
CLASS_SIZES = {0: (0.5, 1.7), 2: (1.85, 1.5), 5: (2.55, 3.2), 7: (2.5, 3.0)}
#: Side of the image cells, in raster pixels.
CELL = 32


def pixel_meters(v: Column, lo: Column, hi: Column, scale: float = 1.0) -> Column:
    """Inverse 8-bit depth to metres; 0 when the range is empty."""
    return F.when(hi <= lo, 0.0).otherwise((lo + (F.lit(255.0) - v) * (hi - lo) / 255.0) * scale)


def depth_rectangle(b: Box, roi: tuple, dw: Column, dh: Column) -> Column:
    """Struct (x, y, w, h) of a box in raster pixels, null when nothing is left. Division truncates."""
    rx, ry, rw, rh = [F.col(c) if isinstance(c, str) else F.lit(c) for c in roi]

    def at(v: Column, origin: Column, size: Column, extent: Column) -> Column:
        raw = ((v - origin) * size / extent).cast("int")
        return F.greatest(F.lit(0), F.least(size - 1, raw))
    x1, x2 = at(b.left, rx, dw, rw), at(b.right, rx, dw, rw)
    y1, y2 = at(b.top, ry, dh, rh), at(b.bottom, ry, dh, rh)
    ok = (rw > 0) & (rh > 0) & (dw > 0) & (dh > 0) & (x2 > x1) & (y2 > y1)
    return F.when(ok, F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1 + 1).alias("w"), (y2 - y1 + 1).alias("h")))


def ground_band(rect: Column, band: float, dw: Column, dh: Column) -> Column:
    """Lower ``band`` share of a rectangle, middle 60 % of its width."""
    share = band if 0.0 < band < 1.0 else 1.0
    bh = F.greatest(F.lit(1), F.floor(rect["h"] * share + 0.5).cast("int"))
    x = rect["x"] + F.floor(rect["w"] * 2 / 10).cast("int")
    y = rect["y"] + rect["h"] - bh
    w = F.greatest(F.lit(1), F.floor(rect["w"] * 6 / 10).cast("int"))
    return F.struct(x.alias("x"), y.alias("y"), F.least(w, dw - x).alias("w"), F.least(bh, dh - y).alias("h"))


def region_values(regions: DataFrame, pixels: DataFrame, cell: int = CELL) -> DataFrame:
    """How many pixels of each region (``frame, det_idx, rect``) have each value: parts of ``n``.

    Pixels are counted once by image cell and value. Cells inside a region give it their counts;
    only cells on its border are read pixel by pixel.
    """
    rect = F.col("rect")
    last_x, last_y = rect["x"] + rect["w"] - 1, rect["y"] + rect["h"] - 1
    cells = regions.where(rect.isNotNull()).select(
        "frame", "det_idx", "rect", F.explode(F.sequence(F.floor(rect["x"] / cell), F.floor(last_x / cell))).alias("cx"))
    cells = cells.withColumn("cy", F.explode(F.sequence(F.floor(rect["y"] / cell), F.floor(last_y / cell))))
    left, top = F.col("cx") * cell, F.col("cy") * cell
    cells = cells.withColumn("inner", (left >= rect["x"]) & (left + cell - 1 <= last_x)
                             & (top >= rect["y"]) & (top + cell - 1 <= last_y))
    px = pixels.select("frame", "px", "py", "v", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy"))
    counts = px.groupBy("frame", "cx", "cy", "v").agg(F.count(F.lit(1)).alias("n"))
    inner = cells.where("inner").join(counts, ["frame", "cx", "cy"]).select("frame", "det_idx", "v", "n")
    border = cells.where(~F.col("inner")).join(px, ["frame", "cx", "cy"]).where(
        F.col("px").between(rect["x"], last_x) & F.col("py").between(rect["y"], last_y)).select(
        "frame", "det_idx", "v", F.lit(1).cast("long").alias("n"))
    return inner.union(border)


def region_medians(regions: DataFrame, pixels: DataFrame, cell: int = CELL) -> DataFrame:
    """Upper median of all pixels of each region (``frame, det_idx, rect``); values are bytes.

    Regions meet the pixels of an image cell as two arrays in one row, so pixels by region are never rows. A region
    inside one cell gets the middle one of its pixels; of others every cell gives the values with their
    counts. Further columns are kept. The result is written once, as it is read for both kinds of regions.
    """
    keep = [c for c in regions.columns if c not in ("frame", "rect")]
    # unnesting computes a rectangle once, however often its fields are read
    known = regions.select("frame", *keep, F.inline(F.array("rect"))).where("x is not null").withColumnsRenamed(
        {"x": "_x", "y": "_y", "w": "_w", "h": "_h"})
    last_x, last_y = F.col("_x") + F.col("_w") - 1, F.col("_y") + F.col("_h") - 1

    def cell_of(v: Column | str) -> Column:
        return F.floor((F.col(v) if isinstance(v, str) else v) / cell).cast("int")
    cells = known.select("*", F.explode(F.sequence(cell_of("_x"), cell_of(last_x))).alias("cx")).select(
        "*", F.explode(F.sequence(cell_of("_y"), cell_of(last_y))).alias("cy"))
    whole = (cell_of("_x") == cell_of(last_x)) & (cell_of("_y") == cell_of(last_y))
    left, top = F.col("cx") * cell, F.col("cy") * cell
    own = cells.groupBy("frame", "cx", "cy").agg(F.collect_list(F.struct(
        *keep, F.greatest(F.col("_x") - left, F.lit(0)).cast("int").alias("x"), F.greatest(F.col("_y") - top, F.lit(0)).cast("int").alias("y"),
        F.least(last_x - left, F.lit(cell - 1)).cast("int").alias("x2"), F.least(last_y - top, F.lit(cell - 1)).cast("int").alias("y2"),
        whole.alias("whole"))).alias("regions"))
    rows = own.join(_cell_pixels(pixels, cell), ["frame", "cx", "cy"]).select("frame", "regions", "pixels")
    bins = ArrayType(StructType([StructField("v", IntegerType()), StructField("n", IntegerType())]))
    out = StructType([regions.schema["frame"], *[regions.schema[c] for c in keep], StructField("median", LongType()), StructField("bins", bins)])
    found, _ = written(rows.mapInArrow(_cell_medians, out), "medians")
    parts = found.where("bins is not null").select("frame", *keep, F.inline("bins"))
    return found.where("bins is null").drop("bins").unionByName(_merged_medians(parts, ["frame", *keep]))


def _cell_medians(batches: Iterator[pa.RecordBatch], pairs: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Medians of the regions of each cell, for some cells at a time (``pairs`` of region and pixel, or one cell).

    Regions that are not ``whole`` in their cell get ``bins`` instead: their values there with counts.
    """
    for batch in batches:
        boxes, lists = batch.column("regions").flatten(), batch.column("pixels")
        x, y, x2, y2 = [boxes.field(c).to_numpy().astype("int64") for c in ("x", "y", "x2", "y2")]
        n_regions, n_pixels = [np.diff(batch.column(c).offsets.to_numpy()).astype("int64") for c in ("regions", "pixels")]
        of = np.repeat(np.arange(len(batch)), n_regions)
        size = np.bincount(of, (x2 - x + 1) * (y2 - y + 1), len(batch)).astype("int64")
        done, start = np.cumsum(size + n_pixels), 0
        ends, first = np.cumsum(n_regions), np.cumsum(n_regions) - n_regions
        while start < len(done):
            stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + pairs, "right")))
            a, b = first[start], ends[stop - 1]
            codes = lists.slice(start, stop - start).flatten().to_numpy()
            place = np.repeat(np.arange(stop - start), n_pixels[start:stop])
            region, value = _region_pixels(of[a:b] - start, x[a:b], y[a:b], x2[a:b], y2[a:b], place, codes)
            yield _medians(batch.column("frame"), boxes.slice(a, b - a), of[a:b], region, value)
            start = stop


def _region_pixels(home: np.ndarray, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, cell: np.ndarray,
                   codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Region and value of each pixel in a region, by region and value. ``home``: cell of a region, ``cell``: of a pixel."""
    px, py, v = codes & (_PLACE - 1), (codes >> _BITS) & (_PLACE - 1), codes >> (2 * _BITS)
    width, height = (int(px.max()) + 1, int(py.max()) + 1) if len(codes) else (1, 1)
    at = (cell * height + py) * width + px
    cells = int(max(home.max(initial=-1), cell.max(initial=-1))) + 1
    w, h = np.maximum(np.minimum(x2, width - 1) - x + 1, 0), np.maximum(np.minimum(y2, height - 1) - y + 1, 0)
    # places of the rows of the regions, then of their pixels
    row = np.repeat(np.arange(len(home)), h)
    base = (home[row] * height + y[row] + np.arange(len(row)) - np.repeat(np.cumsum(h) - h, h)) * width + x[row]
    n = w[row]
    where = np.repeat(base, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    region = np.repeat(row, n)
    many = np.bincount(at, minlength=cells * height * width)
    if many.max(initial=0) <= 1:
        image = np.full(cells * height * width, -1, dtype="int64")
        image[at] = v
        value = image[where]
        region, value = region[value >= 0], value[value >= 0]
    else:
        # a pixel may be listed more than once
        order, count = np.argsort(at, kind="stable"), many[where]
        begin = (np.cumsum(many) - many)[where]
        value = v[order][np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        region = np.repeat(region, count)
    key = np.sort((region << 32) | value)
    return key >> 32, key & 0xFFFFFFFF


def _medians(frames: pa.Array, regions: pa.StructArray, row: np.ndarray, region: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    keep = [f.name for f in regions.type if f.name not in ("x", "y", "x2", "y2", "whole")]
    hits = np.bincount(region, minlength=len(regions))
    some = np.flatnonzero(hits)
    middle = value[(np.cumsum(hits) - hits + hits // 2)[some]]
    at = pa.array(some)
    columns = [frames.take(pa.array(row[some])), *[regions.field(c).take(at) for c in keep]]
    if regions.type.get_field_index("whole") < 0:
        return pa.RecordBatch.from_arrays([*columns, pa.array(middle)], names=["frame", *keep, "median"])
    whole = regions.field("whole").to_numpy(zero_copy_only=False)
    # values and counts of the others
    rest = ~whole[region]
    region, value = region[rest], value[rest]
    new = np.flatnonzero((np.diff(region, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0))
    counts = np.diff(np.append(new, len(region)))
    each = np.bincount(region[new], minlength=len(regions))[some]
    bins = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(each)).astype("int32")),
        pa.StructArray.from_arrays([pa.array(value[new].astype("int32")), pa.array(counts.astype("int32"))], names=["v", "n"]),
        mask=pa.array(whole[some]))
    return pa.RecordBatch.from_arrays([*columns, pa.array(middle, mask=~whole[some]), bins], names=["frame", *keep, "median", "bins"])


#: Bits of a pixel's column and row in its cell.
_BITS = 10
_PLACE = 1 << _BITS


def _cell_pixels(pixels: DataFrame, cell: int) -> DataFrame:
    """One row per image cell with its ``pixels``: value, row and column of each in one number, put together map-side."""
    if cell > _PLACE:
        raise ValueError(f"cells may have {_PLACE} pixels a side at most")
    places = [F.pmod(F.col(c), F.lit(cell)).cast("int") for c in ("py", "px")]
    number = (F.col("v").cast("int") * _PLACE + places[0]) * _PLACE + places[1]
    return pixels.groupBy("frame", *[F.floor(F.col(p) / cell).cast("int").alias(c) for p, c in (("px", "cx"), ("py", "cy"))]).agg(
        F.collect_list(number).alias("pixels"))


def _merged_medians(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    # at most 256 values a region, counted map-side
    bins = parts.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    packed = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("h"), F.sum("n").alias("total"))
    walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")),
                       lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(
                           a["v"], F.when(a["seen"] + x["n"] > F.floor(F.col("total") / 2), x["v"].cast("long"))).alias("v")),
                       lambda a: a["v"])
    return packed.select(*keys, walk.alias("median"))


def _accepted(meters: Column, hi: Column, scale: float) -> Column:
    return (meters >= 0) & (meters <= hi * scale + 1e-3)


def box_distances(dets: DataFrame, rasters: DataFrame, pixels: DataFrame, scale: float = 1.0,
                  band: float | None = None) -> DataFrame:
    """Detections with ``meters`` from the median depth of their box, or of its ground band."""
    joined = dets.join(rasters, "frame")
    rect = depth_rectangle(Box.of(), ("roi_x", "roi_y", "roi_w", "roi_h"), F.col("dw"), F.col("dh"))
    # what the result needs travels with the region, so medians are not joined back; unnesting computes a rectangle once
    known = joined.where("hi > lo").select(*dets.columns, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "dw", "dh", F.inline(
        F.array(rect)).alias("_rx", "_ry", "_rw", "_rh")).where("_rx is not null")
    rect = F.struct(*[F.col(f"_r{c}").alias(c) for c in "xywh"])
    if band is not None:
        rect = ground_band(rect, band, F.col("dw"), F.col("dh"))
    kept = known.select(*dets.columns, "_lo", "_hi", rect.alias("rect"))
    out = region_medians(kept, pixels).withColumnsRenamed({"_lo": "lo", "_hi": "hi"}).withColumn(
        "meters", pixel_meters(F.col("median"), F.col("lo"), F.col("hi"), scale))
    return out.where(_accepted(F.col("meters"), F.col("hi"), scale)).select(*dets.columns, "meters")


def near_targets(distances: DataFrame, near_m: float) -> DataFrame:
    """Frames with objects within ``near_m``: their number and list."""
    near = distances.where(F.col("meters") <= near_m)
    return near.groupBy("frame").agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct(
            F.col("det_idx"), F.col("cls").alias("class"), F.col("meters").alias("distance_m")))).alias("targets"))


# raster ranges -------------------------------------------------------------------------

def percentile_range(pixels: DataFrame, bins: int = 256, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Range of each frame between two histogram percentiles (bin starts), merged map-side."""
    span = pixels.groupBy("frame").agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count(F.lit(1)).alias("n"))
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("mn")) * (F.lit(float(bins)) / (
        F.col("mx") - F.col("mn"))))))
    hist = (pixels.join(span.hint("shuffle_hash"), "frame").where("mx - mn >= 1e-6").groupBy("frame", b.alias("b"))
            .agg(F.count(F.lit(1)).alias("c")))
    packed = hist.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("h"))
    rows = span.join(packed, "frame", "left")

    def reach(target: Column) -> Column:
        """First bin at which the running count reaches the target."""
        return F.aggregate("h", F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("b")),
                           lambda a, x: F.struct((a["s"] + x["c"]).alias("s"), F.coalesce(
                               a["b"], F.when(a["s"] + x["c"] >= target, x["b"].cast("long"))).alias("b")), lambda a: a["b"])
    width = (F.col("mx") - F.col("mn")) / bins
    low_bin, high_bin = reach(F.floor(F.col("n") * low / 100.0)), reach(F.floor(F.col("n") * high / 100.0))
    # the lower bound moves off bin 0 unless the upper bound is found there
    lo = F.col("mn") + F.when(high_bin == 0, F.lit(0)).otherwise(F.greatest(low_bin, F.lit(1))) * width
    hi = F.col("mn") + high_bin * width
    return rows.select("frame", F.coalesce(lo, F.col("mn")).alias("lo"), F.coalesce(hi, F.col("mx")).alias("hi"))


def normal_range(pixels: DataFrame, cap: float = MAX_METERS, histogram: bool = False) -> DataFrame:
    """Range used for the 8-bit image: min/max or percentiles, capped, never empty."""
    base = percentile_range(pixels) if histogram else pixels.groupBy("frame").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    hi = F.least("hi", F.lit(cap)) if cap > 0 else F.col("hi")
    return base.select("frame", "lo", F.when(hi <= F.col("lo"), F.col("lo") + 1.0).otherwise(hi).alias("hi"))


def to_bytes(pixels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Depth to inverse 8-bit values: near is bright, rounded half to even and clamped."""
    level = F.bround((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")), 0)
    byte = 255 - F.least(F.lit(255), F.greatest(F.lit(0), level.cast("int")))
    # one row per frame is held, pixels are not sorted
    return pixels.join(ranges.hint("shuffle_hash"), "frame").select("frame", "px", "py", byte.alias("v8"))


# 3-D boxes -----------------------------------------------------------------------------

def box_3d(b: Box, z: Column, p2: Sequence[float], yaw_deg: float = 0.0) -> Column:
    """Size and pose of a 3-D box from a 2-D box and ground distance; null for bad input."""
    fx, fy = float(p2[0]), float(p2[5])
    alpha = math.radians(yaw_deg)
    ok = (z > 0) & (b.width > 1) & (b.height > 1) & F.lit(fx > 0 and fy > 0)
    length = b.width * z / fx
    return F.when(ok, F.struct(
        z.cast("double").alias("z"), b.cx.alias("u"), b.cy.alias("v"), (b.height * z / fy).alias("h3"),
        length.alias("l3"), (length * WIDTH_RATIO).alias("w3"),
        F.lit(math.sin(alpha)).alias("sin_a"), F.lit(math.cos(alpha)).alias("cos_a")))


# fixed values: corner signs along length, height and width
CORNERS = [(1, 1, 1), (1, 1, -1), (-1, 1, -1), (-1, 1, 1), (1, -1, 1), (1, -1, -1), (-1, -1, -1), (-1, -1, 1)]


def project_corners(box: Column, p2: Sequence[float]) -> Column:
    """Image points of the eight corners, null when one lies behind the camera."""
    return bind(box, lambda item: _corners(item, p2))


def _corners(item: Column, p2: Sequence[float]) -> Column:
    p = [float(v) for v in p2]
    fx, fy, cx, cy = p[0], p[5], p[2], p[6]
    if not (fx > 0 and fy > 0):
        raise ValueError("focal lengths must be positive")
    norm = F.sqrt(item["sin_a"] * item["sin_a"] + item["cos_a"] * item["cos_a"])
    s, c = item["sin_a"] / norm, item["cos_a"] / norm
    centre = F.struct(((item["u"] - cx) * item["z"] / fx).alias("x"), ((item["v"] - cy) * item["z"] / fy).alias("y"))
    signs = F.array(*[F.struct(*[F.lit(v / 2).alias(n) for v, n in zip(row, "lhw")]) for row in CORNERS])

    def corner(k: Column) -> Column:
        ahead, up, aside = k["l"] * item["l3"], k["h"] * item["h3"], k["w"] * item["w3"]
        at = F.struct((c * ahead + s * aside + centre["x"]).alias("x"), (up + centre["y"]).alias("y"),
                      (c * aside - s * ahead + item["z"]).alias("z"))

        def image(q: Column) -> Column:
            depth = q["x"] * p[8] + q["y"] * p[9] + q["z"] * p[10] + p[11]
            return bind(depth, lambda d: F.when(d > 1e-3, F.struct(
                ((q["x"] * p[0] + q["y"] * p[1] + q["z"] * p[2] + p[3]) / d).alias("x"),
                ((q["x"] * p[4] + q["y"] * p[5] + q["z"] * p[6] + p[7]) / d).alias("y"))))
        return bind(at, image)

    ok = (item["z"] > 0) & (item["l3"] > 0) & (item["h3"] > 0) & (item["w3"] > 0)
    return F.when(ok, bind(F.transform(signs, corner), lambda pts: F.when(~F.exists(pts, lambda q: q.isNull()), pts)))


def wireframes(ground: DataFrame, p2: Sequence[float], min_depth: float = 8.0) -> DataFrame:
    """Detections with ground distance ``meters`` to corner points; closer ones are dropped."""
    if not (p2[0] > 0 and p2[5] > 0):
        raise ValueError("focal lengths must be positive")
    far = ground.where(F.col("meters") >= min_depth)
    out = StructType([*far.schema, StructField("corners", POINTS)])
    return far.mapInArrow(partial(_wire_batches, p2=[float(v) for v in p2]), out)


def _wire_batches(batches: Iterator[pa.RecordBatch], p2: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """``project_corners(box_3d(..))`` in the same steps on arrays; rows without all corners are left out."""
    fx, fy, cx, cy = p2[0], p2[5], p2[2], p2[6]
    for batch in batches:
        left, top, right, bottom, z = [batch.column(c).to_numpy(zero_copy_only=False).astype("float64")
                                       for c in ("left", "top", "right", "bottom", "meters")]
        ok = (z > 0) & (right - left > 1) & (bottom - top > 1)
        length, height = (right - left) * z / fx, (bottom - top) * z / fy
        width = length * WIDTH_RATIO
        x0, y0 = ((left + right) / 2 - cx) * z / fx, ((top + bottom) / 2 - cy) * z / fy
        points = []
        for ahead, up, aside in CORNERS:
            # no yaw: along, up and across are the axes
            x, y, at = ahead / 2 * length + x0, up / 2 * height + y0, aside / 2 * width + z
            depth = x * p2[8] + y * p2[9] + at * p2[10] + p2[11]
            ok &= depth > 1e-3
            depth = np.where(ok, depth, 1.0)
            points.append([(x * p2[k] + y * p2[k + 1] + at * p2[k + 2] + p2[k + 3]) / depth for k in (0, 4)])
        some = np.flatnonzero(ok)
        xs, ys = [pa.array(np.stack([p[k][some] for p in points], 1).ravel()) for k in (0, 1)]
        corners = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype="int32") * len(CORNERS)),
                                           pa.StructArray.from_arrays([xs, ys], names=["x", "y"]))
        yield pa.RecordBatch.from_arrays([*[c.take(pa.array(some)) for c in batch.columns], corners],
                                         names=[*batch.schema.names, "corners"])


def overflow_report(dets: DataFrame, p2: Sequence[float], frame_w: int) -> DataFrame:
    """Wireframe width ratio and share leaving the frame, by distance estimated from the box foot."""
    fy, cy = float(p2[5]), float(p2[6])
    z = F.lit(fy * 1.5) / (F.col("bottom") - cy)
    rows = (dets.where((F.col("bottom") - F.col("top")).between(25, 400) & (F.col("bottom") != cy))
            .withColumn("z", z).where("z > 1 and z < 200"))
    points = project_corners(box_3d(Box.of(), F.col("z"), p2), p2)
    rows = rows.withColumn("pts", points).withColumn("xs", F.transform("pts", lambda q: q["x"]))
    rows = rows.withColumn("x1", F.array_min("xs")).withColumn("x2", F.array_max("xs"))
    over = F.col("pts").isNull() | (F.col("x2") > frame_w) | (F.col("x1") < 0)
    label = F.lit(None).cast("string")
    for lo, hi in reversed(DISTANCE_BINS):
        label = F.when((F.col("z") >= lo) & (F.col("z") < hi), f"{lo}-{hi}").otherwise(label)
    rows = rows.withColumn("bin", label).withColumn("ratio", (F.col("x2") - F.col("x1")) / (F.col("right") - F.col("left")))
    rows = rows.where("bin is not null")
    counts = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.count_if(over) / F.count(F.lit(1)) * 100).alias("overflow"))
    return counts.join(lower_medians(rows, ["bin"], ["ratio"]), "bin", "left").select("bin", "n", "ratio", "overflow")


def size_consistency(dets: DataFrame, fx: float, fy: float, min_height: int = 200) -> DataFrame:
    """Distance from known width against distance from known height for large boxes, per class."""
    sizes = F.create_map(*[F.lit(v) for k, (w, h) in CLASS_SIZES.items() for v in (
        k, F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))])
    size = F.coalesce(F.element_at(sizes, F.col("cls").cast("int")), F.struct(F.lit(1.85).alias("w"), F.lit(1.5).alias("h")))
    rows = dets.where(F.col("bottom") - F.col("top") > min_height).withColumn("s", size)
    rows = rows.withColumn("zw", F.col("s.w") * fx / (F.col("right") - F.col("left"))).withColumn(
        "zh", F.col("s.h") * fy / (F.col("bottom") - F.col("top")))
    rows = rows.withColumn("ratio", F.col("zh") / F.col("zw"))
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).join(
        lower_medians(rows, ["cls"], ["zw", "zh", "ratio"]), "cls", "left").select("cls", "n", "zw", "zh", "ratio")
