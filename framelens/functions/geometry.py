"""Geometry as Column builders: boxes, polygons, lines, letterbox and crop mappings."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four edge columns of an axis-aligned box."""
    left: Column
    top: Column
    right: Column
    bottom: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*[F.col(f"{prefix}{s}") for s in ("left", "top", "right", "bottom")])

    @classmethod
    def field(cls, row: Column) -> Box:
        return cls(row["left"], row["top"], row["right"], row["bottom"])

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0)) * F.greatest(self.height, F.lit(0))

    @property
    def cx(self) -> Column:
        return (self.left + self.right) / 2

    @property
    def cy(self) -> Column:
        return (self.top + self.bottom) / 2


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.right, b.right) - F.greatest(a.left, b.left)
    h = F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box, floor: float = 1e-6) -> Column:
    """Intersection over union; 0 when the union is not above ``floor`` (0 for the NMS form)."""
    inter = intersection(a, b)
    union = a.area + b.area - inter
    if floor == 0:
        # one division, no branch: this runs inside per-frame folds
        return F.coalesce(F.try_divide(inter.cast("double"), union), F.lit(0.0))
    return F.when(union > floor, inter / union).otherwise(F.lit(0.0))


def parse_points(text: str | None, strict: bool = False) -> list[tuple[int, int]]:
    """Points of an ``x1,y1,x2,y2`` string.

    Separators are comma and semicolon; other characters are dropped. An odd tail is dropped,
    or makes the whole list empty when ``strict`` (the region-of-interest form).
    """
    fields = [("".join(c for c in part if c.isdigit() or c == "-"))
              for part in (text or "").replace(";", ",").split(",")]
    values = [int(v) for v in fields if v.lstrip("-").isdigit()]
    if len(values) % 2:
        if strict:
            return []
        values = values[:-1]
    return list(zip(values[::2], values[1::2]))


def side_of_line(a: tuple[float, float], b: tuple[float, float], x: Column, y: Column) -> Column:
    """Cross product of the directed line a->b with the point; its sign is the side."""
    return F.lit(b[0] - a[0]) * (y - a[1]) - F.lit(b[1] - a[1]) * (x - a[0])


def cross_of(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(p0, p1, q0, q1) -> Column:
    """Whether two segments properly cross. Points are (x, y) pairs of columns or numbers."""
    p0, p1, q0, q1 = [tuple(F.lit(v) if isinstance(v, (int, float)) else v for v in p)
                      for p in (p0, p1, q0, q1)]
    d1, d2 = cross_of(*q0, *q1, *p0), cross_of(*q0, *q1, *p1)
    d3, d4 = cross_of(*p0, *p1, *q0), cross_of(*p0, *p1, *q1)
    return ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0))


def point_in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Inside or on the boundary of a literal polygon, as one boolean expression."""
    on_edge, odd = F.lit(False), F.lit(False)
    edges = list(zip(polygon, [*polygon[1:], polygon[0]]))
    for (ax, ay), (bx, by) in edges:
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        on_edge = on_edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx))
                             & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            hit = ((y >= min(ay, by)) & (y < max(ay, by))
                   & ((cross < 0) if by > ay else (cross > 0)))
            odd = odd != hit
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    # cheap bounding-box test first
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (on_edge | odd)


# polygons as array<struct<x, y>> -------------------------------------------------------

def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def oriented_polygon(x: Column, y: Column, w: Column, h: Column, angle: Column) -> Column:
    """Corners of a box rotated by ``angle`` (radians) about its centre; x, y is its corner."""
    # written out per corner, the terms make generated code too long to be compiled
    terms = F.struct((x + w / 2).alias("cx"), (y + h / 2).alias("cy"), (w / 2).alias("w"), (h / 2).alias("h"),
                     F.cos(angle).alias("c"), F.sin(angle).alias("s"))

    def corners(t: Column) -> Column:
        sides = [(-t["w"], -t["h"]), (t["w"], -t["h"]), (t["w"], t["h"]), (-t["w"], t["h"])]
        return F.array(*[point(t["cx"] + dx * t["c"] - dy * t["s"], t["cy"] + dx * t["s"] + dy * t["c"]) for dx, dy in sides])
    return bind(terms, corners)


def box_polygon(b: Box) -> Column:
    return F.array(point(b.left, b.top), point(b.right, b.top),
                   point(b.right, b.bottom), point(b.left, b.bottom))


def flat_polygon(values: Column) -> Column:
    """``[x1, y1, x2, y2, ...]`` to points; an odd tail is dropped."""
    n = F.floor(F.size(values) / 2).cast("int")
    return F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: point(F.get(values, i * 2), F.get(values, i * 2 + 1)))).otherwise(
        F.array().cast("array<struct<x: double, y: double>>"))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (expressions inside lambdas are not shared)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _turned(items: Column) -> Column:
    """The array moved on by one, so position i meets its successor."""
    return F.concat(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.slice(items, 1, 1))


def signed_area(poly: Column) -> Column:
    return bind(poly, lambda points: F.aggregate(F.zip_with(
        points, _turned(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda acc, v: acc + v)) / 2


def polygon_area(poly: Column) -> Column:
    """Shoelace area."""
    return F.abs(signed_area(poly))


_POINTS = "array<struct<x: double, y: double>>"


def clip_convex(subject: Column, clip: Column) -> Column:
    """Intersection polygon of ``subject`` with a convex ``clip`` polygon.

    A fold over the clip edges: each edge keeps the points on its inner side and adds the
    cut points. The clip polygon may wind either way.
    """
    def cut(poly: Column, e: Column) -> Column:
        marked = F.transform(poly, lambda p: F.struct(
            p["x"].alias("x"), p["y"].alias("y"),
            (e["nx"] * (p["x"] - e["x"]) + e["ny"] * (p["y"] - e["y"])).alias("d")))

        def step(p: Column, q: Column) -> Column:
            here = F.struct(p["x"], p["y"])
            t = p["d"] / (p["d"] - q["d"])
            meet = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
            stays, leaves = p["d"] >= 0, (p["d"] >= 0) != (q["d"] >= 0)
            return (F.when(~leaves, F.when(stays, F.array(here)).otherwise(F.array().cast(_POINTS)))
                    .when(stays, F.array(here, meet)).otherwise(F.array(meet)))

        return bind(marked, lambda m: F.flatten(F.zip_with(m, _turned(m), step)))

    def edges(shape: Column) -> Column:
        # inner normal of every edge; the winding sign is computed once
        return bind(F.signum(signed_area(shape)), lambda s: F.zip_with(
            shape, _turned(shape), lambda a, b: F.struct(
                a["x"].alias("x"), a["y"].alias("y"), (s * (a["y"] - b["y"])).alias("nx"),
                (s * (b["x"] - a["x"])).alias("ny"))))

    return F.aggregate(bind(clip, edges), subject, cut)


def polygon_iou(a: Column, b: Column) -> Column:
    """Overlap of two convex polygons; 0 when they do not meet or have no area."""
    def ratio(inter: Column) -> Column:
        return bind(polygon_area(a) + polygon_area(b) - inter, lambda union: F.when(
            (inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0)))
    return bind(bind(clip_convex(a, b), polygon_area), ratio)


def oriented_bounds(x: Column, y: Column, w: Column, h: Column, angle: Column) -> Box:
    """Axis-aligned bounds of an oriented box, rounded to whole pixels."""
    dx = F.abs(w / 2 * F.cos(angle)) + F.abs(h / 2 * F.sin(angle))
    dy = F.abs(w / 2 * F.sin(angle)) + F.abs(h / 2 * F.cos(angle))
    cx, cy = x + w / 2, y + h / 2
    return Box(*[F.round(v).cast("int") for v in (cx - dx, cy - dy, cx + dx, cy + dy)])


# tracker geometry ----------------------------------------------------------------------

def centre_distance(a: Box, b: Box) -> Column:
    return F.sqrt(F.pow(a.cx - b.cx, 2) + F.pow(a.cy - b.cy, 2))


def max_centre_distance(b: Box, scale: float) -> Column:
    w, h = F.greatest(b.width, F.lit(1)), F.greatest(b.height, F.lit(1))
    return F.greatest(F.lit(10.0), F.sqrt((w * w + h * h).cast("double")) * scale)


def size_ratio(a: Box, b: Box) -> Column:
    def sized(v: Box) -> Column:
        return F.greatest(v.width, F.lit(1)) * F.greatest(v.height, F.lit(1))
    return F.least(sized(a), sized(b)) / F.greatest(sized(a), sized(b))


def smoothing_alpha(prev: Box, new: Box, base: float) -> Column:
    """Weight of the old box; grows when the box hardly moves, bounded to [0.30, 0.78]."""
    moved = F.least(F.lit(1.0), centre_distance(prev, new) / max_centre_distance(prev, 0.5))
    return F.least(F.lit(0.78), F.greatest(F.lit(0.30), F.lit(base) + (1 - moved) * 0.10))


def blend(prev: Box, new: Box, alpha: Column) -> Box:
    return Box(*[F.round(alpha * p + (1 - alpha) * n).cast("int") for p, n in
                 zip((prev.left, prev.top, prev.right, prev.bottom),
                     (new.left, new.top, new.right, new.bottom))])


# letterbox and crop --------------------------------------------------------------------

def _clamp(v: Column, lo, hi) -> Column:
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.least(hi, F.greatest(lo, v))


def letterbox_box(b: Box, pad: tuple, scale, model: tuple, crop: tuple) -> Box:
    """Model-space box to frame pixels. ``crop`` is (x, y, w, h); division truncates to int."""
    def back(v, p, size, origin, extent):
        raw = (_clamp(v - p, 0, size) / scale).cast("int") + origin
        return _clamp(raw, F.lit(origin), F.lit(origin) + F.greatest(F.lit(1), F.lit(extent)))
    return Box(back(b.left, pad[0], model[0], crop[0], crop[2]),
               back(b.top, pad[1], model[1], crop[1], crop[3]),
               back(b.right, pad[0], model[0], crop[0], crop[2]),
               back(b.bottom, pad[1], model[1], crop[1], crop[3]))


def letterbox_point(x: Column, y: Column, pad: tuple, scale: float, model: tuple,
                    crop: tuple, content: bool) -> tuple[Column, Column]:
    """Model-space point to frame pixels, clamped to the content area or to the canvas."""
    def back(v, p, size, origin):
        limit = (size - 2.0 * p if content else size) / scale
        return _clamp((v - p) / scale, 0.0, float(limit)) + origin
    return back(x, pad[0], model[0], crop[0]), back(y, pad[1], model[1], crop[1])


def crop_affine(b: Box, model_w: int, model_h: int, pad: float = 1.0) -> Column:
    """Struct (sx, tx, sy, ty) and inverse (ix, itx, iy, ity) of the crop around a box."""
    aspect = model_w / model_h
    w0, h0 = b.width * F.lit(float(pad)), b.height * F.lit(float(pad))
    wide = w0 > h0 * aspect
    w = F.greatest(F.when(wide, w0).otherwise(h0 * aspect), F.lit(1.0))
    h = F.greatest(F.when(wide, w0 / aspect).otherwise(h0), F.lit(1.0))
    sx, sy = F.lit(float(model_w)) / w, F.lit(float(model_h)) / h
    return F.struct(
        sx.alias("sx"), (F.lit(model_w / 2) - sx * b.cx).alias("tx"),
        sy.alias("sy"), (F.lit(model_h / 2) - sy * b.cy).alias("ty"),
        (1 / sx).alias("ix"), (b.cx - F.lit(model_w / 2) / sx).alias("itx"),
        (1 / sy).alias("iy"), (b.cy - F.lit(model_h / 2) / sy).alias("ity"))


# keypoints -----------------------------------------------------------------------------

def normalise_keypoint(x: Column, y: Column, box: Box | None = None,
                       width: Column | None = None, height: Column | None = None):
    """Keypoint relative to its box (centre, longer side) or to the image half size."""
    if box is not None:
        scale = F.greatest(box.width, box.height, F.lit(1)).cast("double")
        return (x - box.cx) / scale, (y - box.cy) / scale
    return (x - width / 2) / (width / 2), (y - height / 2) / (height / 2)
