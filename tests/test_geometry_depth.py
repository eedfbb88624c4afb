"""Hand-computed numbers for geometry, depth, decode and masks."""
import math

import pytest
from pyspark.sql import functions as F

from framelens.functions import decode as D
from framelens.functions import geometry as G
from framelens.operators import depth as P
from framelens.operators import evaluation as V


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_depth_pixel(spark):
    assert one(spark, P.pixel_meters(F.lit(128), F.lit(0.0), F.lit(10.0))) == pytest.approx(4.98, abs=.01)


def test_corner_projection(spark):
    p2 = [100.0, 0, 50.0, 0, 0, 100.0, 50.0, 0, 0, 0, 1, 0]
    item = F.struct(F.lit(10.0).alias("z"), F.lit(50.0).alias("u"), F.lit(50.0).alias("v"), F.lit(1.5).alias("h3"),
                    F.lit(4.0).alias("l3"), F.lit(2.0).alias("w3"), F.lit(0.0).alias("sin_a"), F.lit(1.0).alias("cos_a"))
    first = one(spark, P.project_corners(item, p2))[0]
    assert (first.x, first.y) == (pytest.approx(68.1818, abs=1e-3), pytest.approx(56.8182, abs=1e-3))


def test_rotated_overlap(spark):
    def box(x, y, w, h, a):
        return G.oriented_polygon(*[F.lit(float(v)) for v in (x, y, w, h, a)])
    assert one(spark, G.polygon_iou(box(0, 0, 10, 10, 0), box(0, 0, 10, 10, math.pi / 2))) == pytest.approx(1.0)
    octagon = 100 * 2 * (math.sqrt(2) - 1)
    assert one(spark, G.polygon_iou(box(0, 0, 10, 10, 0), box(0, 0, 10, 10, math.pi / 4))) == pytest.approx(octagon / (200 - octagon))
    assert one(spark, G.polygon_iou(box(0, 0, 4, 4, .3), box(20, 0, 4, 4, .3))) == 0.0


def test_point_strings():
    assert G.parse_points("1,2;3,x4,5") == [(1, 2), (3, 4)]
    assert G.parse_points("1,2,3", strict=True) == []


def test_ctc_text(spark):
    steps = F.array(*[F.array(*[F.lit(5.0 if i == c else 0.0) for i in range(3)]) for c in (1, 1, 0, 1, 2)])
    assert one(spark, D.ctc_decode(steps, "ab")).text == "aab"


def test_keypoint_in_box(spark):
    b = G.Box(*[F.lit(v) for v in (0, 0, 100, 100)])
    x, y = G.normalise_keypoint(F.lit(30), F.lit(70), b)
    assert (one(spark, x), one(spark, y)) == (-0.2, 0.2)


def test_rle_round_trip(spark):
    mask = [1, 1, 0, 0, 1, 0, 0, 1, 1]
    counts = one(spark, D.rle_encode(F.array(*[F.lit(v) for v in mask])))
    assert counts == [0, 2, 2, 1, 2, 2]
    spans = one(spark, V.rle_spans(F.array(*[F.lit(v) for v in counts]), *[F.lit(v) for v in (0, 0, 3, 3, 10, 10)]))
    back = [0] * 9
    for s in spans:
        for i in range(s.a, s.b):
            back[s.row * 3 + i] = 1
    assert back == mask


def test_oriented_ap_claims(spark):
    # the better detection claims the truth, the second on the same truth is a miss
    def poly(x):
        return [(x, 0.0), (x + 10.0, 0.0), (x + 10.0, 10.0), (x, 10.0)]
    kind = "array<struct<x: double, y: double>>"
    dets = spark.createDataFrame([("i", 0, .9, 1, poly(0.0)), ("i", 0, .8, 2, poly(1.0)), ("i", 0, .7, 3, poly(50.0))],
                                 f"image string, cls int, score double, det_order long, poly {kind}")
    gts = spark.createDataFrame([("i", 0, 0, 0, poly(0.0)), ("i", 0, 1, 0, poly(50.0))], f"image string, cls int, gt_idx int, difficult int, poly {kind}")
    ap = {r.thr_no: r.ap for r in V.oriented_ap(dets, gts).collect()}
    assert ap[0] == pytest.approx((51 + 50 * 2 / 3) / 101)


def test_region_medians_are_exact(spark):
    # boxes above 4096 pixels, with image cells inside and on the border, and one inside a single cell
    px = spark.range(256 * 192).select(F.lit(1).alias("frame"), (F.col("id") % 256).cast("int").alias("px"), F.floor(F.col("id") / 256).cast("int").alias("py"))
    px = px.withColumn("v", (F.col("px") * 17 + F.col("py") * 7 + F.col("px") * F.col("py")) % 256)
    boxes = [(3, 5, 200, 150), (32, 32, 64, 64), (0, 0, 256, 192), (40, 41, 7, 9)]
    regions = spark.createDataFrame([(1, i, b) for i, b in enumerate(boxes)],
                                    "frame int, det_idx int, rect struct<x: int, y: int, w: int, h: int>")
    got = {r.det_idx: r.median for r in P.region_medians(regions, px).collect()}
    for i, (x, y, w, h) in enumerate(boxes):
        values = sorted((a * 17 + b * 7 + a * b) % 256 for a in range(x, x + w) for b in range(y, y + h))
        assert got[i] == values[len(values) // 2]


def test_regions_meet_pixels_as_arrays(spark):
    """Three frames, some regions without pixels, few pairs at a time: medians by cell equal sorted values."""
    px = spark.createDataFrame([(f, x, y, (x * y + f) % 256) for f in (1, 2) for x in range(70) for y in range(20)],
                               "frame int, px int, py int, v int")
    boxes = [(f, i, (x, y, 1 + i % 5, 1 + i % 3)) for f in (1, 2, 3) for i, (x, y) in enumerate((a * 7, b * 6) for a in range(11) for b in range(4))]
    regions = spark.createDataFrame(boxes, "frame int, det_idx int, rect struct<x: int, y: int, w: int, h: int>")
    want = {}
    for f, i, (x, y, w, h) in boxes:
        values = sorted((a * b + f) % 256 for a in range(x, min(x + w, 70)) for b in range(y, min(y + h, 20)))
        if f < 3 and values:
            want[f, i] = values[len(values) // 2]
    assert {(r.frame, r.det_idx): r.median for r in P.region_medians(regions, px).collect()} == want
    item = {"det_idx": 4, "x": 1, "y": 0, "x2": 2, "y2": 0}
    codes = sorted((v << 20) | p for p, v in enumerate([9, 3, 8, 200]))
    row = {"frame": 1, "regions": [item, {**item, "det_idx": 5, "x2": 0}, {**item, "det_idx": 6, "x2": 3}], "pixels": codes}
    kind = "frame int, regions array<struct<det_idx: int, x: int, y: int, x2: int, y2: int>>, pixels array<int>"
    rows = spark.createDataFrame([row, {**row, "frame": 2}], kind).toArrow().combine_chunks().to_batches()
    got = [r for b in P._cell_medians(rows, 1) for r in b.to_pylist()]
    assert [(r["frame"], r["det_idx"], r["median"]) for r in got] == [(f, d, m) for f in (1, 2) for d, m in ((4, 8), (6, 8))]


def test_official_categories(spark):
    ids = [i for i in V.OFFICIAL_IDS]
    got = {r.cls: r.category for r in V.category_mapping(spark.createDataFrame([(i,) for i in ids], "id int")).collect()}
    assert got == dict(enumerate(ids)) and len(got) == 80
    with pytest.raises(Exception, match="neither"):
        V.category_mapping(spark.createDataFrame([(2,), (5,)], "id int")).collect()


def test_mask_overlap_of_many_rows(spark):
    """Masks of 500 rows with several spans each, touching spans among them, against pixel sets."""
    import random

    import pytest

    from framelens.operators import evaluation as V
    r = random.Random(3)

    def mask(shift):
        spans = []
        for row in range(500):
            cuts = sorted(r.sample(range(60), 6))
            spans += [(row + shift, a, b) for a, b in ((cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[3], cuts[5]))]
        return spans
    rows, want = [], []
    for k in range(4):
        d, g = mask(k), mask(0)
        pixels = [{(y, x) for y, a, b in m for x in range(a, b)} for m in (d, g)]
        both = len(pixels[0] & pixels[1])
        crowd = k % 2
        want.append(both / len(pixels[0]) if crowd else both / len(pixels[0] | pixels[1]))
        rows.append((k, (d, float(len(pixels[0])), 0, 0, 60, 510), (g, float(len(pixels[1])), 0, 0, 60, 510, crowd)))
    box = "spans: array<struct<row: int, a: int, b: int>>, area: double, left: int, top: int, right: int, bottom: int"
    df = spark.createDataFrame(rows, f"k int, d struct<{box}>, g struct<{box}, crowd: int>")
    got = [x["v"] for x in df.select("k", V.spans_overlap(F.col("d"), F.col("g")).alias("v")).orderBy("k").collect()]
    assert got == pytest.approx(want)


def test_overlaps_by_pairs_equal_columns(spark):
    """Boxes and masks, crowd truth, boxes apart and a group without truth: arrays of pairs give what columns give."""
    rows = [(f, i, ((i * 37 + f) % 10) / 10, i % 3, 5 * (i % 4) + f, 4 * (i % 5), 20 + i, 12 + i % 7) for f in (1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(rows, "image int, i int, score double, cat int, left int, top int, w int, h int")
    span = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.struct(
        (F.col("top") + k).alias("row"), (F.col("left") + k % 3).alias("a"), (F.col("left") + F.col("w")).alias("b")))
    df = df.withColumn("right", F.col("left") + F.col("w")).withColumn("bottom", F.col("top") + F.col("h")).withColumn("spans", span)
    df = df.withColumn("area", V.spans_area(F.col("spans")).cast("double"))
    edges = ["left", "top", "right", "bottom", "spans"]
    dets = df.select("image", "cat", "score", F.col("i").alias("det_order"), "area", *[
        (F.col(c) + 3).alias(c) if c in ("left", "right") else F.col(c) for c in edges])
    crowd = (F.col("i") % 5 == 0).cast("int")
    gts = df.where("image < 3").select("image", "cat", F.col("i").alias("gt_idx"), "area", crowd.alias("crowd"), crowd.alias("ignore"), *edges)
    for overlap in (V.box_overlap, V.spans_overlap):
        assert overlap in V.PAIR_OVERLAPS
        got, want = [sorted(map(tuple, V.match_frames(dets, gts, o, V.THRESHOLDS, {"all": (0.0, 1e10), "small": (0.0, 300.0)}).collect()))
                     for o in (overlap, lambda a, b: overlap(a, b))]
        assert got == want and len(got) == 36 and {c for r in got for c in r[5]} == {-1, 0, 1}
