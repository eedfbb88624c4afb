"""Medians of regions: columns travel with a region, pixels may be listed twice or be missing, wireframes equal the column form."""
import random

import pytest
from pyspark.sql import functions as F

from framelens.functions.geometry import Box
from framelens.operators import depth as P


@pytest.mark.parametrize("cell", [8, 32])
def test_columns_travel_with_regions(spark, cell):
    r = random.Random(4)
    # a third of the pixels is missing, some are listed twice or three times
    px = [(f, x, y, r.randrange(256)) for f in (1, 2) for x in range(40) for y in range(24) for _ in range(r.choice([0, 1, 1, 1, 2, 3]) if f == 2 else r.choice([0, 1, 1]))]
    boxes = [(f, i, f"n{i}", (r.randrange(40), r.randrange(24), r.randrange(1, 25), r.randrange(1, 12))) for f in (1, 2, 3) for i in range(30)]
    # a region left of the raster begins below 0
    boxes.append((1, 30, None, (-5, -3, 9, 9)))
    regions = spark.createDataFrame(boxes, "frame int, det_idx int, name string, rect struct<x: int, y: int, w: int, h: int>")
    got = {(g["frame"], g["det_idx"]): (g["name"], g["median"]) for g in P.region_medians(
        regions, spark.createDataFrame(px, "frame int, px int, py int, v int"), cell).collect()}
    want = {}
    for f, i, name, (x, y, w, h) in boxes:
        values = sorted(v for a, b, c, v in px if a == f and x <= b < x + w and y <= c < y + h)
        if values:
            want[f, i] = name, values[len(values) // 2]
    assert got == want and len(got) > 50


def test_wireframes_equal_columns(spark):
    p2 = [500.0, 0.0, 100.0, 3.0, 0.0, 480.0, 40.0, -2.0, 0.001, 0.0, 1.0, -9.0]
    r = random.Random(7)
    rows = [(1, i, left, top, left + r.randrange(-1, 60), top + r.randrange(-1, 60), r.choice([None, 0.0, 4.5, r.random() * 30]))
            for i, (left, top) in enumerate((r.randrange(200), r.randrange(150)) for _ in range(400))]
    df = spark.createDataFrame(rows, "frame int, det_idx int, left int, top int, right int, bottom int, meters double")
    got = {x["det_idx"]: x["corners"] for x in P.wireframes(df, p2, 4.0).collect()}
    want = {x["det_idx"]: x["p"] for x in df.where("meters >= 4").select("det_idx", P.project_corners(
        P.box_3d(Box.of(), F.col("meters"), p2), p2).alias("p")).where("p is not null").collect()}
    assert got == want and 50 < len(got) < 350
    with pytest.raises(ValueError, match="focal"):
        P.wireframes(df, [0.0, *p2[1:]])
