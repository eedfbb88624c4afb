"""Filters, suppression, reports and frame lines over the boxes view."""
from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import geometry as G
from framelens.functions import polygons as PG
from framelens.operators import filters as FL
from framelens.operators import reports as RP
from framelens.operators import suppression as S
from framelens.session import scratch_path
from framelens.sources import frames as SF
from framelens.workload.registry import query
from framelens.workload.views import BOXES, TRACKED, Tables, big, fixed

NAMES = ["person", "car"]  # class 2 has no name on purpose
KEEP = ["frame", "det_idx"]
LABEL_SQL = "CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'null' END"


def iou_sql(a: str, b: str) -> str:
    """Overlap of two struct-like aliases with left/top/right/bottom."""
    w = f'greatest(least({a}."right", {b}."right") - greatest({a}."left", {b}."left"), 0)'
    h = f'greatest(least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top), 0)'
    area = "({0}.\"right\" - {0}.\"left\") * ({0}.bottom - {0}.top)"
    inter = f"({w} * {h})"
    return f"({inter}::DOUBLE / ({area.format(a)} + {area.format(b)} - {inter}))"


# a box falls when a kept better box lists it among the boxes it suppresses
def greedy_sql(kills: str, partition: str, source: str = "boxes") -> str:
    return f"""
kills AS ({kills}),
ranked AS (SELECT {partition}, list({{'i': b.det_idx, 'k': coalesce(k.ids, [])}} ORDER BY b.score DESC, b.det_idx) AS items
  FROM {source} b LEFT JOIN kills k ON k.frame = b.frame AND k.det_idx = b.det_idx GROUP BY {partition}),
kept AS (SELECT {partition}, unnest(list_reduce(list_transform(items, lambda x: [x]), lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda m: list_contains(m.k, x[1].i))) > 0 THEN acc ELSE list_concat(acc, x) END)).i AS det_idx
  FROM ranked)"""


def pairs_sql(condition: str, same: str, source: str = "boxes") -> str:
    return f"""SELECT a.frame, a.det_idx, list(b.det_idx) AS ids FROM {source} a JOIN {source} b
  ON a.frame = b.frame {same} AND (b.score < a.score OR (b.score = a.score AND b.det_idx > a.det_idx))
  WHERE {condition} GROUP BY a.frame, a.det_idx"""


def nested(t: Tables, boxes=None):
    """Frames with their detections as an array, ordered by index."""
    item = F.struct("det_idx", "left", "top", "right", "bottom", "score", "cls")
    return (t.boxes if boxes is None else boxes).groupBy("frame", F.concat(
        F.lit("cam"), F.col("source")).alias("source")).agg(F.array_sort(F.collect_list(item)).alias("dets"))


# filters -------------------------------------------------------------------------------

@query("flt1_roi_filter", BOXES + """
SELECT frame, det_idx FROM (SELECT *, "left" + "right" AS x, top + bottom AS y FROM boxes)
WHERE y >= 80 AND 5 * x + 2 * y <= 2560 AND 5 * x - 2 * y >= -160""")
def flt1(t: Tables):
    # the triangle's edges in doubled coordinates are the linear forms above
    return FL.roi_filter(t.boxes, "0,40;240,40;120,340").select(*KEEP)


@query("flt2_privacy_masks", BOXES + """
SELECT frame, det_idx, x1 AS mask_x, y1 AS mask_y, x2 - x1 AS mask_w, y2 - y1 AS mask_h FROM (
  SELECT frame, det_idx, greatest("left" + 2, 0) AS x1, greatest(top + 2, 0) AS y1,
    least("right" - 2, 150) AS x2, least(bottom - 2, 130) AS y2 FROM boxes WHERE cls IN (0, 2))
WHERE x2 > x1 AND y2 > y1""")
def flt2(t: Tables):
    return FL.privacy_masks(t.boxes, [0, 2], 150, 130).select(*KEEP, "mask_x", "mask_y", "mask_w", "mask_h")


@query("flt3_score_threshold", BOXES + " SELECT frame, det_idx, score FROM boxes WHERE score >= 0.6")
def flt3(t: Tables):
    return FL.score_filter(t.boxes, 0.6).select(*KEEP, "score")


@query("flt4_valid_boxes", BOXES + " SELECT frame, det_idx FROM boxes WHERE w - 60 > 0 AND h - 50 > 0 AND cls < 2")
def flt4(t: Tables):
    shrunk = t.boxes.withColumn("w", F.col("w") - 60).withColumn("h", F.col("h") - 50)
    return FL.valid_boxes(shrunk, 2).select(*KEEP)


@query("flt5_class_whitelist", BOXES + " SELECT frame, det_idx, cls FROM boxes WHERE cls IN (1)")
def flt5(t: Tables):
    return FL.class_whitelist(FL.class_whitelist(t.boxes, []), [1]).select(*KEEP, "cls")


@query("flt6_label_lookup", BOXES + f"""
SELECT frame, det_idx, {LABEL_SQL} AS label,
  CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'class_' || cls END AS review_name FROM boxes""")
def flt6(t: Tables):
    labels = t.spark.createDataFrame(list(enumerate(NAMES)), "cls long, label string")
    return FL.label_lookup(t.boxes, labels).select(
        *KEEP, "label", FL.label_of(F.col("cls"), NAMES, "class").alias("review_name"))


@query("flt7_display_filter", BOXES + """
SELECT frame, det_idx FROM boxes WHERE score >= 0.3""")
def flt7(t: Tables):
    return FL.display_filter(t.boxes, 0.3).select(*KEEP)


@query("flt8_borderline_gate", BOXES + " SELECT frame FROM boxes GROUP BY frame HAVING min(score) < 0.02")
def flt8(t: Tables):
    return FL.borderline_gate(nested(t), 0.02).select("frame")


def poses(t: Tables):
    """A pose per box: six keypoints whose scores come from the box."""
    k = [F.array(F.col("left").cast("double"), F.col("top").cast("double"),
                 ((F.col("qty") * (i + 3) + F.col("line") * 7) % 100) / 100.0) for i in range(6)]
    return t.boxes.withColumn("kpts", F.array(*k))


GOOD_KPTS = " + ".join(f"CAST((qty * {i + 3} + line * 7) % 100 >= 50 AS INT)" for i in range(6))


@query("flt9_person_present", BOXES + f"""
SELECT frame, coalesce(bool_or({GOOD_KPTS} >= 3), false) AS present FROM boxes GROUP BY frame""")
def flt9(t: Tables):
    frames = poses(t).groupBy("frame").agg(F.collect_list(F.struct("kpts")).alias("poses"))
    return frames.select("frame", FL.has_person(F.col("poses")).alias("present"))


# projections ---------------------------------------------------------------------------

@query("prj1_box_forms", BOXES + """
SELECT frame, det_idx, "left" + w AS "right", top + h AS bottom, ("left" + "right") / 2 AS cx,
  (top + bottom) / 2 AS cy, w * h AS area, bottom AS foot_y FROM boxes""")
def prj1(t: Tables):
    b = G.Box(F.col("left"), F.col("top"), F.col("left") + F.col("w"), F.col("top") + F.col("h"))
    return t.boxes.select(*KEEP, b.right.alias("right"), b.bottom.alias("bottom"), b.cx.alias("cx"),
                          b.cy.alias("cy"), b.area.alias("area"), b.bottom.alias("foot_y"))


def _back(edge: str, pad: int, crop: int, extent: int) -> str:
    return f"greatest({crop}, least({crop + extent}, CAST(trunc(least(120, greatest(0, {edge} - {pad})) / 0.4) AS INT) + {crop}))"


@query("prj2_letterbox_box", BOXES + f"""
SELECT frame, det_idx, {_back('"left"', 8, 30, 280)} AS x1, {_back('top', 15, 20, 200)} AS y1,
  {_back('"right"', 8, 30, 280)} AS x2, {_back('bottom', 15, 20, 200)} AS y2 FROM boxes""")
def prj2(t: Tables):
    b = G.letterbox_box(G.Box.of(), (8, 15), 0.4, (120, 120), (30, 20, 280, 200))
    return t.boxes.select(*KEEP, b.left.alias("x1"), b.top.alias("y1"), b.right.alias("x2"), b.bottom.alias("y2"))


@query("prj3_letterbox_point", BOXES + """
SELECT frame, det_idx, round(greatest(0, least(("left" - 8) / 0.4, (120 - 16.0) / 0.4)) * 10000 + 300000) / 10000 AS content_x,
  round(greatest(0, least((top - 15) / 0.4, 120 / 0.4)) * 10000 + 200000) / 10000 AS canvas_y FROM boxes""")
def prj3(t: Tables):
    args = (F.col("left"), F.col("top"), (8, 15), 0.4, (120, 120), (30, 20, 280, 200))
    return t.boxes.select(*KEEP, fixed(G.letterbox_point(*args, True)[0]).alias("content_x"),
                          fixed(G.letterbox_point(*args, False)[1]).alias("canvas_y"))


@query("prj4_crop_affine", BOXES + """
SELECT frame, det_idx, round(192 / cw * 10000) / 10000 AS sx, round((96 - 192 / cw * cx) * 10000) / 10000 AS tx,
  round(ch / 256 * 10000) / 10000 AS iy, round((cy - ch / 2) * 10000) / 10000 AS ity
FROM (SELECT *, greatest(CASE WHEN pw > ph * 0.75 THEN pw ELSE ph * 0.75 END, 1) AS cw,
    greatest(CASE WHEN pw > ph * 0.75 THEN pw / 0.75 ELSE ph END, 1) AS ch FROM (
  SELECT *, w * 1.25::DOUBLE AS pw, h * 1.25::DOUBLE AS ph, ("left" + "right") / 2 AS cx, (top + bottom) / 2 AS cy FROM boxes))""")
def prj4(t: Tables):
    a = G.crop_affine(G.Box.of(), 192, 256, 1.25)
    return t.boxes.withColumn("a", a).select(
        *KEEP, *[fixed(F.col(f"a.{c}")).alias(c) for c in ("sx", "tx", "iy", "ity")])


ANGLE_SQL = "(qty * 7 % 31) / 10.0::DOUBLE"


def oriented(t: Tables):
    """Boxes turned by an angle, with polygon and whole-pixel bounds."""
    b = t.boxes.withColumn("angle", (F.col("qty") * 7 % 31) / 10.0)
    args = (F.col("left"), F.col("top"), F.col("w"), F.col("h"), F.col("angle"))
    o = G.oriented_bounds(*args)
    return (b.withColumn("poly", G.oriented_polygon(*args)).withColumn("o_left", o.left)
            .withColumn("o_top", o.top).withColumn("o_right", o.right).withColumn("o_bottom", o.bottom))


@query("prj5_oriented_bounds", BOXES + f"""
SELECT frame, det_idx, CAST(round(cx - dx) AS INT) AS o_left, CAST(round(cy - dy) AS INT) AS o_top,
  CAST(round(cx + dx) AS INT) AS o_right, CAST(round(cy + dy) AS INT) AS o_bottom
FROM (SELECT *, "left" + w / 2 AS cx, top + h / 2 AS cy,
  abs(w / 2 * cos(a)) + abs(h / 2 * sin(a)) AS dx, abs(w / 2 * sin(a)) + abs(h / 2 * cos(a)) AS dy
  FROM (SELECT *, {ANGLE_SQL} AS a FROM boxes))""")
def prj5(t: Tables):
    return oriented(t).select(*KEEP, "o_left", "o_top", "o_right", "o_bottom")


CORNERS = f"""turned AS (SELECT *, "left" + w / 2 AS cx, top + h / 2 AS cy, {ANGLE_SQL} AS a FROM boxes),
corners AS (SELECT frame, det_idx, cls, score, n,
    cx + dx * cos(a) - dy * sin(a) AS x, cy + dx * sin(a) + dy * cos(a) AS y
  FROM (SELECT *, CASE WHEN n IN (1, 4) THEN -w / 2 ELSE w / 2 END AS dx,
    CASE WHEN n <= 2 THEN -h / 2 ELSE h / 2 END AS dy FROM turned, range(1, 5) r(n)))"""


@query("prj6_oriented_polygon", BOXES + "," + CORNERS + """
SELECT frame, det_idx, n, round(x * 1000) / 1000 AS x, round(y * 1000) / 1000 AS y FROM corners""")
def prj6(t: Tables):
    return oriented(t).select(*KEEP, F.posexplode("poly").alias("p", "c")).select(
        *KEEP, big(F.col("p") + 1).alias("n"), fixed(F.col("c.x"), 3).alias("x"), fixed(F.col("c.y"), 3).alias("y"))


# pair geometry -------------------------------------------------------------------------

NEXT = """nexts AS (SELECT *, lead("left") OVER f AS l2, lead(top) OVER f AS t2, lead("right") OVER f AS r2,
  lead(bottom) OVER f AS b2 FROM boxes WINDOW f AS (PARTITION BY frame ORDER BY det_idx))"""


def neighbours(t: Tables):
    """Each box with the next one of its frame."""
    from pyspark.sql import Window as W
    w = W.partitionBy("frame").orderBy("det_idx")
    df = t.boxes
    for c in ("left", "top", "right", "bottom"):
        df = df.withColumn(f"n_{c}", F.lead(c).over(w))
    return df.where("n_left is not null")


INTER = 'greatest(least("right", r2) - greatest("left", l2), 0) * greatest(least(bottom, b2) - greatest(top, t2), 0)'


@query("fn1_iou", BOXES + "," + NEXT + f"""
SELECT frame, det_idx, round(i / (w * h + (r2 - l2) * (b2 - t2) - i) * 1000000) / 1000000 AS iou
FROM (SELECT *, {INTER} AS i FROM nexts WHERE l2 IS NOT NULL)""")
def fn1(t: Tables):
    return neighbours(t).select(*KEEP, fixed(G.iou(G.Box.of(), G.Box.of("n_")), 6).alias("iou"))


@query("fn2_nms_iou", BOXES + "," + NEXT + f"""
SELECT frame, count(*) FILTER (i / (w * h + (r2 - l2) * (b2 - t2) - i) > 0.45) AS overlapping
FROM (SELECT *, {INTER} AS i FROM nexts WHERE l2 IS NOT NULL) GROUP BY frame""")
def fn2(t: Tables):
    return neighbours(t).groupBy("frame").agg(
        F.count_if(G.iou(G.Box.of(), G.Box.of("n_"), 0.0) > 0.45).alias("overlapping"))


POLY_PAIRS = """
inside AS (
  SELECT p.frame, p.ia, p.ib, c.x, c.y FROM pairs p JOIN corners c ON c.frame = p.frame AND c.det_idx = p.ia
  JOIN turned o ON o.frame = p.frame AND o.det_idx = p.ib
  WHERE abs((c.x - o.cx) * cos(o.a) + (c.y - o.cy) * sin(o.a)) <= o.w / 2 + 1e-9
    AND abs((c.y - o.cy) * cos(o.a) - (c.x - o.cx) * sin(o.a)) <= o.h / 2 + 1e-9
  UNION ALL
  SELECT p.frame, p.ia, p.ib, c.x, c.y FROM pairs p JOIN corners c ON c.frame = p.frame AND c.det_idx = p.ib
  JOIN turned o ON o.frame = p.frame AND o.det_idx = p.ia
  WHERE abs((c.x - o.cx) * cos(o.a) + (c.y - o.cy) * sin(o.a)) <= o.w / 2 + 1e-9
    AND abs((c.y - o.cy) * cos(o.a) - (c.x - o.cx) * sin(o.a)) <= o.h / 2 + 1e-9),
edges AS (SELECT a.frame, a.det_idx, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy FROM corners a JOIN corners b
  ON a.frame = b.frame AND a.det_idx = b.det_idx AND b.n = a.n % 4 + 1),
cuts AS (SELECT p.frame, p.ia, p.ib, e.x + s * e.dx AS x, e.y + s * e.dy AS y FROM (
    SELECT p.frame, p.ia, p.ib, e.x, e.y, e.dx, e.dy,
      ((f.x - e.x) * f.dy - (f.y - e.y) * f.dx) / nullif(e.dx * f.dy - e.dy * f.dx, 0) AS s,
      ((f.x - e.x) * e.dy - (f.y - e.y) * e.dx) / nullif(e.dx * f.dy - e.dy * f.dx, 0) AS u
    FROM pairs p JOIN edges e ON e.frame = p.frame AND e.det_idx = p.ia
    JOIN edges f ON f.frame = p.frame AND f.det_idx = p.ib) e JOIN (SELECT 1) ON s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1, 
  (SELECT NULL) p0(z) , LATERAL (SELECT e.frame, e.ia, e.ib) p),
pts AS (SELECT * FROM inside UNION ALL SELECT * FROM cuts),
fan AS (SELECT *, atan2(y - avg(y) OVER g, x - avg(x) OVER g) AS ang FROM pts WINDOW g AS (PARTITION BY frame, ia, ib)),
ring AS (SELECT *, coalesce(lead(x) OVER g, first_value(x) OVER g) AS nx, coalesce(lead(y) OVER g, first_value(y) OVER g) AS ny
  FROM fan WINDOW g AS (PARTITION BY frame, ia, ib ORDER BY ang)),
inter AS (SELECT frame, ia, ib, abs(sum(x * ny - nx * y)) / 2 AS i FROM ring GROUP BY ALL),
overlap AS (SELECT p.frame, p.ia, p.ib, coalesce(i, 0) / (a.w * a.h + b.w * b.h - coalesce(i, 0)) AS iou
  FROM pairs p LEFT JOIN inter USING (frame, ia, ib)
  JOIN turned a ON a.frame = p.frame AND a.det_idx = p.ia JOIN turned b ON b.frame = p.frame AND b.det_idx = p.ib)""".replace(
    " e JOIN (SELECT 1) ON s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1, \n  (SELECT NULL) p0(z) , LATERAL (SELECT e.frame, e.ia, e.ib) p)",
    " e WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)").replace("SELECT p.frame, p.ia, p.ib, e.x + s", "SELECT frame, ia, ib, e.x + s")


@query("fn3_polygon_iou", BOXES + "," + CORNERS + """,
pairs AS (SELECT frame, det_idx AS ia, lead(det_idx) OVER (PARTITION BY frame ORDER BY det_idx) AS ib FROM boxes
  QUALIFY ib IS NOT NULL),""" + POLY_PAIRS + """
SELECT frame, ia AS det_idx, CASE WHEN iou < 0.0005 THEN 0 ELSE round(iou * 1000) / 1000 END AS iou FROM overlap""")
def fn3(t: Tables):
    from pyspark.sql import Window as W
    w = W.partitionBy("frame").orderBy("det_idx")
    pairs = oriented(t).withColumn("other", F.lead("poly").over(w)).where("other is not null")
    rows = PG.with_overlap(pairs.select(*KEEP, "poly", "other"), "poly", "other", "value")
    return rows.select(*KEEP, F.when(F.col("value") < 0.0005, 0.0).otherwise(fixed(F.col("value"), 3)).alias("iou"))


@query("fn4_point_in_polygon", BOXES + """
SELECT cls, count(*) AS n FROM (SELECT *, "left" + "right" AS x, top + bottom AS y FROM boxes)
WHERE (x BETWEEN 40 AND 200 AND y BETWEEN 100 AND 300) AND NOT (x > 100 AND y > 200)
GROUP BY cls""")
def fn4(t: Tables):
    # an L shape, so the test is not convex
    shape = [(40, 100), (200, 100), (200, 200), (100, 200), (100, 300), (40, 300)]
    b = G.Box.of()
    return t.boxes.where(G.point_in_polygon(b.left + b.right, b.top + b.bottom, shape)).groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"))


@query("fn5_side_of_line", BOXES + """
SELECT frame, det_idx, CAST(sign(150 * (top - 10) - 90 * ("left" - 5)) AS INT) AS side FROM boxes""")
def fn5(t: Tables):
    s = G.side_of_line((5, 10), (155, 100), F.col("left"), F.col("top"))
    return t.boxes.select(*KEEP, F.signum(s).cast("int").alias("side"))


@query("fn6_segments_cross", BOXES + """
SELECT frame, det_idx FROM boxes WHERE (top - 60 > 0) <> (bottom - 60 > 0)
  AND (("right" - "left") * (60 - top) - (bottom - top) * (20 - "left") > 0)
   <> (("right" - "left") * (60 - top) - (bottom - top) * (120 - "left") > 0)""")
def fn6(t: Tables):
    hit = G.segments_cross((F.col("left"), F.col("top")), (F.col("right"), F.col("bottom")), (20, 60), (120, 60))
    return t.boxes.where(hit).select(*KEEP)


@query("fn7_polygon_area", BOXES + " SELECT frame, det_idx, CAST(w * h AS DOUBLE) AS area FROM boxes")
def fn7(t: Tables):
    return oriented(t).select(*KEEP, F.round(G.polygon_area(F.col("poly"))).alias("area"))


@query("fn8_polygon_clip_rectangle", BOXES + """
SELECT frame, det_idx, CAST(i AS DOUBLE) AS area FROM (SELECT *, (least("right", 100) - greatest("left", 30)) *
  (least(bottom, 90) - greatest(top, 20)) AS i FROM boxes WHERE "left" < 100 AND "right" > 30 AND top < 90 AND bottom > 20)""")
def fn8(t: Tables):
    tile = G.box_polygon(G.Box(F.lit(30), F.lit(20), F.lit(100), F.lit(90)))
    rows = t.boxes.select(*KEEP, G.box_polygon(G.Box.of()).alias("poly"), tile.alias("tile"))
    return PG.with_clip(rows, "poly", "tile", "cut", "area").where("size(cut) >= 3 and area > 0").select(*KEEP, "area")


@query("fn9_tracker_distances", BOXES + "," + NEXT + """
SELECT frame, det_idx, round(sqrt(pow("left" + "right" - l2 - r2, 2) + pow(top + bottom - t2 - b2, 2)) / 2 * 10000) / 10000 AS distance,
  round(greatest(10, sqrt(w * w + h * h) * 1.8) * 10000) / 10000 AS reach,
  round(least(w * h, (r2 - l2) * (b2 - t2)) / greatest(w * h, (r2 - l2) * (b2 - t2)) * 10000) / 10000 AS ratio
FROM nexts WHERE l2 IS NOT NULL""")
def fn9(t: Tables):
    a, b = G.Box.of(), G.Box.of("n_")
    return neighbours(t).select(*KEEP, fixed(G.centre_distance(a, b)).alias("distance"),
                                fixed(G.max_centre_distance(a, 1.8)).alias("reach"),
                                fixed(G.size_ratio(a, b)).alias("ratio"))


@query("fn10_adaptive_blend", BOXES + "," + NEXT + """
SELECT frame, det_idx, round(al * 10000) / 10000 AS alpha, CAST(round(al * "left" + (1 - al) * l2) AS INT) AS left_blend
FROM (SELECT *, least(0.78, greatest(0.30, 0.65 + (1 - least(1.0, d / greatest(10, sqrt(w * w + h * h) * 0.5))) * 0.10)) AS al
  FROM (SELECT *, sqrt(pow("left" + "right" - l2 - r2, 2) + pow(top + bottom - t2 - b2, 2)) / 2 AS d FROM nexts WHERE l2 IS NOT NULL))""")
def fn10(t: Tables):
    a, b = G.Box.of(), G.Box.of("n_")
    alpha = G.smoothing_alpha(a, b, 0.65)
    return neighbours(t).select(*KEEP, fixed(alpha).alias("alpha"), G.blend(a, b, alpha).left.alias("left_blend"))


# suppression ---------------------------------------------------------------------------

@query("sup1_top_k_per_frame", BOXES + """
SELECT frame, det_idx, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) AS INT) AS rank
FROM boxes QUALIFY rank <= 12""")
def sup1(t: Tables):
    return S.top_k(t.boxes, 12).select(*KEEP, "rank")


@query("sup2_class_nms", BOXES + "," + greedy_sql(pairs_sql(iou_sql("a", "b") + " > 0.45", "AND a.cls = b.cls"), "b.frame, b.cls")
       .replace("SELECT b.frame, b.cls, unnest", "SELECT frame, cls, unnest") + " SELECT frame, det_idx FROM kept")
def sup2(t: Tables):
    return S.nms(t.boxes, 0.45).select(*KEEP)


@query("sup3_agnostic_nms", BOXES + """,
cut AS (SELECT * FROM boxes WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) <= 20),"""
       + greedy_sql(pairs_sql(iou_sql("a", "b") + " > 0.4", "", "cut"), "b.frame", "cut")
       .replace("SELECT b.frame, unnest", "SELECT frame, unnest") + """
SELECT frame, det_idx FROM kept JOIN cut USING (frame, det_idx)
QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) <= 6""")
def sup3(t: Tables):
    return S.nms_agnostic(t.boxes, 0.2, 0.4, 20, 6).select(*KEEP)


@query("sup4_rotated_nms", BOXES + "," + CORNERS + """,
pairs AS (SELECT a.frame, a.det_idx AS ia, b.det_idx AS ib FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.cls = b.cls
  AND (b.score < a.score OR (b.score = a.score AND b.det_idx > a.det_idx))),""" + POLY_PAIRS + ","
       + greedy_sql("SELECT frame, ia AS det_idx, list(ib) AS ids FROM overlap WHERE iou > 0.3 GROUP BY ALL", "b.frame, b.cls")
       .replace("SELECT b.frame, b.cls, unnest", "SELECT frame, cls, unnest") + " SELECT frame, det_idx FROM kept")
def sup4(t: Tables):
    o = oriented(t).select("frame", "cls", "det_idx", "score", "poly", F.col("o_left").alias("left"),
                           F.col("o_top").alias("top"), F.col("o_right").alias("right"), F.col("o_bottom").alias("bottom"))
    return S.rotated_nms(o, 0.3).select(*KEEP)


@query("sup5_near_duplicates", BOXES + ","
       + greedy_sql(pairs_sql(iou_sql("a", "b") + " >= 0.75", "AND a.cls = b.cls"), "b.frame, b.cls")
       .replace("SELECT b.frame, b.cls, unnest", "SELECT frame, cls, unnest") + """
SELECT b.frame, b.det_idx, k.det_idx IS NULL AS suppressed FROM boxes b LEFT JOIN kept k USING (frame, det_idx)""")
def sup5(t: Tables):
    return S.flag_duplicates(t.boxes).select(*KEEP, "suppressed")


@query("sup6_mask_cap", BOXES + """
SELECT frame, det_idx FROM boxes QUALIFY row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) <= 64""")
def sup6(t: Tables):
    return S.mask_cap(t.boxes).select(*KEEP)


@query("sup9_top_classes", TRACKED + """
SELECT cls, n, CAST((SELECT count(*) FROM tracked) AS BIGINT) AS total
FROM (SELECT cls, count(*) AS n FROM tracked GROUP BY cls) ORDER BY n DESC, cls LIMIT 3""")
def sup9(t: Tables):
    counts = t.tracked.groupBy(F.col("cls")).agg(F.count(F.lit(1)).alias("n"))
    return S.top_classes(counts, 3)


# joins ---------------------------------------------------------------------------------

@query("jn2_suppression_pairs", BOXES + f"""
SELECT a.frame, count(*) AS pairs FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.cls = b.cls
  AND (b.score < a.score OR (b.score = a.score AND b.det_idx > a.det_idx))
WHERE {iou_sql('a', 'b')} >= 0.75 GROUP BY a.frame""")
def jn2(t: Tables):
    # counted inside each frame's array, without writing the pairs out
    item = F.struct((-F.col("score")).alias("neg"), "det_idx", "left", "top", "right", "bottom")
    ranked = t.boxes.groupBy("frame", "cls").agg(F.array_sort(F.collect_list(item)).alias("a"))
    later = F.transform("a", lambda x, i: F.size(F.filter(
        F.slice("a", i + 2, F.greatest(F.size("a") - i - 1, F.lit(0))),
        lambda y: G.iou(G.Box.field(x), G.Box.field(y)) >= 0.75)))
    per = ranked.select("frame", F.aggregate(later, F.lit(0), lambda s, v: s + v).alias("n"))
    return per.groupBy("frame").agg(F.sum("n").alias("pairs")).where("pairs > 0")


@query("jn4_sub_labels", BOXES + """
SELECT frame, det_idx, CASE WHEN qty % 4 = 0 THEN NULL ELSE CAST(qty % 4 AS BIGINT) END AS sub_cls FROM boxes""")
def jn4(t: Tables):
    from framelens.operators.cascade import attach_sub_labels
    subs = t.boxes.select("frame", "det_idx", (F.col("qty") % 4 - F.when(F.col("qty") % 4 == 0, 1).otherwise(0)).alias("sub_cls"))
    return attach_sub_labels(t.boxes, subs).select(*KEEP, "sub_cls")


# reports -------------------------------------------------------------------------------

MIXED = BOXES + """,
framed AS (SELECT frame, source, CASE WHEN frame % 9 = 0 THEN 'pose' ELSE 'detect' END AS type FROM boxes GROUP BY frame, source)"""


def mixed(t: Tables):
    """Frames of two types with labelled detections."""
    f = nested(t).withColumn("type", F.when(F.col("frame") % 9 == 0, "pose").otherwise("detect"))
    return f.withColumn("dets", F.transform("dets", lambda d: d.withField(
        "label", FL.label_of(d["cls"], NAMES))))


@query("agg1_detection_stats", MIXED + """
SELECT (SELECT count(*) FROM framed) AS frames, (SELECT count(*) FROM framed WHERE type = 'detect') AS frames_with_dets,
  count(*) AS total, round(avg(score) * 10000) / 10000 AS mean_score, min(score) AS min_score, max(score) AS max_score,
  count(*) FILTER (score < 0.5) AS borderline
FROM boxes JOIN framed USING (frame) WHERE type = 'detect'""")
def agg1(t: Tables):
    return RP.detection_stats(mixed(t)).withColumn("mean_score", fixed(F.col("mean_score")))


@query("agg1_detections_by_label", MIXED + """
SELECT CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'class_' || cls END AS label, count(*) AS n
FROM boxes JOIN framed USING (frame) WHERE type = 'detect' GROUP BY 1""")
def agg1_label(t: Tables):
    return RP.detections_by_label(mixed(t))


@query("agg2_frames_by_source", MIXED + """
SELECT 'cam' || source AS source, count(*) AS frames FROM framed WHERE type = 'detect' GROUP BY 1""")
def agg2(t: Tables):
    return RP.frames_by_source(mixed(t))


@query("agg4_observed_classes", BOXES + f" SELECT {LABEL_SQL} AS name, count(*) AS n FROM boxes GROUP BY 1")
def agg4(t: Tables):
    return RP.observed_classes(t.boxes, FL.label_of(F.col("cls"), NAMES))


@query("agg6_unique_objects", TRACKED + """
SELECT source, cls, count(*) AS objects FROM (
  SELECT source, track_id, arg_min(cls, ts_ms) AS cls FROM tracked WHERE confirmed GROUP BY source, track_id)
GROUP BY source, cls""")
def agg6(t: Tables):
    return RP.unique_objects(t.tracked)


@query("agg7_frame_class_counts", BOXES + """
SELECT frame, CAST(sum(n) AS BIGINT) AS total, string_agg(cls || ':' || n, ',' ORDER BY cls) AS classes
FROM (SELECT frame, cls, count(*) AS n FROM boxes GROUP BY frame, cls) GROUP BY frame""")
def agg7(t: Tables):
    text = F.array_join(F.transform("classes", lambda c: F.concat_ws(":", c["class"], c["count"])), ",")
    return RP.frame_class_counts(t.boxes).withColumn("classes", text)


@query("rul14_count_alert", BOXES + " SELECT frame, count(*) AS total FROM boxes GROUP BY frame HAVING count(*) >= 40")
def rul14(t: Tables):
    return RP.count_alerts(t.boxes, 40).select("frame", "total")


@query("agg17_class_areas", BOXES + """
SELECT frame, cls, count(*) AS pixels FROM (
  SELECT frame, px, py, arg_max(cls, value * 10 - cls) AS cls FROM (
    SELECT frame, "left" // 20 AS px, top // 20 AS py, cls, max(qty) AS value FROM boxes GROUP BY ALL)
  GROUP BY frame, px, py) GROUP BY frame, cls""")
def agg17(t: Tables):
    cells = t.boxes.groupBy("frame", F.expr("left div 20").alias("px"), F.expr("top div 20").alias("py"), "cls").agg(
        F.max("qty").alias("value"))
    return RP.class_areas(cells)


# frame lines ---------------------------------------------------------------------------

PAYLOAD = f"""lines AS (SELECT frame, '{{"schema_version":1,"frame":' || frame || ',"width":320,"height":240,"source":"cam' ||
  any_value(source) || '","type":"detect","dets":[' || string_agg('{{"bbox":[' || "left" || ',' || top || ',' || w || ',' || h ||
  '],"score":' || score || ',"cls":' || cls || ',"label":"' || {LABEL_SQL} || '"}}', ',' ORDER BY det_idx) || ']}}' AS value
  FROM boxes GROUP BY frame)"""


@query("snk2_result_payload", BOXES + "," + PAYLOAD + " SELECT frame, value FROM lines")
def snk2(t: Tables):
    return SF.detect_payload(nested(t), NAMES, 320, 240)


@query("snk3_review_payload", BOXES + """
SELECT frame, '{"type":"detect","count":' || count(*) || ',"items":[' || string_agg('{"cls_id":' || cls || ',"name":"' ||
  CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'class_' || cls END || '","conf":' || score || ',"box":[' ||
  "left" || ',' || top || ',' || "right" || ',' || bottom || ']}', ',' ORDER BY det_idx) || ']}' AS value
FROM boxes GROUP BY frame""")
def snk3(t: Tables):
    return SF.review_payload(nested(t), NAMES)


def lines(t: Tables):
    """Result lines in both dialects, with truncated and blank ones among them."""
    good = SF.detect_payload(nested(t), NAMES, 320, 240)
    dump = F.regexp_replace(F.regexp_replace("value", '"frame":', '"index":'), '"source":("[^"]*"),"type":"detect"', '"file":$1')
    return good.withColumn("value", F.when(F.col("frame") % 10 == 3, F.expr("left(value, length(value) - 5)"))
                           .when(F.col("frame") % 10 == 4, "").when(F.col("frame") % 10 == 5, dump)
                           .otherwise(F.col("value")))


@query("src1_frame_lines_round_trip", BOXES + """
SELECT frame, count(*) AS dets, CAST(sum("left") AS BIGINT) AS x FROM boxes WHERE frame % 10 NOT IN (3, 4) GROUP BY frame""")
def src1(t: Tables):
    path = scratch_path(t.spark, "frame-lines")
    SF.write_frames(lines(t), path)
    rows = SF.normalise(SF.read_frames(t.spark, path))
    return SF.unnest(rows).groupBy("frame").agg(F.count("cls").alias("dets"), F.sum("left").alias("x"))


@query("src2_dialects", BOXES + """
SELECT frame, 'cam' || any_value(source) AS source, 'detect' AS type, 'bbox' AS kind, CAST(count(*) AS INT) AS n
FROM boxes WHERE frame % 10 NOT IN (3, 4) GROUP BY frame""")
def src2(t: Tables):
    return SF.normalise(SF.parse_frames(lines(t))).select("frame", "source", "type", "kind", F.size("dets").alias("n"))


@query("src3_unnest_detections", BOXES + f"""
SELECT frame, det_idx, CAST("left" AS INT) AS "left", CAST(bottom AS INT) AS bottom, score, {LABEL_SQL} AS label FROM boxes""")
def src3(t: Tables):
    rows = SF.unnest(SF.normalise(SF.parse_frames(SF.detect_payload(nested(t), NAMES, 320, 240))))
    return rows.select(*KEEP, "left", "bottom", "score", "label")


@query("snk1_frames_with_results", BOXES + " SELECT count(*) AS lines FROM (SELECT frame FROM boxes GROUP BY frame HAVING count(*) >= 30)")
def snk1(t: Tables):
    path = scratch_path(t.spark, "results")
    frames = nested(t).withColumn("has_result", F.size("dets") >= 30)
    payload = SF.detect_payload(frames, NAMES, 320, 240).join(frames.select("frame", "has_result"), "frame")
    SF.write_frames(payload, path, F.col("has_result"))
    return t.spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


# every kind of result ------------------------------------------------------------------

KINDS = ["detect", "pose", "obb", "seg", "depth", "composite_cls", "face", "action", "none"]


def every_kind(t: Tables, gaps: bool = False):
    """Normalised frames of all nine kinds in turn; with ``gaps`` some scores are not a number."""
    row = F.struct("det_idx", "left", "top", "w", "h", "score", "cls", "line", "qty")
    rows = t.boxes.groupBy("frame", F.concat(F.lit("cam"), "source").alias("source")).agg(F.array_sort(F.collect_list(row)).alias("all"))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("frame") % 9).cast("int"))

    def score(d):
        return F.when((d["det_idx"] % 11 == 5) & F.lit(gaps), F.lit(float("nan"))).otherwise(d["score"]).alias("score")

    def head(d):
        return [F.array(*[d[c].cast("int") for c in ("left", "top", "w", "h")]).alias("bbox"), score(d), d["cls"].cast("int").alias("cls")]

    def points(d, n, *more):
        return F.array(*[F.array((d["left"] + i).cast("double"), (d["top"] + i).cast("double"), *more) for i in range(n)]).alias("kpts")

    track = lambda d: d["line"].cast("int").alias("track_id")
    mask = lambda d: (d["det_idx"] % 2).cast("int")
    made = {
        "dets": (("detect", "composite_cls"), lambda d: F.struct(*head(d), FL.label_of(d["cls"], NAMES).alias("label"), F.when(
            F.col("type") == "composite_cls", F.struct((d["line"] % 3 - 1).cast("int").alias("cls"), F.lit(0.25).alias("score"),
                                                       F.concat(F.lit("c"), d["line"]).alias("label"))).alias("sub"))),
        "poses": (("pose", "action"), lambda d: F.struct(*head(d), track(d), points(d, 17, F.lit(0.5)))),
        "obbs": (("obb",), lambda d: F.struct(F.array(*[d[c].cast("double") for c in ("left", "top", "w", "h")], d["qty"] / 64.0).alias("box"),
                                              score(d), d["cls"].cast("int").alias("cls"), track(d))),
        "segs": (("seg",), lambda d: F.struct(*head(d), track(d), mask(d).alias("mask"), F.when(
            mask(d) == 1, F.array(F.lit(0), d["w"].cast("int"), d["h"].cast("int"))).alias("rle"))),
        "faces": (("face",), lambda d: F.struct(head(d)[0], score(d), points(d, 5))),
        "actions": (("action",), lambda d: F.struct(track(d), d["cls"].cast("int").alias("action"), score(d)))}
    first = F.get("all", F.lit(0))
    depth = F.struct(F.array(*[first[c].cast("int") for c in ("left", "top", "w", "h")]).alias("roi"),
                     F.array(F.lit(0.5), first["qty"].cast("double")).alias("range"))
    return rows.withColumn("type", kind).select(
        "frame", "source", "type", F.lit(320).alias("width"), F.lit(240).alias("height"),
        *[F.when(F.col("type").isin(*kinds), F.transform("all", one)).alias(name) for name, (kinds, one) in made.items()],
        F.when(F.col("type") == "depth", depth).alias("depth"))


KIND_SQL = f"""kinds AS (SELECT *, ['{"','".join(KINDS)}'][frame % 9 + 1] AS type FROM boxes),
parts AS (SELECT *, unnest(CASE type WHEN 'action' THEN ['poses', 'actions'] WHEN 'detect' THEN ['dets'] WHEN 'composite_cls' THEN ['dets']
  WHEN 'pose' THEN ['poses'] WHEN 'obb' THEN ['obbs'] WHEN 'seg' THEN ['segs'] WHEN 'face' THEN ['faces'] ELSE [] END) AS part FROM kinds)"""


def _written_kinds(t: Tables):
    """All kinds written as result lines, and read back."""
    path = scratch_path(t.spark, "kinds")
    SF.write_frames(SF.result_payload(every_kind(t, gaps=True)), path)
    return SF.normalise(SF.read_frames(t.spark, path))


@query("snk2_every_kind", BOXES + "," + KIND_SQL + """
SELECT frame, 'cam' || source AS source, type, part, det_idx AS item, a."left" AS x, a.top AS y, a.w, a.h, CASE WHEN type = 'obb' THEN qty / 64.0::DOUBLE END AS angle,
  CASE WHEN det_idx % 11 = 5 THEN 0.0 ELSE score END::DOUBLE AS score, CASE WHEN part NOT IN ('faces', 'actions') THEN cls END AS cls,
  CASE WHEN part = 'dets' THEN """ + LABEL_SQL + """ END AS label, CASE WHEN part NOT IN ('dets', 'faces') THEN line END AS track_id,
  CASE WHEN type = 'pose' THEN 17 * p."left" + 136 WHEN type = 'face' THEN 5 * p."left" + 10 END AS points_x,
  CASE WHEN type = 'pose' THEN 8.5 END::DOUBLE AS points_sure, CASE WHEN type = 'seg' THEN det_idx % 2 END AS mask,
  CASE WHEN type = 'seg' AND det_idx % 2 = 1 THEN p.w + p.h END AS mask_run, CASE WHEN part = 'actions' THEN cls END AS action,
  CASE WHEN type = 'composite_cls' AND line % 3 > 0 THEN line % 3 - 1 || ':c' || line || ':0.25' END AS second
FROM parts p LEFT JOIN (SELECT frame AS f, det_idx AS i, "left", top, w, h FROM boxes) a ON a.f = p.frame AND a.i = p.det_idx AND p.part <> 'actions'""")
def snk2_kinds(t: Tables):
    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    x, y, w, h = [F.get("box", F.lit(i)).cast("long") for i in range(4)]
    return SF.items(_written_kinds(t)).select(
        "frame", "source", "type", "part", "item", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.get("box", F.lit(4)).alias("angle"),
        "score", "cls", "label", "track_id", total(F.transform("kpts", lambda k: k[0])).cast("long").alias("points_x"),
        total(F.transform("kpts", lambda k: F.get(k, F.lit(2)))).alias("points_sure"), "mask",
        F.aggregate("rle", F.lit(0), lambda a, v: a + v).alias("mask_run"), "action",
        F.concat_ws(":", "sub.cls", "sub.label", "sub.score").alias("second")).withColumn("second", F.nullif("second", F.lit("")))


@query("src2_every_kind", BOXES + "," + KIND_SQL + """
SELECT frame, any_value(type) AS type, CASE WHEN any_value(type) IN ('pose', 'action') THEN 'kpts' WHEN any_value(type) = 'seg' THEN 'segm' ELSE 'bbox' END AS kind,
  CASE WHEN any_value(type) = 'depth' THEN arg_min("left" || ',' || top || ',' || w || ',' || h || ':' || qty, det_idx) END AS depth FROM kinds GROUP BY frame""")
def src2_kinds(t: Tables):
    depth = F.concat(F.array_join("depth.roi", ","), F.lit(":"), F.get("depth.range", F.lit(1)).cast("long"))
    return _written_kinds(t).select("frame", "type", "kind", depth.alias("depth"))


def _points_sql(n: int, more: str = "") -> str:
    return " || ',' || ".join(f"""'[' || ("left" + {i}) || '.0,' || (top + {i}) || '.0{more}]'""" for i in range(n))


@query("snk3_every_kind", BOXES + "," + KIND_SQL + f""",
each AS (SELECT frame, type, det_idx, '"cls_id":' || cls || ',"name":"' || CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'class_' || cls END || '","conf":' || score AS head,
  '"box":[' || "left" || ',' || top || ',' || "right" || ',' || bottom || ']' AS edges, ',"track_id":' || line AS track, score, cls, line, "left", top, w, h, qty FROM kinds),
text AS (SELECT *, CASE WHEN type IN ('detect', 'composite_cls') THEN head || ',' || edges || CASE WHEN type = 'composite_cls' AND line % 3 > 0
    THEN ',"sub":{{"cls_id":' || (line % 3 - 1) || ',"score":0.25,"label":"c' || line || '"}}' ELSE '' END
  WHEN type IN ('pose', 'action') THEN head || ',' || edges || track || ',"keypoints":[' || {_points_sql(17, ",0.5")} || ']'
  WHEN type = 'obb' THEN head || ',"box":{{"x":' || "left" || ',"y":' || top || ',"w":' || w || ',"h":' || h || ',"angle":' || (qty / 64.0::DOUBLE) || '}}' || track
  WHEN type = 'seg' THEN head || ',"box":[' || "left" || ',' || top || ',' || w || ',' || h || ']' || track
  WHEN type = 'face' THEN '"conf":' || score || ',' || edges || ',"landmarks":[' || {_points_sql(5)} || ']' END AS item,
  '{{"track_id":' || line || ',"action_id":' || cls || ',"score":' || score || '}}' AS act FROM each)
SELECT frame, CASE any_value(type) WHEN 'none' THEN '{{"type":"none"}}' WHEN 'depth' THEN '{{"type":"depth","summary":"depth map only"}}' ELSE
  '{{"type":"' || any_value(type) || '","count":' || count(*) || ',"items":[' || string_agg('{{' || item || '}}', ',' ORDER BY det_idx) || ']' ||
  CASE WHEN any_value(type) = 'action' THEN ',"actions":[' || string_agg(act, ',' ORDER BY det_idx) || ']' ELSE '' END || '}}' END AS value FROM text GROUP BY frame""")
def snk3_kinds(t: Tables):
    return SF.review_result(every_kind(t), NAMES)
