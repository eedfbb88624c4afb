"""Scoring queries: truth is the boxes view, predictions are the same boxes moved a little."""
from __future__ import annotations

from pyspark.sql import functions as F

from framelens.functions import geometry as G
from framelens.functions.text import percent_text
from framelens.operators import evaluation as V
from framelens.operators import reports as RP
from framelens.session import scratch_path
from framelens.workload.detections import iou_sql
from framelens.workload.registry import query
from framelens.workload.views import BOXES, Tables, big, fixed

AREAS = {"all": (0.0, 1e10), "small": (0.0, 3000.0), "medium": (3000.0, 5000.0), "large": (5000.0, 1e10)}


def _shape(shift):
    return F.struct(*[(F.col(c) + shift).alias(c) if c in ("left", "right") else F.col(c)
                      for c in ("left", "top", "right", "bottom")])


def truth(t: Tables):
    return t.boxes.select(F.col("frame").alias("image"), "cls", F.col("det_idx").alias("gt_idx"),
                          (F.col("line") == 7).cast("int").alias("difficult"), _shape(0).alias("box"))


def predictions(t: Tables):
    return t.boxes.select(F.col("frame").alias("image"), "cls", "score", "det_idx",
                          (F.col("frame") * 10000 + F.col("det_idx")).alias("det_order"),
                          _shape(F.col("qty") % 13 * 2).alias("box"))


box_iou = V.plain_iou


PAIRS = BOXES + f""",
g AS (SELECT frame, cls, det_idx, line = 7 AS difficult, "left", top, "right", bottom FROM boxes),
p AS (SELECT frame, cls, det_idx, score, frame * 10000 + det_idx AS det_order, "left" + qty % 13 * 2 AS "left", top,
    "right" + qty % 13 * 2 AS "right", bottom FROM boxes),
cand AS (SELECT p.frame, p.cls, p.det_idx, p.score, p.det_order, g.det_idx AS gt_idx, g.difficult, {iou_sql('p', 'g')} AS iou
  FROM p JOIN g ON p.frame = g.frame AND p.cls = g.cls),
best AS (SELECT p.frame, p.cls, p.det_idx, p.score, p.det_order, b.gt_idx, b.difficult, coalesce(b.iou, 0) AS iou FROM p LEFT JOIN (
  SELECT * FROM cand WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY frame, det_idx ORDER BY iou DESC, gt_idx) = 1) b
  ON p.frame = b.frame AND p.det_idx = b.det_idx)"""

THR = "thr AS (SELECT i AS thr_no, [0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95][i + 1]::DOUBLE AS thr FROM range(0, 10) r(i))"


def _ap_sql(matched: str, keys: str, npos: str) -> str:
    """AP over a CTE `matched` with keys, thr_no, score, det_order, tp, fp."""
    return f"""
curve AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM {matched}
  WINDOW w AS (PARTITION BY {keys}, thr_no ORDER BY score DESC, det_order ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT {keys}, thr_no, ctp * 100 // npos AS k, max(ctp / (ctp + cfp)) AS p
  FROM curve JOIN {npos} USING ({keys}) WHERE tp = 1 GROUP BY ALL),
apk AS (SELECT {keys}, t.thr_no, n.npos, q.k, coalesce((SELECT max(p) FROM pts WHERE {' AND '.join(f'pts.{k.strip()} = n.{k.strip()}' for k in keys.split(','))}
    AND pts.thr_no = t.thr_no AND pts.k >= q.k), 0) AS p FROM {npos} n, (SELECT DISTINCT thr_no FROM thr) t, range(0, 101) q(k) WHERE n.npos > 0),
ap AS (SELECT {keys}, thr_no, npos, avg(p) AS ap FROM apk GROUP BY ALL)"""


ORIENTED = PAIRS + "," + THR + """,
flagged AS (SELECT b.*, thr_no, coalesce(gt_idx IS NOT NULL AND iou >= thr, false) AS hit, thr FROM best b, thr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame, cls, gt_idx, thr_no, hit ORDER BY score DESC, det_order) AS n FROM flagged),
matched AS (SELECT cls, thr_no, score, det_order, CASE WHEN hit AND NOT difficult AND n = 1 THEN 1 ELSE 0 END AS tp,
  CASE WHEN hit AND difficult THEN 0 WHEN hit AND n = 1 THEN 0 ELSE 1 END AS fp FROM ranked),
npos AS (SELECT cls, count(*) FILTER (NOT difficult) AS npos FROM g GROUP BY cls),""" + _ap_sql("matched", "cls", "npos")


@query("jn1_best_truth", PAIRS + " SELECT frame AS image, det_idx, gt_idx, round(iou * 1000000) / 1000000 AS iou FROM best")
def jn1(t: Tables):
    return V.best_truth(predictions(t), truth(t), box_iou, "box").select(
        "image", "det_idx", "gt_idx", fixed(F.col("iou"), 6).alias("iou"))


@query("jn12_thresholds_by_pairs", ORIENTED + """
SELECT cls, CAST(thr_no AS INT) AS thr_no, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM matched GROUP BY cls, thr_no""")
def jn12(t: Tables):
    m = V.oriented_matches(V.best_truth(predictions(t), truth(t), box_iou, "box"))
    return (m.select("cls", F.posexplode(F.arrays_zip("tp", "fp")).alias("thr_no", "f"))
            .groupBy("cls", "thr_no").agg(F.sum("f.tp").alias("tp"), F.sum("f.fp").alias("fp")))


@query("win6_precision_points", ORIENTED + """
SELECT cls, CAST(thr_no AS INT) AS thr_no, CAST(k AS INT) AS k, round(p * 1000000) / 1000000 AS p FROM pts""")
def win6(t: Tables):
    m = V.oriented_matches(V.best_truth(predictions(t), truth(t), box_iou, "box"))
    npos = truth(t).groupBy("cls").agg(F.count_if(F.col("difficult") != 1).alias("npos"))
    return V.precision_points(m, npos, ["cls"], 10).select("cls", "thr_no", "k", fixed(F.col("p"), 6).alias("p"))


#: Nine of ten detections share one score.
ONE_SCORE = "CASE WHEN (frame * 7 + det_idx) % 10 < 9 THEN 0.5 ELSE score END AS score"


@query("win6_equal_scores", ORIENTED.replace("det_idx, score, frame", f"det_idx, {ONE_SCORE}, frame", 1) + """
SELECT cls, CAST(thr_no AS INT) AS thr_no, CAST(k AS INT) AS k, round(p * 1000000) / 1000000 AS p FROM pts""")
def win6_equal(t: Tables):
    dets = predictions(t).withColumn("score", F.when((F.col("image") * 7 + F.col("det_idx")) % 10 < 9, 0.5).otherwise(F.col("score")))
    m = V.oriented_matches(V.best_truth(dets, truth(t), box_iou, "box"))
    npos = truth(t).groupBy("cls").agg(F.count_if(F.col("difficult") != 1).alias("npos"))
    return V.precision_points(m, npos, ["cls"], 10).select("cls", "thr_no", "k", fixed(F.col("p"), 6).alias("p"))


@query("evl4_oriented_ap", ORIENTED + """
SELECT cls, CAST(thr_no AS INT) AS thr_no, npos, round(ap * 1000000) / 1000000 AS ap FROM ap""")
def evl4(t: Tables):
    return V.oriented_ap(predictions(t), truth(t), box_iou, "box").select(
        "cls", "thr_no", "npos", fixed(F.col("ap"), 6).alias("ap"))


@query("evl4_mean_ap", ORIENTED + """
SELECT round(avg(ap) FILTER (thr_no = 0) * 1000000) / 1000000 AS map50, round(avg(ap) * 1000000) / 1000000 AS map50_95 FROM ap""")
def evl4_mean(t: Tables):
    m = V.mean_ap(V.oriented_ap(predictions(t), truth(t), box_iou, "box"))
    return m.select(fixed(F.col("map50"), 6).alias("map50"), fixed(F.col("map50_95"), 6).alias("map50_95"))


@query("evl4_polygon_ap")
def evl4_polygon(t: Tables):
    # turned polygons; the overlap itself is checked by fn3_polygon_iou
    from framelens.workload.detections import oriented
    o = oriented(t).withColumn("image", F.col("frame"))
    gts = o.select("image", "cls", F.col("det_idx").alias("gt_idx"), (F.col("line") == 7).cast("int").alias("difficult"), "poly")
    moved = F.transform("poly", lambda p: p.withField("x", p["x"] + F.col("qty") % 13))
    dets = o.select("image", "cls", "score", (F.col("frame") * 10000 + F.col("det_idx")).alias("det_order"), moved.alias("poly"))
    dets, gts = V.oriented_inputs(dets, gts, gts)
    return V.oriented_ap(dets, gts)


@query("evl7_confidence_sweep", PAIRS + """,
cut AS (SELECT * FROM (VALUES (0.0::DOUBLE), (0.35), (0.7)) v(cut)),
thr AS (SELECT 0 AS thr_no),
ranked AS (SELECT b.*, cut, iou >= 0.5 AND gt_idx IS NOT NULL AS hit, row_number() OVER (PARTITION BY cut, frame, cls, gt_idx, iou >= 0.5
  ORDER BY score DESC, det_order) AS n FROM best b, cut WHERE score >= cut),
matched AS (SELECT cut, cls, 0 AS thr_no, score, det_order, CASE WHEN hit AND NOT difficult AND n = 1 THEN 1 ELSE 0 END AS tp,
  CASE WHEN hit AND (difficult OR n = 1) THEN 0 ELSE 1 END AS fp FROM ranked),
npos AS (SELECT cut, cls, count(*) FILTER (NOT difficult) AS npos FROM g, cut GROUP BY ALL),""" + _ap_sql("matched", "cut, cls", "npos") + """
SELECT cut, round(avg(ap) * 1000000) / 1000000 AS map50 FROM ap GROUP BY cut""")
def evl7(t: Tables):
    s = V.confidence_sweep(predictions(t), truth(t), [0.0, 0.35, 0.7], box_iou, "box")
    return s.select("cut", fixed(F.col("map50"), 6).alias("map50"))


def coco_inputs(t: Tables):
    area = (F.col("w") * F.col("h")).cast("double")
    crowd = (F.col("qty") % 17 == 0).cast("int")
    edges = ["left", "top", "right", "bottom"]
    dets = t.boxes.select(F.col("frame").alias("image"), F.col("cls").alias("cat"), "score",
                          F.col("det_idx").alias("det_order"), area.alias("area"),
                          *[(F.col(c) + F.col("qty") % 13 * 2).alias(c) if c in ("left", "right") else F.col(c) for c in edges])
    gts = t.boxes.select(F.col("frame").alias("image"), F.col("cls").alias("cat"), F.col("det_idx").alias("gt_idx"),
                         area.alias("area"), crowd.alias("crowd"), crowd.alias("ignore"), *edges)
    return dets, gts


COCO = BOXES + "," + THR + f""",
ranges AS (SELECT * FROM (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('small', 0.0, 3000.0), ('medium', 3000.0, 5000.0), ('large', 5000.0, 1e10)) v(area_range, lo, hi)),
g AS (SELECT frame, cls, det_idx, "left", top, "right", bottom, (w * h)::DOUBLE AS area, CASE WHEN qty % 17 = 0 THEN 1 ELSE 0 END AS crowd,
  row_number() OVER (PARTITION BY frame, cls ORDER BY det_idx) AS j FROM boxes),
p AS (SELECT frame, cls, det_idx, score, "left" + qty % 13 * 2 AS "left", top, "right" + qty % 13 * 2 AS "right", bottom, (w * h)::DOUBLE AS area,
  row_number() OVER (PARTITION BY frame, cls ORDER BY score DESC, det_idx) AS rank FROM boxes),
cand AS (SELECT p.frame, p.cls, p.rank, any_value(p.score) AS score, any_value(p.det_idx) AS det_idx, any_value(p.area) AS area,
    list(CASE WHEN g.crowd = 1 THEN greatest(least(p."right", g."right") - greatest(p."left", g."left"), 0) *
        greatest(least(p.bottom, g.bottom) - greatest(p.top, g.top), 0) / p.area ELSE {iou_sql('p', 'g')} END ORDER BY g.j) AS ious
  FROM p JOIN g ON p.frame = g.frame AND p.cls = g.cls GROUP BY p.frame, p.cls, p.rank),
gl AS (SELECT frame, cls, list({{'j': j, 'area': area, 'crowd': crowd}} ORDER BY j) AS gs FROM g GROUP BY ALL)"""

# matching as a recursion over ranks: every step settles one detection of every group
STEPS = """,
groups AS (SELECT frame, cls, gs, thr_no, thr, area_range, lo, hi FROM gl, thr, ranges),
step AS (
  SELECT frame, cls, thr_no, area_range, 0::BIGINT AS rank, []::BIGINT[] AS taken, 0 AS code FROM groups
  UNION ALL
  SELECT frame, cls, thr_no, area_range, rank, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END,
    CASE WHEN real IS NOT NULL THEN 1 WHEN other IS NOT NULL THEN -1 WHEN area < lo OR area > hi THEN -1 ELSE 0 END
  FROM (SELECT *, coalesce(real.j, other.j) AS pick FROM (
    SELECT s.frame, s.cls, s.thr_no, s.area_range, c.rank, s.taken, c.area, q.lo, q.hi,
      list_reverse_sort(list_transform(list_filter(q.gs, lambda y: c.ious[y.j] >= q.thr AND (y.crowd = 1 OR NOT list_contains(s.taken, y.j))
        AND NOT (y.crowd = 1 OR y.area < q.lo OR y.area > q.hi)), lambda y: {'iou': c.ious[y.j], 'j': y.j}))[1] AS real,
      list_reverse_sort(list_transform(list_filter(q.gs, lambda y: c.ious[y.j] >= q.thr AND (y.crowd = 1 OR NOT list_contains(s.taken, y.j))
        AND (y.crowd = 1 OR y.area < q.lo OR y.area > q.hi)), lambda y: {'iou': c.ious[y.j], 'j': y.j}))[1] AS other
    FROM step s JOIN cand c ON c.frame = s.frame AND c.cls = s.cls AND c.rank = s.rank + 1 AND c.rank <= 100
    JOIN groups q ON q.frame = s.frame AND q.cls = s.cls AND q.thr_no = s.thr_no AND q.area_range = s.area_range))),
coded AS (SELECT s.*, c.score, c.det_idx FROM step s JOIN cand c USING (frame, cls, rank)),
matched AS (SELECT cls, area_range, thr_no, score, frame * 10000 + det_idx AS det_order, rank,
  CASE WHEN code = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN code = 0 THEN 1 ELSE 0 END AS fp FROM coded),
npos AS (SELECT cls, area_range, count(*) AS npos FROM g, ranges WHERE crowd = 0 AND area BETWEEN lo AND hi GROUP BY ALL),""" + _ap_sql("matched", "cls, area_range", "npos") + """,
tops AS (SELECT cls, area_range, thr_no, sum(tp) FILTER (rank <= 1) AS t1, sum(tp) FILTER (rank <= 10) AS t10, sum(tp) AS t100 FROM matched GROUP BY ALL),
cells AS (SELECT cls AS cat, area_range, CAST(thr_no AS INT) AS thr_no, npos, ap, coalesce(t1, 0) / npos AS recall_1, coalesce(t10, 0) / npos AS recall_10,
  coalesce(t100, 0) / npos AS recall_100 FROM ap LEFT JOIN tops USING (cls, area_range, thr_no))"""

COCO = "WITH RECURSIVE " + COCO + STEPS


def _cells(t: Tables):
    dets, gts = coco_inputs(t)
    return V.coco_ap(dets, gts, areas=AREAS)


@query("evl1_box_ap", COCO + """
SELECT cat, area_range, thr_no, npos, round(ap * 1000000) / 1000000 AS ap, round(recall_1 * 1000000) / 1000000 AS recall_1,
  round(recall_10 * 1000000) / 1000000 AS recall_10, round(recall_100 * 1000000) / 1000000 AS recall_100 FROM cells""")
def evl1(t: Tables):
    return _cells(t).select("cat", "area_range", "thr_no", "npos", *[
        fixed(F.col(c), 6).alias(c) for c in ("ap", "recall_1", "recall_10", "recall_100")])


@query("evl5_per_class_ap", COCO + """
SELECT cat, round(avg(ap) * 1000000) / 1000000 AS AP, round(avg(ap) FILTER (thr_no = 0) * 1000000) / 1000000 AS AP50
FROM cells WHERE area_range = 'all' GROUP BY cat""")
def evl5(t: Tables):
    return V.per_class_ap(_cells(t)).select("cat", fixed(F.col("AP"), 6).alias("AP"), fixed(F.col("AP50"), 6).alias("AP50"))


SUMMARY_SQL = "SELECT " + ", ".join(
    f"round(avg({v}) FILTER (area_range = '{a}'{x}) * 1000000) / 1000000 AS {n}" for n, v, a, x in [
        ("AP", "ap", "all", ""), ("AP50", "ap", "all", " AND thr_no = 0"), ("AP75", "ap", "all", " AND thr_no = 5"),
        ("AR_max", "recall_100", "all", ""), ("AR_1", "recall_1", "all", ""), ("AR_10", "recall_10", "all", ""),
        ("AP_small", "ap", "small", ""), ("AP_medium", "ap", "medium", ""), ("AP_large", "ap", "large", ""),
        ("AR_small", "recall_100", "small", ""), ("AR_medium", "recall_100", "medium", ""),
        ("AR_large", "recall_100", "large", "")]) + " FROM cells"


@query("evl6_summary", COCO + " " + SUMMARY_SQL)
def evl6(t: Tables):
    row = V.summary_row(_cells(t))
    return row.select(*[fixed(F.col(c), 6).alias(c) for c in row.columns])


@query("evl8_quality_gate", COCO + """
SELECT 'AP' AS metric, avg(ap) * 100 >= 10 AS passed FROM cells WHERE area_range = 'all'
UNION ALL SELECT 'AP50', avg(ap) * 100 >= 99.5 FROM cells WHERE area_range = 'all' AND thr_no = 0""")
def evl8(t: Tables):
    return V.quality_gate(V.summary_row(_cells(t)), {"AP": 10.0, "AP50": 99.5, "AP75": 0.0}).select("metric", "passed")


# masks and keypoints -------------------------------------------------------------------

def masks(t: Tables):
    """A mask per box: rows of the box with a varying left part switched on."""
    w = F.col("w").cast("int")
    rows = F.sequence(F.lit(0), F.lit(5))
    on = ((F.col("qty") * 3 + F.col("line")) % (F.col("w") - 2) + 1).cast("int")
    rle = F.flatten(F.transform(rows, lambda r: F.array(F.when(r == 0, F.lit(0)).otherwise(w - F.col("on")), F.col("on"))))
    ints = {c: F.col(c).cast("int") for c in ("left", "top", "w", "h")}
    both = G.bind(rle, lambda r: F.struct(r.alias("rle"), V.rle_spans(
        r, ints["left"], ints["top"], ints["w"], ints["h"], F.lit(200), F.lit(150)).alias("spans")))
    # unnested, so that the spans are computed once for all their uses
    return t.boxes.withColumn("on", on).select("*", F.inline(F.array(both)))


@query("fn12_mask_area", BOXES + """
SELECT frame, det_idx, CAST(6 * o AS INT) AS mask_pixels, CAST(greatest(least("left" + o, 200) - "left", 0) * greatest(least(top + 6, 150) - top, 0) AS INT) AS frame_pixels
FROM (SELECT *, (qty * 3 + line) % (w - 2) + 1 AS o FROM boxes)""")
def fn12(t: Tables):
    return masks(t).select("frame", "det_idx", V.rle_area(F.col("rle")).alias("mask_pixels"),
                           V.spans_area(F.col("spans")).alias("frame_pixels"))


def _mask_inputs(t: Tables):
    m = masks(t).withColumn("area", V.spans_area(F.col("spans")).cast("double")).where("area > 0")
    edges = ["left", "top", "right", "bottom"]
    dets = m.select(F.col("frame").alias("image"), F.col("cls").alias("cat"), "score", F.col("det_idx").alias("det_order"),
                    "area", *edges, "spans")
    # the truth mask lies one row lower
    low = F.transform("spans", lambda s: s.withField("row", s["row"] + 1))
    gts = m.select(F.col("frame").alias("image"), F.col("cls").alias("cat"), F.col("det_idx").alias("gt_idx"), "area",
                   F.lit(0).alias("crowd"), F.lit(0).alias("ignore"), *edges, low.alias("spans"))
    return dets, gts


MASKED = BOXES + """, m AS (SELECT *, least("left" + o, 200) AS mr, least(top + 6, 150) AS mb, greatest(least("left" + o, 200) - "left", 0) *
    greatest(least(top + 6, 150) - top, 0) AS marea FROM (SELECT *, (qty * 3 + line) % (w - 2) + 1 AS o FROM boxes))"""


@query("evl2_mask_overlap", MASKED + """,
x AS (SELECT p.frame, p.det_idx, g.det_idx AS gi, greatest(least(p.mr, g.mr) - greatest(p."left", g."left"), 0) *
    greatest(least(p.mb, g.mb + 1) - greatest(p.top, g.top + 1), 0) AS i, p.marea AS a, g.marea AS b
  FROM m p JOIN m g ON p.frame = g.frame AND p.cls = g.cls)
SELECT frame AS image, det_idx AS det_order, round(max(i / (a + b - i)) * 1000000) / 1000000 AS best FROM x GROUP BY frame, det_idx""")
def evl2_overlap(t: Tables):
    dets, gts = _mask_inputs(t)
    return V.best_overlap(dets, gts, V.spans_overlap).select("image", "det_order", fixed(F.col("best"), 6).alias("best"))


MASK_COCO = "WITH RECURSIVE " + MASKED + "," + THR + """,
ranges AS (SELECT 'all' AS area_range, 0.0::DOUBLE AS lo, 1e10::DOUBLE AS hi),
g AS (SELECT frame, cls, det_idx, "left", top, mr, mb, marea::DOUBLE AS area, 0 AS crowd, row_number() OVER (PARTITION BY frame, cls ORDER BY det_idx) AS j FROM m WHERE marea > 0),
p AS (SELECT frame, cls, det_idx, score, "left", top, mr, mb, marea::DOUBLE AS area, row_number() OVER (PARTITION BY frame, cls ORDER BY score DESC, det_idx) AS rank FROM m WHERE marea > 0),
pairs AS (SELECT p.frame, p.cls, p.rank, p.score, p.det_idx, p.area, g.j, g.area AS ga,
    greatest(least(p.mr, g.mr) - greatest(p."left", g."left"), 0) * greatest(least(p.mb, g.mb + 1) - greatest(p.top, g.top + 1), 0) AS i
  FROM p JOIN g ON p.frame = g.frame AND p.cls = g.cls),
cand AS (SELECT frame, cls, rank, any_value(score) AS score, any_value(det_idx) AS det_idx, any_value(area) AS area, list(i / (area + ga - i) ORDER BY j) AS ious
  FROM pairs GROUP BY frame, cls, rank),
gl AS (SELECT frame, cls, list({'j': j, 'area': area, 'crowd': crowd} ORDER BY j) AS gs FROM g GROUP BY ALL)""" + STEPS


@query("evl2_mask_ap", MASK_COCO + """
SELECT cat, round(avg(ap) * 1000000) / 1000000 AS AP, round(avg(ap) FILTER (thr_no = 0) * 1000000) / 1000000 AS AP50 FROM cells GROUP BY cat""")
def evl2(t: Tables):
    dets, gts = _mask_inputs(t)
    per = V.per_class_ap(V.coco_ap(dets, gts, V.spans_overlap, areas={"all": (0.0, 1e10)}))
    return per.select("cat", fixed(F.col("AP"), 6).alias("AP"), fixed(F.col("AP50"), 6).alias("AP50"))


def _poses(t: Tables):
    """Seventeen points spread over the box; the predicted ones are moved by the quantity."""
    def points(shift):
        return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.array(
            (F.col("left") + F.col("w") * i / 17 + shift).cast("double"), (F.col("top") + F.col("h") * i / 17).cast("double"),
            ((i + F.col("qty")) % 3).cast("double")))
    one = t.boxes.where("cls = 0").withColumn("area", (F.col("w") * F.col("h")).cast("double"))
    edges = ["left", "top", "right", "bottom"]
    dets = one.select(F.col("frame").alias("image"), F.lit(1).alias("cat"), "score", F.col("det_idx").alias("det_order"), "area",
                      *edges, points(F.col("qty") % 5 * 2).alias("kpts"))
    gts = one.select(F.col("frame").alias("image"), F.lit(1).alias("cat"), F.col("det_idx").alias("gt_idx"), "area",
                     F.lit(0).alias("crowd"), F.lit(0).alias("ignore"), *edges, points(0).alias("kpts"))
    return dets, gts


@query("evl3_keypoint_similarity", BOXES + f""",
sig AS (SELECT unnest({V.KEYPOINT_SIGMAS}) AS s, unnest(range(0, 17)) AS i),
o AS (SELECT frame, det_idx, qty % 5 * 2 AS d, w * h AS area, s, i, (i + qty) % 3 AS v FROM boxes, sig WHERE cls = 0)
SELECT frame AS image, det_idx, round(avg(exp(-(d * d) / (2 * pow(2 * s, 2) * (area + 2.220446049250313e-16)))) * 1000000) / 1000000 AS oks
FROM o WHERE v > 0 GROUP BY frame, det_idx""")
def evl3_oks(t: Tables):
    dets, gts = _poses(t)
    g = gts.select("image", F.col("gt_idx").alias("det_order"), F.struct("kpts", "area", "left", "top", "right", "bottom").alias("g"))
    d = dets.select("image", "det_order", F.struct("kpts").alias("d")).join(g, ["image", "det_order"])
    return d.select("image", F.col("det_order").alias("det_idx"), fixed(V.keypoint_similarity(F.col("d"), F.col("g")), 6).alias("oks"))


POINT_COCO = "WITH RECURSIVE " + BOXES + "," + THR + f""",
ranges AS (SELECT * FROM (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)) v(area_range, lo, hi)),
one AS (SELECT *, (w * h)::DOUBLE AS area FROM boxes WHERE cls = 0),
g AS (SELECT *, 0 AS crowd, row_number() OVER (PARTITION BY frame ORDER BY det_idx) AS j FROM one),
p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) AS rank FROM one),
sig AS (SELECT unnest({V.KEYPOINT_SIGMAS}) AS s, unnest(range(0, 17)) AS i),
pairs AS (SELECT p.frame, p.cls, p.rank, any_value(p.score) AS score, any_value(p.det_idx) AS det_idx, any_value(p.area) AS area, g.j,
    avg(exp(-(pow(p."left" + p.w * i / 17.0::DOUBLE + p.qty % 5 * 2 - g."left" - g.w * i / 17.0::DOUBLE, 2) + pow(p.top + p.h * i / 17.0::DOUBLE - g.top - g.h * i / 17.0::DOUBLE, 2))
      / (2 * pow(2 * s, 2) * (g.area + 2.220446049250313e-16)))) AS oks
  FROM p JOIN g ON p.frame = g.frame, sig WHERE (i + g.qty) % 3 > 0 AND p.rank <= 20 GROUP BY p.frame, p.cls, p.rank, g.j),
cand AS (SELECT frame, cls, rank, any_value(score) AS score, any_value(det_idx) AS det_idx, any_value(area) AS area, list(oks ORDER BY j) AS ious
  FROM pairs GROUP BY frame, cls, rank),
gl AS (SELECT frame, cls, list({{'j': j, 'area': area, 'crowd': crowd}} ORDER BY j) AS gs FROM g GROUP BY ALL)""" + STEPS


@query("evl3_keypoint_ap", POINT_COCO + " SELECT " + ", ".join(
    f"coalesce(round(avg({v}) FILTER (area_range = '{a}'{x}) * 1000000) / 1000000, -1.0) AS {n}" for n, v, a, x in [
        ("AP", "ap", "all", ""), ("AP50", "ap", "all", " AND thr_no = 0"), ("AP75", "ap", "all", " AND thr_no = 5"),
        ("AR_max", "recall_100", "all", ""), ("AR_1", "recall_1", "all", ""), ("AR_10", "recall_10", "all", ""),
        ("AP_medium", "ap", "medium", ""), ("AP_large", "ap", "large", ""),
        ("AR_medium", "recall_100", "medium", ""), ("AR_large", "recall_100", "large", "")]) + " FROM cells")
def evl3(t: Tables):
    dets, gts = _poses(t)
    areas = {k: v for k, v in V.AREAS.items() if k != "small"}
    row = V.summary_row(V.coco_ap(dets, gts, V.keypoint_similarity, 20, areas), 20, small=False)
    return row.select(*[fixed(F.col(c), 6).alias(c) for c in row.columns])


# runs and comparisons ------------------------------------------------------------------

RUNS = """runs AS (SELECT 'd' || (s_suppkey % 3) AS dir, 'm' || s_suppkey AS tag, ['bbox','segm','kpts','obb'][s_nationkey % 4 + 1] AS kind,
  (s_suppkey * 37 % 1000) / 1000.0::DOUBLE AS main, CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE s_suppkey % 50 + 0.5 END::DOUBLE AS fps FROM supplier)"""


def runs(t: Tables):
    s, k = t.read("supplier"), F.col("s_suppkey")
    return s.select(F.concat(F.lit("d"), k % 3).alias("dir"), F.concat(F.lit("m"), k).alias("tag"),
                    F.element_at(F.array(*[F.lit(v) for v in ("bbox", "segm", "kpts", "obb")]), F.col("s_nationkey") % 4 + 1).alias("kind"),
                    (k * 37 % 1000 / 1000.0).alias("main"), F.when(k % 9 == 0, 0.0).otherwise(k % 50 + 0.5).alias("fps"))


@query("evl9_run_comparison", RUNS + """,
b AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY kind ORDER BY dir, tag) = 1)
SELECT r.kind, r.dir, r.tag, b.tag AS base_tag, round((r.main - b.main) * 100 * 10000) / 10000 AS delta,
  round(CASE WHEN b.fps > 0 THEN r.fps / b.fps ELSE 0 END * 10000) / 10000 AS speed
FROM runs r JOIN b USING (kind) WHERE NOT (r.dir = b.dir AND r.tag = b.tag)""")
def evl9(t: Tables):
    return V.compare_runs(runs(t)).withColumn("delta", fixed(F.col("delta"))).withColumn("speed", fixed(F.col("speed")))


@query("jn13_base_run", RUNS + """
SELECT kind, dir, tag, first_value(dir || '/' || tag) OVER (PARTITION BY kind ORDER BY dir, tag) AS base FROM runs""")
def jn13(t: Tables):
    r = runs(t)
    base = r.groupBy("kind").agg(F.min(F.struct("dir", "tag")).alias("b"))
    return r.join(base, "kind").select("kind", "dir", "tag", F.concat_ws("/", "b.dir", "b.tag").alias("base"))


@query("evl10_comparison_scale", """
SELECT p_type AS metric, p_partkey, round(p_retailprice / max(p_retailprice) OVER (PARTITION BY p_type) * 10000) / 10000 AS share FROM part""")
def evl10(t: Tables):
    v = t.read("part").select(F.col("p_type").alias("metric"), "p_partkey", F.col("p_retailprice").alias("value"))
    return V.comparison_scale(v).select("metric", "p_partkey", fixed(F.col("share")).alias("share"))


@query("evl11_per_class_pivot", """
SELECT p_brand AS cls, max(p_retailprice) FILTER (p_type = 'ECONOMY') AS "ECONOMY", max(p_retailprice) FILTER (p_type = 'LARGE') AS "LARGE",
  max(p_retailprice) FILTER (p_type = 'MEDIUM') AS "MEDIUM", max(p_retailprice) FILTER (p_type = 'PROMO') AS "PROMO",
  max(p_retailprice) FILTER (p_type = 'SMALL') AS "SMALL", max(p_retailprice) FILTER (p_type = 'STANDARD') AS "STANDARD"
FROM part GROUP BY p_brand""")
def evl11(t: Tables):
    rows = t.read("part").groupBy(F.col("p_brand").alias("cls"), F.col("p_type").alias("tag")).agg(F.max("p_retailprice").alias("ap50"))
    return V.per_class_table(rows, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


@query("evl12_class_list_check", """
SELECT n_nationkey AS ord, n_name AS label, CASE WHEN n_nationkey % 6 = 5 THEN 'other' ELSE n_name END AS category FROM nation
WHERE n_nationkey % 6 = 5 AND n_nationkey < 20
UNION ALL SELECT n_nationkey, n_name, NULL FROM nation WHERE n_nationkey >= 20
UNION ALL SELECT n_nationkey + 100, NULL, CASE WHEN n_nationkey % 6 = 5 THEN 'other' ELSE n_name END FROM nation WHERE n_nationkey >= 20""")
def evl12(t: Tables):
    n = t.read("nation")
    labels = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    cats = n.select(F.when(F.col("n_nationkey") < 20, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 100).alias("ord"), F.when(
        F.col("n_nationkey") % 6 == 5, "other").otherwise(F.col("n_name")).alias("name"))
    return V.class_list_check(labels, cats)


@query("prj10_category_mapping", "SELECT CAST(n_nationkey AS INT) AS cls, CAST(n_nationkey + 1 AS INT) AS category FROM nation")
def prj10(t: Tables):
    return V.category_mapping(t.read("nation").select((F.col("n_nationkey") + 1).alias("id")))


@query("agg15_metrics_merge", """
SELECT s_nationkey AS run, CAST(sum(f) AS BIGINT) AS processed_frames, sum(e) AS elapsed_seconds, round(sum(f) / sum(e) * 10000) / 10000 AS avg_fps,
  round(sum(p * f) / sum(f) * 10000) / 10000 AS preprocess FROM (
  SELECT s_nationkey, s_suppkey % 40 + 10 AS f, s_suppkey % 7 + 0.5 AS e, s_suppkey % 5 + 0.25 AS p FROM supplier) GROUP BY s_nationkey""")
def agg15(t: Tables):
    k = F.col("s_suppkey")
    parts = t.read("supplier").select(F.col("s_nationkey").alias("run"), (k % 40 + 10).alias("processed_frames"),
                                      (k % 7 + 0.5).alias("elapsed_seconds"), (k % 5 + 0.25).alias("preprocess"), F.lit(1.0).alias("inference"))
    m = RP.merge_run_metrics(parts)
    return m.select("run", "processed_frames", "elapsed_seconds", fixed(F.col("avg_fps")).alias("avg_fps"), fixed(F.col("preprocess")).alias("preprocess"))


@query("agg14_recent_average", """
SELECT event_type, round(avg(value) * 10000) / 10000 AS average, count(*) AS n FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY event_type""")
def agg14(t: Tables):
    out = RP.recent_average(t.read("events"), ["event_type"], ["ts", "event_id"], "value")
    return out.withColumn("average", fixed(F.col("average")))


@query("agg16_coverage", """
SELECT count(*) AS exported, count(*) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS evaluated,
  count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) AS images_evaluated,
  (SELECT count(*) FROM documents) AS images_total FROM labels""")
def agg16(t: Tables):
    images = t.read("documents").select(F.when(F.col("lang") == "en", F.col("doc_id")).otherwise(-1 - F.col("doc_id")).alias("image_id"))
    return RP.coverage(t.read("labels").select(F.col("doc_id").alias("image_id")), images)


@query("jn8_known_images", BOXES + " SELECT frame, det_idx FROM boxes WHERE frame IN (SELECT o_custkey FROM orders)")
def jn8(t: Tables):
    known = t.read("orders").select(F.col("o_custkey").alias("frame"))
    return t.boxes.join(known, "frame", "left_semi").select("frame", "det_idx")


@query("snk6_per_class_csv", """
SELECT n_nationkey AS category_id, n_name AS name, n_nationkey / 50.0::DOUBLE AS "AP", n_regionkey / 5.0::DOUBLE AS "AP50" FROM nation""")
def snk6(t: Tables):
    path = scratch_path(t.spark, "per-class")
    rows = t.read("nation").select(F.col("n_nationkey").alias("category_id"), F.col("n_name").alias("name"),
                                   (F.col("n_nationkey") / 50.0).alias("AP"), (F.col("n_regionkey") / 5.0).alias("AP50"))
    rows.write.option("header", True).csv(path)
    return t.spark.read.option("header", True).schema("category_id int, name string, AP double, AP50 double").csv(path)


@query("snk8_markdown_rows", RUNS + """
SELECT kind, dir, tag, '| ' || dir || ' | ' || tag || ' | ' || format('{:.1f}', round(main * 1000) / 10) || ' |' AS line FROM runs""")
def snk8(t: Tables):
    return RP.markdown_rows(runs(t), [F.col("dir"), F.col("tag"), percent_text(F.col("main"))], ["kind", "dir", "tag"])


@query("fn32_percent_text", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '-' ELSE format('{:.1f}', round(p_size / 51.0 * 1000) / 10) END AS text FROM part""")
def fn32(t: Tables):
    v = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 51.0)
    return t.read("part").select("p_partkey", percent_text(v).alias("text"))


@query("set1_concatenate_parts", BOXES + " SELECT cls, count(*) AS n, count(*) FILTER (frame % 2 = 1) AS extra FROM boxes GROUP BY cls")
def set1(t: Tables):
    b = t.boxes
    parts = b.where("frame % 2 = 0").drop("qty").unionByName(b.where("frame % 2 = 1"), allowMissingColumns=True)
    return parts.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count("qty").alias("extra"))
