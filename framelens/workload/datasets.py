"""Annotation and dataset queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from framelens.operators import datasets as DS
from framelens.session import scratch_path
from framelens.sources import annotations as A
from framelens.sources import runs as RU
from framelens.workload.detections import BOXES
from framelens.workload.registry import query
from framelens.workload.views import Tables, fixed

IMAGES = """images AS (SELECT p_partkey AS image_id, 'im' || p_partkey AS stem, 1000 + p_size * 40 AS width, 800 + p_partkey % 900 AS height FROM part)"""


def images(t: Tables):
    p = t.read("part")
    return p.select(F.col("p_partkey").alias("image_id"), F.concat(F.lit("im"), "p_partkey").alias("stem"),
                    F.concat(F.lit("im"), "p_partkey", F.lit(".jpg")).alias("file_name"),
                    (1000 + F.col("p_size") * 40).alias("width"), (800 + F.col("p_partkey") % 900).alias("height"))


YOLO = IMAGES + """,
lbl AS (SELECT l_partkey AS image_id, l_orderkey * 8 + l_linenumber AS line_no, l_suppkey % 5 AS cls, l_suppkey % 9 AS bad,
  l_quantity / 60.0 AS cx, l_tax * 10 + 0.1 AS cy, (l_linenumber - 1) / 10.0 AS w, l_discount * 4 AS h FROM lineitem)"""


def label_lines(t: Tables):
    """Label files: one line per order line, some with bad numbers or too few fields."""
    li = t.read("lineitem")
    line = F.concat_ws(" ", F.when(F.col("l_suppkey") % 9 == 1, "x").otherwise((F.col("l_suppkey") % 5).cast("string")),
                       F.col("l_quantity") / 60.0, F.col("l_tax") * 10 + 0.1, (F.col("l_linenumber") - 1) / 10.0,
                       F.when(F.col("l_suppkey") % 9 != 2, (F.col("l_discount") * 4).cast("string")))
    return li.select(F.concat(F.lit("labels/im"), "l_partkey", F.lit(".txt")).alias("path"),
                     (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), line.alias("value"))


@query("src7_yolo_labels", YOLO + """
SELECT image_id, line_no, cls, invalid, CASE WHEN NOT invalid THEN round((cx * width - w * width / 2) * 10) / 10 END AS x FROM (
  SELECT *, bad = 1 OR cls > 3 OR w <= 0 OR h <= 0 AS invalid FROM lbl JOIN images USING (image_id) WHERE bad <> 2)""".replace(
    "SELECT image_id, line_no, cls,", "SELECT image_id, line_no, CASE WHEN bad = 1 THEN NULL ELSE CAST(cls AS INT) END AS cls,"))
def src7(t: Tables):
    rows = A.yolo_boxes(label_lines(t), images(t), 4)
    return rows.select("image_id", "line_no", "cls", "invalid", F.when(~F.col("invalid"), fixed(F.col("x"), 1)).alias("x"))


@query("dst1_coco_tables", YOLO + """
SELECT count(*) AS annotations, count(DISTINCT image_id) AS images, max(n) AS last_id FROM (
  SELECT *, row_number() OVER (ORDER BY image_id, line_no) AS n FROM lbl JOIN images USING (image_id) WHERE bad NOT IN (1, 2) AND cls <= 3 AND w > 0 AND h > 0)""")
def dst1(t: Tables):
    ann, _ = DS.coco_tables(A.yolo_boxes(label_lines(t), images(t), 4), images(t))
    return ann.agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("image_id").alias("images"), F.max("id").alias("last_id"))


@query("src10_yolo_polygons", IMAGES + """
SELECT image_id, line_no, invalid, CASE WHEN NOT invalid THEN round(a * width * 10) / 10 END AS x1 FROM (
  SELECT l_partkey AS image_id, l_orderkey * 8 + l_linenumber AS line_no, l_discount AS a, l_suppkey % 5 > 3 OR l_linenumber = 1 AS invalid FROM lineitem) JOIN images USING (image_id)""")
def src10(t: Tables):
    li, a, s = t.read("lineitem"), F.col("l_discount"), (F.col("l_linenumber") - 1) / 20.0
    line = F.concat_ws(" ", F.col("l_suppkey") % 5, a, a, a + s, a, a + s, a + s, a, a + s)
    lines = li.select(F.concat(F.lit("im"), "l_partkey", F.lit(".txt")).alias("path"),
                      (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), line.alias("value"))
    rows = A.yolo_polygons(lines, images(t), 4)
    return rows.select("image_id", "line_no", "invalid", F.when(~F.col("invalid"), fixed(F.get("poly", F.lit(0)), 1)).alias("x1"))


@query("src11_aerial_labels", """
SELECT l_orderkey * 8 + l_linenumber AS line_no, ['plane','ship','bridge'][l_suppkey % 4 + 1] AS cls, CASE WHEN l_linenumber < 5 THEN l_linenumber ELSE 0 END AS difficult,
  CAST(l_quantity AS DOUBLE) AS x1 FROM lineitem WHERE l_suppkey % 4 < 3 AND l_suppkey % 7 <> 0""")
def src11(t: Tables):
    li, q = t.read("lineitem"), F.col("l_quantity")
    first = F.when(F.col("l_suppkey") % 7 == 0, F.lit("gsd:0.1")).otherwise(q.cast("string"))
    line = F.concat_ws(" ", first, q, q + 9, q, q + 9, q + 9, q, q + 9,
                       F.element_at(F.array(*[F.lit(v) for v in ("plane", "ship", "bridge", "rocket")]), (F.col("l_suppkey") % 4 + 1).cast("int")),
                       F.when(F.col("l_linenumber") < 5, F.col("l_linenumber").cast("string")).otherwise("no"))
    lines = li.select(F.lit("p").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), line.alias("value"))
    return A.aerial_polygons(lines).select("line_no", "cls", "difficult", F.get("poly", F.lit(0)).alias("x1"))


@query("src11_text_lines", """
SELECT count(*) AS lines, 0::BIGINT AS objects FROM (SELECT unnest(regexp_split_to_array(text, '\\r?\\n')) AS v FROM documents)""")
def src11_text(t: Tables):
    # prose is no label text: every line must be refused
    lines = t.read("documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "value"))
    found = A.aerial_polygons(lines).agg(F.count(F.lit(1))).scalar()
    return lines.agg(F.count(F.lit(1)).alias("lines")).withColumn("objects", found)


@query("src8_voc_xml", """
SELECT 'im' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS filename, CASE l_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS cls,
  l_suppkey % 3 = 2 OR l_linenumber = 1 AS invalid, (l_linenumber - 1) * 1.0::DOUBLE AS w FROM lineitem""")
def src8(t: Tables):
    li = t.read("lineitem")
    name = F.element_at(F.array(F.lit("cat"), F.lit("dog"), F.lit("cow")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    xml = F.concat(F.lit("<annotation><filename>im"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey"), F.lit("</filename><object><name> "), name,
                   F.lit(" </name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>"), F.col("l_linenumber") + 4, F.lit("</xmax><ymax>20</ymax></bndbox></object></annotation>"))
    return A.voc_objects(li.select(xml.alias("value")), ["cat", "dog"]).select("filename", "cls", "invalid", "w")


@query("src9_labelme_polygons", """
WITH s AS (SELECT l_orderkey, ['tree','car',''][l_suppkey % 3 + 1] AS label, l_linenumber, l_quantity AS q FROM lineitem)
SELECT l_orderkey, count(*) AS shapes, count(*) FILTER (label = '' OR l_linenumber = 1) AS invalid,
  round(sum(CASE WHEN label <> '' AND l_linenumber > 1 THEN CASE WHEN l_linenumber % 2 = 0 THEN q * 2 * l_linenumber ELSE q * l_linenumber END ELSE 0 END)) AS area FROM s GROUP BY l_orderkey""")
def src9(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    zero = F.lit(0.0)
    # even lines are two-point rectangles, odd ones triangles, line 1 has too few points
    pts = (F.when(F.col("l_linenumber") % 2 == 0, F.array(F.array(zero, zero), F.array(q * 2, n)))
           .when(F.col("l_linenumber") == 1, F.array(F.array(zero, zero)))
           .otherwise(F.array(F.array(zero, zero), F.array(q * 2, zero), F.array(zero, n))))
    shape = F.struct(F.element_at(F.array(F.lit("tree"), F.lit("car"), F.lit("")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("label"),
                     F.when(F.col("l_linenumber") % 2 == 0, "rectangle").otherwise("polygon").alias("shape_type"), pts.alias("points"))
    docs = t.read("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_list(shape).alias("shapes")).withColumn(
        "imageWidth", F.lit(640)).withColumn("imageHeight", F.lit(480))
    objs, _ = A.labelme_objects(docs, ["tree", "car"])
    return objs.groupBy(F.col("path").cast("long").alias("l_orderkey")).agg(
        F.count(F.lit(1)).alias("shapes"), F.count_if("invalid").alias("invalid"),
        F.round(F.sum(F.when(~F.col("invalid"), F.col("area")).otherwise(0.0))).alias("area"))


@query("src9_labels_by_first_use", """
SELECT p_type AS label, row_number() OVER (ORDER BY min(lpad(p_partkey || '', 9, '0'))) AS category_id FROM part GROUP BY p_type""")
def src9_auto(t: Tables):
    pts = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (9.0, 0.0), (0.0, 9.0))])
    docs = t.read("part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"), F.lit(9).alias("imageWidth"), F.lit(9).alias("imageHeight"),
                                 F.array(F.struct(F.col("p_type").alias("label"), F.lit("polygon").alias("shape_type"), pts.alias("points"))).alias("shapes"))
    return A.labelme_objects(docs)[1]


@query("src4_image_listing", """
SELECT url AS path, row_number() OVER (ORDER BY url, page_id) - 1 AS "index" FROM (
  SELECT page_id || '-' || url || CASE page_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.txt' END AS url, page_id FROM pages) WHERE url NOT LIKE '%.txt'""")
def src4(t: Tables):
    ext = F.element_at(F.array(F.lit(".JPG"), F.lit(".png"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    return A.image_listing(t.read("pages").select(F.concat(F.col("page_id"), F.lit("-"), "url", ext).alias("path"))).select("path", "index")


@query("src12_label_list", "SELECT CAST(n_nationkey AS INT) AS cls, n_name AS label FROM nation")
def src12(t: Tables):
    path = scratch_path(t.spark, "labels")
    t.read("nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), "\r\n\n").alias("v")).write.text(path)
    return A.read_label_list(t.spark, path)


@query("src6_coco_round_trip", IMAGES + """
SELECT n.n_nationkey AS id, n.n_name AS name, (SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS same_region FROM nation n""")
def src6(t: Tables):
    # an annotation file made of the nation table: regions are images, nations are objects and classes
    path = scratch_path(t.spark, "coco")
    n = t.read("nation")
    doc = n.agg(
        F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("categories"),
        F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("image_id"), F.col("n_nationkey").alias("category_id"))).alias("annotations"),
        F.collect_set(F.struct(F.col("n_regionkey").alias("id"), F.lit("f").alias("file_name"))).alias("images"))
    doc.write.json(path)
    c = A.read_coco(t.spark, path)
    per = c["annotations"].groupBy("image_id").agg(F.count(F.lit(1)).alias("same_region"))
    return (A.require_rows(c["categories"], "categories").join(c["annotations"].select(F.col("category_id").alias("id"), "image_id"), "id")
            .join(per, "image_id").select("id", "name", "same_region"))


RUN_SQL = """f AS (SELECT s_suppkey AS k, 'd' || (s_suppkey % 3) AS dir, CASE WHEN s_suppkey % 10 = 0 THEN 'conf' ELSE 'm' END || s_suppkey AS tag FROM supplier)"""


@query("src14_run_summaries", RUN_SQL + """
SELECT dir, tag, CASE WHEN k % 5 = 1 THEN 'obb' ELSE 'bbox' END AS kind, CASE WHEN k % 4 = 0 THEN 0.0 ELSE k + 0.5 END::DOUBLE AS fps
FROM f WHERE tag NOT LIKE 'conf%' AND k % 5 NOT IN (2, 3)""")
def src14(t: Tables):
    k = F.col("s_suppkey")
    s = t.read("supplier").withColumn("dir", F.concat(F.lit("d"), k % 3)).withColumn(
        "tag", F.concat(F.when(k % 10 == 0, "conf").otherwise("m"), k))
    value = (F.when(k % 5 == 1, '{"mAP50_95":0.4}').when(k % 5 == 2, '{"AP":0.3}').when(k % 5 == 3, "[1]").otherwise('{"kind":"bbox","AP":0.5}'))
    files = s.select("dir", F.concat(F.lit("summary_"), "tag", F.lit(".json")).alias("name"), value.alias("value"))
    metrics = s.select("dir", F.concat(F.when(k % 4 == 0, "metrics_other_").otherwise("metrics_"), "tag", F.lit(".json")).alias("name"), F.concat(
        F.when(k % 3 == 0, F.lit('{"version":"1",')).otherwise(F.lit("{")), F.lit('"engine":{"pipeline":{"avg_fps":'), k + F.lit(0.5), F.lit("}}}")).alias("value"))
    return RU.summaries(files, metrics).select("dir", "tag", "kind", "fps")


@query("prj9_image_ids", "SELECT page_id, page_id AS image_id FROM pages")
def prj9(t: Tables):
    name = F.when(F.col("page_id") % 2 == 0, F.lpad(F.col("page_id").cast("string"), 8, "0")).otherwise(F.concat(F.lit("img_"), "page_id"))
    p = t.read("pages").select("page_id", F.concat(F.lit("/data/"), name, F.lit(".jpg")).alias("file"))
    known = p.select(F.col("page_id").alias("id"), F.regexp_replace("file", "/data/", "val/").alias("file_name"))
    return A.resolve_image_ids(p, known).select("page_id", "image_id")


@query("agg9_category_distribution", """
SELECT n_nationkey AS id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS count FROM nation""")
def agg9(t: Tables):
    cats = t.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return DS.category_distribution(t.read("customer").select(F.col("c_nationkey").alias("category_id")), cats)


CHECK = """(SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) u"""


@query("agg10_check_report", f"""
SELECT (SELECT count(*) FROM documents) AS images, (SELECT count(*) FROM labels) AS annotations, (SELECT count(*) FROM {CHECK}) AS unlabeled_images,
  (SELECT string_agg('doc' || doc_id, ',' ORDER BY doc_id) FROM (SELECT * FROM {CHECK} ORDER BY doc_id LIMIT 10)) AS unlabeled_examples,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS invalid_boxes""")
def agg10(t: Tables):
    im = t.read("documents").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("doc"), "doc_id").alias("file_name"))
    lab = t.read("labels")
    bad = lab.agg(F.count_if(F.col("toxic") == 1).alias("invalid_boxes"))
    return DS.check_report(im, lab.select(F.col("doc_id").alias("image_id")), bad).withColumn(
        "unlabeled_examples", F.array_join("unlabeled_examples", ","))


@query("jn7_unlabelled_images", f"SELECT doc_id AS image_id FROM {CHECK}")
def jn7(t: Tables):
    return DS.unlabelled(t.read("documents").select(F.col("doc_id").alias("image_id")), t.read("labels").select(F.col("doc_id").alias("image_id")))


@query("snk7_export_lines", """
SELECT d.doc_id AS image_id, '{"patch":"doc' || d.doc_id || '","width":9,"height":7,"objects":[' || CASE WHEN l.doc_id IS NULL THEN '' ELSE
  '{"id":' || l.doc_id || ',"category_id":' || quality || ',"bbox":[1.0,2.0,3.0,4.0]}' END || ']}' AS value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def snk7(t: Tables):
    im = t.read("documents").select(F.col("doc_id").alias("image_id"), F.concat(F.lit("doc"), "doc_id").alias("file_name"), F.lit(9).alias("width"), F.lit(7).alias("height"))
    ann = t.read("labels").select(F.col("doc_id").alias("image_id"), F.col("doc_id").alias("id"), F.col("quality").alias("category_id"),
                                  F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)]).alias("bbox"))
    return DS.export_lines(im, ann)


@query("snk7_coco_files", YOLO + """,
ann AS (SELECT *, row_number() OVER (ORDER BY image_id, line_no) AS id FROM lbl JOIN images USING (image_id) WHERE bad NOT IN (1, 2) AND cls <= 3 AND w > 0 AND h > 0),
cats AS (SELECT * FROM (VALUES (1, 'ant'), (2, 'bee'), (3, 'cat'), (4, 'dog')) v(category_id, name))
SELECT image_id, 'im' || image_id || '.jpg' AS file_name, i.width, min(id) OVER (PARTITION BY image_id) AS first_id, max(id) OVER (PARTITION BY image_id) AS last_id, category_id, name, round((cx * i.width - w * i.width / 2) * 10) / 10 AS x, round(w * i.width * 10) / 10 AS w
FROM images i LEFT JOIN (SELECT image_id, id, CAST(cls + 1 AS INT) AS category_id, cx, w FROM ann) a USING (image_id) LEFT JOIN cats USING (category_id)""")
def snk7_coco(t: Tables):
    # written, read back and put together again; images without objects stay, and lines of one number share a range of ids
    ann, _ = DS.coco_tables(A.yolo_boxes(label_lines(t), images(t), 4), images(t))
    cats = t.spark.createDataFrame([(i + 1, n) for i, n in enumerate(("ant", "bee", "cat", "dog"))], "id int, name string")
    path = scratch_path(t.spark, "coco-files")
    DS.write_coco(DS.coco_documents(images(t), ann, cats, 100), path)
    c = A.read_coco(t.spark, path)
    objs = c["annotations"].join(c["categories"].select(F.col("id").alias("category_id"), "name"), "category_id")
    ids = c["annotations"].groupBy("image_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return c["images"].select(F.col("id").alias("image_id"), "file_name", "width").join(objs, "image_id", "left").join(ids, "image_id", "left").select(
        "image_id", "file_name", "width", "first_id", "last_id", "category_id", "name", fixed(F.get("bbox", F.lit(0)), 1).alias("x"), fixed(F.get("bbox", F.lit(2)), 1).alias("w"))


@query("snk7_oriented_lines", IMAGES + """,
o AS (SELECT l_partkey AS image_id, l_orderkey * 8 + l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, l_suppkey % 3 AS c, l_linenumber FROM lineitem WHERE l_suppkey % 5 > 0)
SELECT stem AS image, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n) - 1 AS INT) AS gt_idx, ['plane', 'ship', 'bridge'][c + 1] AS cls,
  CAST(l_linenumber % 2 AS INT) AS difficult, 4::INT AS corners, q AS x1, q + 3 AS y3 FROM o JOIN images USING (image_id)""")
def snk7_oriented(t: Tables):
    li = t.read("lineitem").where("l_suppkey % 5 > 0")
    q = F.col("l_quantity").cast("double")
    objs = li.select(F.concat(F.lit("im"), "l_partkey").alias("patch"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gt_idx"),
                     F.element_at(F.array(*[F.lit(v) for v in ("plane", "ship", "bridge")]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("cls"),
                     (F.col("l_linenumber") % 2).cast("int").alias("difficult"), F.array(q, q, q + 3, q, q + 3, q + 3, q, q + 3).alias("poly"))
    path = scratch_path(t.spark, "oriented-lines")
    DS.oriented_lines(images(t).select(F.col("stem").alias("patch")), objs).select("value").write.text(path)
    _, found = A.read_oriented(t.spark, path)
    return found.select("image", "gt_idx", "cls", "difficult", F.size("poly").alias("corners"),
                        F.col("poly")[0]["x"].alias("x1"), F.col("poly")[2]["y"].alias("y3"))


TILES = """
xs AS (SELECT image_id, unnest(list_concat(range(0, greatest(width - 1024, 0) + 1, 824), CASE WHEN (greatest(width - 1024, 0) // 824) * 824 + 1024 < width THEN [width - 1024] ELSE [] END)) AS x0 FROM images),
ys AS (SELECT image_id, unnest(list_concat(range(0, greatest(height - 1024, 0) + 1, 824), CASE WHEN (greatest(height - 1024, 0) // 824) * 824 + 1024 < height THEN [height - 1024] ELSE [] END)) AS y0 FROM images),
tiles AS (SELECT image_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0 FROM xs JOIN ys USING (image_id))"""


@query("dst3_tile_origins", IMAGES + "," + TILES + " SELECT image_id, x0, y0 FROM tiles")
def dst3(t: Tables):
    return DS.tile_origins(images(t), 1024, 200)


@query("dst4_clip_to_tiles", IMAGES + "," + TILES + """,
objs AS (SELECT l_partkey AS image_id, l_orderkey * 8 + l_linenumber AS obj_no, CAST(l_quantity AS BIGINT) * 50 AS l, l_linenumber * 150 AS t, 100 + l_suppkey * 3 AS w, 90 + l_linenumber * 10 AS h FROM lineitem)
SELECT image_id, obj_no, x0, y0, i AS inside FROM (
  SELECT *, (least(l + w, x0 + 1024) - greatest(l, x0))::DOUBLE * (least(t + h, y0 + 1024) - greatest(t, y0)) AS i FROM objs JOIN tiles USING (image_id)
  WHERE l < x0 + 1024 AND l + w > x0 AND t < y0 + 1024 AND t + h > y0) WHERE i / (w * h) >= 0.5""")
def dst4(t: Tables):
    li = t.read("lineitem")
    l, tp = F.col("l_quantity").cast("long") * 50, F.col("l_linenumber") * 150
    r, b = l + 100 + F.col("l_suppkey") * 3, tp + 90 + F.col("l_linenumber") * 10
    objs = li.select(F.col("l_partkey").alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("obj_no"),
                     F.array(*[c.cast("double") for c in (l, tp, r, tp, r, b, l, b)]).alias("poly"))
    cut = DS.clip_to_tiles(objs, DS.tile_origins(images(t), 1024, 200), 1024, 200)
    return cut.select("image_id", "obj_no", "x0", "y0", F.round("inside").alias("inside"))


@query("dst2_normalise_categories", "SELECT c_custkey AS id, c_nationkey + 1 AS category_id FROM customer")
def dst2(t: Tables):
    cats = t.read("nation").select((F.col("n_nationkey") + 1).alias("id"), "n_name")
    ann = t.read("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1).alias("category_id"))
    return DS.normalise_categories(ann, cats)[0].select("id", "category_id")


@query("dst5_pair_files", """
SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY 's' || lpad(d.doc_id || '', 6, '0') LIMIT 25""")
def dst5(t: Tables):
    key = F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    d = t.read("documents").select(F.lit("a").alias("dir"), key.alias("stem"), "doc_id")
    lab = t.read("labels").select(F.lit("a").alias("dir"), key.alias("stem"))
    return DS.pair_files(d, lab, 25).select("doc_id")


@query("dst6_class_names", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def dst6(t: Tables):
    return DS.class_names(t.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


MANIFEST = """m AS (SELECT url AS path, length(html) AS size, page_id FROM pages), c AS (SELECT path || CASE WHEN page_id % 3 = 0 THEN '~' ELSE '' END AS path, size + CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS size FROM m)"""


def manifest(t: Tables):
    m = t.read("pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size"), "page_id")
    moved = F.concat("path", F.when(F.col("page_id") % 3 == 0, "~").otherwise(""))
    return m, m.withColumn("path", moved).withColumn("size", F.col("size") + F.when(F.col("page_id") % 4 == 1, 1).otherwise(0))


@query("dst7_manifest_summary", MANIFEST + """
SELECT count(*) FILTER (c.path IS NULL) AS need, CAST(sum(m.size) FILTER (c.path IS NULL) AS BIGINT) AS need_bytes, count(*) FILTER (c.path IS NOT NULL) AS have, true AS fits
FROM m LEFT JOIN (SELECT DISTINCT * FROM c) c ON m.path = c.path AND m.size = c.size""")
def dst7(t: Tables):
    return DS.manifest_summary(*manifest(t), 1 << 34)


@query("jn9_manifest_diff", MANIFEST + " SELECT page_id FROM m WHERE (path, size) NOT IN (SELECT (path, size) FROM c)")
def jn9(t: Tables):
    return DS.manifest_diff(*manifest(t)).select("page_id")


@query("dst8_batch_assignment", "SELECT page_id, (row_number() OVER (ORDER BY lpad(page_id || '', 9, '0')) - 1) // 30 AS batch FROM pages")
def dst8(t: Tables):
    files = t.read("pages").select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("path"), "page_id")
    return DS.assign_batches(files, 30).select("page_id", "batch")
