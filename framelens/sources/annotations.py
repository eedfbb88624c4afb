"""Annotation readers: label text, XML and JSON files to one row per object.

Readers work on tables of ``path, line_no, value`` (text) or on paths. Broken lines are kept
with ``invalid = true`` so that reports can count them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.functions.geometry import flat_polygon, polygon_area
from framelens.plans.numbering import global_row_number
from framelens.schema import COCO, LABELME, ORIENTED

# fixed values: image suffixes and the aerial class list, in id order
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|bmp|tiff)$"
AERIAL_CLASSES = ["plane", "ship", "storage-tank", "baseball-diamond", "tennis-court", "basketball-court",
                  "ground-track-field", "harbor", "bridge", "large-vehicle", "small-vehicle", "helicopter",
                  "roundabout", "soccer-ball-field", "swimming-pool"]


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def image_listing(files: DataFrame) -> DataFrame:
    """Image files (``path``) with ``index``: their position in path order, from 0."""
    return global_row_number(files.where(F.col("path").rlike(IMAGE_SUFFIX)), ["path"], "index", 0)


def read_image_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of the files of a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            .select("path", F.col("length").alias("size"), "modificationTime"))


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of label files as ``path, line_no, value``; one file is one label text, so it stays whole."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """Class list file: ``cls, label`` by line, empty lines dropped."""
    names = F.filter(F.split("value", "[\r\n]+"), lambda v: v != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(names).alias("cls", "label"))


def _fields(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda v: v != "")


def _number(fields: Column, i: int) -> Column:
    return F.get(fields, F.lit(i)).try_cast("double")


def yolo_boxes(lines: DataFrame, images: DataFrame, n_classes: int) -> DataFrame:
    """``cls cx cy w h`` lines joined to ``stem, image_id, width, height``; short lines are dropped."""
    p = _fields(F.col("value"))
    rows = lines.withColumn("_p", p).where(F.size("_p") >= 5).withColumn("stem", stem(F.col("path")))
    cls = F.get("_p", F.lit(0)).try_cast("int")
    rows = rows.join(images.select("stem", "image_id", "width", "height"), "stem")
    n = [_number(F.col("_p"), i) for i in range(1, 5)]
    w, h = n[2] * F.col("width"), n[3] * F.col("height")
    ok = F.coalesce(cls.between(0, n_classes - 1) & (w > 0) & (h > 0) & n[0].isNotNull() & n[1].isNotNull(), F.lit(False))
    return rows.select("image_id", "line_no", cls.alias("cls"), F.round(n[0] * F.col("width") - w / 2, 2).alias("x"),
                       F.round(n[1] * F.col("height") - h / 2, 2).alias("y"), F.round(w, 2).alias("w"),
                       F.round(h, 2).alias("h"), F.round(w * h, 2).alias("area"), (~ok).alias("invalid"))


def yolo_polygons(lines: DataFrame, images: DataFrame, n_classes: int) -> DataFrame:
    """``cls x1 y1 .. x4 y4`` lines to pixel polygons; area up to 1 is invalid."""
    rows = lines.withColumn("_p", _fields(F.col("value"))).where(F.size("_p") >= 9).withColumn("stem", stem(F.col("path")))
    rows = rows.join(images.select("stem", "image_id", "width", "height"), "stem")
    cls = F.get("_p", F.lit(0)).try_cast("int")
    flat = F.array(*[F.round(_number(F.col("_p"), i + 1) * F.col("width" if i % 2 == 0 else "height"), 1) for i in range(8)])
    rows = rows.select("image_id", "line_no", cls.alias("cls"), flat.alias("poly"))
    ok = F.col("cls").between(0, n_classes - 1)
    whole = ~F.exists("poly", lambda v: v.isNull())
    area = polygon_area(flat_polygon(F.col("poly")))
    return rows.withColumn("invalid", ~F.coalesce(ok & whole & (area > 1), F.lit(False)))


def aerial_polygons(lines: DataFrame, classes: Sequence[str] = AERIAL_CLASSES) -> DataFrame:
    """Label lines ``x1 .. y4 class difficult``; lines without eight numbers or a known class are skipped."""
    rows = lines.withColumn("_p", _fields(F.col("value"))).where(F.size("_p") >= 9)
    flat = F.transform(F.slice("_p", 1, 8), lambda v: v.try_cast("double"))
    flag = F.get("_p", F.lit(9))
    rows = rows.select("path", "line_no", flat.alias("poly"), F.get("_p", F.lit(8)).alias("cls"),
                       F.when(flag.rlike(r"^\d+$"), flag.cast("int")).otherwise(0).alias("difficult"))
    return rows.where(~F.exists("poly", lambda v: v.isNull()) & F.col("cls").isin(*classes))


def voc_objects(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """XML texts (``value``): one row per object with its corner box; unknown names and empty boxes are invalid."""
    box = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    raw = docs.select(F.from_xml("value", f"filename string, object array<struct<name: string, bndbox: {box}>>").alias("a"))
    rows = raw.select("a.filename", F.posexplode("a.object").alias("obj_no", "o"))
    x, y = F.col("o.bndbox.xmin"), F.col("o.bndbox.ymin")
    w, h = F.col("o.bndbox.xmax") - x, F.col("o.bndbox.ymax") - y
    known = F.array(*[F.lit(n) for n in names])
    cls = (F.array_position(known, F.trim("o.name")) - 1).cast("int")
    return rows.select("filename", "obj_no", cls.alias("cls"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"),
                       F.round(w, 2).alias("w"), F.round(h, 2).alias("h"),
                       (~F.coalesce((cls >= 0) & (w > 0) & (h > 0), F.lit(False))).alias("invalid"))


def read_voc(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Annotation files, one image each."""
    return voc_objects(spark.read.text(path, wholetext=True), names)


def labelme_objects(docs: DataFrame, classes: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Polygon files (``path`` + fields) to objects and the class list.

    Two-point rectangles become four-point polygons. Without a list, classes are numbered
    by first appearance in path order.
    """
    rows = docs.select("path", "imageWidth", "imageHeight", F.posexplode("shapes").alias("shape_no", "s"))
    pts = F.col("s.points")
    rect = (F.coalesce(F.col("s.shape_type"), F.lit("polygon")) == "rectangle") & (F.size(pts) == 2)

    def corner(i: int, j: int) -> Column:
        return F.array(F.get(F.get(pts, F.lit(i)), F.lit(0)), F.get(F.get(pts, F.lit(j)), F.lit(1)))
    poly = F.when(rect, F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).when(F.size(pts) >= 3, pts)
    rows = rows.select("path", "shape_no", F.nullif(F.col("s.label"), F.lit("")).alias("label"), F.flatten(poly).alias("poly"))
    area = polygon_area(flat_polygon(F.col("poly")))
    if classes is None:
        first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("path", "shape_no")).alias("at"))
        listed = global_row_number(first.select("label", "at.path", "at.shape_no"), ["path", "shape_no"], "category_id").select(
            "label", "category_id")
    else:
        spark = docs.sparkSession
        listed = spark.createDataFrame([(n, i + 1) for i, n in enumerate(classes)], "label string, category_id long")
    rows = rows.join(listed, "label", "left").withColumn("area", F.round(area, 2))
    return rows.withColumn("invalid", ~F.coalesce(F.col("category_id").isNotNull() & (F.col("area") > 1), F.lit(False))), listed


def read_labelme(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELME).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Images, annotations and categories of an annotation file, or a folder of them. Use ``require_rows`` before scoring.

    Categories that several files list in common are one row.
    """
    doc = spark.read.schema(COCO).option("multiLine", True).json(path)
    parts = {part: doc.select(F.inline(part)) for part in ("images", "annotations", "categories")}
    return {**parts, "categories": parts["categories"].distinct()}


def read_oriented(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Oriented truth lines as ``patch`` rows and as objects ``image, gt_idx, cls, difficult, poly`` for the scorer."""
    rows = spark.read.schema(ORIENTED).json(path).where("patch is not null")
    objects = rows.select(F.col("patch").alias("image"), F.posexplode("objects").alias("gt_idx", "_o"))
    return rows.select("patch"), objects.select(
        "image", "gt_idx", "_o.cls", F.coalesce("_o.difficult", F.lit(0)).alias("difficult"), flat_polygon(F.col("_o.poly")).alias("poly"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The table itself; an error when it is empty."""
    if df.isEmpty():
        raise ValueError(f"annotation file has no {what}")
    return df


def image_id_of(files: Column) -> Column:
    """Number of an image named by digits, else null (look it up by base name)."""
    return F.when(stem(files).rlike(r"^\d+$"), stem(files).cast("long"))


def resolve_image_ids(rows: DataFrame, images: DataFrame, file: str = "file") -> DataFrame:
    """Add ``image_id``: from a numeric name, else by base name; unknown names are an error."""
    base = F.regexp_extract(F.col(file), r"([^/]*)$", 1)
    known = images.select(F.regexp_extract("file_name", r"([^/]*)$", 1).alias("_base"), F.col("id").alias("_id"))
    found = rows.withColumn("_base", base).join(known, "_base", "left")
    value = F.coalesce(image_id_of(F.col(file)), F.col("_id"), F.raise_error(
        F.concat(F.lit("image not in annotations: "), F.col(file))).cast("long"))
    return found.withColumn("image_id", value).drop("_base", "_id")
