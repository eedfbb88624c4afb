"""Dataset preparation: id normalisation, checks, tiling, pairing, diffs and batches."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions.geometry import Box, box_polygon, point
from framelens.functions.polygons import with_clip
from framelens.operators.evaluation import category_mapping
from framelens.plans.numbering import global_row_number
from framelens.plans.spread import spread

# fixed value: space kept free on the target
SPARE_BYTES = 1 << 30


def coco_tables(objects: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid objects as annotations with ids 1..N in file order, and how many were invalid."""
    good = objects.where("not invalid")
    numbered = global_row_number(good, ["image_id", "line_no"], "id")
    ann = numbered.select("id", "image_id", (F.col("cls") + 1).alias("category_id"),
                          F.array("x", "y", "w", "h").alias("bbox"), "area", F.lit(0).alias("iscrowd"))
    return ann, objects.agg(F.count_if("invalid").alias("invalid_boxes"))


def normalise_categories(annotations: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category ids made 1..N (contiguous ones stay, the official 80 are renumbered)."""
    mapping = category_mapping(categories).select(F.col("category").alias("category_id"), (F.col("cls") + 1).alias("_new"))

    def renumber(df: DataFrame, column: str) -> DataFrame:
        key = mapping.withColumnRenamed("category_id", column)
        return df.join(key, column).withColumn(column, F.col("_new")).drop("_new")
    return renumber(annotations, "category_id"), renumber(categories, "id")


def category_distribution(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations per category, zero included."""
    counts = annotations.groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return categories.join(counts, "id", "left").select("id", "name", F.coalesce("_n", F.lit(0)).alias("count"))


def unlabelled(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select("image_id"), "image_id", "left_anti")


def check_report(images: DataFrame, annotations: DataFrame, invalid: DataFrame, examples: int = 10) -> DataFrame:
    """One row: images, annotations, unlabelled images with the first names, invalid boxes."""
    missing = unlabelled(images, annotations)
    first = missing.orderBy("image_id").limit(examples).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("image_id", "file_name"))), lambda s: s["file_name"]).alias("e"))
    return images.agg(F.count(F.lit(1)).alias("images")).select(
        "images", annotations.agg(F.count(F.lit(1))).scalar().alias("annotations"),
        missing.agg(F.count(F.lit(1))).scalar().alias("unlabeled_images"), first.scalar().alias("unlabeled_examples"),
        invalid.scalar().alias("invalid_boxes"))


def export_lines(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """One JSON line per image with its objects (the oriented truth form), written in parallel."""
    objs = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(
        "id", "category_id", "bbox"))).alias("objects"))
    rows = images.join(objs, "image_id", "left")
    empty = F.array().cast(objs.schema["objects"].dataType)
    return rows.select("image_id", F.to_json(F.struct(
        F.col("file_name").alias("patch"), "width", "height", F.coalesce("objects", empty).alias("objects"))).alias("value"))


def coco_documents(images: DataFrame, annotations: DataFrame, categories: DataFrame, per_file: int = 1000) -> DataFrame:
    """COCO annotation documents as ``shard, value``: each holds the images of one id range, their objects and all categories.

    ``images``: image_id, file_name, width, height; ``annotations``: as of ``coco_tables``; ``categories``: id, name. Each
    document stands alone and has ``per_file`` images at most, so no task ever builds the whole set. Images
    without objects stay; objects of unknown images go with no document.
    """
    objs = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(
        "id", "image_id", "category_id", "bbox", "area", "iscrowd"))).alias("_objects"))
    rows = images.join(objs, "image_id", "left").withColumn(
        "_objects", F.coalesce("_objects", F.array().cast(objs.schema["_objects"].dataType)))
    image = F.struct(F.col("image_id").alias("id"), "file_name", "width", "height")
    shards = rows.groupBy(F.floor(F.col("image_id") / per_file).cast("long").alias("shard")).agg(
        F.array_sort(F.collect_list(F.struct(image.alias("i"), F.col("_objects").alias("o")))).alias("_all"))
    names = categories.agg(F.array_sort(F.collect_list(F.struct("id", "name")))).scalar()
    doc = F.struct(F.transform("_all", lambda x: x["i"]).alias("images"),
                   F.flatten(F.transform("_all", lambda x: x["o"])).alias("annotations"), names.alias("categories"))
    return shards.select("shard", F.to_json(doc).alias("value"))


def write_coco(documents: DataFrame, path: str) -> None:
    """One file per document, so that each file is a whole annotation file; ``read_coco`` reads the folder."""
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)


def oriented_lines(patches: DataFrame, objects: DataFrame) -> DataFrame:
    """Oriented truth: ``patch, value`` with one JSON line per patch, empty ones included.

    ``objects``: patch, gt_idx, cls (its name), difficult, poly (eight numbers); they keep the order of ``gt_idx``.
    """
    objs = objects.groupBy("patch").agg(F.array_sort(F.collect_list(F.struct("gt_idx", "poly", "cls", "difficult"))).alias("_objects"))
    listed = F.transform("_objects", lambda o: o.dropFields("gt_idx"))
    rows = patches.select("patch").distinct().join(objs, "patch", "left")
    return rows.select("patch", F.to_json(F.struct("patch", F.coalesce(
        listed, F.array().cast("array<struct<poly: array<double>, cls: string, difficult: int>>")).alias("objects"))).alias("value"))


def tile_origins(images: DataFrame, size: int, gap: int) -> DataFrame:
    """Tiles of every image: steps of ``size - gap`` and a last tile flush with the edge."""
    step = size - gap

    def origins(extent: str):
        last = F.greatest(F.col(extent) - size, F.lit(0)).cast("int")
        grid = F.sequence(F.lit(0), last, F.lit(step))
        flush = F.element_at(grid, -1) + size < F.col(extent)
        return F.when(flush, F.array_append(grid, last)).otherwise(grid)
    rows = images.withColumn("x0", F.explode(origins("width")))
    return rows.withColumn("y0", F.explode(origins("height"))).select("image_id", "x0", "y0")


def clip_to_tiles(objects: DataFrame, tiles: DataFrame, size: int, gap: int, keep: float = 0.5) -> DataFrame:
    """Four-corner objects (``image_id, obj_no, poly`` flat) cut to the tiles that hold enough of their area.

    Tiles meet objects by image and grid cell: a tile names the cells it covers, an object those of the cells of its
    bounds that lie within the image's tiles, so an image with very many tiles does not pair all of both. Only the
    corners of an object travel. A convex object too wide, too high or too large for any tile to hold ``keep`` of it goes before.
    """
    cell = size
    # four corners, written out: plain arithmetic stays in generated code
    xs, ys = [F.get("poly", F.lit(i)) for i in (0, 2, 4, 6)], [F.get("poly", F.lit(i)) for i in (1, 3, 5, 7)]
    twice = sum((xs[i] * ys[(i + 1) % 4] - xs[(i + 1) % 4] * ys[i] for i in range(4)), F.lit(0.0))
    bounds = {"l": F.least(*xs), "t": F.least(*ys), "r": F.greatest(*xs), "b": F.greatest(*ys)}
    turns = [(xs[(i + 1) % 4] - xs[i]) * (ys[(i + 2) % 4] - ys[(i + 1) % 4]) - (ys[(i + 1) % 4] - ys[i]) * (
        xs[(i + 2) % 4] - xs[(i + 1) % 4]) for i in range(4)]
    convex = (F.least(*turns) > 0) | (F.greatest(*turns) < 0)
    # a strip of width s holds at most 1 - (1 - s / w)^2 of a convex shape of width w; a little room for rounding
    room = size / (1 - math.sqrt(1 - min(keep, 1.0))) * 1.001 if keep > 0 else math.inf
    hopeless = convex & ((bounds["r"] - bounds["l"] > room) | (bounds["b"] - bounds["t"] > room))
    if keep > 0:
        hopeless = hopeless | (convex & (F.abs(twice) / 2 > size * size / keep * 1.001))
    o = objects.select("image_id", "obj_no", "poly").where((F.abs(twice) / 2 > 0) & ~F.coalesce(hopeless, F.lit(False)))

    def cells(df: DataFrame, x1, x2, y1, y2) -> DataFrame:
        df = df.withColumn("cx", F.explode(F.sequence(F.floor(x1 / cell), F.floor(x2 / cell))))
        return df.withColumn("cy", F.explode(F.sequence(F.floor(y1 / cell), F.floor(y2 / cell))))
    # the part of each image that has tiles: cells outside hold none
    extent = tiles.groupBy("image_id").agg(F.min("x0").alias("_l"), F.min("y0").alias("_t"), (F.max("x0") + size).alias("_r"),
                                           (F.max("y0") + size).alias("_b"))
    met = o.join(extent, "image_id").where((bounds["l"] < F.col("_r")) & (bounds["r"] > F.col("_l")) & (
        bounds["t"] < F.col("_b")) & (bounds["b"] > F.col("_t")))
    oc = cells(met, F.greatest(bounds["l"], "_l"), F.least(bounds["r"], "_r"), F.greatest(bounds["t"], "_t"),
               F.least(bounds["b"], "_b")).select("image_id", "cx", "cy", "obj_no", "poly")
    tc = cells(tiles, F.col("x0"), F.col("x0") + size - 1, F.col("y0"), F.col("y0") + size - 1)
    # both sides are as large as the dataset: shuffled by cell, never broadcast
    cell_keys = ["image_id", "cx", "cy"]
    pairs = spread(oc, *cell_keys).join(spread(tc, *cell_keys).hint("shuffle_hash"), cell_keys)
    pairs = pairs.withColumns(bounds)
    meets = (F.col("l") < F.col("x0") + size) & (F.col("r") > F.col("x0")) & (F.col("t") < F.col("y0") + size) & (F.col("b") > F.col("y0"))
    # of the shared cells only the first counts, so no pair comes twice
    own = (F.col("cx") == F.floor(F.greatest("l", "x0") / cell)) & (F.col("cy") == F.floor(F.greatest("t", "y0") / cell))
    tile = box_polygon(Box(F.col("x0"), F.col("y0"), F.col("x0") + size, F.col("y0") + size))
    rows = pairs.where(meets & own).select(
        "image_id", "obj_no", "x0", "y0", (F.abs(twice) / 2).alias("full"),
        F.array(*[point(x, y) for x, y in zip(xs, ys)]).alias("pts"), tile.alias("tile"))
    cut = with_clip(rows, "pts", "tile", "cut", "inside").where(
        (F.size("cut") >= 3) & (F.col("inside") > 0) & (F.col("inside") / F.col("full") >= keep))
    local = F.transform("cut", lambda p: F.struct((p["x"] - F.col("x0")).alias("x"), (p["y"] - F.col("y0")).alias("y")))
    return cut.select("image_id", "obj_no", "x0", "y0", "inside", local.alias("poly"))


def pair_files(images: DataFrame, labels: DataFrame, first: int | None = None) -> DataFrame:
    """Images and labels of the same folder and stem, the first ``first`` by name if asked."""
    pairs = images.join(labels, ["dir", "stem"])
    return pairs if first is None else pairs.orderBy("stem", "dir").limit(first)


def class_names(categories: DataFrame) -> DataFrame:
    return categories.orderBy("id").select("id", "name")


def manifest_diff(manifest: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (``path, size``) that are missing on the target or differ in size."""
    return manifest.join(cached.select("path", "size"), ["path", "size"], "left_anti")


def manifest_summary(manifest: DataFrame, cached: DataFrame, free_bytes: int) -> DataFrame:
    """One row: files and bytes to send, files there, and whether they fit with 1 GiB to spare."""
    need = manifest_diff(manifest, cached).agg(F.count(F.lit(1)).alias("need"), F.coalesce(F.sum("size"), F.lit(0)).alias("need_bytes"))
    total = manifest.agg(F.count(F.lit(1))).scalar()
    return need.select("need", "need_bytes", (total - F.col("need")).alias("have"),
                       (F.lit(free_bytes) >= F.col("need_bytes") + SPARE_BYTES).alias("fits"))


def assign_batches(files: DataFrame, size: int, order: str = "path") -> DataFrame:
    """Consecutive batches of ``size`` files in path order."""
    numbered = global_row_number(files, [order], "_n", 0)
    return numbered.withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")
