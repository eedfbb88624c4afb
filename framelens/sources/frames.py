"""Frame-result lines: reading, unifying dialects, unnesting and writing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelens.operators.filters import label_of
from framelens.schema import FRAME, SCHEMA_VERSION

BAD = "_corrupt_record"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame results, one JSON object per line; blank, broken and truncated lines are skipped."""
    rows = (spark.read.schema(f"{FRAME}, {BAD} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD).json(path))
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def parse_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same for a table or stream of text lines."""
    parsed = F.from_json(F.col(column), f"{FRAME}, {BAD} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return (lines.where(F.trim(column) != "").select(parsed.alias("_f"))
            .where(F.col(f"_f.{BAD}").isNull()).select("_f.*").drop(BAD))


def normalise(frames: DataFrame) -> DataFrame:
    """One shape for both dialects, with ``kind`` taken from the array that is present."""
    def boxed(items: Column) -> Column:
        return F.transform(items, lambda p: p.withField("bbox", F.coalesce(p["bbox"], p["box"])).dropFields("box"))

    kind = (F.when(F.col("poses").isNotNull(), "kpts").when(F.col("segs").isNotNull(), "segm")
            .otherwise("bbox"))
    task = (F.when(F.col("dets").isNotNull(), "detect").when(F.col("poses").isNotNull(), "pose")
            .when(F.col("obbs").isNotNull(), "obb").when(F.col("segs").isNotNull(), "seg").otherwise("none"))
    trimmed = F.transform(boxed(F.col("poses")), lambda p: p.withField(
        "kpts", F.transform(p["kpts"], lambda k: F.slice(k, 1, 3))))
    return frames.select(
        F.coalesce("frame", "index").alias("frame"), F.coalesce("source", "file").alias("source"),
        F.coalesce("type", task).alias("type"), kind.alias("kind"), "width", "height", "dets",
        trimmed.alias("poses"), "obbs", boxed(F.col("segs")).alias("segs"), "depth", "faces", "actions")


def unnest(frames: DataFrame, items: str = "dets") -> DataFrame:
    """One row per detection with ``det_idx`` and pixel edges; frames without any are kept."""
    rows = frames.select("frame", "source", "type", F.posexplode_outer(items).alias("det_idx", "_d"))
    x, y, w, h = [F.get(F.col("_d.bbox"), F.lit(i)) for i in range(4)]
    kept = [f for f in ("score", "cls", "label", "track_id", "sub", "kpts")
            if f in {n.name for n in rows.schema["_d"].dataType.fields}]
    return rows.select("frame", "source", "type", F.col("det_idx").cast("long").alias("det_idx"),
                       x.alias("left"), y.alias("top"), (x + w).alias("right"), (y + h).alias("bottom"),
                       *[F.col(f"_d.{f}").alias(f) for f in kept])


def finite(value: Column) -> Column:
    """NaN and infinities become 0 on output."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def _xywh(d: Column) -> Column:
    return F.array(d["left"], d["top"], d["right"] - d["left"], d["bottom"] - d["top"])


def detect_payload(frames: DataFrame, names: Sequence[str], width: int, height: int,
                   track_ids: bool = False, sub: bool = False) -> DataFrame:
    """Frame rows (``frame, source, dets``) to ``frame, value``: one payload line per frame."""
    def item(d: Column) -> Column:
        fields = [_xywh(d).alias("bbox"), finite(d["score"]).alias("score"), d["cls"].alias("cls"),
                  label_of(d["cls"], names).alias("label")]
        if track_ids:
            fields.append(d["track_id"].alias("track_id"))
        if sub:
            fields.append(F.when(d["sub"]["cls"] >= 0, F.struct(
                d["sub"]["cls"].alias("cls"), finite(d["sub"]["score"]).alias("score"),
                F.coalesce(d["sub"]["label"], F.lit("")).alias("label"))).alias("sub"))
        return F.struct(*fields)

    payload = F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "frame", F.lit(width).alias("width"),
        F.lit(height).alias("height"), "source",
        F.lit("composite_cls" if sub else "detect").alias("type"),
        F.transform("dets", item).alias("dets")))
    return frames.select("frame", payload.alias("value"))


def result_payload(frames: DataFrame) -> DataFrame:
    """Any normalised frame back to its payload line; only the arrays of its type are written.

    Poses of an action frame go without their points, and a second-stage class below 0 is left out.
    """
    def number(items: Column) -> Column:
        return F.transform(items, lambda d: d.withField("score", finite(d["score"])))

    def keypoints(items: Column) -> Column:
        return F.transform(number(items), lambda d: d.withField("kpts", F.transform(
            d["kpts"], lambda k: F.transform(k, finite))))

    kind = F.coalesce("type", F.lit("none"))

    def only(kinds: tuple[str, ...], value: Column, name: str) -> Column:
        return F.when(kind.isin(*kinds), value).alias(name)

    def staged_class(items: Column) -> Column:
        return F.transform(number(items), lambda d: d.withField("sub", F.when(d["sub"]["cls"] >= 0, F.struct(
            d["sub"]["cls"].alias("cls"), finite(d["sub"]["score"]).alias("score"),
            F.coalesce(d["sub"]["label"], F.lit("")).alias("label")))))

    # one expression for both kinds, so their types agree
    poses = F.transform(keypoints(F.col("poses")), lambda d: d.withField("kpts", F.when(kind == "pose", d["kpts"])))
    angled = F.transform(number(F.col("obbs")), lambda o: o.withField("box", F.transform(o["box"], finite)))
    return frames.select("frame", F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "frame", "width", "height",
        F.coalesce("source", F.lit("")).alias("source"), kind.alias("type"),
        only(("detect", "composite_cls"), staged_class(F.col("dets")), "dets"),
        only(("pose", "action"), poses, "poses"),
        only(("obb",), angled, "obbs"), only(("seg",), number(F.col("segs")), "segs"),
        only(("depth",), F.col("depth"), "depth"),
        only(("face",), keypoints(F.col("faces")), "faces"),
        only(("action",), number(F.col("actions")), "actions"))).alias("value"))


def review_payload(frames: DataFrame, names: Sequence[str]) -> DataFrame:
    """Compact detections for review prompts: edges, class name, score to four digits, count."""
    items = F.transform("dets", lambda d: F.struct(
        d["cls"].alias("cls_id"), label_of(d["cls"], names, "class").alias("name"),
        (F.round(d["score"] * 10000) / 10000).alias("conf"),
        F.array(d["left"], d["top"], d["right"], d["bottom"]).alias("box")))
    return frames.select("frame", F.to_json(F.struct(
        F.lit("detect").alias("type"), F.size("dets").alias("count"), items.alias("items"))).alias("value"))


#: Columns of one item of any kind, with ``part`` (its array) and ``item`` (its place there).
ITEM = {"part": "string", "item": "long", "box": "array<double>", "score": "double", "cls": "int", "label": "string",
        "track_id": "int", "kpts": "array<array<double>>", "mask": "int", "rle": "array<int>", "action": "int",
        "sub": "struct<cls: int, score: double, label: string>"}
PARTS = ("dets", "poses", "obbs", "segs", "faces", "actions")


def items(frames: DataFrame) -> DataFrame:
    """One row per item of normalised frames of any kind; fields a kind does not have are null.

    ``box`` is x, y, width, height (and the angle of an oriented box). Frames without items give no row.
    """
    def common(part: str) -> Column:
        fields = {f.name for f in frames.schema[part].dataType.elementType.fields}

        def one(d: Column, i: Column) -> Column:
            given = {"part": F.lit(part), "item": i, **{f: d[f] for f in fields if f in ITEM}}
            if "bbox" in fields:
                given["box"] = d["bbox"]
            return F.struct(*[given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in ITEM.items()])
        return F.transform(part, one)

    every = F.flatten(F.filter(F.array(*[common(p) for p in PARTS]), lambda a: a.isNotNull()))
    return frames.select("frame", "source", "type", F.inline(every))


def review_result(frames: DataFrame, names: Sequence[str]) -> DataFrame:
    """Compact review line of normalised frames of any kind: ``frame, value``.

    Boxes are edges, but x, y, width, height for masks and named fields for oriented boxes. Scores have four
    digits. A depth frame only says so; a frame without a result is ``none``.
    """
    def digits(score: Column) -> Column:
        return F.round(score * 10000) / 10000

    def edges(b: Column) -> Column:
        return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]).alias("box")

    def head(d: Column) -> list[Column]:
        return [d["cls"].alias("cls_id"), label_of(d["cls"], names, "class").alias("name"), digits(d["score"]).alias("conf")]

    def detected(d: Column) -> Column:
        second = F.when(d["sub"]["cls"] >= 0, F.struct(
            d["sub"]["cls"].alias("cls_id"), digits(d["sub"]["score"]).alias("score"),
            F.coalesce(d["sub"]["label"], F.lit("")).alias("label")))
        return F.struct(*head(d), edges(d["bbox"]), F.when(F.col("type") == "composite_cls", second).alias("sub"))

    def turned(d: Column) -> Column:
        named = [d["box"][i].cast("int").alias(n) for i, n in enumerate("xywh")]
        return F.struct(*head(d), F.struct(*named, d["box"][4].alias("angle")).alias("box"), d["track_id"].alias("track_id"))

    def line(rows: Column, *more: Column) -> Column:
        return F.to_json(F.struct("type", F.size(rows).alias("count"), rows.alias("items"), *more))

    poses = F.transform("poses", lambda d: F.struct(
        *head(d), edges(d["bbox"]), d["track_id"].alias("track_id"), d["kpts"].alias("keypoints")))
    segs = F.transform("segs", lambda d: F.struct(*head(d), d["bbox"].alias("box"), d["track_id"].alias("track_id")))
    faces = F.transform("faces", lambda d: F.struct(
        digits(d["score"]).alias("conf"), edges(d["bbox"]), d["kpts"].alias("landmarks")))
    actions = F.transform("actions", lambda a: F.struct(
        a["track_id"].alias("track_id"), a["action"].alias("action_id"), digits(a["score"]).alias("score")))
    kind = F.col("type")
    value = (F.when(kind.isin("detect", "composite_cls"), line(F.transform("dets", detected)))
             .when(kind == "pose", line(poses)).when(kind == "action", line(poses, actions.alias("actions")))
             .when(kind == "obb", line(F.transform("obbs", turned))).when(kind == "seg", line(segs))
             .when(kind == "face", line(faces))
             .when(kind == "depth", F.lit('{"type":"depth","summary":"depth map only"}'))
             .otherwise(F.lit('{"type":"none"}')))
    return frames.select("frame", value.alias("value"))


def write_frames(payloads: DataFrame, path: str, has_result: Column | None = None) -> None:
    """Write payload lines; frames without a result are left out."""
    rows = payloads if has_result is None else payloads.where(has_result)
    rows.select("value").write.mode("overwrite").text(path)
