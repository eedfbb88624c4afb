"""Rule events over tracked rows: crossings, regions, falls and speed.

Input rows: ``source, ts_ms, track_id, cls, confirmed, left, top, right, bottom``; frames:
``source, ts_ms`` with every processed frame, also those without detections.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelens.functions.geometry import Box, point_in_polygon, segments_cross, side_of_line
from framelens.plans.chunked import CHUNK, previous, running, with_chunk
from framelens.plans.sequential import ordered_pass
from framelens.session import staged

# fixed values: rule types and default thresholds
REGION_TYPES = ("intrusion", "dwell", "absence", "crowd", "abandoned")
RULE_TYPES = ("line_cross", *REGION_TYPES, "fall", "speed")
DEFAULTS = {"dwell_seconds": 10.0, "absence_seconds": 30.0, "seconds": 60.0, "min_count": 3,
            "fall_seconds": 2.0, "fall_aspect": 1.2, "speed_seconds": 1.0}
STALE_MS = 5000
CHUNK_MS = 3_600_000
MAX_RULES = 512
EVENT_COLUMNS = ["source", "ts_ms", "type", "rule_id", "track_id", "cls", "detail"]


@dataclass(frozen=True)
class Rule:
    """One compiled rule; geometry is literal and ends up inside Spark expressions."""
    id: str
    type: str
    line: tuple = ()
    region: tuple = ()
    classes: tuple = ()
    direction: str = "both"
    ref_point: str = "center"
    dwell_seconds: float = 10.0
    absence_seconds: float = 30.0
    seconds: float = 60.0
    min_count: int = 3
    fall_seconds: float = 2.0
    fall_aspect: float = 1.2
    speed_limit: float = 0.0
    px_per_meter: float = 0.0
    speed_seconds: float = 1.0
    hint: str = field(default="", compare=False)

    @property
    def key(self) -> str:
        return self.id or self.type


# RUL0 ---------------------------------------------------------------------------------

def _points(spec: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(spec, F.lit("")), r"[^0-9,;\-]", ""), "[,;]")
    values = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.coalesce(
        F.regexp_extract(p, r"^-?\d+", 0).try_cast("int"), F.lit(0)))
    return F.slice(values, 1, (F.floor(F.size(values) / 2) * 2).cast("int"))


def _classes(spec: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(spec, F.lit("")), r"[^0-9,]", ""), ",")
    return F.array_sort(F.array_distinct(F.transform(
        F.filter(parts, lambda p: p != ""), lambda p: p.cast("int"))))


def normalise_rules(rules: DataFrame, position: str) -> DataFrame:
    """Parse and check a table of rule settings; ``position`` orders it from 1.

    Missing ids become ``rule<position>``, thresholds that are not positive get their
    defaults, unknown directions fall back to ``both``. ``valid`` is false for unknown
    types, missing geometry and speed rules without a limit.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in rules.columns else F.lit("")

    def number(name: str) -> Column:
        given = F.col(name).cast("double") if name in rules.columns else F.lit(None).cast("double")
        return F.when(given > 0, given).otherwise(F.lit(float(DEFAULTS.get(name, 0.0))))

    line, region = _points(text("line")), _points(text("region"))
    zone_ok = F.size(region) >= 6
    kind = text("type")
    valid = (F.when(kind == "line_cross", F.size(line) == 4)
             .when(kind.isin(*REGION_TYPES), zone_ok)
             .when(kind == "fall", (text("region") == "") | zone_ok)
             .when(kind == "speed", (number("speed_limit") > 0) & ((text("region") == "") | zone_ok))
             .otherwise(False))
    auto = F.concat(F.lit("rule"), F.col(position).cast("string"))
    return rules.select(
        F.col(position).alias("position"),
        F.when(text("id") == "", auto).otherwise(text("id")).alias("id"), kind.alias("type"),
        line.alias("line"), region.alias("region"), _classes(text("classes")).alias("classes"),
        F.when(text("direction").isin("A2B", "B2A"), text("direction"))
        .otherwise("both").alias("direction"),
        F.when(text("ref_point") == "bottom", "bottom").otherwise("center").alias("ref_point"),
        *[number(n).alias(n) for n in ("dwell_seconds", "absence_seconds", "seconds", "fall_seconds",
                                       "fall_aspect", "speed_limit", "px_per_meter", "speed_seconds")],
        number("min_count").cast("int").alias("min_count"),
        text("llm_hint").alias("hint"), valid.alias("valid"))


def _pairs(values: Sequence[int]) -> tuple:
    return tuple(zip(values[::2], values[1::2]))


def compile_rules(rules: DataFrame, position: str) -> list[Rule]:
    """Valid rules as literals. Rules are settings: more than ``MAX_RULES`` is an error."""
    rows = (normalise_rules(rules, position).where("valid").orderBy("position")
            .limit(MAX_RULES + 1).collect())
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for row in rows:
        values = row.asDict()
        values = {k: v for k, v in values.items() if k not in ("position", "valid")}
        out.append(Rule(**{**values, "line": _pairs(values["line"]),
                           "region": _pairs(values["region"]), "classes": tuple(values["classes"])}))
    return out


def legacy_rules(options: Mapping[str, object]) -> list[Rule]:
    """Unnamed rules from flat settings, used only when no rule list is given."""
    from framelens.functions.geometry import parse_points
    classes = tuple(int(c) for c in re.findall(r"\d+", str(options.get("event_classes", ""))))
    line = tuple(parse_points(str(options.get("event_line", ""))))
    region = tuple(parse_points(str(options.get("event_region", ""))))
    out = []
    if options.get("event_line_cross") and len(line) == 2:
        out.append(Rule("", "line_cross", line=line, classes=classes))
    if len(region) >= 3:
        for kind in ("intrusion", "dwell", "absence"):
            if options.get(f"event_{kind}"):
                seconds = {f"{kind}_seconds": s for s in [options.get(f"event_{kind}_seconds")]
                           if s and float(s) > 0}
                out.append(Rule("", kind, region=region, classes=classes, **seconds))
    return out


# shared preparation -------------------------------------------------------------------

def _class_ok(rule: Rule) -> Column:
    return F.col("cls").isin(*rule.classes) if rule.classes else F.lit(True)


def _centre2() -> tuple[Column, Column]:
    """Doubled centre: stays integer, so geometry is exact."""
    return F.col("left") + F.col("right"), F.col("top") + F.col("bottom")


def _doubled(points: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(2 * x, 2 * y) for x, y in points]


def _in_region(rule: Rule) -> Column:
    return point_in_polygon(*_centre2(), _doubled(rule.region)) if rule.region else F.lit(True)


def timeline(tracked: DataFrame, frames: DataFrame | None, chunk_ms: int) -> DataFrame:
    """Every frame of every source once, with the time of the frame before it."""
    seen = tracked.select("source", "ts_ms")
    allf = seen if frames is None else seen.unionByName(frames.select("source", "ts_ms"))
    return previous(with_chunk(allf.distinct(), "ts_ms", chunk_ms),
                    ["source"], ["ts_ms"], {"prev_frame_ts": "ts_ms"})


def presence(tracked: DataFrame, frames: DataFrame | None = None, stale_ms: int = STALE_MS,
             chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Tracked rows with their previous sighting and whether that sighting had gone stale.

    A track is forgotten when some frame was processed more than ``stale_ms`` after its last
    sighting, so the frame before the current one decides. Rows of any class and state count.
    """
    line = timeline(tracked, frames, chunk_ms).select("source", CHUNK, "ts_ms", "prev_frame_ts")
    rows = with_chunk(tracked.where("track_id > 0"), "ts_ms", chunk_ms)
    rows = previous(rows, ["source", "track_id"], ["ts_ms"],
                    {"prev_ts": "ts_ms", "prev_left": "left", "prev_top": "top",
                     "prev_right": "right", "prev_bottom": "bottom"})
    rows = rows.join(line, ["source", CHUNK, "ts_ms"])
    gone = F.col("prev_ts").isNull() | (F.col("prev_frame_ts") - F.col("prev_ts") > stale_ms)
    return rows.withColumn("is_start", gone)


def lives(rows: DataFrame) -> DataFrame:
    """Add ``life``: the time at which the current stretch of sightings began."""
    return running(rows, ["source", "track_id"], ["ts_ms"],
                   {"life": ("max", F.when(F.col("is_start"), F.col("ts_ms")))})


def _per_rule(rows: DataFrame, rules: Sequence[Rule], fields) -> DataFrame:
    """One output row per (row, rule that accepts its class), in a single pass."""
    items = [F.when(_class_ok(r), F.struct(F.lit(r.key).alias("rule_id"), F.lit(r.type).alias("type"),
                                           F.lit(i).alias("rule_no"),
                                           *[c.alias(n) for n, c in fields(r).items()]))
             for i, r in rules]
    return rows.select("*", F.inline(F.array_compact(F.array(*items))))


def rules_by_rows(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every tracked row with each rule that accepts its class, in one pass over the rows."""
    return _per_rule(rows, list(enumerate(rules)), lambda r: {})


def _pick(rules: Sequence[Rule], *types: str) -> list[tuple[int, Rule]]:
    return [(i, r) for i, r in enumerate(rules) if r.type in types]


def _limit_ms(rules: list[tuple[int, Rule]], attribute: str) -> Column:
    """Per-rule threshold as a small CASE expression."""
    return reduce(lambda acc, ir: acc.when(F.col("rule_no") == ir[0],
                                           F.lit(int(round(getattr(ir[1], attribute) * 1000)))),
                  rules, F.when(F.lit(False), F.lit(0)))


def _seconds_text(ms: Column) -> Column:
    return F.format_string("%ds", F.bround(ms / 1000.0, 0).cast("long"))


def _events(df: DataFrame, detail: Column, track: Column | None = None,
            cls: Column | None = None) -> DataFrame:
    return df.select("source", "ts_ms", "type", "rule_id",
                     (F.col("track_id") if track is None else track).cast("long").alias("track_id"),
                     (F.col("cls") if cls is None else cls).cast("int").alias("cls"),
                     detail.alias("detail"))


# RUL1 / AGG8 ---------------------------------------------------------------------------

def line_crossings(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All crossings of all lines; ``reported`` tells whether the direction raises an event."""
    def fields(r: Rule) -> dict[str, Column]:
        a, b = _doubled(r.line)
        x0, x1 = F.col("prev_left") + F.col("prev_right"), F.col("left") + F.col("right")
        if r.ref_point == "bottom":
            y0, y1 = F.col("prev_bottom") * 2, F.col("bottom") * 2
        else:
            y0, y1 = F.col("prev_top") + F.col("prev_bottom"), F.col("top") + F.col("bottom")
        s0, s1 = side_of_line(a, b, x0, y0), side_of_line(a, b, x1, y1)
        hit = ((s0 != 0) & (s1 != 0) & ((s0 > 0) != (s1 > 0))
               & segments_cross((x0, y0), (x1, y1), a, b))
        wanted = F.lit(True) if r.direction == "both" else ((s1 > 0) == F.lit(r.direction == "A2B"))
        return {"hit": hit, "a2b": s1 > 0, "reported": wanted}

    current = rows.where(F.col("confirmed") & ~F.col("is_start"))
    out = _per_rule(current, _pick(rules, "line_cross"), fields).where("hit")
    return out.withColumn("detail", F.when(F.col("a2b"), "A->B").otherwise("B->A"))


def crossing_counts(crossings: DataFrame, *by: str) -> DataFrame:
    """Crossings per rule in both directions, whatever the reported direction."""
    return crossings.groupBy(*by, "rule_id").agg(
        F.count_if("a2b").alias("cross_ab"), F.count_if(~F.col("a2b")).alias("cross_ba"))


# RUL4 / RUL5 ---------------------------------------------------------------------------

def _frame_counts(rows: DataFrame, line: DataFrame, rules: list[tuple[int, Rule]],
                  confirmed_only: bool) -> DataFrame:
    base = rows.where("confirmed") if confirmed_only else rows
    inside = _per_rule(base, rules, lambda r: {"inside": _in_region(r)}).where("inside")
    counts = inside.groupBy("source", CHUNK, "ts_ms", "rule_no").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r.key).alias("rule_id"),
                                F.lit(r.type).alias("type")) for i, r in rules])
    every = line.select("source", CHUNK, "ts_ms", F.inline(listed))
    return (every.join(counts, ["source", CHUNK, "ts_ms", "rule_no"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0))))


def crowd_counts(rows: DataFrame, line: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Confirmed objects inside each crowd region, for every frame."""
    return _frame_counts(rows, line, _pick(rules, "crowd"), True)


def crowd_events(rows: DataFrame, line: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    picked = _pick(rules, "crowd")
    least = reduce(lambda acc, ir: acc.when(F.col("rule_no") == ir[0], F.lit(ir[1].min_count)),
                   picked, F.when(F.lit(False), F.lit(0)))
    counts = crowd_counts(rows, line, rules).withColumn("full", F.col("n") >= least)
    rising = previous(counts, ["rule_no", "source"], ["ts_ms"], {"was_full": "full"}).where(
        F.col("full") & ~F.coalesce("was_full", F.lit(False)))
    return _events(rising, F.format_string("%d人", "n"), F.lit(0), F.lit(-1))


def absence_counts(rows: DataFrame, line: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Objects inside each absence region, for every frame."""
    return _frame_counts(rows, line, _pick(rules, "absence"), False)


def absence_rows(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows inside each absence region."""
    return _per_rule(rows, _pick(rules, "absence"), lambda r: {"inside": _in_region(r)}).where("inside")


def absence_events(rows: DataFrame, line: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Region empty for the limit after it was occupied; once until it is occupied again."""
    picked = _pick(rules, "absence")
    frames = absence_counts(rows, line, rules).withColumn("occupied", F.col("n") > 0)
    keys = ["rule_no", "source"]
    frames = previous(frames, keys, ["ts_ms"], {"was_occupied": "occupied", "before": "ts_ms"})
    frames = running(frames, keys, ["ts_ms"], {
        "empty_from": ("max", F.when(~F.col("occupied") & F.col("was_occupied"), F.col("ts_ms")))})
    limit, stay = _limit_ms(picked, "absence_seconds"), F.col("ts_ms") - F.col("empty_from")
    fired = frames.where(~F.col("occupied") & (stay >= limit)
                         & (F.col("before") - F.col("empty_from") < limit))
    return fired.select("source", "ts_ms", "type", "rule_id", "rule_no", CHUNK,
                        _seconds_text(stay).alias("detail"))


# RUL2 / RUL3 ---------------------------------------------------------------------------

def region_rows(rows: DataFrame, rules: Sequence[Rule], picked: list[tuple[int, Rule]],
                absences: DataFrame | None) -> DataFrame:
    """Rows of each region rule with ``inside`` and ``was_inside`` (last class-accepted row).

    ``was_inside`` is forgotten with the track, and when an absence rule of the same
    geometry fires in between. A rule listed after that absence rule sees it in the same
    frame, a rule listed before it only from the next frame on.
    """
    keys = ["rule_no", "source", "track_id"]
    items = _per_rule(rows, picked, lambda r: {"inside": _in_region(r)})
    items = previous(items, keys, ["ts_ms"], {"ok_ts": "ts_ms", "ok_in": "inside"})
    held = F.col("ok_in") & (F.col("ok_ts") >= F.col("life"))
    links = [(i, a) for i, r in picked for a, q in _pick(rules, "absence")
             if r.region == q.region]
    if absences is None or not links:
        return items.withColumn("was_inside", F.coalesce(held, F.lit(False)))
    affected = F.array(*[F.struct(F.lit(a).alias("from_no"), F.lit(i).alias("rule_no"),
                                  F.lit(2 if i <= a else 0).alias("_turn")) for i, a in links])
    resets = (absences.select("source", CHUNK, "ts_ms", F.col("rule_no").alias("_fired"),
                              F.inline(affected))
              .where("from_no = _fired").drop("_fired", "from_no"))
    marked = items.withColumn("_turn", F.lit(1)).unionByName(
        resets.withColumn("_reset", F.lit(True)), allowMissingColumns=True)
    # reset marks sort before (turn 0) or after (turn 2) the rows of their frame
    when = F.col("ts_ms") * 3 + F.col("_turn")
    marked = running(marked.withColumn("_at", when), ["rule_no", "source"], ["_at"],
                     {"last_reset": ("max", F.when(F.col("_reset"), F.col("_at")))})
    cleared = F.coalesce(F.col("last_reset") > F.col("ok_ts") * 3 + 1, F.lit(False))
    return (marked.where("_reset is null")
            .withColumn("was_inside", F.coalesce(held, F.lit(False)) & ~cleared)
            .drop("_turn", "_reset", "_at", "last_reset"))


def _sustained(items: DataFrame, keys: list[str], state: Column, was: Column, before: str,
               limit: Column) -> DataFrame:
    """Rows at which a state has lasted for ``limit`` for the first time since it began."""
    items = items.withColumn("_on", state).withColumn("_was", was)
    items = running(items, keys, ["ts_ms"], {
        "since": ("max", F.when(F.col("_on") & ~F.col("_was"), F.col("ts_ms")))})
    return items.where(F.col("_on") & F.col("_was") & (F.col("ts_ms") - F.col("since") >= limit)
                       & (F.col(before) - F.col("since") < limit))


def intrusion_events(items: DataFrame) -> DataFrame:
    return _events(items.where((F.col("type") == "intrusion") & F.col("confirmed")
                               & F.col("inside") & ~F.col("was_inside")), F.lit(""))


def dwell_events(items: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    fired = _sustained(items.where(F.col("type") == "dwell"), ["rule_no", "source", "track_id"],
                       F.col("inside"), F.col("was_inside"), "ok_ts",
                       _limit_ms(_pick(rules, "dwell"), "dwell_seconds"))
    return _events(fired, _seconds_text(F.col("ts_ms") - F.col("since")))


# RUL6 ----------------------------------------------------------------------------------

def abandoned_events(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Objects that stay within reach of an anchor point for the limit, once per anchor."""
    picked = _pick(rules, "abandoned")
    items = _per_rule(rows.where("confirmed"), picked, lambda r: {
        "inside": _in_region(r), "limit": F.lit(int(round(r.seconds * 1000)))}).where("inside")
    x2, y2 = _centre2()
    slim = items.select(
        "source", "ts_ms", "type", "rule_id", "rule_no", "track_id", "life", "cls", "limit",
        (x2 / 2.0).alias("x"), (y2 / 2.0).alias("y"),
        F.greatest(F.lit(8.0), F.sqrt((F.pow(F.col("right") - F.col("left"), 2)
                                       + F.pow(F.col("bottom") - F.col("top"), 2))) * 0.1).alias("reach"))

    def start():
        ax = ay = since = fired = None  # of the anchor; without one ``ax`` is None

        def step(rows: pd.DataFrame, begins: np.ndarray) -> pd.DataFrame:
            nonlocal ax, ay, since, fired
            hits, still = [], []
            columns = [rows[c].tolist() for c in ("ts_ms", "x", "y", "reach", "limit")]
            for i, (begin, ts, x, y, reach, limit) in enumerate(zip(begins.tolist(), *columns)):
                if begin or ax is None or math.sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) > reach:
                    ax, ay, since, fired = x, y, ts, False
                elif not fired and ts - since >= limit:
                    fired = True
                    hits.append(i)
                    still.append(ts - since)
            out = rows.iloc[hits].copy()
            out["still"] = still
            return out[["source", "ts_ms", "type", "rule_id", "track_id", "cls", "still"]]
        return step

    kinds = dict(slim.dtypes)
    fired = ordered_pass(slim, ["rule_no", "source", "track_id", "life"], ["ts_ms"],
                         f"source {kinds['source']}, ts_ms long, type string, rule_id string, "
                         f"track_id {kinds['track_id']}, cls {kinds['cls']}, still long", start)
    return _events(fired, _seconds_text(F.col("still")))


# RUL7 ----------------------------------------------------------------------------------

def fall_events(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    picked, keys = _pick(rules, "fall"), ["rule_no", "source", "track_id"]
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    items = _per_rule(rows.where("confirmed"), picked, lambda r: {
        "lying": (h > 1) & (w >= h * F.lit(r.fall_aspect)) & _in_region(r)})
    items = previous(items, keys, ["ts_ms"], {"ok_ts": "ts_ms", "was": "lying"})
    was = F.coalesce(F.col("was") & (F.col("ok_ts") >= F.col("life")), F.lit(False))
    fired = _sustained(items, keys, F.col("lying"), was, "ok_ts", _limit_ms(picked, "fall_seconds"))
    return _events(fired, _seconds_text(F.col("ts_ms") - F.col("since")))


# RUL8 ----------------------------------------------------------------------------------

def speed_rows(rows: DataFrame, rules: Sequence[Rule], keep: float = 0.6) -> DataFrame:
    """Smoothed speed in px/s per rule and row.

    The smoothing is linear, so the rows of a track life are cut by their number into blocks,
    over which a weight falls by ``1e-50``. A block is a running sum of ``v / keep**place``; what
    enters it comes from the sums of the seven blocks before, beyond which a double holds nothing.
    """
    if not 0 <= keep < 1:
        raise ValueError("keep must be at least 0 and below 1")
    picked = _pick(rules, "speed")
    dt = F.col("ts_ms") - F.col("prev_ts")
    step = F.sqrt((F.pow(F.col("left") + F.col("right") - F.col("prev_left") - F.col("prev_right"), 2)
                   + F.pow(F.col("top") + F.col("bottom") - F.col("prev_top") - F.col("prev_bottom"), 2))) / 2
    items = _per_rule(rows.where(F.col("confirmed") & ~F.col("is_start") & (dt > 1)), picked,
                      lambda r: {"inside": _in_region(r)}).withColumn("v", step * 1000.0 / dt)
    keys = ["rule_no", "source", "track_id", "life"]
    size = math.ceil(-50 * math.log(10) / math.log(keep)) if keep else 1
    items = running(items.select(*keys, CHUNK, "ts_ms", "v", "inside", "cls", "type", "rule_id"),
                    keys, ["ts_ms"], {"_n": ("sum", F.lit(1))})
    place = (F.col("_n") - 1) % size
    # the first value of a life enters whole
    share = F.when(F.col("_n") == 1, F.col("v")).otherwise(F.col("v") * (1 - keep))
    items = items.select("*", F.floor((F.col("_n") - 1) / size).alias("_block"),
                         F.pow(F.lit(keep), place).alias("_w")).withColumn("_x", share / F.col("_w"))
    sums = items.groupBy(*keys, "_block").agg(F.sum("_x").alias("_sum"))
    by_block = W.partitionBy(*keys).orderBy("_block")
    entry = reduce(lambda a, b: a + b, [
        F.coalesce(F.lag("_sum", k).over(by_block), F.lit(0.0)) * (keep ** (size - 1) * keep ** (size * (k - 1)))
        for k in range(1, 8)])
    inner = W.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    ema = F.col("_w") * (F.col("_part") + keep * F.col("_entry"))
    return (items.withColumn("_part", F.sum("_x").over(inner))
            .join(sums.select(*keys, "_block", entry.alias("_entry")), [*keys, "_block"])
            .select(*keys, CHUNK, "ts_ms", "v", "inside", "cls", "type", "rule_id", ema.alias("ema")))


def speed_events(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    picked, keys = _pick(rules, "speed"), ["rule_no", "source", "track_id"]
    items = speed_rows(rows, rules)

    def setting(name: str) -> Column:
        return reduce(lambda acc, ir: acc.when(F.col("rule_no") == ir[0], F.lit(float(getattr(ir[1], name)))),
                      picked, F.when(F.lit(False), F.lit(0.0)))

    items = items.withColumn("over", F.col("inside") & (F.col("ema") >= setting("speed_limit")))
    items = previous(items, keys, ["ts_ms"], {"ok_ts": "ts_ms", "was": "over"})
    was = F.coalesce(F.col("was") & (F.col("ok_ts") >= F.col("life")), F.lit(False))
    fired = _sustained(items, keys, F.col("over"), was, "ok_ts", _limit_ms(picked, "speed_seconds"))
    metre = setting("px_per_meter")
    return _events(fired, F.when(metre > 0, F.format_string("%.1fkm/h", F.col("ema") / metre * 3.6))
                   .otherwise(F.format_string("%.0fpx/s", F.bround("ema", 0))))


# all rules -----------------------------------------------------------------------------

def rule_events(tracked: DataFrame, rules: Sequence[Rule], frames: DataFrame | None = None,
                stale_ms: int = STALE_MS, chunk_ms: int = CHUNK_MS, rows: DataFrame | None = None) -> DataFrame:
    """Events of all rules, one row each (SET2). ``rows``: the ``lives`` of ``presence``, where they are staged already."""
    types = {r.type for r in rules}
    if rows is None:
        rows = presence(tracked, frames, stale_ms, chunk_ms)
        if types - {"line_cross"}:
            rows = staged(lives(rows))
    parts: list[DataFrame] = []
    absences = None
    if types & {"crowd", "absence"}:
        line = staged(timeline(tracked, frames, chunk_ms))
        if "crowd" in types:
            parts.append(crowd_events(rows, line, rules))
        if "absence" in types:
            absences = staged(absence_events(rows, line, rules))
            parts.append(_events(absences, F.col("detail"), F.lit(0), F.lit(-1)))
    if "line_cross" in types:
        parts.append(_events(line_crossings(rows, rules).where("reported"), F.col("detail")))
    regions = _pick(rules, "intrusion", "dwell")
    if regions:
        items = region_rows(rows, rules, regions, absences)
        if "intrusion" in types:
            parts.append(intrusion_events(items))
        if "dwell" in types:
            parts.append(dwell_events(items, rules))
    for kind, build in (("abandoned", abandoned_events), ("fall", fall_events), ("speed", speed_events)):
        if kind in types:
            parts.append(build(rows, rules))
    return reduce(DataFrame.unionByName, parts)


# RUL9 - RUL12 --------------------------------------------------------------------------

def rule_stats(tracked: DataFrame, rules: Sequence[Rule], frames: DataFrame | None = None,
               stale_ms: int = STALE_MS, chunk_ms: int = CHUNK_MS,
               carried: DataFrame | None = None) -> DataFrame:
    """Per source and rule: crossings so far, objects in crowd regions now, anchored objects now.

    ``carried`` (id, type, cross_ab, cross_ba) restores totals of an earlier run (RUL11).
    """
    rows = staged(lives(presence(tracked, frames, stale_ms, chunk_ms)))
    line = staged(timeline(tracked, frames, chunk_ms))
    listed = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r.key).alias("id"),
                                F.lit(r.type).alias("type"), F.lit(bool(r.id)).alias("named"))
                       for i, r in enumerate(rules)])
    latest = line.groupBy("source").agg(
        F.max_by(F.struct("ts_ms", "prev_frame_ts"), "ts_ms").alias("_last"))
    out = latest.select("source", F.inline(listed))
    if any(r.type == "line_cross" for r in rules):
        crossed = crossing_counts(line_crossings(rows, rules), "source").withColumnRenamed("rule_id", "id")
    else:
        crossed = out.where("false").select("source", "id", F.lit(0).alias("cross_ab"),
                                            F.lit(0).alias("cross_ba"))
    out = out.join(crossed, ["source", "id"], "left")
    if _pick(rules, "crowd"):
        now = (crowd_counts(rows, line, rules).groupBy("source", "rule_no")
               .agg(F.max_by("n", "ts_ms").alias("crowd_now")))
        out = out.join(now, ["source", "rule_no"], "left")
    else:
        out = out.withColumn("crowd_now", F.lit(0))
    picked = _pick(rules, "abandoned")
    if picked:
        absences = absence_events(rows, line, rules) if _pick(rules, "absence") else None
        items = _per_rule(rows, picked, lambda r: {"inside": _in_region(r)})
        # state at the end: the last sighting of the track, whatever its class
        seen = rows.groupBy("source", "track_id").agg(
            F.max("ts_ms").alias("seen"), F.max("life").alias("life_now"))
        ends = items.groupBy("source", "track_id", "rule_no", "life").agg(
            F.max_by("inside", "ts_ms").alias("inside"), F.max("ts_ms").alias("ok_ts"),
            F.bool_or(F.col("inside") & F.col("confirmed")).alias("anchored"))
        live = (ends.join(seen, ["source", "track_id"]).join(latest, "source")
                .where((F.col("life") == F.col("life_now")) & F.col("inside") & F.col("anchored")
                       & ((F.col("seen") == F.col("_last.ts_ms"))
                          | (F.col("_last.prev_frame_ts") - F.col("seen") <= stale_ms))))
        links = [(i, a) for i, r in picked for a, q in _pick(rules, "absence") if r.region == q.region]
        if absences is not None and links:
            pairs = F.array(*[F.struct(F.lit(a).alias("from_no"), F.lit(i).alias("rule_no"),
                                       F.lit(i <= a).alias("late")) for i, a in links])
            resets = (absences.select("source", "ts_ms", F.col("rule_no").alias("_fired"), F.inline(pairs))
                      .where("from_no = _fired").groupBy("source", "rule_no")
                      .agg(F.max(F.col("ts_ms") * 2 + F.when(F.col("late"), 1).otherwise(0)).alias("_reset")))
            live = live.join(resets, ["source", "rule_no"], "left").where(
                F.col("_reset").isNull() | (F.col("_reset") <= F.col("ok_ts") * 2))
        now = live.groupBy("source", "rule_no").agg(F.count(F.lit(1)).alias("abandoned_now"))
        out = out.join(now, ["source", "rule_no"], "left")
    else:
        out = out.withColumn("abandoned_now", F.lit(0))
    out = out.select("source", "id", "type", "named", *[
        F.coalesce(c, F.lit(0)).cast("long").alias(c)
        for c in ("cross_ab", "cross_ba", "crowd_now", "abandoned_now")])
    return carry_over(out, carried) if carried is not None else out.drop("named")


def carry_over(stats: DataFrame, carried: DataFrame) -> DataFrame:
    """Add totals of an earlier run, by rule id, or by type for unnamed rules; zeros restore nothing."""
    old = carried.where("cross_ab > 0 or cross_ba > 0").select(
        "source", F.col("id").alias("_id"), F.col("type").alias("_type"),
        F.col("cross_ab").alias("_ab"), F.col("cross_ba").alias("_ba"))
    named = old.groupBy("source", F.col("_id").alias("_key")).agg(
        F.max("_ab").alias("_ab"), F.max("_ba").alias("_ba")).withColumn("named", F.lit(True))
    by_type = old.groupBy("source", F.col("_type").alias("_key")).agg(
        F.max("_ab").alias("_ab"), F.max("_ba").alias("_ba")).withColumn("named", F.lit(False))
    key = F.when(F.col("named"), F.col("id")).otherwise(F.col("type"))
    joined = stats.withColumn("_key", key).join(named.unionByName(by_type),
                                                ["source", "_key", "named"], "left")
    return (joined.withColumn("cross_ab", F.col("cross_ab") + F.coalesce("_ab", F.lit(0)))
            .withColumn("cross_ba", F.col("cross_ba") + F.coalesce("_ba", F.lit(0)))
            .drop("_key", "_ab", "_ba", "named"))


def periodic_report(crossings: DataFrame, interval_ms: int) -> DataFrame:
    """Crossings per source, rule and report interval."""
    slot = F.floor(F.col("ts_ms") / interval_ms).cast("long") * interval_ms
    return crossing_counts(crossings.withColumn("interval_start", slot), "source", "interval_start")


def _slot(interval_ms: int) -> Column:
    return F.floor(F.col("ts_ms") / interval_ms).cast("long")


def anchored_gauge(rows: DataFrame, slots: DataFrame, rules: Sequence[Rule], interval_ms: int, stale_ms: int,
                   absences: DataFrame | None = None) -> DataFrame:
    """(source, slot, rule_no, abandoned_now): anchored objects inside at the last frame of each slot with frames.

    ``slots``: source, slot, last_ts, before_ts (the last frame and the one before it), next_slot. A track holds
    its state until it is seen again or forgotten, so its last sighting in a slot counts there and in
    the few later slots whose last frames still remember it.
    """
    picked = _pick(rules, "abandoned")
    keys = ["rule_no", "source", "track_id"]
    every = _per_rule(rows, picked, lambda r: {"inside": _in_region(r)})
    # sightings of other classes prolong the stretch without changing its state
    other = rows.select("*", F.inline(F.array(*[F.struct(F.lit(i).alias("rule_no"), _class_ok(r).alias("_ok")) for i, r in picked])))
    marked = other.where("not _ok").select("source", "track_id", "ts_ms", "life", CHUNK, "rule_no").unionByName(
        every.select("source", "track_id", "ts_ms", "life", CHUNK, "rule_no", "inside", "confirmed"), allowMissingColumns=True)
    state = running(marked, keys, ["ts_ms"], {
        "ok_state": ("max", F.when(F.col("inside").isNotNull(), F.struct("ts_ms", "inside"))),
        "anchor": ("max", F.when(F.col("inside") & F.col("confirmed"), F.col("ts_ms")))})
    held = (F.col("ok_state.inside") & (F.col("ok_state.ts_ms") >= F.col("life")) & (F.col("anchor") >= F.col("life")))
    last = state.withColumn("slot", _slot(interval_ms)).groupBy(*keys, "slot").agg(F.max_by(F.struct(
        "ts_ms", held.alias("held"), F.col("ok_state.ts_ms").alias("ok_ts")), "ts_ms").alias("_at"))
    reach = F.floor((F.col("_at.ts_ms") + stale_ms) / interval_ms).cast("long")
    spread_ = last.withColumn("slot", F.explode(F.sequence("slot", reach)))
    met = spread_.join(slots, ["source", "slot"])
    # the slot after the last one in reach may have a last frame whose predecessor is still in reach
    after = met.groupBy(*keys, "_at").agg(F.max_by("next_slot", "slot").alias("slot")).where("slot is not null")
    met = met.unionByName(after.join(slots, ["source", "slot"]).select(*met.columns))
    now = met.groupBy("source", "slot", "rule_no", "track_id", "last_ts", "before_ts").agg(F.max_by("_at", "_at.ts_ms").alias("_at"))
    live = now.where(F.col("_at.held") & ((F.col("_at.ts_ms") == F.col("last_ts"))
                                          | (F.col("before_ts") - F.col("_at.ts_ms") <= stale_ms)))
    links = [(i, a) for i, r in picked for a, q in _pick(rules, "absence") if r.region == q.region]
    if absences is not None and links:
        pairs = F.array(*[F.struct(F.lit(a).alias("from_no"), F.lit(i).alias("rule_no"), F.lit(i <= a).alias("late")) for i, a in links])
        resets = (absences.select("source", "ts_ms", F.col("rule_no").alias("_fired"), F.inline(pairs)).where("from_no = _fired")
                  .withColumn("slot", _slot(interval_ms)).groupBy("source", "rule_no", "slot")
                  .agg(F.max(F.col("ts_ms") * 2 + F.when(F.col("late"), 1).otherwise(0)).alias("_mark")))
        by_slot = slots.select("source", "slot").join(resets.select("source", "rule_no").distinct(), "source").join(
            resets, ["source", "rule_no", "slot"], "left")
        seen = by_slot.select("source", "slot", "rule_no", F.max("_mark").over(
            W.partitionBy("source", "rule_no").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)).alias("_reset"))
        live = live.join(seen, ["source", "slot", "rule_no"], "left").where(
            F.col("_reset").isNull() | (F.col("_reset") <= F.col("_at.ok_ts") * 2))
    return live.groupBy("source", "slot", "rule_no").agg(F.count(F.lit(1)).alias("abandoned_now"))


def filled_report(found: DataFrame, slots: DataFrame, rules: Sequence[Rule], interval_ms: int) -> DataFrame:
    """A row per source, rule and interval from the first to the last one: counters are 0 and gauges stay where nothing came.

    ``found`` (source, slot, rule_no, cross_ab, cross_ba, crowd_now, abandoned_now; the last two null where the
    slot has no frame) and ``slots`` (source, slot) have one row per slot, not per frame.
    """
    span = slots.groupBy("source").agg(F.min("slot").alias("_low"), F.max("slot").alias("_high"))
    listed = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(r.key).alias("rule_id"), F.lit(r.type).alias("type"))
                       for i, r in enumerate(rules)])
    every = span.select("source", F.explode(F.sequence("_low", "_high")).alias("slot")).select("*", F.inline(listed))
    back = W.partitionBy("source", "rule_no").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    rows = every.join(found, ["source", "slot", "rule_no"], "left")
    gauge = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.lit(0)).cast("long").alias(c)
    return rows.select("source", (F.col("slot") * interval_ms).alias("interval_start"), "rule_id", "type",
                       *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cross_ab", "cross_ba")],
                       gauge("crowd_now"), gauge("abandoned_now"))


def report_slots(line: DataFrame, interval_ms: int) -> DataFrame:
    """source, slot, last_ts, before_ts, next_slot of the slots with frames, from a ``timeline``."""
    ends = line.withColumn("slot", _slot(interval_ms)).groupBy("source", "slot").agg(
        F.max_by(F.struct(F.col("ts_ms").alias("last_ts"), F.col("prev_frame_ts").alias("before_ts")), "ts_ms").alias("_end"))
    return ends.select("source", "slot", "_end.*", F.lead("slot").over(W.partitionBy("source").orderBy("slot")).alias("next_slot"))


def slot_figures(rows: DataFrame, line: DataFrame, slots: DataFrame, rules: Sequence[Rule], interval_ms: int,
                 stale_ms: int = STALE_MS) -> DataFrame:
    """What each rule counted in each slot: the input of ``filled_report``."""
    blank = slots.select("source", "slot").select("*", F.explode(F.array(*[F.lit(i) for i in range(len(rules))])).alias("rule_no"))
    numbers = lambda df: df.withColumn("slot", _slot(interval_ms))
    out = blank
    if _pick(rules, "line_cross"):
        crossed = numbers(line_crossings(rows, rules)).groupBy("source", "slot", "rule_no").agg(
            F.count_if("a2b").alias("cross_ab"), F.count_if(~F.col("a2b")).alias("cross_ba"))
        out = out.join(crossed, ["source", "slot", "rule_no"], "left")
    if _pick(rules, "crowd"):
        crowd = numbers(crowd_counts(rows, line, rules)).groupBy("source", "slot", "rule_no").agg(F.max_by("n", "ts_ms").alias("crowd_now"))
        out = out.join(crowd, ["source", "slot", "rule_no"], "left")
    if _pick(rules, "abandoned"):
        absences = absence_events(rows, line, rules) if _pick(rules, "absence") else None
        out = out.join(anchored_gauge(rows, slots, rules, interval_ms, stale_ms, absences), ["source", "slot", "rule_no"], "left")
    for c in ("cross_ab", "cross_ba", "crowd_now", "abandoned_now"):
        # a slot with frames and no object has the gauge 0; slots without frames have no row here
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0))
    return out


def rule_report(tracked: DataFrame, rules: Sequence[Rule], interval_ms: int, frames: DataFrame | None = None,
                stale_ms: int = STALE_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Periodic report of all rules: crossings of each interval, and crowd and anchored objects at its end.

    Intervals run from the first to the last frame of a source; those without crossings or frames appear too.
    """
    rows = staged(lives(presence(tracked, frames, stale_ms, chunk_ms)))
    line = staged(timeline(tracked, frames, chunk_ms))
    slots = staged(report_slots(line, interval_ms))
    return filled_report(slot_figures(rows, line, slots, rules, interval_ms, stale_ms), slots, rules, interval_ms)


def with_hints(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the review hint of the rule that raised the event; empty when there is none."""
    hints = {r.key: r.hint for r in rules if r.hint}
    if not hints:
        return events.withColumn("hint", F.lit(""))
    table = F.create_map(*[F.lit(v) for pair in hints.items() for v in pair])
    return events.withColumn("hint", F.coalesce(F.element_at(table, F.col("rule_id")), F.lit("")))
