"""JSON, verdict and display-text helpers as Column builders."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted verdicts and the words looked for in plain-text verdicts
VERDICTS = ("true", "false", "uncertain")
FALSE_ALARM_WORD = "误报"
DEFECT_WORD = "缺陷"

_REPLY = "struct<verdict: string, reason: string, confidence: double>"


def is_json_object(text: Column) -> Column:
    """Whether the text parses as a JSON object."""
    parsed = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def json_string(text: Column, key: str) -> Column:
    """String member of a JSON object; null for other types."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{key}", "string")


def extract_verdict(reply: Column) -> Column:
    """Struct (ok, verdict, reason, confidence) from a free-text reply.

    Takes the text from the first ``{`` to the last ``}``; anything but a known verdict is not ok.
    """
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(is_json_object(body), body), _REPLY)
    ok = F.coalesce(parsed["verdict"].isin(*VERDICTS), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, parsed["verdict"]).alias("verdict"),
                    F.when(ok, F.coalesce(parsed["reason"], F.lit(""))).alias("reason"),
                    F.when(ok, F.coalesce(parsed["confidence"], F.lit(0.0))).alias("confidence"))


def classify_verdict(text: Column) -> Column:
    """Class of a stored verdict: its JSON verdict, else by keyword, else text or unparsed."""
    member = F.try_variant_get(F.when(is_json_object(text), F.try_parse_json(text)), "$.verdict", "variant")
    found = F.when(F.schema_of_variant(member) == "STRING", F.get_json_object(text, "$.verdict"))
    return (F.when(found.isNotNull(), found)
            .when(text.contains(FALSE_ALARM_WORD), "false_positive")
            .when(text.contains(DEFECT_WORD), "real_defect")
            .when(F.coalesce(F.length(text), F.lit(0)) > 0, "text")
            .otherwise("unparsed"))


def seconds_text(seconds: Column) -> Column:
    return F.format_string("%ds", F.bround(seconds, 0).cast("long"))


def speed_text(px_per_s: Column, px_per_meter: float) -> Column:
    if px_per_meter > 0:
        return F.format_string("%.1fkm/h", px_per_s / px_per_meter * 3.6)
    return F.format_string("%dpx/s", F.bround(px_per_s, 0).cast("long"))


def percent_text(value: Column) -> Column:
    """Share times 100 with one decimal, ``-`` when missing."""
    return F.when(value.isNotNull(), F.format_string("%.1f", F.round(value * 1000) / 10)).otherwise("-")


def event_type(body: Column, default: str) -> Column:
    """``rule_type``, else ``event``, else the default; empty strings do not count."""
    return F.coalesce(F.nullif(F.get_json_object(body, "$.rule_type"), F.lit("")),
                      F.nullif(F.get_json_object(body, "$.event"), F.lit("")), F.lit(default))


def matches_type(body: Column, wanted: str) -> Column:
    """Whether an event has the type, as event name or as type of a rule event."""
    if not wanted:
        return F.lit(True)
    event = F.get_json_object(body, "$.event")
    rule = F.get_json_object(body, "$.rule_type")
    return F.coalesce((event == wanted) | ((event == "rule_events") & (rule == wanted)), F.lit(False))


_DETAIL = ("struct<events: array<struct<type: string, rule: string, detail: string>>, "
           "total: string, count: string, classes: array<struct<class: string, count: string>>>")


def event_detail(body: Column) -> Column:
    """Short text of an event body: its rule events, its class counts or its count."""
    b = F.from_json(body, _DETAIL)
    rules = F.array_join(F.transform(b["events"], lambda e: F.concat(
        F.coalesce(e["type"], F.lit("")),
        F.when(e["rule"] != "", F.concat(F.lit("@"), e["rule"])).otherwise(""),
        F.when(e["detail"] != "", F.concat(F.lit("("), e["detail"], F.lit(")"))).otherwise(""))), "、")
    classes = F.array_join(F.transform(b["classes"], lambda c: F.concat(
        F.lit("cls"), c["class"], F.lit("×"), c["count"])), " ")
    return (F.when(F.coalesce(F.size(b["events"]), F.lit(0)) > 0, rules)
            .when(b["total"].isNotNull() & b["classes"].isNotNull(), classes)
            .when(b["count"].isNotNull(), F.concat(F.lit("count="), b["count"]))
            .otherwise(""))
