"""Schemas of the tables and lines the operators exchange."""
from __future__ import annotations

SCHEMA_VERSION = 1

_SUB = "struct<cls: int, score: double, label: string>"
_DET = f"struct<bbox: array<int>, score: double, cls: int, label: string, track_id: int, sub: {_SUB}>"
_POSE = ("struct<bbox: array<int>, box: array<int>, score: double, cls: int, label: string, "
         "track_id: int, kpts: array<array<double>>>")
_OBB = "struct<box: array<double>, score: double, cls: int, label: string, track_id: int>"
_SEG = ("struct<bbox: array<int>, box: array<int>, score: double, cls: int, label: string, "
        "track_id: int, mask: int, rle: array<int>>")
_FACE = "struct<bbox: array<int>, score: double, kpts: array<array<double>>>"
_ACTION = "struct<track_id: int, action: int, score: double>"

# both dialects: `frame, source, type` and `file, index`
FRAME = (f"schema_version int, frame long, index long, file string, width int, height int, "
         f"source string, type string, dets array<{_DET}>, poses array<{_POSE}>, obbs array<{_OBB}>, "
         f"segs array<{_SEG}>, depth struct<roi: array<int>, range: array<double>>, "
         f"faces array<{_FACE}>, actions array<{_ACTION}>")

EVENT_LINE = ("id long, recv_ts long, body string, kind string, event_id long, source string, "
              "verdict string, confidence double, ts long, reason string")

RULE = ("id string, type string, line string, region string, classes string, direction string, "
        "ref_point string, dwell_seconds double, absence_seconds double, seconds double, "
        "min_count int, fall_seconds double, fall_aspect double, speed_limit double, "
        "px_per_meter double, speed_seconds double, llm_hint string")

COCO = ("images array<struct<id: long, file_name: string, width: int, height: int>>, "
        "annotations array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, "
        "area: double, iscrowd: int>>, categories array<struct<id: int, name: string>>")

ORIENTED = "patch string, objects array<struct<poly: array<double>, cls: string, difficult: int>>"

LABELME = ("imagePath string, imageWidth int, imageHeight int, shapes array<struct<label: string, "
           "shape_type: string, points: array<array<double>>>>")

SUMMARY = ("kind string, AP double, AP50 double, AP75 double, AP_small double, AP_medium double, "
           "AP_large double, AR_max double, AR_20 double, mAP50 double, mAP50_95 double, "
           "AP50_per_class map<string, double>")

# one top-level key (the engine name) over the numbers
METRICS = ("map<string, struct<pipeline: struct<processed_frames: long, elapsed_seconds: double, "
           "avg_fps: double>, stage_avg_ms: struct<preprocess: double, inference: double>>>")
