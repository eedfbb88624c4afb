"""The registered queries, each next to the SQL that must give the same rows."""
from framelens.workload.registry import ORACLES, QUERIES
from framelens.workload import rules as _rules  # noqa: F401
from framelens.workload import detections as _detections  # noqa: F401
from framelens.workload import events as _events  # noqa: F401
from framelens.workload import evaluation as _evaluation  # noqa: F401
from framelens.workload import depth_pose as _depth_pose  # noqa: F401
from framelens.workload import datasets as _datasets  # noqa: F401
from framelens.workload import streams as _streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
