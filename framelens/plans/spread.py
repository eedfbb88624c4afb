"""Even spreading of rows before CPU-heavy per-key work."""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into the session's full number of shuffle partitions.

    Later grouping by these keys needs no second shuffle. The number is given explicitly
    because adaptive coalescing goes by bytes and would leave folds over small arrays, or
    Python stages, on a few cores.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
