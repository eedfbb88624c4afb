"""Ordered passes over each key with a carried state, in constant memory.

For rules whose state cannot be composed from parts (an anchor that moves, a tracker).
Rows are shuffled by key, sorted by Spark (with spill), and streamed as Arrow batches;
only the state of the current key is held. Callers first cut keys at provable resets. A slice may hold
thousands of short keys, so a step gets it whole, with a mark on the rows that begin a key.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framelens.plans.spread import spread


def ordered_pass(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str,
                 start: Callable[[], Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]]) -> DataFrame:
    """Run ``start()``'s ``step(rows, begins)`` over consecutive slices; ``begins`` marks the first row of each key.

    A step drops its state at those rows and keeps it from slice to slice. ``keys`` have no nulls.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, current = start(), None
        for batch in batches:
            if batch.empty:
                continue
            begins = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            first = tuple(batch[keys].iloc[0])
            begins[0], current = first != current, tuple(batch[keys].iloc[-1])
            out = step(batch, begins)
            if len(out):
                yield out

    return (spread(df, *keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema))
