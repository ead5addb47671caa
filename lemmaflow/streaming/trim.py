"""Running summaries with trimming over a stream: one state per key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "max double, min double, sum double, count bigint, mean double, sos double"


def fold(state: tuple | None, x: float, least: int) -> tuple:
    """The summary (max, min, sum, count, mean, sos) after one more value, trimmed by the summary so far."""
    if state is None:
        return (x, x, x, 1, x, 0.0)
    mx, mn, total, n, mean, sos = state
    width = 3 * (sos / (n - 1)) ** 0.5 if n > 1 else 0.0
    if n >= least and (x > mean + width or x < mean - width):
        x = mean
    step = x - mean
    n, mean = n + 1, mean + step / (n + 1)
    return (max(mx, x), min(mn, x), total + x, n, mean, sos + step * (x - mean))


def trimmed_summaries(stream: DataFrame, key: str, time: str, value: str, least: int = 3) -> DataFrame:
    """``(key, STATE...)`` after each batch that has rows of the key, for update or append-as-update sinks.

    Values are folded in the order of ``time`` within a batch; the order between batches is that of arrival. State
    is six numbers a key.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()
    if stream.schema[time].dataType.simpleString() == "timestamp_ntz":
        stream = stream.withColumn(time, F.col(time).cast("timestamp"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s: Any = state.get if state.exists else None
        rows = pd.concat(list(frames)).dropna(subset=[value]).sort_values(time, kind="stable")
        for x in rows[value].astype(float):
            s = fold(s, x, least)
        if s is not None:
            state.update(tuple(s))
            yield pd.DataFrame([(k[0], *s)], columns=[key, "max", "min", "sum", "count", "mean", "sos"])

    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
