"""Band joins of streams: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_band_join(a: DataFrame, b: DataFrame, a_time: str, b_time: str, delta: str, keys: list[tuple[str, str]], late: str) -> DataFrame:
    """Pairs of two streams whose times differ by at most delta (an interval such as '3 days') and whose keys are equal.

    State is dropped once the watermark, `late` behind the newest row, has passed the band. Column names must differ.
    """
    left, right = a.withWatermark(a_time, late), b.withWatermark(b_time, late)
    on = F.expr(f"{a_time} >= {b_time} - interval {delta} and {a_time} <= {b_time} + interval {delta}")
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    return left.join(right, on)
