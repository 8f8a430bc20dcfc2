"""Row frames along one axis."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def along(keys: Sequence[str], axis: str, size: int | None = None) -> WindowSpec:
    """Rows of a group in the order of ``axis``, ``size`` of them around each.

    An even size reaches one row further back than forward. Without a size the order alone.
    """
    w = Window.partitionBy(*keys).orderBy(axis)
    return w if size is None else w.rowsBetween(-(size // 2), size - 1 - size // 2)


def running_median(x: Column, w: WindowSpec) -> Column:
    """Exact; rows beyond the ends and nulls are left out. The frame bounds what a task holds."""
    return F.percentile(x, F.lit(0.5)).over(w)


def running_line(y: Column, x: Column, w: WindowSpec) -> Column:
    """The value at each row of the straight line fitted to its frame; the mean where there is one point."""
    both = F.when(y.isNotNull(), x)
    slope, base = F.regr_slope(y, both).over(w), F.regr_intercept(y, both).over(w)
    return F.coalesce(base + slope * x, F.avg(y).over(w))


def islands(flag: Column, keys: Sequence[str], axis: str) -> Column:
    """A number for each run of rows with equal ``flag`` along ``axis``; unique together with the keys and the flag."""
    everything = Window.partitionBy(*keys).orderBy(axis)
    alike = Window.partitionBy(*keys, flag).orderBy(axis)
    return F.row_number().over(everything) - F.row_number().over(alike)


def unwrap(df: DataFrame, value: str, keys: Sequence[str], axis: str, out: str) -> DataFrame:
    """Add ``out``: the phases along ``axis`` without jumps of more than half a turn; expects no nulls."""
    order = Window.partitionBy(*keys).orderBy(axis)
    step = F.col(value) - F.lag(value).over(order)
    turns = F.ceil((step - math.pi) / (2 * math.pi))  # a step of half a turn stays as it is
    x = df.withColumn("__turns", F.coalesce(turns, F.lit(0)))
    return x.withColumn(out, F.col(value) - 2 * math.pi * F.sum("__turns").over(order)).drop("__turns")
