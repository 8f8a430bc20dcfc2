"""Looking back along an ordered key without sorting a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: Column, known: bool = False) -> DataFrame:
    """Add ``out``: ``value`` of the row before in ``order`` within ``keys``, or with ``known`` the last one that isn't null.

    ``block`` must grow with ``order``. Rows are sorted within (keys, block); only one summary row per block
    is sorted per key, and its value is carried into the next blocks.
    """
    x = df.withColumn("__block", block).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    at = F.lag("__value").over(inside) if not known else F.last("__value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    summary = x.filter(F.col("__value").isNotNull()) if known else x
    ends = summary.groupBy(*keys, "__block").agg(F.max_by("__value", order).alias("__end"))
    blocks = x.select(*keys, "__block").distinct().join(ends, [*keys, "__block"], "left") if known else ends
    line = Window.partitionBy(*keys).orderBy("__block")
    carried = F.last("__end", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)) if known else F.lag("__end").over(line)
    blocks = blocks.select(*keys, "__block", carried.alias("__carried"))
    x = x.withColumn("__first", F.row_number().over(inside)).withColumn("__at", at)
    got = F.coalesce("__at", "__carried") if known else F.when(F.col("__first") == 1, F.col("__carried")).otherwise(F.col("__at"))
    return x.join(blocks, [*keys, "__block"], "left").withColumn(out, got).drop("__block", "__value", "__first", "__at", "__carried")
