"""Exact medians of groups of any size, by aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the first pass is at most n / SKETCH.
SKETCH = 20_000


def group_medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """One row per group: keys and the median (mean of the middle two) of the values that aren't null.

    A quantile sketch of fixed size brackets the median; a second pass counts what lies below the bracket
    and, per different value, what lies in it. No task holds the values of a group.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    e = 2.0 / SKETCH
    ends = x.groupBy(*keys).agg(F.percentile_approx("__v", [0.5 - e, 0.5 + e], SKETCH).alias("q"), F.count(F.lit(1)).alias("__n"))
    ends = ends.select(*keys, "__n", F.col("q")[0].alias("__lo"), F.col("q")[1].alias("__hi"))
    y = x.join(ends, list(keys)) if keys else x.join(F.broadcast(ends), how="cross")
    # Below the bracket all rows count as one value, above it they aren't needed.
    y = y.filter(F.col("__v") <= F.col("__hi")).withColumn("__v", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
    counts = y.groupBy(*keys, "__n", "__v").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first())
    counts = counts.withColumn("__upto", F.sum("__k").over(w))
    first, second = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    hit = lambda r: F.max(F.when((F.col("__upto") >= r) & (F.col("__upto") - F.col("__k") < r), F.col("__v")))
    return counts.groupBy(*keys).agg(((hit(first) + hit(second)) / 2).alias(out))
