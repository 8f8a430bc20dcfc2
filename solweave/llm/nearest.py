"""Pairing records of two tables by nearest time, by joins over expanding rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the cells by which rows are spread, in tolerances. Right rows near a cell's ends go to the next cell, too.
CELL = 16
#: Buckets are this much wider than needed, so that rounding loses no match at the ends.
SLACK = 1.001


def _ring(x: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Look for the matches of open left rows within ``radius``: in their bucket of width 2r and in that of a second grid, half a bucket further.

    One of the two reaches r back and the other r ahead. Each bucket is read once in the order of time, forwards and backwards, so that
    no pairs of rows are built however full it is.
    """
    right = F.col("side") == 0
    hit = F.when(right, F.struct("t", "id"))
    width = F.lit(2 * SLACK * radius)
    found = []
    for name, bucket in (("b0", F.floor(F.col("t") / width)), ("b1", F.floor(F.col("t") / width + 0.5))):
        # Rows that found their match stand aside, in a bucket of nulls.
        x = x.withColumn(name, F.when(F.col("best").isNull(), bucket))
        part = Window.partitionBy(*keys, "cell", name)
        # At equal times the right row comes first in either direction.
        for way, order in (("f", F.col("t").asc()), ("b", F.col("t").desc())):
            x = x.withColumn(name + way, F.last(hit, ignorenulls=True).over(part.orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0)))
            found.append(name + way)

    def scored(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("t")).alias("dist"), F.col(f"{c}.id").alias("id")))

    near = F.least(*[scored(c) for c in found])
    best = F.when(~right, F.coalesce("best", F.when(near.dist <= radius, near)))
    return x.withColumn("best", best).drop("b0", "b1", *found)


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    tolerance: float,
    start: float | None = None,
) -> DataFrame:
    """One row per left record with known keys and time: ``left_id, right_id, dist``, nulls where none is near enough.

    A ring of radius r uses buckets of width 2r; a match at a distance of at most r is provably the nearest.
    Left rows without one go on to a ring of twice the radius, the last having the radius ``tolerance``
    (inclusive). ``start`` is the first radius (default ``tolerance / 4``).

    Rows with a null key, or a null, NaN or infinite time on either side, match nothing and are left out;
    so are null ids. A repeated id counts once. Right records at the same time stand for the smallest id
    of theirs, and of two right times equally far the smaller id wins. Empty tables give empty results. Columns
    other than those named are not read, so clashing names do no harm. Both ids are whole numbers.

    Rows are shuffled once, by (keys, cell of ``CELL`` tolerances), so a hot key is spread over time; right rows within a tolerance of a
    cell's end go to both. All rings and the removal of repeats take place within that partitioning.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    names = [f"k{i}" for i in range(len(keys))]
    wide = F.lit(CELL * tolerance)

    def usable(df: DataFrame, time: str, row_id: str, side: int) -> DataFrame:
        t = F.col(time).cast("double")
        x = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], (t + F.lit(0.0)).alias("t"), F.col(row_id).alias("id"), F.lit(side).alias("side"))
        ok = F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")) & F.col("id").isNotNull()
        for n in names:
            ok = ok & F.col(n).isNotNull()
        return x.filter(ok)

    lhs = usable(left, left_time, left_id, 1).withColumn("cell", F.floor(F.col("t") / wide))
    ends = F.floor((F.col("t") - SLACK * tolerance) / wide), F.floor((F.col("t") + SLACK * tolerance) / wide)
    rhs = usable(right, right_time, right_id, 0).withColumn("cell", F.explode(F.sequence(*ends)))
    both = lhs.unionByName(rhs).repartition(*names, "cell")
    x = both.groupBy(*names, "cell", "t", "side", F.when(F.col("side") == 1, F.col("id")).alias("left_id")).agg(F.min("id").alias("id")).drop("left_id")
    x = x.withColumn("best", F.lit(None).cast("struct<dist:double,id:bigint>"))
    radius = tolerance / 4 if start is None else min(start, tolerance)
    while radius < tolerance:
        x = _ring(x, names, radius)
        radius *= 2
    x = _ring(x, names, tolerance).filter(F.col("side") == 1)
    return x.select(F.col("id").alias(left_id), F.col("best.id").alias(right_id), F.col("best.dist").alias("dist"))
