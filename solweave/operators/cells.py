"""Operators that work cell by cell or against figures of a group of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solweave.functions.medians import group_medians
from solweave.functions.scalar import log10_positive
from solweave.model import Solutions, good, with_stats
from solweave.operators.selection import select


def absolute(table: Solutions) -> Solutions:
    """Absolute values; weights stay, null stays null."""
    return table.put(table.df.withColumn("val", F.abs("val")))


def clip(table: Solutions, axes: Sequence[str] | None = None, level: float = 5.0, log: bool = False, mode: str = "median") -> Solutions:
    """Flag outliers of each group of cells that share the coordinates off ``axes`` (None or empty: all axes).

    ``median``: further from the group's median than ``level`` population standard deviations; both are
    taken over cells that aren't flagged. ``above``/``below``: beyond ``level``. With ``log`` all in
    decimal logarithms, values of 0 or less having none. Null values are never flagged; groups without an unflagged value stay.
    """
    keys = table.others(axes or table.axes)
    x = log10_positive(F.col("val")) if log else F.col("val")
    if mode in ("above", "below"):
        bad = x > level if mode == "above" else x < level
        if not log:
            return table.put(table.df.withColumn("weight", F.when(bad, 0.0).otherwise(F.col("weight"))))
        return table.put(table.df.withColumn("weight", F.when(bad, 0.0).otherwise(F.col("weight"))))
    if mode != "median":
        raise ValueError("mode is median, above or below")
    df = table.df.withColumn("__x", x)
    use = df.select(*keys, F.when(F.col("weight") != 0, F.col("__x")).alias("__u"))
    stats = use.groupBy(*keys).agg(F.stddev_pop("__u").alias("__s"))
    middle = group_medians(use, keys, "__u", "__m")
    df = with_stats(with_stats(df, keys, stats), keys, middle) if not keys else df.join(stats.join(middle, keys, "left"), keys, "left")  # figures first: rows are joined once
    bad = F.abs(F.col("__x") - F.col("__m")) > level * F.col("__s")
    return table.put(df.withColumn("weight", F.when(bad, 0.0).otherwise(F.col("weight"))))


def norm(table: Solutions, axes: Sequence[str], value: float = 1.0, log: bool = False) -> Solutions:
    """Scale the unflagged cells of each group (coordinates off ``axes``) to the mean ``value``.

    With ``log`` values are logarithms already: they are shifted to the mean log10(value). A mean of 0 leaves null.
    """
    keys = table.others(axes)
    stats = table.df.groupBy(*keys).agg(F.avg(good()).alias("__m"))
    df = with_stats(table.df, keys, stats)
    new = F.col("val") + F.log10(F.lit(float(value))) - F.col("__m") if log else F.try_divide(F.col("val") * float(value), F.col("__m"))
    return table.put(df.withColumn("val", F.when(F.col("weight") != 0, new).otherwise(F.col("val"))))


def reset(table: Solutions, value: float | None = None) -> Solutions:
    """Set every value: to ``value``, or to 1 for amplitudes (with four polarisations only XX, YY, RR, LL) and 0 for others. Weights stay."""
    if value is not None:
        new: Column = F.lit(float(value))
    elif not table.is_amplitude:
        new = F.lit(0.0)
    elif "pol" in table.axes and table.df.select("pol").distinct().count() == 4:
        new = F.when(F.col("pol").isin("XX", "YY", "RR", "LL"), 1.0).otherwise(0.0)
    else:
        new = F.lit(1.0)
    return table.put(table.df.withColumn("val", new))


def duplicate(table: Solutions, name: str, **wanted: object) -> Solutions:
    """The selected cells under another name."""
    out = select(table, **wanted)
    return out.put(out.df, name=name)


def cell_of(table: Solutions, axis: str, which: object) -> Column | object:
    """The coordinate meant by ``first``, ``last`` or a value."""
    if which in ("first", "last"):
        rows = table.axis(axis)
        pick = F.min_by(axis, "i") if which == "first" else F.max_by(axis, "i")
        return rows.agg(pick.alias("c")).first().c  # one coordinate
    return which


def delete_axis(table: Solutions, axis: str, which: object) -> Solutions:
    """Keep the cells at one coordinate (``first``, ``last`` or a value) and drop the axis."""
    kind = dict(table.df.dtypes)[axis]
    df = table.df.filter(F.col(axis) == F.lit(cell_of(table, axis, which)).cast(kind))
    return table.put(df, axes=tuple(table.others([axis])))


def replicate_on_axis(table: Solutions, axis: str, which: object, weights: bool = True) -> Solutions:
    """Every cell gets the value (and weight) of the cell at one coordinate of ``axis``.

    ``which`` is ``first``, ``last``, a coordinate, or ``nonflaggedCS``: the mean of the unflagged cells of core
    stations, of weight 1 where there is one. Where the source has no cell the value becomes null and the weight 0.
    """
    keys = table.others([axis])
    if which == "nonflaggedCS":
        src = table.df.filter(F.col(axis).rlike("CS") & (F.col("weight") != 0)).groupBy(*keys).agg(F.avg("val").alias("__v"))
        src = src.withColumn("__w", F.when(F.col("__v").isNotNull(), 1.0).otherwise(0.0))
    else:
        kind = dict(table.df.dtypes)[axis]
        src = table.df.filter(F.col(axis) == F.lit(cell_of(table, axis, which)).cast(kind)).select(*keys, F.col("val").alias("__v"), F.col("weight").alias("__w"))
    df = table.df.join(src, keys, "left").withColumn("val", F.col("__v"))
    if weights:
        df = df.withColumn("weight", F.coalesce("__w", F.lit(0.0)))
    return table.put(df)


def reweight_uniform(table: Solutions, weight: float = 1.0) -> Solutions:
    """One weight for all cells."""
    return table.put(table.df.withColumn("weight", F.lit(float(weight))))


def reweight_copy(table: Solutions, other: Solutions) -> Solutions:
    """The weights of another table at the same coordinates; cells flagged here or missing there get 0."""
    given = other.df.select(*table.axes, F.col("weight").alias("__w"))
    df = table.df.join(given, list(table.axes), "left")
    return table.put(df.withColumn("weight", F.when(F.col("weight") == 0, 0.0).otherwise(F.coalesce("__w", F.lit(0.0)))))


def flag_defaults(table: Solutions) -> Solutions:
    """Flag cells that still have the value a solver starts from: 1 for amplitudes, 0 for others."""
    return table.put(table.df.withColumn("weight", F.when(F.col("val") == table.default, 0.0).otherwise(F.col("weight"))))


def flagged_share(table: Solutions, by: Sequence[str] = ()) -> DataFrame:
    """Cells and the percentage that is flagged or null, per group."""
    bad = ((F.col("weight") == 0) | F.col("val").isNull()).cast("double")
    return table.df.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), (100 * F.avg(bad)).alias("flagged"))
