"""Smoothing, regridding and window weights along axes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solweave.functions.frames import along, islands, running_line, running_median
from solweave.functions.medians import group_medians
from solweave.functions.scalar import log10_positive, quantity
from solweave.model import Solutions, good, with_stats


def _finish(table: Solutions, df: DataFrame, replace: bool, log: bool) -> Solutions:
    """Put ``__s`` in place: flagged cells keep their value unless they are to be replaced."""
    new = F.pow(F.lit(10.0), F.col("__s")) if log else F.col("__s")
    if replace:
        return table.put(df.withColumn("val", new).withColumn("weight", F.when(F.col("val").isNull(), 0.0).otherwise(1.0)))
    return table.put(df.withColumn("val", F.when(F.col("weight") != 0, new).otherwise(F.col("val"))))


def smooth(table: Solutions, axes: Sequence[str], size: Sequence[int] = (), mode: str = "runningmedian", degree: int = 1, replace: bool = False, log: bool = False) -> Solutions:
    """Smooth along axes; flagged and null cells don't count.

    ``mean`` and ``median`` give every cell of a group (coordinates off ``axes``) the group's figure; ``runningmedian``
    takes that of a window of ``size`` cells (even sizes grow by one), on one axis by a row frame, on more by a
    kernel per group; ``runningpoly`` fits a polynomial of ``degree`` to the window; ``savitzky-golay`` does so on the
    filled-in line. Phases are smoothed by their unit vectors; the polynomial modes refuse them. With
    ``replace`` flagged cells get the result and weight 1, or 0 where there is none. Cells that aren't in the table aren't in its windows.
    """
    keys = table.others(axes)
    size = [s + 1 - s % 2 for s in size]
    df = table.df.withColumn("__v", log10_positive(good()) if log else good())
    if mode in ("mean", "median"):
        if table.is_phase:
            df = df.withColumn("__a", F.cos("__v")).withColumn("__b", F.sin("__v"))
            if mode == "mean":
                stats = df.groupBy(*keys).agg(F.atan2(F.avg("__b"), F.avg("__a")).alias("__s"))
            else:
                stats = _vector_median(df, keys)
            df = with_stats(df, keys, stats)
        elif mode == "mean":
            df = with_stats(df, keys, df.groupBy(*keys).agg(F.avg("__v").alias("__s")))
        else:
            df = df.join(group_medians(df, keys, "__v", "__s"), keys, "left") if keys else with_stats(df, keys, group_medians(df, keys, "__v", "__s"))
        out = F.pow(F.lit(10.0), F.col("__s")) if log else F.col("__s")
        done = df.withColumn("val", out)
        return table.put(done.withColumn("weight", F.when(F.col("val").isNull(), 0.0).otherwise(1.0)) if replace else done)
    if len(size) != len(axes):
        raise ValueError("give a size for each axis")
    if mode == "runningmedian" and len(axes) == 1:
        w = along(keys, axes[0], size[0])
        if table.is_phase:
            s = F.atan2(running_median(F.sin("__v"), w), running_median(F.cos("__v"), w))
        else:
            s = running_median(F.col("__v"), w)
        return _finish(table, df.withColumn("__s", s), replace, log)
    if table.is_phase and mode != "runningmedian":
        raise ValueError(f"{mode} doesn't work for phases")
    if mode == "runningpoly" and len(axes) == 1 and degree == 1:
        w = along(keys, axes[0], size[0])
        rank = F.row_number().over(along(keys, axes[0])).cast("double")
        df = df.withColumn("__x", rank)
        return _finish(table, df.withColumn("__s", running_line(F.col("__v"), F.col("__x"), w)), replace, log)
    return _finish(table, _by_kernel(table, df, keys, list(axes), size, mode, degree), replace, log)


def _vector_median(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The middle of unit vectors sorted by their first and then their second part (the mean of the middle two), as an angle."""
    x = df.filter(F.col("__v").isNotNull()).select(*keys, "__a", "__b")
    counts = x.groupBy(*keys, "__a", "__b").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("k").over(w.orderBy("__a", "__b"))).withColumn("n", F.sum("k").over(w))

    def at(rank, part: str):
        return F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank), F.col(part)))

    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return counts.groupBy(*keys).agg(F.atan2(at(first, "__b") + at(second, "__b"), at(first, "__a") + at(second, "__a")).alias("__s"))


def _by_kernel(table: Solutions, df: DataFrame, keys: list[str], axes: list[str], size: list[int], mode: str, degree: int) -> DataFrame:
    from solweave.functions import grids

    phase = table.is_phase

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cube, place = grids.cube(pdf, axes, "__v")
        if mode == "runningmedian":
            if phase:
                out = np.arctan2(grids.running_median(np.sin(cube), size), grids.running_median(np.cos(cube), size))
            else:
                out = grids.running_median(cube, size)
        elif mode == "runningpoly":
            out = grids.running_poly(cube, size[0], degree)
        elif mode == "savitzky-golay":
            out = grids.savitzky_golay(cube, size[0], degree)
        else:
            raise ValueError(f"unknown mode {mode}")
        pdf["__s"] = out[place]
        return pdf

    cols = [*table.axes, "val", "weight", "__v"]
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in cols) + ", __s double"
    return df.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def reweight_window(table: Solutions, axis: str = "time", detrend: int = 3, width: int = 251) -> Solutions:
    """Weights from the scatter around each cell: 1 / (2 * std)**2 along ``axis``, cells of weight 0 left out.

    Cells are detrended by a running median of ``detrend`` rows (0: not at all) and their scatter is taken over
    ``width`` rows: for phases the circular one of cosine and sine together, for amplitudes of ln(val). A scatter that is 0
    or missing is the least good one of the antenna. Weights are scaled down to at most 65504. Flagged cells stay
    flagged; an antenna without any good scatter keeps weight 1 where it isn't flagged.
    """
    keys = table.others([axis])
    size = [s + 1 - s % 2 for s in (detrend, width)]
    df = table.df.withColumn("__v", good())
    wide = along(keys, axis, size[1])
    if table.is_phase:
        parts = []
        for name, f in (("__re", F.cos), ("__im", F.sin)):
            df = df.withColumn(name, f("__v"))
            if detrend:
                df = df.withColumn(name, F.least(F.greatest(F.col(name) - running_median(F.col(name), along(keys, axis, size[0])), F.lit(-1.0)), F.lit(1.0)))
            # A part of a unit vector and its complement give the mean resultant length.
            r = F.hypot(F.avg(name).over(wide), F.avg(F.sqrt(1 - F.col(name) * F.col(name))).over(wide))
            parts.append(F.sqrt(F.greatest(-2 * F.ln(r), F.lit(0.0))))
        df = df.withColumn("__sd", parts[0] + parts[1])
    else:
        df = df.withColumn("__x", F.when(F.col("__v") > 0, F.ln("__v")) if table.is_amplitude else F.col("__v"))
        if detrend:
            df = df.withColumn("__x", F.col("__x") - running_median(F.col("__x"), along(keys, axis, size[0])))
        df = df.withColumn("__sd", F.stddev_pop("__x").over(wide))
    own = ["ant"] if "ant" in table.axes else []
    ok = F.when((F.col("__sd") > 0) & ~F.isnan("__sd"), F.col("__sd"))
    least = df.groupBy(*own).agg(F.min(ok).alias("__least"))
    df = with_stats(df, own, least)
    sd = F.coalesce(ok, F.col("__least"))
    raw = F.when(F.col("__least").isNull(), 1.0).otherwise(1 / ((2 if detrend else 1) * sd * (2 if detrend else 1) * sd))
    df = df.withColumn("__w", F.when(F.col("weight") != 0, raw))
    top = df.groupBy(*own).agg(F.max("__w").alias("__top"))
    df = with_stats(df, own, top)
    scaled = F.when(F.col("__top") > 65504, F.col("__w") * 65504 / F.col("__top")).otherwise(F.col("__w"))
    return table.put(df.withColumn("weight", F.coalesce(scaled, F.lit(0.0))))


def interpolate(table: Solutions, axis: str, step: str | float, current: str | float = "", max_gap: int = 0, log: bool = False) -> Solutions:
    """Linear interpolation onto a grid of ``step`` along time or frequency.

    The grid runs from ``min + off`` to ``max + off + step/2`` with ``off = (step - current) / 2``; ``current`` is by
    default the least distance of neighbours. Values come from unflagged cells, at least three of a group, and are null beyond them;
    weights from all cells, rounded half to even (0 beyond them). With ``max_gap`` > 1, flagged runs of at most so many
    cells that lie between unflagged ones are filled as well.
    """
    keys = table.others([axis])
    x = table.axis(axis).select(F.col(axis).cast("double").alias("x"))
    gaps = x.withColumn("d", F.col("x") - F.lag("x").over(Window.orderBy("x")))  # an axis is short
    b = gaps.agg(F.min("x").alias("a"), F.max("x").alias("z"), F.min("d").alias("d")).first()
    new, old = quantity(step), (quantity(current) if current != "" else float(b.d or 0.0))
    off = (new - old) / 2
    grid = np.arange(b.a + off, b.z + off + new / 2, new)
    if len(grid) > 10_000_000:
        raise ValueError("the grid is too fine")
    spark = table.df.sparkSession
    points = spark.range(len(grid)).select((F.lit(float(b.a + off)) + F.col("id") * F.lit(float(new))).alias("g"))

    df = table.df.withColumn("__x", F.col(axis).cast("double")).withColumn("__v", log10_positive(F.col("val")) if log else F.col("val"))
    df = df.withColumn("__ok", (F.col("weight") != 0) & F.col("__v").isNotNull())
    if max_gap > 1:
        df = df.withColumn("__run", islands(F.col("__ok"), keys, "__x"))
        run = Window.partitionBy(*keys, "__ok", "__run")
        length, inner = F.count(F.lit(1)).over(run), Window.partitionBy(*keys)
        first, last = F.min(F.when(F.col("__ok"), F.col("__x"))).over(inner), F.max(F.when(F.col("__ok"), F.col("__x"))).over(inner)
        fill = ~F.col("__ok") & (length <= max_gap) & (F.col("__x") > first) & (F.col("__x") < last)
        df = df.withColumn("weight", F.when(fill, 1.0).otherwise(F.col("weight")))
    enough = df.groupBy(*keys).agg(F.sum(F.col("__ok").cast("int")).alias("__n"))

    # Grid points and cells of a group in one order: each point looks back and ahead for its brackets.
    groups = df.select(*keys).distinct()
    wanted = groups.join(points, how="cross") if keys else points  # every group gets every point; the planner weighs the sides
    none = F.lit(None).cast("double")
    both = df.select(*keys, "__x", "__v", "weight", "__ok", F.lit(False).alias("__g")).unionByName(
        wanted.select(*keys, F.col("g").alias("__x"), none.alias("__v"), none.alias("weight"), F.lit(False).alias("__ok"), F.lit(True).alias("__g"))
    )
    order = Window.partitionBy(*keys).orderBy("__x", "__g")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("__x"), "__g").rowsBetween(Window.unboundedPreceding, 0)
    cell = F.when(~F.col("__g"), F.struct("__x", "weight"))
    seen = F.when(F.col("__ok"), F.struct("__x", "__v"))
    for name, what in (("w", cell), ("v", seen)):
        both = both.withColumn(f"{name}0", F.last(what, ignorenulls=True).over(back)).withColumn(f"{name}1", F.last(what, ignorenulls=True).over(ahead))

    def line(a: str, part: str):
        x0, x1 = F.col(f"{a}0.__x"), F.col(f"{a}1.__x")
        y0, y1 = F.col(f"{a}0.{part}"), F.col(f"{a}1.{part}")
        return F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col("__x") - x0) / (x1 - x0))

    out = with_stats(both.filter("__g"), keys, enough)
    val = F.when(F.col("__n") >= 3, line("v", "__v"))
    if log:
        val = F.pow(F.lit(10.0), val)
    out = out.select(*keys, F.col("__x").alias(axis), val.alias("val"), F.coalesce(F.rint(line("w", "weight")), F.lit(0.0)).alias("weight"))
    return Solutions(out.select(*table.axes, "val", "weight"), table.axes, table.kind, table.name, table.attrs)
