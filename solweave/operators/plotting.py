"""Plot-ready rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solweave.functions import grids
from solweave.functions.carry import before
from solweave.functions.frames import unwrap
from solweave.functions.medians import group_medians
from solweave.functions.scalar import normalize_phase, wrap_rotation
from solweave.functions.unwrapping import unwrap_plane
from solweave.model import Solutions


#: Breaks in time that are closed up in one plot.
MOST_BREAKS = 10_000


def time_breaks(table: Solutions, factor: float = 100.0) -> list[tuple[float, float]]:
    """(time before, length) of the breaks longer than ``factor`` times the median step of the time axis."""
    times = table.df.select(F.col("time").cast("double").alias("t")).distinct()
    span = times.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    if span.a is None or span.z == span.a:
        return []
    block = F.floor((F.col("t") - span.a) / ((span.z - span.a) / 1024))
    steps = before(times, [], "t", F.col("t"), "p", block).filter(F.col("p").isNotNull()).withColumn("d", F.col("t") - F.col("p"))
    usual = group_medians(steps, [], "d", "m").first()
    if usual is None:
        return []
    rows = steps.filter(F.col("d") > factor * usual.m).orderBy("t").limit(MOST_BREAKS + 1).collect()
    if len(rows) > MOST_BREAKS:
        raise ValueError(f"more than {MOST_BREAKS} breaks in time: select a part of it")
    return [(r.p, r.d) for r in rows]


def _closed_up(t: Column, breaks: Sequence[tuple[float, float]], span: float) -> Column:
    """Seconds with each break shortened to a hundredth of what is left."""
    left = span - sum(d for _, d in breaks)
    cut = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d - left / 100).alias("d")) for p, d in breaks])
    return t - F.aggregate(F.filter(cut, lambda b: b.p < t), F.lit(0.0), lambda acc, b: acc + b.d)


def plot_rows(
    table: Solutions, axes: Sequence[str], panel: str = "", colour: str = "", diff: str = "", log: bool | str = False, show_flagged: bool = False, unwrap_phases: bool = False,
    minmax: tuple[float, float] | None = None, antennas: DataFrame | None = None, close_breaks: bool = True,
) -> DataFrame:
    """One row per point: ``file, panel, colour, x[, y], px, py, val, flagged, lo, hi``.

    Coordinates off ``axes``, ``panel`` and ``colour`` name the file (the files in order are the frames of a film). ``diff`` is an axis of two coordinates whose values are subtracted
    (flagged where either is). Phases lie within half a turn either way (rotations a quarter), or are unwrapped along a single axis or on the plane of two (a plane in one task). Times are
    hours, minutes or seconds from the first, by the span; on a single axis breaks longer than 100 usual steps are closed up. Frequencies are MHz. With ``antennas`` and the axis ``ant``, ``px`` and ``py`` are
    the antenna's place on the ground (the second coordinate, and the first turned round). The limits are ``minmax`` (none where both are 0), or pi for phases, or for amplitudes the lesser of the
    largest value and the mean plus three deviations. ``log`` takes decimal logarithms of the values. Flagged points have a null value unless they are shown.
    """
    df = table.df
    rest = list(table.axes)
    named = [*axes, *[a for a in (panel, colour, diff) if a]]
    if len(axes) not in (1, 2) or len(set(named)) < len(named):
        raise ValueError("one or two axes, and each axis once")
    table.others(named)
    if len(axes) == 2:
        colour = ""
    if diff:
        if table.axis_length(diff) != 2:
            raise ValueError(f"the axis {diff} must have two coordinates")
        on = [a for a in rest if a != diff]
        w = df.groupBy(*on).agg(F.min_by("val", diff).alias("a"), F.max_by("val", diff).alias("b"), F.min(F.abs("weight")).alias("weight"))
        df, rest = w.withColumn("val", F.col("a") - F.col("b")), on
    flagged = (F.col("weight") == 0) | F.col("val").isNull()
    if table.kind == "rotation":
        df = df.withColumn("val", wrap_rotation(F.col("val")))
    elif table.is_phase:
        df = df.withColumn("val", normalize_phase(F.col("val")))
    if log:
        df = df.withColumn("val", F.when(F.col("val") > 0, F.log10("val")))
    if unwrap_phases and table.is_phase:
        keys = [a for a in rest if a not in axes]
        df = df.select(*rest, "val", "weight")
        if len(axes) == 1:
            seen = unwrap(df.filter(F.col("val").isNotNull()), "val", keys, axes[0], "__u")
            df = df.drop("val").join(seen.select(*rest, F.col("__u").alias("val")), rest, "left")
        else:
            kinds = dict(df.dtypes)
            df = df.groupBy(*keys).applyInPandas(_plane(list(axes)), ", ".join(f"`{c}` {kinds[c]}" for c in df.columns))
            df = df.withColumn("val", F.when(~F.isnan("val"), F.col("val")))
    df = df.withColumn("flagged", flagged)
    files = [a for a in rest if a not in (*axes, panel, colour)]
    name = F.concat_ws("_", *[F.concat(F.lit(f"{a}-"), F.col(a).cast("string")) for a in files]) if files else F.lit("all")
    start = end = 0.0
    if "time" in axes:
        start, end = df.agg(F.min("time"), F.max("time")).first()
        start, end = start or 0, end or 0
    unit = 3600 if end - start > 3600 else 60 if end - start > 60 else 1
    breaks = time_breaks(table) if list(axes) == ["time"] and close_breaks else []

    def scaled(a: str) -> Column:
        c = F.col(a)
        if a != "time":
            return c / 1e6 if a == "freq" else c
        t = c - F.lit(start)
        return (_closed_up(t.cast("double"), [(p - start, d) for p, d in breaks], end - start) if breaks else t) / unit

    place = [F.lit(None).cast("double").alias(c) for c in ("px", "py")]
    if antennas is not None and "ant" in rest:
        ground = antennas.select(F.col("name").alias("ant"), F.col("position")[1].cast("double").alias("__px"), (-F.col("position")[0].cast("double")).alias("__py")).dropDuplicates(["ant"])
        df, place = df.join(ground, "ant", "left"), [F.col("__px").alias("px"), F.col("__py").alias("py")]
    out = df.select(
        name.alias("file"), (F.col(panel).cast("string") if panel else F.lit("")).alias("panel"), (F.col(colour).cast("string") if colour else F.lit("")).alias("colour"),
        *[scaled(a).alias(c) for a, c in zip(axes, ("x", "y"), strict=False)], *place, "val", "flagged",
    )
    if minmax and any(minmax):
        lo, hi = F.lit(float(minmax[0])), F.lit(float(minmax[1]))
        out = out.withColumn("lo", lo).withColumn("hi", hi)
    elif table.is_phase:
        out = out.withColumn("lo", F.lit(-3.141592653589793)).withColumn("hi", F.lit(3.141592653589793))
    else:
        ok = F.when(~F.col("flagged"), F.col("val"))
        lim = out.groupBy("file").agg(F.min(ok).alias("lo"), F.least(F.max(ok), F.avg(ok) + 3 * F.stddev_pop(ok)).alias("hi"))
        out = out.join(lim, "file")
    return out if show_flagged else out.withColumn("val", F.when(~F.col("flagged"), F.col("val")))


def _plane(axes: list[str]):
    """Unwrap the phases of one plane, flagged cells aside."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        val, place = grids.cube(pdf, axes, "val")
        weight, _ = grids.cube(pdf, axes, "weight")
        bad = np.isnan(val) | np.isnan(weight) | (weight == 0)
        if not bad.all():
            val = np.where(np.isnan(val), np.nan, unwrap_plane(np.where(np.isnan(val), 0.0, val), bad))
        pdf["val"] = val[place]
        return pdf

    return run


def render(rows: DataFrame, path: str, size: Sequence[float] = (0, 0), marker: float = 2.0, columns: int = 0, most: int = 5_000_000) -> None:
    """Draw the points of one file, a panel each; needs matplotlib. Points are read to the driver: more than ``most`` are refused, so select a part first.

    Two axes are drawn as coloured places, antennas with places on the ground by these. Flagged points that are shown are red.
    """
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib; the rows can be plotted with any tool") from e
    pdf = rows.limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError(f"more than {most} points")
    panels = sorted(pdf["panel"].unique()) or [""]
    across = columns or int(np.ceil(np.sqrt(len(panels))))
    down = -(-len(panels) // across)
    fig, axs = plt.subplots(down, across, squeeze=False, sharex=True, sharey=True, figsize=(size[0] or 10 + 3 * across, size[1] or 8 + 2 * down))
    for ax, name in zip(axs.ravel(), panels, strict=False):
        part = pdf[pdf["panel"] == name]
        ax.set_title(name)
        ground = part["px"].notna().any()
        if "y" in part or ground:
            x, y = (part["px"], part["py"]) if ground else (part["x"], part["y"])
            ax.scatter(x, y, c=part["val"], s=4 * marker**2)
            continue
        for c, line in part.groupby("colour"):
            good, bad = line[~line["flagged"]], line[line["flagged"]]
            ax.plot(good["x"], good["val"], ".", markersize=marker, label=c)
            ax.plot(bad["x"], bad["val"], ".", markersize=marker, color="#e41a1c")
    fig.savefig(path)
    plt.close(fig)
