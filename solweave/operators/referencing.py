"""Values relative to an antenna or a direction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solweave.functions.medians import group_medians
from solweave.model import Solutions

#: Antennas that are compared with each other on the driver; an array has hundreds.
MOST_ANTENNAS = 20_000


def antenna_distances(antennas: DataFrame, to: str | None = None, subset: Sequence[str] = ()) -> DataFrame:
    """(ant, dist): metres to one antenna, or to the median of all positions. Antennas without a position are left out; repeated rows count once."""
    pos = antennas.select(F.col("name").alias("ant"), *[F.col("position")[i].cast("double").alias(c) for i, c in enumerate("xyz")]).dropna().dropDuplicates(["ant"])
    if subset:
        pos = pos.filter(F.col("ant").isin(list(subset)))
    if to is None:
        here = None
        for c in "xyz":
            m = group_medians(pos, [], c, f"{c}0")
            here = m if here is None else here.join(F.broadcast(m), how="cross")  # one row each
    else:
        here = pos.filter(F.col("ant") == to).select(*[F.col(c).alias(f"{c}0") for c in "xyz"]).limit(1)
    square = lambda c: (F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0"))
    return pos.join(F.broadcast(here), how="cross").select("ant", F.sqrt(square("x") + square("y") + square("z")).alias("dist"))


def auto_reference(table: Solutions, antennas: DataFrame, nearest: int = 10) -> str:
    """The antenna with most unflagged cells among the ``nearest`` ones to the median position; ties go to the name that sorts first."""
    near = antenna_distances(antennas).join(table.df.select("ant").distinct(), "ant", "left_semi").orderBy("dist", "ant").limit(nearest)
    counts = table.df.groupBy("ant").agg(F.sum((F.col("weight") != 0).cast("bigint")).alias("n"))
    best = near.join(counts, "ant").orderBy(F.desc("n"), "ant").first()
    if best is None:
        raise ValueError("no antenna has a position")
    return best.ant


def least_flagged(table: Solutions) -> str:
    """The antenna with most unflagged cells; ties go to the name that sorts first."""
    return table.df.groupBy("ant").agg(F.sum((F.col("weight") != 0).cast("bigint")).alias("n")).orderBy(F.desc("n"), "ant").first().ant


def closest_antennas(table: Solutions, antennas: DataFrame) -> DataFrame:
    """(ant, ref): for each antenna of the table its nearest other one that isn't fully flagged; ties go to the name that sorts first.

    The positions of an array are few (at most ``MOST_ANTENNAS``, checked) and are compared on the driver.
    """
    known = antennas.select(F.col("name").alias("ant"), "position").dropna().dropDuplicates(["ant"]).join(table.df.select("ant").distinct(), "ant", "left_semi")
    rows = known.join(table.fully_flagged().withColumn("dead", F.lit(True)), "ant", "left").orderBy("ant").limit(MOST_ANTENNAS + 1).collect()
    if len(rows) > MOST_ANTENNAS:
        raise ValueError(f"more than {MOST_ANTENNAS} antennas")
    pos = np.array([[float(x) for x in r.position] for r in rows]).reshape(-1, 3)
    alive = np.array([not r.dead for r in rows], dtype=bool)
    pairs = []
    for i, r in enumerate(rows):
        d = np.sqrt(((pos - pos[i]) ** 2).sum(axis=1))
        d[~alive] = np.inf
        d[i] = np.inf
        if np.isfinite(d).any():
            pairs.append((r.ant, rows[int(d.argmin())].ant))
    return table.df.sparkSession.createDataFrame(pairs, "ant string, ref string")


def centre_direction(sources: DataFrame) -> str:
    """The source nearest to the mean direction; ties go to the name that sorts first."""
    xy = sources.select("name", *[F.col("dir")[i].cast("double").alias(c) for i, c in enumerate("ab")]).dropna()
    mean = xy.agg(F.avg("a").alias("a0"), F.avg("b").alias("b0"))
    d = (F.col("a") - F.col("a0")) * (F.col("a") - F.col("a0")) + (F.col("b") - F.col("b0")) * (F.col("b") - F.col("b0"))
    return xy.join(F.broadcast(mean), how="cross").orderBy(d, "name").first().name


def reference(
    table: Solutions,
    ant: str | None = None,
    direction: str | None = None,
    antennas: DataFrame | None = None,
    sources: DataFrame | None = None,
    one_pol: bool = False,
) -> Solutions:
    """Subtract the values at a reference antenna and/or direction, cell by cell; weights stay.

    ``ant`` is a name, ``auto`` (the best of the ten nearest to the middle of the array) or ``closest`` (another
    one for each antenna). ``direction`` is a name or ``center``. With ``one_pol``, or four polarisations,
    XX (or else RR) of the reference is subtracted from all polarisations. Without a reference nothing
    changes. Cells whose reference is missing or null become null.
    """
    if not ant and not direction:
        return table
    if ant == "auto":
        ant = auto_reference(table, antennas)
    if direction == "center":
        direction = centre_direction(sources)
    drop = [a for a, want in (("ant", ant), ("dir", direction)) if want]
    on = table.others(drop)
    src = table.df
    if ant and ant != "closest":
        src = src.filter(F.col("ant") == ant)
    if direction:
        src = src.filter(F.col("dir") == direction)
    if "pol" in on:
        pols = table.axis_values("pol", 1000)
        if one_pol or len(pols) == 4:
            keep = "XX" if "XX" in pols else "RR" if "RR" in pols else sorted(pols)[0]
            src, on = src.filter(F.col("pol") == keep), [a for a in on if a != "pol"]
    if ant == "closest":
        if direction:
            raise ValueError("closest works for antennas alone")
        pairs = closest_antennas(table, antennas)
        src = src.select(F.col("ant").alias("ref"), *on, F.col("val").alias("__r"))
        df = table.df.join(pairs, "ant", "left").join(src, ["ref", *on], "left")
    else:
        df = table.df.join(src.select(*on, F.col("val").alias("__r")), on, "left")
    return table.put(df.withColumn("val", F.col("val") - F.col("__r")))
