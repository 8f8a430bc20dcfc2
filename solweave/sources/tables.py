"""Merging, cutting and converting tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solweave.model import Solutions


def collect(tables: Sequence[Solutions], squeeze: bool = False) -> Solutions:
    """Merge tables on the union of their axes; where cells meet the last table wins.

    Weights become 0 or 1, null values are flagged and missing cells added, flagged. With ``squeeze`` axes of one coordinate
    are dropped, but never ``freq``.
    """
    first = tables[0]
    if any(sorted(t.axes) != sorted(first.axes) or t.kind != first.kind for t in tables):
        raise ValueError("tables must have the same axes and kind")
    parts = [t.df.select(*first.axes, "val", "weight", F.lit(i).alias("__i")) for i, t in enumerate(tables)]
    both = reduce(DataFrame.unionByName, parts)
    last = both.groupBy(*first.axes).agg(F.max_by(F.struct("val", "weight"), "__i").alias("c"))
    w = F.when(F.col("c.val").isNull() | (F.col("c.weight") == 0), 0.0).otherwise(1.0)
    out = first.put(last.select(*first.axes, F.col("c.val").alias("val"), w.alias("weight"))).densify()
    if squeeze:
        sizes = out.df.agg(*[F.countDistinct(a).alias(a) for a in out.axes]).first()
        keep = tuple(a for a in out.axes if sizes[a] != 1 or a == "freq")
        out = out.put(out.df, axes=keep)
    return out


def on_grid(table: Solutions, axis: str, grid: DataFrame, kind: str = "linear") -> Solutions:
    """Values and weights on other coordinates (``grid`` has the column ``axis``), each group by itself, extended beyond its ends.

    ``kind``: nearest (ties to the lower), previous, next, zero, linear, slinear; quadratic and cubic by splines in a kernel per group.
    """
    keys = table.others([axis])
    points = grid.select(F.col(axis).cast("double").alias("g")).distinct()
    if kind in ("quadratic", "cubic"):
        return _spline_grid(table, axis, points, 2 if kind == "quadratic" else 3)
    cells = table.df.filter(F.col("val").isNotNull()).select(*keys, F.col(axis).cast("double").alias("x"), "val", "weight")
    groups = cells.select(*keys).distinct()
    wanted = groups.join(points, how="cross")  # every group gets every point; the planner weighs the sides
    none = F.lit(None).cast("double")
    both = cells.withColumn("g", F.lit(False)).unionByName(wanted.select(*keys, F.col("g").alias("x"), none.alias("val"), none.alias("weight"), F.lit(True).alias("g")))
    cell = F.when(~F.col("g"), F.struct("x", "val", "weight"))
    fore, back = Window.partitionBy(*keys).orderBy("x", "g"), Window.partitionBy(*keys).orderBy(F.desc("x"), "g")
    span = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("a", F.last(cell, ignorenulls=True).over(span(fore))).withColumn("b", F.last(cell, ignorenulls=True).over(span(back)))
    # Lines are extended from the two cells next to an end.
    apart = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("a2", F.last(cell, ignorenulls=True).over(apart(fore))).withColumn("b2", F.last(cell, ignorenulls=True).over(apart(back)))
    second = lambda c: F.when(~F.col("g"), F.struct(F.col(c).alias("s")))
    both = both.withColumn("pa", F.last(second("a2"), ignorenulls=True).over(span(fore))).withColumn("pb", F.last(second("b2"), ignorenulls=True).over(span(back)))
    out = both.filter("g")
    lo, hi = F.coalesce("a", "pb.s", "b"), F.coalesce("b", "pa.s", "a")

    def value(part: str):
        xa, xb, ya, yb = lo["x"], hi["x"], lo[part], hi[part]
        if kind in ("previous", "zero"):
            return F.coalesce(F.col("a")[part], F.col("b")[part])
        if kind == "next":
            return F.coalesce(F.col("b")[part], F.col("a")[part])
        if kind == "nearest":
            da, db = F.col("x") - F.col("a.x"), F.col("b.x") - F.col("x")
            return F.when(F.col("b").isNull() | (da <= db), F.col("a")[part]).otherwise(F.col("b")[part])
        return F.when(xa == xb, ya).otherwise(ya + (yb - ya) * (F.col("x") - xa) / (xb - xa))

    out = out.select(*keys, F.col("x").alias(axis), value("val").alias("val"), value("weight").alias("weight"))
    return Solutions(out.select(*table.axes, "val", "weight"), table.axes, table.kind, table.name, table.attrs)


def _spline_grid(table: Solutions, axis: str, points: DataFrame, degree: int) -> Solutions:
    keys = table.others([axis])
    axes = table.axes
    grid = np.array(sorted(r.g for r in points.limit(1_000_001).collect()))
    if len(grid) > 1_000_000:
        raise ValueError("the grid is too long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["val"].notna()].sort_values(axis)
        x = pdf[axis].to_numpy(float)
        out = pd.DataFrame({axis: grid})
        for c in ("val", "weight"):
            out[c] = spline(x, pdf[c].to_numpy(float), grid, degree) if len(x) else np.nan
        for k in keys:
            out[k] = pdf[k].iloc[0] if len(pdf) else None
        return out[[*axes, "val", "weight"]]

    kinds = dict(table.df.dtypes)
    schema = ", ".join(f"`{a}` {'double' if a == axis else kinds[a]}" for a in table.axes) + ", val double, weight double"
    out = table.df.select(*table.axes, "val", "weight").groupBy(*keys).applyInPandas(run, schema)
    return Solutions(out, table.axes, table.kind, table.name, table.attrs)


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """An interpolating spline of degree 2 (knots halfway between points) or 3 (not-a-knot); lower with too few points."""
    degree = min(degree, len(x) - 1)
    if degree < 1:
        return np.full(len(at), y[0])
    inner = x[2:-2] if degree == 3 else (x[1:-2] + x[2:-1]) / 2 if degree == 2 else x[1:-1]
    t = np.r_[[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)]
    n = len(t) - degree - 1
    coef = np.linalg.solve(_bsplines(t, degree, x, n), y)
    return _bsplines(t, degree, at, n) @ coef


def _bsplines(t: np.ndarray, degree: int, at: np.ndarray, n: int) -> np.ndarray:
    """Values of B-splines; beyond the ends the outer polynomials go on."""
    span = np.clip(np.searchsorted(t, at, side="right") - 1, degree, n - 1)
    b = np.zeros((len(at), len(t) - 1))
    b[np.arange(len(at)), span] = 1.0
    for k in range(1, degree + 1):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        wl = np.divide(at[:, None] - t[: -k - 1], left, out=np.zeros((len(at), len(left))), where=left > 0)
        wr = np.divide(t[k + 1 :] - at[:, None], right, out=np.zeros((len(at), len(right))), where=right > 0)
        b = wl * b[:, :-1] + wr * b[:, 1:]
    return b


def resample(tables: Sequence[Solutions], kind: str = "linear") -> Solutions:
    """Bring tables of one kind to the longest time and frequency axes among them and combine them per direction.

    Amplitudes and weights are multiplied, other values summed. The directions are those of all tables that have the axis.
    """
    first = tables[0]
    out = list(tables)
    for axis in ("time", "freq"):
        have = [t for t in tables if axis in t.axes]
        if not have:
            continue
        grids = [t.df.select(axis).distinct() for t in have]
        longest = max(grids, key=lambda g: g.count())
        out = [on_grid(t, axis, longest, kind) if axis in t.axes else t for t in out]
    axes = tuple(dict.fromkeys(a for t in out for a in t.axes))
    axes = tuple(sorted(axes, key=lambda a: a != "dir"))
    total = None
    for i, t in enumerate(out):
        part = t.df.select(*t.axes, F.col("val").alias(f"v{i}"), F.col("weight").alias(f"w{i}"))
        total = part if total is None else total.join(part, [a for a in part.columns if a in total.columns], "full" if set(t.axes) == set(axes) else "left")
    vals, weights = [F.col(f"v{i}") for i in range(len(out))], [F.col(f"w{i}") for i in range(len(out))]
    val = reduce(lambda a, b: a * b if first.is_amplitude else a + b, vals)
    df = total.select(*axes, val.alias("val"), F.coalesce(reduce(lambda a, b: a * b, weights), F.lit(0.0)).alias("weight"))
    return Solutions(df, axes, first.kind, first.name)


def split(table: Solutions, axis: str, length: float, inclusive: bool = False) -> DataFrame:
    """Rows with the number of their ``chunk`` along ``axis``, of about ``length`` each, from the first coordinate on.

    Chunks are half-open; with ``inclusive`` a cell on a boundary lies in both. Write them with ``partitionBy("chunk")``.
    """
    x = F.col(axis).cast("double")
    span = table.df.agg(F.min(x).alias("a"), F.max(x).alias("z")).first()
    n = max(1, int(round((span.z - span.a) / length)))
    at = (x - F.lit(float(span.a))) / F.lit((span.z - span.a) / n or 1.0)
    own = F.least(F.floor(at), F.lit(n - 1)).cast("bigint")
    df = table.df.withColumn("chunk", own)
    if inclusive:
        edge = df.filter((at == F.floor(at)) & (F.col("chunk") > 0) & (at < n)).withColumn("chunk", F.col("chunk") - 1)
        df = df.unionByName(edge)
    return df


def parameters_to_tables(rows: DataFrame, dense: bool = False) -> dict[str, Solutions]:
    """Tables from named parameters: rows of (name, time, freq, val), such as ``Gain:0:0:Real:CS001HBA0:3C196``.

    With ``dense`` each table holds the whole grid of the coordinates that its parameters have among them; cells of no parameter are flagged.

    Gains as Real/Imag become amplitude and phase, Ampl and Phase stay what they are; Clock, TEC, RotationAngle, RotationMeasure, ScalarPhase, ScalarAmplitude and those with Common become tables
    of their kind, with the direction ``pointing`` and the frequency 0 where the parameter has none. Values that aren't finite become 0 (amplitudes 1) and are flagged. Unknown names are left out.
    """
    p = F.split("name", ":")
    base = rows.select(p.alias("p"), p[0].alias("what"), "time", "freq", "val").filter(F.col("name").isNotNull())
    n = F.size("p")
    pol = F.concat(F.when(F.element_at("p", 2) == "0", "X").otherwise("Y"), F.when(F.element_at("p", 3) == "0", "X").otherwise("Y"))
    gain = base.filter(F.col("what").isin("Gain", "DirectionalGain") & (n >= 5)).select(
        F.when(n > 5, F.try_element_at("p", F.lit(6))).otherwise("pointing").alias("dir"), pol.alias("pol"), F.element_at("p", 5).alias("ant"), F.element_at("p", 4).alias("part"), "time", "freq", "val"
    )
    axes = ["dir", "pol", "ant", "freq", "time"]
    pick = lambda c: F.max(F.when(F.col("part") == c, F.col("val")))
    g = gain.groupBy(*axes).agg(*[pick(c).alias(c) for c in ("Real", "Imag", "Ampl", "Phase")])
    amp = F.coalesce(F.hypot("Real", "Imag"), "Ampl")
    phase = F.coalesce(F.atan2("Imag", "Real"), "Phase")

    def table(df: DataFrame, on: Sequence[str], kind: str) -> Solutions:
        finite = F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") < float("inf"))
        empty = 1.0 if kind.endswith("amplitude") else 0.0
        df = df.select(*on, F.when(finite, F.col("val")).otherwise(empty).alias("val"), F.when(finite, 1.0).otherwise(0.0).alias("weight"))
        return Solutions(df, tuple(on), kind, f"{kind}000")

    out = {"amplitude000": table(g.select(*axes, amp.alias("val")).filter(F.col("val").isNotNull()), axes, "amplitude")}
    out["phase000"] = table(g.select(*axes, phase.alias("val")).filter(F.col("val").isNotNull()), axes, "phase")
    plain = {"Clock": "clock", "TEC": "tec", "RotationAngle": "rotation", "CommonRotationAngle": "rotation", "RotationMeasure": "rotationmeasure"}
    plain |= {f"{c}Scalar{w}": f"scalar{w.lower()}" for c in ("", "Common") for w in ("Phase", "Amplitude")}
    for kind in dict.fromkeys(plain.values()):
        x = base.filter(F.col("what").isin([w for w, k in plain.items() if k == kind]) & (n >= 2))
        # A rotation of 0 was never solved for.
        val = F.when(F.col("val") != 0, F.col("val")) if kind.startswith("rotation") else F.col("val")
        on = ["ant", "freq", "time"] if kind == "clock" else ["dir", "ant", "freq", "time"]
        freq = F.coalesce(F.col("freq").cast("double"), F.lit(0.0))
        x = x.select(F.coalesce(F.get("p", F.lit(2)), F.lit("pointing")).alias("dir"), F.element_at("p", 2).alias("ant"), freq.alias("freq"), "time", val.alias("val"))
        out[f"{kind}000"] = table(x.dropDuplicates(on), on, kind)
    return {k: t.densify() for k, t in out.items()} if dense else out


def parameter_grid(rows: DataFrame) -> DataFrame:
    """(name, time, freq, val) from stored grids: rows of (name, startx, endx, starty, endy, ntime, nfreq, values), values time by time.

    Coordinates are the middles of ``ntime`` and ``nfreq`` equal cells between the ends. Values that are missing at the end of the list are null.
    """
    x = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("ntime") - 1)).alias("__i")).select("*", F.explode(F.sequence(F.lit(0), F.col("nfreq") - 1)).alias("__j"))
    middle = lambda a, z, n, i: F.col(a) + (F.col(i) + 0.5) * (F.col(z) - F.col(a)) / F.col(n)
    return x.select("name", middle("starty", "endy", "ntime", "__i").alias("time"), middle("startx", "endx", "nfreq", "__j").alias("freq"), F.get("values", F.col("__i") * F.col("nfreq") + F.col("__j")).alias("val"))


def tables_to_parameters(amplitude: Solutions | None = None, phase: Solutions | None = None, polar: bool = False, others: Sequence[Solutions] = (), wanted: DataFrame | None = None) -> DataFrame:
    """(name, time[, freq], val) of tables as named parameters; values are null where flagged, for gains where either table is.

    Amplitude and phase become Real = A cos(phi) and Imag = A sin(phi), or with ``polar`` (or where one is missing) Ampl and Phase, under ``Gain`` or, with directions, ``DirectionalGain``
    unless the only direction is ``pointing``. ``others`` are clock, tec, rotation and rotationmeasure tables: ``Clock:ant``, ``TEC:ant[:dir]``, ``RotationAngle:ant[:dir]`` (``CommonRotationAngle:ant`` without
    directions) and ``RotationMeasure:ant[:dir]``; polarised clocks get the indices of a gain.

    ``wanted`` (name, start, end, freqs) selects entries: the cells of those names between start and end, 0.1 s more on either side, at
    the listed frequencies (null: all). Entries that no table has are left out; those of tables without frequencies are repeated for each.
    """
    index = lambda i: F.when(F.substring("pol", i, 1).isin("X", "R"), "0").otherwise("1")

    def named(t: Solutions, head: Column, part: Column | None, val: Column) -> DataFrame:
        words = [head, *([index(1), index(2)] if "pol" in t.axes else []), *([part] if part is not None else []), F.col("ant")]
        words += [F.when(F.col("dir") != "pointing", F.col("dir"))] if "dir" in t.axes else []  # nulls are passed over
        freq = F.col("freq").cast("double") if "freq" in t.axes else F.lit(None).cast("double")
        return t.df.select(F.concat_ws(":", *words).alias("name"), F.col("time"), freq.alias("freq"), val.alias("val"))

    kept = F.when(F.col("weight") != 0, F.col("val"))
    parts: list[DataFrame] = []
    gains = [t for t in (amplitude, phase) if t is not None]
    head = lambda t: F.when(F.col("dir") != "pointing", "DirectionalGain").otherwise("Gain") if "dir" in t.axes else F.lit("Gain")
    if len(gains) == 2 and not polar:
        on = [a for a in amplitude.axes if a in phase.axes]
        p = phase.df.select(*phase.axes, F.col("val").alias("__p"), F.col("weight").alias("__w"))
        both = amplitude.df.join(p, on)
        wide = amplitude if set(phase.axes) <= set(amplitude.axes) else phase
        ok = (F.col("weight") != 0) & (F.col("__w") != 0)
        for part, f in (("Real", F.cos), ("Imag", F.sin)):
            parts.append(named(replace(wide, df=both), head(wide), F.lit(part), F.when(ok, F.col("val") * f("__p"))))
    else:
        parts += [named(t, head(t), F.lit("Ampl" if t.is_amplitude else "Phase"), kept) for t in gains]
    heads = {"clock": "Clock", "tec": "TEC", "rotation": "RotationAngle", "rotationmeasure": "RotationMeasure"}
    for t in others:
        if t.kind not in heads:
            raise ValueError(f"{t.name}: a {t.kind} table has no parameters")
        name = "CommonRotationAngle" if t.kind == "rotation" and "dir" not in t.axes else heads[t.kind]
        parts.append(named(t, F.lit(name), None, kept))
    out = reduce(DataFrame.unionByName, parts)
    if wanted is not None:
        w = wanted.select(F.col("name"), F.col("start").cast("double").alias("__a"), F.col("end").cast("double").alias("__z"), F.col("freqs").cast("array<double>").alias("__f"))
        x = out.join(w, "name").filter(F.col("time").between(F.col("__a") - 0.1, F.col("__z") + 0.1))
        x = x.filter(F.col("freq").isNull() | F.col("__f").isNull() | F.array_contains("__f", F.col("freq")))
        one = F.when(F.col("freq").isNull() & F.col("__f").isNotNull(), F.col("__f")).otherwise(F.array("freq"))
        out = x.select("name", "time", F.explode(one).alias("freq"), "val")
    return out if wanted is not None or any("freq" in t.axes for t in [*gains, *others]) else out.drop("freq")


def directions(names: DataFrame, field: tuple[float, float], patches: DataFrame) -> DataFrame:
    """(name, dir) of the named directions: ``pointing`` is the field centre, a patch the mean of its components, others NaN."""
    mean = patches.groupBy("patch").agg(F.avg("ra").alias("ra"), F.avg("dec").alias("dec"))
    x = names.select("name").distinct().join(mean, F.col("name") == F.col("patch"), "left")
    ra = F.when(F.col("name") == "pointing", float(field[0])).otherwise(F.coalesce("ra", F.lit(float("nan"))))
    dec = F.when(F.col("name") == "pointing", float(field[1])).otherwise(F.coalesce("dec", F.lit(float("nan"))))
    return x.select("name", F.array(ra.cast("float"), dec.cast("float")).alias("dir"))


def from_gain_record(spark: SparkSession, path: str) -> dict[str, Solutions]:
    """Amplitude and phase tables from an .npz of solutions: ``Sols`` with t0, t1 and complex G[time, freq, ant, dir, 2, 2], ``FreqDomains``, ``StationNames``, ``SkyModel``/``ClusterCat``."""
    with np.load(path, allow_pickle=False) as z:
        sols, freqs = z["Sols"], z["FreqDomains"]
        ants = [a.decode() if isinstance(a, bytes) else str(a) for a in z["StationNames"]]
    times = (sols["t0"] + sols["t1"]) / 2
    if len(times) > 3:  # the first and last intervals may be cut
        step = float(np.median(np.diff(times[1:-1])))
        times[0], times[-1] = times[1] - step, times[-2] + step
    g = sols["G"]
    t, f, a, d, p, q = np.indices(g.shape)
    pdf = pd.DataFrame({"dir": [f"dir{i:03d}" for i in d.ravel()], "pol": ["XY"[i] + "XY"[j] for i, j in zip(p.ravel(), q.ravel(), strict=True)], "ant": np.array(ants)[a.ravel()],
                        "freq": freqs.mean(axis=1)[f.ravel()], "time": times[t.ravel()], "re": g.real.ravel().astype(float), "im": g.imag.ravel().astype(float)})
    x = spark.createDataFrame(pdf)
    axes = ("dir", "pol", "ant", "freq", "time")
    amp = x.select(*axes, F.hypot("re", "im").alias("val"), F.lit(1.0).alias("weight"))
    phase = x.select(*axes, F.atan2("im", "re").alias("val"), F.lit(1.0).alias("weight"))
    return {"amplitude000": Solutions(amp, axes, "amplitude", "amplitude000"), "phase000": Solutions(phase, axes, "phase", "phase000")}


def screen_weights(tec: Solutions, piercepoints: DataFrame, beta: float = 5 / 3, r0: float = 1.0) -> DataFrame:
    """(time, ant, dir, val): whitened electron content of a screen; per time the inverse of the structure matrix applied to the values.

    ``piercepoints`` has ant, dir, time and x, y, z in metres. The matrix of a time is as large as stations times directions.
    """
    x = tec.df.filter((F.col("weight") != 0) & F.col("val").isNotNull()).join(piercepoints.select("ant", "dir", "time", "x", "y", "z"), ["ant", "dir", "time"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        d2 = ((p[:, None] - p[None]) ** 2).sum(axis=-1)
        c = -((d2 / r0**2) ** (beta / 2)) / 2
        return pd.DataFrame({"time": pdf["time"], "ant": pdf["ant"], "dir": pdf["dir"], "val": np.linalg.pinv(c) @ pdf["val"].to_numpy(float)})

    kinds = dict(x.dtypes)
    return x.select("time", "ant", "dir", "val", "x", "y", "z").groupBy("time").applyInPandas(run, f"time {kinds['time']}, ant string, dir string, val double")
