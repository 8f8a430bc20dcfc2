"""Fits of electron content, clock, Faraday rotation and polarisation alignment; structure functions; new directions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solweave.functions import grids
from solweave.functions.scalar import LIGHT, TEC3_PHASE, TEC_PHASE, wrap
from solweave.functions.unwrapping import unwrap_plane, unwrap_trend
from solweave.model import Solutions, good

#: The noise (SEFD) of low-band stations at 100 frequencies.
LOW_BAND = np.linspace(28.5e6, 81e6, 100), np.array(
    [
        29940.300806269457, 29138.743157924673, 28486.373118639956, 27934.571276243045, 27261.12344516823, 26566.750939258804, 25971.96672786273, 25713.649299335677,
        25467.259992662184, 25140.84102040381, 24865.16674111212, 24670.080785550545, 24568.919344020906, 24499.060410427395, 24411.52557008937, 24352.84099484204,
        24281.30362751188, 24123.781872900636, 23981.72239664983, 23959.88451670274, 24300.454907727853, 24710.318004850422, 23861.103640991463, 23536.902960848907,
        23368.033448578546, 23375.4912213226, 22825.59852902077, 22888.574686251835, 22939.012907979475, 22792.013997004513, 22635.75546276593, 22343.81817033494,
        22010.908871950473, 21675.11043603119, 21260.23280379924, 20944.715008990217, 20763.100867166202, 20724.521479612555, 20725.24703336138, 20246.239703372674,
        20249.02352195448, 20421.57956576801, 20612.334368904216, 20524.60108698517, 20444.766531987058, 20296.096961977735, 20119.80530139794, 20006.52821604121,
        19724.91939080056, 19707.622884411874, 19632.802985681396, 19471.780747634348, 19303.111306540766, 19308.803889101328, 18965.543595891926, 18974.919315659663,
        18991.07079252672, 18973.871822828194, 19105.035458433736, 19409.545486370713, 19841.35252611626, 20147.50239689877, 20450.961112458946, 21023.282790437956,
        21257.87547095409, 21656.6502671062, 22195.869348363827, 22516.1856568403, 22569.826097678902, 22994.870466990884, 23603.991010539237, 24528.39877523586,
        24753.356313683937, 25418.184555420223, 26323.39058027763, 27222.600786585077, 28092.488828677604, 28693.24085220565, 29370.626520009806, 29758.762530211116,
        30233.813876156797, 30780.959875494424, 31362.89409735725, 31941.91655745387, 32567.73533922633, 33235.385382537905, 34083.04345233587, 35324.381512893764,
        36110.54891041759, 36779.27807149001, 37429.28695890053, 38310.19856693005, 39423.488538461, 39708.18633546015, 40552.20533173038, 41742.17174788208,
        43718.78037581652, 43666.883850263876, 44419.329396768495, 45138.269432353016,
    ]
)
#: (frequency, relative weight) of channels: the inverse of the noise, at most 1.
SENSITIVITY = np.stack([LOW_BAND[0], LOW_BAND[1].min() / LOW_BAND[1]], axis=1)


def _wrap(x: np.ndarray) -> np.ndarray:
    return np.mod(x + np.pi, 2 * np.pi) - np.pi


def refine(f: Callable[[np.ndarray], np.ndarray], centre: float, step: float, turns: int = 45) -> float:
    """A minimum within one grid step of ``centre``, by golden sections of an interval on which ``f`` has one valley."""
    a, b, g = centre - step, centre + step, (np.sqrt(5) - 1) / 2
    for _ in range(turns):
        c, d = b - g * (b - a), a + g * (b - a)
        fc, fd = f(np.array([c, d]))
        a, b = (a, d) if fc < fd else (c, b)
    return (a + b) / 2


def _difference_of_pols(table: Solutions) -> DataFrame:
    """(axes without pol, phi, weight): RR - LL, or XX - YY; flagged where either is."""
    pols = table.axis_values("pol", 1000)
    one, two = ("RR", "LL") if "RR" in pols else ("XX", "YY")
    keys = table.others(["pol"])
    pick = lambda p, c: F.max(F.when(F.col("pol") == p, F.col(c)))
    x = table.df.groupBy(*keys).agg(pick(one, "val").alias("a"), pick(two, "val").alias("b"), pick(one, "weight").alias("wa"), pick(two, "weight").alias("wb"))
    phi = F.col("a") - F.col("b")
    ok = (F.col("wa") != 0) & (F.col("wb") != 0) & phi.isNotNull()
    return x.select(*keys, F.when(ok, phi).alias("phi"), F.when(ok, F.least("wa", "wb")).otherwise(0.0).alias("weight"))


def _per_spectrum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per spectrum: arrays of frequencies and unflagged values. A spectrum has as many members as there are channels."""
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col("freq").cast("double").alias("f"), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("s")).select(*keys, F.col("s.f").alias("f"), F.col("s.v").alias("v"))


def faraday(table: Solutions, ref_ant: str = "", max_residual: float = 1.0, name: str = "rotationmeasure000") -> Solutions:
    """Rotation measure per station and time from phases of two polarisations, or from rotations.

    The sum over channels of |cos 2RM(c/f)^2 - cos phi| + |sin .. - sin ..| is minimised on a grid of 2e-4 between -0.5 and 0.5, then between
    grid points. With fewer than 20 unflagged channels the result is 0 with weight 0. The weight is 1 where the mean absolute residual is
    below ``max_residual`` (0: always). The reference station has 0 with weight 1.
    """
    axes = [a for a in table.axes if a not in ("pol", "freq")]
    if table.kind == "rotation":
        x = table.df.select(*axes, "freq", (2 * good()).alias("phi"))
    elif "pol" in table.axes and table.is_phase:
        x = _difference_of_pols(table)
    else:
        raise ValueError("phases with polarisations, or rotations")
    if ref_ant:
        ref = x.filter(F.col("ant") == ref_ant).select(*[a for a in axes if a != "ant"], "freq", F.col("phi").alias("__r"))
        x = x.join(ref, [a for a in axes if a != "ant"] + ["freq"], "left").withColumn("phi", F.col("phi") - F.col("__r"))
    grid = np.arange(-0.5, 0.5, 2e-4)

    @F.pandas_udf("struct<val:double,weight:double>")
    def fit(freqs: pd.Series, phis: pd.Series) -> pd.DataFrame:
        out, memo = np.zeros((len(freqs), 2)), {}
        for i, (f, phi) in enumerate(zip(freqs, phis, strict=True)):
            if f is None or len(f) < 20:
                continue
            lam = 2 * (LIGHT / np.asarray(f)) ** 2
            key = lam.tobytes()
            if key not in memo:
                memo.clear()
                memo[key] = np.cos(np.outer(grid, lam)), np.sin(np.outer(grid, lam))
            c, s = memo[key]
            phi = np.asarray(phi)
            best = float(grid[(np.abs(c - np.cos(phi)) + np.abs(s - np.sin(phi))).sum(axis=1).argmin()])
            cost = lambda rm, lam=lam, phi=phi: (np.abs(np.cos(np.outer(rm, lam)) - np.cos(phi)) + np.abs(np.sin(np.outer(rm, lam)) - np.sin(phi))).sum(axis=1)
            rm = refine(cost, best, 2e-4)
            resid = float(np.abs(_wrap(lam * rm - phi)).mean())
            out[i] = rm, float(max_residual == 0 or resid < max_residual)
        return pd.DataFrame(out, columns=["val", "weight"])

    y = _per_spectrum(x, axes, "phi").withColumn("r", fit("f", "v"))
    is_ref = F.col("ant") == ref_ant if ref_ant else F.lit(False)
    y = y.select(*axes, F.when(is_ref, 0.0).otherwise(F.col("r.val")).alias("val"), F.when(is_ref, 1.0).otherwise(F.col("r.weight")).alias("weight"))
    return Solutions(y, tuple(axes), "rotationmeasure", name)


def tec(
    table: Solutions, ref_ant: str = "", max_residual_flag: float = 2.5, max_residual_track: float = 1.0, sensitivity: Sequence[tuple[float, float]] | None = None, name: str = "tec000"
) -> Solutions:
    """Differential electron content per station (and direction) along time, from phases without polarisations.

    The weighted deviation of the wrapped residual is minimised on 1000 points between -0.5 and 0.5, or, after a
    fit with a residual below ``max_residual_track``, on 100 points within 0.05 of it, then between points and by Gauss-Newton steps. Channels count by
    ``sensitivity`` (frequency, relative weight: interpolated, 0 below and 1 above; by default that of low-band stations, and equal if empty). Fewer than 10
    channels, none that counts, or a residual of at least ``max_residual_flag`` (0: no
    check) give weight 0. The reference station has 0 with weight 1. The fit goes on in time, so a station and direction is one group.
    """
    if "pol" in table.axes:
        raise ValueError("average polarisations first")
    keys = [a for a in table.axes if a not in ("freq", "time")]
    x = table.df
    if ref_ant:
        on = [a for a in table.axes if a != "ant"]
        ref = x.filter(F.col("ant") == ref_ant).select(*on, F.col("val").alias("__r"), F.col("weight").alias("__w"))
        x = x.join(ref, on, "left").withColumn("val", F.col("val") - F.col("__r")).withColumn("weight", F.when(F.coalesce(F.col("__w"), F.lit(0.0)) == 0, 0.0).otherwise(F.col("weight")))
    table_f = np.array(SENSITIVITY if sensitivity is None else sensitivity, dtype=float).reshape(-1, 2)

    def best_of(cost: Callable, grid: np.ndarray, k: np.ndarray, phi: np.ndarray, w: np.ndarray) -> float:
        v = refine(cost, float(grid[cost(grid).argmin()]), float(grid[1] - grid[0]))
        for _ in range(5):
            v += float((w * w * k * _wrap(phi - k * v)).sum() / (w * w * k * k).sum())
        return v

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_ref = bool(ref_ant) and pdf["ant"].iloc[0] == ref_ant
        rows, last = [], None
        for t, part in pdf.sort_values("time", kind="stable").groupby("time", sort=False):
            ok = (part["weight"].to_numpy() != 0) & part["val"].notna().to_numpy()
            if is_ref:
                rows.append((t, 0.0, 1.0))
                continue
            if ok.sum() < 10:
                rows.append((t, 0.0, 0.0))
                continue
            nu, phi = part["freq"].to_numpy(float)[ok], part["val"].to_numpy(float)[ok]
            w = np.interp(nu, table_f[:, 0], table_f[:, 1], left=0.0, right=1.0) if len(table_f) else np.ones(len(nu))
            if not w.any():
                rows.append((t, 0.0, 0.0))
                continue
            w = w / w.mean()
            k = TEC_PHASE / nu
            cost = lambda v, k=k, phi=phi, w=w: np.std(w * _wrap(np.outer(v, k) - phi), axis=1)
            grid = np.linspace(-0.5, 0.5, 1000) if last is None else np.linspace(last - 0.05, last + 0.05, 100)
            v = best_of(cost, grid, k, phi, w)
            resid = float(cost(np.array([v]))[0])
            if last is not None and max_residual_track and resid >= max_residual_track:
                v = best_of(cost, np.linspace(-0.5, 0.5, 1000), k, phi, w)
                resid = float(cost(np.array([v]))[0])
            rows.append((t, v, float(max_residual_flag == 0 or resid < max_residual_flag)))
            last = v if max_residual_track == 0 or resid < max_residual_track else None
        out = pd.DataFrame(rows, columns=["time", "val", "weight"])
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "time", "val", "weight"]]

    kinds = dict(x.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "time"]) + ", val double, weight double"
    out = x.select(*keys, "time", "freq", "val", "weight").groupBy(*keys).applyInPandas(run, schema)
    return Solutions(out, (*keys, "time"), "tec", name)


def align_polarisations(table: Solutions, min_freq: float = 0.0, ref_ant: str = "", name: str = "phasediff") -> Solutions:
    """A delay and an offset per station (and direction) between two polarisations, as phases: 0 for the first, the negative fit for the second.

    The circular mean over time of the difference is fitted with d0*f + d1, weighted by its scatter, on a grid of d0 between -3e-9 and 3e-9
    and d1 between -5 and 5 and by a simplex from there. Stations without a usable channel get weight 0; the reference station 0 and weight 1.
    """
    axes = [a for a in table.axes if a != "pol"]
    keys = [a for a in axes if a not in ("time", "freq")]
    diff = _difference_of_pols(table).filter(F.col("freq") >= min_freq)
    mean = diff.filter(F.col("phi").isNotNull()).groupBy(*keys, "freq").agg(
        F.atan2(F.avg(F.sin("phi")), F.avg(F.cos("phi"))).alias("m"), (1 - F.hypot(F.avg(F.cos("phi")), F.avg(F.sin("phi")))).alias("cv"), F.count(F.lit(1)).cast("double").alias("n")
    )
    packed = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("freq").cast("double").alias("f"), "m", "cv", "n"))).alias("s"))

    @F.pandas_udf("struct<d0:double,d1:double>")
    def fit(f: pd.Series, m: pd.Series, cv: pd.Series, n: pd.Series) -> pd.DataFrame:
        d0, d1 = np.meshgrid(np.arange(-3e-9, 3e-9, 1e-10), np.arange(-5, 5, 0.1), indexing="ij")
        rows = []
        for ff, mm, vv, nn in zip(f, m, cv, n, strict=True):
            ff, mm = np.asarray(ff), np.asarray(mm)
            sd = np.sqrt(np.maximum(np.asarray(vv), 0)) / np.asarray(nn) ** 2
            w = np.where((sd > 0) & (mm != 0), 1 / np.where(sd > 0, sd, 1), 1e9)
            w = w / w.max()

            def cost(p: np.ndarray, ff: np.ndarray = ff, mm: np.ndarray = mm, w: np.ndarray = w) -> np.ndarray:
                model = p[..., :1] * ff + p[..., 1:]
                return (w * (np.abs(np.cos(model) - np.cos(mm)) + np.abs(np.sin(model) - np.sin(mm)))).sum(axis=-1)

            grid = np.stack([d0.ravel(), d1.ravel()], axis=1)
            rows.append(simplex(cost, grid[cost(grid).argmin()], np.array([1e-10, 0.1])))
        return pd.DataFrame(np.array(rows).reshape(-1, 2), columns=["d0", "d1"])

    fitted = packed.withColumn("r", fit("s.f", "s.m", "s.cv", "s.n")).select(*keys, "r.d0", "r.d1")
    pols = table.axis_values("pol", 1000)
    second = "LL" if "RR" in pols else "YY"
    x = table.df.join(fitted, keys, "left")
    is_ref = F.col("ant") == ref_ant if ref_ant else F.lit(False)
    model = -wrap(F.col("d0") * F.col("freq") + F.col("d1"))
    val = F.when(is_ref | (F.col("pol") != second), 0.0).otherwise(F.coalesce(model, F.lit(0.0)))
    weight = F.when(is_ref | F.col("d0").isNotNull(), 1.0).otherwise(0.0)
    return Solutions(x.select(*table.axes, val.alias("val"), weight.alias("weight")), table.axes, "phase", name)


def simplex(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, scale: np.ndarray, turns: int = 200) -> np.ndarray:
    """A local minimum by the simplex of Nelder and Mead; ``f`` takes an array of points."""
    pts = np.array([start, *(start + np.eye(len(start))[i] * scale for i in range(len(start)))])
    val = f(pts)
    for _ in range(turns):
        order = val.argsort()
        pts, val = pts[order], val[order]
        if np.all(np.ptp(pts, axis=0) <= 1e-9 * scale):
            break
        centre = pts[:-1].mean(axis=0)
        trial = centre + np.array([1.0, 2.0, 0.5, -0.5])[:, None] * (centre - pts[-1])
        got = f(trial)
        if got[0] < val[0]:
            k = 1 if got[1] < got[0] else 0
        elif got[0] < val[-2]:
            k = 0
        else:
            k = 2 if got[0] < val[-1] else 3
        if k < 2 or got[k] < min(got[0], val[-1]):
            pts[-1], val[-1] = trial[k], got[k]
        else:
            pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
            val = f(pts)
    return pts[val.argmin()]


def structure_pairs(table: Solutions, antennas: DataFrame, ant: str = "CS", ndiv: int = 1, unwrap: bool = False) -> DataFrame:
    """(ant1, ant2, part, dist, var, n): scatter over time of the phase difference of each pair of core stations, scaled to 150 MHz.

    Polarisations are combined as unit vectors (a cell counts if the first two are unflagged), differences are wrapped around their circular mean (with ``unwrap``,
    the phases of each station are unwrapped over frequency and time instead: its plane in one task) and averaged over frequency; the first times beyond a multiple of ``ndiv`` are dropped and the rest cut in ``ndiv`` parts. A cell is
    paired with those of the other matching stations, of which an array has a hundred at most.
    """
    keys = [a for a in table.axes if a != "pol"]
    x = table.df.filter(F.col("ant").rlike(ant))
    if "pol" in table.axes:
        x = x.groupBy(*keys).agg(F.sum(F.cos("val")).alias("re"), F.sum(F.sin("val")).alias("im"), F.min(F.abs("weight")).alias("weight"), F.count("val").alias("k"))
        x = x.filter((F.col("weight") != 0) & (F.col("k") > 0)).select(*keys, F.atan2("im", "re").alias("val"))
    else:
        x = x.filter((F.col("weight") != 0) & F.col("val").isNotNull()).select(*keys, "val")
    if unwrap:
        x = _unwrapped(x, table)
    times = x.select("time").distinct()
    n = times.count()
    per = max(1, n // ndiv)
    from pyspark.sql import Window

    ranked = times.withColumn("k", F.row_number().over(Window.orderBy("time")) - 1 - n % ndiv).filter(F.col("k") >= 0).select("time", F.floor(F.col("k") / per).alias("part"))
    x = x.join(ranked, "time")
    on = ["time", "freq"] if "freq" in keys else ["time"]
    a = x.select(*on, "part", F.col("ant").alias("ant1"), F.col("val").alias("v1"))
    b = x.select(*on, F.col("ant").alias("ant2"), F.col("val").alias("v2"))
    d = a.join(b, on).filter(F.col("ant1") < F.col("ant2")).withColumn("d", F.col("v1") - F.col("v2"))
    centre = d.groupBy("ant1", "ant2").agg(F.atan2(F.avg(F.sin("d")), F.avg(F.cos("d"))).alias("c"))
    if not unwrap:
        d = d.join(centre, ["ant1", "ant2"]).withColumn("d", wrap(F.col("d") - F.col("c")))
    line = d.groupBy("ant1", "ant2", "part", "time").agg(F.avg("d").alias("d"))
    nu = x.agg(F.avg(F.col("freq").cast("double")).alias("nu")).first().nu if "freq" in keys else 150e6
    var = line.groupBy("ant1", "ant2", "part").agg((F.var_pop("d") * (nu / 150e6) ** 2).alias("var"), F.count(F.lit(1)).alias("n"))
    pos = antennas.select("name", *[F.col("position")[i].cast("double").alias(c) for i, c in enumerate("xyz")]).dropna().dropDuplicates(["name"])
    p, q = (pos.select(F.col("name").alias(f"ant{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i in (1, 2))
    gap = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz")
    return var.join(p, "ant1").join(q, "ant2").select("ant1", "ant2", "part", F.sqrt(gap).alias("dist"), "var", "n")


def _unwrapped(x: DataFrame, table: Solutions) -> DataFrame:
    """Phases of each station (of the columns left in ``x``) around their circular mean, unwrapped over frequency and time."""
    plane = [a for a in ("freq", "time") if a in x.columns]
    keys = [c for c in x.columns if c not in (*plane, "val")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = np.angle(np.exp(1j * pdf["val"].to_numpy()).mean())
        pdf["val"] = _wrap(pdf["val"].to_numpy() - centre)
        val, place = grids.cube(pdf, plane, "val")
        if val.ndim == 2:
            flags = np.isnan(val)
            val = unwrap_plane(np.where(flags, 0.0, val), flags)
        else:
            val = unwrap_trend(val)
        pdf["val"] = val[place]
        return pdf

    kinds = dict(x.dtypes)
    return x.groupBy(*keys).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in x.columns))


def structure_function(pairs: DataFrame) -> DataFrame:
    """(part, beta, offset, r_diff, pairs): the power law of the scatter over distance, and the distance at which it is 1."""
    x = pairs.filter((F.col("var") > 0) & (F.col("dist") > 0)).select("part", F.log10("var").alias("y"), F.log10("dist").alias("x"))
    fit = x.groupBy("part").agg(F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("offset"), F.count(F.lit(1)).alias("pairs"))
    return fit.select("part", "beta", "offset", F.pow(F.lit(10.0), F.try_divide(-F.col("offset"), F.col("beta"))).alias("r_diff"), "pairs")


def direction_weights(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weights (wanted x known) of multiquadric interpolation between directions in radians: they depend on the directions alone."""
    vec = lambda d: np.stack([np.cos(d[:, 1]) * np.cos(d[:, 0]), np.cos(d[:, 1]) * np.sin(d[:, 0]), np.sin(d[:, 1])], axis=1)
    a, b = vec(known), vec(wanted)
    edge = np.ptp(a, axis=0)
    edge = edge[edge > 0]
    eps = (np.prod(edge) / len(a)) ** (1 / len(edge))
    dist = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=-1))
    phi = lambda r: np.sqrt((r / eps) ** 2 + 1)
    return np.linalg.solve(phi(dist(a, a)).T, phi(dist(b, a)).T).T


def interpolate_directions(table: Solutions, sources: DataFrame, wanted: Sequence[tuple[float, float]], prefix: str = "interp_") -> tuple[Solutions, DataFrame]:
    """Add directions (RA and Dec in degrees) between at least ten known ones; returns the table and the added sources.

    Amplitudes are made positive, phases interpolated by their unit vectors, others linearly. A new cell is flagged if one of the old
    directions is flagged or missing there. The weights are solved once on the driver, from a few hundred directions; the cells are one join and sum.
    """
    rows = sources.select("name", "dir").dropna().join(table.df.select(F.col("dir").alias("name")).distinct(), "name", "left_semi").orderBy("name").limit(10_001).collect()
    if not 10 <= len(rows) <= 10_000:
        raise ValueError("between 10 and 10,000 known directions")
    new = np.radians(np.asarray(wanted, dtype=float).reshape(-1, 2))
    m = direction_weights(np.array([[float(r.dir[0]), float(r.dir[1])] for r in rows]), new)
    names = [f"{prefix}{i:03d}" for i in range(len(new))]
    spark = table.df.sparkSession
    flat = [(r.name, names[i], float(m[i, j])) for j, r in enumerate(rows) for i in range(len(new))]
    weights = spark.createDataFrame(flat, "dir string, new string, m double")
    keys = table.others(["dir"])
    x = table.df.join(weights, "dir")
    part = lambda c: F.sum(F.col("m") * c)
    ok = F.when((F.min(F.abs("weight")) > 0) & (F.count("val") == len(rows)), 1.0).otherwise(0.0)
    if table.is_phase:
        val = F.atan2(part(F.sin("val")), part(F.cos("val")))
    else:
        val = part(F.col("val"))
    out = x.groupBy(*keys, "new").agg((F.abs(val) if table.is_amplitude else val).alias("val"), ok.alias("weight")).withColumnRenamed("new", "dir")
    both = table.df.select(*table.axes, "val", "weight").unionByName(out.select(*table.axes, "val", "weight"))
    added = spark.createDataFrame([(n, [float(x) for x in d]) for n, d in zip(names, new, strict=True)], "name string, dir array<float>")
    return table.put(both), added


def clock_tec(
    table: Solutions, fit_third: bool = False, combine_pols: bool = False, flag_channels: bool = True, cut: float = 5.0, chi2_cut: float = 3000.0, names: Sequence[str] = ("tec000", "clock000", "phase_offset000", "tec3rd000"),
    antennas: DataFrame | None = None, remove_wraps: bool = True, circular: bool = False, reverse: bool = False, invert_offset: bool = False,
) -> dict[str, Solutions]:
    """Separate phases of each station and polarisation into clock (seconds), electron content (and its third-order term) and a constant offset.

    Phases are taken relative to the vector sum of the inner core (CS002..CS007, else the first station). Channels whose scatter is ``cut`` times the usual one
    are left out. Along time each spectrum is unwrapped from the prediction of the one before, or started from a search over
    whole turns, then solved by least squares; a misfit above ``chi2_cut`` (square degrees per channel) starts a new search and, if it remains, flags. Turns
    that differ between neighbours in time are taken out. Weights are 0 where there is no fit.

    With ``remove_wraps`` and the positions of ``antennas``, whole turns of stations are found from a linear screen of electron content over longitude and latitude
    (``screen_turns``), and all spectra are solved again from there; then only this second fit is held to ``chi2_cut``. The stations of a polarisation are one group in it.
    Without positions each station stands alone. Where the first station isn't a low-band one, a first clock of stations off the core is found from the mean spectrum of a hundred
    times from the middle on (``start_clock``) and taken off before. ``reverse`` goes back in time, ``invert_offset`` turns the sign of the offsets. ``circular`` with ``combine_pols`` adds the phases of both polarisations, searches twice as far and halves the results.
    """
    axes = [a for a in ("ant", "pol") if a in table.axes]
    x = table.df.filter((F.col("weight") != 0) & F.col("val").isNotNull())
    if "pol" in table.axes:
        pols = table.axis_values("pol", 1000)
        if len(pols) == 4:
            x = x.filter(F.col("pol").isin(pols[0], pols[3]))
        if combine_pols and not circular:
            x = x.groupBy("ant", "time", "freq").agg(F.atan2(F.sum(F.sin("val")), F.sum(F.cos("val"))).alias("val"))
            axes = ["ant"]
    rest = [a for a in axes if a != "ant"]
    inner = x.filter(F.col("ant").rlike("^CS00[2-7]|Super"))
    if not inner.limit(1).count():
        first = x.agg(F.min("ant").alias("a")).first().a
        inner = x.filter(F.col("ant") == first)
    ref = inner.groupBy(*rest, "time", "freq").agg(F.atan2(F.sum(F.sin("val")), F.sum(F.cos("val"))).alias("__r"))
    x = x.join(ref, [*rest, "time", "freq"]).withColumn("val", wrap(F.col("val") - F.col("__r")))
    twice = circular and combine_pols and "pol" in table.axes
    if twice:
        both = x.groupBy("ant", "time", "freq").agg(F.sum("val").alias("val"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == min(len(pols), 2))
        x, axes, rest = both.withColumn("val", wrap(F.col("val"))), ["ant"], []
    part_of = 2.0 if twice else 1.0
    if flag_channels:
        spread = x.groupBy(*rest, "ant", "freq").agg((1 - F.hypot(F.avg(F.cos("val")), F.avg(F.sin("val")))).alias("s")).groupBy("freq").agg(F.avg("s").alias("s"))
        usual = spread.agg(F.avg("s").alias("m"))
        bad = spread.join(F.broadcast(usual), how="cross").filter(F.col("s") >= cut * F.col("m"))
        x = x.join(bad.select("freq"), "freq", "left_anti")

    first_clock = _first_clocks(x, axes) if "LBA" not in (x.agg(F.min("ant").alias("a")).first().a or "") else None
    if first_clock is not None:
        x = x.join(first_clock, axes, "left").withColumn("__c", F.coalesce("__c", F.lit(0.0)))
        x = x.withColumn("val", wrap(F.col("val") - 2e-9 * np.pi * F.col("__c") * F.col("freq").cast("double"))).drop("__c")

    def solver(cut_at: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            begin = pdf[["__tec", "__clock", "__third"][: 2 + fit_third]].iloc[0].to_numpy(float) if "__tec" in pdf else None
            begin = None if begin is None or np.isnan(begin).any() else begin
            shift = float(np.nan_to_num(pdf["__shift"].iloc[0])) if "__shift" in pdf else 0.0
            rows, last = [], begin
            for t, part in pdf.sort_values(["time", "freq"], ascending=[not reverse, True], kind="stable").groupby("time", sort=False):
                nu, phi = part["freq"].to_numpy(float), part["val"].to_numpy(float) + shift
                if len(nu) < 8:
                    rows.append((t, None, None, None, None, 0.0))
                    continue
                a = np.stack([TEC_PHASE / nu, 2e-9 * np.pi * nu] + ([TEC3_PHASE / nu**3] if fit_third else []), axis=1)
                # Turns that are settled aren't looked for again.
                p, chi2 = _solve_turns(a, nu, phi, last, part_of, 1 if begin is None else 0)
                if last is not begin and chi2 > cut_at:
                    p, chi2 = _solve_turns(a, nu, phi, begin, part_of, 0)
                good_fit = chi2 <= cut_at
                rows.append((t, p[0], p[1], p[2] if fit_third else 0.0, 0.0, float(good_fit)))
                last = p if good_fit else begin
            out = pd.DataFrame(rows, columns=["time", "tec", "clock", "third", "offset", "weight"])
            for c in axes:
                out[c] = pdf[c].iloc[0]
            return out[[*axes, "time", "tec", "clock", "third", "offset", "weight"]]

        return run

    kinds = dict(x.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*axes, "time"]) + ", tec double, clock double, third double, offset double, weight double"
    screened = remove_wraps and antennas is not None
    spectra = x.select(*axes, "time", "freq", "val")
    fitted = spectra.groupBy(*axes).applyInPandas(solver(FIRST_CUT if screened else chi2_cut), schema)
    if screened:
        nus = np.array([float(r.freq) for r in x.select("freq").distinct().orderBy("freq").collect()])  # the channels
        steps = np.linalg.pinv(np.stack([TEC_PHASE / nus, 2e-9 * np.pi * nus], axis=1)) @ np.full(len(nus), 2 * np.pi)
        pos = antennas.select(F.col("name").alias("ant"), *[F.col("position")[k].cast("double").alias(f"__{c}") for k, c in enumerate("xyz")]).dropna().dropDuplicates(["ant"])

        def starts(pdf: pd.DataFrame) -> pd.DataFrame:
            tecs = pdf.pivot(index="time", columns="ant", values="tec")
            firsts = pdf.sort_values("time").groupby("ant").first().reindex(tecs.columns)
            turns, shift = screen_turns(tecs.to_numpy(float), firsts[["__x", "__y", "__z"]].to_numpy(float), float(steps[0]))
            out = pd.DataFrame({"ant": tecs.columns, "__tec": firsts["tec"].to_numpy() + turns * steps[0], "__clock": firsts["clock"].to_numpy() + turns * steps[1], "__third": firsts["third"].to_numpy(), "__shift": shift})
            for c in rest:
                out[c] = pdf[c].iloc[0]
            return out[[*axes, "__tec", "__clock", "__third", "__shift"]]

        kept = fitted.filter(F.col("weight") > 0).join(pos, "ant", "left")
        begin = kept.groupBy(*rest).applyInPandas(starts, ", ".join(f"`{c}` {kinds[c]}" for c in axes) + ", __tec double, __clock double, __third double, __shift double")
        fitted = spectra.join(begin, axes, "left").groupBy(*axes).applyInPandas(solver(chi2_cut), schema)
    grid = table.df.select(*axes, "time").distinct()
    fitted = grid.join(fitted, [*axes, "time"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    full = (*axes, "time")
    model = x.join(fitted.filter(F.col("weight") > 0), [*axes, "time"])
    nu = F.col("freq").cast("double")
    resid = F.col("val") - TEC_PHASE * F.col("tec") / nu - 2e-9 * np.pi * F.col("clock") * nu
    off = model.groupBy(*axes).agg((F.atan2(F.sum(F.sin(resid)), F.sum(F.cos(resid))) / (-part_of if invert_offset else part_of)).alias("val"))
    if first_clock is not None:
        fitted = fitted.join(first_clock, axes, "left").withColumn("clock", F.col("clock") + F.coalesce("__c", F.lit(0.0)))
    out = {
        names[0]: Solutions(fitted.select(*full, (F.col("tec") / part_of).alias("val"), "weight"), full, "tec", names[0]),
        names[1]: Solutions(fitted.select(*full, (F.col("clock") * 1e-9 / part_of).alias("val"), "weight"), full, "clock", names[1]),
    }
    stations = table.df.select(*axes).distinct().join(off, axes, "left")
    out[names[2]] = Solutions(stations.select(*axes, "val", F.when(F.col("val").isNotNull(), 1.0).otherwise(0.0).alias("weight")), tuple(axes), "phase_offset", names[2])
    if fit_third:
        out[names[3]] = Solutions(fitted.select(*full, (F.col("third") / part_of).alias("val"), "weight"), full, "tec3rd", names[3])
    return out


#: Times from the middle on whose mean spectrum tells a first clock.
FIRST_TIMES = 100


def start_clock(nu: np.ndarray, phi: np.ndarray) -> float:
    """The clock (ns) that a spectrum of wrapped phases follows best: of delays from -25 to 26 turns across the band, a tenth of a turn apart, the one that
    leaves the phases closest together, and then by a straight line through what it leaves."""
    trial = np.arange(-25, 26, 0.1) * 1e9 / np.ptp(nu)
    left = np.exp(1j * (phi - 2e-9 * np.pi * trial[:, None] * nu)).mean(axis=1)
    best = int(np.abs(left).argmax())
    rest = _wrap(phi - 2e-9 * np.pi * trial[best] * nu - np.angle(left[best]))
    return float(trial[best] + np.polyfit(nu - nu.mean(), rest, 1)[0] / (2e-9 * np.pi))


def _first_clocks(x: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axes, __c): the first clock of each station off the core."""
    far = x.filter(~F.col("ant").contains("CS"))
    middle = x.select("time").distinct().agg(F.percentile_approx("time", 0.5).alias("t")).first().t
    times = x.select("time").distinct().filter(F.col("time") >= middle).orderBy("time").limit(FIRST_TIMES)
    mean = far.join(times, "time").groupBy(*axes, "freq").agg(F.atan2(F.sum(F.sin("val")), F.sum(F.cos("val"))).alias("m"))
    packed = _per_spectrum(mean, axes, "m")

    @F.pandas_udf("double")
    def fit(nu: pd.Series, phi: pd.Series) -> pd.Series:
        return pd.Series([start_clock(np.asarray(f), np.asarray(p)) if len(f) > 2 else 0.0 for f, p in zip(nu, phi, strict=True)], dtype=float)

    return packed.select(*axes, fit("f", "v").alias("__c"))


#: Misfit (square degrees per channel) allowed before the turns of the stations are settled.
FIRST_CUT = 30_000.0

#: Degrees from the first station within which electron content is taken for a plane.
NEAR = 0.5


def screen_turns(tec: np.ndarray, pos: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole turns that bring each station onto a linear screen of electron content, and the phase that is left over.

    ``tec`` is (times, stations), NaN where there is no fit; ``step`` is the electron content of a turn. At each time a plane through the first station with a position is fitted
    to those within ``NEAR``; the mean distance from it over the times that fit well is rounded to turns, twice. Other stations keep their turns.
    """
    turns, shift = np.zeros(tec.shape[1]), np.zeros(tec.shape[1])
    placed = np.flatnonzero(~np.isnan(pos).any(axis=1))
    if not len(placed):
        return turns, shift
    first = placed[0]
    at = np.degrees(np.stack([np.arctan2(pos[:, 1], pos[:, 0]), np.arctan2(pos[:, 2], np.hypot(pos[:, 0], pos[:, 1]))], axis=1))
    at = at - at[first]
    near = np.hypot(at[:, 0], at[:, 1]) <= NEAR
    x = np.where(near[:, None], at, 0.0)
    for _ in range(2):
        y = tec - tec[:, [first]] + step * (turns - turns[first])
        ok = ~np.isnan(y) & near
        y = np.where(ok, y, 0.0)
        slope = np.einsum("tij,tj->ti", np.linalg.pinv(np.einsum("ts,si,sj->tij", ok, x, x)), y @ x)
        off = np.where(ok, y - slope @ x.T, 0.0)
        # A station that is off at all times doesn't make a time bad.
        usual = off.sum(axis=0) / np.maximum(ok.sum(axis=0), 1)
        chi2 = np.where(ok.any(axis=1), (np.where(ok, off - usual, 0.0) ** 2).sum(axis=1) / tec.shape[1], np.nan)
        if np.isnan(chi2).all():
            break
        fine = chi2 <= np.nanmean(chi2) * (1 + 1e-9)
        fine = chi2 <= np.nanmean(chi2[fine]) * (1 + 1e-9)
        n = ok[fine].sum(axis=0)
        shift = -np.where(n > 0, off[fine].sum(axis=0) / np.maximum(n, 1), usual) * 2 * np.pi / step
        more = np.round(shift / (2 * np.pi))
        turns = turns + more
        if not more.any():
            break
    return turns, shift


def _solve_turns(a: np.ndarray, nu: np.ndarray, phi: np.ndarray, start: np.ndarray | None, reach_of: float = 1.0, turns: int = 1) -> tuple[np.ndarray, float]:
    """Least squares of a spectrum whose whole turns are unknown: from a prediction, or from the best of many starts."""
    fit = np.linalg.pinv(a)

    def polish(p: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(8):
            off = _wrap(phi - a @ p)
            step = fit @ off
            p = p + step
            if np.abs(a @ step).max() < 1e-6:
                break
        return p, float(np.degrees(1) ** 2 * (_wrap(phi - a @ p) ** 2).mean())

    # The change of the parameters that is closest to a whole turn in all channels.
    turn_step = fit @ np.full(len(nu), 2 * np.pi)

    def beside(p: np.ndarray, reach: int) -> tuple[np.ndarray, float]:
        return min((polish(p + n * turn_step) for n in range(-reach, reach + 1)), key=lambda r: r[1])

    if start is not None:
        return beside(np.asarray(start, dtype=float), turns)
    # A grid over electron content; for each the delay follows from the transform of the derotated spectrum.
    tecs = np.arange(-1.0 * reach_of, 1.0001 * reach_of, 0.01)
    delays = np.arange(-200.0 * reach_of, 200.0 * reach_of, 0.25 / (np.ptp(nu) * 1e-9) / 2 + 0.05)
    turn = np.exp(-1j * np.outer(delays, 2e-9 * np.pi * nu))
    spectra = np.exp(1j * (phi - np.outer(tecs, a[:, 0])))
    power = (spectra @ turn.T).real
    best = np.argsort(power.ravel())[::-1][:60]
    starts = [np.r_[tecs[k // len(delays)], delays[k % len(delays)], np.zeros(a.shape[1] - 2)] for k in best]
    return beside(min((polish(s) for s in starts), key=lambda r: r[1])[0], 3)
