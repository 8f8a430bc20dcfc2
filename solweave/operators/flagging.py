"""Outliers against a smooth model, growth of flags, and bad stations."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solweave.functions import grids
from solweave.functions import segments as S
from solweave.functions.scalar import log10_positive, wrap
from solweave.model import Solutions, good, with_stats

log = logging.getLogger(__name__)


def _kernel_schema(table: Solutions) -> tuple[list[str], str]:
    cols = [*table.axes, "val", "weight"]
    return cols, ", ".join(f"`{c}` {dict(table.df.dtypes)[c]}" for c in cols)


def _wrap(x: np.ndarray) -> np.ndarray:
    return np.mod(x + np.pi, 2 * np.pi) - np.pi


def _trend(x: np.ndarray, w: np.ndarray, order: Sequence[int], mode: str, coords: Sequence[np.ndarray]) -> np.ndarray:
    """A smooth model of the cube: running medians, a polynomial, or a cubic spline with ``order`` intervals per axis."""
    ok = (w > 0) & ~np.isnan(x)
    y = np.where(ok, x, np.nan)
    if not ok.any():
        return np.full(x.shape, np.nan)
    if mode == "smooth":
        if all(o == 0 for o in order):
            return np.full(x.shape, np.nanmedian(y))
        return grids.running_median(y, order)
    unit = [(c - c.min()) / (np.ptp(c) or 1.0) for c in coords]
    if mode == "poly":
        basis = [np.vander(u, o + 1, increasing=True) for u, o in zip(unit, order, strict=True)]
        weight = np.sqrt(w) if x.ndim == 1 else np.ones(x.shape)
    elif mode == "spline":
        basis = [spline_basis(u, max(1, o)) for u, o in zip(unit, order, strict=True)]
        weight = np.sqrt(w)
    else:
        raise ValueError(f"unknown mode {mode}")
    a = basis[0] if x.ndim == 1 else np.einsum("ip,jq->ijpq", *basis).reshape(*x.shape, -1)
    coef = np.linalg.lstsq(a[ok] * weight[ok][:, None], x[ok] * weight[ok], rcond=None)[0]
    return a @ coef


def spline_basis(u: np.ndarray, intervals: int, knots: Sequence[float] | None = None) -> np.ndarray:
    """Cubic B-splines on 0..1 by the recursion of Cox and de Boor, on equal intervals or given inner knots."""
    inner = np.linspace(0, 1, intervals + 1) if knots is None else np.asarray(knots, dtype=float)
    t = np.r_[[inner[0]] * 3, inner, [inner[-1]] * 3]
    x = np.clip(u, inner[0], inner[-1])
    last = np.flatnonzero(t[:-1] < t[1:])[-1]
    b = ((t[:-1] <= x[:, None]) & (x[:, None] < t[1:])).astype(float)
    b[x == t[-1], last] = 1.0
    for k in (1, 2, 3):
        left, right = t[k:-1] - t[: -k - 1], t[k + 1 :] - t[1:-k]
        wl = np.divide(x[:, None] - t[: -k - 1], left, out=np.zeros((len(x), len(left))), where=left > 0)
        wr = np.divide(t[k + 1 :] - x[:, None], right, out=np.zeros((len(x), len(right))), where=right > 0)
        b = wl * b[:, :-1] + wr * b[:, 1:]
    return b


def flag_cube(
    val: np.ndarray, weight: np.ndarray, coords: Sequence[np.ndarray], order: Sequence[int], kind: str, mode: str, cycles: int,
    max_rms: float, max_rms_noise: float, fix_rms: float, fix_rms_noise: float, window_noise: int, replace: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """New values and weights of one group."""
    w = np.where(np.isnan(val), 0.0, weight).copy()
    if not (w > 0).any():
        return val, weight
    if kind == "phase":
        centre = np.angle(np.nansum(w * np.exp(1j * val)))
        x = _wrap(val - centre)
    elif kind == "amplitude":
        x = np.log10(np.where(val > 0, val, np.nan))
        w[np.isnan(x)] = 0.0
    else:
        x = val
    first, model = w.copy(), None
    for _ in range(cycles):
        model = _trend(x, w, order, mode, coords)
        with np.errstate(invalid="ignore"):
            off = _wrap(x - model) if kind == "phase" else x - model
            resid = np.where(w > 0, off, np.nan)
            limit = fix_rms or max_rms * grids.mad_sigma(resid)
            bad = np.abs(off) > limit if limit > 0 else np.zeros(x.shape, dtype=bool)
            if max_rms_noise or fix_rms_noise:
                noise = _local_rms(resid, window_noise)
                top = fix_rms_noise or max_rms_noise * 1.4826 * np.nanmedian(noise)
                bad |= noise > top
        new = bad & (w > 0)
        w[new] = 0.0
        if not new.any():
            break
    out = val.copy()
    if replace and model is not None:
        fresh = (first > 0) & (w == 0) & ~np.isnan(model)
        back = _wrap(model + centre) if kind == "phase" else 10**model if kind == "amplitude" else model
        out[fresh] = back[fresh]
        w[fresh] = first[fresh]
    return out, w


def _local_rms(x: np.ndarray, size: int) -> np.ndarray:
    """Scatter within ``size`` cells on every axis, mirrored at the edges."""
    half = [min(size // 2, n - 1) for n in x.shape]
    w = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(h, h) for h in half], mode="reflect"), tuple(2 * h + 1 for h in half))
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return np.nanstd(w, axis=tuple(range(x.ndim, 2 * x.ndim)))


def flag(
    table: Solutions, axes: Sequence[str], order: Sequence[int], cycles: int = 5, max_rms: float = 5.0, max_rms_noise: float = 0.0, fix_rms: float = 0.0,
    fix_rms_noise: float = 0.0, window_noise: int = 11, replace: bool = False, preflag_defaults: bool = False, mode: str = "smooth",
) -> Solutions:
    """Flag cells far from a smooth model along one or two axes, again and again until nothing new is found.

    The model is a running median over ``order`` cells (0: the whole axis), a polynomial of degrees ``order``, or a
    spline with ``order`` intervals. A cell is bad if its residual is above ``max_rms`` times 1.4826 times the median absolute
    residual (or above ``fix_rms``), or if the scatter around it is above ``max_rms_noise`` times the usual one (or ``fix_rms_noise``). Phases are
    judged around their weighted circular mean, amplitudes by decimal logarithm (0 or less is bad). With ``replace`` the
    cells found get the model's value and keep their weight. Null values get weight 0. The cells of a group (coordinates off ``axes``) are judged in one task.
    """
    if len(axes) not in (1, 2) or len(order) != len(axes):
        raise ValueError("one or two axes, and an order for each")
    keys = table.others(axes)
    kind = "phase" if table.is_phase else "amplitude" if table.is_amplitude else "plain"
    df = table.df
    if preflag_defaults:
        df = df.withColumn("weight", F.when(F.col("val") == table.default, 0.0).otherwise(F.col("weight")))
    if len(axes) == 1 and mode == "smooth" and not (max_rms_noise or fix_rms_noise):
        return table.put(_flag_lines(df, keys, table, axes[0], order[0], kind, cycles, max_rms, fix_rms, replace))
    names, limits = list(axes), (cycles, max_rms, max_rms_noise, fix_rms, fix_rms_noise, window_noise, replace)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        val, place = grids.cube(pdf, names, "val")
        weight, _ = grids.cube(pdf, names, "weight")
        coords = [np.unique(pdf[a].to_numpy()) for a in names]
        coords = [np.arange(len(c), dtype=float) if c.dtype.kind not in "if" else c.astype(float) for c in coords]
        new, w = flag_cube(val, np.nan_to_num(weight), coords, order, kind, mode, *limits)
        pdf["val"], pdf["weight"] = new[place], w[place]
        return pdf

    cols, schema = _kernel_schema(table)
    out = df.select(*cols).groupBy(*keys).applyInPandas(run, schema)
    return table.put(out.withColumn("val", F.when(~F.isnan("val"), F.col("val"))))


def _flag_lines(df: DataFrame, keys: Sequence[str], table: Solutions, axis: str, order: int, kind: str, cycles: int, max_rms: float, fix_rms: float, replace: bool) -> DataFrame:
    """The rule of ``flag_cube`` for running medians along one axis, for many groups at once on flat arrays."""

    def work(rows: pa.Table, seg: np.ndarray) -> Iterator[pa.RecordBatch]:
        val, weight = S.floats(rows["val"]), np.nan_to_num(S.floats(rows["weight"]))
        n_seg = int(seg[-1]) + 1
        w = np.where(np.isnan(val), 0.0, weight)
        centre = np.zeros(n_seg)
        if kind == "phase":
            known = np.nan_to_num(val)
            centre = np.arctan2(np.bincount(seg, w * np.sin(known), n_seg), np.bincount(seg, w * np.cos(known), n_seg))
            x = _wrap(val - centre[seg])
        elif kind == "amplitude":
            with np.errstate(invalid="ignore", divide="ignore"):
                x = np.log10(np.where(val > 0, val, np.nan))
            w[np.isnan(x)] = 0.0
        else:
            x = val
        idle = np.bincount(seg, w > 0, n_seg) == 0  # nothing to judge: left as they are
        first, model = w.copy(), np.full(len(x), np.nan)
        for _ in range(cycles):
            y = np.where(w > 0, x, np.nan)
            model = S.medians(y, seg, n_seg)[seg] if order == 0 else S.running_median(y, seg, order // 2, ahead=order - 1 - order // 2)
            off = np.abs(_wrap(x - model) if kind == "phase" else x - model)
            limit = np.full(n_seg, fix_rms) if fix_rms else max_rms * 1.4826 * S.medians(np.where(w > 0, off, np.nan), seg, n_seg)
            with np.errstate(invalid="ignore"):
                new = (w > 0) & (limit[seg] > 0) & (off > limit[seg])
            if not new.any():
                break
            w[new] = 0.0
        out = val.copy()
        if replace:
            fresh = (first > 0) & (w == 0) & ~np.isnan(model)
            back = _wrap(model + centre[seg]) if kind == "phase" else 10**model if kind == "amplitude" else model
            out[fresh], w[fresh] = back[fresh], first[fresh]
        w = np.where(idle[seg], weight, w)
        for name, data in (("val", pa.array(out, from_pandas=True)), ("weight", pa.array(w))):
            rows = rows.set_column(rows.column_names.index(name), name, data)
        yield from rows.combine_chunks().to_batches()

    cols, schema = _kernel_schema(table)
    lines = df.select(*cols).repartition(*keys) if keys else df.select(*cols).coalesce(1)
    # Rows of one group may straddle batches; without keys all rows are one group.
    group = list(keys)
    lines = lines.sortWithinPartitions(*keys, axis)
    if not group:
        lines = lines.withColumn("__all", F.lit(1))
        schema, group = schema + ", __all int", ["__all"]
    return lines.mapInArrow(lambda batches: S.whole_groups(batches, group, work), schema)


def extend_flags(table: Solutions, axes: Sequence[str], size: Sequence[int], percent: float = 50.0, cycles: int = 3) -> Solutions:
    """Flag cells around which more than ``percent`` of a box of ``size`` cells (0: all) is flagged, until that settles.

    Cells that are missing from the grid of a group count as flagged; beyond its edges the grid is mirrored. Null values count by their weight.
    """
    keys, names = table.others(axes), list(axes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        weight, place = grids.cube(pdf, names, "weight")
        bad = np.isnan(weight) | (weight == 0)
        for _ in range(cycles):
            grown = bad | (grids.box_share(bad, size) > percent / 100 + 1e-12)
            if (grown == bad).all():
                break
            bad = grown
        pdf["weight"] = np.where(bad[place], 0.0, pdf["weight"])
        return pdf

    cols, schema = _kernel_schema(table)
    return table.put(table.df.select(*cols).groupBy(*keys).applyInPandas(run, schema))


def flag_stations_relative(table: Solutions, sigma: float = 5.0, threshold: float = 0.5, skip: Sequence[str] = (), skip_international: bool = False) -> Solutions:
    """Flag stations (of amplitudes) that stand out from the others in too many cells.

    In each cell the mean and population deviation over unflagged stations are taken; a station is flagged altogether if its unflagged cells further than ``sigma``
    deviations away are more than the share ``threshold`` of all its cells, flagged ones included. Stations in ``skip``, and with ``skip_international`` those that are neither core nor
    remote, are left alone.
    """
    if not table.is_amplitude:
        raise ValueError("relative flagging works for amplitudes")
    keys = table.others(["ant"])
    x = table.df.withColumn("__v", good())
    stats = x.groupBy(*keys).agg(F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s"))
    x = with_stats(x, keys, stats).withColumn("__bad", F.abs(F.col("__v") - F.col("__m")) > sigma * F.col("__s"))
    share = x.groupBy("ant").agg(F.avg(F.coalesce(F.col("__bad"), F.lit(False)).cast("double")).alias("__share"))
    dead = share.filter(F.col("__share") > threshold)
    if skip:
        dead = dead.filter(~F.col("ant").isin(list(skip)))
    if skip_international:
        dead = dead.filter(F.col("ant").rlike("CS|RS"))
    out = table.df.join(dead.select("ant", F.lit(True).alias("__dead")), "ant", "left")
    return table.put(out.withColumn("weight", F.when(F.col("__dead"), 0.0).otherwise(F.col("weight"))))


def flag_stations_residual(
    table: Solutions, least: float = 0.0, most: float = 0.5, sigma: float = 5.0, max_std: float | None = None, cycles: int = 5
) -> Solutions:
    """Flag cells of each station and polarisation (and direction) whose residual is large, or the station if they are many.

    Phases are taken off their circular mean; amplitudes as decimal logarithms. The deviation is the root of the weighted mean square, at most ``max_std``
    (0.1 for phases, 0.01 for amplitudes); it is taken anew without the bad cells up to ``cycles`` times. A share of bad cells above ``most`` flags
    all, below ``least`` none. A fully flagged polarisation flags all of its station. Only sums go between cells, so groups of any size are shared by tasks. Null values are flagged first.
    """
    keys = [a for a in table.axes if a not in ("time", "freq", "t")]
    cap = max_std if max_std is not None else (0.1 if table.is_phase else 0.01)
    df = table.df.withColumn("weight", F.when(F.col("val").isNull(), 0.0).otherwise(F.col("weight")))
    if table.is_phase:
        w = F.when(F.col("val").isNotNull(), F.col("weight"))
        mean = df.groupBy(*keys).agg(F.atan2(F.sum(w * F.sin("val")), F.sum(w * F.cos("val"))).alias("__c"))
        df = with_stats(df, keys, mean).withColumn("__x", wrap(F.col("val") - F.col("__c")))
    else:
        df = df.withColumn("__x", log10_positive(F.col("val")))
        df = df.withColumn("weight", F.when(F.col("__x").isNull(), 0.0).otherwise(F.col("weight")))
    # The k-th limit follows from the sums over cells within the limit before: one small aggregate per cycle.
    base = df.select(*table.axes, "val", "weight", "__x")
    limits = None
    for _ in range(cycles):
        x = base if limits is None else with_stats(base, keys, limits)
        inside = F.lit(True) if limits is None else F.abs(F.col("__x")) <= F.col("__limit")
        w = F.when(inside & F.col("__x").isNotNull(), F.col("weight"))
        limits = x.groupBy(*keys).agg((sigma * F.least(F.sqrt(F.try_divide(F.sum(w * F.col("__x") * F.col("__x")), F.sum(w))), F.lit(cap))).alias("__limit"))
    x = with_stats(base, keys, limits).withColumn("__bad", (F.col("weight") > 0) & (F.abs(F.col("__x")) > F.col("__limit")))
    share = x.groupBy(*keys).agg(F.try_divide(F.sum(F.col("__bad").cast("double")), F.sum((F.col("weight") > 0).cast("double"))).alias("__share"))
    x = with_stats(x, keys, share)
    new = F.when(F.col("__share") > most, 0.0).when(F.col("__share") < least, F.col("weight")).when(F.col("__bad"), 0.0).otherwise(F.col("weight"))
    return table.put(_all_pols(table, x.withColumn("weight", new)))


def export_station_flags(source: Solutions, target: Solutions) -> Solutions:
    """Flag in ``target`` the stations (and polarisations, where both tables have them) that are flagged throughout ``source``."""
    on = [a for a in ("ant", "pol") if a in source.axes and a in target.axes]
    dead = source.df.groupBy(*on).agg(F.max(F.abs("weight")).alias("__top")).filter(F.col("__top") == 0).select(*on, F.lit(True).alias("__dead"))
    x = target.df.join(dead, on, "left")
    return target.put(x.withColumn("weight", F.when(F.col("__dead"), 0.0).otherwise(F.col("weight"))))


def bounded_lsq(a: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, turns: int = 60) -> np.ndarray:
    """Least squares with bounds: free the variables that pull inside, fix those that hit a bound (the problem is convex)."""
    x = np.clip(np.linalg.lstsq(a, y, rcond=None)[0], low, high)
    fixed = np.zeros(len(x), dtype=bool)
    for _ in range(turns):
        free = ~fixed
        if free.any():
            want = np.linalg.lstsq(a[:, free], y - a[:, fixed] @ x[fixed], rcond=None)[0]
            step = want - x[free]
            room = np.where(step > 0, high[free] - x[free], low[free] - x[free])
            part = np.divide(room, step, out=np.ones_like(step), where=step != 0)
            t = min(1.0, float(part.min()))
            x[free] += t * step
            if t < 1.0:
                fixed[np.flatnonzero(free)[part <= t + 1e-12]] = True
                continue
        pull = a.T @ (y - a @ x)
        loose = fixed & (((x <= low) & (pull > 1e-9)) | ((x >= high) & (pull < -1e-9)))
        if not loose.any():
            break
        fixed[np.argmax(np.where(loose, np.abs(pull), -1))] = False
    return x


#: Bandpass models by band: range of the median frequency, inner knots, coefficients, and how far these may go down and up.
BANDS = {
    "lba": (
        (0.0, 90e6), [10850524.0, 20e6, 30e6, 40e6, 50e6, 55e6, 56e6, 60e6, 62e6, 63e6, 64e6, 70e6, 77610779.0],
        [-0.19996913, -0.10604762, -0.29063847, -0.17248618, 0.05588799, 0.21518069, 0.46090289, 0.59503671, 0.6278482, 0.42936404, 0.43576633, 0.29100915, -0.00448301, -0.16566164, -0.3667639],
        [0.1, 0.2, 0.25, 0.2, 0.05, 0.05, 0.05, 0.1, 0.1, 0.16, 0.2, 0.15, 0.15, 0.25, 0.3],
        [0.1, 0.3, 0.4, 0.3, 0.15, 0.05, 0.05, 0.05, 0.08, 0.05, 0.08, 0.15, 0.15, 0.25, 0.35],
    ),
    "hba_low": (
        (110e6, 180e6), [115e6, 130e6, 138e6, 148e6, 160e6, 168e6, 178e6, 190e6],
        [-0.01460369, 0.05062699, 0.02827004, 0.03738518, -0.05729109, 0.02303295, -0.03550487, -0.0803113, -0.2394929, -0.358301],
        [0.06, 0.05, 0.04, 0.04, 0.04, 0.04, 0.1, 0.1, 0.2, 0.5],
        [0.06, 0.1, 0.1, 0.1, 0.04, 0.04, 0.04, 0.04, 0.05, 0.06],
    ),
}

#: Accepted median levels (least, most), by whether the median of the station is above 1 (new correlator) or not.
LEVELS = {True: (50.0, 325.0), False: (0.0004, 0.0018)}

#: The relative noise of a channel that doesn't count.
LOST = 1e8


def band_basis(freq: np.ndarray, knots: Sequence[float]) -> np.ndarray:
    """Cubic B-splines on inner knots; beyond the ends the first or last one alone goes on as a cubic."""
    k = np.asarray(knots, dtype=float)
    b = spline_basis(freq, 0, k)
    low, high = freq < k[0], freq >= k[-1]
    b[low | high] = 0.0
    b[low, 0] = ((k[1] - freq[low]) / (k[1] - k[0])) ** 3
    b[high, -1] = ((freq[high] - k[-2]) / (k[-1] - k[-2])) ** 3
    return b


def _fit_bandpass(a: np.ndarray, y: np.ndarray, noise: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bandpass of bounded coefficients; those that no channel tells stay at ``start``."""
    use = noise < 0.1 * LOST
    if not use.any():
        return a @ start
    w = 1 / noise[use]
    return a @ (start + bounded_lsq(a[use] * w[:, None], (y - a @ start)[use] * w, -low, high))


def judge_bandpass(
    m: np.ndarray, noise: np.ndarray, cells: np.ndarray, good_cells: np.ndarray, a: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray,
    max_std: float, least: float, most: float, sigma: float, cycles: int,
) -> tuple[np.ndarray, bool]:
    """Bad channels of one station and polarisation, and whether its level is still to be looked at."""
    known = ~np.isnan(m)
    y = np.where(known, np.log10(np.where(known, m, 1.0) / np.nanmedian(m)), 0.0)
    first = np.where(known, noise, LOST)
    model = a @ start
    y = y - np.median(y - model)
    now = np.where(np.abs(y - model) > 0.2, LOST, first)
    if (now > 0.1 * LOST).all():
        return np.ones(len(m), dtype=bool), False
    std = 0.0
    for _ in range(cycles):
        off = y - _fit_bandpass(a, y, now, start, low, high)
        std = float(np.sqrt(np.average(off**2, weights=now**-2.0)))
        bad = np.abs(off) > max(sigma * min(max_std, std), 1e-9)
        if bad.sum() in (0, known.sum()):
            break
        now = np.where(bad, LOST, first)
    bad = now >= LOST
    share = good_cells[bad].sum() / cells.sum()
    if std > sigma * max_std or share > most:
        return np.ones(len(m), dtype=bool), False
    if 0 < share < least:
        return np.zeros(len(m), dtype=bool), False
    return bad, True


def flag_stations_bandpass(
    table: Solutions, max_std: float | None = 0.01, most: float = 0.5, sigma: float = 5.0, intervals: int | None = None, amp_range: Sequence[float] | None = None,
    cycles: int = 2, deepest: float = 1.5, least: float = 0.0, skip: Sequence[str] = (), skip_international: bool = False, telescope: str = "lofar",
) -> Solutions:
    """Flag channels and stations whose amplitudes over frequency don't follow a smooth bandpass.

    Medians over time are taken per station, polarisation (and direction) and channel; a station with a polarisation whose level differs from that of
    the first (XX or RR, else the first by name) by more than a factor 2 is flagged. The log of the normalised medians is fitted with the bandpass model of the band
    (LBA below 90 MHz, HBA-low between 110 and 180 MHz by the median channel; elsewhere, and for other telescopes, nothing is judged), whose
    coefficients are bounded, or with cubic B-splines on ``intervals`` equal intervals bounded to ``deepest``. Channels 0.2 dex off are left out, then those off
    by more than ``sigma`` times the deviation (at most ``max_std``) in each of ``cycles`` fits. A channel flagged at more than half of its times is flagged at all.

    A station and polarisation is flagged altogether if the deviation stays above ``sigma * max_std``, if more than ``most`` of its cells are newly flagged,
    or if the median of what is left lies outside ``amp_range`` (unset or 0, 0: 50 to 325 where the station's median is above 1, else 0.0004 to 0.0018); with
    a share of new flags below ``least`` it keeps its flags. Stations in ``skip``, and with ``skip_international`` those neither core nor remote, aren't judged.
    At the end a fully flagged polarisation flags all polarisations of its station. Null values are flagged; values of 0 or less don't count.
    """
    if not table.is_amplitude or not {"ant", "freq"} <= set(table.axes):
        raise ValueError("bandpass flagging works for amplitudes of antennas over frequency")
    from solweave.functions.medians import group_medians

    max_std = max_std if max_std is not None and max_std > 0 else 0.01
    amp_range = None if amp_range is None or not any(amp_range) else tuple(amp_range)
    keys = [a for a in table.axes if a not in ("time", "t", "freq")]
    station = [k for k in keys if k != "pol"]
    df = table.df.withColumn("weight", F.when(F.col("val").isNull(), 0.0).otherwise(F.col("weight")))
    middle = df.select("freq").distinct().agg(F.median(F.col("freq").cast("double")).alias("f")).first().f
    band = None if middle is None or telescope.lower() != "lofar" else next((b for b, (r, *_) in BANDS.items() if r[0] < middle < r[1]), None)
    if band is None and intervals is None:
        log.warning("no bandpass model for %s at %s Hz: nothing is judged", telescope, middle)
        return table.put(_all_pols(table, df))
    x = df.filter(~F.col("ant").isin(list(skip))) if skip else df
    if skip_international and telescope.lower() == "lofar":
        x = x.filter(F.col("ant").rlike("CS|RS"))
    x = x.withColumn("__v", F.when(F.col("val") > 0, good()))
    x = x.withColumn("__noise", F.when(F.col("__v").isNotNull(), 1 / F.sqrt("weight")).otherwise(LOST))
    channel = [*keys, "freq"]
    cells = x.groupBy(*channel).agg(F.count(F.lit(1)).alias("__cells"), F.sum((F.col("weight") != 0).cast("bigint")).alias("__good"))
    cells = cells.join(group_medians(x, channel, "__noise", "__s"), channel).join(group_medians(x, channel, "__v", "__m"), channel, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["__bad"], pdf["__open"] = False, False
        pols = [p for _, p in pdf.groupby("pol", sort=False)] if "pol" in keys else [pdf]
        pols = sorted((p for p in pols if p["__m"].notna().any()), key=lambda p: (p["pol"].iloc[0] not in ("XX", "RR"), p["pol"].iloc[0]) if "pol" in keys else 0)
        levels = np.array([p["__m"].median() for p in pols])
        if len(levels) and (np.abs(np.log10(levels / levels[0])) > np.log10(2)).any():
            pdf["__bad"] = True
            return pdf[[*channel, "__bad", "__open"]]
        for p in pols:
            f = p["freq"].to_numpy(float)
            if intervals is None:
                _, knots, start, low, high = BANDS[band]
                a, (start, low, high) = band_basis(f, knots), np.array([start, low, high])
            else:
                a = spline_basis((f - f.min()) / (np.ptp(f) or 1.0), max(1, min(intervals, len(f) // 4)))
                start, low = np.zeros(a.shape[1]), np.full(a.shape[1], deepest)
                high = low
            numbers = [p[c].to_numpy(float) for c in ("__m", "__s", "__cells", "__good")]
            bad, still = judge_bandpass(*numbers, a, start, low, high, max_std, least, most, sigma, cycles)
            pdf.loc[p.index, "__bad"], pdf.loc[p.index, "__open"] = bad, still
        return pdf[[*channel, "__bad", "__open"]]

    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in channel) + ", __bad boolean, __open boolean"
    judged = cells.groupBy(*station).applyInPandas(run, schema)
    out = df.join(judged, channel, "left").withColumn("weight", F.when(F.coalesce("__bad", F.lit(False)), 0.0).otherwise(F.col("weight")))
    level = group_medians(out.filter(F.col("__open") & (F.col("weight") > 0)), keys, "val", "__level")
    if amp_range is None:
        level = level.join(group_medians(x, station, "__v", "__usual"), station)
        most_of = lambda i: F.when(F.col("__usual") > 1, LEVELS[True][i]).otherwise(LEVELS[False][i])
        bounds = most_of(0), most_of(1)
    else:
        bounds = F.lit(float(amp_range[0])), F.lit(float(amp_range[-1]))
    extreme = level.filter(~F.col("__level").between(*bounds)).select(*keys, F.lit(True).alias("__dead"))
    out = out.join(extreme, keys, "left").withColumn("weight", F.when(F.col("__dead"), 0.0).otherwise(F.col("weight")))
    return table.put(_all_pols(table, out))


def _all_pols(table: Solutions, df: DataFrame) -> DataFrame:
    """Flag the stations that have a fully flagged polarisation."""
    df = df.select(*table.df.columns)
    if "pol" not in table.axes:
        return df
    dead = df.groupBy("ant", "pol").agg(F.max(F.abs("weight")).alias("__top")).filter(F.col("__top") == 0).select("ant", F.lit(True).alias("__dead")).distinct()
    out = df.join(dead, "ant", "left")
    return out.withColumn("weight", F.when(F.col("__dead"), 0.0).otherwise(F.col("weight"))).select(*table.df.columns)
