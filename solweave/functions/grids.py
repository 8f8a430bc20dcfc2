"""NumPy kernels on the dense cube of one group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view


def cube(pdf: pd.DataFrame, axes: Sequence[str], value: str) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The values of a group on the grid of its coordinates (NaN where there is no cell), and each row's place in it."""
    coords = [np.unique(pdf[a].to_numpy(), return_inverse=True) for a in axes]
    place = tuple(c[1] for c in coords)
    out = np.full([len(c[0]) for c in coords], np.nan)
    out[place] = pdf[value].to_numpy(dtype=float, na_value=np.nan)
    return out, place


def _windows(x: np.ndarray, size: Sequence[int], **pad: object) -> np.ndarray:
    widths = [(s // 2, s - 1 - s // 2) for s in size]
    return sliding_window_view(np.pad(x, widths, **pad), tuple(size))


def running_median(x: np.ndarray, size: Sequence[int]) -> np.ndarray:
    """Median of the values within a window of ``size`` cells (0: the whole axis and beyond), NaN left out; a row of the first axis at a time."""
    size = [s or 2 * n + 1 for s, n in zip(size, x.shape, strict=True)]
    w = _windows(x, size, mode="constant", constant_values=np.nan)
    out = np.empty(x.shape)
    with np.errstate(all="ignore"):
        for i in range(len(x)):
            flat = np.sort(w[i].reshape(*x.shape[1:], -1), axis=-1)  # NaN goes last
            n = (~np.isnan(flat)).sum(axis=-1)
            a = np.take_along_axis(flat, np.maximum((n - 1) // 2, 0)[..., None], -1)[..., 0]
            b = np.take_along_axis(flat, np.minimum(n // 2, flat.shape[-1] - 1)[..., None], -1)[..., 0]
            out[i] = np.where(n > 0, (a + b) / 2, np.nan)
    return out


def running_poly(x: np.ndarray, size: int, degree: int) -> np.ndarray:
    """The value at the centre of the polynomial fitted to each window; with too few points one of a lower degree."""
    out = np.full(len(x), np.nan)
    half = size // 2
    for i in range(len(x)):
        k = np.arange(max(0, i - half), min(len(x), i + half + 1))
        ok = ~np.isnan(x[k])
        if ok.any():
            a = np.vander(k[ok] - i, min(degree, ok.sum() - 1) + 1)
            out[i] = np.linalg.lstsq(a, x[k][ok], rcond=None)[0][-1]
    return out


def savitzky_golay(x: np.ndarray, size: int, degree: int) -> np.ndarray:
    """Polynomial filter on the linearly filled line; at the ends the polynomial of the first or last window; NaN stays."""
    ok = ~np.isnan(x)
    if ok.sum() == 0 or len(x) < size:
        return x.copy()
    at = np.arange(len(x))
    y = np.interp(at, at[ok], x[ok])
    half = size // 2
    v = np.vander(np.arange(-half, half + 1), degree + 1)
    fit = np.linalg.pinv(v)
    out = np.empty(len(x))
    out[half : len(x) - half] = sliding_window_view(y, size) @ fit[-1]
    for part, first in ((slice(0, half), 0), (slice(len(x) - half, len(x)), len(x) - size)):
        coef = fit @ y[first : first + size]
        out[part] = np.vander(at[part] - first - half, degree + 1) @ coef
    return np.where(ok, out, np.nan)


def box_share(flag: np.ndarray, size: Sequence[int]) -> np.ndarray:
    """The share of flagged cells in the box around each; beyond the edges the grid is mirrored without repeating the edge."""
    total = flag.astype(float)
    count = 1.0
    for axis, s in enumerate(size):
        s = s or 2 * flag.shape[axis]
        n = flag.shape[axis]
        pos = np.arange(-(s // 2), n + s - 1 - s // 2)
        period = max(1, 2 * (n - 1))
        pos = np.abs(pos) % period
        pos = np.where(pos >= n, period - pos, pos)
        run = np.cumsum(np.concatenate([np.zeros_like(np.take(total, [0], axis)), np.take(total, pos, axis)], axis), axis)
        total = np.take(run, np.arange(s, s + n), axis) - np.take(run, np.arange(n), axis)
        count *= s
    return total / count


def mad_sigma(x: np.ndarray) -> float:
    x = np.abs(x[~np.isnan(x)])
    return 1.4826 * float(np.median(x)) if len(x) else np.nan
