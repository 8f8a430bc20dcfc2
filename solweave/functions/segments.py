"""NumPy kernels over many short series that lie one after another in flat arrays.

``seg`` numbers the series of each element, ascending. No kernel loops over series in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(columns: Sequence[pa.ChunkedArray | pa.Array]) -> np.ndarray:
    """True where a row differs from the row before in any column (nulls are equal to each other); the first row is True."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
    for col in columns:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if n > 1:
            a, b = col[1:], col[:-1]
            differ = pc.not_equal(a, b)
            if col.null_count:
                differ = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.not_equal(a.is_null(), b.is_null()), differ)
            out[1:] |= differ.to_numpy(zero_copy_only=False).astype(bool)
    return out


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], rows: int = 100_000
) -> Iterator[pa.RecordBatch]:
    """Feed ``work`` with tables of whole groups, from batches sorted by ``keys``.

    ``work`` gets about ``rows`` rows at a time and, for each row, the number of its group.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = changes([table[k] for k in keys])
            last = int(np.flatnonzero(starts)[-1])
            if last:
                yield from work(table.slice(0, last), np.cumsum(starts[:last]) - 1)
            rest = table.slice(last)
            held, count = rest.to_batches(), rest.num_rows
            if not last:  # one group fills it all: wait for twice as much
                rows = max(rows, 2 * count)
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from work(table, np.cumsum(changes([table[k] for k in keys])) - 1)


def floats(col: pa.ChunkedArray) -> np.ndarray:
    """Doubles, null as NaN."""
    return pc.fill_null(col, float("nan")).to_numpy().astype(np.float64, copy=False)


def starts_of(seg: np.ndarray) -> np.ndarray:
    """First position of each run of equal values in ``seg``."""
    return np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if len(seg) else np.zeros(0, dtype=np.int64)


def medians(x: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    """The median of each series' values that aren't NaN; NaN for a series without any."""
    ok = ~np.isnan(x)
    x, seg = x[ok], seg[ok]
    out = np.full(n_seg, np.nan)
    if not len(x):
        return out
    x = x[np.lexsort((x, seg))]
    count = np.bincount(seg, minlength=n_seg)
    first = np.cumsum(count) - count
    has = count > 0
    out[has] = (x[first[has] + (count[has] - 1) // 2] + x[first[has] + count[has] // 2]) / 2
    return out


def means(x: np.ndarray, seg: np.ndarray, n_seg: int) -> np.ndarray:
    ok = ~np.isnan(x)
    count = np.bincount(seg[ok], minlength=n_seg)
    return np.divide(np.bincount(seg[ok], x[ok], n_seg), count, out=np.full(n_seg, np.nan), where=count > 0)


def run_lengths(x: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """For each element, how many neighbours in a row (itself included) equal it exactly."""
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (seg[1:] != seg[:-1])])
    length = np.diff(np.r_[begin, len(x)])
    return np.repeat(length, length)


def _ends(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = starts_of(seg)
    length = np.diff(np.r_[begin, len(seg)])
    return np.repeat(begin, length), np.repeat(begin + length - 1, length)


def spline_smooths(x: np.ndarray, counts: np.ndarray, seg: np.ndarray, levels: int) -> list[np.ndarray]:
    """The smooth parts 1..``levels`` of an undecimated wavelet decomposition (filter 1, 4, 6, 4, 1 over 16, holes of 2**level).

    Only places where ``counts`` is true are averaged; the others, and those beyond a series' ends, have no weight, and the weights of the
    rest are scaled up. NaN where nothing is within reach. A value depends on ``reach(levels)`` places on either side.
    """
    num, den, out = np.where(counts, x, 0.0), counts.astype(float), []
    alike: dict[int, np.ndarray] = {}
    for j in range(levels):
        a, b = num * (6 / 16), den * (6 / 16)
        for tap, part in ((1, 4 / 16), (2, 1 / 16)):
            k = tap * 2**j
            if k >= len(x):
                continue
            same = alike.setdefault(k, seg[k:] == seg[:-k])
            for side, wide in ((a, num), (b, den)):
                side[:-k] += np.where(same, wide[k:] * part, 0.0)
                side[k:] += np.where(same, wide[:-k] * part, 0.0)
        num, den = a, b
        out.append(np.divide(num, den, out=np.full(len(x), np.nan), where=den > 0))
    return out


def reach(levels: int) -> int:
    """How many places on either side a smooth part of that level looks at."""
    return 2 * (2**levels - 1)


def running_median(x: np.ndarray, seg: np.ndarray, half: int, at: np.ndarray | None = None, ahead: int | None = None) -> np.ndarray:
    """Median of the values from ``half`` places back to ``ahead`` (default: as many) places on in the series, NaN left out; for the places ``at`` or all."""
    lo, hi = _ends(seg)
    at = np.arange(len(x)) if at is None else at
    out = np.empty(len(at))
    offsets = np.arange(-half, (half if ahead is None else ahead) + 1)
    for k in range(0, len(at), 200_000):
        part = at[k : k + 200_000]
        pos = part[:, None] + offsets
        inside = (pos >= lo[part][:, None]) & (pos <= hi[part][:, None])
        near = np.where(inside, x[np.clip(pos, 0, len(x) - 1)], np.nan)
        near.sort(axis=1)  # NaN goes last
        count = (~np.isnan(near)).sum(axis=1)
        rows = np.arange(len(part))
        mid = (near[rows, np.maximum(count - 1, 0) // 2] + near[rows, np.minimum(count // 2, len(offsets) - 1)]) / 2
        out[k : k + 200_000] = np.where(count > 0, mid, np.nan)
    return out
