"""Irregular readings onto a regular grid: harmonic regression with trend, residuals bridged across gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solweave.functions import segments as S
from solweave.staging import stage

#: Slots of a series that are handled as one row; a longer series is spread over several.
BLOCK = 1024


def slot_of(t: Column, start: Column, step: Column) -> Column:
    """The slot k with start + k*step <= t < start + (k+1)*step, in double arithmetic."""
    k = F.floor((t - start) / step)
    k = F.when(t < start + k * step, k - 1).otherwise(k)
    return F.when(t >= start + (k + 1) * step, k + 1).otherwise(k).cast("bigint")


def regular_series(
    readings: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    start: str,
    step: str,
    slots: str,
    row_id: str | None = None,
    harmonics: int = 2,
    period: str | None = None,
    ridge: float = 1e-6,
) -> DataFrame:
    """Every slot of every series: ``keys, slot, time, val, n, state``.

    ``start, step, slots`` are columns that give the grid of a reading's series; slot k reaches from
    ``start + k*step`` up to the next. Rows with a null key or grid, or a null or NaN value or time, are left
    out; readings outside the grid make their series known but fill no slot. A ``row_id`` that occurs again
    counts once. A slot has the mean of its finite readings, or an infinite one if it has no others.

    ``state`` is ``observed``; ``bridged`` for a missing slot between two observed ones, where the value is the
    regression's plus the residuals of the two endpoints, linearly interpolated; ``extended`` before the first
    and after the last observation, with the residual of the nearest; ``marked``, with a null value, in a
    series without a finite reading on its grid. The regression has a trend and ``harmonics`` waves of ``period`` seconds
    (a column; by default the length of the grid). Its normal equations are summed block by block and then
    over the series, and solved with a small ``ridge``, so short or constant series do no harm. An empty table gives no rows; a
    zero or negative step or number of slots leaves its rows out. Other columns aren't read.

    Rows are spread by (series, block of ``BLOCK`` slots), so a long or hot series takes many tasks; only the
    summaries of its blocks (a few dozen numbers each) meet in one. The packed blocks are written to the shared folder.
    """
    num = lambda c: F.col(c).cast("double")
    x = readings.select(
        *[F.col(k) for k in keys], num(time).alias("__t"), num(value).alias("__v"), num(start).alias("__t0"), num(step).alias("__dt"),
        F.col(slots).cast("bigint").alias("__n"), (num(period) if period else num(step) * F.col(slots)).alias("__period"),
        (F.col(row_id) if row_id else F.lit(None).cast("bigint")).alias("__id"),
    )
    ok = F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__t") < float("inf")) & (F.col("__dt") > 0) & (F.col("__n") > 0) & F.col("__t0").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    slot = slot_of(F.col("__t"), F.col("__t0"), F.col("__dt"))
    x = x.filter(ok).withColumn("__slot", slot).withColumn("__sid", F.xxhash64(*keys))
    x = x.withColumn("__block", F.floor(F.least(F.greatest("__slot", F.lit(0)), F.col("__n") - 1) / BLOCK).cast("int"))
    order = ["__sid", *keys, "__block", "__slot", "__id"]
    x = x.drop("__t").repartition("__sid", "__block").sortWithinPartitions(*order)
    terms = 2 + 2 * harmonics
    key_types = ", ".join(f"`{k}` {readings.schema[k].dataType.simpleString()}" for k in keys)
    packed = x.mapInArrow(
        _pack(keys, harmonics),
        f"{key_types}, __sid bigint, __block int, __t0 double, __dt double, __n bigint, __period double, "
        f"slots array<bigint>, vals array<double>, counts array<int>, sums array<double>, first {_POINT}, last {_POINT}",
    )
    packed = stage(packed, "blocks")
    # A grid of one block needs nothing from elsewhere; of longer ones only the summaries of blocks meet, and are joined back.
    alone = packed.filter(F.col("__n") <= BLOCK).withColumns({
        "normal": F.col("sums"), "prev": F.lit(None).cast(_POINT), "next": F.lit(None).cast(_POINT), "block_before": F.lit(None).cast("int"), "block_after": F.lit(None).cast("int"),
    })
    long = packed.filter(F.col("__n") > BLOCK)
    size = terms * (terms + 1) // 2 + terms
    on = ["__sid", *keys, "__block"]
    summaries = long.select(*on, "sums", "first", "last")
    line = Window.partitionBy("__sid", *keys).orderBy("__block")
    up = line.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("__sid", *keys).orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(
        *on, F.last("last", ignorenulls=True).over(up).alias("prev"), F.last("first", ignorenulls=True).over(down).alias("next"),
        F.lag("__block").over(line).alias("block_before"), F.lead("__block").over(line).alias("block_after"),
    )
    normal = summaries.groupBy("__sid", *keys).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("normal"))
    spread = long.join(carried, on).join(normal, ["__sid", *keys])
    both = alone.drop("sums", "first", "last").unionByName(spread.drop("sums", "first", "last"))
    return both.mapInArrow(_fill(keys, harmonics, ridge), f"{key_types}, slot bigint, time double, val double, n int, state string")


_POINT = "struct<s:bigint,v:double>"


def _basis(slot: np.ndarray, n: np.ndarray, dt: np.ndarray, period: np.ndarray, harmonics: int) -> np.ndarray:
    mid = slot + 0.5
    turn = 2 * np.pi * mid * dt / period
    cols = [np.ones(len(slot)), mid / n - 0.5]
    for h in range(1, harmonics + 1):
        cols += [np.cos(h * turn), np.sin(h * turn)]
    return np.stack(cols, axis=1)


def _pack(keys: Sequence[str], harmonics: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per (series, block): its observed slots, and its part of the normal equations."""
    group = ["__sid", *keys, "__block"]

    def work(table: pa.Table, seg: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = S.starts_of(seg)
        n_seg = len(heads)
        slot, n = table["__slot"].to_numpy(), table["__n"].to_numpy()
        again = ~S.changes([table[c] for c in (*group, "__slot", "__id")]) & table["__id"].is_valid().to_numpy(zero_copy_only=False)
        use = np.flatnonzero((slot >= 0) & (slot < n) & ~again)
        s, g, v = slot[use], seg[use], table["__v"].to_numpy()[use]
        cell = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])]) - 1 if len(use) else np.zeros(0, dtype=np.int64)
        at = S.starts_of(cell)
        cells = len(at)
        finite = np.isfinite(v)
        val = S.means(np.where(finite, v, np.nan), cell, cells)
        val = np.where(np.isnan(val), v[at], val)
        count = np.bincount(cell, minlength=cells)
        s, g = s[at], g[at]
        fit = np.isfinite(val)
        pick = lambda c: table[c].to_numpy()[heads]
        t0, dt, nn, period = pick("__t0"), pick("__dt"), pick("__n"), pick("__period")
        f, gf, y = s[fit], g[fit], val[fit]
        b = _basis(f, nn[gf], dt[gf], period[gf], harmonics)
        i, j = np.triu_indices(b.shape[1])
        sums = np.stack([np.bincount(gf, b[:, p] * b[:, q], n_seg) for p, q in zip(i, j, strict=True)] + [np.bincount(gf, b[:, p] * y, n_seg) for p in range(b.shape[1])], axis=1)
        begin = np.searchsorted(gf, np.arange(n_seg), side="left")
        end = np.searchsorted(gf, np.arange(n_seg), side="right")
        none = begin == end

        def point(pos: np.ndarray) -> pa.StructArray:
            pos = np.clip(pos, 0, max(0, len(f) - 1))
            ss, vv = (f[pos], y[pos]) if len(f) else (np.zeros(n_seg, dtype=np.int64), np.zeros(n_seg))
            return pa.StructArray.from_arrays([pa.array(ss), pa.array(vv)], names=["s", "v"], mask=pa.array(none))

        bounds = pa.array(np.searchsorted(g, np.arange(n_seg + 1), side="left").astype(np.int32))
        wide = pa.array(np.arange(n_seg + 1, dtype=np.int32) * sums.shape[1])
        head = pa.array(heads)
        lists = [pa.ListArray.from_arrays(bounds, pa.array(a)) for a in (s, val, count.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(
            [*[table[k].combine_chunks().take(head) for k in (*keys, "__sid", "__block")], pa.array(t0), pa.array(dt), pa.array(nn), pa.array(period), *lists,
             pa.ListArray.from_arrays(wide, pa.array(sums.ravel())), point(begin), point(end - 1)],
            names=[*keys, "__sid", "__block", "__t0", "__dt", "__n", "__period", "slots", "vals", "counts", "sums", "first", "last"],
        )

    return lambda batches: S.whole_groups(batches, group, work)


def _fill(keys: Sequence[str], harmonics: int, ridge: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    terms = 2 + 2 * harmonics
    states = pa.array(["observed", "bridged", "extended", "marked"])

    def solve(normal: np.ndarray) -> np.ndarray:
        i, j = np.triu_indices(terms)
        a = np.zeros((len(normal), terms, terms))
        a[:, i, j] = normal[:, : len(i)]
        a[:, j, i] = normal[:, : len(i)]
        # A penalty on all but the mean, in units of the number of observations.
        weight = ridge * np.maximum(a[:, 0, 0], 1.0)
        d = np.arange(terms)
        a[:, d, d] += weight[:, None] * np.where(d == 0, 1e-6, 1.0)
        return np.linalg.solve(a, normal[:, len(i) :, None])[:, :, 0]

    def optional(col: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = col.is_valid().to_numpy(zero_copy_only=False)
        s = col.field("s").fill_null(0).to_numpy(zero_copy_only=False)
        v = col.field("v").fill_null(0.0).to_numpy(zero_copy_only=False)
        return has, s, v

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = b.num_rows
        n, t0, dt, period, block = (b[c].to_numpy(zero_copy_only=False) for c in ("__n", "__t0", "__dt", "__period", "__block"))
        lo = np.where(b["block_before"].is_null().to_numpy(zero_copy_only=False), 0, block.astype(np.int64) * BLOCK)
        hi = np.where(b["block_after"].is_null().to_numpy(zero_copy_only=False), n, b["block_after"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK)
        size = hi - lo
        base = np.cumsum(size) - size
        row = np.repeat(np.arange(rows), size)
        slot = np.arange(int(size.sum())) - base[row] + lo[row]
        slots, vals, counts = b["slots"], b["vals"], b["counts"]
        obs_row = np.repeat(np.arange(rows), slots.value_lengths().to_numpy(zero_copy_only=False))
        obs = base[obs_row] + slots.flatten().to_numpy(zero_copy_only=False) - lo[obs_row]
        val, count = np.full(len(row), np.nan), np.zeros(len(row), dtype=np.int32)
        val[obs], count[obs] = vals.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        coef = solve(b["normal"].flatten().to_numpy(zero_copy_only=False).reshape(rows, -1))
        fitted = np.einsum("ij,ij->i", _basis(slot, n[row], dt[row], period[row], harmonics), coef[row])

        # The nearest finite observation before and after each slot: in this block, or the one carried in.
        at = np.arange(len(row))
        finite = np.isfinite(val)
        prev = np.maximum.accumulate(np.where(finite, at, -1))
        nxt = np.minimum.accumulate(np.where(finite, at, len(row))[::-1])[::-1]
        in_prev, in_next = prev >= base[row], nxt < (base + size)[row]

        def edge(inside: np.ndarray, pos: np.ndarray, carried: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            has, s, v = optional(carried)
            resid = v - np.einsum("ij,ij->i", _basis(s, n, dt, period, harmonics), coef)
            pos = np.clip(pos, 0, max(0, len(row) - 1))
            here = np.where(finite, val, 0.0) - fitted
            return inside | has[row], np.where(inside, slot[pos], s[row]), np.where(inside, here[pos], resid[row])

        has_a, slot_a, res_a = edge(in_prev, prev, b["prev"])
        has_b, slot_b, res_b = edge(in_next, nxt, b["next"])
        gap = np.maximum(slot_b - slot_a, 1)
        both = res_a + (res_b - res_a) * (slot - slot_a) / gap
        bridged = fitted + np.where(has_a & has_b, both, np.where(has_a, res_a, res_b))
        state = np.where(count > 0, 0, np.where(has_a & has_b, 1, np.where(has_a | has_b, 2, 3)))
        out = np.where(count > 0, val, np.where(state == 3, np.nan, bridged))
        take = pa.array(row)
        cols = [b[k].take(take) for k in keys]
        cols += [pa.array(slot), pa.array(t0[row] + slot * dt[row]), pa.array(out, mask=state == 3), pa.array(count), states.take(pa.array(state))]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "slot", "time", "val", "n", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Cut so that about 200,000 slots are made at a time.
            if not batch.num_rows:
                continue
            n = batch["__n"].to_numpy(zero_copy_only=False)
            cut = np.cumsum(np.minimum(n, 2 * BLOCK)) // 200_000
            begin = np.r_[S.starts_of(cut), batch.num_rows]
            for a, z in zip(begin[:-1], begin[1:], strict=True):
                yield part(batch.slice(int(a), int(z - a)))

    return run
