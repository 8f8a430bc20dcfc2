"""Spikes, stuck values and impossible readings, relative to each series' own behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solweave.functions import segments as S
from solweave.functions.medians import group_medians
from solweave.staging import stage

_FLAGS = ("impossible", "bad_weight", "spike", "stuck")


def flag_implausible(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    row_id: str,
    weight: str | None = None,
    above: float = 0.0,
    weight_range: tuple[float, float] = (0.0, 1.0),
    spike: float = 10.0,
    stuck: int = 6,
    levels: int = 3,
    detail: float = 5.0,
    turns: int = 2,
    min_values: int = 8,
    block: int = 100_000,
) -> DataFrame:
    """The implausible readings, one row each: ``<row_id>, val, level, scatter, impossible, bad_weight, spike, stuck``.

    * impossible: a value not above ``above``, or infinite. bad_weight: a weight outside ``weight_range``.
    * stuck: a run of at least ``stuck - 1`` details of the finest (Haar) level that are 0, over the known values of a series in time.
    * spike: the other readings of a series are decomposed by an undecimated spline wavelet of ``levels`` levels, and the details of each level scaled by
      1.4826 times their median absolute value. Readings with a scaled detail above ``detail`` are left out of the smooth part,
      which is then taken anew from the rest: the ``level``. What remains of a reading, the sum of its details, is
      scaled by 1.4826 times the median absolute remainder of the readings that weren't left out (1.2533 times the mean where that is
      0): the ``scatter``. With readings above ``detail`` such units left out instead, level and scatter are taken again, ``turns`` times in all.
      A reading is a spike if its remainder is at last above ``spike`` units. Where all readings
      within reach are left out, the level is the median of those of the series that aren't.

    Null and NaN values are never cases by value, nor are null and NaN weights by weight. Null keys form a series
    like any other value. A reading with a null time has no place in its series: it is only held against the
    bounds. A ``row_id`` that occurs again, with the same content, counts once; rows with a null id all count. Equal times
    are ordered by id. Series with fewer than ``min_values`` ordinary readings have no spikes. An empty
    table gives no rows, and other columns are not read.

    A series of more than ``block`` readings is shared by as many tasks as it has blocks; each block brings the readings next to it that its
    details depend on, and medians are exact over the whole series, so the result is the same for any ``block``.
    """
    num = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    marks = [y for k in keys for y in (F.col(k).isNull(), F.col(k))]
    rows = df.select(
        F.xxhash64(*marks).alias("s1"), F.xxhash64(F.lit(1), *marks).alias("s2"), num(time).alias("t"),
        F.col(row_id).alias("id"), num(value).alias("v"), (num(weight) if weight else F.lit(1.0)).alias("w"),
    )
    rule = _Rule(above, weight_range, spike, stuck, levels, detail, turns, min_values)
    kind = df.schema[row_id].dataType.simpleString()
    long = rows.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = long.agg(F.sum("n")).first()[0]
    short = rows if not hot else rows.join(long, ["s1", "s2"], "left_anti")
    short = short.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "t", "id")
    out = short.mapInArrow(_whole(rule), f"id {kind}, {_COLUMNS}")
    if hot:
        out = out.unionByName(_in_blocks(rows.join(long.select("s1", "s2"), ["s1", "s2"], "left_semi"), rule, kind, block, -(-hot // block)))
    return out.withColumnRenamed("id", row_id)


_COLUMNS = "val double, level double, scatter double, impossible boolean, bad_weight boolean, spike boolean, stuck boolean"


class _Rule:
    """The parameters of a rule, and its steps on flat arrays; ``seg`` numbers the series (or blocks of one)."""

    def __init__(self, above: float, weight_range: tuple[float, float], spike: float, stuck: int, levels: int, detail: float, turns: int, least: int) -> None:
        self.above, self.weight_range, self.spike, self.stuck = above, weight_range, spike, stuck
        self.levels, self.detail, self.turns, self.least = levels, detail, max(1, turns), least

    def bounds(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(invalid="ignore"):
            return (v <= self.above) | np.isinf(v), (w < self.weight_range[0]) | (w > self.weight_range[1])

    def bounds_sql(self) -> tuple[Column, Column]:
        inf, unknown = float("inf"), lambda c: F.isnan(c)
        return (
            ~unknown("v") & ((F.col("v") <= self.above) | F.col("v").isin(inf, -inf)),
            ~unknown("w") & ((F.col("w") < self.weight_range[0]) | (F.col("w") > self.weight_range[1])),
        )

    def still(self, v: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Readings in a run of zero details of the Haar level."""
        zero = np.zeros(len(v) + 1, dtype=bool)  # between a reading and the one before
        if len(v) > 1:
            zero[1:-1] = (v[1:] == v[:-1]) & (seg[1:] == seg[:-1])
        begin = np.flatnonzero(zero[1:] & ~zero[:-1])
        end = np.flatnonzero(~zero[1:] & zero[:-1])
        out = np.zeros(len(v) + 1, dtype=np.int64)
        long = end - begin >= self.stuck - 1
        out[begin[long]] += 1
        out[end[long] + 1] -= 1
        return np.cumsum(out[:-1]) > 0

    def details(self, v: np.ndarray, use: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Absolute details of each level (levels x readings); NaN where a reading isn't used."""
        fine = np.where(use, v, 0.0)
        out = np.empty((self.levels, len(v)))
        for j, smooth in enumerate(S.spline_smooths(fine, use, seg, self.levels)):
            out[j] = np.where(use, np.abs(fine - smooth), np.nan)
            fine = smooth
        return out

    def left_out(self, details: np.ndarray, usual: np.ndarray) -> np.ndarray:
        """Readings with a detail above the limit; ``usual`` are the medians of details, level by level."""
        with np.errstate(invalid="ignore"):
            return (details > self.detail * 1.4826 * usual).any(axis=0)

    def level(self, v: np.ndarray, free: np.ndarray, seg: np.ndarray) -> np.ndarray:
        return S.spline_smooths(v, free, seg, self.levels)[-1]


def _whole(rule: _Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Judge whole series, many at a time."""

    def work(table: pa.Table, seg: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, t, v, w = table["id"], S.floats(table["t"]), S.floats(table["v"]), S.floats(table["w"])
        again = ~S.changes([table[c] for c in ("s1", "s2", "t", "id")]) & ids.is_valid().to_numpy(zero_copy_only=False)
        impossible, bad_weight = rule.bounds(v, w)
        n, n_seg = len(v), int(seg[-1]) + 1
        level, scatter, spiked, still = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        line = np.flatnonzero(~np.isnan(v) & np.isfinite(t) & ~again)
        x, s = v[line], seg[line]
        still[line] = rule.still(x, s)
        use = ~impossible[line] & ~still[line]
        use &= (np.bincount(s, use, n_seg) >= rule.least)[s]
        d = rule.details(x, use, s)
        free = use & ~rule.left_out(d, np.stack([S.medians(row, s, n_seg)[s] for row in d]))
        for turn in range(rule.turns):
            mid = rule.level(x, free, s)
            lost = use & np.isnan(mid)
            if lost.any():
                mid[lost] = S.medians(np.where(free, x, np.nan), s, n_seg)[s[lost]]
            rest = np.full(len(x), np.nan)
            rest[use] = np.abs(x[use] - mid[use])
            usual = np.where(free, rest, np.nan)
            unit = 1.4826 * S.medians(usual, s, n_seg)
            flat = ~(unit > 0)
            if flat.any():
                unit[flat] = 1.2533 * S.means(usual, s, n_seg)[flat]
            if turn + 1 < rule.turns:
                with np.errstate(invalid="ignore"):
                    free = use & ~(rest > rule.detail * unit[s])
        with np.errstate(invalid="ignore"):
            spiked[line] = use & (rest > rule.spike * unit[s]) & (unit[s] > 0)
        level[line], scatter[line] = np.where(use, mid, np.nan), np.where(use, unit[s], np.nan)
        keep = np.flatnonzero((impossible | bad_weight | spiked | still) & ~again)
        if len(keep):
            cols = [ids.take(pa.array(keep)).combine_chunks(), pa.array(v[keep], from_pandas=True)]
            cols += [pa.array(c[keep], from_pandas=True) for c in (level, scatter)] + [pa.array(c[keep]) for c in (impossible, bad_weight, spiked, still)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "val", "level", "scatter", *_FLAGS])

    return lambda batches: S.whole_groups(batches, ["s1", "s2"], work)


def _in_blocks(rows: DataFrame, rule: _Rule, kind: str, block: int, tasks: int) -> DataFrame:
    """The same judgement of series that are spread over blocks; medians are taken over all blocks of a series."""
    series = ["s1", "s2"]
    impossible, bad_weight = rule.bounds_sql()
    rows = rows.withColumns({"impossible": impossible, "bad_weight": bad_weight})
    on_line = ~F.isnan("v") & ~F.isnan("t") & (F.abs("t") < float("inf"))
    # Readings in the order of series, time and id over all tasks; equal ones lie in the same task.
    laid = stage(rows.repartitionByRange(int(tasks), *series, "t", "id").withColumn("part", F.spark_partition_id()), "laid")
    order = Window.partitionBy(*series, "part").orderBy("t", "id")
    again = F.col("id").isNotNull() & F.lag("id").over(order).eqNullSafe(F.col("id")) & F.lag("t").over(order).eqNullSafe(F.col("t"))
    laid = laid.withColumn("again", again).filter(~F.col("again")).drop("again")
    aside = laid.filter(~on_line & (F.col("impossible") | F.col("bad_weight")))
    none = F.lit(None).cast("double")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    aside = aside.select("id", known("v").alias("val"), none.alias("level"), none.alias("scatter"), "impossible", "bad_weight", F.lit(False).alias("spike"), F.lit(False).alias("stuck"))

    line = laid.filter(on_line).withColumn("at", F.row_number().over(order) - 1)
    parts = line.groupBy(*series, "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(*series).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*series, "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    line = line.join(parts, [*series, "part"]).withColumn("at", F.col("at") + F.col("before"))
    line = stage(line.select(*series, "at", "id", "v", "impossible", "bad_weight"), "line")

    def shared(x: DataFrame, margin: int) -> DataFrame:
        """Rows in their block and, as ``core`` false, in those whose margin they lie in; a block comes in the order of time."""
        first, last = F.floor((F.col("at") - margin) / block), F.floor((F.col("at") + margin) / block)
        x = x.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), first), last))).withColumn("core", F.col("block") == F.floor(F.col("at") / block))
        return x.repartition(*series, "block").sortWithinPartitions(*series, "block", "at")

    names = [f"d{j}" for j in range(rule.levels)]

    def split(table: pa.Table, seg: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = S.floats(table["v"])
        still = rule.still(v, seg)
        use = ~table["impossible"].to_numpy() & ~still
        d = rule.details(v, use, seg)
        table = table.append_column("stuck", pa.array(still)).append_column("use", pa.array(use))
        for name, row in zip(names, d, strict=True):
            table = table.append_column(name, pa.array(row, from_pandas=True))
        yield from table.filter(table["core"]).drop_columns(["block", "core"]).combine_chunks().to_batches()

    def smooth(table: pa.Table, seg: np.ndarray) -> Iterator[pa.RecordBatch]:
        level = rule.level(S.floats(table["v"]), table["free"].to_numpy(), seg)
        table = table.append_column("level", pa.array(level, from_pandas=True))
        yield from table.filter(table["core"]).drop_columns(["block", "core"]).combine_chunks().to_batches()

    def blocks(work: Callable) -> Callable:
        return lambda batches: S.whole_groups(batches, [*series, "block"], work)

    base = f"s1 bigint, s2 bigint, at bigint, id {kind}, v double, impossible boolean, bad_weight boolean"
    base_d = base + ", stuck boolean, use boolean"
    split_rows = shared(line, S.reach(rule.levels) + rule.stuck).mapInArrow(blocks(split), base_d + "".join(f", {c} double" for c in names))
    x = stage(split_rows, "details")
    usual = x.groupBy(*series).agg(F.sum(F.col("use").cast("bigint")).alias("uses"))
    for c in names:
        usual = usual.join(group_medians(x, series, c, f"m{c}"), series, "left")
    x = x.join(usual, series).withColumn("use", F.col("use") & (F.col("uses") >= rule.least))
    large = F.lit(False)
    for c in names:
        large = large | F.coalesce(F.col(c) > rule.detail * 1.4826 * F.col(f"m{c}"), F.lit(False))
    x = x.withColumn("free", F.col("use") & ~large).select(*[c.split()[0] for c in base_d.split(", ")], "free")
    kept = [*x.columns]
    for turn in range(rule.turns):
        x = stage(shared(x, S.reach(rule.levels)).mapInArrow(blocks(smooth), base_d + ", free boolean, level double"), "levels")
        x = x.join(group_medians(x.filter("free"), series, "v", "middle"), series, "left")
        x = x.withColumn("level", F.when(F.col("use"), F.coalesce("level", "middle"))).withColumn("rest", F.abs(F.col("v") - F.col("level")))
        free = x.filter("free")
        unit = group_medians(free, series, "rest", "mid").join(free.groupBy(*series).agg(F.avg("rest").alias("mean")), series)
        unit = unit.select(*series, F.when(F.col("mid") > 0, 1.4826 * F.col("mid")).otherwise(1.2533 * F.col("mean")).alias("unit"))
        if turn + 1 < rule.turns:
            x = x.join(unit, series, "left").withColumn("free", F.col("use") & ~F.coalesce(F.col("rest") > rule.detail * F.col("unit"), F.lit(False))).select(*kept)
    x = x.join(unit, series, "left").withColumn("scatter", F.when(F.col("use"), F.col("unit")))
    x = x.withColumn("spike", F.coalesce(F.col("use") & (F.col("rest") > rule.spike * F.col("unit")) & (F.col("unit") > 0), F.lit(False)))
    x = x.filter(F.col("impossible") | F.col("bad_weight") | F.col("spike") | F.col("stuck"))
    return x.select("id", F.col("v").alias("val"), "level", "scatter", *_FLAGS).unionByName(aside)
