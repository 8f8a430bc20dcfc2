"""Percentiles of very large numeric columns by radix selection.

Doubles are mapped to 64-bit integers of the same order. A pass counts one digit (``digit_bits`` bits) per
group; the next pass looks only at rows that share the digits found so far for some target rank. After 64
bits the percentile is an element of the data, exactly. Stopping earlier leaves an interval that holds it,
with a relative width of at most 2**(12 - bits).

Histograms of a fixed depth add up: those of separate days or solsets give the one of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from solweave.staging import stage

_LOW63 = np.int64(0x7FFFFFFFFFFFFFFF)


def to_ordered(x: np.ndarray) -> np.ndarray:
    """Doubles (no NaN) to int64 of the same order; -0.0 counts as 0.0."""
    bits = (np.asarray(x, dtype=np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & _LOW63)


def from_ordered(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, dtype=np.int64)
    return (k ^ ((k >> np.int64(63)) & _LOW63)).view(np.float64)


@F.pandas_udf(LongType())
def ordered_key(x: pd.Series) -> pd.Series:
    return pd.Series(to_ordered(x.to_numpy(dtype=np.float64, na_value=0.0)))


@F.pandas_udf(DoubleType())
def ordered_value(k: pd.Series) -> pd.Series:
    keys = k.to_numpy(dtype=np.int64)
    x = from_ordered(keys)
    # The last interval on either side reaches past infinity, into codes of no number.
    return pd.Series(np.where(np.isnan(x), np.where(keys >= 0, np.inf, -np.inf), x))


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def keyed_values(df: DataFrame, keys: Sequence[str], value: str, row_id: str | None = None) -> DataFrame:
    """(keys, key): known values as ordered integers, each ``row_id`` once (rows without an id all count)."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if row_id is None:
        rows = known.select(*keys, F.col(value).alias("v"))
    else:
        # A repeated row repeats its content, so it is equal in all these columns.
        pick = [*keys, F.col(value).alias("v"), F.col(row_id).alias("__id")]
        with_id = known.filter(F.col(row_id).isNotNull()).select(*pick).repartition("__id").distinct()
        rows = with_id.unionByName(known.filter(F.col(row_id).isNull()).select(*pick)) if _nullable(df, row_id) else with_id
    return rows.select(*keys, ordered_key("v").alias("key"))


def _nullable(df: DataFrame, name: str) -> bool:
    return df.schema[name].nullable


def digit_histogram(keyed: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """(keys, prefix, n): how many values share their first ``bits`` bits. Counts are summed before the shuffle."""
    return keyed.groupBy(*keys, F.shiftright("key", 64 - bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The histogram of all parts (days, solsets, partitions) from those of each."""
    return parts.groupBy(*keys, "prefix").agg(F.sum("n").alias("n"))


def _follow(hist: DataFrame, keys: Sequence[str], wanted: DataFrame | None, probs: Sequence[float]) -> DataFrame:
    """For each target the prefix that holds its rank, and the rank within that prefix."""
    if wanted is None:  # the first digit: targets come from the group's size
        by = Window.partitionBy(*keys)
        ranks = F.transform(
            F.array(*[F.lit(float(p)) for p in probs]),
            lambda p: F.struct(p.alias("q"), F.greatest(F.lit(1), F.ceil(p * F.col("total"))).cast("bigint").alias("rank")),
        )
        x = hist.withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("prefix")))
        x = x.withColumn("hit", F.explode(F.filter(ranks, lambda t: (t.rank > F.col("upto") - F.col("n")) & (t.rank <= F.col("upto")))))
        return x.select(*keys, "prefix", "total", F.col("hit.q").alias("q"), (F.col("hit.rank") - F.col("upto") + F.col("n")).alias("rank"))
    # Later digits: a parent prefix has at most 2**digit_bits children, and as many targets as there are probs.
    by = Window.partitionBy(*keys, "parent")
    x = hist.withColumn("upto", F.sum("n").over(by.orderBy("prefix")))
    w = wanted.groupBy(*keys, "prefix", "total").agg(F.collect_list(F.struct("q", "rank")).alias("targets"))
    j = x.alias("h").join(w.alias("w"), _same(keys, "h", "w") & (F.col("h.parent") == F.col("w.prefix")))
    j = j.select(*[F.col(f"h.{k}") for k in keys], "h.prefix", "h.n", "h.upto", "w.total", "w.targets")
    j = j.withColumn("hit", F.explode(F.filter("targets", lambda t: (t.rank > F.col("upto") - F.col("n")) & (t.rank <= F.col("upto")))))
    return j.select(*keys, "prefix", "total", F.col("hit.q").alias("q"), (F.col("hit.rank") - F.col("upto") + F.col("n")).alias("rank"))


def radix_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    row_id: str | None = None,
    bits: int = 64,
    digit_bits: int = 16,
) -> DataFrame:
    """Percentiles per group: ``keys, q, n, lo, hi, value``.

    The percentile q is the element of rank max(1, ceil(q * n)). ``lo`` and ``hi`` bound it; with
    ``bits=64`` they and ``value`` are that element itself.

    Null and NaN values don't count, infinite ones do. Null keys form their own group. A ``row_id`` that
    occurs again counts once. Ties need no rule: equal values are one key. An empty table gives no rows.
    Each pass groups by (keys, digit) with a partial count before the shuffle, so no task gets more of a
    hot group than 2**digit_bits counts per map task.
    """
    if not 0 < digit_bits <= 16 or not 12 < bits <= 64 or bits % digit_bits:
        raise ValueError("bits must be a multiple of digit_bits, from 13 to 64; digit_bits at most 16")
    if not all(0 <= p <= 1 for p in probs):
        raise ValueError("probs lie in 0..1")
    keyed = stage(keyed_values(df, keys, value, row_id), "radix")
    found = stage(_follow(digit_histogram(keyed, keys, digit_bits), keys, None, probs), "digit")
    for depth in range(2 * digit_bits, bits + 1, digit_bits):
        near = keyed.withColumn("parent", F.shiftright("key", 64 - depth + digit_bits))
        alive = found.select(*keys, F.col("prefix").alias("parent")).distinct()
        near = near.alias("k").join(alive.alias("a"), _same(keys, "k", "a") & (F.col("k.parent") == F.col("a.parent")), "left_semi")
        hist = near.groupBy(*keys, "parent", F.shiftright("key", 64 - depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        found = stage(_follow(hist, keys, found, probs), "digit")
        if depth == 2 * digit_bits < bits:  # what shares two digits with a target is a small part: later passes read that alone
            alive = found.select(*keys, F.col("prefix").alias("parent")).distinct()
            last = keyed.withColumn("parent", F.shiftright("key", 64 - depth)).alias("k")
            last = last.join(alive.alias("a"), _same(keys, "k", "a") & (F.col("k.parent") == F.col("a.parent")), "left_semi")
            keyed = stage(last.select(*keys, "key"), "radix")
    return _bounds(found, keys, bits)


def _bounds(found: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    lo = F.shiftleft(F.col("prefix"), 64 - bits)
    hi = lo.bitwiseOR(F.lit((1 << (64 - bits)) - 1))
    x = found.select(*keys, "q", F.col("total").alias("n"), ordered_value(lo).alias("lo"), ordered_value(hi).alias("hi"))
    return x.withColumn("value", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((F.col("lo") + F.col("hi")) / 2))


def histogram_percentiles(hist: DataFrame, keys: Sequence[str], probs: Sequence[float], bits: int) -> DataFrame:
    """Percentiles from (merged) histograms of depth ``bits``; the true element lies in lo..hi.

    An interval that holds an infinity or reaches past the largest double has that infinity as its bound.
    A group has at most 2**bits prefixes; the running count is taken in two levels, so no task sorts more
    than 2**16 of them.
    """
    top = hist.groupBy(*keys, F.shiftright("prefix", max(0, bits - 16)).alias("parent")).agg(F.sum("n").alias("n"))
    first = _follow(top.withColumnRenamed("parent", "prefix"), keys, None, probs)
    if bits <= 16:
        return _bounds(first, keys, bits)
    low = hist.withColumn("parent", F.shiftright("prefix", bits - 16))
    return _bounds(_follow(low, keys, first, probs), keys, bits)
