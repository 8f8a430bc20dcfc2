"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solweave.functions.names import label
from solweave.staging import stage

#: Cuts of a source's stream for its running total; the total within one cut is taken in one task.
CUTS = 4096


class Schedule:
    """How a source's weight goes with training time 0..1: a piecewise-linear multiplier, scaled to the mean 1."""

    def __init__(self, knots: Sequence[tuple[float, float]]) -> None:
        t, m = (np.array(x, dtype=float) for x in zip(*knots, strict=True))
        if t[0] != 0 or t[-1] != 1 or (np.diff(t) <= 0).any() or (m < 0).any() or not m.any():
            raise ValueError("knots run from time 0 to 1 in order, multipliers are at least 0 and not all 0")
        steps = np.diff(t) * (m[1:] + m[:-1]) / 2
        self.t, self.m = t, m / steps.sum()
        self.total = np.concatenate([[0.0], np.cumsum(steps / steps.sum())])

    def invert(self, y: np.ndarray) -> np.ndarray:
        """The time at which the share y (0..1) of the source's demand has been drawn."""
        y = np.clip(y, 0.0, 1.0)
        i = np.clip(np.searchsorted(self.total, y, side="right") - 1, 0, len(self.t) - 2)
        width = self.t[i + 1] - self.t[i]
        slope, m, need = (self.m[i + 1] - self.m[i]) / width, self.m[i], y - self.total[i]
        # need = m*d + slope*d^2/2, solved in the form without cancellation
        root = np.sqrt(np.maximum(m * m + 2 * slope * need, 0.0))
        d = np.divide(2 * need, m + root, out=np.zeros_like(need), where=(m + root) > 0)
        return self.t[i] + np.minimum(d, width)


def ramp(shares: dict[str, float], strength: float = 0.6) -> dict[str, list[tuple[float, float]]]:
    """A default curriculum: sources with large shares weigh more at the start, small ones at the end.

    At any time the weights sum to the sum of the shares.
    """
    total = sum(shares.values()) or 1.0
    mean = sum(s * s for s in shares.values()) / total
    far = max((abs(s - mean) for s in shares.values()), default=0.0) or 1.0
    return {k: [(0.0, 1 + strength * (s - mean) / far), (1.0, 1 - strength * (s - mean) / far)] for k, s in shares.items()}


def mix(
    docs: DataFrame,
    doc_id: str,
    source: str,
    size: str,
    targets: DataFrame,
    schedules: dict[str, list[tuple[float, float]]] | None = None,
    seed: int = 7,
    cuts: int = CUTS,
) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that each source has its target share of the size of all of them.

    ``targets`` has ``source, target_share, max_uses``, one row per source (fixed and small: read to the
    driver, at most 10,000 rows). Sources are equal regardless of letter case and blanks around them.
    Returns the drawn documents, range-sorted by training position, as ``position, source, <doc_id>, use, size``,
    and the report ``source, target_share, max_uses, size, demand, drawn, uses, first, last, actual_share, short``. The mix is made once and
    written to the shared folder; both results read that table, so the report counts the documents that got a position.

    The demand of a source is its share of the size of all documents of the sources in ``targets``. Its
    stream holds its documents in the order of a hash, a second time in another order, and so on, up to
    ``max_uses`` times. A use is drawn if its place in the stream begins before the demand, so a source
    overshoots by less than a document. Training time is where the schedule's integral meets the middle of
    the place; it is scaled to the total size. A source is short if its whole stream is below its demand;
    others don't make up for it, and the report shows the shares that came about.

    Null or unknown sources, null ids and null or negative sizes are left out, and so are targets without a
    source or share. Documents of size 0 are drawn as they come in the order. A repeated id counts as often as it
    occurs. A source without documents has the size 0 and is short unless its share is 0. Equal sources in
    ``targets`` are refused. Running totals are taken over ``cuts`` hash ranges per use, so a
    source with a third of all rows is spread over as many groups.
    """
    rows = targets.select(F.col("source"), label("source").alias("k"), F.col("target_share").cast("double").alias("w"), F.col("max_uses").cast("int").alias("u")).limit(10_001).collect()
    rows = [r for r in rows if r.k is not None and r.w is not None]
    if len(rows) > 10_000 or len({r.k for r in rows}) < len(rows):
        raise ValueError("targets: at most 10,000 sources, each once")
    spark = docs.sparkSession
    goal = spark.createDataFrame([(r.k, r.source, r.w, r.u if r.u is not None else 1) for r in rows], "k string, source string, target_share double, max_uses int")
    plans = {k: Schedule(knots) for k, knots in ramp({r.k: r.w for r in rows}).items()}
    for name, knots in (schedules or {}).items():
        plans[name.strip().lower()] = Schedule(knots)

    kept = docs.select(F.col(doc_id).alias("__id"), label(source).alias("k"), F.col(size).cast("bigint").alias("size"))
    kept = kept.filter(F.col("__id").isNotNull() & (F.col("size") >= 0) & F.col("k").isNotNull())
    kept = kept.join(F.broadcast(goal), "k")  # at most 10,000 rows, checked above
    sizes = kept.groupBy("k").agg(F.sum("size").alias("have"))
    totals = goal.join(sizes, "k", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    known = {r.k: (r.have, r.w, r.max_uses) for r in totals.select("k", "have", F.col("target_share").alias("w"), "max_uses").collect()}
    whole = sum(h for h, _, _ in known.values())
    report_base = spark.createDataFrame(
        [(k, int(h), float(w * whole), _epochs(h, w * whole, u)) for k, (h, w, u) in known.items()], "k string, have bigint, demand double, epochs int"
    )
    facts = F.broadcast(report_base)  # as many rows as targets

    uses = kept.join(facts, "k").filter(F.col("epochs") > 0)
    uses = uses.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    uses = uses.withColumn("h", F.xxhash64("__id", "use", F.lit(seed)))
    # Range cuts of the hash keep the order: cut i lies before cut i + 1.
    uses = uses.withColumn("cut", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * cuts).cast("int"))
    per_cut = uses.groupBy("k", "use", "cut").agg(F.sum("size").alias("cut_size"))
    before = Window.partitionBy("k").orderBy("use", "cut").rowsBetween(Window.unboundedPreceding, -1)
    per_cut = per_cut.select("k", "use", "cut", F.coalesce(F.sum("cut_size").over(before), F.lit(0)).alias("base"))
    per_cut = per_cut.join(facts.select("k", "demand"), "k").filter(F.col("base") < F.col("demand")).drop("demand")  # cuts beyond the demand aren't sorted
    within = Window.partitionBy("k", "use", "cut").orderBy("h", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = uses.join(per_cut, ["k", "use", "cut"]).withColumn("end", F.col("base") + F.sum("size").over(within))
    placed = placed.withColumn("begin", F.col("end") - F.col("size")).filter(F.col("begin") < F.col("demand"))

    @F.pandas_udf("double")
    def when(k: pd.Series, share: pd.Series) -> pd.Series:
        out = np.empty(len(k))
        for name, idx in k.groupby(k, sort=False).indices.items():
            out[idx] = plans[name].invert(share.to_numpy()[idx])
        return pd.Series(out)

    middle = F.least((F.col("begin") + F.col("end")) / 2, F.col("demand")) / F.col("demand")
    drawn = placed.select((when("k", middle) * float(whole)).alias("position"), "source", F.col("__id").alias(doc_id), "use", "size")
    out = stage(drawn.orderBy("position", "source", doc_id, "use"), "mix")
    placed_sums = out.filter(F.col("position").between(0.0, float(whole))).groupBy("source").agg(
        F.sum("size").alias("drawn"), F.max("use").alias("uses"), F.min("position").alias("first"), F.max("position").alias("last")
    )
    all_drawn = Window.partitionBy(F.lit(1))  # over the targets, one row each
    report = goal.join(report_base, "k").join(placed_sums, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.select(
        "source", "target_share", "max_uses", F.col("have").alias("size"), "demand", "drawn",
        F.coalesce("uses", F.lit(0)).alias("uses"), "first", "last",
        F.try_divide(F.col("drawn").cast("double"), F.sum("drawn").over(all_drawn)).alias("actual_share"),
        (F.col("drawn") < F.col("demand")).alias("short"),
    )
    return out, report


def _epochs(have: int, demand: float, max_uses: int) -> int:
    if have <= 0 or demand <= 0:
        return 0
    return int(min(max_uses, -(-demand // have)))
