"""Queries on the delivered solution and header tables: regular grids, wrong readings, drifting schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solweave.functions.medians import group_medians
from solweave.functions.names import station
from solweave.operators.drift import Drift
from solweave.operators.implausible import flag_implausible
from solweave.operators.regular import regular_series, slot_of
from solweave.staging import stage


#: Seconds of the season that the readings are fitted with: the levels of the amplitudes wander within an hour or so.
SEASON = 3600.0


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _wrong(spark: SparkSession, d: str) -> DataFrame:
    cells = _read(spark, d, "cells").select("cell_id", "solset", station("ant").alias("ant"), "pol", "freq", "time", "val", "weight")
    return flag_implausible(cells, ["solset", "ant", "pol", "freq"], "time", "val", "cell_id", weight="weight")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Wrong readings."""
    return _wrong(spark, d).select("cell_id").distinct()


def p4_readings(spark: SparkSession, d: str) -> DataFrame:
    """Wrong readings with the level and scatter of their series and what is wrong."""
    return _wrong(spark, d)


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """The nominal grid of each amplitude table, once (the metadata repeat rows)."""
    meta = _read(spark, d, "soltab_meta").filter(F.col("n_time").isNotNull() & F.col("n_freq").isNotNull())
    names = ["time_start", "time_step", "n_time", "freq_start", "freq_step", "n_freq"]
    return meta.groupBy("solset", "soltab").agg(*[F.max(c).alias(c) for c in names])


def _gridded(spark: SparkSession, d: str, hide: Column | None) -> DataFrame:
    cells = _read(spark, d, "cells").select("cell_id", "solset", "soltab", station("ant").alias("ant"), "pol", "freq", "time", "val")
    cells = cells.filter(F.col("ant").isNotNull() & F.col("pol").isNotNull() & F.col("val").isNotNull() & ~F.isnan("val"))
    x = cells.join(_grids(spark, d), ["solset", "soltab"])
    chan = F.rint((F.col("freq") - F.col("freq_start")) / F.col("freq_step"))
    x = x.withColumn("chan", F.least(F.greatest(chan, F.lit(0.0)), F.col("n_freq") - 1.0).cast("bigint"))
    x = x.select("cell_id", "solset", "ant", "pol", "chan", "time", "val", "time_start", "time_step", "n_time", F.lit(SEASON).alias("season"))
    return x if hide is None else x.filter(hide)


def _on_grid(spark: SparkSession, d: str, hide: Column | None = None) -> DataFrame:
    x = _gridded(spark, d, hide)
    return regular_series(x, ["solset", "ant", "pol", "chan"], "time", "val", "time_start", "time_step", "n_time", row_id="cell_id", period="season")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a usable reading."""
    return _on_grid(spark, d).filter(F.col("state") != "observed").select("solset", "ant", "pol", "chan", "slot")


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    """The regular series, missing slots filled or marked."""
    return _on_grid(spark, d)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Slots and filled slots of each solset."""
    return _on_grid(spark, d).groupBy("solset").agg(F.count(F.lit(1)).alias("slots"), F.sum((F.col("state") != "observed").cast("bigint")).alias("missing"))


def p3_states(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each solset and antenna by state, the readings in them, and how many have a value."""
    x = _on_grid(spark, d)
    return x.groupBy("solset", "ant", "state").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.col("n").cast("bigint")).alias("readings"), F.count("val").alias("valued"))


def p3_holdout(spark: SparkSession, d: str) -> DataFrame:
    """What filled values are off: every tenth reading is hidden, its slot filled, and the error set against the scatter of its series.

    Per state: slots, median error in units of the median distance of the series' readings from their median, and the same of
    the regression's rival, the series' median.
    """
    hidden = F.pmod(F.xxhash64("cell_id"), F.lit(10)) == 0
    told, kept = _gridded(spark, d, hidden), stage(_on_grid(spark, d, ~hidden), "filled")  # read several times
    keys = ["solset", "ant", "pol", "chan"]
    t, t0, dt = F.col("time"), F.col("time_start"), F.col("time_step")
    told = told.filter(F.abs("val") < float("inf")).select(*keys, slot_of(t, t0, dt).alias("slot"), F.col("val").alias("true"))
    seen = kept.filter("state = 'observed' AND abs(val) < double('inf')")
    mid = group_medians(seen, keys, "val", "middle")
    away = group_medians(seen.join(mid, keys).withColumn("away", F.abs(F.col("val") - F.col("middle"))), keys, "away", "usual").join(mid, keys).filter("usual > 0")
    x = told.join(kept.filter("n = 0 AND val IS NOT NULL"), [*keys, "slot"]).join(away, keys)
    off = lambda c: F.percentile_approx(F.abs(F.col("true") - F.col(c)) / F.col("usual"), 0.5)
    return x.groupBy("state").agg(F.count(F.lit(1)).alias("slots"), off("val").alias("error"), off("middle").alias("error_of_median"))


def _drift(spark: SparkSession, d: str) -> Drift:
    return Drift(_read(spark, d, "header_records"), "feed", "file_seq", "file_id", "line_no", "body")


def _top(changes: DataFrame) -> DataFrame:
    """What the steps are to the top level: a field that goes under another one is removed there, one that comes up is added."""
    down = (F.col("change") == "moved") & (F.col("depth") == 1)
    up = (F.col("change") == "moved") & (F.col("to_depth") == 1)
    rows = F.array(
        F.when((F.col("depth") == 1) & (F.col("change") != "moved"), F.struct("field", "change")),
        F.when(down, F.struct("field", F.lit("removed").alias("change"))),
        F.when(up, F.struct(F.col("to").alias("field"), F.lit("added").alias("change"))),
    )
    return changes.select("feed", "file_id", F.inline(F.array_compact(rows)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the top-level fields of each file against the one before."""
    return _top(_drift(spark, d).changes())


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """Top-level fields of each file and their types."""
    return _drift(spark, d).fields()


def p5_gone(spark: SparkSession, d: str) -> DataFrame:
    """Names that a file no longer has, whether the field was removed or renamed, and fields of another type."""
    x = _top(_drift(spark, d).changes()).filter("change <> 'added'")
    return x.select("feed", "file_id", "field", F.when(F.col("change") == "retyped", "retyped").otherwise("gone").alias("change"))


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    """Steps of all scripts by depth, field and kind of change."""
    x = _drift(spark, d).changes()
    return x.groupBy("depth", "field", "to_depth", "to", "change").agg(F.count(F.lit(1)).alias("files"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable lines of all files under one schema."""
    drift = _drift(spark, d)
    return drift.table(drift.canonical(drift.changes()))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    """Values of each feed in the one table."""
    t = p5_table(spark, d)
    held = [F.col(c).isNotNull().cast("bigint") for c in t.columns if c not in ("feed", "file_seq", "file_id", "line_no", "also")]
    total = F.size("also").cast("bigint")
    for h in held:
        total = total + h
    return t.groupBy("feed").agg(F.count(F.lit(1)).alias("lines"), F.sum(total).alias("kept"))


def queries():
    return {"p3_found": p3_found, "p3_series": p3_series, "p3_coverage": p3_coverage, "p3_states": p3_states, "p3_holdout": p3_holdout, "p4_found": p4_found, "p4_readings": p4_readings, "p5_found": p5_found, "p5_changes": p5_changes, "p5_table": p5_table, "p5_fields": p5_fields, "p5_gone": p5_gone, "p5_kept": p5_kept}


_GRID = """
WITH m AS (SELECT solset, soltab, max(time_start) t0, max(time_step) dt, max(n_time) n, max(freq_start) f0, max(freq_step) df, max(n_freq) nf
  FROM soltab_meta WHERE n_time IS NOT NULL AND n_freq IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.cell_id, c.val, c.solset, upper(trim(c.ant)) AS ant, c.pol, CAST(least(greatest(round_even((c.freq - m.f0) / m.df, 0), 0), nf - 1) AS BIGINT) AS chan,
  c.time, m.t0, m.dt, m.n, CAST(floor((c.time - m.t0) / m.dt) AS BIGINT) AS k
  FROM cells c JOIN m USING (solset, soltab) WHERE c.ant IS NOT NULL AND c.pol IS NOT NULL AND c.val IS NOT NULL AND NOT isnan(c.val)),
o AS (SELECT cell_id, val, solset, ant, pol, chan, n, CASE WHEN time < t0 + k * dt THEN k - 1 WHEN time >= t0 + (k + 1) * dt THEN k + 1 ELSE k END AS slot FROM r),
s AS (SELECT solset, ant, pol, chan, max(n) AS n FROM o GROUP BY ALL),
g AS (SELECT solset, ant, pol, chan, unnest(range(CAST(n AS BIGINT))) AS slot FROM s),
x AS (SELECT g.* FROM g ANTI JOIN o USING (solset, ant, pol, chan, slot))
"""


def _wrong_sql(levels: int = 3, turns: int = 2) -> str:
    """The wavelet rule by window functions: two decompositions, the second without the readings of large details."""
    series = "solset, ant, pol, freq"
    q = f"""
WITH r AS (SELECT DISTINCT cell_id, solset, upper(trim(ant)) AS ant, pol, freq, time, val, weight FROM cells),
k AS (SELECT * FROM r WHERE val IS NOT NULL AND NOT isnan(val)),
e AS (SELECT *, coalesce(val <> lag(val) OVER (PARTITION BY {series} ORDER BY time, cell_id), TRUE)::INT AS b FROM k),
g AS (SELECT *, sum(b) OVER (PARTITION BY {series} ORDER BY time, cell_id) AS run FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY {series}, run) AS len FROM g),
v AS (SELECT *, len < 6 AND val > 0 AND NOT isinf(val) AS ok FROM n),
u AS (SELECT cell_id, {series}, time, CASE WHEN ok THEN val END AS val, ok AND count(*) FILTER (ok) OVER (PARTITION BY {series}) >= 8 AS use FROM v)"""

    def smooths(source: str, flag: str, to: str) -> str:
        out = f""",
{to}0 AS (SELECT *, CASE WHEN {flag} THEN val ELSE 0 END AS a0, ({flag})::INT::DOUBLE AS b0 FROM {source})"""
        for j in range(levels):
            terms = {}
            for c in "ab":
                near = [f"coalesce({f}({c}{j}, {k * 2**j}) OVER w, 0) * {p} / 16" for k, p in ((1, 4), (2, 1)) for f in ("lead", "lag")]
                terms[c] = f"{c}{j} * 6 / 16 + " + " + ".join(near)
            out += f""",
{to}{j + 1} AS (SELECT *, {terms['a']} AS a{j + 1}, {terms['b']} AS b{j + 1} FROM {to}{j} WINDOW w AS (PARTITION BY {series} ORDER BY time, cell_id))"""
        return out

    part = lambda j: f"CASE WHEN b{j} > 0 THEN a{j} / b{j} END"
    q += smooths("u", "use", "x")
    details = ", ".join(f"CASE WHEN use THEN abs({part(j) if j else 'val'} - {part(j + 1)}) END AS d{j}" for j in range(levels))
    usual = ", ".join(f"median(d{j}) OVER (PARTITION BY {series}) AS m{j}" for j in range(levels))
    large = " OR ".join(f"d{j} > 5 * 1.4826 * m{j}" for j in range(levels))
    q += f""",
d AS (SELECT cell_id, {series}, time, val, use, {details} FROM x{levels}),
m AS (SELECT *, {usual} FROM d),
f0 AS (SELECT cell_id, {series}, time, val, use, use AND NOT coalesce({large}, FALSE) AS free FROM m)"""
    for i in range(turns):
        q += smooths(f"f{i}", "free", f"y{i}_") + f""",
l{i} AS (SELECT cell_id, {series}, time, val, use, free, abs(val - coalesce({part(levels)}, median(val) FILTER (free) OVER (PARTITION BY {series}))) AS rest FROM y{i}_{levels}),
s{i} AS (SELECT *, 1.4826 * median(rest) FILTER (free) OVER (PARTITION BY {series}) AS mad, 1.2533 * avg(rest) FILTER (free) OVER (PARTITION BY {series}) AS mean FROM l{i}),
f{i + 1} AS (SELECT cell_id, {series}, time, val, use, use AND NOT coalesce(rest > 5 * CASE WHEN mad > 0 THEN mad ELSE mean END, FALSE) AS free FROM s{i})"""
    return q + f"""
SELECT cell_id FROM s{turns - 1} WHERE use AND rest > 10 * CASE WHEN mad > 0 THEN mad ELSE mean END AND (mad > 0 OR mean > 0)
UNION SELECT cell_id FROM n WHERE len >= 6 UNION SELECT cell_id FROM k WHERE val <= 0 OR isinf(val)
UNION SELECT cell_id FROM r WHERE weight < 0 OR (weight > 1 AND NOT isnan(weight))"""


_FIELDS = """
WITH h AS (SELECT DISTINCT feed, file_seq, file_id, line_no, body FROM header_records WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
v AS (SELECT feed, file_seq, file_id, line_no, unnest(json_keys(body)) AS field, body FROM h),
t AS (SELECT feed, file_seq, file_id, field, CASE json_type(body, '$."' || field || '"') WHEN 'VARCHAR' THEN 'text' WHEN 'BIGINT' THEN 'whole number'
  WHEN 'UBIGINT' THEN 'whole number' WHEN 'DOUBLE' THEN 'real number' WHEN 'BOOLEAN' THEN 'true/false' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END AS kind FROM v),
c AS (SELECT feed, file_seq, file_id, field, kind, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT feed, file_seq, file_id, field, CASE WHEN count(*) FILTER (kind = 'whole number') > 0 AND count(*) FILTER (kind = 'real number') > 0 THEN 'real number'
  ELSE arg_max(kind, n) FILTER (kind IS NOT NULL) END AS kind FROM c GROUP BY ALL),
f AS (SELECT feed, file_seq, file_id, field, coalesce(kind, last_value(kind IGNORE NULLS) OVER (PARTITION BY feed, field ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS kind FROM m),
o AS (SELECT feed, file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY file_seq) AS earlier FROM (SELECT DISTINCT feed, file_seq, file_id FROM h))
"""


def oracle_sql():
    return {
        "p5_fields": _FIELDS + "SELECT feed, file_id, field, kind FROM f",
        "p5_gone": _FIELDS + """SELECT o.feed, o.file_id, a.field, CASE WHEN b.field IS NULL THEN 'gone' ELSE 'retyped' END AS change
FROM o JOIN f a ON a.file_id = o.earlier LEFT JOIN f b ON b.file_id = o.file_id AND b.field = a.field WHERE b.field IS NULL OR a.kind <> b.kind""",
        "p5_kept": _FIELDS + """SELECT feed, lines, kept FROM (SELECT feed, count(*) AS lines FROM h GROUP BY 1)
JOIN (SELECT feed, count(*) FILTER (json_type(body, '$."' || field || '"') <> 'NULL') AS kept FROM v GROUP BY 1) USING (feed)""",
        "p4_found": _wrong_sql(),
        "p3_found": _GRID + "SELECT solset, ant, pol, chan, slot FROM x",
        "p3_states": _GRID + """,
f AS (SELECT o.solset, o.ant, o.pol, o.chan, o.slot, count(DISTINCT o.cell_id) AS n, count(*) FILTER (NOT isinf(o.val)) AS finite FROM o WHERE slot BETWEEN 0 AND n - 1 GROUP BY ALL),
e AS (SELECT solset, ant, pol, chan, min(slot) FILTER (finite > 0) AS lo, max(slot) FILTER (finite > 0) AS hi FROM f GROUP BY ALL),
z AS (SELECT g.solset, g.ant, coalesce(f.n, 0) AS n, CASE WHEN f.n > 0 THEN 'observed' WHEN e.lo IS NULL THEN 'marked' WHEN g.slot > e.lo AND g.slot < e.hi THEN 'bridged' ELSE 'extended' END AS state
  FROM g LEFT JOIN f USING (solset, ant, pol, chan, slot) LEFT JOIN e USING (solset, ant, pol, chan))
SELECT solset, ant, state, count(*) AS slots, CAST(sum(n) AS BIGINT) AS readings, count(*) FILTER (state <> 'marked') AS valued FROM z GROUP BY ALL""",
        "p3_coverage": _GRID + ", a AS (SELECT solset, count(*) AS slots FROM g GROUP BY 1), b AS (SELECT solset, count(*) AS missing FROM x GROUP BY 1) "
        "SELECT solset, slots, coalesce(missing, 0) AS missing FROM a LEFT JOIN b USING (solset)",
    }
