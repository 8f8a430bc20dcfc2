"""Solution tables made of the general test tables, in SQL that both engines read.

Logarithms of averages serve as values, so that figures rounded to 6 digits agree between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from solweave.model import Solutions

PI = "3.141592653589793e0"


def wrapped(x: str) -> str:
    return f"(({x}) - 2 * {PI} * floor((({x}) + {PI}) / (2 * {PI})))"


_ANT = "concat('CS', lpad(cast({key} as {s}), 4, '0'))"
_W = "CASE WHEN count(*) >= 2 THEN 1e0 ELSE 0e0 END AS weight"

#: name -> (SQL, axes, kind)
TABLES = {
    "li_amp": (
        f"SELECT {_ANT.format(key='l_suppkey', s='{s}')} AS ant, l_returnflag AS pol, cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint) AS time, "
        f"ln(1 + avg(l_extendedprice)) AS val, {_W} FROM lineitem GROUP BY 1, 2, 3",
        ("ant", "pol", "time"), "amplitude",
    ),
    "li_dir": (
        f"SELECT concat(l_returnflag, l_linestatus) AS dir, {_ANT.format(key='(l_suppkey % 10 + 1)', s='{s}')} AS ant, cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint) AS time, "
        f"ln(1 + avg(l_extendedprice)) AS val, {_W} FROM lineitem GROUP BY 1, 2, 3",
        ("dir", "ant", "time"), "amplitude",
    ),
    "li_dirs": (
        f"SELECT concat('D', lpad(cast(l_partkey % 12 as {{s}}), 2, '0')) AS dir, {_ANT.format(key='(l_suppkey % 3 + 1)', s='{s}')} AS ant, "
        f"cast(year(l_shipdate) as bigint) AS time, ln(1 + avg(l_extendedprice)) AS val, 1e0 AS weight FROM lineitem GROUP BY 1, 2, 3",
        ("dir", "ant", "time"), "amplitude",
    ),
    "ev_amp": (
        f"SELECT {_ANT.format(key='(user_id % 10 + 1)', s='{s}')} AS ant, cast(hour(ts) as bigint) AS freq, cast(dayofyear(ts) as bigint) AS time, "
        f"ln(1 + avg(value)) AS val, {_W} FROM events GROUP BY 1, 2, 3",
        ("ant", "freq", "time"), "amplitude",
    ),
    "ev_ph": (
        f"SELECT ant, nu AS freq, time, {wrapped('20 * v')} AS val, weight FROM (SELECT {_ANT.format(key='(user_id % 10 + 1)', s='{s}')} AS ant, "
        f"120e6 + hour(ts) * 2.5e6 AS nu, cast(dayofyear(ts) as bigint) AS time, ln(1 + avg(value)) AS v, {_W} FROM events GROUP BY 1, 2, 3) x",
        ("ant", "freq", "time"), "phase",
    ),
    "ev_pol": (
        f"SELECT ant, pol, nu AS freq, time, {wrapped('20 * v')} AS val, weight FROM (SELECT {_ANT.format(key='(user_id % 10 + 1)', s='{s}')} AS ant, "
        f"CASE WHEN event_id % 2 = 0 THEN 'XX' ELSE 'YY' END AS pol, 120e6 + hour(ts) * 2.5e6 AS nu, cast(dayofyear(ts) as bigint) AS time, ln(1 + avg(value)) AS v, {_W} FROM events GROUP BY 1, 2, 3, 4) x",
        ("ant", "pol", "freq", "time"), "phase",
    ),
    "ev_time": (
        f"SELECT {_ANT.format(key='(user_id % 10 + 1)', s='{s}')} AS ant, cast(dayofyear(ts) as bigint) AS time, ln(1 + avg(value)) AS val, {_W} FROM events GROUP BY 1, 2",
        ("ant", "time"), "clock",
    ),
}

ANTENNAS = f"SELECT {_ANT.format(key='s_suppkey', s='{s}')} AS name, cast(s_acctbal as float) AS x, cast(100 * s_nationkey as float) AS y, cast(10 * s_suppkey as float) AS z FROM supplier"

#: Known electron content, clock (ns), rotation measure and delay per station and time, on multiples of 0.01.
TRUTH = (
    "SELECT DISTINCT cast(user_id % 10 + 1 as int) AS a, cast(dayofyear(ts) as int) AS time FROM events"
)


def _views(d: str, sql: str) -> str:
    for t in ("lineitem", "events", "supplier", "embeddings"):
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{d}/{t}.parquet`")
    return sql


def table(spark: SparkSession, d: str, name: str, kind: str | None = None) -> Solutions:
    sql, axes, own = TABLES[name]
    return Solutions.of(spark.sql(_views(d, sql.replace("{s}", "string"))), axes, kind or own, name)


def frame(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(_views(d, sql.replace("{s}", "string")))


def antennas(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, ANTENNAS).selectExpr("name", "array(x, y, z) AS position")


def cte(*names: str) -> str:
    """WITH clauses for DuckDB."""
    parts = [f"{n} AS ({(ANTENNAS if n == 'antennas' else TABLES[n][0]).replace('{s}', 'varchar')})" for n in names]
    return "WITH " + ",\n".join(parts)
