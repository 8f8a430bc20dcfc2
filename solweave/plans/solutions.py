"""Queries of the operators on solution tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solweave.functions import frames, scalar
from solweave.functions.scalar import LIGHT, TEC3_PHASE, TEC_PHASE
from solweave.model import Solutions
from solweave.operators import cells, fits, flagging, plotting, referencing, smoothing
from solweave.operators.residuals import residuals
from solweave.operators.selection import select, set_axis_values, set_values
from solweave.plans import proxies
from solweave.plans.proxies import PI, TRUTH, cte, wrapped
from solweave.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _rows(x: Solutions | DataFrame) -> DataFrame:
    if isinstance(x, Solutions):
        x = x.df.select(*x.axes, "val", "weight")
    return x.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" and c != "freq" else F.col(c) for c, t in x.dtypes])


def _add(name: str, f: Callable[[SparkSession, str], Solutions | DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = lambda spark, d: _rows(f(spark, d))
    if sql:
        _SQL[name] = sql


def _t(name: str, kind: str | None = None) -> Callable[[SparkSession, str], Solutions]:
    return lambda s, d: proxies.table(s, d, name, kind)


amp, dirs, evamp, ph, pol, evt = (_t(n) for n in ("li_amp", "li_dir", "ev_amp", "ev_ph", "ev_pol", "ev_time"))
R = lambda x: f"round({x}, 6) + 0.0"
A = cte("li_amp")
OUT = f"ant, pol, time, {R('val')} AS val, weight"

# the flagship --------------------------------------------------------------------------------------


def _flagship(s: SparkSession, d: str) -> DataFrame:
    x = select(amp(s, d), pol=["A", "N"])
    x = cells.norm(cells.clip(x, ["time", "pol"], 3), ["time"])
    out = x.df.groupBy("ant").agg(F.count(F.lit(1)).alias("cells"), F.avg((F.col("weight") == 0).cast("double")).alias("flagged"), F.max("val").alias("top"))
    return out


_add("flagship", _flagship, A + f""", s AS (SELECT * FROM li_amp WHERE pol IN ('A', 'N')),
g AS (SELECT ant, median(val) FILTER (weight <> 0) AS m, stddev_pop(val) FILTER (weight <> 0) AS sd FROM s GROUP BY 1),
c AS (SELECT s.ant, pol, time, val, CASE WHEN abs(val - m) > 3 * sd THEN 0.0 ELSE weight END AS weight FROM s JOIN g USING (ant)),
n AS (SELECT ant, pol, weight, CASE WHEN weight <> 0 THEN val / avg(val) FILTER (weight <> 0) OVER (PARTITION BY ant, pol) ELSE val END AS val FROM c)
SELECT ant, count(*) AS cells, {R('avg(CASE WHEN weight = 0 THEN 1.0 ELSE 0.0 END)')} AS flagged, {R('max(val)')} AS top FROM n GROUP BY 1""")  # fmt: skip

# cell by cell --------------------------------------------------------------------------------------
_shift = lambda t: t.put(t.df.withColumn("val", F.col("val") - 10.4))
_add("abs_values", lambda s, d: cells.absolute(_shift(amp(s, d))), A + f"SELECT ant, pol, time, {R('abs(val - 10.4)')} AS val, weight FROM li_amp")
_add("duplicate_select", lambda s, d: cells.duplicate(amp(s, d), "copy", pol="A|R", time={"min": 23950}), A + f"SELECT {OUT} FROM li_amp WHERE pol IN ('A', 'R') AND time >= 23950")
for _which in ("first", "last"):
    _f = "min" if _which == "first" else "max"
    _add(f"deleteaxis_{_which}", lambda s, d, w=_which: cells.delete_axis(amp(s, d), "time", w), A + f"SELECT ant, pol, {R('val')} AS val, weight FROM li_amp WHERE time = (SELECT {_f}(time) FROM li_amp)")
_add("deleteaxis_value", lambda s, d: cells.delete_axis(amp(s, d), "pol", "N"), A + f"SELECT ant, time, {R('val')} AS val, weight FROM li_amp WHERE pol = 'N'")
_add("reset_scalar", lambda s, d: cells.reset(amp(s, d)), A + "SELECT ant, pol, time, 1.0::DOUBLE AS val, weight FROM li_amp")
_JONES = "concat(substr('XY', cast(time % 2 + 1 as int), 1), substr('XY', cast(time // 2 % 2 + 1 as int), 1))"


def _jones(s: SparkSession, d: str) -> Solutions:
    x = amp(s, d)
    four = F.concat(F.expr("substr('XY', cast(time % 2 + 1 as int), 1)"), F.expr("substr('XY', cast(floor(time / 2) % 2 + 1 as int), 1)"))
    return Solutions(x.df.withColumn("pol", four).groupBy("ant", "pol", "time").agg(F.max("val").alias("val"), F.max("weight").alias("weight")), x.axes, "amplitude", "jones")


_J = A + f", j AS (SELECT ant, {_JONES} AS pol, time, max(val) AS val, max(weight) AS weight FROM li_amp GROUP BY 1, 2, 3)"
_add("reset_fulljones", lambda s, d: cells.reset(_jones(s, d)), _J + "SELECT ant, pol, time, CASE WHEN pol IN ('XX', 'YY') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS val, weight FROM j")


def _clip_sql(x: str, stats: str = "weight <> 0") -> str:
    return A + f""", v AS (SELECT *, {x} AS x FROM li_amp), g AS (SELECT ant, pol, median(x) FILTER ({stats}) AS m, stddev_pop(x) FILTER ({stats}) AS sd FROM v GROUP BY 1, 2)
SELECT ant, pol, time, {R('val')} AS val, CASE WHEN abs(x - m) > 2 * sd THEN 0.0 ELSE weight END AS weight FROM v JOIN g USING (ant, pol)"""


_add("clip_median", lambda s, d: cells.clip(amp(s, d), ["time"], 2), _clip_sql("val"))
_add("clip_median_log", lambda s, d: cells.clip(amp(s, d), ["time"], 2, log=True), _clip_sql("log10(val)"))
_add("clip_above", lambda s, d: cells.clip(amp(s, d), ["time"], 10.6, mode="above"), A + f"SELECT ant, pol, time, {R('val')} AS val, CASE WHEN val > 10.6 THEN 0.0 ELSE weight END AS weight FROM li_amp")
_add("clip_below", lambda s, d: cells.clip(amp(s, d), ["time"], 1.01, log=True, mode="below"), A + f"SELECT ant, pol, time, {R('val')} AS val, CASE WHEN log10(val) < 1.01 THEN 0.0 ELSE weight END AS weight FROM li_amp")
_add("norm_linear", lambda s, d: cells.norm(amp(s, d), ["time"], 2.0),
     A + f"SELECT ant, pol, time, {R('CASE WHEN weight <> 0 THEN val * 2.0 / avg(val) FILTER (weight <> 0) OVER (PARTITION BY ant, pol) ELSE val END')} AS val, weight FROM li_amp")
_add("norm_log", lambda s, d: cells.norm(amp(s, d), ["time"], 2.0, log=True),
     A + f"SELECT ant, pol, time, {R('CASE WHEN weight <> 0 THEN val + log10(2.0::DOUBLE) - avg(val) FILTER (weight <> 0) OVER (PARTITION BY ant, pol) ELSE val END')} AS val, weight FROM li_amp")

# selection -----------------------------------------------------------------------------------------
_I = A + ", i AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM li_amp))"
for _name, _want, _sql in (
    ("regex", {"ant": "CS00[1-3]"}, A + f"SELECT {OUT} FROM li_amp WHERE regexp_matches(ant, 'CS00[1-3]')"),
    ("list", {"ant": ["CS0003", "CS0007", "none"], "pol": "A"}, A + f"SELECT {OUT} FROM li_amp WHERE ant IN ('CS0003', 'CS0007') AND pol = 'A'"),
    ("minmax", {"time": {"min": 23940, "max": 23960}}, A + f"SELECT {OUT} FROM li_amp WHERE time BETWEEN 23940 AND 23960"),
    ("step", {"time": {"min": 23930, "max": 23970, "step": 4}}, _I + f", k AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS k FROM i WHERE time BETWEEN 23930 AND 23970) SELECT {OUT} FROM li_amp WHERE time IN (SELECT time FROM k WHERE k % 4 = 0)"),
    ("slice", {"time": slice(3, 40, 5)}, _I + f"SELECT {OUT} FROM li_amp WHERE time IN (SELECT time FROM i WHERE i >= 3 AND i < 40 AND (i - 3) % 5 = 0)"),
    ("empty_fallback", {"ant": "nothing like it", "pol": ["A"]}, A + f"SELECT {OUT} FROM li_amp WHERE pol = 'A'"),
):
    _add(f"select_{_name}", lambda s, d, w=_want: select(amp(s, d), **w), _sql)
_add("set_axis_values", lambda s, d: set_axis_values(amp(s, d), "pol", {"A": "XX", "R": "YY"}), A + f"SELECT ant, CASE pol WHEN 'A' THEN 'XX' WHEN 'R' THEN 'YY' ELSE pol END AS pol, time, {R('val')} AS val, weight FROM li_amp")
_add("set_values", lambda s, d: set_values(amp(s, d), amp(s, d).df.groupBy("ant").agg(F.max("val").alias("val")).filter("ant < 'CS0005'")),
     A + f"SELECT ant, pol, time, {R('CASE WHEN ant < $$CS0005$$ THEN max(val) OVER (PARTITION BY ant) ELSE val END')} AS val, weight FROM li_amp")
_add("densify", lambda s, d: amp(s, d).densify(), A + f""", g AS (SELECT a.ant, p.pol, t.time FROM (SELECT DISTINCT ant FROM li_amp) a, (SELECT DISTINCT pol FROM li_amp) p, (SELECT DISTINCT time FROM li_amp) t)
SELECT g.ant, g.pol, g.time, {R('val')} AS val, coalesce(weight, 0.0) AS weight FROM g LEFT JOIN li_amp USING (ant, pol, time)""")  # fmt: skip

# referencing ---------------------------------------------------------------------------------------
_REF = "SELECT x.ant, x.pol, x.time, round(x.val - r.val, 6) + 0.0 AS val, x.weight FROM li_amp x LEFT JOIN li_amp r ON r.pol = x.pol AND r.time = x.time AND r.ant = "
_add("reference_ant", lambda s, d: referencing.reference(amp(s, d), "CS0002"), A + _REF + "'CS0002'")
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_P = cte("li_amp", "antennas") + ", p AS (SELECT name AS ant, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM antennas)"
_add("reference_auto", lambda s, d: referencing.reference(amp(s, d), "auto", antennas=proxies.antennas(s, d)),
     _P + f", b AS (SELECT median(x) AS x, median(y) AS y, median(z) AS z FROM p), n AS (SELECT a.ant FROM p a, b WHERE a.ant IN (SELECT ant FROM li_amp) ORDER BY {_DIST}, a.ant LIMIT 10), "
     "best AS (SELECT ant FROM li_amp WHERE ant IN (SELECT ant FROM n) GROUP BY ant ORDER BY count(*) FILTER (weight <> 0) DESC, ant LIMIT 1) " + _REF + "(SELECT ant FROM best)")  # fmt: skip
_CLOSE = _P + f""", dead AS (SELECT ant FROM li_amp GROUP BY 1 HAVING max(abs(weight)) = 0), k AS (SELECT DISTINCT p.* FROM p JOIN li_amp USING (ant)),
n AS (SELECT ant, ref FROM (SELECT a.ant, b.ant AS ref, row_number() OVER (PARTITION BY a.ant ORDER BY {_DIST}, b.ant) AS rn FROM k a JOIN k b ON a.ant <> b.ant WHERE b.ant NOT IN (SELECT ant FROM dead)) WHERE rn = 1)"""
_add("reference_closest", lambda s, d: referencing.reference(amp(s, d), "closest", antennas=proxies.antennas(s, d)),
     _CLOSE + f" SELECT x.ant, x.pol, x.time, {R('x.val - r.val')} AS val, x.weight FROM li_amp x LEFT JOIN n USING (ant) LEFT JOIN li_amp r ON r.ant = n.ref AND r.pol = x.pol AND r.time = x.time")
_add("antenna_distances", lambda s, d: referencing.antenna_distances(proxies.antennas(s, d)), _P + f", b AS (SELECT median(x) AS x, median(y) AS y, median(z) AS z FROM p) SELECT a.ant, {R(_DIST)} AS dist FROM p a, b")


def _sources(s: SparkSession, d: str) -> DataFrame:
    names = dirs(s, d).axis("dir").select(F.col("dir").alias("name"), F.col("i").alias("vec_id"))
    vec = s.read.parquet(f"{d}/embeddings.parquet").groupBy("vec_id").agg(F.min_by("embedding", "vec_id").alias("e"))
    low = vec.agg(F.min("vec_id").alias("low"))
    return vec.join(F.broadcast(low), how="cross").withColumn("vec_id", F.col("vec_id") - F.col("low")).join(names, "vec_id").select("name", F.slice("e", 1, 2).alias("dir"))


_D = cte("li_dir") + """, v AS (SELECT vec_id - (SELECT min(vec_id) FROM embeddings) AS i, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
n AS (SELECT dir, row_number() OVER (ORDER BY dir) - 1 AS i FROM (SELECT DISTINCT dir FROM li_dir)), s AS (SELECT dir, a, b FROM n JOIN v USING (i)),
m AS (SELECT avg(a) AS a0, avg(b) AS b0 FROM s), c AS (SELECT dir FROM s, m ORDER BY (a - a0) * (a - a0) + (b - b0) * (b - b0), dir LIMIT 1)"""
_add("reference_dir_center", lambda s, d: referencing.reference(dirs(s, d), direction="center", sources=_sources(s, d)),
     _D + f" SELECT x.dir, x.ant, x.time, {R('x.val - r.val')} AS val, x.weight FROM li_dir x LEFT JOIN li_dir r ON r.ant = x.ant AND r.time = x.time AND r.dir = (SELECT dir FROM c)")
_add("reference_ant_dir", lambda s, d: referencing.reference(dirs(s, d), "CS0002", "NO"),
     cte("li_dir") + f" SELECT x.dir, x.ant, x.time, {R('x.val - r.val')} AS val, x.weight FROM li_dir x LEFT JOIN li_dir r ON r.time = x.time AND r.ant = 'CS0002' AND r.dir = 'NO'")
_add("reference_one_pol", lambda s, d: referencing.reference(_jones(s, d), "CS0002"),
     _J + f" SELECT x.ant, x.pol, x.time, {R('x.val - r.val')} AS val, x.weight FROM j x LEFT JOIN j r ON r.time = x.time AND r.ant = 'CS0002' AND r.pol = 'XX'")

# replication ---------------------------------------------------------------------------------------
_add("replicate_first", lambda s, d: cells.replicate_on_axis(amp(s, d), "time", "first"),
     A + f" SELECT x.ant, x.pol, x.time, {R('r.val')} AS val, coalesce(r.weight, 0.0) AS weight FROM li_amp x LEFT JOIN li_amp r ON r.ant = x.ant AND r.pol = x.pol AND r.time = (SELECT min(time) FROM li_amp)")
_add("replicate_nonflagged_mean", lambda s, d: cells.replicate_on_axis(amp(s, d), "ant", "nonflaggedCS"),
     A + f" SELECT ant, pol, time, {R('avg(val) FILTER (weight <> 0) OVER w')} AS val, (CASE WHEN count(*) FILTER (weight <> 0) OVER w > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS weight FROM li_amp WINDOW w AS (PARTITION BY pol, time)")

# residuals -----------------------------------------------------------------------------------------


def _mean_over_freq(t: Solutions, kind: str, scale: float) -> Solutions:
    x = t.df.groupBy(*[a for a in t.axes if a != "freq"]).agg((F.avg("val") * scale).alias("val"), F.max("weight").alias("weight"))
    return Solutions(x, tuple(a for a in t.axes if a != "freq"), kind, f"{kind}000")


def _res_sql(src: str, on: str, axes: str, scale: float, model: str) -> str:
    return cte(src) + f""", s AS (SELECT {on}, avg(val) * {scale!r}::DOUBLE AS v, max(weight) AS w FROM {src} GROUP BY ALL)
SELECT {axes}, {R(f"val - ({model})")} AS val, CASE WHEN w IS NULL OR w = 0 THEN 0.0 ELSE weight END AS weight FROM {src} LEFT JOIN s USING ({on})"""


_add("residuals_same", lambda s, d: residuals(ph(s, d), [_mean_over_freq(ph(s, d), "phase", 1.0)]), _res_sql("ev_ph", "ant, time", "ant, freq, time", 1.0, "v"))
for _kind, _scale, _model in (
    ("clock", 1e-9, f"2 * {PI} * v * freq"), ("tec", 0.1, f"{TEC_PHASE!r}::DOUBLE * v / freq"), ("tec3rd", 1e3, f"{TEC3_PHASE!r}::DOUBLE * v / (freq * freq * freq)"),
):
    _add(f"residuals_{_kind}", lambda s, d, k=_kind, c=_scale: residuals(ph(s, d), [_mean_over_freq(ph(s, d), k, c)]), _res_sql("ev_ph", "ant, time", "ant, freq, time", _scale, _model))
_LAMBDA2 = f"pow({LIGHT!r}::DOUBLE / freq, 2)"
_add("residuals_rm_phase", lambda s, d: residuals(pol(s, d), [_mean_over_freq(ph(s, d), "rotationmeasure", 0.1)]),
     cte("ev_pol", "ev_ph") + f""", s AS (SELECT ant, time, avg(val) * 0.1::DOUBLE AS v, max(weight) AS w FROM ev_ph GROUP BY ALL)
SELECT ant, pol, freq, time, {R(f"val - CASE WHEN pol = 'XX' THEN -({_LAMBDA2} * v) ELSE {_LAMBDA2} * v END")} AS val, CASE WHEN w IS NULL OR w = 0 THEN 0.0 ELSE weight END AS weight FROM ev_pol LEFT JOIN s USING (ant, time)""")  # fmt: skip
_add("residuals_rm_rotation", lambda s, d: residuals(_t("ev_ph", "rotation")(s, d), [_mean_over_freq(ph(s, d), "rotationmeasure", 0.1)]), _res_sql("ev_ph", "ant, time", "ant, freq, time", 0.1, f"{_LAMBDA2} * v"))
_add("residuals_ratio", lambda s, d: residuals(evamp(s, d), [_mean_over_freq(evamp(s, d), "amplitude", 1.0)], ratio=True),
     cte("ev_amp") + f""", s AS (SELECT ant, time, avg(val) AS v, max(weight) AS w FROM ev_amp GROUP BY ALL)
SELECT ant, freq, time, {R('(val - v) / v')} AS val, CASE WHEN w = 0 THEN 0.0 ELSE weight END AS weight FROM ev_amp LEFT JOIN s USING (ant, time)""")  # fmt: skip

# weights -------------------------------------------------------------------------------------------
_add("reweight_uniform", lambda s, d: cells.reweight_uniform(amp(s, d), 0.5), A + f"SELECT ant, pol, time, {R('val')} AS val, 0.5::DOUBLE AS weight FROM li_amp")
_add("reweight_copy", lambda s, d: cells.reweight_copy(amp(s, d), cells.reweight_uniform(cells.duplicate(amp(s, d), "c", pol="A|N"), 0.7)),
     A + f"SELECT ant, pol, time, {R('val')} AS val, CASE WHEN weight = 0 OR pol NOT IN ('A', 'N') THEN 0.0 ELSE 0.7::DOUBLE END AS weight FROM li_amp")
_add("reweight_flagbad", lambda s, d: cells.flag_defaults(cells.reset(amp(s, d))), A + "SELECT ant, pol, time, 1.0::DOUBLE AS val, 0.0::DOUBLE AS weight FROM li_amp")
_WIN = lambda k: f"(PARTITION BY {k} ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_MED3 = lambda k: f"(PARTITION BY {k} ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


def _rw_sql(src: str, keys: str, axes: str, sd: str) -> str:
    return cte(src) + f""", v AS (SELECT *, CASE WHEN weight <> 0 THEN val END AS v FROM {src}), {sd},
k AS (SELECT *, CASE WHEN sd > 0 THEN sd END AS ok FROM z), l AS (SELECT *, min(ok) OVER (PARTITION BY ant) AS least FROM k),
w AS (SELECT *, CASE WHEN weight <> 0 THEN CASE WHEN least IS NULL THEN 1.0 ELSE 1 / (2 * coalesce(ok, least) * 2 * coalesce(ok, least)) END END AS w FROM l), m AS (SELECT *, max(w) OVER (PARTITION BY ant) AS top FROM w)
SELECT {axes}, {R('val')} AS val, round(coalesce(CASE WHEN top > 65504 THEN w * 65504 / top ELSE w END, 0.0), 3) AS weight FROM m"""


def _round_weight(t: Solutions) -> Solutions:
    return t.put(t.df.withColumn("weight", F.round("weight", 3)))


_add("reweight_window_amp", lambda s, d: _round_weight(smoothing.reweight_window(amp(s, d), "time", 3, 7)),
     _rw_sql("li_amp", "ant, pol", "ant, pol, time", f"x AS (SELECT *, ln(v) AS x0 FROM v), y AS (SELECT *, x0 - median(x0) OVER {_MED3('ant, pol')} AS x FROM x), z AS (SELECT *, stddev_pop(x) OVER {_WIN('ant, pol')} AS sd FROM y)"))
_cl = lambda f: f"least(greatest({f}(v) - median({f}(v)) OVER {_MED3('ant, freq')}, -1), 1)"
_sdp = lambda c: f"sqrt(greatest(-2 * ln(sqrt(pow(avg({c}) OVER {_WIN('ant, freq')}, 2) + pow(avg(sqrt(1 - {c} * {c})) OVER {_WIN('ant, freq')}, 2))), 0))"
_add("reweight_window_phase", lambda s, d: _round_weight(smoothing.reweight_window(ph(s, d), "time", 3, 7)),
     _rw_sql("ev_ph", "ant, freq", "ant, freq, time", f"y AS (SELECT *, {_cl('cos')} AS re, {_cl('sin')} AS im FROM v), z AS (SELECT *, {_sdp('re')} + {_sdp('im')} AS sd FROM y)"))

# smoothing -----------------------------------------------------------------------------------------
_GV = "CASE WHEN weight <> 0 THEN val END"
_add("smooth_mean", lambda s, d: smoothing.smooth(amp(s, d), ["time"], mode="mean"), A + f"SELECT ant, pol, time, {R(f'avg({_GV}) OVER (PARTITION BY ant, pol)')} AS val, weight FROM li_amp")
_add("smooth_median", lambda s, d: smoothing.smooth(amp(s, d), ["time"], mode="median"), A + f", g AS (SELECT ant, pol, median({_GV}) AS m FROM li_amp GROUP BY 1, 2) SELECT ant, pol, time, {R('m')} AS val, weight FROM li_amp JOIN g USING (ant, pol)")
_F = "OVER (PARTITION BY {k} ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
_keep = lambda x: R(f"CASE WHEN weight <> 0 THEN {x} ELSE val END")
_add("smooth_runningmedian_1d", lambda s, d: smoothing.smooth(amp(s, d), ["time"], [7]), A + f"SELECT ant, pol, time, {_keep(f'median({_GV}) ' + _F.format(k='ant, pol'))} AS val, weight FROM li_amp")
_add("smooth_runningmedian_log_replace", lambda s, d: smoothing.smooth(amp(s, d), ["time"], [6], log=True, replace=True),
     A + f", m AS (SELECT *, pow(10.0, median(log10({_GV})) {_F.format(k='ant, pol')}) AS v FROM li_amp) SELECT ant, pol, time, {R('v')} AS val, (CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS weight FROM m")
_add("smooth_mean_phase", lambda s, d: smoothing.smooth(ph(s, d), ["time"], mode="mean"),
     cte("ev_ph") + f"SELECT ant, freq, time, {R(f'atan2(avg(sin({_GV})) OVER w, avg(cos({_GV})) OVER w)')} AS val, weight FROM ev_ph WINDOW w AS (PARTITION BY ant, freq)")
_add("smooth_runningmedian_phase", lambda s, d: smoothing.smooth(ph(s, d), ["time"], [7]),
     cte("ev_ph") + f"SELECT ant, freq, time, {_keep(f'atan2(median(sin({_GV})) {_F}, median(cos({_GV})) {_F})'.replace('{k}', 'ant, freq'))} AS val, weight FROM ev_ph")
_add("smooth_median_phase", lambda s, d: smoothing.smooth(ph(s, d), ["time"], mode="median"), cte("ev_ph") + f""", x AS (SELECT ant, freq, cos(val) AS a, sin(val) AS b FROM ev_ph WHERE weight <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY ant, freq ORDER BY a, b) AS rn, count(*) OVER (PARTITION BY ant, freq) AS n FROM x),
m AS (SELECT ant, freq, atan2(sum(b), sum(a)) AS v FROM (SELECT * FROM k WHERE rn = (n + 1) // 2 UNION ALL SELECT * FROM k WHERE rn = n // 2 + 1) GROUP BY 1, 2)
SELECT ant, freq, time, {R('v')} AS val, weight FROM ev_ph LEFT JOIN m USING (ant, freq)""")  # fmt: skip
_fit = _F.format(k="ant, pol")
_add("smooth_runningpoly_deg1", lambda s, d: smoothing.smooth(amp(s, d), ["time"], [7], mode="runningpoly"),
     A + f", k AS (SELECT *, row_number() OVER (PARTITION BY ant, pol ORDER BY time)::DOUBLE AS x, {_GV} AS v FROM li_amp), f AS (SELECT *, regr_slope(v, x) {_fit} AS b, regr_intercept(v, x) {_fit} AS a, avg(v) {_fit} AS m, count(v) {_fit} AS n FROM k) "
     f"SELECT ant, pol, time, {_keep('CASE WHEN n >= 2 THEN a + b * x ELSE m END')} AS val, weight FROM f")  # fmt: skip
_add("smooth_runningmedian_2d", lambda s, d: smoothing.smooth(evamp(s, d), ["freq", "time"], [3, 5]), cte("ev_amp") + f""", f AS (SELECT ant, freq, row_number() OVER (PARTITION BY ant ORDER BY freq) AS i FROM (SELECT DISTINCT ant, freq FROM ev_amp)),
t AS (SELECT ant, time, row_number() OVER (PARTITION BY ant ORDER BY time) AS j FROM (SELECT DISTINCT ant, time FROM ev_amp)), c AS (SELECT e.*, i, j FROM ev_amp e JOIN f USING (ant, freq) JOIN t USING (ant, time)),
m AS (SELECT x.ant, x.freq, x.time, median(y.val) AS v FROM c x LEFT JOIN c y ON y.ant = x.ant AND abs(y.i - x.i) <= 1 AND abs(y.j - x.j) <= 2 AND y.weight <> 0 GROUP BY 1, 2, 3)
SELECT ant, freq, time, {_keep('v')} AS val, weight FROM c JOIN m USING (ant, freq, time)""")  # fmt: skip
_HAT = np.vander(np.arange(7), 3) @ np.linalg.pinv(np.vander(np.arange(7), 3))  # the quadratic fit to seven points, at each of them
_add("smooth_savgol", lambda s, d: smoothing.smooth(evamp(s, d), ["time"], [7], mode="savitzky-golay", degree=2), cte("ev_amp") + f""", h(o, k, c) AS (VALUES {', '.join(f'({o}, {k}, {float(_HAT[o, k])!r}::DOUBLE)' for o in range(7) for k in range(7))}),
e AS (SELECT *, CASE WHEN weight <> 0 THEN val END AS g, row_number() OVER (PARTITION BY ant, freq ORDER BY time) AS i, count(*) OVER (PARTITION BY ant, freq) AS n FROM ev_amp),
b AS (SELECT *, last_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER w AS p, last_value(g IGNORE NULLS) OVER w AS pv, first_value(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER z AS q, first_value(g IGNORE NULLS) OVER z AS qv
  FROM e WINDOW w AS (PARTITION BY ant, freq ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY ant, freq ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT *, CASE WHEN p IS NULL THEN qv WHEN q IS NULL OR p = q THEN pv ELSE pv + (qv - pv) * (i - p) / (q - p) END AS y, greatest(1, least(i - 3, n - 6)) AS s FROM b),
m AS (SELECT y.ant, y.freq, y.i, sum(c * x.y) AS m FROM y JOIN y x ON x.ant = y.ant AND x.freq = y.freq AND x.i BETWEEN y.s AND y.s + 6 JOIN h ON h.o = y.i - y.s AND h.k = x.i - y.s GROUP BY 1, 2, 3)
SELECT ant, freq, time, {R('CASE WHEN g IS NOT NULL AND n >= 7 THEN m ELSE val END')} AS val, weight FROM y LEFT JOIN m USING (ant, freq, i)""")  # fmt: skip

# regridding ----------------------------------------------------------------------------------------
_GRID = """, b AS (SELECT min(time)::DOUBLE AS a, max(time)::DOUBLE AS z FROM {src}), g AS (SELECT a + 0.25 + i * 1.5 AS x FROM b, range(0, 100000) r(i) WHERE a + 0.25 + i * 1.5 < z + 0.25 + 0.75),
k AS (SELECT DISTINCT ant, freq FROM {src}), p AS (SELECT * FROM k, g), e AS (SELECT ant, freq, time::DOUBLE AS t, val, weight FROM {src}), ok AS (SELECT * FROM e WHERE weight <> 0), n AS (SELECT ant, freq, count(*) AS n FROM ok GROUP BY 1, 2),
v0 AS (SELECT p.*, ok.t AS t0, ok.val AS y0 FROM p ASOF LEFT JOIN ok ON p.ant = ok.ant AND p.freq = ok.freq AND p.x >= ok.t), v1 AS (SELECT p.*, ok.t AS t1, ok.val AS y1 FROM p ASOF LEFT JOIN ok ON p.ant = ok.ant AND p.freq = ok.freq AND p.x <= ok.t),
w0 AS (SELECT p.*, e.t AS s0, e.weight AS q0 FROM p ASOF LEFT JOIN e ON p.ant = e.ant AND p.freq = e.freq AND p.x >= e.t), w1 AS (SELECT p.*, e.t AS s1, e.weight AS q1 FROM p ASOF LEFT JOIN e ON p.ant = e.ant AND p.freq = e.freq AND p.x <= e.t)
SELECT ant, freq, round(x, 6) + 0.0 AS time, round(CASE WHEN n >= 3 THEN CASE WHEN t0 = t1 THEN y0 ELSE y0 + (y1 - y0) * (x - t0) / (t1 - t0) END END, 6) + 0.0 AS val,
  coalesce(round_even(CASE WHEN s0 = s1 THEN q0 ELSE q0 + (q1 - q0) * (x - s0) / (s1 - s0) END, 0), 0.0) + 0.0 AS weight
FROM v0 JOIN v1 USING (ant, freq, x) JOIN w0 USING (ant, freq, x) JOIN w1 USING (ant, freq, x) LEFT JOIN n USING (ant, freq)"""
_add("interpolate_linear", lambda s, d: smoothing.interpolate(evamp(s, d), "time", 1.5), cte("ev_amp") + _GRID.format(src="ev_amp"))
_GAPS = """, o AS (SELECT *, (weight <> 0)::INT AS k FROM ev_amp), r AS (SELECT *, row_number() OVER (PARTITION BY ant, freq ORDER BY time) - row_number() OVER (PARTITION BY ant, freq, k ORDER BY time) AS run FROM o),
z AS (SELECT *, count(*) OVER (PARTITION BY ant, freq, k, run) AS n, min(time) FILTER (k = 1) OVER (PARTITION BY ant, freq) AS a, max(time) FILTER (k = 1) OVER (PARTITION BY ant, freq) AS b FROM r),
u AS (SELECT ant, freq, time, val, weight AS w, CASE WHEN k = 0 AND n <= 2 AND time > a AND time < b THEN 1.0 ELSE weight END AS weight FROM z)"""


def _gap(s: SparkSession, d: str) -> Solutions:
    return smoothing.interpolate(evamp(s, d), "time", 1.5, max_gap=2)


_add("interpolate_gap_unflag", _gap, cte("ev_amp") + _GAPS + _GRID.format(src="u").replace("val, weight FROM u)", "val, weight, w FROM u)").replace("FROM e WHERE weight <> 0", "FROM e WHERE w <> 0"))

# flagging ------------------------------------------------------------------------------------------
_RM = "(PARTITION BY ant, pol ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


def _flag_sql(cycles: int, last: str) -> str:
    q = A + ", w0 AS (SELECT *, log10(val) AS x, weight AS w FROM li_amp)"
    for k in range(cycles):
        q += f""", s{k} AS (SELECT *, median(CASE WHEN w > 0 THEN x END) OVER {_RM} AS m FROM w{k}), g{k} AS (SELECT ant, pol, 3 * 1.4826 * median(abs(x - m)) FILTER (w > 0) AS lim FROM s{k} GROUP BY 1, 2),
w{k + 1} AS (SELECT ant, pol, time, val, weight, x, m, CASE WHEN w > 0 AND lim > 0 AND abs(x - m) > lim THEN 0.0 ELSE w END AS w FROM (SELECT * EXCLUDE (m), m FROM s{k}) JOIN g{k} USING (ant, pol))"""
        if k < cycles - 1:
            q = q.replace(f"w{k + 1} AS (SELECT ant, pol, time, val, weight, x, m,", f"w{k + 1} AS (SELECT ant, pol, time, val, weight, x,")
    return q + last.replace("{w}", f"w{cycles}")


_FL = f"SELECT ant, pol, time, {R('val')} AS val, w AS weight FROM {{w}}"
_add("flag_smooth_1cycle", lambda s, d: flagging.flag(amp(s, d), ["time"], [5], cycles=1, max_rms=3), _flag_sql(1, _FL))
_add("flag_smooth_multi", lambda s, d: flagging.flag(amp(s, d), ["time"], [5], cycles=3, max_rms=3), _flag_sql(3, _FL))
_add("flag_replace", lambda s, d: flagging.flag(amp(s, d), ["time"], [5], cycles=1, max_rms=3, replace=True),
     _flag_sql(1, f"SELECT ant, pol, time, {R('CASE WHEN weight > 0 AND w = 0 AND m IS NOT NULL THEN pow(10.0, m) ELSE val END')} AS val, CASE WHEN m IS NOT NULL OR w > 0 THEN weight ELSE w END AS weight FROM {{w}}"))
_add("flag_poly", lambda s, d: flagging.flag(amp(s, d), ["time"], [1], cycles=1, max_rms=2.5, mode="poly"), A + f""", x AS (SELECT *, log10(val) AS x, CASE WHEN weight > 0 THEN log10(val) END AS y FROM li_amp),
f AS (SELECT ant, pol, regr_slope(y, time) AS b, regr_intercept(y, time) AS a, avg(y) AS m, count(y) AS n, count(DISTINCT time) FILTER (y IS NOT NULL) AS nt FROM x GROUP BY 1, 2), r AS (SELECT *, x - (a + b * time) AS r FROM x JOIN f USING (ant, pol)),
g AS (SELECT ant, pol, 2.5 * 1.4826 * median(abs(r)) FILTER (weight > 0) AS lim FROM r GROUP BY 1, 2)
SELECT ant, pol, time, {R('val')} AS val, CASE WHEN n > 2 AND abs(r) > lim THEN 0.0 ELSE weight END AS weight FROM r JOIN g USING (ant, pol)""")  # fmt: skip
_add("flag_preflag_defaults", lambda s, d: cells.flagged_share(cells.flag_defaults(cells.reset(amp(s, d))), ["pol"]), A + "SELECT pol, count(*) AS cells, 100.0::DOUBLE AS flagged FROM li_amp GROUP BY 1")
_add("flagextend_2d", lambda s, d: flagging.extend_flags(evamp(s, d), ["freq", "time"], [3, 5], 40, cycles=1), cte("ev_amp") + f""", f AS (SELECT ant, freq, row_number() OVER (PARTITION BY ant ORDER BY freq) - 1 AS i, count(*) OVER (PARTITION BY ant) AS ni FROM (SELECT DISTINCT ant, freq FROM ev_amp)),
t AS (SELECT ant, time, row_number() OVER (PARTITION BY ant ORDER BY time) - 1 AS j, count(*) OVER (PARTITION BY ant) AS nj FROM (SELECT DISTINCT ant, time FROM ev_amp)),
c AS (SELECT f.ant, freq, time, i, j, ni, nj, val, weight, CASE WHEN weight IS NULL OR weight = 0 THEN 1.0 ELSE 0.0 END AS bad FROM f JOIN t USING (ant) LEFT JOIN ev_amp e USING (ant, freq, time)),
o AS (SELECT c.*, abs(i + a) AS p, abs(j + b) AS q FROM c, range(-1, 2) r1(a), range(-2, 3) r2(b)),
q AS (SELECT o.ant, o.i, o.j, sum(d.bad) / 15 AS share FROM o JOIN c d ON d.ant = o.ant AND d.i = CASE WHEN p >= o.ni THEN 2 * (o.ni - 1) - p ELSE p END AND d.j = CASE WHEN q >= o.nj THEN 2 * (o.nj - 1) - q ELSE q END GROUP BY 1, 2, 3)
SELECT ant, freq, time, {R('val')} AS val, CASE WHEN share > 0.4 + 1e-12 THEN 0.0 ELSE weight END AS weight FROM c JOIN q USING (ant, i, j) WHERE val IS NOT NULL""")  # fmt: skip
_add("flagstation_relative", lambda s, d: flagging.flag_stations_relative(amp(s, d), 1.0, 0.3, skip=["CS0004"]), A + f""", g AS (SELECT pol, time, avg(val) FILTER (weight <> 0) AS m, stddev_pop(val) FILTER (weight <> 0) AS sd FROM li_amp GROUP BY 1, 2),
b AS (SELECT ant, avg(coalesce(weight <> 0 AND abs(val - m) > 1.0 * sd, FALSE)::INT) AS share FROM li_amp LEFT JOIN g USING (pol, time) GROUP BY 1)
SELECT ant, pol, time, {R('val')} AS val, CASE WHEN share > 0.3 AND ant <> 'CS0004' THEN 0.0 ELSE weight END AS weight FROM li_amp LEFT JOIN b USING (ant)""")  # fmt: skip


def _resid_sql(cycles: int) -> str:
    q = cte("ev_ph") + f""", c AS (SELECT ant, atan2(sum(weight * sin(val)), sum(weight * cos(val))) AS c FROM ev_ph GROUP BY 1), x AS (SELECT e.*, {wrapped('val - c')} AS x FROM ev_ph e JOIN c USING (ant))"""
    for k in range(cycles):
        inside = "TRUE" if k == 0 else "abs(x) <= lim"
        src = "x" if k == 0 else f"x JOIN l{k - 1} USING (ant)"
        q += f", l{k} AS (SELECT ant, 2 * least(sqrt(sum(weight * x * x) FILTER ({inside}) / nullif(sum(weight) FILTER ({inside}), 0)), 1.5) AS lim FROM {src} GROUP BY 1)"
    return q + f""", b AS (SELECT *, weight > 0 AND abs(x) > lim AS bad FROM x JOIN l{cycles - 1} USING (ant)), s AS (SELECT ant, sum(bad::INT) / nullif(sum((weight > 0)::INT), 0) AS share FROM b GROUP BY 1)
SELECT ant, freq, time, {R('val')} AS val, CASE WHEN share > 0.3 THEN 0.0 WHEN share < 0.02 THEN weight WHEN bad THEN 0.0 ELSE weight END AS weight FROM b JOIN s USING (ant)"""


_add("flagstation_resid", lambda s, d: flagging.flag_stations_residual(ph(s, d), 0.02, 0.3, 2.0, 1.5, cycles=3), _resid_sql(3))
def _rows_of(x: Solutions, weights: Solutions) -> Solutions:
    return x.put(x.df.drop("weight").join(weights.df.select(*x.axes, "weight"), list(x.axes)))


def _flag_refant(s: SparkSession, d: str) -> Solutions:
    t = _t("ev_time", "phase")(s, d)
    return _rows_of(t, flagging.flag(referencing.reference(t, "CS0003"), ["time"], [0], cycles=1, max_rms=2.0))


_add("flag_refant", _flag_refant, cte("ev_time") + f""", x AS (SELECT e.*, e.val - r.val AS y FROM ev_time e LEFT JOIN ev_time r ON r.ant = 'CS0003' AND r.time = e.time),
q AS (SELECT *, CASE WHEN y IS NULL THEN 0 ELSE weight END AS w FROM x), c AS (SELECT ant, atan2(sum(w * sin(y)), sum(w * cos(y))) AS c FROM q GROUP BY 1),
y AS (SELECT q.*, {wrapped('y - c')} AS z FROM q JOIN c USING (ant)), m AS (SELECT ant, median(z) FILTER (w > 0) AS m FROM y GROUP BY 1),
o AS (SELECT y.*, abs({wrapped('z - m')}) AS o FROM y JOIN m USING (ant)), l AS (SELECT ant, 2.0 * 1.4826 * median(o) FILTER (w > 0) AS lim FROM o GROUP BY 1)
SELECT ant, time, {R('val')} AS val, CASE WHEN lim > 0 AND o > lim THEN 0.0 ELSE w END AS weight FROM o JOIN l USING (ant)""")  # fmt: skip
_NEAREST_ANT = """, n AS (SELECT a.name AS ant, arg_min(b.name, (a.x::DOUBLE - b.x) ** 2 + (a.y::DOUBLE - b.y) ** 2 + (a.z::DOUBLE - b.z) ** 2) AS ref
  FROM antennas a JOIN antennas b ON a.name <> b.name WHERE a.name IN (SELECT ant FROM ev_time) AND b.name IN (SELECT ant FROM ev_time GROUP BY 1 HAVING max(weight) > 0) GROUP BY 1)"""
_add("flagstation_nearest", lambda s, d: _rows_of(_t("ev_time", "phase")(s, d), flagging.flag_stations_residual(referencing.reference(_t("ev_time", "phase")(s, d), "closest", antennas=proxies.antennas(s, d)), 0.0, 0.9, 1.5, 9.0, cycles=1)),
     cte("ev_time", "antennas") + _NEAREST_ANT + f""", x AS (SELECT e.*, e.val - r.val AS y FROM ev_time e LEFT JOIN n USING (ant) LEFT JOIN ev_time r ON r.ant = n.ref AND r.time = e.time),
q AS (SELECT *, CASE WHEN y IS NULL THEN 0 ELSE weight END AS w FROM x), c AS (SELECT ant, atan2(sum(w * sin(y)), sum(w * cos(y))) AS c FROM q GROUP BY 1), y AS (SELECT q.*, {wrapped('y - c')} AS z FROM q JOIN c USING (ant)),
l AS (SELECT ant, 1.5 * least(sqrt(sum(w * z * z) / nullif(sum(w), 0)), 9.0) AS lim FROM y GROUP BY 1), b AS (SELECT y.*, w > 0 AND abs(z) > lim AS bad FROM y JOIN l USING (ant)),
s AS (SELECT ant, sum(bad::INT) / nullif(sum((w > 0)::INT), 0) AS share FROM b GROUP BY 1)
SELECT ant, time, {R('val')} AS val, CASE WHEN share > 0.9 THEN 0.0 WHEN bad THEN 0.0 ELSE w END AS weight FROM b JOIN s USING (ant)""")  # fmt: skip
_add("flagstation_export", lambda s, d: flagging.export_station_flags(cells.clip(amp(s, d), ["time"], 10.0, mode="above").put(cells.clip(amp(s, d), ["time"], 9.0, mode="above").df.withColumn("weight", F.when(F.col("pol") == "A", 0.0).otherwise(F.col("weight")))), amp(s, d)),
     A + f", k AS (SELECT ant, pol, CASE WHEN val > 9.0 OR pol = 'A' THEN 0.0 ELSE weight END AS w FROM li_amp), z AS (SELECT ant, pol FROM k GROUP BY 1, 2 HAVING max(w) = 0) SELECT ant, pol, time, {R('val')} AS val, CASE WHEN z.ant IS NOT NULL THEN 0.0 ELSE weight END AS weight FROM li_amp LEFT JOIN z USING (ant, pol)")
_add("flagstation_bandpass", lambda s, d: flagging.flag_stations_bandpass(Solutions(evamp(s, d).df.withColumn("freq", F.col("freq") * 1e6 + 12e7), ("ant", "freq", "time"), "amplitude")))

# structure, fits -----------------------------------------------------------------------------------
_S = cte("ev_ph", "antennas") + f""", x AS (SELECT * FROM ev_ph WHERE weight <> 0), d AS (SELECT a.ant AS ant1, b.ant AS ant2, a.time, a.val - b.val AS d FROM x a JOIN x b ON a.time = b.time AND a.freq = b.freq AND a.ant < b.ant),
c AS (SELECT ant1, ant2, atan2(avg(sin(d)), avg(cos(d))) AS c FROM d GROUP BY 1, 2), w AS (SELECT d.*, {wrapped('d - c')} AS w FROM d JOIN c USING (ant1, ant2)), l AS (SELECT ant1, ant2, time, avg(w) AS w FROM w GROUP BY 1, 2, 3),
v AS (SELECT ant1, ant2, var_pop(w) * pow((SELECT avg(freq) FROM x) / 150e6, 2) AS var, count(*) AS n FROM l GROUP BY 1, 2),
p AS (SELECT name AS ant, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM antennas),
s AS (SELECT ant1, ant2, {_DIST} AS dist, var, n FROM v JOIN p a ON a.ant = ant1 JOIN p b ON b.ant = ant2)"""
_pairs = lambda s, d: fits.structure_pairs(ph(s, d), proxies.antennas(s, d))
_add("structure_pairs", _pairs, _S + f" SELECT ant1, ant2, 0::BIGINT AS part, {R('dist')} AS dist, {R('var')} AS var, n FROM s")
_add("structure_function", lambda s, d: fits.structure_function(_pairs(s, d)).select("part", "beta", "offset", "pairs"),
     _S + f" SELECT 0::BIGINT AS part, {R('regr_slope(log10(var), log10(dist))')} AS beta, {R('regr_intercept(log10(var), log10(dist))')} AS \"offset\", count(*) AS pairs FROM s WHERE var > 0 AND dist > 0")

_STATION = "concat('CS', lpad(cast(a as {s}), 4, '0')) AS ant"
_TEC, _CLOCK, _RM_, _DELAY = "((a * 37) % 41 - 20 + abs(time % 20 - 10)) / 100e0", "((a * 29) % 41 - 20 + abs(time % 20 - 10)) / 10e0", "((a * 17 + time * 5) % 71 - 35) / 100e0", "((a * 13) % 21 - 10) / 10e0"


def simulated(s: SparkSession, d: str, model: str, start: float, step: float, channels: int, pols: tuple[str, ...] = ()) -> Solutions:
    """Phases of a known model on the stations and days of the events table."""
    base = proxies.frame(s, d, f"SELECT a, {_STATION}, time, {_TEC} AS tec, {_CLOCK} AS clock, {_RM_} AS rm, {_DELAY} AS delay FROM ({TRUTH}) t")
    x = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).withColumn("freq", start + F.col("k") * step)
    axes = ["ant", "freq", "time"]
    if pols:
        x, axes = x.withColumn("pol", F.explode(F.array(*[F.lit(p) for p in pols]))), ["ant", "pol", "freq", "time"]
    x = x.withColumn("val", scalar.wrap(F.expr(model))).withColumn("weight", F.lit(1.0)).withColumn("time", F.col("time").cast("bigint"))
    return Solutions(x.select(*axes, "val", "weight"), tuple(axes), "phase", "phase000")


def _truth_sql(value: str, extra: str = "") -> str:
    return f"SELECT {_STATION.replace('{s}', 'varchar')}, time::BIGINT AS time, {value} AS val, 1.0::DOUBLE AS weight FROM ({TRUTH}) t{extra}"


def _r3(t: Solutions) -> Solutions:
    return t.put(t.df.withColumn("val", F.round("val", 3) + F.lit(0.0)))


_add("tec_fit", lambda s, d: _r3(fits.tec(simulated(s, d, f"{TEC_PHASE!r}D * tec / freq", 40e6, 5e5, 60))), _truth_sql(f"round({_TEC}, 3) + 0.0"))
_add("faraday_fit", lambda s, d: _r3(fits.faraday(simulated(s, d, f"CASE WHEN pol = 'RR' THEN 1 ELSE -1 END * pow({LIGHT!r}D / freq, 2) * rm", 120e6, 12e5, 50, ("RR", "LL")))), _truth_sql(f"round({_RM_}, 3) + 0.0"))


def _clocktec(s: SparkSession, d: str) -> DataFrame:
    sim = simulated(s, d, f"({TEC_PHASE!r}D * tec / freq + 2 * {PI.replace('e0', 'D')} * clock * 1e-9D * freq) * CASE WHEN a = 1 THEN 0 ELSE 1 END", 40e6, 5e5, 60, ("XX", "YY"))
    out = fits.clock_tec(sim)
    t, c = out["tec000"].df, out["clock000"].df
    x = t.select("ant", "pol", "time", F.col("val").alias("tec"), "weight").join(c.select("ant", "pol", "time", (F.col("val") * 1e9).alias("clock")), ["ant", "pol", "time"])
    return x.select("ant", "pol", "time", (F.round("tec", 3) + F.lit(0.0)).alias("tec"), (F.round("clock", 3) + F.lit(0.0)).alias("clock"), "weight")


_zero = lambda v: f"CASE WHEN a = 1 THEN 0.0 ELSE round({v}, 3) + 0.0 END"
_add("clocktec_fit", _clocktec, f"SELECT {_STATION.replace('{s}', 'varchar')}, pol, time::BIGINT AS time, {_zero(_TEC)} AS tec, {_zero(_CLOCK)} AS clock, 1.0::DOUBLE AS weight FROM ({TRUTH}) t, (VALUES ('XX'), ('YY')) p(pol)")


def _more_dirs(s: SparkSession, d: str) -> DataFrame:
    t = proxies.table(s, d, "li_dirs")
    src = s.range(12).select(F.format_string("D%02d", "id").alias("name"), F.array((F.col("id") * 0.01).cast("float"), ((F.col("id") * 5) % 12 * 0.01).cast("float")).alias("dir"))
    out, _ = fits.interpolate_directions(t, src, [(0.0, 0.0), (2.0, 1.0)])
    return out.df.select(*out.axes, "val", "weight")


_add("interpolate_directions", _more_dirs)

# files, plots, functions ---------------------------------------------------------------------------
_add("info_flagged", lambda s, d: cells.flagged_share(amp(s, d), ["pol"]), A + f"SELECT pol, count(*) AS cells, {R('100 * avg(CASE WHEN weight = 0 THEN 1.0 ELSE 0.0 END)')} AS flagged FROM li_amp GROUP BY 1")
_add("collector_union", lambda s, d: tables.collect([select(amp(s, d), pol=["A", "N"]), _shift(select(amp(s, d), pol=["N", "R"]))]), A + f""", g AS (SELECT a.ant, p.pol, t.time FROM (SELECT DISTINCT ant FROM li_amp) a, (SELECT DISTINCT pol FROM li_amp) p, (SELECT DISTINCT time FROM li_amp) t)
SELECT ant, pol, time, {R("CASE WHEN pol IN ('N', 'R') THEN val - 10.4 ELSE val END")} AS val, (CASE WHEN weight <> 0 AND val IS NOT NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS weight FROM g LEFT JOIN li_amp USING (ant, pol, time)""")  # fmt: skip
_half = lambda s, d: evamp(s, d).df.select((F.col("time") + 0.25).alias("time")).distinct()
_NEAR = cte("ev_amp") + """, p AS (SELECT ant, freq, (t + 0.25)::DOUBLE AS x FROM (SELECT DISTINCT ant, freq FROM ev_amp), (SELECT DISTINCT time AS t FROM ev_amp)), e AS (SELECT ant, freq, time::DOUBLE AS t, val, weight FROM ev_amp),
a AS (SELECT p.*, e.t AS t0, e.val AS y0, e.weight AS w0 FROM p ASOF LEFT JOIN e ON p.ant = e.ant AND p.freq = e.freq AND p.x >= e.t), b AS (SELECT p.*, e.t AS t1, e.val AS y1, e.weight AS w1 FROM p ASOF LEFT JOIN e ON p.ant = e.ant AND p.freq = e.freq AND p.x <= e.t)"""
_pick = lambda c: f"CASE WHEN t1 IS NULL OR x - t0 <= t1 - x THEN {c}0 ELSE {c}1 END"
_add("interpolator_nearest", lambda s, d: tables.on_grid(evamp(s, d), "time", _half(s, d), "nearest"), _NEAR + f" SELECT ant, freq, x AS time, {R(_pick('y'))} AS val, {_pick('w')} AS weight FROM a JOIN b USING (ant, freq, x)")
_add("interpolator_previous", lambda s, d: tables.on_grid(evamp(s, d), "time", _half(s, d), "previous"), _NEAR + f" SELECT ant, freq, x AS time, {R('coalesce(y0, y1)')} AS val, coalesce(w0, w1) AS weight FROM a JOIN b USING (ant, freq, x)")
_TWO = ", o AS (SELECT *, row_number() OVER (PARTITION BY ant, freq ORDER BY t) AS u, count(*) OVER (PARTITION BY ant, freq) AS m FROM e), z AS (SELECT ant, freq, max(t) FILTER (u = 2) AS ta, max(val) FILTER (u = 2) AS ya, max(weight) FILTER (u = 2) AS wa, max(t) FILTER (u = m - 1) AS tb, max(val) FILTER (u = m - 1) AS yb, max(weight) FILTER (u = m - 1) AS wb FROM o GROUP BY 1, 2), j AS (SELECT ant, freq, x, coalesce(t0, ta, t1) AS t0, coalesce(y0, ya, y1) AS y0, coalesce(w0, wa, w1) AS w0, coalesce(t1, tb, t0) AS t1, coalesce(y1, yb, y0) AS y1, coalesce(w1, wb, w0) AS w1 FROM a JOIN b USING (ant, freq, x) JOIN z USING (ant, freq))"
_lin = lambda c: f"CASE WHEN t0 = t1 THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * (x - t0) / (t1 - t0) END"
_add("interpolator_linear", lambda s, d: tables.on_grid(evamp(s, d), "time", _half(s, d), "linear"), _NEAR + _TWO + f" SELECT ant, freq, x AS time, {R(_lin('y'))} AS val, {R(_lin('w'))} AS weight FROM j")
_add("interpolator_cubic", lambda s, d: tables.on_grid(evamp(s, d), "time", _half(s, d), "cubic"))
_add("interpolator_combine", lambda s, d: tables.resample([evamp(s, d), Solutions(evt(s, d).df, ("ant", "time"), "amplitude")], "nearest"),
     _NEAR.replace("t + 0.25", "t").replace("WITH ", cte("ev_time") + ", ", 1)
     + f" SELECT ant, freq::DOUBLE AS freq, x AS time, {R(f'({_pick("y")}) * t.val')} AS val, ({_pick('w')}) * t.weight AS weight FROM a JOIN b USING (ant, freq, x) JOIN (SELECT ant, time::DOUBLE AS x, val, weight FROM ev_time) t USING (ant, x)")
_add("split_chunks", lambda s, d: tables.split(amp(s, d), "time", 12).groupBy("chunk").agg(F.count(F.lit(1)).alias("cells"), F.min("time").alias("first"), F.max("time").alias("last")), A + """, b AS (SELECT min(time)::DOUBLE AS a, max(time)::DOUBLE AS z FROM li_amp), n AS (SELECT a, z, greatest(1, round_even((z - a) / 12, 0)) AS n FROM b)
SELECT CAST(least(floor((time - a) / ((z - a) / n)), n - 1) AS BIGINT) AS chunk, count(*) AS cells, min(time) AS first, max(time) AS last FROM li_amp, n GROUP BY 1""")  # fmt: skip


def _export(s: SparkSession, d: str) -> DataFrame:
    a = select(_jones(s, d), pol=["XX", "YY"])
    p = Solutions(a.df.withColumn("val", scalar.wrap(20 * F.col("val"))), a.axes, "phase")
    return tables.tables_to_parameters(a, p)


_EXP = _J + f", g AS (SELECT ant, CASE WHEN pol = 'XX' THEN '0:0' ELSE '1:1' END AS ij, time, val AS a, {wrapped('20 * val')} AS p, weight FROM j WHERE pol IN ('XX', 'YY'))"
_add("export_parameters", _export, _EXP + f" SELECT concat('Gain:', ij, ':', part, ':', ant) AS name, time, {R('CASE WHEN weight <> 0 THEN v END')} AS val FROM (SELECT *, 'Real' AS part, a * cos(p) AS v FROM g UNION ALL SELECT *, 'Imag' AS part, a * sin(p) AS v FROM g)")


def _import(s: SparkSession, d: str) -> DataFrame:
    t = tables.parameters_to_tables(_export(s, d).withColumn("freq", F.lit(1.5e8)))["amplitude000"]
    return t.df.select("dir", "pol", "ant", "time", "val", "weight")


_add("import_parameters", _import, _EXP + f" SELECT 'pointing' AS dir, CASE WHEN ij = '0:0' THEN 'XX' ELSE 'YY' END AS pol, ant, time, {R('abs(a)')} AS val, 1.0::DOUBLE AS weight FROM g WHERE weight <> 0")
_add("plot_rows", lambda s, d: plotting.plot_rows(ph(s, d), ["time"], colour="freq"), cte("ev_ph") + f""", r AS (SELECT *, val % (2 * {PI}) AS y FROM ev_ph), z AS (SELECT min(time) AS t0, max(time) AS t1 FROM ev_ph)
SELECT concat('ant-', ant) AS file, '' AS panel, colour, {R('(time - t0) / CASE WHEN t1 - t0 > 3600 THEN 3600 WHEN t1 - t0 > 60 THEN 60 ELSE 1 END')} AS x, NULL AS px, NULL AS py, {R(f'CASE WHEN weight <> 0 THEN CASE WHEN y < -{PI} THEN y + 2 * {PI} WHEN y > {PI} THEN y - 2 * {PI} ELSE y END END')} AS val, weight = 0 AS flagged, {R('-' + PI)} AS lo, {R(PI)} AS hi
FROM (SELECT *, replace(printf('%.2E', freq), 'E+0', 'E') AS colour FROM r) q, z""".replace("SELECT *, replace(printf('%.2E', freq), 'E+0', 'E') AS colour", "SELECT *, concat(cast(freq / 1e8 as varchar), 'E8') AS colour"))  # fmt: skip
_add("unwrap_phases", lambda s, d: frames.unwrap(_steps(s, d), "val", ["ant"], "time", "u").select("ant", "time", F.col("u").alias("val")), cte("ev_time") + f""", x AS (SELECT ant, time, {wrapped('20 * val')} AS v FROM ev_time),
k AS (SELECT *, ceil((v - lag(v) OVER (PARTITION BY ant ORDER BY time) - {PI}) / (2 * {PI})) AS k FROM x)
SELECT ant, time, {R(f'v - 2 * {PI} * sum(coalesce(k, 0)) OVER (PARTITION BY ant ORDER BY time)')} AS val FROM k""")  # fmt: skip


def _steps(s: SparkSession, d: str) -> DataFrame:
    return evt(s, d).df.withColumn("val", scalar.wrap(20 * F.col("val")))


_add("scalar_functions", lambda s, d: evt(s, d).df.select("ant", "time", scalar.wrap(20 * F.col("val")).alias("wrap"), scalar.normalize_phase(20 * F.col("val")).alias("normal"), scalar.wrap_rotation(20 * F.col("val")).alias("rotation"), scalar.log10_positive(F.col("val") - 3).alias("log"), scalar.station_class(F.col("ant")).alias("class")),
     cte("ev_time") + f", x AS (SELECT *, (20 * val) % (2 * {PI}) AS y FROM ev_time) SELECT ant, time, {R(wrapped('20 * val'))} AS wrap, {R(f'CASE WHEN y < -{PI} THEN y + 2 * {PI} WHEN y > {PI} THEN y - 2 * {PI} ELSE y END')} AS normal, "
     f"{R(f'20 * val - {PI} * floor((20 * val + {PI} / 2) / {PI})')} AS rotation, {R('CASE WHEN val > 3 THEN log10(val - 3) END')} AS log, 'CS' AS class FROM x")  # fmt: skip
_add("circular_statistics", lambda s, d: ph(s, d).df.groupBy("ant").agg(scalar.circular_mean(F.col("val"), F.col("weight")).alias("mean"), scalar.circular_variance(F.col("val")).alias("variance"), scalar.circular_std(F.col("val")).alias("std")),
     cte("ev_ph") + f" SELECT ant, {R('atan2(sum(weight * sin(val)), sum(weight * cos(val)))')} AS mean, {R('1 - sqrt(pow(avg(cos(val)), 2) + pow(avg(sin(val)), 2))')} AS variance, {R('sqrt(-2 * ln(sqrt(pow(avg(cos(val)), 2) + pow(avg(sin(val)), 2))))')} AS std FROM ev_ph GROUP BY 1")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
