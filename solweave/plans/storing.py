"""Queries of the store, the step runner, imports and exports, and of fits on simulated tables with a known truth; each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solweave.functions import scalar
from solweave.model import Solutions
from solweave.operators import fits, flagging, plotting
from solweave.plans import proxies, runner
from solweave.plans.proxies import PI, TRUTH, cte, wrapped
from solweave.plans.solutions import R, simulated
from solweave.sources import tables
from solweave.sources.store import Store
from solweave.staging import keep, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
A, E = cte("li_amp"), cte("ev_ph")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" and c != "freq" else F.col(c) for c, t in df.dtypes])


def _store(spark: SparkSession, d: str) -> Store:
    """A store with the antennas and two tables, in the shared folder."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    keep(spark, root)
    store = Store(spark, root, "a")
    store.make_solset("sol000", proxies.antennas(spark, d))
    amp, ph = proxies.table(spark, d, "li_amp"), proxies.table(spark, d, "ev_ph")
    store.make_table("sol000", amp.df, amp.axes, "amplitude")
    store.make_table("sol000", ph.df, ph.axes, "phase")
    return store


def store_selection(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a stored table by a regular expression, a list with an absent member, a range with a step, an unknown axis and no wish."""
    t = _store(spark, d).table("sol000/amplitude000", ant="CS000[1-7]", pol=["A", "R", "none"], time={"min": 23930, "max": 23960, "step": 3}, dir="x", freq=None)
    return _rounded(t.df.select(*t.axes, "val", "weight"))


def store_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one coordinate; a selection that selects nothing keeps all."""
    t = _store(spark, d).table("sol000/amplitude000", pol=["N"], ant="nothing like this", time=slice(2, 20, 2))
    return _rounded(t.df.select(*t.axes, "val", "weight"))


def store_contents(spark: SparkSession, d: str) -> DataFrame:
    """Sets and tables after copies, renames and deletions, with their cells, flagged cells and entries of history."""
    store = _store(spark, d)
    store.copy_solset("sol000", store, "copy")
    store.rename_table("copy/phase000", "phi")
    store.make_solset("old")
    store.rename_solset("old", "new")
    store.delete_table("sol000/phase000")
    rows = []
    for s in store.solsets():
        for t in store.tables(s) or [None]:
            meta = store._meta(f"{s}/{t}") if t else {}
            rows.append((s, t or "", meta.get("cells", 0), meta.get("flagged", 0), len(meta.get("history", []))))
    return spark.createDataFrame(rows, "solset string, soltab string, cells bigint, flagged bigint, entries bigint")


def store_antennas(spark: SparkSession, d: str) -> DataFrame:
    """The antenna table of a set, with its places on the earth."""
    side = _store(spark, d).side("sol000", "antenna")
    x, y, z = (F.col("position")[i].cast("double") for i in range(3))
    return _rounded(side.select("name", x.alias("x"), y.alias("y"), z.alias("z"), scalar.longitude(x, y).alias("lon"), scalar.latitude(x, y, z).alias("lat")))


_STEPS = """
soltab = [sol000/amplitude000]
pol = A
[first]
Operation = reweight
MODE = uniform
weightVal = 0.25
ant.regexp = CS000[1-5]
[second]
operation = NORM
axesToNorm = [time]
normVal = 3.
pol = [A, N]
[third]
operation = ABS
soltab = sol000/none.*
[fourth]
operation = REWEIGHT
mode = uniform
weightVal = 0.75
time.minmaxstep = [23950, 23960]
"""


def steps_run(spark: SparkSession, d: str) -> DataFrame:
    """A step file with selections of its own and for all steps."""
    store = _store(spark, d)
    runner.run(_STEPS, store)
    t = store.table("sol000/amplitude000")
    return _rounded(t.df.select(*t.axes, "val", "weight"))


def table_grids(spark: SparkSession, d: str) -> DataFrame:
    """The grids of a table, one combination of the other axes after the other: cells that are there, unflagged ones, sums."""
    t = proxies.table(spark, d, "ev_amp")
    rows = [(c["ant"], len(c["freq"]), len(c["time"]), int(np.isfinite(v).sum()), int((w != 0).sum()), float(np.nansum(v))) for c, v, w in t.grids(["freq", "time"])]
    return _rounded(spark.createDataFrame(rows, "ant string, freqs bigint, times bigint, cells bigint, good bigint, total double"))


def table_axes(spark: SparkSession, d: str) -> DataFrame:
    """Names, lengths, types and ends of the axes of a stored table whose axes were put in another order."""
    store = _store(spark, d)
    store.write("sol000", store.table("sol000/phase000").reorder("time", "ant", "freq"))
    t = store.table("sol000/phase000")
    rows = [(i, a, len(t.axis_values(a)), t.axis_type(a), str(store.coordinates("sol000/phase000", a)[0]), str(t.axis_values(a)[-1])) for i, a in enumerate(t.axes)]
    return spark.createDataFrame(rows, "place bigint, axis string, length bigint, type string, first string, last string")


def first_good(spark: SparkSession, d: str) -> DataFrame:
    """The first unflagged value of each station and polarisation."""
    x = proxies.table(spark, d, "li_amp").df
    return _rounded(x.groupBy("ant", "pol").agg(scalar.first_good(F.col("val"), F.col("weight"), F.col("time")).alias("val")))


def _named(spark: SparkSession, d: str) -> DataFrame:
    amp = proxies.table(spark, d, "li_amp")
    clock = Solutions(proxies.table(spark, d, "ev_time").df, ("ant", "time"), "clock")
    turn = Solutions(proxies.table(spark, d, "li_dir").df, ("dir", "ant", "time"), "rotationmeasure")
    flat = Solutions(amp.df.filter("pol = 'A'").drop("pol"), ("ant", "time"), "rotation")
    return tables.tables_to_parameters(Solutions(amp.df.withColumn("freq", F.lit(1.5e8)), ("ant", "pol", "freq", "time"), "amplitude"), others=[clock, turn, flat])


def export_all_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Amplitudes, clock, rotation measures and rotations under their parameter names."""
    return _rounded(_named(spark, d))


def export_wanted_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The same for listed entries: times between ends, listed frequencies, clocks repeated for each frequency."""
    amp = proxies.table(spark, d, "li_amp")
    clock = Solutions(proxies.table(spark, d, "ev_time").df, ("ant", "time"), "clock")
    gain = Solutions(amp.df.withColumn("freq", F.explode(F.array(F.lit(1.0), F.lit(2.0)))), ("ant", "pol", "freq", "time"), "amplitude")
    wanted = spark.createDataFrame(
        [("Gain:1:1:Ampl:CS0001", 23940.0, 23950.0, [2.0, 3.0]), ("Clock:CS0002", 5.0, 9.0, [1.0, 2.0]), ("Clock:CS0003", 1.0, 3.0, None), ("TEC:CS0001", 0.0, 1.0, None)],
        "name string, start double, end double, freqs array<double>",
    )
    return _rounded(tables.tables_to_parameters(gain, others=[clock], wanted=wanted))


def import_all_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters back in tables on the whole grid of their coordinates: cells, good cells and sums of each kind."""
    rows = _named(spark, d).withColumn("freq", F.coalesce("freq", F.lit(1.5e8)))
    back = tables.parameters_to_tables(rows, dense=True)
    out = None
    for name in ("amplitude000", "clock000", "rotation000", "rotationmeasure000"):
        x = back[name].df.agg(F.lit(name).alias("soltab"), F.count(F.lit(1)).alias("cells"), F.sum((F.col("weight") != 0).cast("bigint")).alias("good"), F.sum(F.when(F.col("weight") != 0, F.col("val"))).alias("total"))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("total", F.round("total", 3))


def import_grid(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that are stored as grids, cell by cell."""
    x = proxies.table(spark, d, "ev_time").df.groupBy("ant").agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "val"))), lambda c: c.val).alias("values"))
    x = x.select(F.concat(F.lit("TEC:"), "ant").alias("name"), F.lit(100.0).alias("startx"), F.lit(104.0).alias("endx"), F.lit(0.0).alias("starty"), F.lit(20.0).alias("endy"), F.lit(10).alias("ntime"), F.lit(2).alias("nfreq"), "values")
    return _rounded(tables.parameter_grid(x))


def unwrap_plane(spark: SparkSession, d: str) -> DataFrame:
    """Wrapped phases of a smooth plane over frequency and time, unwrapped: whether they are the plane but for whole turns of the station."""
    t = simulated(spark, d, "0.05D * time + 1e-7D * (freq - 40e6) * (1 + 0.01D * a)", 40e6, 5e6, 20)
    rows = plotting.plot_rows(t, ["time", "freq"], unwrap_phases=True, show_flagged=True)
    a = F.substring("file", 7, 10).cast("int")
    start = t.df.agg(F.min("time").alias("t")).first().t
    span = t.df.agg((F.max("time") - F.min("time")).alias("s")).first().s
    unit = 3600 if span > 3600 else 60 if span > 60 else 1
    truth = 0.05 * (F.col("x") * unit + start) + 1e-7 * (F.col("y") * 1e6 - 40e6) * (1 + 0.01 * a)
    off = rows.withColumn("off", F.col("val") - truth)
    return off.groupBy(F.substring("file", 5, 10).alias("ant")).agg(F.count(F.lit(1)).alias("cells"), (F.max("off") - F.min("off") < 1e-6).alias("plane"))


def polalign_truth(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fitted phases of the second polarisation undo a known delay and offset, and those of the first are 0."""
    t = simulated(spark, d, "CASE WHEN pol = 'XX' THEN delay * 1e-9D * freq + 0.3D ELSE 0 END", 120e6, 1e6, 40, ("XX", "YY"))
    out = fits.align_polarisations(t)
    # XX less the fit of the difference, which YY gets with the sign turned, is what remains of XX - YY.
    x = t.df.filter("pol = 'XX'").select("ant", "freq", "time", F.col("val").alias("want"))
    y = out.df.filter("pol = 'YY'").select("ant", "freq", "time", F.col("val").alias("got"))
    near = F.abs(scalar.wrap(F.col("want") + F.col("got"))) < 0.05
    first = out.df.filter("pol = 'XX'").groupBy("ant").agg((F.max(F.abs("val")) == 0).alias("first"))
    return x.join(y, ["ant", "freq", "time"]).groupBy("ant").agg(F.count(F.lit(1)).alias("cells"), F.min(near.cast("int")).alias("second")).join(first, "ant")


def interpolate_directions_known(spark: SparkSession, d: str) -> DataFrame:
    """Directions put where known ones are get their values."""
    t = proxies.table(spark, d, "li_dirs")
    src = spark.range(12).select(F.format_string("D%02d", "id").alias("name"), F.array((F.col("id") * 0.01).cast("float"), ((F.col("id") * 5) % 12 * 0.01).cast("float")).alias("dir"))
    at = {r.name: np.degrees(np.array(r.dir, dtype=np.float32).astype(float)) for r in src.collect()}
    out, _ = fits.interpolate_directions(t, src, [tuple(at["D03"]), tuple(at["D07"])])
    return _rounded(out.df.filter("dir LIKE 'interp%' AND weight <> 0").select(*out.axes, "val"))


def cubic_truth(spark: SparkSession, d: str) -> DataFrame:
    """A cubic in time comes back from cubic splines at other times, also beyond the ends."""
    e = proxies.table(spark, d, "ev_time")
    t = F.col("time") / 10
    x = Solutions(e.df.withColumn("val", 1 + t - 0.3 * t * t + 0.02 * t * t * t), e.axes, "amplitude")
    grid = e.df.select((F.col("time") + 0.37).alias("time")).distinct()
    out = tables.on_grid(x, "time", grid, "cubic").df
    return out.select("ant", F.round("time", 6).alias("time"), F.round("val", 4).alias("val"))


def bandpass_truth(spark: SparkSession, d: str) -> DataFrame:
    """Amplitudes along the low band's bandpass with a station far too strong, a channel of another off, and one with half its channels lost: what is flagged."""
    _, knots, start, *_ = flagging.BANDS["lba"]
    freq = 15e6 + 1e6 * np.arange(60)
    shape = 150 * 10 ** (flagging.band_basis(freq, knots) @ np.array(start))
    level = spark.createDataFrame([(int(i), float(f), float(s)) for i, (f, s) in enumerate(zip(freq, shape, strict=True))], "chan int, freq double, level double")
    x = proxies.frame(spark, d, f"SELECT a, concat('CS', lpad(cast(a as string), 4, '0')) AS ant, time FROM ({TRUTH}) t").join(F.broadcast(level), how="cross")
    ripple = 1 + 0.002 * F.sin(F.col("time") * 1.7 + F.col("chan"))
    val = F.col("level") * ripple * F.when(F.col("a") == 3, 40.0).when((F.col("a") == 5) & (F.col("chan") == 30), 2.5).when((F.col("a") == 7) & (F.col("chan") >= 25), 1e-3).otherwise(1.0)
    t = Solutions.of(x.select("ant", "freq", F.col("time").cast("bigint").alias("time"), val.alias("val")), ["ant", "freq", "time"])
    out = flagging.flag_stations_bandpass(t)
    return out.df.groupBy("ant").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("weight") == 0).cast("bigint")).alias("flagged"))


_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        store_selection, store_scalar, store_contents, store_antennas, steps_run, table_grids, table_axes, first_good, export_all_parameters, export_wanted_parameters,
        import_all_parameters, import_grid, unwrap_plane, polalign_truth, interpolate_directions_known, cubic_truth, bandpass_truth,
    )
}

_GAIN = "CASE WHEN substr(pol, {i}, 1) IN ('X', 'R') THEN '0' ELSE '1' END"
_NAMES = cte("li_amp", "ev_time", "li_dir") + f""", x AS (
SELECT concat_ws(':', 'Gain', {_GAIN.format(i=1)}, {_GAIN.format(i=2)}, 'Ampl', ant) AS name, time, 1.5e8::DOUBLE AS freq, CASE WHEN weight <> 0 THEN val END AS val, ant, pol, NULL AS dir, 'amplitude000' AS t FROM li_amp UNION ALL
SELECT 'Clock:' || ant, time, NULL, CASE WHEN weight <> 0 THEN val END, ant, NULL, NULL, 'clock000' FROM ev_time UNION ALL
SELECT concat_ws(':', 'RotationMeasure', ant, dir), time, NULL, CASE WHEN weight <> 0 THEN val END, ant, NULL, dir, 'rotationmeasure000' FROM li_dir UNION ALL
SELECT 'CommonRotationAngle:' || ant, time, NULL, CASE WHEN weight <> 0 THEN val END, ant, NULL, NULL, 'rotation000' FROM li_amp WHERE pol = 'A')"""
_ROWS = f"SELECT ant, pol, time, {R('val')} AS val, weight FROM "
_STATIONS = f"SELECT a, concat('CS', lpad(cast(a as varchar), 4, '0')) AS ant, count(*) AS days FROM ({TRUTH}) t GROUP BY 1, 2"
_KNOWN = "lpad(cast(i as varchar), 3, '0')"

_SQL = {
    "store_selection": A + f""", c AS (SELECT DISTINCT time FROM li_amp WHERE time BETWEEN 23930 AND 23960), k AS (SELECT time FROM (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM c) WHERE i % 3 = 0)
{_ROWS} li_amp WHERE regexp_matches(ant, 'CS000[1-7]') AND pol IN ('A', 'R') AND time IN (SELECT time FROM k)""",
    "store_scalar": A + f", c AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM li_amp)) {_ROWS} li_amp WHERE pol = 'N' AND time IN (SELECT time FROM c WHERE i BETWEEN 2 AND 19 AND i % 2 = 0)",
    "store_contents": cte("li_amp", "ev_ph") + """, a AS (SELECT count(*) AS cells, count(*) FILTER (weight = 0) AS flagged FROM li_amp), p AS (SELECT count(*) AS cells, count(*) FILTER (weight = 0) AS flagged FROM ev_ph)
SELECT 'copy' AS solset, 'amplitude000' AS soltab, cells, flagged, 2::BIGINT AS entries FROM a UNION ALL SELECT 'copy', 'phi', cells, flagged, 2 FROM p UNION ALL SELECT 'new', '', 0, 0, 0 UNION ALL SELECT 'sol000', 'amplitude000', cells, flagged, 1 FROM a""",
    "store_antennas": cte("antennas") + f", p AS (SELECT name, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM antennas) SELECT name, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z, {R('degrees(atan2(y, x))')} AS lon, {R('degrees(atan2(z, sqrt(x * x + y * y)))')} AS lat FROM p",
    "steps_run": A + f""", w AS (SELECT ant, pol, time, val, CASE WHEN pol = 'A' AND regexp_matches(ant, 'CS000[1-5]') THEN 0.25 ELSE weight END AS weight FROM li_amp),
n AS (SELECT *, val * 3 / avg(CASE WHEN weight <> 0 THEN val END) OVER (PARTITION BY ant, pol) AS v FROM w)
SELECT ant, pol, time, {R("CASE WHEN pol IN ('A', 'N') AND weight <> 0 THEN v ELSE val END")} AS val, (CASE WHEN pol = 'A' AND time BETWEEN 23950 AND 23960 THEN 0.75 ELSE weight END)::DOUBLE AS weight FROM n""",
    "table_grids": cte("ev_amp") + f" SELECT ant, (SELECT count(DISTINCT freq) FROM ev_amp) AS freqs, (SELECT count(DISTINCT time) FROM ev_amp) AS times, count(val) AS cells, count(*) FILTER (weight <> 0) AS good, {R('sum(val)')} AS total FROM ev_amp GROUP BY 1",
    "table_axes": E + """SELECT 0::BIGINT AS place, 'time' AS axis, count(DISTINCT time) AS length, 'bigint' AS type, min(time)::VARCHAR AS first, max(time)::VARCHAR AS last FROM ev_ph UNION ALL
SELECT 1, 'ant', count(DISTINCT ant), 'string', min(ant), max(ant) FROM ev_ph UNION ALL SELECT 2, 'freq', count(DISTINCT freq), 'double', min(freq)::VARCHAR, max(freq)::VARCHAR FROM ev_ph""",
    "first_good": A + f"SELECT ant, pol, {R('arg_min(val, time) FILTER (weight <> 0 AND val IS NOT NULL)')} AS val FROM li_amp GROUP BY 1, 2",
    "export_all_parameters": _NAMES + f" SELECT name, time, freq, {R('val')} AS val FROM x",
    "export_wanted_parameters": cte("li_amp", "ev_time") + f"""SELECT 'Gain:1:1:Ampl:CS0001' AS name, time, 2.0::DOUBLE AS freq, {R('CASE WHEN weight <> 0 THEN val END')} AS val
FROM li_amp WHERE ant = 'CS0001' AND time BETWEEN 23940 AND 23950 AND pol IN ('A', 'N') UNION ALL
SELECT 'Clock:CS0002', time, f, {R('CASE WHEN weight <> 0 THEN val END')} FROM ev_time, (VALUES (1.0::DOUBLE), (2.0)) v(f) WHERE ant = 'CS0002' AND time BETWEEN 5 AND 9 UNION ALL
SELECT 'Clock:CS0003', time, NULL, {R('CASE WHEN weight <> 0 THEN val END')} FROM ev_time WHERE ant = 'CS0003' AND time BETWEEN 1 AND 3""",
    "import_all_parameters": _NAMES + """, u AS (SELECT t, name, ant, dir, time, max(val) AS val FROM x GROUP BY ALL),
g AS (SELECT t, count(DISTINCT ant) * count(DISTINCT time) * CASE WHEN t = 'amplitude000' THEN count(DISTINCT substr(name, 1, 9)) ELSE count(DISTINCT coalesce(dir, '')) END AS cells FROM u GROUP BY 1)
SELECT t AS soltab, cells::BIGINT AS cells, count(val) FILTER (val <> 0 OR t NOT LIKE 'rot%') AS good, round(sum(val), 3) AS total FROM u JOIN g USING (t) GROUP BY 1, 2""",
    "import_grid": cte("ev_time") + f""", v AS (SELECT ant, list(val ORDER BY time) AS values FROM ev_time GROUP BY 1)
SELECT 'TEC:' || ant AS name, (i + 0.5) * 2.0 AS time, 100 + (j + 0.5) * 2.0 AS freq, {R('values[i * 2 + j + 1]')} AS val FROM v, range(10) r(i), range(2) q(j)""",
    "unwrap_plane": f"WITH s AS ({_STATIONS}) SELECT ant, (days * 20)::BIGINT AS cells, TRUE AS plane FROM s",
    "polalign_truth": f"WITH s AS ({_STATIONS}) SELECT ant, (days * 40)::BIGINT AS cells, 1::INT AS second, TRUE AS first FROM s",
    "interpolate_directions_known": cte("li_dirs") + f""", c AS (SELECT ant, time, count(*) AS n FROM li_dirs GROUP BY 1, 2)
SELECT CASE WHEN dir = 'D03' THEN 'interp_000' ELSE 'interp_001' END AS dir, ant, time, {R('val')} AS val FROM li_dirs JOIN c USING (ant, time) WHERE dir IN ('D03', 'D07') AND n = (SELECT count(DISTINCT dir) FROM li_dirs)""",
    "cubic_truth": cte("ev_time") + """, g AS (SELECT DISTINCT time + 0.37 AS time FROM ev_time), s AS (SELECT DISTINCT ant FROM ev_time), x AS (SELECT ant, time, time / 10.0 AS t FROM s, g)
SELECT ant, round(time::DOUBLE, 6) AS time, round((1 + t - 0.3 * t * t + 0.02 * t * t * t)::DOUBLE, 4) AS val FROM x""",
    "bandpass_truth": f"WITH s AS ({_STATIONS}) SELECT ant, (days * 60)::BIGINT AS cells, (CASE a WHEN 3 THEN days * 60 WHEN 7 THEN days * 60 WHEN 5 THEN days ELSE 0 END)::BIGINT AS flagged FROM s",
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
