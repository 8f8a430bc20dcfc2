import pytest
from pyspark.sql import functions as F

from solweave.plans import runner
from solweave.sources import tables
from solweave.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), "a")
    ants = spark.createDataFrame([("CS001", [0.0, 0.0, 0.0]), ("CS002", [10.0, 0.0, 0.0]), ("RS001", [500.0, 0.0, 0.0])], "name string, position array<float>")
    s.make_solset(None, ants, spark.createDataFrame([("a", [0.1, 0.2])], "name string, dir array<float>"))
    rows = [(a, p, t, 10.0 + 0.01 * t + (100 if (a, t) == ("CS001", 7) else 0), 1.0) for a in ("CS001", "CS002", "RS001") for p in ("XX", "YY") for t in range(30)]
    df = spark.createDataFrame(rows, "ant string, pol string, time bigint, val double, weight double")
    s.make_table("sol000", df, ["ant", "pol", "time"], "amplitude")
    s.make_table("sol000", df.withColumn("val", F.col("val") / 7), ["ant", "pol", "time"], "phase")
    return s


def test_names_and_contents(store, spark):
    assert store.solsets() == ["sol000"] and store.tables("sol000") == ["amplitude000", "phase000"]
    assert store.make_solset("sol000") == "sol001" and store.make_solset("bad name!") == "sol002" and store.make_solset("night") == "night"
    store.rename_solset("night", "day")
    with pytest.raises(FileExistsError):
        store.rename_solset("day", "sol001")
    store.delete_solset("sol001")
    assert store.solsets("^s") == ["sol000", "sol002"]
    t = store.table("sol000/amplitude000", ant="CS.*", time={"max": 9})
    assert t.df.count() == 40
    store.write("sol000", store.table("sol000/amplitude000"), note="again")  # from itself
    assert store.table("sol000/amplitude000").df.count() == 180
    assert [h.split(": ", 1)[1] for h in store.history("sol000/amplitude000").split("\n")] == ["created", "again"]
    store.rename_table("sol000/phase000", "phi")
    store.delete_table("sol000/phi")
    assert store.tables("sol000") == ["amplitude000"] and store.side("sol000", "antenna").count() == 3
    assert "180 cells, 0.000% flagged" in store.info()
    with pytest.raises(KeyError):
        store.table("sol000/none")
    with pytest.raises(FileNotFoundError):
        Store(spark, store.root + "-none")
    with pytest.raises(PermissionError):
        Store(spark, store.root).make_solset()
    with pytest.raises(ValueError):
        store.make_table("sol000", t.df.unionByName(t.df), ["ant", "pol", "time"], "amplitude")


def test_selections_are_predicates_on_one_scan(store):
    t = store.table("sol000/amplitude000", ant="CS.*", time={"min": 4, "max": 9}, pol=["YY", "none"])
    plan = t.df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "PushedFilters: [IsNotNull" in plan and ">= 4)" in plan and plan.count("FileScan") == 1
    assert t.df.count() == 12
    assert store.table("sol000/amplitude000", ant="nothing").df.count() == 180  # selects nothing: keeps all
    assert store.table("sol000/amplitude000", time=slice(-3, None)).df.agg(F.min("time")).first()[0] == 27
    assert store.table("sol000/amplitude000", time={"min": 3, "step": 10}).df.select("time").distinct().count() == 3
    assert store.table("sol000/amplitude000", time=[1, 5, 99], ant="RS001").df.count() == 4
    assert store.coordinates("sol000/amplitude000", "ant") == ["CS001", "CS002", "RS001"] and store.coordinates("sol000/amplitude000", "time") == list(range(30))
    text = store.info(verbose=True)
    assert "ant: [CS001, CS002, RS001]" in text and "CS002: 10, 0, 0" in text and "antennas: CS001, CS002, RS001" in text


def test_long_axes_are_looked_up(store, monkeypatch):
    from solweave.sources import store as module

    monkeypatch.setattr(module, "MOST_COORDINATES", 5)
    store.write("sol000", store.table("sol000/amplitude000"))
    assert set(store._known("sol000", "amplitude000", store._meta("sol000/amplitude000"))) == {"ant", "pol"}
    assert store.table("sol000/amplitude000", time={"min": 4, "max": 9}, ant="CS.*").df.count() == 24
    assert store.coordinates("sol000/amplitude000", "time") == list(range(30))


def test_copy(store, spark, tmp_path):
    other = Store(spark, str(tmp_path / "other"), "a")
    store.copy_solset("sol000", other, "copy")
    assert [h.split(": ", 1)[1] for h in other.history("copy/phase000").split("\n")] == ["created", "copied from sol000/phase000"]
    assert other.tables("copy") == ["amplitude000", "phase000"] and other.table("copy/phase000").kind == "phase"
    with pytest.raises(FileExistsError):
        store.copy_solset("sol000", other, "copy")


STEPS = """
soltab = [sol000/amplitude000]   # for all steps
[dup]
operation = DUPLICATE
soltabOut = keep
[clip]
operation = CLIP
axesToClip = [time]
clipLevel = 3
pol = XX
[norm]
operation = NORM
axesToNorm = time
normVal = 2
[ref]
operation = REFERENCE
soltab = sol000/phase.*
refAnt = CS002
[smooth]
operation = SMOOTH
axesToSmooth = [time]
size = [5]
[nonsense]
operation = NOSUCH
[weights]
operation = REWEIGHT
mode = uniform
weightVal = 0.5
time.minmaxstep = [0, 9]
[sub]
operation = RESIDUALS
soltab = sol000/keep
soltabsToSub = amplitude000
"""


def test_steps(store):
    done = runner.run(STEPS, store)
    assert [d[0] for d in done] == ["dup", "clip", "norm", "ref", "smooth", "weights", "sub"]
    a = store.table("sol000/amplitude000").df
    assert a.count() == 180 and a.filter("weight = 0").select("ant", "pol", "time").collect() == []
    assert {r.weight for r in a.filter("time < 10").collect()} == {0.5} and {r.weight for r in a.filter("time >= 10").collect()} == {1.0}
    assert store.table("sol000/phase000").df.filter("ant = 'CS002'").agg(F.max(F.abs("val"))).first()[0] == 0
    assert store.table("sol000/keep").df.count() == 180
    assert "CLIP" in store.history("sol000/amplitude000")


def cells_of(store, name):
    return {(r.ant, r.pol, r.time): (r.val, r.weight) for r in store.table(f"sol000/{name}").df.collect()}


def test_flags_of_referenced_values_leave_the_values(store):
    before = cells_of(store, "phase000")
    runner.run("[f]\nOPERATION = flag\nSolTab = sol000/phase000\naxesToFLAG = time\norder = 5\nfixrms = 1\nRefAnt = CS002\n", store)
    after = cells_of(store, "phase000")
    assert {k: v for k, (v, _) in after.items()} == {k: v for k, (v, _) in before.items()}
    assert {k[::2] for k, (_, w) in after.items() if w == 0} == {("CS001", 7)}


def test_references_that_are_not_there(store):
    before = cells_of(store, "phase000")
    assert runner.run("[r]\noperation = REFERENCE\nsoltab = sol000/phase000\nrefAnt = XX999\n", store) == []  # an error
    assert cells_of(store, "phase000") == before
    runner.run("[f]\noperation = FLAGSTATION\nmode = resid\nsoltab = sol000/phase000\nrefAnt = XX999\n", store)  # the first antenna
    assert {k[0] for k, (_, w) in cells_of(store, "phase000").items() if w} >= {"CS001"}
    runner.run("[s]\noperation = SMOOTH\nsoltab = sol000/phase000\naxesToSmooth = time\nsize = 3\nrefAnt = XX999\n", store)  # looked for
    means = store.table("sol000/phase000").df.filter("weight > 0").groupBy("ant").agg(F.max(F.abs("val")).alias("m"))
    assert min(r.m for r in means.collect()) < 1e-9


def test_nearest_reference_does_not_flag_everything(store):
    runner.run("[f]\noperation = FLAGSTATION\nmode = resid\nsoltab = sol000/phase000\nrefAnt = nearest\n", store)
    got = cells_of(store, "phase000")
    assert {k[0] for k, (_, w) in got.items() if w == 0 and k[2] != 7} == set()
    assert {v for k, (v, _) in got.items() if k[2] == 3} == {(10.03) / 7}


def test_plot_step(store):
    runner.run("[p]\noperation = PLOT\nsoltab = sol000/phase000\naxesInPlot = time\naxisInTable = ant\naxisInCol = pol\nrefAnt = CS002\nminmax = [0, 0]\nplotFlag = True\nprefix = x\n", store)
    rows = store.spark.read.parquet(f"{store.root}/sol000/_plots/x-phase000")
    assert rows.count() == 180 and rows.filter("panel = 'CS002'").agg(F.max(F.abs("val"))).first()[0] == 0


def test_parser():
    s = runner.parse("a = 1 # x\n[one]\nb = [1, two, 3.5] ; y\nc.regexp = CS.*\n[two]\nc.minmaxstep = [1, 5, 2]\nd = False\n")
    assert list(s) == ["_global", "one", "two"] and runner.value(s["one"]["b"]) == [1, "two", 3.5]
    assert runner.selection_of("c", s["one"], s["two"]) == "CS.*" and runner.selection_of("c", s["two"], {}) == {"min": 1, "max": 5, "step": 2}
    assert runner.value("False") is False and runner.value("") is None
    for name in ("ABS", "CLIP", "CLOCKTEC", "DELETEAXIS", "DUPLICATE", "FARADAY", "FLAG", "FLAGEXTEND", "FLAGSTATION", "INTERPOLATE", "INTERPOLATEDIRECTIONS", "LOFARBEAM", "NORM", "PLOT", "POLALIGN", "REFERENCE", "REPLICATEONAXIS", "RESET", "RESIDUALS", "REWEIGHT", "SMOOTH", "STRUCTURE", "TEC"):
        assert name in runner.OPERATIONS


def test_collect_and_split(store):
    t = store.table("sol000/amplitude000")
    early, late = t.put(t.df.filter("time < 20")), t.put(t.df.filter("time >= 10").withColumn("val", F.lit(-1.0)))
    out = tables.collect([early, late])
    assert out.df.count() == 180 and out.df.filter("val = -1").count() == 120
    chunks = tables.split(t.put(t.df.filter("time <= 20")), "time", 10, inclusive=True).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == [66, 66]  # 21 times, of which one lies in both


def test_streamed_solutions_arrive_once(spark, tmp_path):
    from solweave.streaming.append import append_to, arriving

    rows = spark.createDataFrame([(i, f"2004-12-17 11:{i:02d}:00", 1.0) for i in range(20)], "id bigint, at string, val double").selectExpr("id", "cast(at as timestamp) at", "val")
    src = str(tmp_path / "in")
    rows.write.parquet(src)
    rows.filter("id < 5").write.mode("append").parquet(src)
    q = append_to(arriving(spark, src, rows.schema, "id", "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
