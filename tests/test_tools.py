import numpy as np
import pytest
from pyspark.sql import functions as F

from solweave.functions.carry import before
from solweave.functions.medians import group_medians
from solweave.model import Solutions
from solweave.operators import beam, plotting, referencing, smoothing
from solweave.plans import cli
from solweave.sources import tables
from solweave.sources.store import Store


def test_beam(spark):
    rows = [("CS001", p, float(t), 1e8 + f * 1e6, 1.0, 1.0) for p in ("XX", "XY", "YY") for t in range(3) for f in range(2)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, pol string, time double, freq double, val double, weight double"), ["ant", "pol", "time", "freq"])

    def model(station, time, freq):
        j = np.zeros((len(time), 2, 2), dtype=complex)
        j[:, 0, 0], j[:, 1, 1] = 2 * np.exp(1j * time), 3 * np.exp(-1j * time)
        return j

    got = {(r.pol, r.time): r.val for r in beam.fill_beam(t, model).df.collect()}
    assert got["XX", 1.0] == pytest.approx(2) and got["YY", 2.0] == pytest.approx(3) and got["XY", 1.0] == 1.0
    phase = Solutions(t.df, t.axes, "phase")
    assert {(r.pol, r.time): r.val for r in beam.fill_beam(phase, model).df.collect()}["YY", 1.0] == pytest.approx(-1)
    with pytest.raises(RuntimeError):
        beam.fill_beam(t)


def test_gain_record(spark, tmp_path):
    g = (np.arange(5 * 2 * 3 * 1 * 4).reshape(5, 2, 3, 1, 2, 2) + 1) * np.exp(0.5j)
    sols = np.zeros(5, dtype=[("t0", float), ("t1", float), ("G", complex, g.shape[1:])])
    sols["t0"], sols["t1"], sols["G"] = np.array([2.0, 10, 20, 30, 40]), np.array([10.0, 20, 30, 40, 43]), g
    np.savez(tmp_path / "g.npz", Sols=sols, FreqDomains=np.array([[1e8, 1.1e8], [1.1e8, 1.2e8]]), StationNames=np.array(["CS1", "CS2", "RS1"]))
    out = tables.from_gain_record(spark, str(tmp_path / "g.npz"))
    amp = out["amplitude000"].df
    assert amp.count() == g.size and sorted(r.time for r in amp.select("time").distinct().collect()) == [5.0, 15.0, 25.0, 35.0, 45.0]
    r = amp.filter("ant = 'RS1' AND pol = 'YX' AND time = 45 AND freq = 1.15e8").first()
    assert r.val == pytest.approx(abs(g[4, 1, 2, 0, 1, 0]))
    assert out["phase000"].df.agg(F.max(F.abs(F.col("val") - 0.5))).first()[0] < 1e-12


def test_directions_and_parameters(spark):
    names = spark.createDataFrame([("pointing",), ("A",), ("B",)], "name string")
    patches = spark.createDataFrame([("A", 1.0, 2.0), ("A", 3.0, 4.0)], "patch string, ra double, dec double")
    got = {r.name: r.dir for r in tables.directions(names, (0.5, 0.25), patches).collect()}
    assert got["pointing"] == [0.5, 0.25] and got["A"] == [2.0, 3.0] and all(np.isnan(got["B"]))
    rows = [("Gain:0:0:Real:CS1", 1.0, 1e8, 3.0), ("Gain:0:0:Imag:CS1", 1.0, 1e8, 4.0), ("DirectionalGain:1:1:Ampl:CS1:3C196", 1.0, 1e8, float("nan")), ("Clock:CS1", 1.0, 1e8, 2e-9), ("TEC:CS1", 1.0, 1e8, float("inf")),
            ("RotationMeasure:CS2", 1.0, 1e8, 0.1), ("Other:CS1", 1.0, 1e8, 1.0), (None, 1.0, 1e8, 1.0)]
    out = tables.parameters_to_tables(spark.createDataFrame(rows, "name string, time double, freq double, val double"))
    amp = {(r.dir, r.pol): (r.val, r.weight) for r in out["amplitude000"].df.collect()}
    assert amp == {("pointing", "XX"): (5.0, 1.0), ("3C196", "YY"): (1.0, 0.0)}
    assert out["clock000"].df.first().val == 2e-9 and out["tec000"].df.first().weight == 0 and out["rotationmeasure000"].df.first().ant == "CS2"
    assert out["phase000"].df.first().val == pytest.approx(np.arctan2(4, 3))


def test_screen(spark):
    rows = [(a, d, float(t), float(i + t), 1.0) for t in range(2) for i, (a, d) in enumerate([("A", "x"), ("B", "x"), ("A", "y")])]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, dir string, time double, val double, weight double"), ["ant", "dir", "time"], "tec")
    pp = spark.createDataFrame([(a, d, float(t), float(i), 0.0, 0.0) for t in range(2) for i, (a, d) in enumerate([("A", "x"), ("B", "x"), ("A", "y")])], "ant string, dir string, time double, x double, y double, z double")
    got = tables.screen_weights(t, pp).filter("time = 1").orderBy("dir", "ant").collect()
    p = np.arange(3.0)
    c = -((p[:, None] - p[None]) ** 2) ** (5 / 6) / 2
    want = dict(zip([("A", "x"), ("B", "x"), ("A", "y")], np.linalg.pinv(c) @ np.array([1.0, 2, 3]), strict=True))
    assert all(r.val == pytest.approx(want[r.ant, r.dir]) for r in got)


def test_plot_rows(spark):
    rows = [(a, p, float(t), (5.0 if p == "XX" else 1.0) + t, float(t != 2)) for a in ("A", "B") for p in ("XX", "YY") for t in range(5)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, pol string, time double, val double, weight double"), ["ant", "pol", "time"])
    got = plotting.plot_rows(t, ["time"], colour="pol").collect()
    assert len(got) == 20 and {r.file for r in got} == {"ant-A", "ant-B"} and {r.colour for r in got} == {"XX", "YY"}
    assert all((r.val is None) == (r.x == 2.0) for r in got)
    diff = plotting.plot_rows(t, ["time"], panel="ant", diff="pol", show_flagged=True).collect()
    assert len(diff) == 10 and {r.val for r in diff} == {4.0} and {r.file for r in diff} == {"all"}
    ph = Solutions(t.df, t.axes, "phase")
    un = {(r.colour, r.x): r.val for r in plotting.plot_rows(ph, ["time"], panel="ant", colour="pol", unwrap_phases=True, show_flagged=True).collect()}
    assert len(un) == 10


def test_plots_of_planes_places_and_broken_times(spark):
    t0 = [float(i) for i in range(10)] + [5000.0 + i for i in range(10)] + [9000.0]
    rows = [(a, x, 1e8 + f * 1e6, 0.7 * x + 0.3 * f, 1.0 if x else 0.0) for a in ("A", "B") for x in t0 for f in range(4)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, time double, freq double, val double, weight double"), ["ant", "time", "freq"], "phase")
    assert plotting.time_breaks(t) == [(9.0, 4991.0), (5009.0, 3991.0)]
    x = sorted({r.x for r in plotting.plot_rows(t, ["time"], panel="ant", colour="freq").collect()})
    left = 9000.0 - 4991.0 - 3991.0
    assert x[9] * 3600 == pytest.approx(9) and x[10] * 3600 == pytest.approx(9 + left / 100) and x[-1] * 3600 == pytest.approx(left + 2 * left / 100)
    plane = plotting.plot_rows(t.put(t.df.filter("time < 10")), ["time", "freq"], unwrap_phases=True, show_flagged=True).filter("file = 'ant-A' AND NOT flagged").collect()
    off = {round(r.val - 0.7 * r.x - 0.3 * (r.y - 100), 6) for r in plane}
    assert len(plane) == 36 and len(off) == 1
    ants = spark.createDataFrame([("A", [1.0, 2.0, 3.0])], "name string, position array<float>")
    got = plotting.plot_rows(t, ["ant"], antennas=ants, minmax=(0, 0)).filter("time" if False else "true").collect()
    assert {(r.x, r.px, r.py) for r in got} == {("A", 2.0, -1.0), ("B", None, None)}
    for bad in (["ant", "ant"], ["nope"], ["ant", "time", "freq"]):
        with pytest.raises(ValueError):
            plotting.plot_rows(t, bad)


def test_axes_and_grids(spark):
    rows = [("A", 2, 1.0, 1.0), ("A", 1, None, 1.0), ("B", 1, 3.0, 0.5)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, time int, val double, weight double"), ["ant", "time"])
    assert t.ant == ["A", "B"] and t.axis_values("time") == [1, 2] and t.axis_length("time") == 2 and t.axis_type("time") == "int"
    with pytest.raises(AttributeError):
        t.freq  # noqa: B018
    with pytest.raises(ValueError):
        t.axis_values("time", most=1)
    got = list(t.grids(["time"]))
    assert [g[0] for g in got] == [{"ant": "A", "time": [1, 2]}, {"ant": "B", "time": [1, 2]}]
    np.testing.assert_array_equal(got[0][1], [np.nan, 1.0])
    np.testing.assert_array_equal(got[1][2], [0.5, 0.0])
    whole = list(t.grids(["ant", "time"]))
    assert len(whole) == 1 and whole[0][1].shape == (2, 2)


def test_medians_of_any_group(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 1001), ("d", 3000)) for v in rng.normal(size=n)] + [("e", 7.0)] * 500 + [("c", None), ("f", None)]
    got = {r.g: r.m for r in group_medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()}
    assert set(got) == set("abcde")
    for g in got:
        assert got[g] == pytest.approx(np.median([v for k, v in rows if k == g and v is not None]), abs=1e-15)
    one = group_medians(spark.createDataFrame(rows, "g string, v double"), [], "v", "m").collect()
    assert one[0].m == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_look_back_over_blocks(spark):
    rows = [("a", i, None if i % 3 else i) for i in range(40) if i not in range(10, 20)] + [("b", 5, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for block in (1000, 4):
        got = {(r.k, r.i): (r.lag, r.last) for r in before(before(df, ["k"], "i", F.col("i"), "lag", F.floor(F.col("i") / block)), ["k"], "i", F.col("v"), "last", F.floor(F.col("i") / block), known=True).collect()}
        order = sorted(i for k, i, _ in rows if k == "a")
        for n, i in enumerate(order):
            prior = [j for j in order[:n] if j % 3 == 0]
            assert got["a", i] == (order[n - 1] if n else None, prior[-1] if prior else None)
        assert got["b", 5] == (None, None)


def test_reference_corner_cases(spark):
    rows = [(a, p, t, float(ord(a) + t), 1.0 if a != "C" else 0.0) for a in "ABC" for p in ("XX", "YY") for t in range(3) if (a, t) != ("B", 1)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, pol string, time int, val double, weight double"), ["ant", "pol", "time"], "phase")
    ants = spark.createDataFrame([("A", [0.0, 0.0, 0.0]), ("B", [2.0, 0.0, 0.0]), ("C", [1.0, 0.0, 0.0]), ("A", [0.0, 0.0, 0.0]), ("X", None)], "name string, position array<float>")
    assert referencing.reference(t) is t
    assert {(r.ant, r.ref) for r in referencing.closest_antennas(t, ants).collect()} == {("A", "B"), ("B", "A"), ("C", "A")}
    lost = referencing.reference(t, "B").df.filter("val IS NULL").collect()
    assert {r.time for r in lost} == {1} and len(lost) == 4
    assert referencing.auto_reference(t, ants) == "A"


def test_reweight_and_interpolate_corner_cases(spark):
    rows = [("A", float(i), 5.0, 1.0) for i in range(20)] + [("B", float(i), None, 0.0) for i in range(20)] + [("C", float(i), 1.0 + (i % 4) / 10, 1.0) for i in range(20)]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, time double, val double, weight double"), ["ant", "time"])
    w = {}
    for r in smoothing.reweight_window(t, "time", 0, 7).df.collect():
        w.setdefault(r.ant, set()).add(round(r.weight, 6))
    assert w["A"] == {1.0} and w["B"] == {0.0} and min(w["C"]) > 1
    g = smoothing.interpolate(t, "time", 0.5).df
    assert g.filter("ant = 'B' AND val IS NOT NULL").count() == 0 and g.filter("ant = 'A'").agg(F.max("val")).first()[0] == 5.0


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "s")
    s = Store(spark, root, "a")
    s.make_solset()
    s.make_table("sol000", spark.createDataFrame([("A", 1, -2.0, 1.0), ("B", 1, 3.0, 1.0)], "ant string, time int, val double, weight double"), ["ant", "time"], "amplitude")
    steps = tmp_path / "steps"
    steps.write_text("soltab = sol000/amplitude000\n[a]\noperation = ABS\n")
    assert cli.main(["-q", root, str(steps)]) == 0 and s.table("sol000/amplitude000").df.agg(F.min("val")).first()[0] == 2.0
    assert cli.main(["-i", root]) == 0 and "amplitude000" in capsys.readouterr().out
    assert cli.main(["-q", "-d", "sol000/amplitude000", root]) == 0 and s.tables("sol000") == []


def test_staged_tables_can_be_let_go(spark, tmp_path):
    import os

    from solweave import staging

    folder = staging.shared_dir(spark)
    rows = staging.stage(spark.range(10), "held")
    assert rows.count() == 10 and any(n.startswith("staged-held") for n in os.listdir(folder.removeprefix("file:")))
    staging.release()
    assert not any(n.startswith("staged-held") for n in os.listdir(folder.removeprefix("file:")))
