import numpy as np
import pytest

from solweave.model import Solutions
from solweave.operators import flagging
from solweave.plans import runner
from solweave.sources.store import Store

SCHEMA = "ant string, pol string, time double, freq double, val double, weight double"
FREQS = {"lba": np.linspace(12e6, 76e6, 64), "hba_low": np.linspace(118e6, 188e6, 64)}


def bandpass(band):
    _, knots, start, *_ = flagging.BANDS[band]
    return 10 ** (flagging.band_basis(FREQS[band], knots) @ np.array(start))


def table(spark, band, level, change=lambda ant, pol, k: (1.0, 1.0)):
    rng, rows = np.random.default_rng(2), []
    for ant, at in level.items():
        for pol in ("XX", "YY"):
            for t in range(3):
                for k, (f, v) in enumerate(zip(FREQS[band], bandpass(band), strict=True)):
                    factor, weight = change(ant, pol, k)
                    rows.append((ant, pol, float(t), float(f), float(v * at * factor * 10 ** rng.normal(0, 0.002)), weight))
    return Solutions.of(spark.createDataFrame(rows, SCHEMA), ["ant", "pol", "time", "freq"])


def share(out):
    return {(r.ant, r.pol): r.s for r in out.df.groupBy("ant", "pol").agg({"weight": "avg"}).withColumnRenamed("avg(weight)", "s").collect()}


@pytest.mark.parametrize("band", ["lba", "hba_low"])
def test_band_models_and_default_levels(spark, band):
    got = share(flagging.flag_stations_bandpass(table(spark, band, {"CS001": 100.0, "CS002": 1000.0, "CS003": 0.001, "CS004": 0.01})))
    assert {a for (a, _), s in got.items() if s == 0} == {"CS002", "CS004"}
    assert got["CS001", "XX"] > 0.95 and got["CS003", "YY"] > 0.95
    got = share(flagging.flag_stations_bandpass(table(spark, band, {"CS001": 100.0, "CS002": 1000.0}), amp_range=(900, 1100)))
    assert got["CS001", "XX"] == 0 and got["CS002", "XX"] > 0.95


def test_a_lost_polarisation_takes_the_station(spark):
    x = table(spark, "hba_low", {"CS001": 100.0, "CS002": 100.0}, lambda ant, pol, k: (1.0, 0.0 if (ant, pol) == ("CS001", "YY") else 1.0))
    got = share(flagging.flag_stations_bandpass(x))
    assert got["CS001", "XX"] == got["CS001", "YY"] == 0 and got["CS002", "XX"] > 0.95


def test_least_share_and_skips(spark):
    x = table(spark, "hba_low", {"CS001": 100.0, "DE601": 1000.0}, lambda ant, pol, k: (1.6 if (ant, k) == ("CS001", 30) else 1.0, 1.0))
    got = share(flagging.flag_stations_bandpass(x))
    assert got["DE601", "XX"] == 0 and got["CS001", "XX"] == pytest.approx(63 / 64)
    got = share(flagging.flag_stations_bandpass(x, least=0.1, skip_international=True))
    assert all(s == 1 for s in got.values())
    assert share(flagging.flag_stations_bandpass(x, skip=["DE601"]))["DE601", "YY"] == 1


def test_limit_of_the_scatter():
    _, knots, start, *_ = flagging.BANDS["hba_low"]
    m, one, tight = bandpass("hba_low") * 10 ** (0.07 * (-1.0) ** np.arange(64)), np.ones(64), np.full(10, 1e-6)
    judge = lambda sigma: flagging.judge_bandpass(m, one, one, one, flagging.band_basis(FREQS["hba_low"], knots), np.array(start), tight, tight, 0.01, 0.0, 1.0, sigma, 2)
    assert judge(5.0)[0].all() and not judge(10.0)[0].any()


def test_elsewhere_nothing_is_judged(spark):
    x = table(spark, "hba_low", {"CS001": 1000.0})
    far = x.put(x.df.withColumn("freq", x.df.freq + 1e8))
    assert set(share(flagging.flag_stations_bandpass(far)).values()) == {1.0}
    assert set(share(flagging.flag_stations_bandpass(x, telescope="other")).values()) == {1.0}


def test_basis_beyond_the_knots():
    _, knots, *_ = flagging.BANDS["hba_low"]
    b = flagging.band_basis(np.array([110e6, 115e6, 150e6, 190e6, 196e6]), knots)
    assert b.shape == (5, 10) and np.allclose(b[1:4].sum(axis=1), 1)
    assert b[0, 0] == pytest.approx((20 / 15) ** 3) and b[4, 9] == pytest.approx(1.5**3) and not b[0, 1:].any() and not b[4, :9].any()


def test_residuals_against_the_nearest_antenna(spark, tmp_path, caplog):
    where = {"CS001": 0.0, "CS002": 10.0, "RS001": 500.0, "RS002": 510.0}
    s = Store(spark, str(tmp_path / "s"), "a")
    s.make_solset(None, spark.createDataFrame([(a, [x, 0.0, 0.0]) for a, x in where.items()], "name string, position array<float>"), None)
    phi = lambda a, t: (0.4 * np.sin(t) if a[0] == "R" else 0.0) + (1.0 if (a, t) == ("RS001", 5) else 0.0)
    rows = [(a, "XX", float(t), 1e8, float(phi(a, t)), 1.0) for a in where for t in range(30)]
    s.make_table("sol000", spark.createDataFrame(rows, SCHEMA), ["ant", "pol", "time", "freq"], "phase")
    step = "soltab = sol000/phase000\n[f]\noperation = FLAGSTATION\nmode = resid\nrefAnt = {}\n"
    s.write("sol000", s.table("sol000/phase000").put(s.table("sol000/phase000").df, name="other"))
    assert len(runner.run(step.format("RS009").replace("phase000", "other"), s)) == 1 and "no antenna RS009" in caplog.text
    assert s.table("sol000/phase000").df.filter("weight = 0").count() == 0
    assert len(runner.run(step.format("nearest"), s)) == 1
    done = s.table("sol000/phase000").df
    assert {(r.ant, r.time) for r in done.filter("weight = 0").collect()} == {("RS001", 5.0), ("RS002", 5.0)}
    assert done.filter("val = 1 OR val IS NULL").count() == 0  # the values stay as they were
