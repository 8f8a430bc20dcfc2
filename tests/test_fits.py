import numpy as np
import pytest
from pyspark.sql import functions as F

from solweave.functions.scalar import TEC_PHASE, quantity
from solweave.model import Solutions
from solweave.operators import fits, flagging, smoothing
from solweave.sources import tables


def phases(spark, f, ants=4, times=12, freqs=np.linspace(40e6, 70e6, 60), pols=None, noise=0.0):
    rng = np.random.default_rng(3)
    rows = []
    for a in range(ants):
        for t in range(times):
            for p in pols or [None]:
                phi = f(a, t, freqs, p) + rng.normal(0, noise, len(freqs))
                phi = np.mod(phi + np.pi, 2 * np.pi) - np.pi
                rows += [(f"CS{a:03d}", float(t), float(nu), p, float(x), 1.0) for nu, x in zip(freqs, phi, strict=True)]
    df = spark.createDataFrame(rows, "ant string, time double, freq double, pol string, val double, weight double")
    axes = ["ant", "time", "freq", *(["pol"] if pols else [])]
    return Solutions.of(df, axes, "phase")


def test_tec_with_noise_flags_and_reference(spark):
    truth = lambda a, t: 0.1 * a - 0.15 + 0.01 * t
    x = phases(spark, lambda a, t, nu, p: TEC_PHASE * truth(a, t) / nu, noise=0.1)
    x = x.put(x.df.withColumn("weight", F.when((F.col("time") == 3) & (F.col("ant") == "CS002"), 0.0).otherwise(F.col("weight"))))
    got = {(r.ant, r.time): r for r in fits.tec(x, "CS000").df.collect()}
    assert len(got) == 48
    for (ant, t), r in got.items():
        a = int(ant[2:])
        if ant == "CS000":
            assert (r.val, r.weight) == (0.0, 1.0)
        elif (ant, t) == ("CS002", 3.0):
            assert r.weight == 0
        else:
            assert r.weight == 1 and r.val == pytest.approx(truth(a, t) - truth(0, t), abs=2e-3)


def test_clock_tec_with_noise(spark):
    truth = lambda a, t: (0.0 if a == 0 else 0.05 * a + 0.01 * t, 0.0 if a == 0 else 3.0 * a - 5)
    x = phases(spark, lambda a, t, nu, p: TEC_PHASE * truth(a, t)[0] / nu + 2e-9 * np.pi * truth(a, t)[1] * nu, noise=0.05)
    x = x.put(x.df.withColumn("ant", F.regexp_replace("ant", "CS", "RS")))  # no inner core: relative to the first station
    out = fits.clock_tec(x)
    tec = {(r.ant, r.time): r for r in out["tec000"].df.collect()}
    clock = {(r.ant, r.time): r for r in out["clock000"].df.collect()}
    for (ant, t), r in tec.items():
        want = truth(int(ant[2:]), t)
        assert r.weight == 1 and r.val == pytest.approx(want[0], abs=0.01)
        assert clock[ant, t].val * 1e9 == pytest.approx(want[1], abs=0.5)


def test_polarisation_delay(spark):
    freqs = np.linspace(120e6, 180e6, 40)
    x = phases(spark, lambda a, t, nu, p: (1e-9 * a * nu + 0.3) if p == "XX" else 0 * nu, freqs=freqs, pols=["XX", "YY"], noise=0.05)
    out = fits.align_polarisations(x).df.filter("pol = 'YY'").collect()
    for r in out:
        want = -(1e-9 * int(r.ant[2:]) * r.freq + 0.3)
        assert abs(np.angle(np.exp(1j * (r.val - want)))) < 0.1


def test_spline_bandpass_and_bounds():
    u = np.linspace(0, 1, 50)
    b = flagging.spline_basis(u, 5)
    assert np.allclose(b.sum(axis=1), 1) and (b >= 0).all() and b.shape == (50, 8)
    rng = np.random.default_rng(0)
    y = b @ rng.normal(size=8)
    low, high = np.full(8, -0.5), np.full(8, 0.5)
    x = flagging.bounded_lsq(b, y, low, high)
    best = np.clip(x, low, high)
    assert (x >= low - 1e-12).all() and (x <= high + 1e-12).all()
    grad = b.T @ (b @ best - y)
    assert all(abs(g) < 1e-6 or (v <= -0.5 + 1e-9 and g > 0) or (v >= 0.5 - 1e-9 and g < 0) for g, v in zip(grad, best, strict=True))


def test_bandpass_flags_a_bad_channel(spark):
    freqs = np.linspace(120e6, 180e6, 60)
    shape = 100 * 10 ** (0.05 * np.sin(freqs / 1e7))
    rows = [(f"CS{a:03d}", float(t), float(f), float(v * (1.35 if (a, k) == (1, 30) else 1.0)), 1.0) for a in range(3) for t in range(5) for k, (f, v) in enumerate(zip(freqs, shape, strict=True))]
    t = Solutions.of(spark.createDataFrame(rows, "ant string, time double, freq double, val double, weight double"), ["ant", "time", "freq"])
    bad = {(r.ant, round(r.freq)) for r in flagging.flag_stations_bandpass(t, intervals=12).df.filter("weight = 0").collect()}
    assert ("CS001", round(freqs[30])) in bad and len(bad) < 4


def test_two_dimensional_flagging(spark):
    rng = np.random.default_rng(4)
    v = 10 ** rng.normal(1, 0.01, (40, 30))
    spikes = [(3, 4), (20, 20), (39, 0)]
    for s in spikes:
        v[s] *= 2
    rows = [(float(t), float(f), float(v[t, f]), 1.0) for t in range(40) for f in range(30)]
    t = Solutions.of(spark.createDataFrame(rows, "time double, freq double, val double, weight double"), ["time", "freq"])
    for mode, order in (("smooth", [5, 5]), ("poly", [1, 1]), ("spline", [2, 2]), ("smooth", [0, 0])):
        bad = {(int(r.time), int(r.freq)) for r in flagging.flag(t, ["time", "freq"], order, mode=mode).df.filter("weight = 0").collect()}
        assert set(spikes) <= bad and len(bad) < 8


def test_savitzky_golay_keeps_polynomials(spark):
    rows = [(float(t), float(1 + 0.1 * t + 0.02 * t * t), 1.0) for t in range(30)]
    t = Solutions.of(spark.createDataFrame(rows, "time double, val double, weight double"), ["time"])
    for mode in ("savitzky-golay", "runningpoly"):
        out = smoothing.smooth(t, ["time"], [7], mode=mode, degree=2).df.collect()
        assert all(r.val == pytest.approx(1 + 0.1 * r.time + 0.02 * r.time**2) for r in out)


def test_splines_interpolate():
    x = np.array([0.0, 1, 2.5, 3, 4.2, 5, 6])
    at = np.linspace(-0.5, 6.5, 20)
    assert np.allclose(tables.spline(x, x**3 - x, at, 3), at**3 - at)
    assert np.allclose(tables.spline(x, x**2, x, 2), x**2)
    assert np.allclose(tables.spline(x[:2], x[:2] * 3, at, 3), at * 3)


def test_directions(spark):
    rng = np.random.default_rng(1)
    known = rng.uniform(0, 0.1, (14, 2))
    w = fits.direction_weights(known, known[:3])
    assert np.allclose(w, np.eye(14)[:3], atol=1e-8)


def test_quantities():
    assert [quantity(x) for x in ("10s", "2 ks", "100kHz", "1.5MHz", 7, "3ms")] == [10.0, 2000.0, 1e5, 1.5e6, 7.0, 3e6]
    with pytest.raises(ValueError):
        quantity("ten")


@pytest.mark.parametrize("kind", ["amplitude", "phase", "clock"])
@pytest.mark.parametrize("order", [0, 4, 5])
@pytest.mark.parametrize("replace", [False, True])
def test_lines_at_once_equal_lines_one_by_one(spark, kind, order, replace):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(12):
        for t in range(int(rng.integers(1, 60))):
            v = abs(rng.normal(3, 0.3)) + (20 if rng.random() < 0.06 else 0) if g != 5 else 2.0
            rows.append((f"a{g}", float(t), None if rng.random() < 0.05 else float(v if rng.random() > 0.02 else -v), float(rng.random() > 0.1) if g != 3 else 0.0))
    t = Solutions.of(spark.createDataFrame(rows, "ant string, time double, val double, weight double"), ["ant", "time"], kind)
    fast = {(r.ant, r.time): (r.val, r.weight) for r in flagging.flag(t, ["time"], [order], cycles=4, max_rms=4, replace=replace).df.collect()}
    how = "phase" if kind == "phase" else "amplitude" if kind == "amplitude" else "plain"
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g)
        val, w = np.array([np.nan if r[2] is None else r[2] for r in mine]), np.array([r[3] for r in mine])
        new, flags = flagging.flag_cube(val, w, [np.array([r[1] for r in mine])], [order], how, "smooth", 4, 4.0, 0.0, 0.0, 0.0, 11, replace)
        for r, v, f in zip(mine, new, flags, strict=True):
            got = fast[g, r[1]]
            assert got[1] == f and (got[0] == pytest.approx(v, abs=1e-12) if not np.isnan(v) else got[0] is None)
