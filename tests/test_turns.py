import numpy as np
import pytest

from solweave.functions.scalar import TEC_PHASE
from solweave.model import Solutions
from solweave.operators import fits

EARTH = 6.37e6
FREQS = np.linspace(120e6, 165e6, 40)
STEPS = np.linalg.pinv(np.stack([TEC_PHASE / FREQS, 2e-9 * np.pi * FREQS], axis=1)) @ np.full(40, 2 * np.pi)


def places(n):
    lon, lat = np.random.default_rng(3).uniform(-0.1, 0.1, (2, n))
    at = np.stack([lon, lat], axis=1) - [lon[0], lat[0]]
    lon, lat = np.radians(lon), np.radians(lat)
    return at, EARTH * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def test_turns_from_a_screen():
    at, pos = places(20)
    rng = np.random.default_rng(1)
    tec = rng.normal(0, 0.3, (50, 2)) @ at.T + rng.normal(0, 0.002, (50, 20))
    tec[rng.random(tec.shape) < 0.05] = np.nan
    lost = np.zeros(20)
    lost[4] = 1
    far = pos.copy()
    far[7] = EARTH * np.array([np.cos(0.1), np.sin(0.1), 0])  # further away than the plane holds
    far[8] = np.nan
    turns, shift = fits.screen_turns(tec + lost * STEPS[0], far, STEPS[0])
    assert turns.tolist() == (-lost).tolist() and np.abs(shift).max() < 0.3


@pytest.fixture
def noisy(spark):
    at, pos = places(20)
    rng, rows = np.random.default_rng(4), []
    truth = (rng.normal(0, 0.3, 2) + 0.02 * np.arange(8)[:, None]) @ at.T
    crooked = np.random.default_rng(0).normal(0, 0.15, 40)  # what makes the wrong turn fit better, at all times
    for a in range(20):
        for t in range(8):
            phi = TEC_PHASE * truth[t, a] / FREQS + 2e-9 * np.pi * (0.3 * a) * FREQS + rng.normal(0, 0.02, 40) + (crooked if a == 4 else 0)
            rows += [(f"RS{a:03d}", float(t), float(f), float(v), 1.0) for f, v in zip(FREQS, np.mod(phi + np.pi, 2 * np.pi) - np.pi, strict=True)]
    df = spark.createDataFrame(rows, "ant string, time double, freq double, val double, weight double")
    ants = spark.createDataFrame([(f"RS{a:03d}", [float(v) for v in pos[a]]) for a in range(20)], "name string, position array<double>")
    return Solutions.of(df, ["ant", "time", "freq"], "phase"), ants, truth


def off_by(out, truth):
    got = {(r.ant, r.time): r.val for r in out["tec000"].df.collect()}
    return np.array([[got[f"RS{a:03d}", float(t)] - truth[t, a] for a in range(20)] for t in range(8)]) / STEPS[0]


def test_stations_a_turn_off_come_back(noisy):
    x, ants, truth = noisy
    alone = np.round(np.median(off_by(fits.clock_tec(x, antennas=ants, remove_wraps=False), truth), axis=0))
    together = np.round(np.median(off_by(fits.clock_tec(x, antennas=ants), truth), axis=0))
    print(alone, together)
    assert np.flatnonzero(alone).tolist() == [4] and not together.any()


def test_circular_polarisations_are_added(spark):
    rows = []
    for a in range(2):
        for t in range(2):
            for pol, turn in (("LL", -1), ("RR", 1)):
                phi = a * (TEC_PHASE * 0.03 / FREQS + 2e-9 * np.pi * 2.0 * FREQS + turn * 5 * (3e8 / FREQS) ** 2)  # rotation, opposite in both
                rows += [(f"RS{a:03d}", pol, float(t), float(f), float(v), 1.0) for f, v in zip(FREQS, np.mod(phi + np.pi, 2 * np.pi) - np.pi, strict=True)]
    df = spark.createDataFrame(rows, "ant string, pol string, time double, freq double, val double, weight double")
    out = fits.clock_tec(Solutions.of(df, ["ant", "pol", "time", "freq"], "phase"), combine_pols=True, circular=True)
    assert {r.ant: (round(r.val, 4), r.weight) for r in out["tec000"].df.collect()} == {"RS000": (0.0, 1.0), "RS001": (0.03, 1.0)}
    assert {r.ant: round(r.val * 1e9, 3) for r in out["clock000"].df.collect()} == {"RS000": 0.0, "RS001": 2.0}


def test_a_first_clock_off_the_core(spark):
    assert fits.start_clock(FREQS, np.angle(np.exp(1j * (2e-9 * np.pi * 431.7 * FREQS + 0.4)))) == pytest.approx(431.7, abs=1e-6)
    rows = []
    for ant, clock in (("CS001HBA", 0.0), ("RS001HBA", 250.0), ("RS002HBA", -333.0)):
        for t in range(12):
            phi = TEC_PHASE * 0.03 * (clock != 0) / FREQS + 2e-9 * np.pi * (clock + 0.2 * t * (clock != 0)) * FREQS + 0.5 * (clock != 0)
            rows += [(ant, float(t), float(f), float(np.angle(np.exp(1j * p))), 1.0) for f, p in zip(FREQS, phi, strict=True)]
    x = Solutions.of(spark.createDataFrame(rows, "ant string, time double, freq double, val double, weight double"), ["ant", "time", "freq"], "phase")
    out = fits.clock_tec(x, flag_channels=False)
    clock = {(r.ant, r.time): 1e9 * r.val for r in out["clock000"].df.filter("weight > 0").collect()}
    slope = clock["RS001HBA", 10.0] - clock["RS001HBA", 2.0]
    assert abs(clock["RS001HBA", 5.0] - 251.0) < 8 and abs(clock["RS002HBA", 5.0] + 332.0) < 8 and slope == pytest.approx(1.6, abs=0.2)
    back = fits.clock_tec(x, flag_channels=False, reverse=True, invert_offset=True)
    a, b = ({r.ant: r.val for r in o["phase_offset000"].df.collect()} for o in (out, back))
    assert a["RS001HBA"] == pytest.approx(-b["RS001HBA"], abs=0.05)
