import random

import numpy as np
import pytest

from solweave.operators import regular

SCHEMA = "id bigint, src string, t double, v double, t0 double, dt double, n int, slot string, val string"


def run(spark, rows, **kw):
    return regular.regular_series(spark.createDataFrame(rows, SCHEMA), ["src"], "t", "v", "t0", "dt", "n", row_id="id", **kw)


def brute(rows):
    """Mean of the finite values of each slot, by row id once."""
    seen, out, grids = set(), {}, {}
    for i, s, t, v, t0, dt, n, *_ in rows:
        if s is None or t is None or v is None or v != v or dt is None or (i is not None and i in seen):
            continue
        seen.add(i)
        grids[s] = n
        k = int(np.floor((t - t0) / dt))
        if 0 <= k < n:
            out.setdefault((s, k), []).append(v)
    return grids, {k: np.mean([x for x in v if np.isfinite(x)] or v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1024, 16])
def test_slots_and_means(spark, monkeypatch, block):
    monkeypatch.setattr(regular, "BLOCK", block)
    r = random.Random(1)
    rows = []
    for i in range(900):
        s = r.choice(["a", "a", "b", "c", None])
        n = {"a": 130, "b": 40, "c": 33, None: 9}[s]
        rows.append((i, s, r.uniform(-20, n * 2.5 + 20), r.choice([r.gauss(5, 1), float("nan"), None, float("inf") if r.random() < 0.05 else 1.0]), 0.0, 2.5, n, "x", "y"))
    rows += rows[:100] + [(5000, "far", -100.0, 1.0, 0.0, 2.5, 20, "x", "y"), (5001, "inf", 3.0, float("inf"), 0.0, 2.5, 4, "x", "y"), (5002, "bad", 3.0, 1.0, 0.0, 0.0, 4, "x", "y")]
    got = run(spark, rows).collect()
    grids, means = brute(rows[:-1])
    assert sorted((x.src, x.slot) for x in got) == sorted((s, k) for s, n in grids.items() for k in range(n))
    for x in got:
        if (x.src, x.slot) in means:
            assert x.state == "observed" and (x.val == pytest.approx(means[x.src, x.slot]) or x.val == means[x.src, x.slot])
        else:
            assert x.state == ("marked" if x.src in ("far", "inf") else x.state) != "observed"
            assert (x.val is None) == (x.state == "marked")
        assert x.time == pytest.approx(2.5 * x.slot)


def test_fill_follows_trend_and_season(spark):
    truth = lambda k: 3 + 0.02 * k + np.sin(2 * np.pi * (k + 0.5) / 200) + 0.5 * np.cos(4 * np.pi * (k + 0.5) / 200)
    gone = {*range(50, 80), 100, *range(150, 155)}
    rows = [(k, "s", k * 1.0 + 0.5, float(truth(k)), 0.0, 1.0, 200, "", "") for k in range(200) if k not in gone]
    got = {x.slot: x for x in run(spark, rows).collect()}
    assert {k for k, x in got.items() if x.state == "bridged"} == gone
    assert max(abs(got[k].val - truth(k)) for k in gone) < 0.05


def test_gap_is_bridged_between_its_endpoints(spark):
    rows = [(k, "s", k + 0.5, 10.0 if k < 20 else 20.0, 0.0, 1.0, 40, "", "") for k in range(40) if not 18 <= k < 22]
    got = {x.slot: x.val for x in run(spark, rows, harmonics=1).collect()}
    assert 9 < got[18] < got[19] < got[20] < got[21] < 21
    ends = {x.slot: x.state for x in run(spark, rows[5:30]).collect()}
    assert ends[0] == "extended" and ends[39] == "extended"


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, "s", k + 0.5, r.gauss(0, 1), 0.0, 1.0, 300, "", "") for k in range(300) if r.random() < 0.3 or k > 290]
    whole = {x.slot: x.val for x in run(spark, rows).collect()}
    monkeypatch.setattr(regular, "BLOCK", 8)
    cut = {x.slot: x.val for x in run(spark, rows).collect()}
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k], abs=1e-9) for k in whole)


def test_empty(spark):
    assert run(spark, []).collect() == []


def test_slot_boundaries(spark):
    from pyspark.sql import functions as F

    t0, dt = 4610000844.66, 10.0139
    times = [t0 + k * dt for k in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t double")
    got = df.select("k", regular.slot_of(F.col("t"), F.lit(t0), F.lit(dt)).alias("s")).collect()
    assert all(x.k == x.s for x in got)
