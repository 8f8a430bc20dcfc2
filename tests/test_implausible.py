import random

import numpy as np
import pytest

from solweave.operators.implausible import flag_implausible

SCHEMA = "id bigint, ant string, t double, v double, w double, level string, spike int"
NAN = float("nan")


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {r.id: r for r in flag_implausible(df, ["ant"], "t", "v", "id", weight="w", **kw).collect()}


def series(name, n, level, scatter, first, seed=0):
    r = np.random.default_rng(seed)
    return [[first + i, name, float(i), float(level + 0.3 * scatter * np.sin(i / 9) + r.normal(0, scatter)), 1.0] for i in range(n)]


@pytest.mark.parametrize("block", [100_000, 60, 7])
def test_kinds_of_wrong_readings(spark, block):
    a, b = series("a", 200, 50, 0.5, 0, 1), series("b", 200, 4000, 90, 1000, 2)
    for i, (at, by) in enumerate([(20, 12), (21, 13), (80, -30), (81, -28), (82, -33), (150, 400)]):
        a[at][3] += by * (1 if i < 5 else 0.05)
    for at in range(100, 107):
        b[at][3] = b[100][3]
    for at in range(120, 125):
        b[at][3] = b[120][3]  # only five
    b[10][3], b[11][3], b[12][3] = -1.0, float("inf"), 0.0
    b[13][4], b[14][4], b[15][4], b[16][4] = 1.5, -0.1, None, NAN
    b[50][3], b[51][3] = None, NAN
    rows = a + b + a[:30] + [[3000, "c", 1.0, -5.0, 1.0], [3001, None, 2.0, 1.0, 2.0], [3002, "a", None, -1.0, 1.0], [3003, "a", None, 7777.0, 1.0]]
    random.Random(0).shuffle(rows)
    got = run(spark, rows, block=block)
    assert {i for i, r in got.items() if r.spike} == {20, 21, 80, 81, 82, 150}
    assert {i for i, r in got.items() if r.stuck} == set(range(1100, 1107))
    assert {i for i, r in got.items() if r.impossible} == {1010, 1011, 1012, 3000, 3002}
    assert {i for i, r in got.items() if r.bad_weight} == {1013, 1014, 3001}


def test_stuck_runs_skip_unknown_values_but_not_others(spark):
    v = [1.0, 2.0, 7.0, 7.0, None, 7.0, NAN, 7.0, 7.0, 7.0, 3.0, 7.0]
    got = run(spark, [[i, "a", float(i), x, 0.0] for i, x in enumerate(v)])
    assert {i for i, r in got.items() if r.stuck} == {2, 3, 5, 7, 8, 9}


def test_repeated_rows_make_no_run(spark):
    rows = [[i // 3, "a", float(i // 3), float(i // 3 % 5 + 1), 1.0] for i in range(60)]
    assert run(spark, rows) == {}


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows, want = [], set()
    for k in range(30):
        n, scatter = int(r.integers(25, 70)), 10 ** r.uniform(-2, 2)
        s = series(f"s{k}", n, scatter * r.uniform(30, 90), scatter, k * 1000, k)
        for at in r.choice(np.arange(1, n - 4, 9), 2, replace=False):
            for j in range(int(r.integers(1, 4))):
                s[at + j][3] += scatter * r.uniform(25, 60)
                want.add(s[at + j][0])
        rows += s
    assert {i for i, x in run(spark, rows).items() if x.spike} == want


def test_empty_and_short(spark):
    assert run(spark, []) == {}
    assert run(spark, [[i, "a", float(i), v, 1.0] for i, v in enumerate([1.0, 1.1, 900.0])]) == {}


def test_the_same_for_every_block_size(spark):
    r = np.random.default_rng(11)
    rows = []
    for k in range(3):
        s = series(f"s{k}", 90, 40.0, 1.0, k * 1000, 20 + k)
        for at in r.choice(90, 9, replace=False):
            s[at][3] = [None, NAN, -2.0, float("inf"), s[at][3] + 30, s[at][3] - 25, s[at][3] + 8][int(r.integers(0, 7))]
        for at in range(50, 50 + int(r.integers(4, 30))):
            s[at][3] = 41.5
        s[5][2] = s[6][2]
        s[70][4], s[71][2] = 3.0, None
        rows += s + s[::13]
    rows += [[None, "s0", 3.5, 40.0, 1.0], [None, "s0", 3.5, 40.0, 1.0], [None, "s0", 4.5, -40.0, 1.0]]
    key = lambda got: sorted(map(repr, (tuple(x) for x in got)))
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA)
    whole = key(flag_implausible(df, ["ant"], "t", "v", "id", weight="w").collect())
    assert len(whole) > 20
    for block in (200, 40, 9, 1):
        assert key(flag_implausible(df, ["ant"], "t", "v", "id", weight="w", block=block).collect()) == whole


def test_the_details_decide(spark):
    s = series("a", 60, 50, 0.5, 0, 3)
    for at, by in [(20, 9.0), (21, 9.0), (22, 9.0), (40, 7.0)]:
        s[at][3] += by
    found = lambda **kw: {i for i, r in run(spark, s, **kw).items() if r.spike}
    assert found() == {20, 21, 22, 40}
    assert found(detail=1e9) != found()  # nothing is left out of the smooth part, which follows the spikes
    assert found(spike=30.0) == set()
