import random

import pytest

from solweave.llm.nearest import nearest_in_time

LEFT, RIGHT = "lid bigint, ant string, t double, bucket string", "rid bigint, ant string, t double, rt string"


def brute(left, right, tol):
    out = {}
    for i, a, t, _ in left:
        if i is None or a is None or t is None or t != t or abs(t) == float("inf"):
            continue
        best = min(((abs(t - u), j) for j, b, u, _ in right if j is not None and b == a and u is not None and u == u), default=None)
        out[i] = (best[1], best[0]) if best and best[0] <= tol else (None, None)
    return out


def run(spark, left, right, tol, start=None):
    got = nearest_in_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["ant"], "t", "t", "lid", "rid", tol, start).collect()
    assert len(got) == len({r.lid for r in got})
    return {r.lid: (r.rid, r.dist) for r in got}


@pytest.mark.parametrize("start", [None, 0.01, 50.0])
def test_against_brute_force(spark, start):
    r = random.Random(1)
    hot = lambda: "hot" if r.random() < 0.5 else r.choice(["a", "b", None])
    left = [(i, hot(), r.choice([round(r.uniform(0, 300), 2), r.uniform(-5, 300)]), "x") for i in range(600)]
    right = [(i, hot(), r.choice([round(r.uniform(0, 300), 2), r.uniform(0, 300)]), "y") for i in range(400)]
    left += [(1000, "a", None, "x"), (1001, "a", float("nan"), "x"), (None, "a", 5.0, "x"), (1002, "a", float("inf"), "x"), *left[:50]]
    right += [(1000, "a", None, "y"), (1001, "a", float("nan"), "y"), *right[:50], (2000, "hot", right[0][2], "y"), (None, "a", 1.0, "y")]
    assert run(spark, left, right, 4.0, start) == brute(left, right, 4.0)


def test_tolerance_counts_itself_and_ties_take_the_smaller_id(spark):
    left = [(1, "a", 100.0, ""), (2, "a", 200.0, ""), (3, "b", 0.0, "")]
    right = [(8, "a", 105.0, ""), (7, "a", 195.0, ""), (6, "a", 205.0, ""), (5, "b", 5.000001, "")]
    assert run(spark, left, right, 5.0) == {1: (8, 5.0), 2: (6, 5.0), 3: (None, None)}


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a", 1.0, "")], 5.0) == {}
    assert run(spark, [(1, "a", 1.0, "")], [], 5.0) == {1: (None, None)}


def test_many_rows_at_one_time(spark):
    left = [(i, "a", 10.0, "") for i in range(300)]
    right = [(i, "a", 10.5, "") for i in range(300)]
    assert set(run(spark, left, right, 5.0).values()) == {(0, 0.5)}
