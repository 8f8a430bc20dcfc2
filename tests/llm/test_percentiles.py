import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from solweave.llm.percentiles import digit_histogram, from_ordered, histogram_percentiles, keyed_values, merge_histograms, radix_percentiles, to_ordered

SCHEMA = "id bigint, part string, g string, q string, v double, hi double"


def expected(values, p):
    s = sorted(values)
    return s[max(1, math.ceil(p * len(s))) - 1]


@given(st.lists(st.floats(allow_nan=False), min_size=2))
@settings(max_examples=200, deadline=None)
def test_ordered_keys_keep_the_order_and_come_back(xs):
    x = np.array(xs)
    k = to_ordered(x)
    assert (from_ordered(k) == x).all()
    assert (np.argsort(k, kind="stable") == np.argsort(x + 0.0, kind="stable")).all()


def rows():
    r = random.Random(4)
    out = []
    for i in range(3000):
        g = ["a", "b", None][i % 3]
        v = [r.gauss(0, 10 ** r.randint(-5, 9)), 7.25, None, float("nan"), float("inf"), -float("inf"), -0.0][i % 7 if i % 2 else 0]
        out.append((i, f"d{i % 4}", g, "clash", v, 1.0))
    return out + out[:500]  # delivered twice


def groups(data):
    seen, out = set(), {}
    for i, _, g, _, v, _ in data:
        if i not in seen and v is not None and not math.isnan(v):
            seen.add(i)
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("digit_bits", [8, 16])
def test_percentiles_are_elements_of_the_data(spark, digit_bits):
    data, probs = rows(), [0.0, 0.01, 0.5, 0.9, 1.0]
    got = radix_percentiles(spark.createDataFrame(data, SCHEMA), ["g"], "v", probs, "id", digit_bits=digit_bits).collect()
    want = {(g, p): (expected(v, p), len(v)) for g, v in groups(data).items() for p in probs}
    assert {(r.g, r.q): (r.value, r.n) for r in got} == want


@pytest.mark.parametrize("bits", [32, 20, 16])
def test_merged_histograms_bound_the_percentiles(spark, bits):
    data, probs = rows(), [0.05, 0.5, 0.95]
    df = spark.createDataFrame(data, SCHEMA)
    parts = digit_histogram(keyed_values(df, ["part", "g"], "v", "id"), ["part", "g"], bits)
    got = histogram_percentiles(merge_histograms(parts, ["g"]), ["g"], probs, bits).collect()
    want = groups(data)
    assert len(got) == 9
    for r in got:
        x = expected(want[r.g], r.q)
        assert r.lo <= x <= r.hi and r.n == len(want[r.g])
        assert math.isinf(x) or r.hi - r.lo <= abs(x) * 2.0 ** (12 - bits) + 1e-300


def test_empty_and_all_null(spark):
    assert radix_percentiles(spark.createDataFrame([], SCHEMA), ["g"], "v", [0.5], "id").collect() == []
    nulls = spark.createDataFrame([(1, "d", "a", "q", None, 0.0)], SCHEMA)
    assert radix_percentiles(nulls, ["g"], "v", [0.5]).collect() == []


def test_rows_without_an_id_all_count(spark):
    df = spark.createDataFrame([(None, "d", "a", "q", 1.0, 0.0), (None, "d", "a", "q", 1.0, 0.0), (1, "d", "a", "q", 5.0, 0.0)], SCHEMA)
    assert [(r.n, r.value) for r in radix_percentiles(df, ["g"], "v", [0.5], "id").collect()] == [(3, 1.0)]


def test_bad_parameters(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        radix_percentiles(df, ["g"], "v", [1.5])
    with pytest.raises(ValueError):
        radix_percentiles(df, ["g"], "v", [0.5], bits=30)
