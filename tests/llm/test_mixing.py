import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from solweave.llm.mixing import Schedule, mix, ramp

DOCS, TARGETS = "id bigint, source string, size bigint, k string, use int", "source string, target_share double, max_uses int"


def build(spark, docs, targets, **kw):
    return mix(spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS), "id", "source", "size", spark.createDataFrame(targets, TARGETS), **kw)


def test_schedule_inverts_its_integral():
    s = Schedule([(0, 0.0), (0.3, 2.0), (0.5, 2.0), (1, 0.1)])
    t = np.linspace(0, 1, 2001)
    m = np.interp(t, s.t, s.m)
    total = np.r_[0, np.cumsum((m[1:] + m[:-1]) / 2 * np.diff(t))]
    assert abs(total[-1] - 1) < 1e-6
    assert np.abs(s.invert(total) - t).max() < 2e-3
    assert Schedule([(0, 1), (1, 1)]).invert(np.array([0.25]))[0] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        Schedule([(0, 1), (0.5, 1)])


def test_ramp_keeps_the_sum_of_weights():
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    r = ramp(shares)
    for end in (0, 1):
        assert sum(shares[k] * r[k][end][1] for k in shares) == pytest.approx(1)


def test_shares_uses_and_positions(spark):
    r = random.Random(3)
    docs = [(i, r.choice(["Big", "big ", " BIG"]), r.randint(0, 50)) for i in range(3000)]
    docs += [(10_000 + i, "small", r.randint(1, 50)) for i in range(300)]
    docs += [(20_000 + i, "tiny", 10) for i in range(20)]
    docs += [(30_000, None, 10), (30_001, "other", 10), (30_002, "big", None), (None, "big", 5)]
    targets = [("Big", 0.6, 1), ("small", 0.3, 5), ("tiny", 0.1, 3), ("absent", 0.0, 1)]
    drawn, report = build(spark, docs, targets, cuts=16)
    rows, rep = drawn.collect(), {r.source: r for r in report.collect()}
    size = Counter()
    for i, s, n in docs:
        if i is not None and s and n is not None:
            size[s.strip().lower()] += n
    whole = size["big"] + size["small"] + size["tiny"]
    per = defaultdict(Counter)
    for x in rows:
        per[x.source][x.id] += 1
    for name, share, most in targets[:3]:
        mine = rep[name]
        assert mine.size == size[name.lower()] and mine.demand == pytest.approx(share * whole)
        assert sum(x.size for x in rows if x.source == name) == mine.drawn
        assert max(per[name].values(), default=0) <= most
        assert mine.short == (most * mine.size < share * whole)
        if not mine.short:
            assert 0 <= mine.drawn - mine.demand < 51
        else:
            assert mine.drawn == most * mine.size
    assert rep["tiny"].short and not rep["Big"].short and not rep["absent"].short
    assert sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    # Files hold successive ranges of positions, each in order.
    files = defaultdict(list)
    for x in drawn.select("position", F.input_file_name().alias("f")).collect():
        files[x.f].append(x.position)
    pos = [p for f in sorted(files) for p in files[f]]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= whole
    assert rep["Big"].first == min(x.position for x in rows if x.source == "Big") and rep["absent"].last is None
    # The large source weighs more in the first half than in the second, the small one less.
    half = lambda s: sum(x.size for x in rows if x.source == s and x.position < whole / 2)
    assert half("Big") > 0.53 * rep["Big"].drawn and half("small") < 0.47 * rep["small"].drawn


def test_empty_documents_and_bad_targets(spark):
    drawn, report = build(spark, [], [("a", 1.0, 2)])
    assert drawn.collect() == [] and [r.drawn for r in report.collect()] == [0]
    with pytest.raises(ValueError):
        build(spark, [(1, "a", 5)], [("a", 0.5, 1), (" A", 0.5, 1)])
