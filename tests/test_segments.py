import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from solweave.functions import segments as S


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=60), st.lists(st.integers(1, 7), min_size=1, max_size=20), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_groups_come_whole_however_batches_are_cut(rows, cuts, size):
    rows.sort()
    table = pa.table({"a": pa.array([r[0] or None for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64()), "i": pa.array(range(len(rows)), pa.int64())})
    batches, at = [], 0
    while at < len(rows):
        n = cuts[len(batches) % len(cuts)]
        batches += table.slice(at, n).to_batches()
        at += n
    seen, got = [], []

    def work(t, seg):
        keys = list(zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True))
        assert len(seg) == len(keys) and all((keys[j] == keys[j - 1]) == (seg[j] == seg[j - 1]) for j in range(1, len(keys)))
        seen.extend(dict.fromkeys(keys))
        got.extend(t["i"].to_pylist())
        yield pa.RecordBatch.from_arrays([], names=[])

    list(S.whole_groups(iter(batches), ["a", "b"], work, rows=size))
    assert got == list(range(len(rows))) and len(seen) == len(set(seen))


@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.just(float("nan")), st.floats(-100, 100))), max_size=60), st.integers(0, 4), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_medians_and_runs(rows, back, ahead):
    rows.sort(key=lambda r: r[0])
    seg = np.unique([r[0] for r in rows], return_inverse=True)[1] if rows else np.zeros(0, dtype=int)
    x = np.array([r[1] for r in rows], dtype=float)
    n = int(seg[-1]) + 1 if len(seg) else 0
    part = [x[seg == k] for k in range(n)]
    med = lambda v: np.median(v[~np.isnan(v)]) if (~np.isnan(v)).any() else np.nan
    np.testing.assert_allclose(S.medians(x, seg, n), [med(v) for v in part])
    np.testing.assert_allclose(S.running_median(x, seg, back, ahead=ahead), [med(v[max(0, i - back) : i + ahead + 1]) for v in part for i in range(len(v))])
    runs = S.run_lengths(x, seg)
    for k in range(n):
        v, r = part[k], runs[seg == k]
        for i in range(len(v)):
            a = b = i
            while a > 0 and v[a - 1] == v[a]:
                a -= 1
            while b + 1 < len(v) and v[b + 1] == v[b]:
                b += 1
            assert r[i] == b - a + 1


def test_spline_smooths_average_what_counts():
    rng = np.random.default_rng(0)
    seg = np.repeat([0, 1, 2], [40, 3, 17])
    x, counts = rng.normal(size=60), rng.random(60) < 0.8
    smooth = S.spline_smooths(x, counts, seg, 3)
    assert np.nanstd(smooth[-1][:40]) < np.std(x[:40])
    for s in S.spline_smooths(np.where(seg == 1, 5.0, 2.0), counts, seg, 3):
        np.testing.assert_allclose(s[~np.isnan(s)], np.where(seg == 1, 5.0, 2.0)[~np.isnan(s)])
    # A value depends on the places within reach alone.
    r = S.reach(3)
    np.testing.assert_array_equal(S.spline_smooths(x[: 20 + r], counts[: 20 + r], seg[: 20 + r], 3)[-1][:20], smooth[-1][:20])


