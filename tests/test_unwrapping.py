import numpy as np

from solweave.functions.unwrapping import cosine_matrix, fill_nearest, unwrap_plane, unwrap_trend

wrap = lambda x: np.mod(x + np.pi, 2 * np.pi) - np.pi


def test_line():
    t = np.arange(200)
    truth = 0.002 * t**2 + 0.3 * np.sin(t / 7)
    x = wrap(truth)
    x[50:55] = np.nan
    got = unwrap_trend(x)
    ok = ~np.isnan(x)
    assert np.isnan(got[~ok]).all() and np.allclose(got[ok] - truth[ok], got[0] - truth[0])


def test_plane():
    y, x = np.mgrid[:30, :40]
    truth = 0.15 * x + 0.1 * y + 0.004 * x * y
    flags = np.zeros(truth.shape, dtype=bool)
    flags[10, 10] = flags[20, 5] = True
    seen = wrap(truth)
    seen[flags] = 0
    d = (unwrap_plane(seen, flags) - truth)[~flags]
    assert np.allclose(d, np.median(d), atol=1e-6)


def test_transform_is_orthonormal_and_nearest_fill():
    m = cosine_matrix(9)
    assert np.allclose(m @ m.T, np.eye(9))
    x, bad = np.array([[1.0, 2], [3, 4]]), np.array([[True, False], [False, False]])
    assert fill_nearest(x, bad)[0, 0] == 2
