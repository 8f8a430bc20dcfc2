"""Phase unwrapping kernels along a line and on a plane."""

from __future__ import annotations

import numpy as np


def unwrap_trend(phase: np.ndarray, window: int = 5) -> np.ndarray:
    """Unwrap along a line by prediction: each phase goes to the turn nearest to the line through the last ``window`` results.

    NaN stays, and is passed over. The first phase keeps its turn.
    """
    out = np.full(len(phase), np.nan)
    at, done = [], []
    for i, x in enumerate(phase):
        if np.isnan(x):
            continue
        guess = x if not done else done[-1] if len(done) == 1 else float(np.polyval(np.polyfit(at[-window:], done[-window:], 1), i))
        out[i] = x + 2 * np.pi * np.round((guess - x) / (2 * np.pi))
        at.append(i)
        done.append(out[i])
    return out


def cosine_matrix(n: int) -> np.ndarray:
    """The orthonormal cosine transform of the second kind as a matrix."""
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def fill_nearest(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Values of bad cells from the nearest good one (ties: the first in order)."""
    out = x.copy()
    good = np.argwhere(~bad)
    if len(good):
        for cell in np.argwhere(bad):
            out[tuple(cell)] = x[tuple(good[((good - cell) ** 2).sum(axis=1).argmin()])]
    return out


def unwrap_plane(phase: np.ndarray, flags: np.ndarray | None = None) -> np.ndarray:
    """Unwrap a plane: the smooth phase whose Laplacian is that of the wrapped one, by cosine transforms, then each cell to the nearest turn of it.

    Flagged cells take the nearest unflagged phase first. The mean turn is arbitrary.
    """
    if flags is not None and flags.any():
        phase = fill_nearest(phase, flags)
    a, b = (cosine_matrix(n) for n in phase.shape)
    p, q = (np.arange(n) for n in phase.shape)
    eigen = 2 * np.cos(np.pi * p / len(p))[:, None] + 2 * np.cos(np.pi * q / len(q))[None] - 4

    def laplace(x: np.ndarray) -> np.ndarray:
        return a.T @ ((a @ x @ b.T) * eigen) @ b

    rho = np.cos(phase) * laplace(np.sin(phase)) - np.sin(phase) * laplace(np.cos(phase))
    eigen_safe = eigen.copy()
    eigen_safe[0, 0] = 1.0
    spectrum = (a @ rho @ b.T) / eigen_safe
    spectrum[0, 0] = 0.0
    smooth = a.T @ spectrum @ b
    smooth += np.angle(np.exp(1j * (phase - smooth)).sum())
    return phase + 2 * np.pi * np.round((smooth - phase) / (2 * np.pi))
