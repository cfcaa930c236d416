"""FTRL-proximal logistic regression: per-coordinate rates, L1 sparsity; binary features.

``fit`` sees one row after the other, each a sorted array of distinct feature numbers below ``dims``; ``fit_pieces`` takes them a
piece at a time, so that a training set needs the memory of one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: (rows, their labels, what each row's loss counts)
Piece = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def fit(rows: list[np.ndarray], labels: np.ndarray, dims: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, passes: int = 3, seed: int = 5, weight: np.ndarray | None = None) -> np.ndarray:
    """``fit_pieces`` of one piece, held in memory."""
    whole = (rows, labels, np.ones(len(rows)) if weight is None else weight)
    return fit_pieces([lambda: whole], dims, alpha, beta, l1, l2, passes, seed)


def fit_pieces(pieces: Sequence[Callable[[], Piece]], dims: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, passes: int = 3, seed: int = 5) -> np.ndarray:
    """Weights (float32), most of them zero; the last is the bias, which has no L1. Each pass takes the pieces in a drawn order,
    and the rows of each in a drawn order."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    bias = np.array([dims])
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        for k in draw.permutation(len(pieces)) if len(pieces) > 1 else range(len(pieces)):
            rows, labels, weight = pieces[k]()
            for i in draw.permutation(len(rows)):
                x = np.concatenate([rows[i], bias])
                limit = np.where(x == dims, 0.0, l1)
                zx, nx = z[x], n[x]
                wx = np.where(np.abs(zx) <= limit, 0.0, (np.sign(zx) * limit - zx) / ((beta + np.sqrt(nx)) / alpha + l2))
                g = (1 / (1 + np.exp(-np.clip(wx.sum(), -35, 35))) - labels[i]) * weight[i]
                z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * wx
                n[x] = nx + g * g
            del rows, labels, weight  # before the next piece is read
    limit, out = np.full(dims + 1, l1), np.zeros(dims + 1, np.float32)
    limit[dims] = 0
    some = np.flatnonzero(np.abs(z) > limit)
    out[some] = (np.sign(z[some]) * limit[some] - z[some]) / ((beta + np.sqrt(n[some])) / alpha + l2)
    return out
