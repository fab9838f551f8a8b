"""Small linear models for sparse 0/1 features, fitted in numpy on a bounded sample.

Rows are sorted arrays of distinct feature numbers.  Only the arithmetic of one model lives
here; drawing the sample, making features and scoring the corpus are Spark jobs.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def document_counts(rows: list[np.ndarray], mask: np.ndarray, dim: int) -> np.ndarray:
    """How many of the masked rows have each feature."""
    chosen = [r for r, m in zip(rows, mask) if m]
    return np.bincount(np.concatenate(chosen), minlength=dim) if chosen else np.zeros(dim, np.int64)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, dim: int, alpha: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed and normalised feature counts, positive over negative."""
    p = document_counts(rows, y == 1, dim) + alpha
    q = document_counts(rows, y != 1, dim) + alpha
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge_dual(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7):
    """L2-regularised hinge loss by dual coordinate descent; feature f of a row has the value
    scale[f] and a constant 1 stands for the bias.  Returns weights (already times scale), bias."""
    sign = np.where(y == 1, 1.0, -1.0)
    rate = np.where(y == 1, 1.0 / max(1, (y == 1).sum()), 1.0 / max(1, (y != 1).sum()))
    upper = c * rate / rate.mean()  # both classes weigh the same
    w, b, a = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([1.0 + (scale[r] ** 2).sum() for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, s = rows[i], sign[i]
            v = scale[r]
            g = s * (w[r] @ v + b) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), upper[i])
            d = new - a[i]
            if d:
                w[r] += d * s * v
                b += d * s
                a[i] = new
                worst = max(worst, abs(d))
        if worst < 1e-4:
            break
    return w * scale, b


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 60):
    """Slope and offset of the sigmoid that turns margins into probabilities (smoothed targets)."""
    pos, neg = float((y == 1).sum()), float((y != 1).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, np.log((pos + 1) / (neg + 1))
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return float(a), float(b)


def telling(rows: list[np.ndarray], y: np.ndarray, dim: int, least: float = 4.5, most: int = 4096) -> np.ndarray:
    """The features whose shares in the two classes differ by ``least`` standard errors, sorted."""
    pos, neg = document_counts(rows, y == 1, dim), document_counts(rows, y != 1, dim)
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y != 1).sum()))
    share = (pos + neg) / (n1 + n0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    z = np.where(pos + neg >= 3, np.abs(pos / n1 - neg / n0) / error, 0)
    kept = np.flatnonzero(z >= least)
    return np.sort(kept[np.argsort(-z[kept], kind="stable")[:most]])


def logistic(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, dim: int, steps: int = 150, rate: float = 0.15, penalty: float = 0.02):
    """Logistic regression by Adam on the whole sample, over the telling features and the dense
    columns of ``extra``.  Returns weights by feature, weights of the dense columns, bias."""
    n, kept = len(rows), telling(rows, y, dim)
    place = np.full(dim, -1, np.int64)
    place[kept] = np.arange(len(kept))
    col = place[np.concatenate(rows)] if n else kept
    row = np.repeat(np.arange(n), [len(r) for r in rows])[col >= 0]
    col = col[col >= 0]
    k, m = len(kept), extra.shape[1]
    x = np.zeros(k + m + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    x[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        d = sigmoid(np.bincount(row, x[col], n) + extra @ x[k : k + m] + x[-1]) - y
        g = np.concatenate((np.bincount(col, d[row], k), d @ extra, [d.sum()])) + penalty * np.append(x[:-1], 0)
        g /= n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    w = np.zeros(dim)
    w[kept] = x[:k]
    return w, x[k : k + m], float(x[-1])
