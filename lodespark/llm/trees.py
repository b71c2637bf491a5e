"""Small gradient-boosted trees for the logistic loss, over binned columns (numpy only; for bounded samples)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A split (goes left where x <= threshold), or a leaf with a value."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        go = x[:, self.feature] <= self.threshold
        out = np.empty(len(x))
        out[go], out[~go] = self.left.predict(x[go]), self.right.predict(x[~go])
        return out

    def paths(self, before: tuple = ()) -> list[tuple]:
        """Conjunctions of (feature, is_below, threshold) that lead to each node but the root."""
        own = [before] if before else []
        if self.feature < 0:
            return own
        return own + self.left.paths((*before, (self.feature, True, self.threshold))) + self.right.paths((*before, (self.feature, False, self.threshold)))


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each column: midpoints between neighbouring distinct quantiles."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _grow(code, rows, g, h, cut, depth, least, l2) -> Node:
    node = Node(-g[rows].sum() / (h[rows].sum() + l2))
    if not depth or len(rows) < 2 * least:
        return node
    best, base = (1e-6, -1, -1), g[rows].sum() ** 2 / (h[rows].sum() + l2)
    for f, own in enumerate(cut):
        if not len(own):
            continue
        c = code[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(c, weights=w, minlength=len(own) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + l2) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + l2) - base
        gain[(ns < least) | (len(rows) - ns < least)] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return node
    _, f, k = best
    go = code[rows, f] <= k
    node.feature, node.threshold = f, float(cut[f][k])
    node.left = _grow(code, rows[go], g, h, cut, depth - 1, least, l2)
    node.right = _grow(code, rows[~go], g, h, cut, depth - 1, least, l2)
    return node


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 8, share: float = 0.7, seed: int = 7) -> tuple[float, list[Node]]:
    """(first log-odds, trees whose predictions times `rate` add to it). Each tree sees a random share of the rows."""
    w = np.ones(len(y)) if weight is None else weight
    p = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    if not len(y) or len(np.unique(y)) < 2:
        return start, []
    rng, cut = np.random.default_rng(seed), edges(x, bins)
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cut, x.T, strict=True)], 1)
    f, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(len(y)) < share)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        tree = _grow(code, rows, w * (p - y), w * np.maximum(p * (1 - p), 1e-6), cut, depth, least, 1.0)
        out.append(tree)
        f += rate * tree.predict(x)
    return start, out


def log_odds(model: tuple[float, list[Node]], x: np.ndarray, rate: float = 0.3) -> np.ndarray:
    start, found = model
    return start + rate * sum((t.predict(x) for t in found), np.zeros(len(x)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient; columns of x are 0/1."""
    n, d = x.shape
    x = x.astype(np.float64)
    b, w = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), np.zeros(d)
    top = np.ones(d) / np.sqrt(max(d, 1))
    for _ in range(20):  # largest eigenvalue of x'x / n
        v = x.T @ (x @ top) / n
        size = np.linalg.norm(v)
        top = v / size if size else top
    step = 1 / (0.25 * (size + 1) + 1e-9)
    zb, zw, t = b, w.copy(), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(zb + x @ zw))) - y
        nb, nw = zb - step * r.mean(), zw - step * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zb, zw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w
