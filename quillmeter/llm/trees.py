"""Gradient-boosted trees in numpy, with monotonic constraints, scored as flat arrays."""

from __future__ import annotations

import numpy as np

BINS, DEPTH, TREES, RATE, LEAST_LEAF, RIDGE = 64, 4, 60, 0.2, 20, 1.0


class Forest:
    """Complete binary trees of one depth; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, bias: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.bias, self.feature, self.cut, self.value = bias, feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        if not trees:
            return np.full(n, self.bias)
        depth = int(np.log2(self.value.shape[1]))
        node = np.zeros((n, trees), np.int64)
        tree = np.arange(trees)
        row = np.arange(n)[:, None]
        for _ in range(depth):
            f = self.feature[tree, node]
            node = 2 * node + 1 + (x[row, f] > self.cut[tree, node])
        return self.bias + self.value[tree, node - (self.value.shape[1] - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = TREES) -> Forest:
    """Logistic boosting.  sign[f] = -1: the score never rises with feature f; 1: never falls; 0: free."""
    n, width = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    none = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves))
    if not n or y.min() == y.max():
        return Forest(float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0, *none)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    z = np.full(n, bias)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        where = np.zeros(n, np.int64)
        rows: dict[int, np.ndarray] = {0: np.arange(n)}
        for node in range(inner):
            own = rows.pop(node)
            left, right = 2 * node + 1, 2 * node + 2
            low[[left, right]], high[[left, right]] = low[node], high[node]
            best = (1e-9, -1, -1, 0.0, 0.0)
            if len(own) >= 2 * LEAST_LEAF:
                gs, hs = g[own].sum(), h[own].sum()
                for f in range(width):
                    b = binned[own, f]
                    k = len(edges[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[own], h[own], None))
                    ok = (nl >= LEAST_LEAF) & (len(own) - nl >= LEAST_LEAF)
                    vl, vr = (np.clip(a / (c + RIDGE), low[node], high[node]) for a, c in ((gl, hl), (gs - gl, hs - hl)))
                    if sign[f]:
                        ok &= sign[f] * (vr - vl) >= 0
                    if not ok.any():
                        continue
                    gain = np.where(ok, gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE), -1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (float(gain[at]), f, at, float(vl[at]), float(vr[at]))
            _, f, at, vl, vr = best
            if f < 0:
                rows[left], rows[right] = own, own[:0]
                continue
            feature[node], cut[node] = f, edges[f][at]
            if sign[f]:
                mid = (vl + vr) / 2
                upper, lower = (right, left) if sign[f] > 0 else (left, right)
                low[upper], high[lower] = max(low[upper], mid), min(high[lower], mid)
            goes = binned[own, f] > at
            rows[left], rows[right] = own[~goes], own[goes]
        value = np.zeros(leaves)
        for k in range(leaves):
            own = rows[inner + k]
            if len(own):
                value[k] = RATE * np.clip(g[own].sum() / (h[own].sum() + RIDGE), low[inner + k], high[inner + k])
                where[own] = k
        z = z + value[where]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(bias, np.array(features), np.array(cuts), np.array(values))
