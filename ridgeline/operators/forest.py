"""A small random forest over binned features, trained in numpy on a bounded sample, with probabilities calibrated on out-of-bag rows."""

from __future__ import annotations

from functools import partial

import numpy as np

BINS = 64
#: Probability that is spread over all classes: a sample cannot tell what is rarer than this.
FLOOR = 0.02


class Forest:
    """Multi-class forest. fit() takes features with NaN for missing values (their own bin)."""

    def __init__(self, classes: int, trees: int = 30, depth: int = 10, least: float = 3.0, seed: int = 11):
        self.classes, self.trees, self.depth, self.least = classes, trees, depth, least
        self.seed, self.heat = seed, 1.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for k, cuts in enumerate(self.cuts):
            out[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(cuts, x[:, k], side="right") + 1)
        return out

    def _weights(self, n: int, k: int) -> tuple[np.ndarray, np.random.Generator]:
        """How often tree k sees each row, and its random numbers."""
        rng = np.random.default_rng([self.seed, k])
        return np.bincount(rng.integers(0, n, n), minlength=n).astype(float), rng

    def tree(self, b: np.ndarray, y: np.ndarray, k: int):
        """Tree k over binned rows; depends on nothing else."""
        return self._grow(b, y, *self._weights(len(y), k))

    def fit(self, x: np.ndarray, y: np.ndarray, each=lambda grow, n: [grow(k) for k in range(n)]) -> Forest:
        """Train; y: class numbers. each(grow, n) gives grow(0) to grow(n - 1) and may run them anywhere."""
        n, f = x.shape
        self.cuts = []
        for k in range(f):
            v = np.unique(x[~np.isnan(x[:, k]), k])
            if len(v) > BINS - 3:
                v = np.unique(np.quantile(x[~np.isnan(x[:, k]), k], np.linspace(0, 1, BINS - 2)))
            self.cuts.append((v[1:] + v[:-1]) / 2 if len(v) > 1 else np.zeros(0))
        b = self._bin(x)
        self.prior = (np.bincount(y, minlength=self.classes) + 0.1) / (n + 0.1 * self.classes)
        self.model, votes, seen = each(partial(self.tree, b, y), self.trees), np.zeros((n, self.classes)), np.zeros(n)
        for k, tree in enumerate(self.model):
            out = self._weights(n, k)[0] == 0
            votes[out] += self._leaf(tree, b[out])
            seen[out] += 1
        ok = seen > 0
        p = votes[ok] / seen[ok, None]
        best = np.inf
        for heat in np.geomspace(0.25, 4, 33):  # temperature with the least log loss on out-of-bag rows
            q = self._heated(p, heat)
            loss = -np.log(q[np.arange(len(q)), y[ok]]).mean() if len(q) else 0.0
            if loss < best - 1e-9:
                best, self.heat = loss, float(heat)
        self.oob = float((p.argmax(1) == y[ok]).mean()) if ok.any() else float("nan")
        return self

    def _heated(self, p: np.ndarray, heat: float) -> np.ndarray:
        q = np.maximum(p, 1e-4) ** (1 / heat)
        return (1 - FLOOR) * q / q.sum(1, keepdims=True) + FLOOR / self.classes

    def _grow(self, b: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator):
        f, c = b.shape[1], self.classes
        feature, cut, child, leaf = [], [], [], []
        stack = [(np.flatnonzero(w > 0), 0, -1, 0)]
        while stack:
            rows, level, parent, side = stack.pop()
            here = len(feature)
            if parent >= 0:
                child[parent][side] = here
            count = np.bincount(y[rows], weights=w[rows], minlength=c)
            feature.append(-1), cut.append(0), child.append([-1, -1])
            leaf.append((count + self.prior) / (count.sum() + 1))
            if level == self.depth or count.max() == count.sum() or count.sum() < 2 * self.least:
                continue
            best = (1e-9, -1, 0)
            gini = count.sum() - (count**2).sum() / count.sum()
            for k in rng.choice(f, max(3, f // 2), replace=False):
                h = np.bincount(b[rows, k].astype(np.int64) * c + y[rows], weights=w[rows], minlength=BINS * c).reshape(BINS, c).cumsum(0)
                left, right = h[:-1], count - h[:-1]
                nl, nr = left.sum(1), right.sum(1)
                gain = gini - (nl - (left**2).sum(1) / np.maximum(nl, 1e-9)) - (nr - (right**2).sum(1) / np.maximum(nr, 1e-9))
                gain[(nl < self.least) | (nr < self.least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], int(k), at)
            if best[1] >= 0:
                feature[here], cut[here] = best[1], best[2]
                go = b[rows, best[1]] <= best[2]
                stack += [(rows[go], level + 1, here, 0), (rows[~go], level + 1, here, 1)]
        return np.array(feature), np.array(cut), np.array(child), np.array(leaf)

    def _leaf(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, child, leaf = tree
        at = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            if not inner.any():
                break
            k = np.flatnonzero(inner)
            at[k] = child[at[k], (b[k, feature[at[k]]] > cut[at[k]]).astype(np.int64)]
        return leaf[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        b = self._bin(x)
        return self._heated(sum(self._leaf(t, b) for t in self.model) / len(self.model), self.heat)
