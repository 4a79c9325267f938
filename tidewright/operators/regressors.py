"""Regression backends in numpy (x: rows by features, y: rows by outputs), by name."""

from __future__ import annotations

import numpy as np

from .kernels import gaussian_process, ridge


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


class Linear:
    """Least squares with a squared penalty."""

    def __init__(self, lam: float = 0.0):
        self.lam = lam

    def fit(self, x, y):
        self.m, self.s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        self.c = ridge(_with_one((x - self.m) / self.s), y, self.lam + 1e-9)
        return self

    def predict(self, x):
        return _with_one((x - self.m) / self.s) @ self.c


class ElasticNet(Linear):
    """Absolute and squared penalties, by descent in one coordinate after another."""

    def __init__(self, lam: float = 0.1, share: float = 0.5, rounds: int = 50):
        self.lam, self.share, self.rounds = lam, share, rounds

    def fit(self, x, y):
        self.m, self.s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z, mean = (x - self.m) / self.s, y.mean(0)
        scale = np.where(y.std(0) > 0, y.std(0), 1.0)
        c, rest, n = np.zeros((x.shape[1], y.shape[1])), (y - mean) / scale, len(x)
        for _ in range(self.rounds):
            for j in range(x.shape[1]):
                g = z[:, j] @ rest / n + c[j]
                new = np.sign(g) * np.maximum(np.abs(g) - self.lam * self.share, 0) / (1 + self.lam * (1 - self.share))
                rest -= np.outer(z[:, j], new - c[j])
                c[j] = new
        self.c = np.vstack((c * scale, mean))
        return self


class Neighbours:
    def __init__(self, k: int = 5):
        self.k = k

    def fit(self, x, y):
        self.m, self.s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        self.x, self.y = (x - self.m) / self.s, y
        return self

    def predict(self, x):
        z = (x - self.m) / self.s
        d = (z**2).sum(1)[:, None] - 2 * z @ self.x.T + (self.x**2).sum(1)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        return self.y[near].mean(axis=1)


class Tree:
    """Cuts that lower the squared error most; `features` and `random` for the trees of forests."""

    def __init__(self, depth: int = 5, least: int = 4, features: float = 1.0, random: np.random.Generator | None = None, one_cut: bool = False):
        self.depth, self.least, self.features, self.random, self.one_cut = depth, least, features, random, one_cut

    def fit(self, x, y):
        self.root = self._grow(x, y, self.depth)
        return self

    def _grow(self, x, y, depth):
        if depth == 0 or len(y) < 2 * self.least or np.allclose(y, y[0]):
            return y.mean(0)
        names = np.arange(x.shape[1])
        if self.random is not None and self.features < 1:
            names = self.random.choice(names, max(1, int(len(names) * self.features)), replace=False)
        best = None
        for j in names:
            if self.one_cut:  # extremely random: one cut a feature
                lo, hi = x[:, j].min(), x[:, j].max()
                cuts = [self.random.uniform(lo, hi)] if hi > lo else []
                for c in cuts:
                    left = x[:, j] <= c
                    if min(left.sum(), (~left).sum()) >= self.least:
                        cost = ((y[left] - y[left].mean(0)) ** 2).sum() + ((y[~left] - y[~left].mean(0)) ** 2).sum()
                        if best is None or cost < best[0]:
                            best = (cost, j, c)
                continue
            order = np.argsort(x[:, j], kind="stable")
            v, s = x[order, j], np.cumsum(y[order], axis=0)
            n = np.arange(1, len(v))[:, None]
            gain = (s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(v) - n)).sum(1)
            ok = (v[:-1] < v[1:]) & (n[:, 0] >= self.least) & (len(v) - n[:, 0] >= self.least)
            if ok.any():
                i = int(np.where(ok, gain, -np.inf).argmax())
                if best is None or -gain[i] < best[0]:
                    best = (-gain[i], j, (v[i] + v[i + 1]) / 2)
        if best is None:
            return y.mean(0)
        _, j, c = best
        left = x[:, j] <= c
        return j, c, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x):
        def walk(node, rows):
            if isinstance(node, tuple):
                j, c, a, b = node
                left = x[rows, j] <= c
                walk(a, rows[left])
                walk(b, rows[~left])
            elif len(rows):
                out[rows] = node

        out = np.zeros((len(x), len(np.atleast_1d(self._leaf(self.root)))))
        walk(self.root, np.arange(len(x)))
        return out

    def _leaf(self, node):
        return self._leaf(node[2]) if isinstance(node, tuple) else node


class Forest:
    """Means of trees on samples of rows and features; `extra`: cuts at random, all rows."""

    def __init__(self, trees: int = 30, depth: int = 6, extra: bool = False, seed: int = 0):
        self.trees, self.depth, self.extra, self.seed = trees, depth, extra, seed

    def fit(self, x, y):
        r = np.random.default_rng(self.seed)
        self.all = []
        for _ in range(self.trees):
            rows = np.arange(len(x)) if self.extra else r.integers(0, len(x), len(x))
            self.all.append(Tree(self.depth, 2, 0.5, r, self.extra).fit(x[rows], y[rows]))
        return self

    def predict(self, x):
        return np.mean([t.predict(x) for t in self.all], axis=0)


class Boosting:
    """Small trees, each on what the ones before leave."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.1):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x, y):
        self.mean, self.all = y.mean(0), []
        rest = y - self.mean
        for _ in range(self.trees):
            t = Tree(self.depth).fit(x, rest)
            rest = rest - self.rate * t.predict(x)
            self.all.append(t)
        return self

    def predict(self, x):
        return self.mean + self.rate * sum(t.predict(x) for t in self.all)


class Network:
    """One hidden layer, trained by full gradients with momentum of both orders."""

    def __init__(self, hidden: int = 16, rounds: int = 200, rate: float = 0.02, seed: int = 0):
        self.hidden, self.rounds, self.rate, self.seed = hidden, rounds, rate, seed

    def fit(self, x, y):
        r = np.random.default_rng(self.seed)
        self.m, self.s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        self.ym, self.ys = y.mean(0), np.where(y.std(0) > 0, y.std(0), 1.0)
        z, t = (x - self.m) / self.s, (y - self.ym) / self.ys
        w = [r.normal(size=(z.shape[1], self.hidden)) / z.shape[1] ** 0.5, np.zeros(self.hidden), r.normal(size=(self.hidden, t.shape[1])) / self.hidden**0.5, np.zeros(t.shape[1])]
        a, b = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        for k in range(1, self.rounds + 1):
            h = np.tanh(z @ w[0] + w[1])
            e = (h @ w[2] + w[3] - t) / len(z)
            back = (e @ w[2].T) * (1 - h * h)
            for i, g in enumerate((z.T @ back, back.sum(0), h.T @ e, e.sum(0))):
                a[i], b[i] = 0.9 * a[i] + 0.1 * g, 0.999 * b[i] + 0.001 * g * g
                w[i] = w[i] - self.rate * (a[i] / (1 - 0.9**k)) / (np.sqrt(b[i] / (1 - 0.999**k)) + 1e-8)
        self.w = w
        return self

    def predict(self, x):
        return (np.tanh((x - self.m) / self.s @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]) * self.ys + self.ym


class Process:
    """A Gaussian process over at most `rows` of the last rows."""

    def __init__(self, kernel: str = "rbf", gamma: float = 0.1, noise: float = 0.1, rows: int = 600):
        self.kernel, self.gamma, self.noise, self.rows = kernel, gamma, noise, rows

    def fit(self, x, y):
        self.m, self.s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        self.ym, self.ys = y.mean(0), np.where(y.std(0) > 0, y.std(0), 1.0)
        self.x, self.y = ((x - self.m) / self.s)[-self.rows :], ((y - self.ym) / self.ys)[-self.rows :]
        return self

    def predict(self, x):
        return gaussian_process(self.x, self.y, (x - self.m) / self.s, self.gamma, self.noise, self.kernel)[0] * self.ys + self.ym


class Bayesian(Linear):
    """A matrix-normal prior on the coefficients and an inverse-Wishart one on the covariance."""

    def __init__(self, alpha: float = 1.0, mean: float = 0.0, scale: float = 1.0):
        self.alpha, self.mean, self.scale = alpha, mean, scale

    def fit(self, x, y):
        self.m, self.s = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        z = _with_one((x - self.m) / self.s)
        self.precision = z.T @ z + self.alpha * np.eye(z.shape[1])
        self.c = np.linalg.solve(self.precision, z.T @ y + self.alpha * self.mean)
        rest = y - z @ self.c
        self.cov = (self.scale * np.eye(y.shape[1]) + rest.T @ rest) / (len(x) + 1)
        return self

    def interval(self, x, z: float):
        rows = _with_one((x - self.m) / self.s)
        spread = 1 + (rows @ np.linalg.inv(self.precision) * rows).sum(1)
        return z * np.sqrt(spread[:, None] * np.diag(self.cov))


BACKENDS = {
    "LinearRegression": Linear, "Ridge": lambda **p: Linear(**{"lam": 1.0, **p}), "ElasticNet": ElasticNet, "KNN": Neighbours, "DecisionTree": Tree, "RandomForest": Forest,
    "ExtraTrees": lambda **p: Forest(extra=True, **p), "Boosting": Boosting, "MLP": Network, "GaussianProcess": Process, "BayesianRidge": Bayesian,
}


def regressor(name: str, **params):
    return BACKENDS[name](**params)
