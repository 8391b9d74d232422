"""Gated recurrent networks in NumPy: forecasts of an asset's next direction or return from its last rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Gru:
    """Layers of gated recurrent units and a linear head on the last state, with dropout ahead of each layer but the first
    and of the head. Parameters are a flat list of arrays: for each layer input, state, and two bias arrays, then the head's."""

    def __init__(self, inputs: int, hidden: int = 64, layers: int = 2, dropout: float = 0.2, seed: int = 42):
        self.hidden, self.layers, self.dropout = hidden, layers, dropout
        self.rng = np.random.default_rng(seed)
        scale = 1 / hidden**0.5
        draw = lambda *shape: self.rng.uniform(-scale, scale, shape)
        self.p: list[np.ndarray] = []
        for k in range(layers):
            self.p += [draw(inputs if k == 0 else hidden, 3 * hidden), draw(hidden, 3 * hidden), draw(3 * hidden), draw(3 * hidden)]
        self.p += [draw(hidden, 1), draw(1)]

    def masks(self, rows: int, steps: int) -> list[np.ndarray]:
        keep = lambda *shape: (self.rng.random(shape) >= self.dropout) / (1 - self.dropout)
        return [keep(rows, steps, self.hidden) for _ in range(self.layers - 1)] + [keep(rows, self.hidden)]

    def forward(self, x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list]:
        """Outputs for x (rows, steps, inputs), and what backward() needs."""
        m, kept, at = self.hidden, [], x
        for k in range(self.layers):
            w, u, b, c = self.p[4 * k : 4 * k + 4]
            if k and masks:
                at = at * masks[k - 1]
            h = np.zeros((len(x), m))
            steps, states = [], []
            for t in range(x.shape[1]):
                a, s = at[:, t] @ w + b, h @ u + c
                z, r = sigmoid(a[:, :m] + s[:, :m]), sigmoid(a[:, m : 2 * m] + s[:, m : 2 * m])
                n = np.tanh(a[:, 2 * m :] + r * s[:, 2 * m :])
                steps.append((h, z, r, n, s[:, 2 * m :]))
                h = (1 - z) * n + z * h
                states.append(h)
            kept.append((at, steps))
            at = np.stack(states, axis=1)
        last = at[:, -1] * masks[-1] if masks else at[:, -1]
        return (last @ self.p[-2] + self.p[-1])[:, 0], [kept, last]

    def backward(self, kept: list, masks: list[np.ndarray] | None, g: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, from the gradient g of the outputs, back through time and layers."""
        layers, last = kept
        m, out = self.hidden, [np.zeros_like(p) for p in self.p]
        out[-2], out[-1] = last.T @ g[:, None], np.array([g.sum()])
        back = g[:, None] @ self.p[-2].T
        back = back * masks[-1] if masks else back
        above = None
        for k in range(self.layers - 1, -1, -1):
            w, u = self.p[4 * k], self.p[4 * k + 1]
            at, steps = layers[k]
            below = np.zeros_like(at)
            dh = back if above is None else np.zeros_like(back)
            for t in range(at.shape[1] - 1, -1, -1):
                if above is not None:
                    dh = dh + above[:, t]
                h, z, r, n, sn = steps[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * sn * r * (1 - r)
                da, ds = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
                out[4 * k] += at[:, t].T @ da
                out[4 * k + 1] += h.T @ ds
                out[4 * k + 2] += da.sum(0)
                out[4 * k + 3] += ds.sum(0)
                below[:, t] = da @ w.T
                dh = dh * z + ds @ u.T
            above = below * masks[k - 1] if k and masks else below
        return out

    @staticmethod
    def loss(z: np.ndarray, y: np.ndarray, classes: bool) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient: log loss of y in {0, 1}, or squared error."""
        if classes:
            p = sigmoid(z)
            return float(-(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean()), (p - y) / len(y)
        return float(((z - y) ** 2).mean()), 2 * (z - y) / len(y)

    def fit(self, x: np.ndarray, y: np.ndarray, classes: bool, epochs: int = 30, patience: int = 5, batch: int = 64, rate: float = 1e-3, held: float = 0.2) -> Gru:
        """Adam on shuffled batches of the first rows; stops when the loss on the last ones has not fallen for `patience` epochs."""
        cut = max(1, int(len(x) * (1 - held)))
        first, second, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        best, wait = (np.inf, [p.copy() for p in self.p]), 0
        for _ in range(epochs):
            order = self.rng.permutation(cut)
            for at in range(0, cut, batch):
                rows = order[at : at + batch]
                masks = self.masks(len(rows), x.shape[1])
                z, kept = self.forward(x[rows], masks)
                step += 1
                for i, g in enumerate(self.backward(kept, masks, self.loss(z, y[rows], classes)[1])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            at = slice(cut, None) if cut < len(x) else slice(None)
            now = self.loss(self.forward(x[at])[0], y[at], classes)[0]
            if now < best[0]:
                best, wait = (now, [p.copy() for p in self.p]), 0
            elif (wait := wait + 1) >= patience:
                break
        self.p = best[1]
        return self

    def sample(self, x: np.ndarray, passes: int = 50) -> np.ndarray:
        """Outputs of several passes with dropout on: (passes, rows)."""
        return np.stack([self.forward(x, self.masks(len(x), x.shape[1]))[0] for _ in range(passes)])


def recurrent_forecast(df: DataFrame, names: list[str], target: str, classes: bool, steps: int = 20, train_share: float = 0.7, hidden: int = 64, layers: int = 2, epochs: int = 30, passes: int = 50, seed: int = 42) -> DataFrame:
    """(asset, timestamp, pred, spread) of each asset's last rows by a network fitted to its first.

    A row is forecast from itself and the steps - 1 rows before it. classes: target in {1, -1}; pred is 1 or -1 and spread the
    confidence, the mean probability of the side over the dropout passes. Else pred and spread are mean and deviation of the
    passes. Inputs are scaled by the training rows. One kernel per asset; an asset with too few rows gives none.
    """
    kind = df.schema["timestamp"].dataType.simpleString()
    columns = ["asset", "timestamp", "pred", "spread"]

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("timestamp", kind="stable").dropna()
        cut = int(len(g) * train_share)
        if cut < steps + 10 or cut >= len(g):
            return pd.DataFrame(columns=columns)
        v, y = g[names].to_numpy(float), g[target].to_numpy(float)
        mean, dev = v[:cut].mean(0), v[:cut].std(0)
        v = (v - mean) / np.where(dev > 0, dev, 1.0)
        x = np.lib.stride_tricks.sliding_window_view(v, steps, axis=0).transpose(0, 2, 1)
        end = np.arange(steps - 1, len(g))
        middle, scale = (0.0, 1.0) if classes else (y[:cut].mean(), y[:cut].std() or 1.0)
        goal = (y > 0).astype(float) if classes else (y - middle) / scale
        train = end < cut
        net = Gru(len(names), hidden, layers, seed=seed).fit(x[train], goal[end[train]], classes, epochs)
        draws = net.sample(x[~train], passes)
        if classes:
            p = sigmoid(draws).mean(0)
            pred, spread = np.where(p >= 0.5, 1.0, -1.0), np.maximum(p, 1 - p)
        else:
            pred, spread = draws.mean(0) * scale + middle, draws.std(0) * scale
        return pd.DataFrame({"asset": key[0], "timestamp": g["timestamp"].to_numpy()[end[~train]], "pred": pred, "spread": spread})[columns]

    slim = df.select("asset", "timestamp", *names, target)
    return slim.groupBy("asset").applyInPandas(one, f"asset string, timestamp {kind}, pred double, spread double")
