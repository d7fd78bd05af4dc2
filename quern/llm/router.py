"""A learned partitioning of unit vectors: graph partition of a sample, and a classifier that routes to its parts.

Each level is fitted on a bounded sample of rows; used on every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Level:
    """A softmax classifier: logits of a vector over the parts are ``v @ weights + bias``."""

    weights: np.ndarray
    bias: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.bias)

    def log_probabilities(self, v: np.ndarray) -> np.ndarray:
        z = v @ self.weights + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def largest(z: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest entries of each row, largest first; of equal ones the first."""
    if n >= z.shape[1]:
        return np.argsort(-z, 1, kind="stable")
    top = np.sort(np.argpartition(-z, n - 1, 1)[:, :n], 1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), 1, kind="stable"), 1)


class Router:
    """Routes vectors to parts by one classifier, or by two: ``top`` finds coarse parts, ``fine[c]`` the parts of coarse part c.

    A part's probability is that of its coarse part times its own within it. A vector's home is the most probable part
    of its most probable coarse part.
    """

    def __init__(self, top: Level, fine: dict[int, Level] | None = None, probes: int = 1):
        self.top, self.fine, self.probes = top, fine or {}, probes
        inner = [self.fine[c].parts if c in self.fine else 1 for c in range(top.parts)]
        self.first = np.r_[0, np.cumsum(inner)]

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    def _inner(self, v: np.ndarray, c: int) -> np.ndarray:
        return self.fine[c].log_probabilities(v) if c in self.fine else np.zeros((len(v), 1), v.dtype)

    def homes(self, v: np.ndarray) -> np.ndarray:
        coarse = np.argmax(v @ self.top.weights + self.top.bias, 1)
        out = self.first[coarse]
        for c in np.unique(coarse):
            if c in self.fine:
                rows = np.flatnonzero(coarse == c)
                out[rows] += np.argmax(self._inner(v[rows], c), 1)
        return out

    def routes(self, v: np.ndarray) -> np.ndarray:
        """Home and then the most probable other parts of each vector: ``probes`` of them, looked for in twice as many coarse parts."""
        probes = min(self.probes, self.parts)
        z = self.top.log_probabilities(v)
        if not self.fine:
            return largest(z, probes)
        wide = largest(z, min(self.top.parts, 2 * probes))
        scores = np.full((len(v), wide.shape[1], probes), -np.inf, v.dtype)
        names = np.zeros(scores.shape, np.int64)
        for c in np.unique(wide):
            rows, nth = np.nonzero(wide == c)
            inner = self._inner(v[rows], c) + z[rows, c][:, None]
            best = largest(inner, min(probes, inner.shape[1]))
            scores[rows, nth, : best.shape[1]] = np.take_along_axis(inner, best, 1)
            names[rows, nth, : best.shape[1]] = best + self.first[c]
        scores[:, 0, 0] = np.inf  # the home
        scores, names = scores.reshape(len(v), -1), names.reshape(len(v), -1)
        return np.take_along_axis(names, largest(scores, probes), 1)

    def depths(self, asked: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """Of each row, how many probes reach the part ``homes`` of the same row."""
        out = np.empty(len(asked), np.int64)
        for a in range(0, len(asked), 64):
            v, at = asked[a : a + 64], homes[a : a + 64]
            z = self.top.log_probabilities(v)
            every = np.concatenate([self._inner(v, c) + z[:, c, None] for c in range(self.top.parts)], 1) if self.fine else z
            mine = every[np.arange(len(v)), at]
            out[a : a + 64] = np.where(self.homes(v) == at, 1, 1 + np.maximum(1, (every > mine[:, None]).sum(1)))
        return out


def neighbour_graph(v: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row, exactly."""
    out = np.empty((len(v), min(k, len(v) - 1)), np.int64)
    for a in range(0, len(v), 1024):
        s = v[a : a + 1024] @ v.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)


def seeded(v: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 15) -> np.ndarray:
    """A first partition of the graph: every vector is averaged with its neighbours, and the averages gather around ``parts`` centres.

    A centre that gathers little takes a row of the fullest part, which keeps the parts near one size.
    """
    y = _unit(v + 2 * v[graph].mean(1))
    centres = y[rng.choice(len(y), parts, False)]
    for _ in range(sweeps):
        label = np.argmax(y @ centres.T, 1)
        n = np.bincount(label, minlength=parts)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, y)
        centres = _unit(sums)
        little = np.flatnonzero(n < len(y) / parts / 4)
        for few, full in zip(little, np.argsort(-n, kind="stable")):
            if n[full] > 1.6 * len(y) / parts:
                centres[few] = y[rng.choice(np.flatnonzero(label == full))]
    return np.argmax(y @ centres.T, 1)


def refine(graph: np.ndarray, label: np.ndarray, parts: int, sweeps: int = 12, slack: float = 1.3) -> np.ndarray:
    """Move vertices to the part of most of their neighbours, while no part exceeds ``slack`` times the mean."""
    n = len(label)
    room = int(np.ceil(slack * n / parts))
    ends = np.r_[np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], np.r_[graph.ravel(), np.repeat(np.arange(n), graph.shape[1])]
    for _ in range(sweeps):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (ends[0], label[ends[1]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        free = room - np.bincount(label, minlength=parts)
        # Of the movers into each part, the best that its free room allows.
        target = best[movers]
        order = np.argsort(target, kind="stable")
        first = np.searchsorted(target[order], np.arange(parts))
        nth = np.empty(len(movers), np.int64)
        nth[order] = np.arange(len(movers)) - first[target[order]]
        go = movers[nth < free[target]]
        if not len(go):
            break
        label[go] = best[go]
    return label


def classifier(v: np.ndarray, label: np.ndarray, parts: int, steps: int = 120, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by Adam on all sample rows."""
    v = v.astype(np.float32)
    w = np.zeros((v.shape[1] + 1, parts), np.float32)
    x = np.c_[v, np.ones(len(v), np.float32)]
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(v)), label] -= 1
        g = x.T @ z / len(v) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w[:-1], w[-1]


def fit(v: np.ndarray, parts: int, k: int, seed: int = 7) -> Level:
    """A classifier of the balanced parts of the neighbour graph of unit vectors ``v``; one part where there are too few rows."""
    rng = np.random.default_rng(seed)
    parts = min(parts, len(v) // 8)
    if parts <= 1:
        return Level(np.zeros((v.shape[1], 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(v, k)
    label = refine(graph, seeded(v, graph, parts, rng), parts)
    return Level(*classifier(v, label, parts))


def pairs_at(v: np.ndarray, cosine: float, pairs: int = 20_000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``v`` and, of each, a unit vector in a random direction at that cosine."""
    rng = np.random.default_rng(seed)
    u = v[rng.integers(0, len(v), pairs)]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    return u, (cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)).astype(u.dtype)
