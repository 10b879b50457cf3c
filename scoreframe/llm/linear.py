"""Sparse multinomial logistic regression for bounded samples, and its calibration."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Rows of a sparse matrix: row k has columns ``idx[ptr[k]:ptr[k+1]]``."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.ptr[k], self.ptr[k + 1])
        return self.idx[span], self.val[span]

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        ptr = np.cumsum([0, *(len(i) for i, _ in rows)])
        idx = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int64)
        val = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
        return Sparse(ptr, idx.astype(np.int64), val)

    @staticmethod
    def filled(rows: Iterable[tuple[np.ndarray, np.ndarray]], sizes: list[int]) -> Sparse:
        """Of rows of known sizes, made one after the other, so that they lie in memory once."""
        ptr = np.cumsum([0, *sizes])
        out = Sparse(ptr, np.empty(ptr[-1], np.int64), np.empty(ptr[-1]))
        for k, (idx, val) in enumerate(rows):
            out.idx[ptr[k] : ptr[k + 1]], out.val[ptr[k] : ptr[k + 1]] = idx, val
        return out

    def take(self, which: np.ndarray) -> Sparse:
        return Sparse.of([self.row(k) for k in which.tolist()])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logits(x: Sparse, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), w.shape[1]))
    for k in range(len(x)):
        idx, val = x.row(k)
        out[k] = val @ w[idx] + bias
    return out


def ftrl(
    x: Sparse, y: np.ndarray, dims: int, classes: int, *, weights: np.ndarray | None = None, epochs: int = 3,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims x classes) and bias by follow-the-regularised-leader, one update per row.

    The proximal form keeps per coordinate the sum of adjusted gradients ``z`` and of squared gradients
    ``n``; ``l1`` sets small weights to zero exactly and ``l2`` shrinks the others. The bias is a last
    column without penalties.
    """
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    order = np.random.default_rng(seed)
    share = np.ones(len(x)) if weights is None else weights
    free = np.ones((1, 1))

    def solve(at: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        shrunk = np.sign(za) * np.maximum(np.abs(za) - l1 * penalty, 0)
        return -shrunk / ((beta + np.sqrt(na)) / alpha + l2 * penalty)

    for _ in range(epochs):
        for k in order.permutation(len(x)).tolist():
            idx, val = x.row(k)
            at, val = np.append(idx, dims), np.append(val, 1.0)
            penalty = np.ones((len(at), 1))
            penalty[-1] = 0
            w = solve(at, penalty)
            g = softmax(val @ w)
            g[y[k]] -= 1
            grad = val[:, None] * (share[k] * g)[None, :]
            na = n[at]
            more = na + grad * grad
            z[at] += grad - (np.sqrt(more) - np.sqrt(na)) / alpha * w
            n[at] = more
    w = solve(np.arange(dims + 1), np.r_[np.ones((dims, 1)), 0 * free])
    return w[:dims].astype(np.float32), w[dims]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """What to divide logits by for the least log loss on rows that weren't fitted; 1 without such rows."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, cut = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))
