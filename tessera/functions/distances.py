"""Pairwise distances between two blocks of vectors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Metrics of 0/1 vectors, computed from the counts of agreeing and differing positions.
BINARY = ("jaccard", "dice", "kulczynski1", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath", "yule")
METRICS = ("braycurtis", "canberra", "chebychev", "cityblock", "correlation", "cosine", "euclidean", "hamming", "jensenshannon", "mahalanobis", "minkowski", "pnorm", "seuclidean", "sqeuclid", "sqeuclidean", *BINARY)


def _safe(top: np.ndarray, bottom: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    return np.where(bottom == 0, otherwise, top / np.where(bottom == 0, 1, bottom))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([((row - b) ** 2).sum(axis=1) for row in a]) if len(a) else np.empty((0, len(b)))


#: Below this share of both squared lengths a squared distance from a product has lost digits and is taken from differences.
CANCELLED = 1e-6


def _again(d: np.ndarray, doubtful: np.ndarray, a: np.ndarray, b: np.ndarray, f) -> np.ndarray:
    """d with f(rows of a, rows of b) at the doubtful cells, some of them at a time."""
    i, j = np.nonzero(doubtful)
    for k in range(0, len(i), 16_384):
        at = i[k : k + 16_384], j[k : k + 16_384]
        d[at] = f(a[at[0]], b[at[1]])
    return d


def _squared_by_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_squared as |a|^2 + |b|^2 - 2 ab, to about nine digits, from one product with the squared lengths as two more columns."""
    aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[:, None]
    d = np.hstack([-2 * a, aa, np.ones_like(aa)]) @ np.hstack([b, np.ones_like(bb), bb]).T
    # Written so that a NaN is doubtful too.
    if d.size and d.min() > CANCELLED * (aa.max() + bb.max()):
        return d
    doubtful = ~(d > CANCELLED * (aa + bb.T))
    return _again(d, doubtful, a, b, lambda x, y: ((x - y) ** 2).sum(axis=1)) if doubtful.any() else d


def unit(x: np.ndarray) -> np.ndarray:
    return _safe(x, np.linalg.norm(x, axis=1, keepdims=True))


def from_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    return np.subtract(1, d, out=d)


def _by_row(a: np.ndarray, b: np.ndarray, f) -> np.ndarray:
    return np.stack([f(row, b) for row in a]) if len(a) else np.empty((0, len(b)))


#: Rows and columns of a piece of a matrix that is summed component by component: it stays in a core's cache.
TALL, WIDE = 64, 512


def _by_component(a: np.ndarray, b: np.ndarray, add) -> np.ndarray:
    """A matrix grown component by component: add(sum so far, x as a column, y as a row, scratch of the same shape)."""
    out, x, y = np.zeros((len(a), len(b))), np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(0, len(a), TALL):
        for j in range(0, len(b), WIDE):
            piece = np.zeros((min(TALL, len(a) - i), min(WIDE, len(b) - j)))
            scratch = np.empty_like(piece), np.empty_like(piece)
            for k in range(len(x)):
                add(piece, x[k, i : i + TALL, None], y[k, None, j : j + WIDE], *scratch)
            out[i : i + TALL, j : j + WIDE] = piece
    return out


def _add_gap(total, x, y, t, _):
    total += np.abs(np.subtract(x, y, out=t), out=t)


def _add_less(total, x, y, t, _):
    total += np.minimum(x, y, out=t)


def _cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From |x - y| = x + y - 2 min(x, y), one operation a component less; what has lost digits comes from differences."""
    d = _by_component(a, b, _add_less)
    d *= -2
    d += a.sum(axis=1)[:, None]
    d += b.sum(axis=1)[None, :]
    most = np.abs(a).sum(axis=1).max(initial=0.0) + np.abs(b).sum(axis=1).max(initial=0.0)
    if d.size and d.min() > CANCELLED * most:
        return d
    doubtful = ~(d > CANCELLED * most)
    return _again(d, doubtful, a, b, lambda x, y: np.abs(x - y).sum(axis=1)) if doubtful.any() else d


def _add_sum(total, x, y, t, _):
    total += np.abs(np.add(x, y, out=t), out=t)


def _keep_gap(total, x, y, t, _):
    np.maximum(total, np.abs(np.subtract(x, y, out=t), out=t), out=total)


def _add_other(total, x, y, t, _):
    total += x != y


def _add_share(total, x, y, t, u):
    np.abs(np.subtract(x, y, out=t), out=t)
    np.add(np.abs(x), np.abs(y), out=u)
    if not (x.all() and y.all()):
        u[u == 0] = 1
    total += np.divide(t, u, out=t)


def _add_entropy(total, x, y, t, u):
    np.add(x, y, out=t)
    if not (x.all() and y.all()):
        np.log(np.where(t > 0, t, 1), out=u)
    else:
        np.log(t, out=u)
    total += np.multiply(t, u, out=t)


def _shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


def _jensenshannon(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From entropies: sum x ln x + sum y ln y - sum (x + y) ln((x + y) / 2), with one logarithm a pair of components."""
    own = lambda x: (x * np.log(np.where(x > 0, x, 1))).sum(axis=1) + np.log(2) * x.sum(axis=1)
    d = (own(a)[:, None] + own(b)[None, :] - _by_component(a, b, _add_entropy)) / 2
    doubtful = ~(d > CANCELLED)
    d = np.sqrt(np.maximum(d, 0))
    return _again(d, doubtful, a, b, _shannon) if doubtful.any() else d


def _zeros_and_ones(x: np.ndarray) -> bool:
    return bool(((x == 0) | (x == 1)).all())


def _of_counts(metric: str, n: int, both: np.ndarray, ones_a: np.ndarray, ones_b: np.ndarray) -> np.ndarray:
    """The distance of 0/1 vectors of n components from the positions where both are 1 and the ones of each."""
    only_a, only_b = ones_a - both, ones_b - both
    differ = only_a + only_b
    neither = n - both - differ
    if metric == "hamming":
        return differ / n
    if metric == "jaccard":
        return _safe(differ, both + differ)
    if metric == "dice":
        return _safe(differ, 2 * both + differ)
    if metric == "kulczynski1":
        return _safe(both, differ)
    if metric == "russellrao":
        return (n - both) / n
    if metric == "sokalsneath":
        return _safe(2 * differ, both + 2 * differ)
    if metric == "yule":
        return _safe(2 * only_a * only_b, both * neither + only_a * only_b)
    return _safe(2 * differ, both + neither + 2 * differ)


#: 0/1 vectors of so many components at most are compared as one machine word, their distances looked up.
WORD = 64


@lru_cache(maxsize=4)
def _looked_up(metric: str, n: int) -> np.ndarray:
    """The distances of 0/1 vectors of n components by their ones and common ones, at (ones_a (n + 1) + ones_b) (n + 1) + both."""
    k = np.arange(n + 1, dtype=np.float64)
    return np.broadcast_to(_of_counts(metric, n, k[None, None, :], k[:, None, None], k[None, :, None]), (n + 1,) * 3).ravel()


def _binary(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not (_zeros_and_ones(a) and _zeros_and_ones(b)):
        raise ValueError(f"{metric} is defined for 0/1 vectors")
    n = a.shape[1]
    ones_a, ones_b = a.sum(axis=1), b.sum(axis=1)
    if not 0 < n <= WORD:
        return _of_counts(metric, n, a @ b.T, ones_a[:, None], ones_b[None, :])
    word = lambda x: np.packbits(np.pad(x.astype(np.uint8), ((0, 0), (0, WORD - n))), axis=1).view(np.uint64).ravel()
    at = np.add(np.bitwise_count(word(a)[:, None] & word(b)[None, :]), (ones_b * (n + 1)).astype(np.int32)[None, :], dtype=np.int32)
    at += (ones_a * (n + 1) ** 2).astype(np.int32)[:, None]
    return _looked_up(metric, n)[at]


def pairwise(metric: str, a: np.ndarray, b: np.ndarray, fitted: np.ndarray | None = None, products: bool = False) -> np.ndarray:
    """The distances of every row of a to every row of b.

    `fitted` is the variance of each column for seuclidean, the inverse covariance for mahalanobis.
    Binary metrics take 0/1 vectors only; a quotient 0/0 is 0. minkowski and pnorm have p = 2. With `products` those
    of squares of differences come from one matrix product and those of sums of differences from sums of minima, to about nine
    digits, so equal distances may differ in the last ones.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    if metric in BINARY:
        return _binary(metric, a, b)
    squared = _squared_by_product if products else _squared
    if metric in ("euclidean", "minkowski", "pnorm"):
        d = squared(a, b)
        return np.sqrt(d, out=d)
    if metric in ("sqeuclidean", "sqeuclid"):
        return squared(a, b)
    if metric == "cosine":
        return from_one(unit(a), unit(b))
    if metric == "correlation":
        return from_one(unit(a - a.mean(axis=1, keepdims=True)), unit(b - b.mean(axis=1, keepdims=True)))
    if metric == "jensenshannon":
        return _jensenshannon(_safe(a, a.sum(axis=1, keepdims=True)), _safe(b, b.sum(axis=1, keepdims=True)))
    if metric == "seuclidean":
        scale = 1 / np.sqrt(fitted)
        return np.sqrt(squared(a * scale, b * scale))
    if metric == "mahalanobis":
        return _by_row(a, b, lambda r, m: np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", m - r, fitted, m - r))))
    if metric == "cityblock" and products:
        return _cityblock(a, b)
    if metric == "braycurtis":
        return _safe(_by_component(a, b, _add_gap), _by_component(a, b, _add_sum))
    if metric == "hamming" and _zeros_and_ones(a) and _zeros_and_ones(b):
        return _binary(metric, a, b)
    if metric == "hamming":
        return _by_component(a, b, _add_other) / a.shape[1]
    return _by_component(a, b, {"cityblock": _add_gap, "chebychev": _keep_gap, "canberra": _add_share}[metric])
