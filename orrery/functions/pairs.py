"""Distances of all pairs among the atoms around a point, counted without keeping pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Atoms of a tile; two tiles are compared at once.
TILE = 256


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed as ``spatial.d2`` sums them."""
    x, y, z = (a[..., i] - b[..., i] for i in range(3))
    return x * x + y * y + z * z


def _limits(high: float, bins: int) -> list[float]:
    """Least squared distance in each bin from the second, by the rule of ``aggregate.fixed_bin``."""
    bin_of = lambda v: 0 if v <= 0 else bins - 1 if np.sqrt(v) >= high else min(int(np.floor(np.sqrt(v) / (high / bins))), bins - 1)
    out = []
    for k in range(1, bins):
        v = np.float64((k * (high / bins)) ** 2)
        while bin_of(v) >= k:
            v = np.nextafter(v, 0.0)
        while bin_of(v) < k:
            v = np.nextafter(v, np.inf)
        out.append(float(v))
    return out


def _along_curve(at: np.ndarray) -> np.ndarray:
    """Order of the points along a curve that keeps near ones together."""
    low = at.min(axis=0)
    cell = np.minimum((at - low) / max(float((at.max(axis=0) - low).max()), 1e-300) * 1023, 1023).astype(np.int64)
    key = np.zeros(len(at), np.int64)
    for bit in range(10):
        for axis in range(3):
            key |= ((cell[:, axis] >> bit) & 1) << (3 * bit + axis)
    return np.argsort(key, kind="stable")


def below(at: np.ndarray, center: np.ndarray, r: float, limits: list[float]) -> np.ndarray:
    """For each limit, the pairs of the points (within r of the center), each once and each point with itself, whose
    squared distance is less.

    Boxes of tiles tell most limits for all their pairs. The others are compared in single
    precision, and those nearer to a limit than its error in double.
    """
    n = len(at)
    near = (at - center).astype(np.float32)
    # coordinates and products are off by some 2e-6 r * r at most
    margin = 5e-6 * r * r
    starts = np.arange(0, n, TILE)
    lo, hi = np.minimum.reduceat(near, starts), np.maximum.reduceat(near, starts)
    gap = np.maximum(np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]), 0)
    gap, far = (gap * gap).sum(axis=2), (np.maximum(hi[:, None] - lo[None], hi[None] - lo[:, None]) ** 2).sum(axis=2)
    size = np.diff(np.append(starts, n))
    square, one = (near * near).sum(axis=1), np.ones(n, np.float32)
    left, right = np.column_stack((near, square, one)), np.column_stack((-2 * near, one, square)).T.copy()
    pairs = np.triu(np.multiply.outer(size, size), 1)
    np.fill_diagonal(pairs, size * (size + 1) // 2)
    out, open_ = [], []
    for v in limits:
        inside = far < v - margin
        out.append(int(pairs[inside].sum()))
        open_.append(~inside & (gap < v + margin))
    some = np.triu(np.logical_or.reduce(open_))
    for i, j in zip(*np.nonzero(some), strict=True):
        a, b = slice(starts[i], starts[i] + size[i]), slice(starts[j], starts[j] + size[j])
        d = left[a] @ right[:, b]
        for k, v in enumerate(limits):
            if not open_[k][i, j]:
                continue
            sure, most = np.count_nonzero(d < v - margin), np.count_nonzero(d < v + margin)
            if sure != most:
                p, q = np.divmod(np.flatnonzero((d >= v - margin) & (d < v + margin)), d.shape[1])
                sure += np.count_nonzero(_d2(at[a][p], at[b][q]) < v)
            # a tile with itself has its pairs twice, but for the points themselves
            out[k] += int((sure + size[i]) // 2 if i == j else sure)
    return np.array(out, np.int64)


def _smooth(at: np.ndarray, high: float, bins: int) -> np.ndarray:
    """Shares of all pairs by the rule of ``aggregate.smooth_bins``."""
    out, step = np.zeros(bins), high / (bins - 1)
    for i in range(0, len(at), TILE):
        d2 = _d2(at[i : i + TILE, None], at[None, i:])
        pos = np.minimum(np.sqrt(d2[np.triu(np.ones(d2.shape, bool))]) / step, bins - 1.0)
        b0 = np.minimum(np.floor(pos).astype(np.int64), bins - 2)
        out += np.bincount(b0, 1.0 - (pos - b0), bins) + np.bincount(b0 + 1, pos - b0, bins)
    return out


def histogram_near(points: pd.DataFrame, atoms: pd.DataFrame, r: float, bins: int, smooth: bool, normalised: bool) -> pd.DataFrame:
    """id and b0, b1, ...: the pair distances, 0 to 2 r, among the atoms (x_r, y_r, z_r) within r of each point."""
    at = atoms[["x_r", "y_r", "z_r"]].to_numpy(np.float64)
    at = at[_along_curve(at)] if len(at) else at
    limits = _limits(2 * r, bins)
    rows = []
    for q in points[["x", "y", "z"]].to_numpy(np.float64):
        mine = at[_d2(q, at) <= r * r]
        n = len(mine)
        total = n * (n + 1) // 2
        if not n:
            got = np.zeros(bins)
        elif smooth:
            got = _smooth(mine, 2 * r, bins)
        else:
            got = np.diff(np.concatenate(([0], below(mine, q, r, limits), [total]))).astype(np.float64)
        rows.append(got / total if normalised and n else got)
    out = pd.DataFrame(np.array(rows).reshape(len(points), bins), columns=[f"b{i}" for i in range(bins)])
    out.insert(0, "id", points["id"].to_numpy())
    return out
