"""Excitation-emission matrices with cells left out: filled from the cells around, inside triangles.

A matrix is one group. Only cells next to a gap are made corners of triangles,
since no other cell can be one of a triangle over a gap; the triangles are
those whose circles hold no corner.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernels import grouped


def triangles(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (three places each) of distinct points, by inserting one after the other; points in one line have none."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    middle, reach = points.mean(axis=0), max(float(np.ptp(points, axis=0).max()), 1.0)
    far = middle + 1e4 * reach * np.array([[-1.0, -0.9], [1.1, -1.0], [-0.05, 1.2]])
    p = np.vstack([points, far]) - middle
    corners = np.array([[n, n + 1, n + 2]])
    centre, square = _circles(p, corners)
    for i in np.lexsort(points.T):
        d = p[i] - centre
        inside = (d * d).sum(axis=1) < square * (1 - 1e-10)
        hit = corners[inside]
        edges = np.concatenate([hit[:, [0, 1]], hit[:, [1, 2]], hit[:, [2, 0]]])
        code = np.sort(edges, axis=1) @ np.array([n + 3, 1])
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        rim = edges[first[times == 1]]
        new = np.column_stack([rim, np.full(len(rim), i)])
        area = np.abs(_cross(p[new[:, 0]], p[new[:, 1]], p[new[:, 2]]))
        new = new[area > 1e-9]
        c, s = _circles(p, new)
        corners, centre, square = np.concatenate([corners[~inside], new]), np.concatenate([centre[~inside], c]), np.concatenate([square[~inside], s])
    return corners[(corners < n).all(axis=1)]


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])


def _circles(p: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii of the circles through three corners each."""
    a, b, c = (p[corners[:, k]] for k in range(3))
    u, v = b - a, c - a
    twice = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    off = np.column_stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu]) / twice[:, None]
    return a + off, (off * off).sum(axis=1)


def corners_of(points: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked point the places of its triangle's corners and their shares; shares are zero where no triangle lies."""
    place, share = np.zeros((len(asked), 3), int), np.zeros((len(asked), 3))
    open_ = np.ones(len(asked), bool)
    for tri in triangles(points):
        a, b, c = points[tri]
        box = open_ & (asked >= np.minimum(np.minimum(a, b), c) - 1e-9).all(axis=1) & (asked <= np.maximum(np.maximum(a, b), c) + 1e-9).all(axis=1)
        at = np.nonzero(box)[0]
        if not len(at):
            continue
        whole = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        d = asked[at] - a
        wb = (d[:, 0] * (c[1] - a[1]) - d[:, 1] * (c[0] - a[0])) / whole
        wc = ((b[0] - a[0]) * d[:, 1] - (b[1] - a[1]) * d[:, 0]) / whole
        hit = (wb >= -1e-9) & (wc >= -1e-9) & (wb + wc <= 1 + 1e-9)
        place[at[hit]], share[at[hit]] = tri, np.column_stack([1 - wb[hit] - wc[hit], wb[hit], wc[hit]])
        open_[at[hit]] = False
    return place, share


@lru_cache(maxsize=64)
def _plan(rows: bytes, columns: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in the flat matrix and shares from which each missing cell is made. Instruments measure on one grid and mask it alike, so a worker needs few of them."""
    r, c = np.frombuffer(rows), np.frombuffer(columns)
    gap = np.frombuffer(gaps, bool).reshape(len(r), len(c))
    wide = np.pad(gap, 1)
    near = np.zeros_like(gap)
    for i in range(3):
        for j in range(3):
            near |= wide[i : i + gap.shape[0], j : j + gap.shape[1]]
    near &= ~gap
    at = lambda m: np.column_stack([r[np.nonzero(m)[0]], c[np.nonzero(m)[1]]])
    place, share = corners_of(at(near), at(gap))
    flat = np.nonzero(near.ravel())[0]
    return (flat[place] if len(flat) else place), share


def filled(grid: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A matrix whose missing cells (NaN) are taken from around, never below zero; zero where nothing is around."""
    gap = np.isnan(grid)
    if not gap.any():
        return grid
    place, share = _plan(np.asarray(rows, float).tobytes(), np.asarray(columns, float).tobytes(), gap.tobytes())
    out = grid.copy()
    out[gap] = np.maximum(np.where(share > 0, share * grid.ravel()[place], 0.0).sum(axis=1) if not gap.all() else 0.0, 0.0)
    return out


def fill_gaps(cells: DataFrame, keys: list[str], em: str, ex: str, value: str, missing: str) -> DataFrame:
    """(keys, em, ex, value, missing): cells that are flagged, null or absent from a matrix's own grid take values from around; the flag says which."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        v = part[value].where(~part[missing].fillna(False).astype(bool))
        table = part.assign(**{value: v}).pivot_table(index=em, columns=ex, values=value, aggfunc="mean", dropna=False)
        table = table.reindex(index=np.sort(part[em].unique()), columns=np.sort(part[ex].unique()))
        grid = table.to_numpy(float)
        full = filled(grid, table.index.to_numpy(float), table.columns.to_numpy(float))
        i, j = np.indices(grid.shape)
        return pd.DataFrame({em: table.index.to_numpy(float)[i.ravel()], ex: table.columns.to_numpy(float)[j.ravel()], value: full.ravel(), missing: np.isnan(grid).ravel()})

    return grouped(cells, keys, [em, ex, value, missing], f"`{em}` double, `{ex}` double, `{value}` double, `{missing}` boolean", work)
