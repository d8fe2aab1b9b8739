"""Shapes of signals in time linear in their points: lower hulls, peaks with bases and widths, peaks of chromatograms.

A signal is one group and its points one array in its task, as instruments
give them; signals are dealt over tasks by Spark.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernels import grouped


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the points of the lower convex hull; x rises. Points on an edge aren't kept."""
    hull: list[int] = []
    xs, ys = x.tolist(), y.tolist()
    for i in range(len(xs)):
        while len(hull) > 1:
            a, b = hull[-2], hull[-1]
            if (xs[b] - xs[a]) * (ys[i] - ys[a]) > (ys[b] - ys[a]) * (xs[i] - xs[a]):
                break
            hull.pop()
        hull.append(i)
    return np.array(hull, int)


def hull_baseline(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x, y, baseline, corrected) of each signal: its lower hull, drawn straight between its corners; of points with one x the lowest bears it."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=[x, y]).sort_values([x, y])
        xs, ys = part[x].to_numpy(float), part[y].to_numpy(float)
        first = np.concatenate([[True], xs[1:] > xs[:-1]]) if len(xs) else np.zeros(0, bool)
        ux, uy = xs[first], ys[first]
        at = lower_hull(ux, uy)
        base = np.interp(xs, ux[at], uy[at]) if len(at) else ys
        return pd.DataFrame({x: xs, y: ys, "baseline": base, "corrected": np.maximum(ys - base, 0.0)})

    return grouped(points, keys, [x, y], f"`{x}` double, `{y}` double, baseline double, corrected double", work)


@dataclass
class Peaks:
    """Places of peaks, how far each stands above the higher of its two bases, the bases, and its width at a share of that."""

    at: np.ndarray
    prominence: np.ndarray
    left_base: np.ndarray
    right_base: np.ndarray
    width: np.ndarray
    left: np.ndarray
    right: np.ndarray


def maxima(y: np.ndarray) -> np.ndarray:
    """Points higher than both sides, the middle of a flat top."""
    change = np.nonzero(np.diff(y))[0]
    if len(change) < 2:
        return np.zeros(0, int)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(y) - 1]])
    v = y[starts]
    top = np.nonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]))[0] + 1
    return (starts[top] + ends[top]) // 2


def spaced(y: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Of peaks nearer than ``distance`` the higher one, of equals the later; each peak is taken out once."""
    if distance <= 1 or not len(at):
        return at
    keep = np.ones(len(at), bool)
    for i in np.argsort(y[at], kind="stable")[::-1]:
        if keep[i]:
            for step, stop in ((-1, -1), (1, len(at))):
                k = i + step
                while k != stop and abs(at[k] - at[i]) < distance:
                    keep[k] = False
                    k += step
    return at[keep]


def _sides(y: list[float], wanted: np.ndarray, share: float, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Looking back from each wanted point: the least value before a higher one stands, its place, and, once prominences are known (``other``), where the signal crosses a share of them.

    One pass keeps the higher points still in sight with the least value behind
    each, and the falling steps of least values, in which a crossing is found
    by bisection.
    """
    sight: list[tuple[float, float, int]] = []  # (height, least since the one before, its place)
    steps: list[float] = []
    step_at: list[int] = []
    least, place, cross = np.zeros(len(wanted)), np.zeros(len(wanted), int), np.zeros(len(wanted))
    k = 0
    for i, v in enumerate(y):
        low, low_at = v, i
        while sight and sight[-1][0] <= v:
            _, below, where = sight.pop()
            if below < low:
                low, low_at = below, where
        sight.append((v, low, low_at))
        if other is not None:
            while steps and steps[-1] >= v:
                steps.pop(), step_at.pop()
        if k < len(wanted) and wanted[k] == i:
            least[k], place[k] = low, low_at
            if other is not None:
                height = v - share * other[k]
                j = bisect_right(steps, height) - 1
                at = step_at[j] if j >= 0 else 0
                cross[k] = at + (height - y[at]) / (y[at + 1] - y[at]) if y[at] < height else at
            k += 1
        if other is not None:
            steps.append(v), step_at.append(i)
    return least, place, cross


def peaks(y: np.ndarray, prominence: float = 0.0, height: float | None = None, distance: int = 1, share: float = 0.5) -> Peaks:
    """Peaks by height, distance and prominence, in this order, with bases and widths."""
    at = maxima(y)
    if height is not None:
        at = at[y[at] >= height]
    at = spaced(y, at, distance)
    ahead, back, n = y.tolist(), y[::-1].tolist(), len(y)
    turned = (n - 1 - at)[::-1]
    left, left_at, _ = _sides(ahead, at, share, None)
    right, right_at, _ = _sides(back, turned, share, None)
    right, right_at = right[::-1], (n - 1 - right_at)[::-1]
    stands = y[at] - np.maximum(left, right)
    keep = stands >= prominence
    at, stands, left_at, right_at = at[keep], stands[keep], left_at[keep], right_at[keep]
    _, _, start = _sides(ahead, at, share, stands)
    _, _, end = _sides(back, (n - 1 - at)[::-1], share, stands[::-1])
    end = n - 1 - end[::-1]
    return Peaks(at, stands, left_at, right_at, end - start, start, end)


def peak_table(points: DataFrame, keys: list[str], x: str, y: str, prominence: float, height: float | None = None, distance: int = 1, share: float = 0.5) -> DataFrame:
    """(keys, x, y, prominence, left_base, right_base, width) of each signal's peaks; bases are values of x, widths points."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=[x, y]).sort_values([x, y])
        xs, ys = part[x].to_numpy(float), part[y].to_numpy(float)
        p = peaks(ys, prominence, height, distance, share)
        return pd.DataFrame({x: xs[p.at], y: ys[p.at], "prominence": p.prominence, "left_base": xs[p.left_base], "right_base": xs[p.right_base], "width": p.width})

    return grouped(points, keys, [x, y], f"`{x}` double, `{y}` double, prominence double, left_base double, right_base double, width double", work)


def running_median(y: np.ndarray, window: int, piece: int = 1 << 16) -> np.ndarray:
    """Median of an odd window around each point; ends are repeated outwards."""
    half = window // 2
    wide = np.pad(y, half, mode="edge")
    return np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(wide[i : i + piece + 2 * half], window), axis=1) for i in range(0, len(y), piece)]) if len(y) else y


def chromatogram_peaks(t: np.ndarray, y: np.ndarray, sigmas: float = 3.0, base_minutes: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, areas and heights of peaks over a running median, by so many deviations of the noise in height and prominence; areas reach one and a half widths to either side."""
    none = (np.zeros(0),) * 3
    if len(y) < 10:
        return none
    step = float(np.median(np.diff(t)))
    if step <= 0:
        return none
    over = y - running_median(y, max(5, int(round(base_minutes / step)) | 1))
    d = np.diff(over)
    limit = max(sigmas * 1.4826 * float(np.median(np.abs(d - np.median(d)))) / np.sqrt(2.0), 1e-12)
    found = peaks(over, limit, limit)
    sums = np.concatenate([[0.0], np.cumsum((np.maximum(over[1:], 0) + np.maximum(over[:-1], 0)) / 2 * np.diff(t))])
    half = np.maximum(2, np.ceil(1.5 * found.width).astype(int))
    lo, hi = np.maximum(0, found.at - half), np.minimum(len(y) - 1, found.at + half)
    return t[found.at], sums[hi] - sums[lo], over[found.at]


def tic_peaks(points: DataFrame, keys: list[str], x: str, y: str, sigmas: float = 3.0, base_minutes: float = 2.0) -> DataFrame:
    """(keys, retention, area, height) of the peaks of each total ion chromatogram."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.dropna(subset=[x, y]).sort_values([x, y])
        return pd.DataFrame(dict(zip(("retention", "area", "height"), chromatogram_peaks(part[x].to_numpy(float), part[y].to_numpy(float), sigmas, base_minutes))))

    return grouped(points, keys, [x, y], "retention double, area double, height double", work)
