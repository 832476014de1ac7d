"""Reparameterised node heights of one tree, as arrays; parents have larger numbers than their children.

A node's lower bound is the height of the latest tip under it. Ratios place each inner node between its bound and its
parent's height; the root keeps its height. Shifts are heights above the higher child.
"""

from __future__ import annotations

import numpy as np


def bounds(children: list[list[int]], tip_heights: np.ndarray) -> np.ndarray:
    low = np.zeros(len(children))
    for i, kids in enumerate(children):
        low[i] = max(low[c] for c in kids) if kids else tip_heights[i]
    return low


def to_ratios(children: list[list[int]], parent: np.ndarray, heights: np.ndarray) -> np.ndarray:
    low = bounds(children, heights)
    out = heights.astype(float).copy()
    for i, kids in enumerate(children):
        if kids and parent[i] >= 0:
            out[i] = (heights[i] - low[i]) / (heights[parent[i]] - low[i])
    return out


def from_ratios(children: list[list[int]], parent: np.ndarray, tip_heights: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Heights from the ratios of inner nodes and the root's height."""
    low = bounds(children, tip_heights)
    out = np.asarray(tip_heights, dtype=float).copy()
    for i in range(len(children) - 1, -1, -1):
        if children[i]:
            out[i] = ratios[i] if parent[i] < 0 else low[i] + (out[parent[i]] - low[i]) * ratios[i]
    return out


def log_jacobian(children: list[list[int]], parent: np.ndarray, heights: np.ndarray) -> float:
    low = bounds(children, heights)
    gaps = [heights[parent[i]] - low[i] for i, kids in enumerate(children) if kids and parent[i] >= 0]
    return float(np.log(gaps).sum()) if min(gaps, default=1.0) > 0 else -np.inf


def ratio_gradient(children: list[list[int]], parent: np.ndarray, heights: np.ndarray, ratios: np.ndarray, by_height: np.ndarray) -> np.ndarray:
    """Gradient by ratios and root height from the gradient by heights, in one pass from the tips."""
    low = bounds(children, heights)
    total = np.asarray(by_height, dtype=float).copy()
    out = np.zeros(len(children))
    for i, kids in enumerate(children):
        if not kids:
            continue
        if parent[i] < 0:
            out[i] = total[i]
        else:
            out[i] = total[i] * (heights[parent[i]] - low[i])
            total[parent[i]] += total[i] * ratios[i]
    return out


def jacobian_height_gradient(children: list[list[int]], parent: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Gradient of the log-Jacobian by heights."""
    low = bounds(children, heights)
    out = np.zeros(len(children))
    for i, kids in enumerate(children):
        if kids and parent[i] >= 0:
            out[parent[i]] += 1 / (heights[parent[i]] - low[i])
    return out


def to_shifts(children: list[list[int]], heights: np.ndarray) -> np.ndarray:
    return np.array([h - max(heights[c] for c in kids) if kids else h for h, kids in zip(heights, children, strict=True)])


def from_shifts(children: list[list[int]], tip_heights: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    out = np.asarray(tip_heights, dtype=float).copy()
    for i, kids in enumerate(children):
        if kids:
            out[i] = max(out[c] for c in kids) + shifts[i]
    return out


def simplex_gradient(p: np.ndarray) -> np.ndarray:
    """d p / d z of the stick-breaking transform: (K - 1) rows of K."""
    k = len(p)
    out = np.zeros((k - 1, k))
    left = 1.0
    for i in range(k - 1):
        share = p[i] / left
        out[i, i] = left * share * (1 - share)
        out[i, i + 1 :] = -p[i + 1 :] * share
        left -= p[i]
    return out
