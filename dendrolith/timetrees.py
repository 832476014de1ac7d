"""Time trees in analysis documents: heights by ratios, population models and rate priors of one declared tree.

The tree of a document is a dimension: its heights are arrays on the driver, as its patterns may be. Collections of trees
and their events are the business of ``operators.sweeps`` and ``operators.coalescent``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import lgamma, log, pi

import numpy as np

from dendrolith.operators import heights as H
from dendrolith.operators.likelihood import TreeArrays
from dendrolith.sources.trees import Tree


@dataclass
class Heights:
    """Heights of a tree whose tips are dated; inner nodes are free through their ratios, the root through its height."""

    tree: Tree
    dates: dict[str, float] | None
    arrays: TreeArrays | None = None
    tips: np.ndarray | None = None
    parameters: list | None = None

    def place(self, taxa: list[str], parameter: Callable) -> list:
        """Number the nodes by the order of ``taxa`` and make the parameters: a ratio per inner node, then the root's height.

        Tips stand at the latest date less their own; without dates, where the tree's lengths put them. Inner nodes start
        where the lengths put them, moved up where a tip or a child is not below them."""
        if self.parameters is not None:
            return self.parameters
        own = TreeArrays.of(self.tree, taxa)
        n, far = len(own.children), np.zeros(len(own.children))
        for k in range(n - 2, -1, -1):
            far[k] = far[own.parent[k]] + own.length[k]
        start = far.max() - far
        tips = start.copy()
        if self.dates is not None:
            last = max(self.dates[t] for t in taxa)
            tips = np.array([last - self.dates[t] for t in taxa] + [0.0] * (n - len(taxa)))
            start = start + (tips[: len(taxa)] - start[: len(taxa)]).max(initial=0.0) if np.any(start[: len(taxa)] < tips[: len(taxa)] - 1e-6) else start
        start[: len(taxa)] = tips[: len(taxa)]
        for k in own.internal:
            start[k] = max(start[k], max(start[c] for c in own.children[k]) + 1e-6)
        ratios = H.to_ratios(own.children, own.parent, start)
        low = H.bounds(own.children, start)
        self.arrays, self.tips = own, start
        self.parameters = [parameter(f"ratio.{k}", float(np.clip(ratios[k], 1e-6, 1 - 1e-6)), 0.0, 1.0) for k in own.internal[:-1]] + [parameter("root.height", float(start[-1]), float(low[-1]), np.inf)]
        return self.parameters

    def values(self) -> np.ndarray:
        """Heights of all nodes at the parameters' present values."""
        if self.parameters is None:
            raise ValueError("a time tree gets its heights with a likelihood over its taxa")
        ratios = np.zeros(len(self.arrays.children))
        ratios[list(self.arrays.internal)] = [p.value for p in self.parameters]
        return H.from_ratios(self.arrays.children, self.arrays.parent, self.tips, ratios)

    def durations(self) -> np.ndarray:
        h = self.values()
        return np.append(h[self.arrays.parent[:-1]] - h[:-1], 0.0)

    def log_jacobian(self) -> float:
        return H.log_jacobian(self.arrays.children, self.arrays.parent, self.values())

    def events(self, grid: list[float] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ordered events: time, time since the one before, pairs of lineages until then, whether it is a coalescence, and
        the numbers of coalescences and grid points before it."""
        h, n = self.values(), len(self.tips) - len(self.arrays.internal)
        t = np.concatenate([h, grid])
        sign = np.concatenate([np.ones(n), -np.ones(len(h) - n), np.zeros(len(grid))])
        order = np.lexsort((np.arange(len(t)), t))
        t, sign = t[order], sign[order]
        lineages = np.concatenate([[0.0], np.cumsum(sign)[:-1]])
        before = lambda own: np.concatenate([[0], np.cumsum(own)[:-1]]).astype(int)
        return t, np.diff(t, prepend=t[0]), lineages * (lineages - 1) / 2, sign < 0, np.stack([before(sign < 0), before(sign == 0)])


@dataclass
class Coalescent:
    """The density of a time tree's coalescences under a population model, at the present values of its parameters."""

    model: str
    heights: Heights
    sizes: list
    cutoff: float = 0.0
    groups: list[int] | None = None
    logs: bool = False

    def log_p(self) -> float:
        values = np.array([p.value for p in self.sizes])
        points = len(values) - 1
        grid = [self.cutoff * i / points for i in range(1, points + 1)] if self.model in ("skygrid", "piecewise-linear") else []
        t, dt, pairs, merges, (coalesced, passed) = self.heights.events(grid)
        if self.model == "constant":
            area, at = dt / values[0], np.full(len(t), np.log(values[0]))
        elif self.model == "exponential":
            n0, rate = values
            area = (np.exp(t * rate) - np.exp((t - dt) * rate)) / (n0 * rate) if rate else dt / n0
            at = np.log(n0) - t * rate
        elif self.model == "piecewise-linear":
            step, i = self.cutoff / points, np.minimum(passed, points)
            size = lambda x: np.where(i >= points, values[-1], values[i] + (values[np.minimum(i + 1, points)] - values[i]) * (x - i * step) / step)
            end, start = size(t), size(t - dt)
            flat = np.abs(end - start) < 1e-12
            area = np.where(flat, dt / end, dt * np.log(end / start) / np.where(flat, 1.0, end - start))
            at = np.log(end)
        else:
            if self.model == "skyline":
                place = np.searchsorted(np.cumsum(self.groups)[:-1], coalesced, side="right")
            else:
                place = passed if self.model == "skygrid" else coalesced
            own = values[np.minimum(place, len(values) - 1)]
            at = own if self.logs else np.log(own)
            area = dt * np.exp(-at)
        return float(-(pairs * area).sum() - at[merges].sum())


@dataclass
class Field:
    """A Gaussian Markov random field on neighbouring values: differences are normal with a precision."""

    x: Callable[[], list[float]]
    precision: object

    def log_p(self) -> float:
        d = np.diff(np.array(self.x()))
        tau = self.precision.value
        return float(0.5 * len(d) * log(tau / (2 * pi)) - 0.5 * tau * (d * d).sum())


@dataclass
class RateScale:
    """The prior of a clock's rate that weighs it by the tree's length in time: gamma with shape a half."""

    x: Callable[[], list[float]]
    heights: Heights

    def log_p(self) -> float:
        total = float(self.heights.durations().sum())
        return float(sum(0.5 * log(total) - lgamma(0.5) - 0.5 * log(r) - r * total for r in self.x()))
