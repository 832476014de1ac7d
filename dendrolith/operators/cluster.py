"""Distance trees: neighbour joining and UPGMA on a matrix of taxa, a dimension of the alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from dendrolith.sources.trees import Node, Tree


def matrix(distance: DataFrame, n: int, value: str = "d") -> np.ndarray:
    """The (i, j, d) rows of n taxa as a symmetric matrix."""
    out = np.zeros((n, n))
    for r in distance.select("i", "j", value).collect():  # n (n - 1) / 2 rows
        out[r[0], r[1]] = out[r[1], r[0]] = r[2]
    return out


def neighbour_joining(names: Sequence[str], distances: np.ndarray) -> Tree:
    """Joins the pair with the least corrected distance; lengths are cut at zero, the last edge is split in half."""
    d = np.asarray(distances, dtype=float).copy()
    nodes = [Node(str(x)) for x in names]
    while len(nodes) > 2:
        n = len(nodes)
        r = d.sum(axis=1) / (n - 2)
        q = d - r[:, None] - r[None, :]
        q[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(q), q.shape)
        half = 0.5 * (d[i, j] + r[i] - r[j])
        nodes[i].length, nodes[j].length = max(0.0, half), max(0.0, d[i, j] - half)
        joined = Node(children=[nodes[i], nodes[j]])
        row = 0.5 * (d[i] + d[j] - d[i, j])
        keep = [k for k in range(n) if k not in (i, j)]
        new = np.zeros((n - 1, n - 1))
        new[:-1, :-1] = d[np.ix_(keep, keep)]
        new[-1, :-1] = new[:-1, -1] = row[keep]
        d, nodes = new, [nodes[k] for k in keep] + [joined]
    if len(nodes) == 2:
        nodes[0].length = nodes[1].length = max(0.0, d[0, 1]) / 2
    return Tree(Node(children=nodes))


def upgma(names: Sequence[str], distances: np.ndarray) -> Tree:
    """Average linkage: clusters weigh by their size, heights are half the joining distance."""
    d = np.asarray(distances, dtype=float).copy()
    nodes, size, height = [Node(str(x)) for x in names], [1] * len(names), [0.0] * len(names)
    while len(nodes) > 1:
        n = len(nodes)
        masked = d.copy()
        masked[np.tril_indices(n)] = np.inf
        i, j = np.unravel_index(np.argmin(masked), masked.shape)
        top = d[i, j] / 2
        nodes[i].length, nodes[j].length = top - height[i], top - height[j]
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        keep = [k for k in range(n) if k not in (i, j)]
        new = np.zeros((n - 1, n - 1))
        new[:-1, :-1] = d[np.ix_(keep, keep)]
        new[-1, :-1] = new[:-1, -1] = row[keep]
        joined = Node(children=[nodes[i], nodes[j]])
        d, nodes = new, [nodes[k] for k in keep] + [joined]
        size, height = [size[k] for k in keep] + [size[i] + size[j]], [height[k] for k in keep] + [top]
    return Tree(nodes[0])


def reroot(tree: Tree, tip: str, share: float = 0.5) -> Tree:
    """Move the root to the branch above a tip; ``share`` of that branch goes to the tip."""
    parent = {id(n): p for n, p in tree.postorder()}
    node = next(n for n in tree.tips() if n.name == tip)
    top = node.length or 0.0
    path, at = [], parent[id(node)]
    while at is not None:
        path.append(at)
        at = parent[id(at)]
    if not path:
        return tree
    below, carried = node, top * (1 - share)
    lengths = [p.length or 0.0 for p in path]
    for n, p in enumerate(path):
        p.children = [c for c in p.children if c is not below]
        below = p
        if n + 1 < len(path):
            p.children.append(path[n + 1])
    for n, p in enumerate(path):
        p.length = carried if n == 0 else lengths[n - 1]
    root = path[-1]
    if len(path) > 1 and len(root.children) == 1:  # the old root joined two branches only
        only = root.children[0]
        only.length = (only.length or 0.0) + (root.length or 0.0)
        path[-2].children[-1] = only
    node.length = top * share
    return Tree(Node(children=[node, path[0]]))


def root_to_tip(tree: Tree, dates: dict[str, float]) -> dict[str, float]:
    """Least squares of the tips' distances from the root on their dates: slope, intercept, r and the root's date."""
    distance: dict[int, float] = {id(tree.root): 0.0}
    stack = [tree.root]
    while stack:
        n = stack.pop()
        for c in n.children:
            distance[id(c)] = distance[id(n)] + (c.length or 0.0)
            stack.append(c)
    tips = tree.tips()
    x, y = np.array([dates[t.name] for t in tips]), np.array([distance[id(t)] for t in tips])
    slope = np.cov(x, y)[0, 1] / x.var(ddof=1)
    intercept = y.mean() - slope * x.mean()
    return {"slope": float(slope), "intercept": float(intercept), "r": float(np.corrcoef(x, y)[0, 1]), "root_date": float(-intercept / slope)}


def nni(tree: Tree) -> list[Tree]:
    """The nearest-neighbour interchanges of a tree, two per inner edge."""
    import copy

    out = []
    order = tree.postorder()
    inner = [k for k, (n, p) in enumerate(order) if p is not None and n.children]
    for k in inner:
        for swap in range(len(order[k][0].children)):
            twin = Tree(copy.deepcopy(tree.root))
            node, parent = twin.postorder()[k]
            others = [c for c in parent.children if c is not node]
            if not others:
                continue
            a, b = node.children[swap], others[0]
            node.children[swap] = b
            parent.children = [a if c is b else c for c in parent.children]
            out.append(twin)
    return out
