"""Ordered edit distances of all tree pairs of one tile, by array recurrences over distinct subtrees.

The forests of this recurrence are made by deleting nodes, so they are no subtrees and have no table
of their own to join with; all other shapes go by joins (``operators.levels``, ``operators.paths``).

A side of a tile is the set of distinct subtrees of its trees, children before parents.  For one
subtree of the left side a recurrence is run against every subtree of the right side at once, so
equal subtrees are met once per tile and the inner loops are array operations.
"""

from __future__ import annotations

import numpy as np


class Side:
    """Distinct subtrees of some trees, given as pre-order labels and subtree sizes."""

    def __init__(self, trees, codes: dict):
        ids: dict = {}
        label, size, self.children, self.roots = [], [], [], []
        for labels, sizes in trees:
            subtree = [0] * len(labels)
            for at in range(len(labels) - 1, -1, -1):
                kids, k = [], at + 1
                while k < at + sizes[at]:
                    kids.append(subtree[k])
                    k += sizes[k]
                code = codes.setdefault(labels[at], len(codes))
                entry = (code, tuple(kids))
                if entry not in ids:
                    ids[entry] = len(ids)
                    label.append(code)
                    size.append(int(sizes[at]))
                    self.children.append(kids)
                subtree[at] = ids[entry]
            self.roots.append(subtree[0])
        n = self.n = len(label)
        self.label = np.array(label)
        self.size = np.array(size + [0], dtype=float)

    def preorder(self, v: int) -> list[int]:
        order, stack = [], [v]
        while stack:
            u = stack.pop()
            order.append(u)
            stack.extend(reversed(self.children[u]))
        return order

    def keyroots(self) -> list[list[int]]:
        """Roots and children with a later sibling, grouped so that inner ones come first."""
        nested = [0] * self.n
        keys = set(self.roots)
        for v, kids in enumerate(self.children):
            if kids:
                keys.update(kids[:-1])
                nested[v] = max([nested[kids[-1]]] + [nested[k] + 1 for k in kids[:-1]])
        return _grouped(sorted(keys), nested)


def _grouped(ids, group) -> list[np.ndarray]:
    found: dict = {}
    for v in ids:
        found.setdefault(group[v], []).append(v)
    return [np.array(found[g]) for g in sorted(found)]


class Suffixes:
    """Pre-order positions of several right-hand trees, padded to one width."""

    def __init__(self, side: Side, ids):
        orders = [side.preorder(v) for v in ids]
        width = max(len(o) for o in orders)
        self.node = np.full((len(orders), width), side.n)
        for row, order in enumerate(orders):
            self.node[row, : len(order)] = order
        place = np.arange(width)
        length = np.array([len(o) for o in orders])[:, None]
        self.left = np.maximum(length - np.arange(width + 1), 0).astype(float)
        self.after = np.minimum(place + side.size[self.node].astype(int), width)
        self.spine = (self.node < side.n) & (self.after == length)

    def settle(self, best: np.ndarray) -> np.ndarray:
        """Allow right-hand nodes to be dropped one by one from the front."""
        gain = (best - self.left)[:, ::-1]
        return self.left + np.minimum.accumulate(gain, axis=1)[:, ::-1]


def relabel_costs(a: Side, b: Side, weight: float, exact: bool) -> np.ndarray:
    other = np.inf if exact else weight
    return np.where(a.label[:, None] == b.label[None, :], 0.0, other)


def _edit(a: Side, b: Side, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered edit distance of all subtree pairs, and of their forests of children."""
    padded = np.full((a.n, b.n + 1), np.inf)
    padded[:, : b.n] = cost
    tree = np.full((a.n, b.n + 1), np.inf)
    forest = np.full((a.n, b.n), np.inf)
    batches = [Suffixes(b, ids) for ids in b.keyroots()]
    for u in np.sort(np.concatenate(a.keyroots())):
        order = a.preorder(int(u))
        for right in batches:
            spine_nodes = right.node[right.spine]
            rows = [None] * len(order) + [right.left]
            for i in range(len(order) - 1, -1, -1):
                node, end = order[i], i + int(a.size[order[i]])
                best = rows[i + 1] + 1.0
                match = tree[node][right.node] + np.take_along_axis(rows[end], right.after, 1)
                if end == len(order):
                    inner = rows[i + 1][:, 1:]
                    match = np.where(right.spine, padded[node][right.node] + inner, match)
                best[:, :-1] = np.minimum(best[:, :-1], match)
                rows[i] = right.settle(best)
                if end == len(order):
                    tree[node, spine_nodes] = rows[i][:, :-1][right.spine]
                    forest[node, spine_nodes] = inner[right.spine]
    return tree[:, : b.n], forest


def _one_pair(a: Side, b: Side, rooted: np.ndarray) -> np.ndarray:
    """Best single pair of roots anywhere inside; everything outside it is deleted."""
    best = rooted - a.size[:-1, None] - b.size[None, :-1]
    for u, kids in enumerate(a.children):
        for t in kids:
            best[u] = np.minimum(best[u], best[t])
    for v, kids in enumerate(b.children):
        for w in kids:
            best[:, v] = np.minimum(best[:, v], best[:, w])
    return np.minimum(best, 0.0) + a.size[:-1, None] + b.size[None, :-1]


def tile_distances(a: Side, b: Side, shape: str, exact: bool, weight: float):
    """Matrix of the distances of the trees of ``a`` (rows) and ``b`` (columns); shape f or t."""
    cost = relabel_costs(a, b, weight, exact)
    trees, forests = _edit(a, b, cost)
    table = _one_pair(a, b, cost + forests) if shape == "t" else trees
    return table[np.ix_(a.roots, b.roots)]
