"""Tree distances by listing mappings: independent of the recurrences under test.

A mapping is a set of node pairs (u, v), u in x, v in y, one to one; its cost is the number of
unmapped nodes plus the relabel costs.  Each shape allows some of the mappings.
"""

from itertools import combinations


def parse(text):
    """Nodes (label, parent) in pre-order."""
    nodes, stack, name, last = [], [None], "", None
    for c in text + ",":
        if c in "(),":
            if name:
                nodes.append((name, stack[-1]))
                last, name = len(nodes) - 1, ""
            if c == "(":
                stack.append(last)
            elif c == ")":
                stack.pop()
        else:
            name += c
    return nodes


def ancestors(nodes, u):
    out = []
    while nodes[u][1] is not None:
        u = nodes[u][1]
        out.append(u)
    return out


def above(nodes):
    return [set(ancestors(nodes, u)) for u in range(len(nodes))]


def ordered_mappings(x, y):
    """Mappings that keep ancestors and order from left to right."""
    ax, ay = above(x), above(y)
    pairs = [(u, v) for u in range(len(x)) for v in range(len(y))]

    def fits(p, q):
        (u, v), (s, t) = sorted((p, q))
        return u < s and v < t and (u in ax[s]) == (v in ay[t])

    def grow(chosen, start):
        yield chosen
        for k in range(start, len(pairs)):
            if all(fits(pairs[k], c) for c in chosen):
                yield from grow(chosen + [pairs[k]], k + 1)

    yield from grow([], 0)


def meet(nodes, u, v):
    """Lowest common ancestor, a node counting as its own."""
    path = [u] + ancestors(nodes, u)
    other = {v, *ancestors(nodes, v)}
    return next((w for w in path if w in other), None)


def allowed(shape, gap, x, y, mapping):
    ax, ay = above(x), above(y)
    mx, my = dict(mapping), {v: u for u, v in mapping}
    tops = [(u, v) for u, v in mapping if not any(a in mx for a in ax[u])]
    if shape == "p":
        chain = all(p[0] in ax[q[0]] for p, q in combinations(sorted(mapping), 2))
        linked = all(
            x[q[0]][1] == p[0] and y[q[1]][1] == p[1]
            for p, q in zip(sorted(mapping), sorted(mapping)[1:])
        )
        return chain and (gap or linked)
    if shape == "t" and len(tops) > 1:
        return False
    if shape == "a":
        if len(tops) != 1:
            return False
        kept_x, kept_y = set(mx), set(my)
        return all(
            meet(x, p[0], q[0]) in kept_x and mx[meet(x, p[0], q[0])] == meet(y, p[1], q[1])
            for p, q in combinations(mapping, 2)
        ) and bool(kept_y)
    if shape == "s":
        # Three nodes: below the meet of two on one side exactly when on the other.
        for p, q, r in ((a, b, c) for a, b in combinations(mapping, 2) for c in mapping):
            mxy = meet(x, p[0], q[0]), meet(y, p[1], q[1])
            if None in mxy:
                continue
            strictly_x = mxy[0] in ax[r[0]]
            strictly_y = mxy[1] in ay[r[1]]
            if strictly_x != strictly_y:
                return False
        return True
    if not gap:
        # Below a mapped pair every mapped node hangs on a mapped parent, pair by pair.
        return all(
            x[u][1] in mx and mx[x[u][1]] == y[v][1]
            for u, v in mapping
            if any(a in mx for a in ax[u])
        )
    return True


def distance(shape, gap, exact, weight, a, b, costs=None):
    """``costs`` has the costs of some pairs of labels, as frozensets; the others cost ``weight``."""
    x, y = parse(a), parse(b)
    best = None
    for mapping in ordered_mappings(x, y):
        if exact and any(x[u][0] != y[v][0] for u, v in mapping):
            continue
        if not allowed(shape, gap, x, y, mapping):
            continue
        cost = len(x) + len(y) - 2 * len(mapping)
        pairs = [frozenset((x[u][0], y[v][0])) for u, v in mapping if x[u][0] != y[v][0]]
        cost += sum((costs or {}).get(pair, weight) for pair in pairs)
        best = cost if best is None else min(best, cost)
    return 100000000.0 if best is None else best
