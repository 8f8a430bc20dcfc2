"""Edit distance between schema trees whose siblings have no order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    name: str
    kind: str | None  # None: only nulls were seen
    children: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


@dataclass
class Step:
    """One step of a script; paths are tuples of names from the root."""

    action: str  # added, removed, renamed, retyped, moved
    old: tuple[str, ...]
    new: tuple[str, ...]
    cost: float = 1.0


def build(paths: list[tuple[str, str | None]]) -> Node:
    """A tree from (path, kind) rows; the parts of a path are joined by ``\\x1f``."""
    root = Node("", "object")
    for path, kind in sorted(paths, key=lambda p: p[0].count("\x1f")):
        at, parts = root, path.split("\x1f")
        for p in parts[:-1]:
            at = at.children.setdefault(p, Node(p, None))
        at.children[parts[-1]] = Node(parts[-1], kind)
    return root


def assign(cost: np.ndarray) -> list[int]:
    """Least-cost assignment of the rows of a square matrix to its columns (shortest augmenting paths)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while True:
            used[j0] = True
            free = ~used[1:]
            slack = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j0
            j1 = int(np.flatnonzero(free)[np.argmin(least[1:][free])]) + 1
            step = least[j1]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0], j0 = row_of[back[j0]], back[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


#: The price of giving a node another name: of (old path, new path, old node, new node), or None where that isn't possible.
Rename = Callable[[tuple[str, ...], tuple[str, ...], Node, Node], float | None]


def edit_script(old: Node, new: Node, rename: Rename) -> tuple[float, list[Step]]:
    """The least cost and the steps that turn ``old`` into ``new``; the costs of the steps add up to it.

    Adding or removing a node costs 1, changing its kind 1, a new name what ``rename`` says, at any depth. Siblings of the
    same name stay each other; the others are matched by a least-cost assignment. A node may also move, with all below it and under its name, to another
    parent for 1. All choices of moves are weighed (those that can't pay are passed over), so the minimum is over names, kinds and moves together.
    """
    steps: list[Step] = []
    best = _children(old, new, (), (), rename, steps)
    found: list[tuple[tuple[str, ...], tuple[str, ...], int]] = []
    olds, news = dict(_below(old, ())), dict(_below(new, ()))
    by_name: dict[str, list[tuple[str, ...]]] = {}
    for q in news:
        by_name.setdefault(q[-1], []).append(q)
    for p, x in olds.items():
        found += [(p, q, x.size()) for q in by_name.get(p[-1], ()) if q[:-1] != p[:-1] and (p not in news or q not in olds) and _same(x, news[q])]
    found.sort(key=lambda f: (-f[2], f[0], f[1]))
    gains = np.cumsum([2 * n - 1 for *_, n in found][::-1])[::-1].tolist() + [0]

    def search(i: int, taken: list[tuple[tuple[str, ...], tuple[str, ...]]], a: Node, b: Node, cost: float) -> None:
        """Weigh the moves from the i-th on; ``cost`` is that of the script with the moves taken."""
        nonlocal best, steps
        if cost - gains[i] >= best - 1e-9:
            return
        for j in range(i, len(found)):
            p, q, _ = found[j]
            if cost - gains[j] >= best - 1e-9:
                return
            if any(_inside(p, x) or _inside(x, p) or _inside(q, y) or _inside(y, q) for x, y in taken):
                continue
            c, d = _without(a, p), _without(b, q)
            some: list[Step] = []
            now = [*taken, (p, q)]
            total = _children(c, d, (), (), rename, some) + len(now)
            if total < best - 1e-9:
                best, steps = total, some + [Step("moved", x, y) for x, y in now]
            search(j + 1, now, c, d, total)

    search(0, [], old, new, best)
    return best, steps


def _below(node: Node, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], Node]]:
    for name, c in node.children.items():
        yield (*path, name), c
        yield from _below(c, (*path, name))


def _inside(p: tuple[str, ...], q: tuple[str, ...]) -> bool:
    return p[: len(q)] == q


def _without(node: Node, path: tuple[str, ...]) -> Node:
    head, rest = path[0], path[1:]
    kept = {k: c for k, c in node.children.items() if rest or k != head}
    if rest:
        kept[head] = _without(kept[head], rest)
    return Node(node.name, node.kind, kept)


def _children(a: Node, b: Node, pa: tuple[str, ...], pb: tuple[str, ...], rename: Rename, steps: list[Step]) -> float:
    total = 0.0
    for name in sorted(a.children.keys() & b.children.keys()):
        x, y = a.children[name], b.children[name]
        if x.kind and y.kind and x.kind != y.kind:
            steps.append(Step("retyped", (*pa, name), (*pb, name)))
            total += 1
        total += _children(x, y, (*pa, name), (*pb, name), rename, steps)
    gone = [a.children[k] for k in sorted(a.children.keys() - b.children.keys())]
    come = [b.children[k] for k in sorted(b.children.keys() - a.children.keys())]
    taken, given = set(), set()
    if gone and come:
        n = len(gone) + len(come)
        cost = np.zeros((n, n))
        cost[: len(gone), len(come) :] = np.array([g.size() for g in gone], dtype=float)[:, None]
        cost[len(gone) :, : len(come)] = np.array([c.size() for c in come], dtype=float)[None, :]
        names = np.full((len(gone), len(come)), np.nan)
        for i, g in enumerate(gone):
            for j, c in enumerate(come):
                price = rename((*pa, g.name), (*pb, c.name), g, c)
                names[i, j] = np.nan if price is None else price
                cost[i, j] = 1e6 if price is None else price + _children(g, c, (*pa, g.name), (*pb, c.name), rename, [])
        for i, j in enumerate(assign(cost)[: len(gone)]):
            if j < len(come) and cost[i, j] < gone[i].size() + come[j].size():
                g, c = gone[i], come[j]
                taken.add(i)
                given.add(j)
                steps.append(Step("renamed", (*pa, g.name), (*pb, c.name), float(names[i, j])))
                total += float(names[i, j]) + _children(g, c, (*pa, g.name), (*pb, c.name), rename, steps)
    for side, done, what in ((gone, taken, "removed"), (come, given, "added")):
        for i, x in enumerate(side):
            if i not in done:
                steps.append(Step(what, (*pa, x.name) if what == "removed" else (), (*pb, x.name) if what == "added" else (), float(x.size())))
                total += x.size()
    return total


def _same(a: Node, b: Node) -> bool:
    return a.kind == b.kind and a.children.keys() == b.children.keys() and all(_same(a.children[k], b.children[k]) for k in a.children)
