"""Build and search a robust-pruned neighbour graph of one block of unit vectors; plain numpy, a block is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest entry is scaled first, so nothing overflows."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0))) if len(x) else 0


def build(x: np.ndarray, least: float, degree: int = 20, candidates: int = 48, alpha: float = 1.2, strides: int = 4) -> list[np.ndarray]:
    """Neighbours of every node. Of a node's nearest candidates the closest is kept, and with it go those that it
    is closer to, by ``alpha``, than the node is; the next is kept, and so on. A few fixed strides over the block keep it in one piece.
    Besides, ``_range_edges`` in both directions make the range search from a node of the graph complete."""
    n = len(x)
    wide = min(candidates, n - 1)
    if wide < 1:
        return [np.empty(0, np.int64)] * n
    edges = np.full((n, degree + strides), -1, np.int64)
    step = max(16, min(512, (1 << 22) // (wide * x.shape[1])))  # candidates' vectors take 32 MB at most
    ranged: list[tuple[int, np.ndarray]] = []
    for start in range(0, n, step):
        rows = np.arange(start, min(start + step, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        ranged += [(row, _range_edges(x, row, own, least)) for row, own in zip(rows.tolist(), sims) if own.max() >= least - 1e-9]
        near = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        near_sims = np.take_along_axis(sims, near, 1)
        order = np.argsort(-near_sims, axis=1)
        near, near_sims = np.take_along_axis(near, order, 1), np.take_along_axis(near_sims, order, 1)
        among = np.einsum("rcd,red->rce", x[near], x[near], optimize=True)
        alive = np.ones(near.shape, bool)
        at = np.arange(len(rows))
        for slot in range(degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            best = alive.argmax(axis=1)
            edges[rows[some], slot] = near[at[some], best[some]]
            closer = alpha**2 * (2 - 2 * among[at, best]) <= 2 - 2 * near_sims
            alive &= ~closer
            alive[at, best] = False
    for i in range(strides):
        step = 1 + (n - 1) * (2 * i + 1) // (2 * strides + 1) if i else 1
        edges[:, degree + i] = (np.arange(n) + step) % n if step % n else -1
    at, slot = np.nonzero(edges >= 0)
    a = np.repeat([row for row, _ in ranged], [len(kept) for _, kept in ranged]).astype(np.int64)
    b = np.concatenate([np.empty(0, np.int64), *[kept for _, kept in ranged]])
    key = np.unique(np.concatenate([at * n + edges[at, slot], a * n + b, b * n + a]))
    return np.split(key % n, np.searchsorted(key // n, np.arange(1, n)))


def _range_edges(x: np.ndarray, row: int, sims: np.ndarray, least: float) -> np.ndarray:
    """All nodes in range of ``row``, pruned without any limit: a node goes only if one that is kept is nearer to it than ``row`` is.

    So whatever is in range of a node q either has q in its list or a node nearer to q, which is thus in range of q too. Followed backwards, such
    steps lead from q to every node in its range, through nodes in its range alone. Nodes at one place meet through the first of them."""
    near = np.flatnonzero(sims >= least - 1e-9)
    gaps = 2 - 2 * sims[near]
    same = gaps < 1e-12
    first = min(row, int(near[same].min(initial=row)))
    kept = [first] if first != row else []
    near, gaps = near[~same], gaps[~same]
    order = np.argsort(gaps, kind="stable")
    near, gaps = near[order], gaps[order]
    others = x[near]
    while len(near):
        kept.append(int(near[0]))
        stay = 2 - 2 * others @ others[0] >= gaps - 1e-12
        stay[0] = False
        near, gaps, others = near[stay], gaps[stay], others[stay]
    return np.array(kept, np.int64)


class Lists:
    """Lists of neighbours end to end: a hub may have a list as long as the block."""

    def __init__(self, edges: list[np.ndarray]):
        self.starts = np.concatenate([[0], np.cumsum([len(e) for e in edges])]).astype(np.int64)
        self.nodes = np.concatenate([np.empty(0, np.int64), *edges])

    def pairs(self, who: np.ndarray, nodes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, neighbour) for every neighbour of a query's node, in parts of about ``most`` pairs that don't cut a list."""
        counts = self.starts[nodes + 1] - self.starts[nodes]
        ends = np.cumsum(counts)
        at = 0
        while at < len(nodes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + most, "right")))
            part = counts[at:to]
            place = np.arange(part.sum()) + np.repeat(self.starts[nodes[at:to]] - np.cumsum(part) + part, part)
            yield np.repeat(who[at:to], part), self.nodes[place]
            at = to


def search(x: np.ndarray, lists: Lists, start: int, own: np.ndarray, queries: np.ndarray, least: float, beam: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with similarity at least ``least``. A query that is a node of the block (``own``, else -1) begins with its own list; the
    others walk in step, greedy with a beam from ``start``. Then the range is expanded from every node found within it, which finds
    all that is in range of a query in the block. For the others an exact check follows, which adds what the walk didn't come by."""
    n, q = len(x), len(queries)
    visited = np.zeros((q, n), bool)
    found, open_pairs = [], []

    def meet(who: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Similarities of new (query, node) pairs; keeps those within the range."""
        new = ~visited[who, nodes]
        key = np.unique(who[new] * n + nodes[new])
        who, nodes = key // n, key % n
        visited[who, nodes] = True
        sims = np.empty(len(who))
        for i in range(0, len(who), 65536):
            part = slice(i, i + 65536)
            sims[part] = np.einsum("ij,ij->i", x[nodes[part]], queries[who[part]])
        near = sims >= least
        found.append((who[near], nodes[near]))
        open_pairs.append(found[-1])
        return who, nodes, sims

    def merge(who: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> None:
        """Put new pairs into the beams: the best ``beam`` of old and new."""
        nonlocal beam_n, beam_s, open_
        order = np.lexsort((-sims, who))
        who, nodes, sims = who[order], nodes[order], sims[order]
        counts = np.bincount(who, minlength=q)
        column = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        best = column < beam
        more_n, more_s = np.zeros((q, beam), np.int64), np.full((q, beam), -np.inf)
        more_n[who[best], column[best]], more_s[who[best], column[best]] = nodes[best], sims[best]
        all_n, all_s = np.hstack([beam_n, more_n]), np.hstack([beam_s, more_s])
        all_o = np.hstack([open_, np.isfinite(more_s)])
        best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        beam_n, beam_s, open_ = (np.take_along_axis(a, best, 1) for a in (all_n, all_s, all_o))

    inside, outside = np.flatnonzero(own >= 0), np.flatnonzero(own < 0)
    visited[inside, own[inside]] = True
    for pairs in lists.pairs(inside, own[inside]):
        meet(*pairs)
    beam_n, beam_s, open_ = np.zeros((q, beam), np.int64), np.full((q, beam), -np.inf), np.zeros((q, beam), bool)
    merge(*meet(outside, np.full(len(outside), start)))
    while open_.any():
        active = np.flatnonzero(open_.any(axis=1))
        best = np.where(open_[active], beam_s[active], -np.inf).argmax(axis=1)
        open_[active, best] = False
        for pairs in lists.pairs(active, beam_n[active, best]):
            merge(*meet(*pairs))
    while open_pairs:
        who, nodes = (np.concatenate(part) for part in zip(*open_pairs))
        open_pairs.clear()
        for pairs in lists.pairs(who, nodes):
            meet(*pairs)
    who, nodes = np.nonzero(queries[outside] @ x.T >= least - 1e-9)
    meet(outside[who], nodes)
    return tuple(np.concatenate(part) for part in zip(*found))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that join what the links (a, b) join: at most one for each node."""
    names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[:len(a)], places[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]
