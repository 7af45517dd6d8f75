"""A flat proximity graph in numpy: robust pruning, greedy search and range expansion. Small helpers of operator 1.

Vectors are unit rows in double precision, a shard or part of one at most; a graph is an (n, degree) matrix of neighbour numbers, -1 where there is none.
"""

from __future__ import annotations

import numpy as np


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def _prune(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: for each of ``of``, nearest candidates first, leaving out those that a chosen one covers (alpha times nearer)."""
    cand = np.where(cand == of[:, None], -1, cand)
    order = np.sort(cand, axis=1)
    twice = np.zeros_like(order, bool)
    twice[:, 1:] = order[:, 1:] == order[:, :-1]
    cand = np.where(twice, -1, order)
    sim = np.where(cand >= 0, np.einsum("pd,pcd->pc", x[of], x[cand]), -np.inf)
    rank = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, rank, 1), np.take_along_axis(sim, rank, 1)
    vectors = x[cand]
    far = 1 - np.matmul(vectors, vectors.transpose(0, 2, 1))
    to = 1 - sim
    alive, out, row = cand >= 0, np.full((len(of), degree), -1, np.int64), np.arange(len(of))
    for r in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = alive.argmax(axis=1)
        out[some, r] = cand[row[some], at[some]]
        alive &= ~(some[:, None] & (alpha * far[row, at] <= to))
        alive[row[some], at[some]] = False
    return out


def build(x: np.ndarray, degree: int = 24, near: int = 40, far: int = 8, alpha: float = 1.2, seed: int = 3) -> np.ndarray:
    """The graph of all rows: each one's candidates are its ``near`` nearest rows, ``far`` seeded ones and the medoid, pruned; then links
    the other way are offered to each list, which is pruned again. Candidates come from products of 256 rows with all.
    """
    n = len(x)
    if n <= degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        return np.where(every == np.arange(n)[:, None], -1, every)
    graph, root = np.full((n, degree), -1, np.int64), medoid(x)
    random = np.random.default_rng(seed).integers(0, n, (n, far))
    for k in range(0, n, 256):
        some = np.arange(k, min(n, k + 256))
        sim = x[some] @ x.T
        sim[np.arange(len(some)), some] = -np.inf
        nearest = np.argpartition(-sim, min(near, n - 1) - 1, axis=1)[:, :near]
        graph[some] = _prune(x, some, np.c_[nearest, random[some], np.full(len(some), root)], degree, alpha)
    source, target = np.repeat(np.arange(n), degree), graph.ravel()
    source, target = source[target >= 0], target[target >= 0]
    rank = np.argsort(target, kind="stable")
    source, target = source[rank], target[rank]
    column = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, int(column.max()) + 1), -1, np.int64)
    back[target, column] = source
    out = np.empty_like(graph)
    for k in range(0, n, 256):
        some = np.arange(k, min(n, k + 256))
        cand = np.c_[graph[some], back[some]]
        if cand.shape[1] > degree + 40:  # a hub: its nearest are enough to prune from
            sim = np.where(cand >= 0, np.einsum("pd,pcd->pc", x[some], x[cand]), -np.inf)
            cand = np.take_along_axis(cand, np.argpartition(-sim, degree + 39, axis=1)[:, : degree + 40], 1)
        out[some] = _prune(x, some, cand, degree, alpha)
    return out


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, seen: np.ndarray, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam search of all queries at once: (codes, similarities) of every (query, node) pair met; a code is query * len(x) + node.

    ``seen`` is a flat mark a code; what is met is marked in it.
    """
    n, q = len(x), len(queries)
    ids, sims, done = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf), np.ones((q, beam), bool)
    m = min(start.shape[1], beam)
    ids[:, :m] = start[:, :m]
    ok = ids >= 0
    row = np.nonzero(ok)[0]
    sims[ok] = similar(queries, x, row, ids[ok])
    met, at = [row * n + ids[ok]], [sims[ok]]
    seen[met[0]] = True
    done[ok] = False
    live = np.arange(q)
    while len(live):
        rank = np.argpartition(np.where(done[live], np.inf, -sims[live]), min(width, beam) - 1, axis=1)[:, :width]
        pick = ~np.take_along_axis(done[live], rank, 1)
        some = pick.any(axis=1)
        live, rank, pick = live[some], rank[some], pick[some]
        if not len(live):
            break
        r, c = np.nonzero(pick)
        done[live[r], rank[r, c]] = True
        near = graph[ids[live[r], rank[r, c]]]
        code = (live[r][:, None] * n + near)[near >= 0]
        code = np.unique(code[~seen[code]])
        if not len(code):
            continue
        seen[code] = True
        owner = code // n
        sim = similar(queries, x, owner, code % n)
        met.append(code)
        at.append(sim)
        rows, first, size = np.unique(owner, return_index=True, return_counts=True)
        wide = int(size.max())
        column, place = np.arange(len(owner)) - np.repeat(first, size), np.repeat(np.arange(len(rows)), size)
        new_ids, new_sims = np.full((len(rows), wide), -1, np.int64), np.full((len(rows), wide), -np.inf)
        new_ids[place, column], new_sims[place, column] = code % n, sim
        all_ids, all_sims, all_done = np.c_[ids[rows], new_ids], np.c_[sims[rows], new_sims], np.c_[done[rows], new_ids < 0]
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    return np.concatenate(met), np.concatenate(at)


def _both_ways(graph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each node's list begins, the lists end to end) of the undirected graph."""
    n = len(graph)
    a, b = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = a[b >= 0], b[b >= 0]
    code = np.unique(np.r_[a * n + b, b * n + a])
    return np.searchsorted(code // n, np.arange(n + 1)), code % n


def similar(queries: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each (query, node) pair, some at a time."""
    return np.concatenate([np.einsum("id,id->i", queries[a[s : s + 16384]], x[b[s : s + 16384]]) for s in range(0, max(1, len(a)), 16384)])


def in_range(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, beam: int, margin: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of similarity ``least`` or more: a greedy search from the medoid (and, for a query that is a node, from
    itself), then an expansion of every node met within ``least - margin`` until nothing new is. The expansion follows links both
    ways: the many that pruning left with one shared neighbour are in no list that it has room for.
    """
    n, found = len(x), [np.zeros(0, np.int64)]
    begin, ends = _both_ways(graph)
    root = medoid(x)
    for k in range(0, len(queries), 512):
        q, mine = queries[k : k + 512], own[k : k + 512]
        seen = np.zeros(len(q) * n, bool)
        code, sim = search(x, graph, q, np.c_[np.full(len(q), root), np.where(mine == root, -1, mine)], beam, seen)
        while len(code):
            found.append(code[sim >= least] + k * n)
            wide, fresh = code[sim >= least - margin], []
            for s in range(0, len(wide), 8192):
                some = wide[s : s + 8192]
                size = begin[some % n + 1] - begin[some % n]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                near = np.repeat(some - some % n, size) + ends[np.repeat(begin[some % n], size) + place]
                fresh.append(np.unique(near[~seen[near]]))
                seen[fresh[-1]] = True
            code = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
            sim = similar(q, x, code // n, code % n)
    every = np.concatenate(found)
    return every // n, every % n
