"""Hierarchical navigable small-world graph over unit vectors, searched for many queries at once.

Nodes stand in the order of falling level, so that level ``l`` holds the first ``sizes[l]`` nodes
under the same numbers.  Each level is built by inserting its nodes in batches: a batch is searched
in what is there, compared with itself, and linked to diverse neighbours in both directions.
Beams of many queries advance side by side as arrays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

DEGREE = 12  # links of a node on the upper levels; twice as many on the lowest
BUILD_BEAM = 48
BATCH = 256  # nodes inserted at once, at most as many as are there
QUERIES = 512  # beams that advance side by side
_NONE = np.float32(-2.0)  # less than any cosine


def _similar(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.einsum("amd,ad->am", vectors[ids], queries, optimize=True)


def _top(ids: np.ndarray, sims: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` most similar of each row, in falling order."""
    if sims.shape[1] > k:
        some = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims, *more = (np.take_along_axis(x, some, 1) for x in (ids, sims, *more))
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, sims, *more))


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Of each row's candidates (in falling order, -1 for none) ``k`` that are nearer to the row than to each other.

    Places left over go to the nearest of those passed over.
    """
    out = np.full((len(ids), k), -1, np.int32)
    for low in range(0, len(ids), BATCH):
        some, near = ids[low : low + BATCH], sims[low : low + BATCH]
        points = vectors[some]
        among = points @ points.transpose(0, 2, 1)
        kept = np.zeros(some.shape, bool)
        closest = np.full(some.shape, _NONE, np.float32)
        for c in range(some.shape[1]):
            good = (some[:, c] >= 0) & (closest[:, c] < near[:, c]) & (kept.sum(1) < k)
            kept[:, c] = good
            closest[good] = np.maximum(closest[good], among[good, c])
        order = np.argsort(np.where(kept, 0, np.where(some >= 0, 1, 2)), axis=1, kind="stable")[:, :k]
        out[low : low + BATCH, : order.shape[1]] = np.take_along_axis(some, order, 1)
    return out


@dataclass
class Graph:
    """``links[l][i]`` are the neighbours of node ``i`` on level ``l``, -1 for none."""

    vectors: np.ndarray
    links: list[np.ndarray]

    @classmethod
    def build(cls, vectors: np.ndarray, chance: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph of ``vectors`` (unit, 32 bits) and their order in it; ``chance`` (0 to 1) sets the levels."""
        level = np.floor(-np.log(np.maximum(chance, 1e-12)) / math.log(DEGREE)).astype(int)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        vectors = np.ascontiguousarray(vectors[order], np.float32)
        # A level of very few nodes leads nowhere.
        levels = [0] + [l for l in range(1, int(level.max(initial=0)) + 1) if (level >= l).sum() > DEGREE]
        sizes = [int((level >= l).sum()) for l in levels]
        graph = cls(vectors, [np.full((n, DEGREE * (1 if l else 2)), -1, np.int32) for l, n in enumerate(sizes)])
        for l in reversed(range(len(sizes))):
            graph._fill(l)
        return graph, order

    def _fill(self, level: int) -> None:
        links = self.links[level]
        size, k = links.shape
        done = 0
        while done < size:
            stop = min(done + max(min(BATCH, done), 2 * k), size)
            new = np.arange(done, stop)
            queries = self.vectors[done:stop]
            own = queries @ queries.T
            np.fill_diagonal(own, _NONE)
            ids, sims = np.broadcast_to(new.astype(np.int32), own.shape), own
            ids = np.where(sims > _NONE, ids, -1)
            if done:
                entry = self._entry(queries, level)
                # While the first nodes are put in, a way down may end at one that is yet to come.
                found, near = self._beam(queries, level, np.where(entry < done, entry, 0), BUILD_BEAM, done)
                ids, sims = np.concatenate([found, ids], 1), np.concatenate([near, sims], 1)
            ids, sims = _top(ids, sims, BUILD_BEAM)
            links[done:stop] = _diverse(self.vectors, ids, sims, k)
            self._link_back(links, new)
            done = stop

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Links to the new nodes from their neighbours, which keep only diverse ones."""
        k = links.shape[1]
        src, dst = np.repeat(new, k), links[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        sims = np.einsum("ad,ad->a", self.vectors[src], self.vectors[dst])
        order = np.lexsort((-sims, dst))
        src, dst = src[order], dst[order]
        nodes, first = np.unique(dst, return_index=True)
        place = np.arange(len(dst)) - np.repeat(first, np.diff(np.append(first, len(dst))))
        near = place < k  # of very many new links the nearest
        wanted = np.full((len(nodes), k), -1, np.int32)
        wanted[np.searchsorted(nodes, dst[near]), place[near]] = src[near]
        old = links[nodes]
        # A link that is there already (two new nodes that chose each other) counts once.
        for c in range(k):
            wanted[(wanted == old[:, c : c + 1]) & (wanted >= 0)] = -1
        ids = np.concatenate([old, wanted], 1)
        sims = np.where(ids >= 0, _similar(self.vectors, ids, self.vectors[nodes]), _NONE)
        ids, sims = _top(ids, sims, 2 * k)
        full = (ids >= 0).sum(1) > k
        links[nodes[~full]] = ids[~full, :k]
        if full.any():
            links[nodes[full]] = _diverse(self.vectors, ids[full], sims[full], k)

    def _entry(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Where to start on a level: the node found by walking down the levels above."""
        at = np.zeros(len(queries), np.int32)
        for l in range(len(self.links) - 1, level, -1):
            ids, _ = self._beam(queries, l, at, 4, len(self.links[l]))
            at = ids[:, 0]
        return at

    def _beam(self, queries: np.ndarray, level: int, entry: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most similar nodes that a beam of that width meets, among the first ``size``."""
        found, near = [], []
        for low in range(0, len(queries), QUERIES):
            ids, sims = self._walk(queries[low : low + QUERIES], level, entry[low : low + QUERIES], width, size)
            found.append(ids)
            near.append(sims)
        return np.concatenate(found), np.concatenate(near)

    def _walk(self, queries: np.ndarray, level: int, entry: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.links[level], len(queries)
        ids, sims = np.full((n, width), -1, np.int32), np.full((n, width), _NONE, np.float32)
        open_ = np.zeros((n, width), bool)
        seen = np.zeros((n, size), bool)
        ids[:, 0], open_[:, 0] = entry, True
        sims[:, 0] = np.einsum("ad,ad->a", self.vectors[entry], queries)
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            best = np.argmax(np.where(open_[active], sims[active], _NONE), axis=1)
            going = open_[active, best]
            active, best = active[going], best[going]
            if not len(active):
                break
            open_[active, best] = False
            around = links[ids[active, best]]
            fresh = (around >= 0) & (around < size)
            around = np.where(fresh, around, 0)
            fresh &= ~seen[active[:, None], around]
            seen[active[:, None], around] |= fresh
            near = np.where(fresh, _similar(self.vectors, around, queries[active]), _NONE)
            all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], 1)
            all_sims = np.concatenate([sims[active], near], 1)
            all_open = np.concatenate([open_[active], fresh], 1)
            some = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active], open_[active] = (np.take_along_axis(x, some, 1) for x in (all_ids, all_sims, all_open))
        return _top(ids, sims, width)

    def within(self, queries: np.ndarray, least: float, width: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of a cosine of about ``least`` or more, for at most ``QUERIES`` queries.

        A beam finds the neighbourhood; from its nodes the search then spreads through all nodes of
        at least ``least - slack``, however many there are.
        """
        n = len(self.vectors)
        ids, sims = self._beam(queries, 0, self._entry(queries, 0), min(width, n), n)
        seen = np.zeros((len(queries), n), bool)
        q, c = np.nonzero(sims >= least - slack)
        node, near = ids[q, c], sims[q, c]
        seen[q, node] = True
        found = [(q[near >= least], node[near >= least])]
        while len(q):
            next_q, next_node = [], []
            for low in range(0, len(q), 1 << 15):
                part = slice(low, low + (1 << 15))
                around = self.links[0][node[part]]
                a, c = np.nonzero((around >= 0) & ~seen[q[part][:, None], np.maximum(around, 0)])
                pairs = np.unique(q[part][a].astype(np.int64) * n + around[a, c])
                nq, nn = pairs // n, (pairs % n).astype(np.int32)
                seen[nq, nn] = True
                near = np.einsum("ad,ad->a", self.vectors[nn], queries[nq])
                good = near >= least
                found.append((nq[good], nn[good]))
                on = near >= least - slack
                next_q.append(nq[on])
                next_node.append(nn[on])
            q, node = np.concatenate(next_q), np.concatenate(next_node)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
