"""Nearest points, exactly: points and queries in blocks of neighbours, and only blocks whose boxes are near enough meet."""

from __future__ import annotations

import numpy as np

#: Points of a block, about.
BLOCK = 64


def _blocks(points: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the points, halved along the widest side of their box until ``most`` are left; equal ones by id."""
    out, todo = [], [np.arange(len(points))] if len(points) else []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        part = points[at]
        wide = np.argmax(part.max(axis=0) - part.min(axis=0))
        at = at[np.lexsort((ids[at], part[:, wide]))]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return out


def nearest(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, most: float = np.inf, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, places of points), each (queries, k): the k nearest points in order, of equals the smaller id; infinity
    and -1 where fewer are within ``most``."""
    d2, found = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
    leaves = _blocks(points, ids, block)
    if not leaves:
        return d2, found
    lo, hi = np.stack([points[x].min(axis=0) for x in leaves]), np.stack([points[x].max(axis=0) for x in leaves])
    least = np.array([ids[x].min() for x in leaves])
    for rows in _blocks(queries, np.arange(len(queries)), block):
        q = queries[rows]
        gap = np.maximum(np.maximum(lo - q.max(axis=0), q.min(axis=0) - hi), 0.0)
        far = sum(gap[:, c] * gap[:, c] for c in range(points.shape[1]))
        order = np.lexsort((least, far))
        best, at, step, done = np.full((len(q), k), np.inf), np.full((len(q), k), -1), 2, 0
        while done < len(order):
            # A block may hold a closer point, or one as far as the last with a smaller id.
            last = best[:, -1].max()
            tied = best[:, -1] == last
            worst = ids[at[tied, -1]].max() if np.isfinite(last) else 0
            some = order[done : done + step]
            done, step = done + step, min(2 * step, 32)
            if far[some[0]] > min(last, most * most):
                break
            use = some[(far[some] <= most * most) & ((far[some] < last) | (far[some] == last) & (least[some] < worst))]
            if not len(use):
                continue
            place = np.concatenate([leaves[x] for x in use])
            apart = sum((q[:, c, None] - points[place, c]) ** 2 for c in range(points.shape[1]))
            every, who = np.concatenate([best, apart], axis=1), np.concatenate([at, np.broadcast_to(place, apart.shape)], axis=1)
            kth = np.partition(every, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero((every <= kth) & (every <= most * most) & (who >= 0))
            by = np.lexsort((ids[who[i, j]], every[i, j], i))
            i, j = i[by], j[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, rank = i[rank < k], j[rank < k], rank[rank < k]
            new, whose = np.full_like(best, np.inf), np.full_like(at, -1)
            new[i, rank], whose[i, rank] = every[i, j], who[i, j]
            best, at = new, whose
        d2[rows], found[rows] = best, at
    return d2, found
