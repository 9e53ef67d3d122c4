"""Weighted least squares of differences on large graphs, with memory in proportion to the edges.

A connected part's unknowns are put in layers by their number of steps from one node, so the normal equations are block
tridiagonal and are eliminated layer by layer. Long, narrow graphs, where iterations would be slow, have small layers; where
layers are wide, paths are short and conjugate gradients settle soon.
"""

from __future__ import annotations

import numpy as np

#: Numbers held in the blocks of layers at most; beyond that a part is solved by conjugate gradients.
MOST_BLOCKS = 20_000_000


def _layers(near: np.ndarray, starts: np.ndarray, root: int, depth: np.ndarray) -> list[np.ndarray]:
    """Nodes by steps from ``root``; ``depth`` (-1 where not yet seen) gets the steps."""
    depth[root] = 0
    out = [np.array([root])]
    while True:
        here = out[-1]
        sizes = starts[here + 1] - starts[here]
        at = np.repeat(starts[here] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        found = np.unique(near[at])
        found = found[depth[found] < 0]
        if not len(found):
            return out
        depth[found] = len(out)
        out.append(found)


def _eliminated(layers: list[np.ndarray], u: np.ndarray, v: np.ndarray, w: np.ndarray, diagonal: np.ndarray, y: np.ndarray, x: np.ndarray, depth: np.ndarray, place: np.ndarray) -> None:
    """x of all layers but the first, whose x is 0."""
    r, deep = y.shape[1], np.maximum(depth[u], depth[v])
    order = np.argsort(deep, kind="stable")
    cuts = np.searchsorted(deep[order], np.arange(len(layers) + 1))

    def blocks(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of layer k: its own block without the diagonal, and that to the layer before."""
        own, back = np.zeros((len(layers[k]), len(layers[k]))), np.zeros((len(layers[k]), len(layers[k - 1])))
        e = order[cuts[k] : cuts[k + 1]]
        a, b = np.where(depth[u[e]] == k, u[e], v[e]), np.where(depth[u[e]] == k, v[e], u[e])
        same = depth[b] == k
        np.add.at(own, (place[a[same]], place[b[same]]), -w[e[same]])
        np.add.at(own, (place[b[same]], place[a[same]]), -w[e[same]])
        np.add.at(back, (place[a[~same]], place[b[~same]]), -w[e[~same]])
        return own, back

    held, before = [], None
    for k in range(1, len(layers)):
        own, back = blocks(k)
        own[np.diag_indices_from(own)] += diagonal[layers[k]]
        right = y[layers[k]].copy()
        if before is not None:
            m, rest = before
            done = np.linalg.solve(m, np.concatenate([back.T, rest], axis=1))
            held.append(done)
            own -= back @ done[:, :-r]
            right -= back @ done[:, -r:]
        before = own, right
    if before is None:
        return
    x[layers[-1]] = np.linalg.solve(*before)
    for k in range(len(layers) - 2, 0, -1):
        done = held.pop()
        x[layers[k]] = done[:, -r:] - done[:, :-r] @ x[layers[k + 1]]


def _iterated(part: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, diagonal: np.ndarray, y: np.ndarray, x: np.ndarray, place: np.ndarray) -> None:
    """x of the nodes ``part`` but the first, whose x is 0, by conjugate gradients scaled by the diagonal."""
    n, a, b = len(part), place[u], place[v]
    scale = 1 / diagonal[part]
    scale[0] = 0
    for c in range(y.shape[1]):
        z, left = np.zeros(n), y[part, c].copy()
        left[0] = 0
        enough = 1e-14 * np.sqrt((left * scale * left).sum())
        step, size = scale * left, (left * scale * left).sum()
        for _ in range(20 * n):
            if np.sqrt(size) <= enough:
                break
            apart = w * (step[a] - step[b])
            to = np.bincount(a, apart, n) - np.bincount(b, apart, n)
            to[0] = 0
            by = size / (step @ to)
            z += by * step
            left -= by * to
            old, size = size, (left * scale * left).sum()
            step = scale * left + size / old * step
        x[part, c] = z


def sparse_differences(pairs: np.ndarray, b: np.ndarray, w: np.ndarray, nodes: int, ref: int, most_blocks: int = MOST_BLOCKS) -> np.ndarray:
    """x with x_u - x_v = b for each pair (u, v) of nodes 0, 1, ... in the weighted least squares sense, 0 at ``ref``; where
    pairs of positive weight do not lead to it, the smallest solution, of mean 0."""
    some = (w > 0) & (pairs[:, 0] != pairs[:, 1])
    (u, v), w, b = pairs[some].T, w[some], b[some]
    x, y = np.zeros((nodes, b.shape[1])), np.zeros((nodes, b.shape[1]))
    np.add.at(y, u, w[:, None] * b)
    np.add.at(y, v, -w[:, None] * b)
    diagonal = np.bincount(u, w, nodes) + np.bincount(v, w, nodes)
    ends, others = np.r_[u, v], np.r_[v, u]
    order = np.argsort(ends, kind="stable")
    near, starts = others[order], np.r_[0, np.cumsum(np.bincount(ends, minlength=nodes))]
    edge = np.r_[np.arange(len(u)), np.arange(len(u))][order]
    depth, place = np.full(nodes, -1), np.zeros(nodes, np.int64)
    for root in [ref, *np.flatnonzero(diagonal > 0).tolist()]:
        if depth[root] >= 0:
            continue
        layers = _layers(near, starts, root, depth)
        part = np.concatenate(layers)
        if len(part) == 1:
            continue
        at = np.unique(np.concatenate([edge[starts[k] : starts[k + 1]] for k in part.tolist()]))
        sizes = np.array([len(k) for k in layers], dtype=float)
        if (sizes[1:] * sizes[:-1]).sum() + (sizes**2).max() <= most_blocks:
            for k in layers:
                place[k] = np.arange(len(k))
            _eliminated(layers, u[at], v[at], w[at], diagonal, y, x, depth, place)
        else:
            place[part] = np.arange(len(part))
            _iterated(part, u[at], v[at], w[at], diagonal, y, x, place)
        if root != ref:
            x[part] -= x[part].mean(axis=0)
    return x
