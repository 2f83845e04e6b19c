"""Trees of a random forest in numpy: each is grown level by level over all its rows at once.

Features are 8-bit bins.  A tree takes Poisson(1) copies of the rows, each node looks at its own random choice of
features and takes the split of least Gini impurity; a node that is pure, at the greatest depth, or that no split of its
features makes purer is a leaf (MLlib's rules).
"""

from __future__ import annotations

import numpy as np

#: Distinct values of a feature that one partition tells exactly; of more it tells as many quantiles.
TOLD = 1024
#: Rows of the nodes that are split, and pixels that are judged, at once: what fits a core's cache.
BLOCK = 1 << 16
#: Stands where an inner node has its bin; a row at a leaf stays there.
LEAF = 255


def summary(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weights, or ``most`` quantiles of equal weight in their place."""
    v, place = np.unique(values, return_inverse=True)
    w = np.bincount(place, weights, len(v))
    if len(v) <= most:
        return v, w
    upto = np.cumsum(w)
    at = np.searchsorted(upto, (np.arange(most) + 0.5) * (upto[-1] / most))
    return v[at], np.full(most, upto[-1] / most)


def cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Where bins end: between all values if these are few, otherwise at quantiles."""
    v, w = summary(values, weights, len(values))
    at = np.arange(len(v) - 1)
    if len(v) > bins:
        upto = np.cumsum(w)
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
        at = at[at < len(v) - 1]
    return (v[at] + v[at + 1]) / 2


def binned(columns: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
    """Rows of bins, a byte a feature."""
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for i, (c, e) in enumerate(zip(columns, ends, strict=True)):
        out[:, i] = np.searchsorted(e, c, side="left")
    return out


def in_order(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order that depends on their content only."""
    place = np.lexsort([y, *x.T])
    return np.ascontiguousarray(x[place]), y[place]


def _best(v: np.ndarray, node: np.ndarray, low: np.ndarray, bits: int, n_classes: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the best split of the feature that holds ``v``: its score (least impurity is most) and last bin on the left."""
    key = (((node << 8) | v) << bits) | low
    key.sort()
    place, low = key >> bits, key & ((1 << bits) - 1)
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], True])  # the last row of each bin of each node
    place = place[last]
    at, first = place >> 8, np.flatnonzero(np.r_[True, (place[1:] >> 8) != (place[:-1] >> 8)])
    weight, label = low // n_classes, low % n_classes
    before = np.cumsum(total, axis=0) - total
    n_left, left, right = np.zeros(len(last)), np.zeros(len(last)), np.zeros(len(last))
    for c in range(n_classes):
        here = np.cumsum(np.where(label == c, weight, 0))[last] - before[at, c]
        n_left += here
        left += here.astype(float) ** 2
        right += (total[at, c] - here).astype(float) ** 2
    n_right = total.sum(1)[at] - n_left
    score = np.where(n_right > 0, left / n_left + right / np.maximum(n_right, 1), -1.0)
    most = np.maximum.reduceat(score, first)
    found = np.flatnonzero(score == most[at])[::-1]
    bins = np.zeros(len(first), np.int64)
    bins[at[found]] = place[found] & 255
    return most, bins


def grow(x: np.ndarray, y: np.ndarray, n_classes: int, depth: int, n_features: int, seed: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(nodes, leaves, importances)``: a node is ``left child << 16 | feature << 8 | bin``, leaves are class counts in order of their nodes."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    copies = rng.poisson(1.0, len(x))
    rows = np.flatnonzero(copies) if copies.any() else np.arange(len(x))
    low = np.maximum(copies[rows], 1) * n_classes + y[rows]
    bits, flat = int(low.max()).bit_length(), x.reshape(-1)
    base, start = rows * width, np.array([0, len(rows)])  # rows stand in order of their nodes
    nodes, leaves, told, made = [], [], np.zeros(width), 0
    for level in range(depth + 1):
        n = len(start) - 1
        node = np.repeat(np.arange(n), np.diff(start))
        total = np.bincount(node * n_classes + low % n_classes, low // n_classes, n * n_classes).reshape(n, n_classes).astype(np.int64)
        size = total.sum(1)
        whole = (total.astype(float) ** 2).sum(1) / size
        score, feature, last = np.full(n, -1.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
        mixed = np.flatnonzero(total.max(1) < size) if level < depth else np.zeros(0, np.int64)
        chosen = np.argpartition(rng.random((len(mixed), width)), n_features - 1, axis=1)[:, :n_features] if len(mixed) else None
        counts, k = np.diff(start)[mixed], 0
        upto = np.cumsum(counts)
        while k < len(mixed):
            to = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BLOCK, side="right")))
            own, some = mixed[k:to], counts[k:to]
            inside = np.repeat(np.arange(to - k), some)
            at = np.arange(len(inside)) + np.repeat(start[own] - (np.cumsum(some) - some), some)
            for j in range(n_features):
                f = chosen[k:to, j]
                most, bins = _best(flat[base[at] + f[inside]].astype(np.int64), inside, low[at], bits, n_classes, total[own])
                better = own[most > score[own]]
                sel = most > score[own]
                score[better], feature[better], last[better] = most[sel], f[sel], bins[sel]
            k = to
        gain = score - whole
        parted = gain > 1e-9 * size
        made += n
        own = np.flatnonzero(parted)
        np.add.at(told, feature[own], gain[own])
        ids = made - n + np.arange(n)
        child = np.where(parted, made + 2 * (np.cumsum(parted) - 1), ids)
        nodes.append((child << 16) | np.where(parted, (feature << 8) | last, LEAF))
        leaves.append(total[~parted])
        if not len(own):
            break
        stay = parted[node]
        rank = (np.cumsum(parted) - 1)[node[stay]]
        base, low, node = base[stay], low[stay], node[stay]
        right = flat[base + feature[node]] > last[node]
        into = 2 * rank + right
        counts = np.bincount(into, minlength=2 * len(own))
        start = np.r_[0, np.cumsum(counts)]
        lefts = np.cumsum(~right)
        lead = np.r_[0, lefts][start[::2][:-1]]  # rows gone left in the nodes before
        nth = np.where(right, np.arange(len(into)) - start[::2][rank] - (lefts - lead[rank]), lefts - 1 - lead[rank])
        place = start[into] + nth
        base2, low2 = np.empty_like(base), np.empty_like(low)
        base2[place], low2[place] = base, low
        base, low = base2, low2
    share = told / told.sum() if told.sum() > 0 else told
    return np.concatenate(nodes), np.concatenate(leaves), share


def to_bytes(nodes: np.ndarray, leaves: np.ndarray) -> bytes:
    return np.array([len(nodes), leaves.shape[1]], "<i8").tobytes() + nodes.astype("<i8").tobytes() + leaves.astype("<i4").tobytes()


def add_shares(data: bytes, x: np.ndarray, out: np.ndarray) -> None:
    """Add one tree's class shares of the rows ``x`` to ``out``."""
    n, n_classes = np.frombuffer(data, "<i8", 2)
    nodes = np.frombuffer(data, "<i8", n, 16)
    leaves = np.frombuffer(data, "<i4", -1, 16 + 8 * int(n)).reshape(-1, n_classes)
    shares = leaves / leaves.sum(1, keepdims=True)
    leaf = np.cumsum((nodes & 255) == LEAF) - 1
    width = x.shape[1]
    for a in range(0, len(x), BLOCK):
        flat = x[a : a + BLOCK].reshape(-1)
        rows = np.arange(len(flat) // width)
        base, at, end = rows * width, np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        step = 0
        while len(rows):
            p = nodes[at]
            at = (p >> 16) + (flat[base + ((p >> 8) & 255)] > (p & 255))
            step += 1
            if step % 4 == 0 or len(nodes) < 4:
                done = (nodes[at] & 255) == LEAF
                end[rows[done]] = at[done]
                rows, base, at = rows[~done], base[~done], at[~done]
        out[a : a + BLOCK] += shares[leaf[end]]
