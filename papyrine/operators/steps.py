"""The nearest nodes by steps along links, and their weights, for a component that one task holds."""

from __future__ import annotations

import numpy as np

from papyrine.operators.dimred import memberships

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hashed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Spark's ``xxhash64(a, b, seed)`` of two longs and an int."""
    with np.errstate(over="ignore"):
        h = np.full(len(a), 42, dtype=np.uint64)
        for x in (a, b):
            h = h + _P5 + np.uint64(8)
            h = h ^ (_turn(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
            h = _mix(_turn(h, 27) * _P1 + _P4)
        h = (h + _P5 + np.uint64(4)) ^ (np.full(1, seed & 0xFFFFFFFF, dtype=np.uint64) * _P1)
        return _mix(_turn(h, 23) * _P2 + _P3).view(np.int64)


def _ranks(group: np.ndarray) -> np.ndarray:
    """Places within the groups of a sorted column."""
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, dtype=int)
    return np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))


def _listed(first: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some nodes its neighbours: the number of each in ``at``, and the neighbour."""
    count = first[at + 1] - first[at]
    which = np.repeat(np.arange(len(at)), count)
    return which, b[np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(len(which))]


def _passed_on(first: np.ndarray, b: np.ndarray, ids: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists with at most ``most`` of each node, the first by a seeded hash."""
    count = np.diff(first)
    hubs = np.flatnonzero(count > most)
    if not len(hubs):
        return first, b
    keep = np.ones(len(b), dtype=bool)
    size = np.cumsum(count[hubs])
    for part in np.split(hubs, np.unique(np.searchsorted(size, np.arange(1 << 18, size[-1], 1 << 18)))):  # hubs of some links together
        if len(part):
            which, other = _listed(first, b, part)
            order = np.lexsort((ids[other], hashed(ids[part[which]], ids[other], seed), which))
            late = np.empty(len(order), dtype=bool)
            late[order] = _ranks(which[order]) >= most
            keep[(first[part][which] + _ranks(which))[late]] = False
    return np.concatenate([[0], np.cumsum(np.minimum(count, most))]), b[keep]


def near_by_hops(first: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, seed: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each node of a component k others and their steps, -1 where it has fewer: those ``graph.hop_neighbours`` finds along links, in its order.

    ``first`` and ``b`` are neighbour lists over places in ``ids``. Nodes are worked through in blocks; at most 2 k² others a node are looked at in a step.
    """
    n = len(ids)
    near, hops = np.full((n, k), -1, dtype=np.int32), np.zeros((n, k), dtype=np.uint8 if k < 256 else np.uint16)
    first, b = _passed_on(first, b, ids, 2 * k, seed)
    for begin in range(0, n, block):
        here = np.arange(begin, min(n, begin + block))
        have = np.zeros(len(here), dtype=int)
        found = np.arange(len(here)) * n + here  # a node itself and what it has, as sorted pairs
        front, step = found, 0
        while len(front) and step < k:
            step += 1
            which, other = _listed(first, b, front % n)
            new = np.unique((front // n)[which] * n + other)
            new = new[found[np.minimum(np.searchsorted(found, new), len(found) - 1)] != new]
            src, dst = new // n, new % n
            order = np.lexsort((ids[dst], hashed(ids[here[src]], ids[dst], seed), src))
            place = have[src[order]] + _ranks(src[order])
            kept = place < k
            s, d = src[order][kept], dst[order][kept]
            near[here[s], place[kept]], hops[here[s], place[kept]] = d, step
            have += np.bincount(s, minlength=len(here))
            found = np.sort(np.concatenate([found, new]))
            front = new[have[src] < k]
    return near, hops


def linked_weights(first: np.ndarray, b: np.ndarray, ids: np.ndarray, neighbours: int, seed: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """``near_by_hops`` and the weights of ``fuzzy_weights``, each pair's at one of its ends: at the smaller where both have each other, elsewhere 0."""
    near, hops = near_by_hops(first, b, ids, neighbours - 1, seed)
    weight = np.zeros(near.shape, dtype=np.float32)
    parts = [slice(i, i + block) for i in range(0, len(near), block)]
    for part in parts:
        kinds, which = np.unique(hops[part], axis=0, return_inverse=True)  # weights follow from the steps alone
        src, at = np.nonzero(kinds)
        w = np.zeros(kinds.shape)
        w[src, at] = memberships(len(kinds), src, kinds[src, at].astype(float), neighbours)
        weight[part] = w[which.ravel()]
    del hops
    for part in parts:  # in ascending order: weights of later nodes are those of one direction still
        own, mine = np.arange(part.start, part.start + len(near[part])), weight[part]
        other = np.maximum(near[part], 0)
        back = (near[other] == own[:, None, None]) & (near[part] >= 0)[:, :, None]
        theirs = (weight[other] * back).sum(2)
        mutual = back.any(2)
        weight[part] = np.where(mutual & (other < own[:, None]), 0, mine + theirs - mine * theirs)
    return np.maximum(near, 0, out=near), weight
