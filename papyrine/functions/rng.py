"""Seeded random numbers that run in sequence, on the driver only."""

from __future__ import annotations

import math
from collections.abc import Callable

_M = 0xFFFFFFFF


def generator(seed: int) -> Callable[[], float]:
    """A 32-bit generator of uniform numbers in [0, 1): an additive step, two mixing rounds."""
    state = seed & _M

    def nxt() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _M
        t = ((state ^ state >> 15) * (state | 1)) & _M
        t ^= (t + ((t ^ t >> 7) * (t | 61) & _M)) & _M
        return ((t ^ t >> 14) & _M) / 2**32

    return nxt


def normal(rng: Callable[[], float]) -> float:
    u, v = 0.0, 0.0
    while not u:
        u = rng()
    while not v:
        v = rng()
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def poisson(mean: float, rng: Callable[[], float]) -> int:
    limit, k, p = math.exp(-mean), 0, rng()
    while p > limit:
        k, p = k + 1, p * rng()
    return k


def shuffled(items: list, rng: Callable[[], float]) -> list:
    out = list(items)
    for last in range(len(out) - 1, 0, -1):
        pick = int(rng() * (last + 1))
        out[last], out[pick] = out[pick], out[last]
    return out


def text_hash(text: str) -> int:
    """A 32-bit hash of a text, to seed from settings: h = h * 33 xor c."""
    h = 5381
    for c in text:
        h = (h * 33 ^ ord(c)) & _M
    return h
