"""SetSketch registers: mergeable, locality-sensitive sketches of sets of 64-bit hashes.

Every element lays down a Poisson process of points, each on a random register;
a register's minimum is then exponential with a rate in proportion to the set.
An element's points come in rising order, so it is left as soon as it has
passed the largest minimum, and a sketch costs about one step per element.
Minima are kept on an exponential scale, floor(1 - log_base(minimum)), cut off
at both ends; the register-wise maximum of two sketches is the sketch of the
union.
"""

from __future__ import annotations

import numpy as np

from sitepanel.llm.wordhash import GOLDEN, mix

REGISTERS = 128
BASE = 1.001
RATE = 20.0
TOP = 65535


def sketches(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of 16-bit registers per set; an empty set has zeros."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    minima = np.full(len(sets) * registers, np.inf)
    owner = np.repeat(np.arange(len(sets)), sizes)
    state = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    at = np.zeros(len(state))
    while len(state):
        state = mix(state + GOLDEN)
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = at - np.log(uniform) / (RATE * registers)
        register = (mix(state ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(minima, owner * registers + register, at)
        limit = minima.reshape(len(sets), registers).max(axis=1)
        go_on = at < limit[owner]
        state, at, owner = state[go_on], at[go_on], owner[go_on]
    minima = minima.reshape(len(sets), registers)
    with np.errstate(divide="ignore"):
        scaled = np.floor(1.0 - np.log(minima) / np.log(BASE)) + TOP // 2
    return np.where(np.isinf(minima), 0, np.clip(scaled, 1, TOP)).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def band_keys(rows: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A 64-bit key per sketch and band of ``width`` neighbouring registers."""
    parts = rows[:, : bands * width].reshape(len(rows), bands, width).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * GOLDEN, parts.shape[:2]).copy()
    for k in range(width):
        keys = mix(keys + (parts[:, :, k] + np.uint64(1)) * GOLDEN)
    return keys.view(np.int64)


def likeliest_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sketches whose set sizes are known.

    With u and v the shares of either set's own elements in the union, the first
    sketch leads with probability p(u - v J) and the second with p(v - u J),
    where p(x) = -log_base(1 - x (base - 1) / base); the likelihood of the two
    counts and of the ties is concave in J and maximised by golden sections.
    """
    registers = a.shape[1]
    over = (a > b).sum(axis=1)
    under = (a < b).sum(axis=1)
    ties = registers - over - under
    u = size_a / (size_a + size_b)
    v = 1.0 - u

    def lead(x):
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)

    def likelihood(j):
        first, second = lead(u - v * j), lead(v - u * j)
        tie = np.clip(1.0 - first - second, 1e-12, 1.0)
        return over * np.log(np.maximum(first, 1e-12)) + under * np.log(np.maximum(second, 1e-12)) + ties * np.log(tie)

    low = np.zeros(len(u))
    high = np.minimum(u, v) / np.maximum(u, v)
    golden = (np.sqrt(5.0) - 1.0) / 2.0
    for _ in range(steps):
        step = golden * (high - low)
        left, right = high - step, low + step
        better = likelihood(left) > likelihood(right)
        low, high = np.where(better, low, left), np.where(better, right, high)
    return (low + high) / 2.0
