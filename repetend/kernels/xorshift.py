"""The 64-bit xorshift generator with shifts 13, 7 and 17, for many streams and long runs at once.

A step is linear over GF(2), so the state 2**n steps ahead is a product with a fixed bit matrix. A run is cut into
stretches of STRIDE steps; the first states of twice as many stretches follow from those of the first ones by one product, and
all stretches of all streams then step together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

STRIDE = 16
_U = np.uint64
#: Where each byte's values begin in a table.
_BYTE = 256 * np.arange(8)


def _step(state: np.ndarray) -> np.ndarray:
    state = state ^ (state << _U(13))
    state = state ^ (state >> _U(7))
    return state ^ (state << _U(17))


def _product(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after the steps that the table stands for."""
    each = np.ascontiguousarray(state, "<u8").view(np.uint8).reshape(*state.shape, 8)
    return np.bitwise_xor.reduce(table.reshape(-1)[each + _BYTE], axis=-1)


@lru_cache(64)
def _doubled(power: int) -> np.ndarray:
    """The table of 2**power steps."""
    if power == 0:
        return _step((np.arange(256, dtype=np.uint64)[None, :] << (_U(8) * np.arange(8, dtype=np.uint64))[:, None]).copy())
    half = _doubled(power - 1)
    return _product(half, half)


def skipped(seeds: np.ndarray, steps: int) -> np.ndarray:
    """The states a number of steps after each seed; a part of a run can begin there."""
    state = seeds.astype(np.uint64)
    for power in range(steps.bit_length()):
        if steps >> power & 1:
            state = _product(_doubled(power), state)
    return state


def runs(seeds: np.ndarray, length: int) -> np.ndarray:
    """length states after each seed, one row a seed."""
    parts, power = max(1, -(-length // STRIDE)), STRIDE.bit_length() - 1
    first = seeds.astype(np.uint64)[:, None]
    while first.shape[1] < parts:
        first = np.concatenate((first, _product(_doubled(power), first[:, : parts - first.shape[1]])), axis=1)
        power += 1
    out = np.empty((len(seeds), parts, STRIDE), np.uint64)
    for i in range(STRIDE):
        first = _step(first)
        out[:, :, i] = first
    return out.reshape(len(seeds), -1)[:, :length]
