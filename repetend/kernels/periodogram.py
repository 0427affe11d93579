"""Periodogram of a sequence: distances between neighbouring equal k-mers, against a random background."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from repetend.kernels import symbols, xorshift

GOLDEN = 0x9E3779B97F4A7C15
#: Symbols of a sequence whose replicates are counted together.
SHORT = 1 << 16


@dataclass(frozen=True)
class PeriodogramConfig:
    k: int = 6
    replicates: int = 10
    least_share: float = 0.001
    least_distance: int = 1
    sigma: float = 10.0


@dataclass(frozen=True)
class Peaks:
    """Columns of the kept peaks, in order of rank."""

    period: np.ndarray
    height: np.ndarray
    score: np.ndarray
    score2: np.ndarray
    share: np.ndarray
    background: np.ndarray

    def __len__(self) -> int:
        return len(self.period)


NO_PEAKS = Peaks(np.empty(0, np.int64), *(np.empty(0) for _ in range(5)))


def histogram(code: np.ndarray, k: int) -> np.ndarray:
    """How often each distance from 0 to the length stands between neighbours."""
    return np.bincount(symbols.neighbours(symbols.words(code, k))[1], minlength=len(code) + 1).astype(np.float64)


@dataclass(frozen=True)
class Part:
    """What a stretch of a sequence adds: distances within it, and the first and last place of each of its k-mers."""

    distance: np.ndarray
    count: np.ndarray
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray


def part(code: np.ndarray, k: int) -> Part:
    word = symbols.words(code, k)
    places = np.flatnonzero(word >= 0)
    places = places[np.argsort(word[places], kind="stable")]
    known = word[places]
    same = known[1:] == known[:-1]
    distance, count = np.unique((places[1:] - places[:-1])[same], return_counts=True)
    heads = np.flatnonzero(np.append(True, ~same)[: len(known)])
    tails = np.append(heads[1:], len(known))[: len(heads)] - 1
    return Part(distance, count, known[heads], places[heads], places[tails])


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends stand zeros."""
    if sigma <= 0:
        return values.copy()
    reach = int(np.ceil(3 * sigma))
    x = np.arange(-reach, reach + 1)
    weights = np.exp(-(x**2) / (2 * sigma * sigma))
    return np.convolve(values, weights / weights.sum())[reach : reach + len(values)]


def _drawn(states: np.ndarray, edges: np.ndarray) -> np.ndarray:
    u = states.astype(np.float64) / float(symbols.MASK)
    code = (u >= edges[0]).astype(np.uint8)
    code += u >= edges[1]
    code += u >= edges[2]
    return code


def _random_states(name: str, counts: np.ndarray, length: int, replicates: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.cumsum(counts)[:3] / counts.sum()
    base = symbols.fnv1a(name.encode())
    seeds = np.array([(base + GOLDEN * (j + 1)) & symbols.MASK or 1 for j in range(replicates)], np.uint64)
    return xorshift.runs(xorshift.skipped(seeds, start), length), edges


def random_codes(name: str, counts: np.ndarray, length: int, replicates: int, start: int = 0) -> Iterator[np.ndarray]:
    """Symbols from start on of each random sequence with these shares of A, C, G and T; its seed follows from the name."""
    rows, edges = _random_states(name, counts, length, replicates, start)
    for states in rows:
        yield _drawn(states, edges)


def envelope_of(code: np.ndarray, k: int) -> np.ndarray:
    """The largest of the histograms of sequences of known symbols, a row each; all k-mers are sorted together."""
    rows, n = code.shape
    word = np.zeros((rows, n - k + 1), np.uint16)
    for j in range(k):
        word *= 4
        word += code[:, j : n - k + 1 + j]
    word += (np.arange(rows) * 4**k).astype(np.uint16)[:, None]
    word = word.reshape(-1)
    order = np.argsort(word, kind="stable")
    value = word[order]
    # a k-mer's places are of one row, so distances are within it
    same = np.flatnonzero(value[1:] == value[:-1])
    distance = order[same + 1] - order[same]
    row = value[same] >> 2 * k
    return np.bincount(row.astype(np.int64) * (n + 1) + distance, minlength=rows * (n + 1)).reshape(rows, n + 1).max(axis=0).astype(np.float64)


def background(code: np.ndarray, name: str, cfg: PeriodogramConfig) -> np.ndarray:
    """Smoothed envelope of random sequences of the same composition; their seed follows from the name."""
    n = len(code)
    counts = np.bincount(code, minlength=5)[:4]
    if n < cfg.k or cfg.replicates == 0 or not counts.sum():
        return np.zeros(n + 1)
    if n <= SHORT and cfg.replicates * 4**cfg.k <= 1 << 16:
        envelope = envelope_of(_drawn(*_random_states(name, counts, n, cfg.replicates, 0)), cfg.k)
    else:
        envelope = np.zeros(n + 1)
        for drawn in random_codes(name, counts, n, cfg.replicates):
            np.maximum(envelope, histogram(drawn, cfg.k), out=envelope)
    level = smooth(envelope, cfg.sigma)
    half = slice(0, n // 2 + 1)
    used = level[half] > 0
    return level * max(1.0, float((envelope[half][used] / level[half][used]).max(initial=1.0)))


def find_peaks(profile: np.ndarray, level: np.ndarray, cfg: PeriodogramConfig) -> Peaks:
    n = len(profile) - 1
    at = 1 + np.flatnonzero((profile[1:-1] > profile[:-2]) & (profile[1:-1] > profile[2:]))
    if cfg.least_distance > 1:
        kept: list[int] = []
        for i in at[np.argsort(-profile[at], kind="stable")]:
            if all(abs(i - j) >= cfg.least_distance for j in kept):
                kept.append(int(i))
        at = np.array(kept, np.int64)
    at = at[at < n // 2]
    if not len(at):
        return NO_PEAKS
    height, under = profile[at], level[at]
    score = height / np.maximum(n - at - cfg.k + 1, 1)
    score2 = score * np.log2(at)
    total = score2.sum()
    share = score2 / total if total > 0 else np.zeros(len(at))
    keep = share > cfg.least_share
    if (keep & (height > under)).any():
        keep &= height > under
    elif keep.any():  # the last of the largest ratios
        ratio = np.where(keep, height / np.maximum(under, 1), -1.0)
        keep = np.arange(len(at)) == len(at) - 1 - int(np.argmax(ratio[::-1]))
    rows = np.flatnonzero(keep)
    rows = rows[np.argsort(-score[rows], kind="stable")]
    return Peaks(at[rows], height[rows], score[rows], score2[rows], share[rows], under[rows])


def analyze(name: str, code: np.ndarray, cfg: PeriodogramConfig) -> tuple[Peaks, np.ndarray, np.ndarray]:
    """Peaks, profile and background; all empty where the sequence is shorter than k + 2."""
    if len(code) < cfg.k + 2:
        return NO_PEAKS, np.empty(0), np.empty(0)
    profile, level = histogram(code, cfg.k), background(code, name, cfg)
    return find_peaks(profile, level, cfg), profile, level
