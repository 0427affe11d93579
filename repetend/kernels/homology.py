"""Homology of the copies at a period: likeness of the canonical k-mer sketches of neighbouring blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from repetend.kernels import symbols


#: Blocks that are held against kinds together, and kinds of a product.
ROWS, BLOCK = 256, 2048
#: Cells of counts that are held together, and the longest period whose sums of products are exact in single precision.
CELLS, EXACT = 1 << 19, 4096
#: What rounding may take from the root of a whole number, so that a likeness just at the limit is alike.
SLACK = 1e-12


@dataclass(frozen=True)
class HomologyConfig:
    k: int = 5
    subtype_likeness: float = 0.85
    offsets: int = 8
    most_pairs: int = 200
    floor: float = 0.40


@dataclass(frozen=True)
class Homology:
    period: int
    offset: int
    n_blocks: int
    score: float
    n_subtypes: int


def canonical_words(code: np.ndarray, k: int) -> np.ndarray:
    """The lesser of each k-mer and its reverse complement; -1 where a symbol is unknown."""
    word = symbols.words(code, k)
    flipped = symbols.words(np.where(code < 4, 3 - code, 4)[::-1].astype(np.uint8), k)[::-1]
    return np.where(word < 0, -1, np.minimum(word, flipped))


def counts_of(column: np.ndarray, starts: np.ndarray, period: int, k: int, size: int) -> np.ndarray:
    """K-mer counts of the blocks at these starts, a row each; column is each place's column, or -1. Sums of products are exact."""
    own = column[starts[:, None] + np.arange(max(period - k + 1, 0))]
    row, at = np.nonzero(own >= 0)
    counts = np.bincount(row * size + own[row, at], minlength=len(starts) * size).reshape(-1, size)
    return counts.astype(np.float32 if period <= EXACT else np.float64)


def sketches(code: np.ndarray, period: int, offset: int, k: int) -> np.ndarray:
    """Unit vectors of the k-mer counts of whole blocks."""
    n = max(len(code) - offset, 0) // period
    counts = counts_of(canonical_words(code, k), offset + np.arange(n) * period, period, k, 4**k)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)


def likeness(column: np.ndarray, size: int, period: int, offsets: list[int], cfg: HomologyConfig) -> list[float]:
    """Mean likeness of neighbouring blocks at each offset, over at most so many pairs; only their blocks are counted."""
    starts, first, cuts = [], [], [0]
    for offset in offsets:
        n = (len(column) + cfg.k - 1 - offset) // period
        pairs = np.arange(0, n - 1, max(1, (n - 1) // max(cfg.most_pairs, 1)))[: cfg.most_pairs]
        held, place = np.unique(np.concatenate((pairs, pairs + 1)), return_inverse=True)
        first.append(np.stack((place[: len(pairs)], place[len(pairs) :])) + sum(map(len, starts)))
        starts.append(offset + held * period)
        cuts.append(cuts[-1] + len(pairs))
    counts = counts_of(column, np.concatenate(starts), period, cfg.k, size)
    a, b = np.concatenate(first, axis=1)
    square = np.maximum(np.einsum("ij,ij->i", counts, counts), 1).astype(float)
    like = np.einsum("ij,ij->i", counts[a], counts[b]) / np.sqrt(square[a] * square[b])
    return [float(like[i:j].mean()) for i, j in zip(cuts, cuts[1:], strict=False)]


def n_kinds(column: np.ndarray, size: int, period: int, offset: int, n: int, cfg: HomologyConfig) -> int:
    """Number of blocks that are unlike every kind before them.

    ROWS blocks are held against all kinds by products, and among themselves by another. Counts and their products
    are whole numbers, so a likeness doesn't depend on how many blocks are multiplied together.
    """
    kinds, norms, found = np.empty((ROWS, size), np.float32 if period <= EXACT else np.float64), np.empty(ROWS), 0
    for first in range(0, n, ROWS):
        own = counts_of(column, offset + np.arange(first, min(first + ROWS, n)) * period, period, cfg.k, size)
        norm = np.sqrt((own * own).sum(axis=1).astype(float))
        norm[norm == 0] = 1
        least = cfg.subtype_likeness * (1 - SLACK) * norm[:, None]
        rest = np.arange(len(own))
        for at in range(0, found, BLOCK):
            some = slice(at, min(at + BLOCK, found))
            rest = rest[((own[rest] @ kinds[some].T) < least[rest] * norms[some]).all(axis=1)]
        like = (own[rest] @ own[rest].T) >= least[rest] * norm[rest]
        kept: list[int] = []
        for i in range(len(rest)):
            if not like[i, kept].any():
                kept.append(i)
        taken = rest[kept]
        while found + len(taken) > len(kinds):
            kinds, norms = np.concatenate((kinds, np.empty_like(kinds))), np.concatenate((norms, np.empty_like(norms)))
        kinds[found : found + len(taken)], norms[found : found + len(taken)] = own[taken], norm[taken]
        found += len(taken)
    return found


def probe(code: np.ndarray, period: int, cfg: HomologyConfig = HomologyConfig()) -> Homology | None:
    """Best phase, its likeness and how many different kinds of blocks there are; None where copies are few or unlike."""
    if period < 1 or len(code) < 4 * period:
        return None
    word = canonical_words(code, cfg.k)
    # a column for each k-mer that occurs: half of all at most, as each stands for its complement too
    used = np.unique(word)
    used = used[used >= 0]
    column = np.where(word < 0, -1, np.searchsorted(used, word))
    offsets = [i * period // max(cfg.offsets, 1) for i in range(max(cfg.offsets, 1))]
    offsets = [x for x in offsets if (len(code) - x) // period >= 2]
    together = max(1, CELLS // (min(2 * cfg.most_pairs, len(code) // period) * max(period, len(used), 1)))
    scores = [x for i in range(0, len(offsets), together) for x in likeness(column, len(used), period, offsets[i : i + together], cfg)]
    score = max(scores, default=-1.0)
    if score < cfg.floor:
        return None
    offset = offsets[scores.index(score)]
    n = (len(code) - offset) // period
    return Homology(period, offset, n, score, n_kinds(column, len(used), period, offset, n, cfg))
