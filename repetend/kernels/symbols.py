"""Sequences as byte codes: A, C, G, T are 0 to 3, everything else is 4."""

from __future__ import annotations

import numpy as np

FNV_START, FNV_PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1

#: U counts as T; any other symbol is unknown.
_FOLD = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    _FOLD[list(_pair)] = _i
#: Case-sensitive: lower-case (masked) symbols are unknown.
_STRICT = np.full(256, 4, np.uint8)
_STRICT[list(b"ACGT")] = range(4)
#: Case folded, but U is unknown.
_DNA = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _DNA[list(_pair)] = _i

LETTERS = np.frombuffer(b"ACGTN", np.uint8)


def codes(sequence: str | bytes, rule: str = "fold") -> np.ndarray:
    raw = sequence.encode("ascii", "replace") if isinstance(sequence, str) else sequence
    return {"fold": _FOLD, "strict": _STRICT, "dna": _DNA}[rule][np.frombuffer(raw, np.uint8)]


def letters(code: np.ndarray) -> str:
    return LETTERS[code].tobytes().decode()


def words(code: np.ndarray, k: int) -> np.ndarray:
    """Base-4 value of the k symbols from each place on; -1 where one of them is unknown."""
    n = len(code) - k + 1
    if n <= 0 or k <= 0:
        return np.empty(0, np.int64)
    # words of twice the symbols, and one symbol more where k's next bit is set
    value, have = code.astype(np.int64), 1
    for bit in bin(k)[3:]:
        value = (value[: len(value) - have] << 2 * have) + value[have:]
        have *= 2
        if bit == "1":
            value = (value[: len(value) - 1] << 2) + code[have:]
            have += 1
    if code.max() == 4:
        unknown = np.concatenate(([0], np.cumsum(code == 4)))
        value[unknown[k:] > unknown[:-k]] = -1
    return value


def neighbours(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of every known word to its next occurrence."""
    places = np.flatnonzero(word >= 0)
    known = word[places]
    if len(known) and known.max() < 1 << 16:
        known = known.astype(np.uint16)  # radix sort
    order = np.argsort(known, kind="stable")
    here, value = places[order], known[order]
    same = value[1:] == value[:-1]
    return here[:-1][same], (here[1:] - here[:-1])[same]


def fnv1a(data: bytes, value: int = FNV_START) -> int:
    for byte in data:
        value = (value ^ byte) * FNV_PRIME & MASK
    return value


def named_seed(seed: int, name: str) -> int:
    """64-bit seed of a stream with a name."""
    return fnv1a(seed.to_bytes(8, "little") + b":" + name.encode())
