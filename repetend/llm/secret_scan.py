"""Secret scan: fixed patterns, and a battery of randomness tests on every long token.

Candidates are the parts between equals signs of the runs of [A-Za-z0-9+/_=-], with at least MIN_LENGTH symbols. The
smallest alphabet that holds all symbols of a candidate is its inferred encoding. Two hypotheses are tested.

That the token is ordinary: the runs test takes the changes of symbol class (digit, lower, upper, other), the serial test
each letter given the one before it, by the letter pairs of the corpus's own words (all text outside candidates, case
folded). Each gives the log of a likelihood ratio, drawn at random to ordinary, and they add up: the ratio of the chance of
the token under some encoding, all equally likely, to its chance as ordinary text. If ordinary tokens follow that model,
the ratio exceeds x with chance 1 / x at most, at every length, so its inverse is a p-value without any approximation.

That the symbols are random: chi-squared for a uniform alphabet, runs above and below the alphabet's median, and serial
correlation at lag 1. A token that one of them rejects at REJECT counts as ordinary with p-value 1.

Benjamini-Hochberg, with weights in proportion to length, bounds the false discoveries among all candidates of the
corpus: a pass over the texts counts p-values divided by length in STEPS bins a factor e, at most BINS of them, and the
last takes every candidate from the bin on that the counts allow. Spans of the patterns always stay; a selected candidate
that overlaps one adds nothing.

Tokens of digits alone are no candidates of the method: nothing tells random ones from numbers in use. They count as
ordinary; the patterns still apply.

Defined results: null text is empty and has no spans; base spans of a row depend on its text alone, random ones on the
corpus too, through its letter pairs and the cut; a corpus without candidates has none. A null doc_id is kept; columns
besides doc_id and text are ignored; offsets are code points, the end exclusive. Texts are scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import SLICE_ROWS, map_slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
#: Every access and hex span stands in one of these runs.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile("[^=]+=*")
MIN_LENGTH = 20
#: Levels: of false discoveries among the corpus's candidates, and of rejecting a random token.
DISCOVERY, REJECT = 1e-3, 1e-4
#: Bins of -log(p / length): steps a unit, and how many at most.
STEPS, BINS = 8, 8 * 720
#: Of ordinary tokens: chances of the next symbol's class (digit, lower, upper, other) by this one's, so that words, words
#: joined by signs or by capitals, and names with a number are ordinary.
CLASSES = ((0.85, 0.05, 0.05, 0.05), (0.05, 0.85, 0.05, 0.05), (0.05, 0.3, 0.6, 0.05), (0.3, 0.3, 0.3, 0.1))
#: Share of even chance in the chances of a next letter.
EVEN = 0.02
#: Stands before a letter that begins a word: one after no letter, or a capital after a small one.
START = 26

DIGIT, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet to the largest.
ENCODINGS = (
    ("hex", DIGIT + "abcdef"),
    ("hex", DIGIT + "ABCDEF"),
    ("letters", LOWER),
    ("letters", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGIT + LOWER),
    ("base36", DIGIT + UPPER),
    ("letters", UPPER + LOWER),
    ("base62", DIGIT + UPPER + LOWER),
    ("base64", DIGIT + UPPER + LOWER + "+/"),
    ("base64url", DIGIT + UPPER + LOWER + "_-"),
    ("any", DIGIT + UPPER + LOWER + "+/_=-"),
)
_ALPHABETS = tuple((name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS)
_CLASS = {c: 0 for c in DIGIT} | {c: 1 for c in LOWER} | {c: 2 for c in UPPER} | {c: 3 for c in "+/_=-"}
_CHANGE = tuple(tuple(math.log(p) for p in row) for row in CLASSES)
_LETTER = np.full(256, START, np.int64)
for _i in range(26):
    _LETTER[ord("a") + _i] = _LETTER[ord("A") + _i] = _i


class Rule(NamedTuple):
    """What the corpus decides: logs of the chances of a letter by the one before it, and the least bin taken."""

    pairs: list[list[float]]
    least: int | None


def _upper(z: float) -> float:
    """Chance that a normal variable is z or more."""
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def _chi_upper(x: float, df: int) -> float:
    """Chance that a chi-squared variable is x or more, by Wilson and Hilferty."""
    return _upper(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def _correlation(values: list[float]) -> float:
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    return sum((values[i] - mean) * (values[i + 1] - mean) for i in range(n - 1)) / spread if spread else 0.0


def count_pairs(text: str) -> np.ndarray:
    """Letters by the letter before them (or START), of the text outside candidates."""
    codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)  # a byte for each code point
    found = _LETTER[codes]
    for start, end in candidates(text):
        found[start:end] = START
    before = np.concatenate(([START], found[:-1]))
    before[1:][(codes[:-1] >= ord("a")) & (codes[1:] <= ord("Z"))] = START
    kept = found < START
    return np.bincount(before[kept] * 26 + found[kept], minlength=27 * 26)


def log_pairs(counts: np.ndarray) -> list[list[float]]:
    """Logs of the chances of each letter by the one before it; EVEN of them is even, the rest as counted."""
    n = counts.reshape(27, 26).astype(np.float64)
    letter = (n.sum(0) + 1 / 26) / (n.sum() + 1)
    seen = (n + letter) / (n.sum(1, keepdims=True) + 1)
    return np.log((1 - EVEN) * seen + EVEN / 26).tolist()


def ratio(body: str, pairs: list[list[float]]) -> float:
    """Log of the token's chance as random symbols over that as ordinary text: runs and serial test together."""
    n, symbols = len(body), set(body)
    logs = [-n * math.log(len(index)) for _, letters, index in _ALPHABETS if symbols <= letters]
    at_random = logs[0] + math.log(sum(math.exp(x - logs[0]) for x in logs) / len(_ALPHABETS))
    runs, serial = -math.log(4), 0.0
    kind, letter = None, START
    for c in body:
        now = _CLASS[c]
        if kind is not None:
            runs += _CHANGE[kind][now]
        if now == 0 or now == 3:
            serial -= math.log(10 if now == 0 else 5)
            letter = START
        else:
            following = int(_LETTER[ord(c)])
            serial += pairs[START if (kind, now) == (1, 2) else letter][following]
            letter = following
        kind = now
    return at_random - runs - serial


def rejection(body: str) -> tuple[str, float]:
    """Inferred encoding, and the least p-value of the three tests of random symbols, times their number."""
    symbols = set(body)
    name, _, index = next(x for x in _ALPHABETS if symbols <= x[1])
    n, k = len(body), len(index)
    chi = k * sum(c * c for c in Counter(body).values()) / n - n
    places = [index[c] for c in body]
    above = [2 * i >= k for i in places]
    changes = sum(a != b for a, b in zip(above, above[1:], strict=False))
    expected = 2 * ((k + 1) // 2) * (k // 2) / (k * k)
    q_chi = _chi_upper(chi, k - 1)
    q_runs = 2 * _upper((abs(changes - expected * (n - 1)) - 0.5) / math.sqrt(expected * (1 - expected) * (n - 1)))
    q_serial = 2 * _upper(abs(_correlation([float(i) for i in places])) * math.sqrt(n))
    return name, min(1.0, 3 * min(q_chi, q_runs, q_serial))


def battery(token: str, pairs: list[list[float]]) -> tuple[str, float]:
    """Inferred encoding and -log of the p-value as an ordinary token; 0 if the symbols are not random either."""
    body = token.rstrip("=")
    if len(body) < MIN_LENGTH or not set(body) - set(DIGIT):
        return "number", 0.0
    evidence = ratio(body, pairs)
    name, random = rejection(body)
    return name, 0.0 if random < REJECT else max(0.0, evidence)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates."""
    return [(run.start() + m.start(), run.start() + m.end()) for run in RUN.finditer(text) for m in PART.finditer(run[0]) if len(m[0]) >= MIN_LENGTH]


def bin_of(evidence: float, length: int) -> int:
    """Bin of a candidate's weighted p-value, from its -log; the higher, the less ordinary."""
    return max(0, min(BINS, math.floor(STEPS * (math.log(length) + evidence))))


def cut_of(counts: dict[int, tuple[int, int]], level: float = DISCOVERY) -> int | None:
    """The least bin whose candidates and those above it may be taken; from number and total length by bin.

    The greatest weighted p-value of bin b is mean / e ** (b / STEPS), with weights of mean 1. Benjamini-Hochberg
    takes all n candidates from b on if total * that value is at most level * n.
    """
    total = sum(n for n, _ in counts.values())
    mean = sum(length for _, length in counts.values()) / total if total else 0
    found, n = None, 0
    for b in sorted(counts, reverse=True):
        n += counts[b][0]
        if total * mean * math.exp(-b / STEPS) <= level * n:
            found = b
    return found


def tested(text: str, pairs: list[list[float]]) -> list[tuple[int, int, int]]:
    """(start, end, bin) of the candidates."""
    return [(start, end, bin_of(battery(text[start:end], pairs)[1], end - start)) for start, end in candidates(text)]


def corpus_pairs(docs: DataFrame) -> np.ndarray:
    """count_pairs() of every text of docs together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(27 * 26, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.slice(at, SLICE_ROWS).column("text").to_pylist():
                    sums += count_pairs(text or "")
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"place": pa.array(found.astype(np.int32)), "n": pa.array(sums[found])})

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "place int, n long")
    counts = np.zeros(27 * 26, np.int64)
    for r in parts.groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most 702 rows
        counts[r["place"]] = r["n"]
    return counts


def rule(docs: DataFrame) -> Rule:
    """Letter pairs of docs and cut_of() over every candidate; at most BINS + 1 rows come to the driver."""
    pairs = log_pairs(corpus_pairs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lengths = Counter(), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text in batch.slice(at, SLICE_ROWS).column("text").to_pylist():
                    for start, end, b in tested(text or "", pairs):
                        n[b] += 1
                        lengths[b] += end - start
        yield pa.RecordBatch.from_pydict({"bin": pa.array(list(n), pa.int32()), "n": pa.array(list(n.values()), pa.int64()), "length": pa.array([lengths[b] for b in n], pa.int64())})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bin int, n long, length long")
    rows = counted.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()
    return Rule(pairs, cut_of({r["bin"]: (r["n"], r["length"]) for r in rows}))


def scan(text: str, of: Rule | None) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of all spans, in order of start and then kind, by the corpus's rule."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    for run in RUN.finditer(text):
        token, at = run[0], run.start()
        if "AKIA" in token:
            found += [(at + m.start(), at + m.end(), 1) for m in ACCESS.finditer(token) if len(m[0]) >= ACCESS_LENGTH]
        if len(token) >= HEX_LENGTH:
            found += [(at + m.start(), at + m.end(), 2) for m in HEX.finditer(token) if len(m[0]) >= HEX_LENGTH]
    if of is not None and of.least is not None:
        base = sorted(found)
        at = 0
        for start, end, b in tested(text, of.pairs):
            if b < of.least:
                continue
            while at < len(base) and base[at][1] <= start:
                at += 1
            if at == len(base) or base[at][0] >= end:
                found.append((start, end, 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with every stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += (text[at:start], mark)
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) and the redacted text."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", T.ArrayType(span)), T.StructField("redacted", T.StringType())])

    of = rule(docs)

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        def run(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            spans = [scan(x or "", of) for x in texts]
            return {
                "doc_id": batch.column("doc_id"),
                "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in row] for row in spans],
                "redacted": [x and redact(x, row) for x, row in zip(texts, spans, strict=True)],
            }

        return run

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans as text."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_random", T.LongType())])

    of = rule(docs)

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)

        def run(batch: pa.RecordBatch) -> dict:
            found = [scan(x or "", of) for x in batch.column("text").to_pylist()]
            base = [said([x for x in row if x[2] < 3]) for row in found]
            return {
                "doc_id": batch.column("doc_id"),
                **{f"n_{kind}": [sum(x[2] == k for x in row) for row in found] for k, kind in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in base],
                "spans": [said(row) for row in found],
            }

        return run

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)


def redact_texts(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced; all other columns stay."""
    of = rule(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [x and redact(x, scan(x, of)) for x in part.column(place).to_pylist()]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
