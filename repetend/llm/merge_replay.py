"""Byte-level BPE by replaying all merges over the words of a stretch of the corpus, and decoding.

Words are the matches of the pattern; they are independent, so each is encoded once for all texts that a task reads.
New words of a slice of rows are laid out one behind the other as single bytes, with a boundary between words. An
inverted index maps every pair that can be merged, by the token that it makes, to its places in all words at once.
Merges are replayed in order of rank, a range of ranks at a time. Within a range every word takes the least rank that
the index holds for it, at all of its places from left to right, and does so until the range is used up; no two words
share a pair, so all words go together, as NumPy columns. A merge touches its two neighbours only, whose new pairs
enter the index at their rank. Places that changed meanwhile no longer hold the pair and are passed over. A word in
which a merge makes a pair of a smaller rank than its own goes through its merges one by one instead, so that every
word takes them in just the order in which the library does. A word that is a token itself is that token, as there.

No word is looked at twice as long as the task's table holds it; the table is emptied when it holds TABLE_BYTES, which
changes no result. Nothing is shuffled: a text's ids are joined from those of its words where it is read.

Defined results: a null text is empty: no tokens, no bytes. A null doc_id is kept, and so are rows that repeat. A word
of any length takes time n log n. Ids that the ranks don't have can't be decoded and are an error; null ids decode to
no bytes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import map_slices

FILE = "byte_bpe_multi_50k.tiktoken"
#: A pair of ids is one number: the left one times this, and the right one.
PAIR = 1 << 20
#: Stands between words and in places that a merge has used, and pairs with nothing.
BOUNDARY = PAIR - 1
#: What a pair makes that can't be merged.
NOTHING = 1 << 30
#: Ranges of ranks, each a constant factor wider than the one before: frequencies fall about as fast.
RANGES = 48
#: Text whose new words are replayed together; words and ids that a task's table holds before it is emptied.
SLICE_BYTES, TABLE_BYTES = 8 << 20, 96 << 20


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Rank of each token of a file of ranks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """Token that each pair makes."""
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left * PAIR + right] = rank
    return found


class Vocabulary:
    """Ranks, the merges of all pairs, and the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if max(ranks.values()) >= BOUNDARY:
            raise ValueError("ids are too large for a pair's number")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("some bytes have no token of their own")
        self.ranks, self.merges, self.tokens = ranks, merges_of(ranks), {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.makes = np.append(np.fromiter(self.merges.values(), np.int64, len(self.merges))[order], NOTHING)
        made = self.makes[:-1]
        ends = np.geomspace(made.min() + 1, made.max() + 1, RANGES).astype(np.int64) if len(made) else np.empty(0, np.int64)
        self.ends = np.unique(np.append(ends[:-1], made.max(initial=0) + 1))

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair of ids makes."""
        pair = left * PAIR + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.makes[at], NOTHING)


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """Kept between the tasks of a worker."""
    return Vocabulary(read_ranks(path))


class _Words:
    """Words as linked places: ids, what the pair of a place and the next one makes, and the index of the places."""

    def __init__(self, words: list[bytes], own: Vocabulary) -> None:
        size = np.array([len(w) for w in words], np.int64)
        self.own, self.n_words = own, len(words)
        self.word = np.append(np.repeat(np.arange(len(words)), size + 1), len(words))
        data = np.frombuffer(b"".join(w + b"\0" for w in words) + b"\0", np.uint8)
        self.ids = own.single[data]
        self.ids[np.append(np.cumsum(size + 1) - 1, len(data) - 1)] = BOUNDARY
        self.after, self.before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        self.makes = np.append(own.made(self.ids[:-1], self.ids[1:]), NOTHING)
        self.index: list[list[np.ndarray]] = [[] for _ in own.ends]
        self.odd = np.zeros(len(words) + 1, bool)
        self.enter(np.flatnonzero(self.makes < NOTHING))

    def enter(self, places: np.ndarray) -> None:
        """Places into the index, by what their pairs make."""
        range_ = np.searchsorted(self.own.ends, self.makes[places], "right")
        order = np.argsort(range_, kind="stable")
        found, starts = np.unique(range_[order], return_index=True)
        for r, some in zip(found.tolist(), np.split(places[order], starts)[1:], strict=True):
            self.index[r].append(some)

    def merge(self, at: np.ndarray) -> np.ndarray:
        """Merge the pairs of these places, of which none overlap; the places whose pairs are new."""
        ids, after, before, makes = self.ids, self.after, self.before, self.makes
        rank, gone = makes[at], after[at]
        far = after[gone]
        # where the next pair is merged too, the pair between both stood there for a moment
        beside = np.flatnonzero(far[:-1] == at[1:])
        passing = self.own.made(rank[beside], ids[at[beside + 1]]) < rank[beside]
        ids[at], ids[gone], makes[gone] = rank, BOUNDARY, NOTHING
        after[at], before[far] = far, at
        left = before[at]
        left_ids = np.where(left < 0, BOUNDARY, ids[left])
        makes[at] = self.own.made(rank, ids[far])
        made_left = self.own.made(left_ids, rank)
        makes[left[left >= 0]] = made_left[left >= 0]
        self.odd[self.word[at[(makes[at] < rank) | (made_left < rank)]]] = True
        self.odd[self.word[at[beside[passing]]]] = True
        new = np.concatenate((at, left[left >= 0]))
        return new[makes[new] < NOTHING]

    def replay(self) -> None:
        for r, end in enumerate(self.own.ends.tolist()):
            places, self.index[r] = np.concatenate([np.empty(0, np.int64), *self.index[r]]), []
            while len(places := np.sort(places[self.makes[places] < end])):
                places = places[np.append(True, places[1:] != places[:-1])]
                word, rank = self.word[places], self.makes[places]
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(places))))
                at = places[rank == least]
                # pairs of one rank that overlap: every second one, from the left
                chained = np.append(False, self.after[at[:-1]] == at[1:])
                link = np.arange(len(at))
                at = at[(link - np.maximum.accumulate(np.where(chained, 0, link))) % 2 == 0]
                new = self.merge(at)
                later = self.makes[new] >= end
                self.enter(new[later])
                places = np.concatenate((places, new[~later]))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and how many each has."""
        alive = self.ids != BOUNDARY
        return self.ids[alive], np.bincount(self.word[alive], minlength=self.n_words)[: self.n_words]


def replay(words: list[bytes], own: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one behind the other, and how many each has: all merges, in order of rank, over all words together."""
    held = _Words(words, own)
    held.replay()
    ids, sizes = held.tokens()
    odd = np.flatnonzero(held.odd[: len(words)])
    if len(odd):
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i, one in zip(odd.tolist(), in_turn([words[i] for i in odd], own), strict=True):
            parts[i] = np.array(one, np.int64)
        ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
    return ids, sizes


def in_turn(words: list[bytes], own: Vocabulary) -> list[list[int]]:
    """Ids of every word, merged pair by pair: where a merge makes a pair of a smaller rank, the rest of its word waits for that."""
    merges = own.merges
    ids: list[int] = [BOUNDARY]
    starts = []
    single = own.single.tolist()
    for word in words:
        starts.append(len(ids))
        ids.extend(single[b] for b in word)
        ids.append(BOUNDARY)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    for place in range(n - 1):
        made = merges.get(ids[place] * PAIR + ids[place + 1])
        if made is not None:
            index.setdefault(made, []).append(place)
    ready = list(index)
    heapify(ready)
    while ready:
        rank = heappop(ready)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        waits, rest = -1, []
        for place in places:
            follower = after[place]
            if follower >= n or merges.get(ids[place] * PAIR + ids[follower]) != rank:
                continue
            if place < waits:
                rest.append(place)
                continue
            # merge, and unlink the right one
            far = after[follower]
            ids[place], ids[follower] = rank, BOUNDARY
            after[place], after[follower] = far, n
            before[far] = place
            earlier = before[place]
            for at, pair in ((earlier, ids[earlier] * PAIR + rank), (place, rank * PAIR + ids[far])):
                made = merges.get(pair)
                if made is None:
                    continue
                if made not in index:
                    index[made] = []
                    heappush(ready, made)
                index[made].append(at)
                if made < rank:
                    waits = place
                    while ids[waits] != BOUNDARY:
                        waits = after[waits]
        if rest:
            if rank not in index:
                index[rank] = []
                heappush(ready, rank)
            index[rank].extend(rest)
    out = []
    for start, word in zip(starts, words, strict=True):
        place, end, own = start, start + len(word), []
        while place < end:
            own.append(ids[place])
            place = after[place]
        out.append(own)
    return out


def ranges_of(kind: str) -> str:
    """Code points below U+10000 of a kind, as the inside of a character class."""
    import regex

    found = [ord(c) for c in regex.findall(kind, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))]
    breaks = [0, *(i for i in range(1, len(found)) if found[i] != found[i - 1] + 1), len(found)]
    return "".join(f"\\u{found[a]:04x}-\\u{found[b - 1]:04x}" for a, b in zip(breaks, breaks[1:], strict=False))


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text. Texts below U+10000 go through the standard module, whose classes are tables.

    Both give the same: the standard module gets the code points of each kind spelt out.
    """
    import re

    import regex

    full, wide = regex.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search
    kinds = {kind: ranges_of(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}

    def spelt(token: re.Match) -> str:
        found = token[0]
        if found == r"\S":
            return f"[^{kinds[chr(92) + 's']}]"
        if found.startswith("["):
            for kind, ranges in kinds.items():
                found = found.replace(kind, ranges)
            return found
        return f"[{kinds[found]}]"

    spelt_out = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", spelt, pattern)
    if re.search(r"\\[a-tv-zA-Z]", spelt_out):  # a kind of its own
        return full
    plain = re.compile(spelt_out).findall
    return lambda text: full(text) if not text.isascii() and wide(text) else plain(text)


class Encoder:
    """Ids of slices of texts; words stay known from slice to slice."""

    def __init__(self, path: str | None = None, pattern: str | None = None) -> None:
        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        self.own, self.split = vocabulary(path), splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.starts, self.sizes, self.held = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def learn(self, words: list[bytes]) -> None:
        """Ids of the words, whose numbers follow those of the words before."""
        whole = np.array([self.own.ranks.get(w, -1) for w in words], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, n = replay([words[i] for i in rest], self.own)
        sizes = np.ones(len(words), np.int64)
        sizes[rest] = n
        starts = np.cumsum(sizes) - sizes
        new = np.empty(int(sizes.sum()), np.int32)
        new[starts[whole >= 0]] = whole[whole >= 0]
        new[np.repeat(starts[rest] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.starts, self.sizes = np.append(self.starts, starts + len(self.ids)), np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, new)
        self.held += sum(map(len, words)) + 4 * len(new) + 150 * len(words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > TABLE_BYTES:
            self.forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        parts = [np.fromiter(map(number, self.split(x)), np.int32) for x in texts]
        if len(self.numbers) > known:
            self.learn([w.encode() for w in islice(self.numbers, known, None)])
        words = np.concatenate([np.empty(0, np.int32), *parts])
        n = self.sizes[words]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[words] - (ends - n), n) + np.arange(int(n.sum()))]
        cuts = np.append(0, ends)[np.cumsum([len(p) for p in parts], dtype=np.int64)]
        return np.split(ids, cuts)[:-1]


def map_texts(docs: DataFrame, kernel: Callable[[], Callable[[list[str]], dict]], fields: list[T.StructField]) -> DataFrame:
    """doc_id and columns of the texts; a slice has about SLICE_BYTES of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([docs.schema["doc_id"], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            slice_ = (np.cumsum(size) - size) // SLICE_BYTES
            for at, n in zip(*np.unique(slice_, return_index=True, return_counts=True)[1:], strict=True):
                rows = batch.slice(int(at), int(n))
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id")} | f([x or "" for x in rows.column("text").to_pylist()]), schema=arrow)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row's text."""

    def kernel() -> Callable[[list[str]], dict]:
        run = Encoder(path, pattern).encode
        return lambda texts: {"ids": run(texts)}

    return map_texts(docs, kernel, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of each row's ids."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("bytes", T.BinaryType())])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        token = vocabulary(path).tokens.__getitem__
        return lambda batch: {"doc_id": batch.column("doc_id"), "bytes": [b"".join(map(token, x or ())) for x in batch.column("ids").to_pylist()]}

    return map_slices(encoded.select("doc_id", "ids"), kernel, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes; ids don't leave the worker."""

    def kernel() -> Callable[[list[str]], dict]:
        run, token = Encoder(path).encode, vocabulary(path).tokens.__getitem__
        shown = {rank: str(rank) for rank in vocabulary(path).tokens}.__getitem__

        def digest(texts: list[str]) -> dict:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for found in run(texts):
                ids = found.tolist()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(shown, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(b"".join(map(token, ids))).hexdigest())
            return out

        return digest

    return map_texts(docs, kernel, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
