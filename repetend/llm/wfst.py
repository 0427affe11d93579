"""SentencePiece encoding and decoding with weighted finite-state transducers.

Three transducers are compiled from a model file; every arc reads, writes and weighs something. The normaliser's arcs map
a space to U+2581, write one before the text and, where the model says so, drop spaces at both ends and after a space. The
pieces' arcs form a trie: a path from its root reads a piece's characters, writes its id and weighs what the piece
weighs. The fallback's arcs read one character that is no piece and write the ids of its bytes. They are composed with
each input as it is read. A state of the composition is a place of the input with the piece before it, and the path of
least weight to the last place, found best first (weights are not negative and add along a path), is the encoding.

In a unigram model a piece weighs its negative score (scores above 0 are refused). A BPE model's result is not the path
of least scores, so its merge order is compiled into weights of two neighbouring pieces: infinity unless merging their joined
text gives just these two, else nothing. An encoding all of whose neighbours weigh nothing is the one that merging gives for the
whole text, so each place is reached with one piece only, and the same search finds it. Of equal weights the longer
piece goes first.

Where no piece has a U+2581 after another character, paths through a word's end don't depend on what follows; words
are composed one by one then, and frequent ones are kept, at most KEPT of them.

Defined results: a null text has null ids, an empty text none. Decoding joins pieces and bytes, replaces bytes that are
no UTF-8, turns U+2581 into spaces and drops the one before the text; it gives the text back if that had no U+2581.
Rows stand on their own; columns besides doc_id and text are ignored. Texts are read whole, in time linear in length.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import map_slices

BLANK = "▁"
#: Runs of spaces (True) and of other characters.
RUN = {True: re.compile(" +"), False: re.compile("[^ ]+")}
#: Words and pairs of pieces that a task keeps.
KEPT, KEPT_PAIRS = 250_000, 1_500_000
# Fixed values of the model format: kinds of model and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN_PIECE, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer's fields; bytes for strings and messages."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"field of kind {kind}")


class Normaliser:
    """A transducer on runs: arcs[state][whether a space] = (next state, written for each character; None copies it, written first)."""

    def __init__(self, prefix: bool, squeeze: bool) -> None:
        first = BLANK if prefix else ""
        if squeeze:
            start = {True: (0, "", ""), False: (1, None, first)}
            self.arcs = [start, {True: (2, "", ""), False: (1, None, "")}, {True: (2, "", ""), False: (1, None, BLANK)}]
        else:
            after = {True: (1, BLANK, ""), False: (1, None, "")}
            self.arcs = [{c: (to, out, first) for c, (to, out, _) in after.items()}, after]

    def compose(self, text: str) -> str:
        # a last state that only leads to itself and writes nothing first is a map of characters
        state, at, written, n = 0, 0, [], len(text)
        while at < n:
            here = self.arcs[state]
            if all(to == state and not first for to, _, first in here.values()):
                written.append(text[at:].replace(" ", here[True][1]))
                break
            blank = text[at] == " "
            to, out, first = here[blank]
            end = at + 1
            if to == state or not blank:
                end = RUN[blank].match(text, at).end()
            written.append(first + (text[at:end] if out is None else out * (end - at)))
            state, at = to, end
        return "".join(written)


class Transducer:
    """A model file's transducers; encode() composes them with a text."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        fallback, unknown = False, 0
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                self.kind, fallback, unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
                if trainer.get(24, 0):
                    raise ValueError("white space as a suffix isn't supported")
            elif number == 3:
                rules = dict(fields(value))
                self.prefix, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
                if rules.get(2) or not self.escape:
                    raise ValueError("only the identity normaliser with escaped spaces is supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(k == USER for *_, k in self.pieces):
            raise ValueError("user-defined pieces aren't supported")
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.fallback, self.unknown = fallback and len(self.bytes) == 256, unknown
        self.scores = {p: s for p, s, k in self.pieces if k == NORMAL}
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.normaliser = Normaliser(self.prefix, self.squeeze)
        low, high = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY, max(self.scores.values(), default=0.0)
        if self.kind == UNIGRAM and high > 0:
            raise ValueError("scores above 0 aren't supported: the search takes weights that are not negative")
        self.weigh = [0.0 if self.kind == BPE else -s for _, s, _ in self.pieces]
        self.unread = 0.0 if self.kind == BPE else -low
        self.root: dict = {}
        for piece, i in self.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        merging = {c for p in self.ids if len(p) > 1 for c in p}
        inert = "".join(c for c in map(chr, range(128)) if c not in merging)
        apart = not any(a != BLANK and b == BLANK for p in self.ids for a, b in zip(p, p[1:], strict=False))
        alone = "[" + re.escape(inert) + "]" if inert else "(?!)"
        self.words = re.compile(f"{alone}|{BLANK}*[^{BLANK}{re.escape(inert)}]+|{BLANK}+" if apart else r"(?s).+")
        self.written = [_written(p, k) for p, _, k in self.pieces]
        self.kept: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # weights of the piece transducer

    def merged(self, text: str) -> list[str]:
        """What merging gives: the neighbours whose joined piece scores highest first, from the left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, arc: int) -> str:
        return self.pieces[arc][0] if arc >= 0 else chr(-arc - 1)

    def allowed(self, last: int, arc: int) -> bool:
        """If the pair's weight is finite."""
        known = self.pairs.get((last, arc))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self._text(last), self._text(arc)
            known = self.pairs[last, arc] = self.merged(a + b) == [a, b]
        return known

    def first_allowed(self, arc: int) -> bool:
        """If a piece is what merging its own text gives."""
        known = self.pairs.get((arc, arc, 0))
        if known is None:
            known = self.pairs[arc, arc, 0] = len(self.merged(self._text(arc))) == 1
        return known

    # composition and shortest path

    def path(self, text: str) -> list[int]:
        """Arcs of the path of least weight: ids of pieces, or -1 - code point for the fallback."""
        root, weigh, ordered, pairs = self.root, self.weigh, self.kind == BPE, self.pairs
        n, closed, heap, node = len(text), set(), [], None
        at, cost = 0, 0.0
        while at < n:
            # arcs that read the text from here on
            state, end, one = root, at, False
            while end < n and (state := state.get(text[end])) is not None:
                end += 1
                if (arc := state.get("")) is not None:
                    one = one or end == at + 1
                    if end not in closed:
                        heappush(heap, (cost + weigh[arc], -end, arc, node))
            if not one and at + 1 not in closed:
                heappush(heap, (cost + self.unread, -1 - at, -1 - ord(text[at]), node))
            while True:
                cost, end, arc, node = heappop(heap)
                if -end in closed:
                    continue
                if ordered:
                    if node is None:
                        fine = self.first_allowed(arc)
                    else:
                        fine = pairs.get((node[0], arc))
                        if fine is None:
                            fine = self.allowed(node[0], arc)
                    if not fine:
                        continue
                break
            at, node = -end, (arc, node)
            closed.add(at)
        out = []
        while node:
            out.append(node[0])
            node = node[1]
        return out[::-1]

    def _outputs(self, text: str) -> tuple[int, ...]:
        """What the arcs of the path write; unknown pieces in a row are one."""
        out: list[int] = []
        for arc in self.path(text):
            if arc >= 0:
                out.append(arc)
            elif self.fallback:
                out += self.read_as_bytes(arc)
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def read_as_bytes(self, arc: int) -> list[int]:
        """Output of a fallback arc."""
        return [self.bytes[b] for b in chr(-1 - arc).encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> list[int]:
        kept, ids = self.kept, []
        for word in self.words.findall(self.normaliser.compose(text)):
            found = kept.get(word)
            if found is None:
                found = self._outputs(word)
                if len(word) <= 64:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[word] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: pieces and bytes back to text."""
        text = b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _written(piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes((int(piece[1:-1], 16),))
    return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN_PIECE else piece.encode()


@lru_cache(1)
def load(path: str | None = None) -> Transducer:
    """Transducers of a model file, kept with their words and pairs for later tasks of the same worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as model:
        return Transducer(model.read())


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        model = load(path)
        return lambda batch: {"doc_id": batch.column("doc_id"), "ids": [None if x is None else model.encode(x) for x in batch.column("text").to_pylist()]}

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        model = load(path)
        return lambda batch: {"doc_id": batch.column("doc_id"), "text": [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]}

    return map_slices(encoded.select("doc_id", "ids"), kernel, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Number, checksum and byte fallbacks of each text's ids, and if decoding gives the text back; null text is empty."""
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_ids", "n_byte_ids", "ids_crc32")], T.StructField("round_trip", T.BooleanType())])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        model = load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.bytes.values())] = True

        def run(batch: pa.RecordBatch) -> dict:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = [model.encode(x) for x in texts]
            return {
                "doc_id": batch.column("doc_id"),
                "n_ids": [len(x) for x in ids],
                "n_byte_ids": [int(is_byte[x].sum()) if x else 0 for x in ids],
                "ids_crc32": [zlib.crc32(array("I", x).tobytes()) for x in ids],
                "round_trip": [model.decode(x) == t for x, t in zip(ids, texts, strict=True)],
            }

        return run

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)
