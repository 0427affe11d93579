"""Hierarchical multi-length packing of token sequences.

A document is its token ids and the end id. It is cut into whole windows and one remainder; the remainder is routed to
the shortest context tier that holds it. Tiers are packed from the longest down. A sequence of a tier holds as many
windows of the tier's size as fit in the full size. Each is opened by the longest piece left that the tier's size holds, and its gap is
filled with the longest pieces that fit, which the tier itself and shorter ones give; what stays open of a window goes
to the next one of the sequence, so that the last one's gap is the sequence's. So long windows take what they need from
short tiers, and no piece stands in a tier too short for it. Sequences are numbered by tier, from the fullest to the
emptiest, and dealt round to step groups: every group gets the same mix of tiers and nearly the same number of tokens.

Placement needs lengths only, and there are at most `size` different ones. So the plan is made for counts of lengths,
not for pieces: its input and output are bounded whatever the corpus holds. A piece finds its place by its rank among
pieces of its length; ranks are counted within salted parts of each length and offset, so no task holds a whole length.
A length has SALTS parts, or as many as keep PART_PIECES pieces in each where it has more, as whole windows have. So the
offsets of parts that are broadcast are at most size * SALTS rows and one for each PART_PIECES pieces.
A piece may stand across two windows of a sequence, as the gap of one is carried to the next.

Defined results: a null or empty text is the end id alone. Rows that are equal in every column are packed each on
their own. A null doc_id is kept. Columns besides doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import map_slices, reliable

SIZE, END_ID = 2048, 1
#: Context sizes that remainders are routed to.
TIERS = (256, 512, 1024, 2048)
#: Sequences of one step group; parts of each length's rank.
GROUP_SEQUENCES, SALTS = 64, 64
#: Pieces that a part of a length holds on average at most.
PART_PIECES = 1_000_000
#: From here on characters go through the slower library, whose Unicode tables decide.
PLAIN_BELOW = "ɐ"
SPECIAL = "<|endoftext|>"


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts as the JSON file's tokenizer gives them; texts of plain letters take the same merges, compiled for speed."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if SPECIAL in text or not (text.isascii() or max(text) < PLAIN_BELOW):
            return exact.encode(text, add_special_tokens=False).ids
        return plain.encode_ordinary(text)

    return lambda texts: [ids(x) for x in texts]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of whole windows and the remainder of each document."""
    kind = docs.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in names])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        encode = encoder(json_path, ranks_path)

        def cut(batch: pa.RecordBatch) -> dict:
            rows, out = [], {n: [] for n in names}
            for row, tokens in enumerate(encode([x or "" for x in batch.column("text").to_pylist()])):
                tokens.append(end_id)
                packed = memoryview(array("I", tokens).tobytes())
                for start in range(0, len(tokens), size):
                    part = packed[4 * start : 4 * (start + size)]
                    rows.append(row)
                    for name, value in zip(names, (start, len(part) // 4, zlib.crc32(part), len(tokens)), strict=True):
                        out[name].append(value)
            return {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), **out}

        return cut

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)


def plan(counts: dict[int, int], size: int = SIZE, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, list[int]]]:
    """(number of sequences, their tier, lengths in each of them), by tier from the longest, then from the fullest."""
    left = [counts.get(n, 0) for n in range(size + 1)]
    below = list(range(size + 1))  # below[n]: a length of at most n that may be left; found with path halving

    def longest(gap: int) -> int:
        while gap and (not left[gap] or below[gap] != gap):
            if below[gap] == gap:
                below[gap] = gap - 1
            else:
                below[gap] = below[below[gap]]
            gap = below[gap]
        return gap

    sizes = sorted({t for t in tiers if t < size} | {size}, reverse=True)
    done = []
    for tier, shorter in zip(sizes, [*sizes[1:], 0], strict=True):
        windows = size // tier
        while (length := longest(tier)) > shorter:
            opened = max(1, left[length] // (size // length))
            left[length] -= opened
            # sequences alike, the gap of their open window, the windows still to open, the lengths they have
            stack = [(opened, tier - length + (size % tier if windows == 1 else 0), windows - 1, (length,))]
            while stack:
                n, gap, more, has = stack.pop()
                fill = longest(min(gap, tier))
                if not fill and more:
                    # the next window, which takes the gap over; the last one what no window covers
                    gap, more = gap + tier + (size % tier if more == 1 else 0), more - 1
                    fill = longest(min(gap, tier))
                    if not fill:
                        more = 0
                if not fill:
                    done.append((n, tier, list(has)))
                    continue
                taken = min(n, left[fill])
                left[fill] -= taken
                if n > taken:
                    stack.append((n - taken, gap, more, has))
                stack.append((taken, gap - fill, more, (*has, fill)))
    return sorted(done, key=lambda x: (-x[1], -sum(x[2]), x[2]))


def slots(sequences: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset, tier): where pieces of a length go."""
    out, ranks, sequence = [], {}, 0
    for n, tier, lengths in sequences:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            out.append((length, first, first + n, sequence, offset, tier))
            ranks[length] = first + n
            offset += length
        sequence += n
    return out


def place(cut: DataFrame, *, size: int = SIZE, tiers: tuple[int, ...] = TIERS, group_sequences: int = GROUP_SEQUENCES, salts: int = SALTS, part_pieces: int = PART_PIECES) -> DataFrame:
    """Pieces with sequence_id, offset, their tier, the tier of the sequence and step_group. cut is read three times; keep it first."""
    spark = cut.sparkSession
    sizes = reliable(cut.groupBy("length").agg(F.count("*").alias("n")))  # at most size rows
    counts = {r["length"]: r["n"] for r in sizes.collect()}
    n_parts = F.greatest(F.lit(salts).cast("long"), F.ceil(F.col("n") / part_pieces))
    salted = cut.join(F.broadcast(sizes.select("length", n_parts.alias("n_parts"))), "length")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "n_parts")).drop("n_parts")
    parts = reliable(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    sequences = plan(counts, size, tiers)
    groups = max(1, -(-sum(n for n, *_ in sequences) // group_sequences))
    targets = spark.createDataFrame(slots(sequences), "length long, low long, high long, first long, offset long, sequence_tier int")
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    placed = ranked.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rank") - 1)
    placed = placed.join(F.broadcast(targets), (placed["length"] == targets["length"]) & (placed["rank"] >= targets["low"]) & (placed["rank"] < targets["high"])).drop(targets["length"])
    tier = F.coalesce(*[F.when(F.col("length") <= t, F.lit(t)) for t in sorted(tiers)], F.lit(size))
    sequence = F.col("first") + F.col("rank") - F.col("low")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset", tier.alias("tier"), "sequence_tier", (sequence % groups).alias("step_group"))


def pack(docs: DataFrame, *, size: int = SIZE, end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, group_sequences: int = GROUP_SEQUENCES, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row for each piece, with its place in a sequence of at most size tokens."""
    kept = reliable(pieces(docs, size, end_id, json_path, ranks_path))
    return place(kept, size=size, tiers=tiers, group_sequences=group_sequences)
