"""Filter interaction audit on a packed bitmap index.

Every text is read once: five filters give a mask, and the text's digest finds copies. Rows of a task are then packed
block by block into NumPy bitsets: one of the failing rows for each filter, one for each label. The rows of a block are
clustered by part and every part begins at a whole byte, so a part's own bitset is a run of bytes and AND with it is a
slice. For each set of filters that may stand before another one, AND-NOT and popcounts give the rows that the filter
removes, for all parts of the block at once. Blocks are summed in the task, tasks by an aggregation: a task sends at
most 80 rows for each part that it holds. What an order of the filters does at a step depends only on the set before
it, so all 120 orders are looked up in those sums.

Failure conditions: A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * [A-Z] characters > 10 * code
points; D: holds any of # $ % & * |; E: equal to the text of a smaller doc_id in the table, removed or not. Words are
maximal runs of characters that are not ASCII white space.

Defined results: a null text is empty: it fails A, and E where an empty text of a smaller id exists. A null lang is the
part of the empty string, as an empty lang is. A null doc_id is smaller or larger than none: its row never fails E and
never makes another fail. Repeated rows count each; rows of one id and text don't fail E by each other. Of several
labels of an id any 1 counts; a null label is none. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import map_slices, release, reliable

LETTERS = "ABCDE"
A, B, C, D, E, GOOD, TOXIC = (1 << i for i in range(7))
UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
FOLLOWING = bytes(range(0x80, 0xC0))
MIN_WORDS = 100
#: Rows of one block of the index.
BLOCK = 1 << 16
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FULL = (1 << len(LETTERS)) - 1


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()  # at ASCII white space
    n = len(text)
    capitals, points = n - len(text.translate(None, UPPER)), len(text.translate(None, FOLLOWING))
    return (
        A * (len(words) < MIN_WORDS)
        | B * (100 * len(set(words)) < 80 * len(words))
        | C * (100 * capitals > 10 * points)
        | D * (len(text.translate(None, MARKS)) < n)
    )


def examined(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of A to D, and the text's digest."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def kernel():  # noqa: ANN202
        def run(batch: pa.RecordBatch) -> dict:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            return {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "mask": [failures(x) for x in texts], "digest": [hashlib.sha256(x).digest() for x in texts]}

        return run

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text"), part), kernel, schema)


def subsets() -> list[tuple[int, int]]:
    """(filters before, filter) of every step that some order has."""
    return [(before, f) for before in range(FULL + 1) for f in range(len(LETTERS)) if not before >> f & 1]


def packed_counts(part: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct parts of a block, and for each part and step of subsets() the six COUNTS."""
    order = np.argsort(part, kind="stable")
    names, sizes = np.unique(part, return_counts=True)
    # every part begins at a byte: rows move on by the padding before them
    wide = -(-sizes // 8)
    first = np.concatenate(([0], np.cumsum(wide)[:-1]))
    at = np.arange(len(part)) + np.repeat(8 * first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)

    def bitset(rows: np.ndarray | bool) -> np.ndarray:
        bits = np.zeros(8 * int(wide.sum()), bool)
        bits[at] = rows
        return np.packbits(bits)

    def popcount(bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits), first, dtype=np.int64)

    mask = mask[order]
    rows, fails = bitset(True), [bitset((mask >> f & 1).astype(bool)) for f in range(len(LETTERS))]
    good, toxic = bitset((mask & GOOD).astype(bool)), bitset((mask & TOXIC).astype(bool))
    gone = [np.zeros_like(rows)]
    for before in range(1, FULL + 1):
        low = (before & -before).bit_length() - 1
        gone.append(gone[before & before - 1] | fails[low])
    alone = [popcount(fails[f] & ~gone[FULL & ~(1 << f)]) for f in range(len(LETTERS))]
    counts = []
    for before, f in subsets():
        removed = fails[f] & ~gone[before]
        counts.append([popcount(rows & ~gone[before | 1 << f]), popcount(removed), popcount(fails[f] & gone[before]), alone[f], popcount(removed & good), popcount(removed & toxic)])
    return names, np.array(counts).transpose(2, 0, 1)


def subset_counts(rows: DataFrame) -> DataFrame:
    """part, before, filter and the COUNTS, summed over all rows (part, mask with the bits of filters and labels)."""
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("filter", T.IntegerType())] + [T.StructField(n, T.LongType()) for n in COUNTS])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, steps = to_arrow_schema(schema), subsets()
    before, filter_ = (np.array(x, np.int32) for x in zip(*steps, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        held, n = [], 0

        def count() -> None:
            part = pa.chunked_array([x.column("part") for x in held]).combine_chunks().dictionary_encode()
            mask = np.concatenate([x.column("mask").to_numpy(zero_copy_only=False) for x in held])
            names = part.dictionary.to_pylist()
            found, counts = packed_counts(part.indices.to_numpy(zero_copy_only=False), mask)
            for i, own in zip(found.tolist(), counts, strict=True):
                total[names[i]] = total.get(names[i], 0) + own

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                if n + piece.num_rows > BLOCK:
                    count()
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            count()
        for name, counts in total.items():
            columns = [pa.array([name] * len(steps)), pa.array(before), pa.array(filter_), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    parts = rows.select("part", "mask").mapInArrow(run, schema)
    return parts.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])


def orders(spark) -> DataFrame:  # noqa: ANN001
    """filter_order, step, before and filter of all 600 steps of the 120 orders."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(LETTERS[i] for i in order), step, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def marked(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """part and mask of every row, with the bits of all five filters and both labels; and what it reads, to be released."""
    own = reliable(examined(docs))
    # kept apart from the join, whose hot digests the adaptive plan can then split
    twins = reliable(own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"))
    kinds = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("labelled"))
    marks = reliable(kinds.agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad")))
    met = own.join(marks, own["doc_id"] == marks["labelled"], "left").select("doc_id", "part", "mask", "digest", (F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("bad", F.lit(0)) * TOXIC).alias("marks"))
    both = met.join(twins, "digest", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), E).otherwise(0)
    return both.select("part", (F.col("mask") + copy + F.col("marks")).alias("mask")), [own, twins, marks]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    rows, held = marked(docs, labels)
    sums = reliable(subset_counts(rows))
    release(*held)
    # orders in which the filters of `before` come first, then the filter, then the rest
    size = F.bit_count("before")
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(LETTERS) - 1 - k)) for k in range(len(LETTERS))]), size + 1)
    shapley = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = sums.join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"])
    return steps.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
