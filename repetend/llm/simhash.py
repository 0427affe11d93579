"""SimHash near-duplicates by multi-index hashing.

A fingerprint has one bit for each bit of the 64-bit hashes of a text's word shingles: 1 if set in over half of them.
The distinct fingerprints are indexed in two tables, one for each half of 32 bits. Two fingerprints that differ in at
most three bits differ in at most one bit in one of the halves. So each fingerprint enumerates the Hamming ball of
radius one around its two halves, fetches equal keys from the tables, and every fetched pair is verified on all 64 bits.
Copies share a fingerprint and are never paired: whatever a group's size, its documents enter the tables once.

Components of the links come from hooking every node to its least neighbour and halving paths until nothing changes.
Labels of each round are written to the shared checkpoint folder.

Defined results: texts without words have fingerprint zero and link like any other; null text is empty. A component's
name is its least doc_id; null doc_ids belong to components but never name one that has another id. Rows that repeat
are rows of the same component. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import compact, map_slices, release, reliable, row_id_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, SEED, RADIUS = 3, 42, 3
HALF = 32
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (big-endian, 64 bits) have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [" ".join(words)]
    return majority(np.fromiter((xxh64_intdigest(g, seed) for g in grams), ">u8", n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, tie: Column | None = None) -> DataFrame:
    """doc_id and the fingerprint as a signed long; with tie, that column too."""
    more = [] if tie is None else [T.StructField("tie", T.LongType())]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), *more])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        def run(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))} | {f.name: batch.column(f.name) for f in more}

        return run

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text"), *([] if tie is None else [tie.alias("tie")])), kernel, schema)


def _half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, HALF * which).bitwiseAND(F.lit((1 << HALF) - 1))


def _keyed(distinct: DataFrame, ball: bool) -> DataFrame:
    """table, key and fp of both halves; with ball, a row for every key at most one bit away."""
    masks = [0] + [1 << i for i in range(HALF)] if ball else [0]
    rows = F.array(*[F.struct(F.lit(w).alias("half"), _half(F.col("fp"), w).alias("value")) for w in (0, 1)])
    halves = distinct.select("fp", F.inline(rows)) if not ball else distinct.select("fp", F.inline(rows)).withColumn("mask", F.explode(F.lit(masks).cast("array<bigint>")))
    key = F.col("value").bitwiseXOR(F.col("mask")) if ball else F.col("value")
    # the table is a bit above the half's 32
    return halves.select(key.bitwiseOR(F.shiftleft(F.col("half").cast("bigint"), HALF)).alias("key"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints that differ in at most radius bits; radius is 3 at most."""
    if radius > 3:
        raise ValueError("two tables with balls of radius one find three bits at most")
    table = _keyed(distinct, ball=False).withColumnRenamed("fp", "b")
    probes = _keyed(distinct, ball=True).withColumnRenamed("fp", "a")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # 66 probes for each fingerprint, which Spark doesn't see: by its sizes it would broadcast them
    found = probes.join(table.hint("merge"), (probes["key"] == table["key"]) & (F.col("a") < F.col("b")) & near)
    return found.select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in a pair; the root is the component's least node."""
    both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = compact(pairs.select(F.inline(both)))
    labels = compact(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    held = labels
    while True:
        seen = edges.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        # a root takes the least label that its members have seen, so whole trees hook at once
        lower = labels.join(seen, "node").select("node", "root", F.least("root", "m").alias("low"))
        hooks = lower.groupBy("root").agg(F.min("low").alias("to"))
        hooked = lower.join(hooks, "root").select("node", "root", F.least("low", "to").alias("to"))
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("far"))
        after = compact(hooked.join(jump, "to", "left").select("node", F.col("root").alias("was"), F.least("to", F.coalesce("far", "to")).alias("root")))
        changed = after.filter("was <> root").limit(1).count()
        release(held)
        held, labels = after, after.select("node", "root")
        if not changed:
            release(edges)
            return labels


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row."""
    rows = reliable(fingerprints(docs.select("doc_id", "text"), shingle))
    distinct = reliable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = rooted(distinct, radius)
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct (fp, least) with each fingerprint's root."""
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The row of least doc_id of each component, with all its columns; null ids come last, ties go by the text's hash."""
    rows = reliable(fingerprints(docs.select("doc_id", "text"), shingle, F.xxhash64("text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie"))
    distinct = reliable(rows.groupBy("fp").agg(first.alias("least")))
    kept = rooted(distinct, radius).groupBy("root").agg(F.min("least").alias("least"))
    id_, tie, own = row_id_columns(docs, ["kept_id", "kept_tie", "own_tie"])
    kept = kept.select(F.col("least.doc_id").alias(id_), F.col("least.tie").alias(tie))
    same = docs["doc_id"].eqNullSafe(kept[id_]) & (F.xxhash64(docs["text"]) == kept[tie])
    marked = docs.withColumn(own, F.xxhash64("text")).join(kept, same, "left_semi")
    return marked.dropDuplicates(["doc_id", own]).select(*docs.columns)
