"""K-mer distance periodograms: kernel and SQL forms of the histogram, peaks, ranks and wide rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import periodogram as kernel
from repetend.kernels import symbols
from repetend.kernels.periodogram import PeriodogramConfig

PEAK = T.StructType(
    [T.StructField("rank", T.IntegerType()), T.StructField("period", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("peak_height", "score", "score2", "score2_norm", "background")]
)
#: Where the kernel has each column of a peak.
_COLUMN = {"period": "period", "peak_height": "height", "score": "score", "score2": "score2", "score2_norm": "share", "background": "background"}
#: Records of an Arrow batch that are in Python at a time; a record may be long.
SLICE = 16


#: Before a costly kernel rows are dealt out: so many parts for each core at least, and so many bytes of files for each part at most.
SPREAD_PARTS, SPREAD_BYTES = 4, 8 << 20
#: Parts of a shuffle that its driver can keep books of: 160 GB of files, beyond which parts grow.
MOST_PARTS = 20000


def spread(df: DataFrame, key: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """df, dealt out by the key: a file's split is one task, whatever its kernel costs, and a task of 128 MB of texts may take hours.

    Parts grow in number with the files that are read, so that a task's share doesn't grow with the input. Rows stay the same.
    """
    if df.isStreaming:
        return df
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [leaves.apply(i) for i in range(leaves.size())]
    # rows that were kept, cached or made have no size that can be trusted
    size = sum(int(str(leaf.stats().sizeInBytes())) for leaf in read if leaf.nodeName() not in ("InMemoryRelation", "LogicalRDD") and "Relation" in leaf.nodeName())
    least = df.sparkSession.sparkContext.defaultParallelism * SPREAD_PARTS
    return df.repartition(max(least, min(-(-size // SPREAD_BYTES), MOST_PARTS)), *key)


def map_records(df: DataFrame, kernel_: Callable[[pa.RecordBatch], dict], schema: T.StructType, rows: int = SLICE, *, costly: bool = True, key: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """A pure function of slices of rows, run over Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df = spread(df, key) if costly else df

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(kernel_(batch.slice(at, rows)), schema=arrow)

    return df.mapInArrow(run, schema)


def peak_lists(found: list[kernel.Peaks], kind: pa.ListType) -> pa.ListArray:
    """Peaks of each record as a list of structs; kind names the columns that they have."""
    columns = {n: lambda p, n=n: getattr(p, _COLUMN[n]) for n in _COLUMN} | {"rank": lambda p: np.arange(1, len(p) + 1)}
    flat = [np.concatenate([columns[f.name](p) for p in found] or [np.empty(0)]) for f in kind.value_type]
    arrays = [pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(flat, kind.value_type, strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind.value_type)), type=kind)


def distance_histogram(recs: DataFrame, k: int = 6) -> DataFrame:
    """record_id, d, h: how often a distance stands between neighbouring equal k-mers."""
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("d", T.IntegerType()), T.StructField("h", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        found = [np.unique(symbols.neighbours(symbols.words(symbols.codes(s or ""), k))[1], return_counts=True) for s in batch.column("seq").to_pylist()]
        ids = np.repeat(np.arange(batch.num_rows), [len(d) for d, _ in found])
        return {
            "record_id": batch.column("record_id").take(pa.array(ids)),
            "d": pa.array(np.concatenate([d for d, _ in found]).astype(np.int32)),
            "h": pa.array(np.concatenate([h for _, h in found]).astype(np.int64)),
        }

    return map_records(recs.select("record_id", "seq"), run, schema, 256, costly=False)


#: Records whose histograms are summed before they leave Python.
POOLED = 1024


def pooled_counts(recs: DataFrame, k: int = 6) -> DataFrame:
    """cohort, of, at, n of records (cohort, seq): how often each distance stands between neighbouring equal k-mers (of is d) and how many have each length (of is length).

    A cohort has several rows of each, one for each slice of records; they are to be summed. Both come from one reading of the sequences.
    """
    schema = T.StructType([recs.schema["cohort"], T.StructField("of", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        own: dict[object, tuple[list[np.ndarray], list[int]]] = {}
        for cohort, seq in zip(batch.column("cohort").to_pylist(), batch.column("seq").to_pylist(), strict=True):
            code = symbols.codes(seq or "")
            distances, lengths = own.setdefault(cohort, ([], []))
            distances.append(symbols.neighbours(symbols.words(code, k))[1])
            lengths.append(len(code))
        cohorts, ofs, ats, ns = [], [], [], []
        for cohort, (distances, lengths) in own.items():
            for of, values in (("d", np.concatenate(distances)), ("length", np.array(lengths, np.int64))):
                counts = np.bincount(values)
                at = np.flatnonzero(counts)
                cohorts += [cohort] * len(at)
                ofs += [of] * len(at)
                ats.append(at.astype(np.int32))
                ns.append(counts[at].astype(np.int64))
        return {"cohort": cohorts, "of": ofs, "at": pa.array(np.concatenate(ats)), "n": pa.array(np.concatenate(ns))}

    return map_records(recs.select("cohort", "seq"), run, schema, POOLED, costly=False)


def distance_histogram_sql(recs: DataFrame, k: int = 6) -> DataFrame:
    """The same by built-in operators: a window over the places of each k-mer. About 25 times slower; kept as a check."""
    long = recs.filter(F.length("seq") >= k)
    words = long.select("record_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substring("seq", i, F.lit(k)))).alias("at", "word")).filter(~F.col("word").rlike("[^ACGT]"))
    before = F.lag("at").over(Window.partitionBy("record_id", "word").orderBy("at"))
    return words.select("record_id", (F.col("at") - before).alias("d")).filter("d is not null").groupBy("record_id", "d").agg(F.count("*").alias("h"))


def periodograms(recs: DataFrame, cfg: PeriodogramConfig = PeriodogramConfig(), *, profiles: bool = False, keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """record_id, length_bp and peaks (array, in order of rank) of each record; with profiles also profile and background.

    Columns of recs named in keep go along. Rows that are dealt out already stay where they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("record_id", T.StringType()), T.StructField("length_bp", T.IntegerType()), T.StructField("peaks", T.ArrayType(PEAK))]
    if profiles:
        fields += [T.StructField("profile", T.ArrayType(T.DoubleType())), T.StructField("background", T.ArrayType(T.DoubleType()))]

    fields += [recs.schema[c] for c in keep]
    kind = to_arrow_schema(T.StructType(fields)).field("peaks").type

    def run(batch: pa.RecordBatch) -> dict:
        ids, seqs = batch.column("record_id").to_pylist(), [symbols.codes(s or "") for s in batch.column("seq").to_pylist()]
        found = [kernel.analyze(i or "", s, cfg) for i, s in zip(ids, seqs, strict=True)]
        out = {"record_id": ids, "length_bp": [len(s) for s in seqs], "peaks": peak_lists([p for p, *_ in found], kind)}
        out |= {"profile": [p for _, p, _ in found], "background": [b for *_, b in found]} if profiles else {}
        return out | {c: batch.column(c) for c in keep}

    return map_records(recs.select("record_id", "seq", *keep), run, T.StructType(fields), costly=not dealt)


def long_peaks(pgrams: DataFrame) -> DataFrame:
    """A row for each peak."""
    return pgrams.select("record_id", F.col("length_bp").alias("array_length"), F.inline("peaks"))


def wide_peaks(pgrams: DataFrame) -> DataFrame:
    """Periods and scores of the three best peaks of each record."""
    columns = []
    for i, tail in enumerate(("", "_2", "_3")):
        peak = F.get("peaks", F.lit(i))
        columns += [peak["period"].alias(f"monomer_size{tail}"), peak["score"].alias(f"score{tail}")]
    return pgrams.select("record_id", F.col("length_bp").alias("array_length"), F.size("peaks").alias("n_peaks_kept"), *columns)


def top_period(peaks: str = "peaks") -> Column:
    """Period of the largest share in an array of peaks; the last of equals."""
    best = F.array_max(F.transform(peaks, lambda p: F.struct(p["score2_norm"].alias("s"), p["rank"].alias("r"), p["period"].alias("p"))))
    return best["p"]


def periodogram_peaks_sql(histogram: DataFrame, lengths: DataFrame, cfg: PeriodogramConfig) -> DataFrame:
    """Peaks without a background by built-in operators, from a sparse histogram: absent distances count as 0."""
    near = histogram.select("record_id", F.col("d").alias("d0"), F.col("h").alias("h0"))
    own = Window.partitionBy("record_id").orderBy("d")
    at = near.withColumnsRenamed({"d0": "d", "h0": "h"})
    left = F.when(F.lag("d").over(own) == F.col("d") - 1, F.lag("h").over(own)).otherwise(0)
    right = F.when(F.lead("d").over(own) == F.col("d") + 1, F.lead("h").over(own)).otherwise(0)
    tops = at.withColumn("l", left).withColumn("r", right).filter("h > l and h > r and d >= 1").join(lengths, "record_id")
    tops = tops.filter("d < length_bp div 2")
    score = F.col("h") / F.greatest(F.col("length_bp") - F.col("d") - cfg.k + 1, F.lit(1))
    scored = tops.withColumn("score", score).withColumn("score2", F.col("score") * F.log2("d"))
    total = F.sum("score2").over(Window.partitionBy("record_id"))
    shared = scored.withColumn("score2_norm", F.when(total > 0, F.col("score2") / total).otherwise(0.0)).filter(F.col("score2_norm") > cfg.least_share)
    rank = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("score"), "d"))
    return shared.select("record_id", F.col("length_bp").alias("array_length"), rank.alias("rank"), F.col("d").alias("period"), F.col("h").cast("double").alias("peak_height"), "score", "score2", "score2_norm", F.lit(0.0).alias("background"))
