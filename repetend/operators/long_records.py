"""Periodograms of records of any length, a chunk of a record at a time.

A record is cut into chunks that overlap by k - 1 symbols, so each k-mer begins in exactly one of them. Chunks are rows
of their own: they are dealt out to tasks, and a task holds one chunk, whatever the record's length. A chunk gives the
distances within it and the first and last place of each of its k-mers. A k-mer's last place in one chunk and its first
in the next one that has it are neighbours too; these are met by a window over record and k-mer, which has a row a
chunk. Partial histograms add up. Random sequences of the background are cut in the same way: the generator jumps to
the chunk's first symbol. All later steps are partitioned by record and stretches of distances; a record's rows come
together only once so few are left as pass the least share of the score.

Results are those of operators.periodogram, which is the way for records that fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import periodogram as kernel
from repetend.kernels import symbols
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.operators import periodogram
from repetend.operators.periodogram import PEAK, map_records
from repetend.operators.sequences import composition
from repetend.operators.shared import checkpointed

#: Symbols of a chunk; distances that a task looks at together.
CHUNK, STRETCH = 1 << 20, 1 << 16
#: Number of the record's own histogram beside those of its random replicates.
OWN = -1
COUNTS = [f"n_{s}" for s in "acgt"]


def chunks(recs: DataFrame, k: int, size: int = CHUNK) -> DataFrame:
    """record_id, chunk, start and piece (bytes) of normalised records, dealt out; piece has up to k - 1 symbols of the next one."""
    # bytes are cut at their offset; characters would be counted from the record's first one
    data = F.encode("seq", "US-ASCII")
    last = F.greatest((F.length("seq") - k) / size, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size + k - 1)))
    rows = recs.filter("seq is not null").select("record_id", *[c for c in COUNTS if c in recs.columns], F.posexplode(pieces).alias("chunk", "piece"))
    return rows.withColumn("start", F.col("chunk").cast("bigint") * size).repartition("record_id", "chunk")


_PARTS = "record_id string, replicate int, chunk int, ds array<struct<d: bigint, h: bigint>>, words array<struct<word: bigint, first: bigint, last: bigint>>"


def partial_histograms(recs: DataFrame, cfg: PeriodogramConfig, size: int = CHUNK) -> DataFrame:
    """What each chunk adds to its record's histogram (replicate OWN) and to those of its random replicates, a row each.

    Rows are kept only where there are replicates: without them it costs less to make both lists twice than to write them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(_PARTS)
    listed = {n: to_arrow_schema(schema).field(n).type for n in ("ds", "words")}

    def lists(name: str, columns: list[list[np.ndarray]]) -> pa.ListArray:
        """One list a row, of structs whose columns come as a list of arrays each."""
        kind = listed[name]
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, columns[0])]), pa.int32()), flat, type=kind)

    def rows(batch: pa.RecordBatch) -> dict:
        heads, found = [], []
        for row in batch.to_pylist():
            code = symbols.codes(row["piece"])
            drawn = [(OWN, code)]
            counts = np.array([row[c] for c in COUNTS]) if cfg.replicates else np.zeros(4)
            if counts.sum():
                drawn += enumerate(kernel.random_codes(row["record_id"] or "", counts, len(code), cfg.replicates, row["start"]))
            for replicate, own in drawn:
                p = kernel.part(own, cfg.k)
                heads.append((row["record_id"], replicate, row["chunk"]))
                found.append((p.distance, p.count, p.word, p.first + row["start"], p.last + row["start"]))
        ids, replicates, numbers = map(list, zip(*heads, strict=True))
        columns = [list(c) for c in zip(*found, strict=True)]
        return {"record_id": ids, "replicate": replicates, "chunk": numbers, "ds": lists("ds", columns[:2]), "words": lists("words", columns[2:])}

    long = recs if not cfg.replicates else recs.select("record_id", "seq").join(composition(recs).select("record_id", *COUNTS), "record_id")
    made = map_records(chunks(long, cfg.k, size), rows, schema, rows=1, costly=False)
    return checkpointed(made) if cfg.replicates else made


def histograms(recs: DataFrame, cfg: PeriodogramConfig, size: int = CHUNK) -> DataFrame:
    """record_id, replicate, d, h over whole records."""
    parts = partial_histograms(recs, cfg, size)
    own = Window.partitionBy("record_id", "replicate", "word").orderBy("chunk")
    words = parts.select("record_id", "replicate", "chunk", F.inline("words"))
    across = words.withColumn("d", F.col("first") - F.lag("last").over(own)).filter("d is not null")
    both = parts.select("record_id", "replicate", F.inline("ds")).unionByName(across.select("record_id", "replicate", "d", F.lit(1).cast("bigint").alias("h")))
    return both.groupBy("record_id", "replicate", "d").agg(F.sum("h").alias("h"))


def in_one_chunk(k: int, size: int) -> Column:
    """Whether a record is one chunk: nothing of it has to meet, and it fits a task as it is."""
    return F.length("seq") < size + k


def distance_histogram(recs: DataFrame, k: int = 6, size: int = CHUNK) -> DataFrame:
    """record_id, d, h, as operators.periodogram.distance_histogram."""
    one = in_one_chunk(k, size)
    found = histograms(recs.filter(~one), PeriodogramConfig(k=k, replicates=0), size)
    return found.select("record_id", F.col("d").cast("int").alias("d"), "h").unionByName(periodogram.distance_histogram(recs.filter(one), k))


def local_maxima(rows: DataFrame, key: str, at: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """Rows whose value is above those one place before and after; absent places have the value 0.

    Stretches of places are looked at each on their own, with the places beside them.
    """
    home, place = F.floor(F.col(at) / stretch), F.col(at) % stretch
    homes = F.array_compact(F.array(home, F.when(place == 0, home - 1), F.when(place == stretch - 1, home + 1)))
    own = Window.partitionBy(key, "stretch_").orderBy(at)
    beside = lambda f, step: F.when(f(at).over(own) == F.col(at) + step, f(value).over(own)).otherwise(0)
    seen = rows.withColumn("stretch_", F.explode(homes)).withColumns({"below_": beside(F.lag, -1), "above_": beside(F.lead, 1)})
    tops = seen.filter((F.col("stretch_") == home) & (F.col(value) > F.col("below_")) & (F.col(value) > F.col("above_")))
    return tops.drop("stretch_", "below_", "above_")


def background(drawn: DataFrame, lengths: DataFrame, cfg: PeriodogramConfig, stretch: int = STRETCH) -> DataFrame:
    """record_id, d, level: the smoothed envelope of the replicates, raised until it holds the envelope up to half the length."""
    reach = int(np.ceil(3 * cfg.sigma)) if cfg.sigma > 0 else 0
    envelope = drawn.groupBy("record_id", "d").agg(F.max("h").alias("h"))
    homes = F.sequence(F.greatest(F.floor((F.col("d") - reach) / stretch), F.lit(0)), F.floor((F.col("d") + reach) / stretch))
    blocks = envelope.withColumn("block", F.explode(homes)).groupBy("record_id", "block").agg(F.collect_list("d").alias("ds"), F.collect_list("h").alias("hs")).join(lengths, "record_id")

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("record_id", "d", "level", "ratio")}
        for row in batch.to_pylist():
            first = row["block"] * stretch
            size = min(stretch, row["length_bp"] + 1 - first)
            if size <= 0:
                continue
            dense = np.zeros(stretch + 2 * reach)
            dense[np.array(row["ds"]) - first + reach] = row["hs"]
            dense[size + reach + max(0, min(reach, row["length_bp"] + 1 - first - size)) :] = 0
            level = kernel.smooth(dense, cfg.sigma)[reach : reach + size]
            own = dense[reach : reach + size]
            at = np.flatnonzero(level > 0)
            ratio = np.where(at + first <= row["length_bp"] // 2, own[at] / level[at], 0.0)
            out["record_id"] += [row["record_id"]] * len(at)
            out["d"] += (at + first).tolist()
            out["level"] += level[at].tolist()
            out["ratio"] += ratio.tolist()
        return out

    schema = T.StructType.fromDDL("record_id string, d bigint, level double, ratio double")
    smoothed = checkpointed(map_records(blocks.select("record_id", "block", "ds", "hs", "length_bp"), rows, schema, rows=1, costly=False))
    raised = smoothed.groupBy("record_id").agg(F.greatest(F.max("ratio"), F.lit(1.0)).alias("times"))
    return smoothed.join(raised, "record_id").select("record_id", "d", (F.col("level") * F.col("times")).alias("level"))


def peaks(recs: DataFrame, cfg: PeriodogramConfig = PeriodogramConfig(), size: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """Ranked peaks of each record as rows, as operators.periodogram.long_peaks gives them; records of one chunk go that way."""
    if cfg.least_distance > 1:
        raise ValueError("peaks of chunked records have no least distance")
    one = in_one_chunk(cfg.k, size)
    return _peaks_of_chunks(recs.filter(~one), cfg, size, stretch).unionByName(periodogram.long_peaks(periodogram.periodograms(recs.filter(one), cfg)))


def _peaks_of_chunks(recs: DataFrame, cfg: PeriodogramConfig, size: int, stretch: int) -> DataFrame:
    lengths = recs.filter(F.length("seq") >= cfg.k + 2).select("record_id", F.length("seq").alias("length_bp"))
    found = histograms(recs, cfg, size)
    found = checkpointed(found) if cfg.replicates else found
    tops = local_maxima(found.filter(F.col("replicate") == OWN).drop("replicate"), "record_id", "d", "h", stretch)
    tops = tops.join(lengths, "record_id").filter("d >= 1 and d < length_bp div 2")
    scored = tops.withColumn("score", F.col("h") / F.greatest(F.col("length_bp") - F.col("d") - cfg.k + 1, F.lit(1)))
    scored = scored.withColumn("score2", F.col("score") * F.log2(F.col("d").cast("double")))
    total = scored.groupBy("record_id").agg(F.sum("score2").alias("total"))
    shared = scored.join(total, "record_id").withColumn("score2_norm", F.when(F.col("total") > 0, F.col("score2") / F.col("total")).otherwise(0.0)).filter(F.col("score2_norm") > cfg.least_share)
    levels = background(found.filter(F.col("replicate") > OWN), lengths, cfg, stretch) if cfg.replicates else None
    met = shared.join(levels, ["record_id", "d"], "left").withColumn("background", F.coalesce("level", F.lit(0.0))) if levels is not None else shared.withColumn("background", F.lit(0.0))
    return _ranked(met)


def _ranked(met: DataFrame) -> DataFrame:
    """Peaks above the background, or else the last of the largest ratios. A record has fewer rows than its least share has parts."""
    all_ = Window.partitionBy("record_id")
    over = F.col("h") > F.col("background")
    ratio = F.struct((F.col("h") / F.greatest("background", F.lit(1.0))).alias("r"), F.col("d").alias("d"))
    chosen = met.withColumns({"any_": F.max(over).over(all_), "best_": F.max(ratio).over(all_)}).filter(over | ~F.col("any_") & (F.col("best_.d") == F.col("d")))
    rank = F.row_number().over(all_.orderBy(F.desc("score"), "d"))
    own: dict[str, Column] = {"rank": rank, "period": F.col("d").cast("int"), "peak_height": F.col("h").cast("double")}
    return chosen.select("record_id", F.col("length_bp").alias("array_length"), *[own.get(n, F.col(n)).alias(n) for n in PEAK.names])
