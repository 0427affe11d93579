"""Screens arrays for tandem and higher-order repeats as their files arrive.

A file stream takes the files that no earlier run has taken; its checkpoint says which these are. Each micro-batch
becomes three tables, each with a folder of its own:

    OUTPUT/arrays/batch=N                record_id, length_bp, n_count, status, peaks (in order of rank)
    OUTPUT/verdicts/batch=N/verdict=V    the verdict on each array whose status is ok
    OUTPUT/periods/batch=N/source=S      candidate periods for the width detector

Verdicts and periods are made of the written peaks, so sequences are read once and a lost executor costs no kernel
twice. A micro-batch that runs again, after a failure, overwrites its own folders: results are the same as of one run.
A run without new files changes nothing. Output and checkpoint belong together: neither may be used with another one.

    python -m jobs.screen_arrays --source FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]
"""

from __future__ import annotations

from argparse import Namespace
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import arrays, command, configured, log
from repetend.operators import periodogram, sequences, verdicts
from repetend.operators.periodogram import PeriodogramConfig
from repetend.streaming.records import read_fasta_stream

CONFIG = Path(__file__).with_suffix(".toml")
TABLES = ("arrays", "verdicts", "periods")
JUDGED = "record_id string, founder double, multiplicity int, tile double, founder_score double, tile_score double, confidence double, n_clusters int, reason string"


@dataclass(frozen=True)
class Config:
    format: str = "parquet"
    key: str = "doc_id"
    text: str = "text"
    alphabet: str = "prose"
    min_length: int = sequences.MIN_LENGTH
    max_unknown: float = sequences.MAX_UNKNOWN
    replicates: int = 10
    max_files: int = 64


def arriving(spark: SparkSession, source: str, cfg: Config) -> DataFrame:
    """Rows of files that arrive at source: record_id and seq of FASTA, key and text of Parquet."""
    if cfg.format == "fasta":
        return read_fasta_stream(spark, source, max_files=cfg.max_files)
    if cfg.format != "parquet":
        raise ValueError(f"format is fasta or parquet, not {cfg.format}")
    # a stream has its columns from the files that are there when it starts
    schema = spark.read.parquet(source).select(cfg.key, cfg.text).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", cfg.max_files).parquet(source)


def dealt_out(rows: DataFrame, cfg: Config) -> DataFrame:
    """record_id and seq of rows. Texts are dealt out before they become symbols, which costs as much as the kernel."""
    if cfg.format == "fasta":
        return periodogram.spread(rows)
    return arrays(periodogram.spread(rows, (cfg.key,)), cfg.key, cfg.text, cfg.alphabet)


def screen(rows: DataFrame, number: int, output: str, cfg: Config) -> None:
    """The three tables of one micro-batch."""
    spark, at = rows.sparkSession, {t: f"{output}/{t}/batch={number}" for t in TABLES}
    recs = sequences.records(dealt_out(rows, cfg), min_length=cfg.min_length, max_unknown=cfg.max_unknown, fold=cfg.format == "fasta")
    # arrays without a verdict have no peaks to look for: their sequence needn't go through the kernel
    ok = F.col("status") == sequences.OK
    examined = recs.withColumn("seq", F.when(ok, F.col("seq")).otherwise("")).withColumnRenamed("length_bp", "own_bp")
    found = periodogram.periodograms(examined, PeriodogramConfig(replicates=cfg.replicates), keep=("own_bp", "n_count", "status"), dealt=True)
    found.select("record_id", F.col("own_bp").alias("length_bp"), "n_count", "status", "peaks").write.mode("overwrite").parquet(at["arrays"])

    kept = spark.read.parquet(at["arrays"]).filter(ok)
    peaks = periodogram.long_peaks(kept)
    verdicts.judged(kept).write.mode("overwrite").partitionBy("verdict").parquet(at["verdicts"])
    judged = spark.read.schema(f"{JUDGED}, verdict string").parquet(at["verdicts"])
    verdicts.emitted_periods(verdicts.short_verdicts(judged), peaks).write.mode("overwrite").partitionBy("source").parquet(at["periods"])
    taken = spark.read.parquet(at["arrays"]).groupBy("status").count().collect()
    n = [spark.read.schema("record_id string").parquet(at[t]).count() for t in TABLES[1:]]
    log.info("batch %d: took %s; wrote %d verdicts and %d periods", number, {r["status"]: r["count"] for r in taken}, *n)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, cfg: Config = Config()) -> int:
    """Take what is new at source; the number of micro-batches that this took."""
    stream = arriving(spark, source, cfg).writeStream.foreachBatch(lambda rows, number: screen(rows, number, output, cfg))
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    log.info("%s: %s", source, f"{batches} micro-batches went to {output}" if batches else "nothing new")
    return batches


def read(spark: SparkSession, output: str, table: str) -> DataFrame:
    """All that runs have written of a table so far, with its batch."""
    kinds = {"verdicts": f"{JUDGED}, batch int, verdict string", "periods": "record_id string, period_bp int, period_score double, batch int, source string"}
    reader = spark.read.schema(kinds[table]) if table in kinds else spark.read
    return reader.parquet(f"{output}/{table}")


def main() -> None:
    def job(spark: SparkSession, args: Namespace) -> None:
        run(spark, args.source, args.output, args.checkpoint, configured(Config, args.config))

    paths = {"source": "folder that files arrive in, or a pattern", "output": "folder of the three tables", "checkpoint": "folder of the stream's checkpoint"}
    command("screen_arrays: verdicts and periods of arrays as they arrive", paths, CONFIG, job)


if __name__ == "__main__":
    main()
