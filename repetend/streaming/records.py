"""The stateless steps over a stream of records: each micro-batch goes through the same kernels as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repetend.kernels.periodogram import PeriodogramConfig
from repetend.operators import periodogram, sequences, verdicts
from repetend.sources import fasta


def read_fasta_stream(spark: SparkSession, folder: str, *, max_files: int | None = None) -> DataFrame:
    """Records (record_id, seq) of files that arrive in a folder; max_files of them at most make a micro-batch."""
    reader = spark.readStream.option("lineSep", fasta.FASTA_BREAK)
    raw = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(folder).filter(F.col("value").rlike(r"\S"))
    return raw.select(*fasta.fasta_columns(F.col("value")))


def write_verdicts(stream: DataFrame, path: str, checkpoint: str, cfg: PeriodogramConfig = PeriodogramConfig()) -> StreamingQuery:
    """Verdicts of each record as Parquet, a folder for each micro-batch; a batch that runs again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        recs = sequences.records(rows)
        verdicts.judged(periodogram.periodograms(recs, cfg)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
