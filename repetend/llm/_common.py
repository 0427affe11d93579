"""What several operators share: word rules, whole-text kernels over Arrow, reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that a kernel holds as Python objects at a time.
SLICE_ROWS = 256
#: Rows of a few numbers that make a partition.
PART_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def map_slices(df: DataFrame, kernel: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType) -> DataFrame:
    """kernel() is called once a task; what it returns turns a slice of rows into columns of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = kernel()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield pa.RecordBatch.from_pydict(f(batch.slice(at, SLICE_ROWS)), schema=arrow)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, that of spark.checkpoint.dir. Where it is unset, only a session in one process gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="repetend-"))
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all executors share, with its lineage cut."""
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    kept.checkpointed = kept
    return kept


def release(*frames: DataFrame) -> None:
    """Delete the files of what reliable() or compact() gave. Nothing may read them again, so what was made of them is kept itself."""
    for df in frames:
        file = df.checkpointed._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def compact(df: DataFrame) -> DataFrame:
    """reliable(df) in partitions of about PART_ROWS small rows, where it has more; few rows make no thousands of tiny files."""
    kept = reliable(df)
    small = kept.coalesce(max(1, -(-kept.count() // PART_ROWS)))
    small.checkpointed = kept
    return small


def row_id_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names
