"""FASTA and FASTQ files as records.

A FASTA file is read by Spark itself with a line that begins with '>' as the record delimiter, so files split and
compressed ones decompress where Spark does that. The order in a file is kept as an ordinal: the file's name, then the
byte order of its splits. Lines may end in CRLF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repetend.operators import sequences

#: Delimiters of records, without the mark of a file's first record.
FASTA_BREAK, FASTQ_BREAK = "\n>", "\n@"


def fasta_columns(value: Column) -> tuple[Column, Column]:
    """record_id (first word of the header) and seq of what stands between two record delimiters."""
    record = F.regexp_replace(value, "^>", "")
    head = F.regexp_extract(record, r"^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\n]*\n?", ""), r"[\s]+", "")
    return F.regexp_extract(head, r"^\s*(\S*)", 1).alias("record_id"), body.alias("seq")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record_id (first word of the header), ordinal and seq as it stands, without white space at line ends."""
    raw = spark.read.option("lineSep", FASTA_BREAK).text(path)
    # blank lines may stand before the first record
    parts = raw.withColumn("ordinal", F.monotonically_increasing_id()).filter(F.col("value").rlike(r"\S"))
    name, seq = fasta_columns(F.col("value"))
    return parts.select(name, "ordinal", seq)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record_id, ordinal and seq of four-line FASTQ records; sequences and qualities stand on one line each."""
    raw = spark.read.option("lineSep", FASTQ_BREAK).text(path)
    # a quality that begins with the mark is cut off and has too few lines to be a record
    lines = F.split(F.regexp_replace("value", r"^\s*@", ""), "\n")
    rows = raw.withColumn("ordinal", F.monotonically_increasing_id()).select("ordinal", lines.alias("x")).filter(F.size("x") >= 3)
    return rows.select(F.regexp_extract(F.get("x", F.lit(0)), r"^\s*(\S*)", 1).alias("record_id"), "ordinal", F.regexp_replace(F.get("x", F.lit(1)), r"^\s+|\s+$", "").alias("seq"))


def is_fastq(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the first line that isn't blank begins with the mark of FASTQ."""
    first = spark.read.text(path).filter(F.col("value").rlike(r"\S")).first()
    return first is not None and first["value"].lstrip().startswith("@")


def load_records(spark: SparkSession, path: str | list[str], *, min_length: int = sequences.MIN_LENGTH, max_unknown: float = sequences.MAX_UNKNOWN) -> DataFrame:
    """Normalised records of FASTA or FASTQ files (all of one kind) with their status; none is dropped."""
    raw = read_fastq(spark, path) if is_fastq(spark, path) else read_fasta(spark, path)
    return sequences.records(raw, min_length=min_length, max_unknown=max_unknown)


def pair_files(spark: SparkSession, fasta_dir: str, periods_dir: str, *, allow_extra: bool = False) -> DataFrame:
    """stem, fasta and periods of files that belong together: NAME.fa and NAME.periods.tsv.

    A sequence file without periods is an error, and so are periods without a sequence file unless allowed. Only names
    are listed, as many as there are files.
    """
    listed = lambda folder, glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    fasta = listed(fasta_dir, "*.fa").select(F.regexp_replace(name, r"\.fa$", "").alias("stem"), F.col("path").alias("fasta"))
    periods = listed(periods_dir, "*.periods.tsv").select(F.regexp_replace(name, r"\.periods\.tsv$", "").alias("stem"), F.col("path").alias("periods"))
    missing = fasta.join(periods, "stem", "left_anti").select("stem").take(5)
    extra = [] if allow_extra else periods.join(fasta, "stem", "left_anti").select("stem").take(5)
    if missing or extra:
        raise ValueError(f"files without a partner: sequences {[r.stem for r in missing]}, periods {[r.stem for r in extra]}")
    return fasta.join(periods, "stem")
