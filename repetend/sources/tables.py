"""Tab-separated stage files, read by column name with fixed types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells that stand for no value.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str | list[str], required: dict[str, str], optional: dict[str, str] | None = None, *, strict: bool = False) -> DataFrame:
    """Columns by name as the given types; strict fails on cells that don't parse, else they are null. All other columns stay as text."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    if missing := [c for c in required if c not in raw.columns]:
        raise ValueError(f"columns are missing: {missing}")
    kinds = required | {c: k for c, k in (optional or {}).items() if c in raw.columns}

    def typed(c: str) -> Column:
        cell = F.when(~F.col(f"`{c}`").isin(*NA), F.col(f"`{c}`"))
        if c not in kinds:
            return cell.alias(c)
        return (cell.cast(kinds[c]) if strict else cell.try_cast(kinds[c])).alias(c)

    return raw.select(*[typed(c) for c in raw.columns])


PEAK_COLUMNS = {"case_id": "string", "rank": "int", "period": "int", "score2_norm": "double"}
PEAK_OPTIONAL = {"array_length": "int", "peak_height": "double", "score": "double", "score2": "double", "background": "double"}


def read_peaks(spark: SparkSession, path: str | list[str], *, lenient: bool = False) -> DataFrame:
    """Peak rows; without array_length it is 0, which turns the copies' gate off. lenient reads malformed cells as 0."""
    rows = read_tsv(spark, path, PEAK_COLUMNS, PEAK_OPTIONAL, strict=not lenient).withColumnRenamed("case_id", "record_id")
    if "array_length" not in rows.columns:
        rows = rows.withColumn("array_length", F.lit(0))
    return rows.fillna(0, subset=["rank", "period", "score2_norm"]) if lenient else rows


def grouped_peaks(peaks: DataFrame) -> DataFrame:
    """One row a record: its length, and its peaks in order of rank."""
    return peaks.groupBy("record_id").agg(F.max("array_length").alias("array_length"), F.array_sort(F.collect_list(F.struct("rank", "period", "score2_norm"))).alias("peaks"))


def top_periods(peaks: DataFrame) -> DataFrame:
    """Period of the largest share of each record, the first of equals."""
    order = Window.partitionBy("record_id").orderBy(F.desc("score2_norm"), "rank")
    return peaks.withColumn("place", F.row_number().over(order)).filter("place = 1").select("record_id", F.col("period").alias("top_period"))


def read_wide_periods(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record_id and period of the wide peak file: the period of the best score."""
    return read_tsv(spark, path, {"case_id": "string", "monomer_size": "double"}).select(F.col("case_id").alias("record_id"), F.col("monomer_size").alias("period"))


def read_verdicts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    kinds = {"case_id": "string", "verdict": "string", "founder": "double", "multiplicity": "double", "tile": "double"}
    rows = read_tsv(spark, path, kinds, {"founder_score": "double", "tile_score": "double", "confidence": "double", "n_clusters": "int", "reason": "string"})
    return rows.withColumnRenamed("case_id", "record_id").withColumn("multiplicity", F.floor(F.col("multiplicity") + 0.5).cast("int"))


def read_periods(spark: SparkSession, path: str | list[str], default_id: str = "") -> DataFrame:
    """record_id, period_bp and the best period_score in 0 to 1 of each period; malformed cells are errors."""
    rows = read_tsv(spark, path, {"period_bp": "int", "period_score": "double"}, {"array_id": "string", "source": "string"}, strict=True)
    own = F.col("array_id") if "array_id" in rows.columns else F.lit(None).cast("string")
    fine = F.col("period_score").between(0.0, 1.0)
    checked = F.when(fine, F.col("period_score")).otherwise(F.raise_error(F.lit("period_score must be between 0 and 1")))
    return rows.select(F.coalesce(own, F.lit(default_id)).alias("record_id"), "period_bp", checked.alias("period_score")).groupBy("record_id", "period_bp").agg(F.max("period_score").alias("period_score"))


GRID_REQUIRED = {"case_id": "string", "monomer_len": "int", "hor_order": "int", "n_blocks": "int"}
GRID_OPTIONAL = {"sub_rate_intra": "double", "sub_rate_inter": "double", "indel_rate_intra": "double", "indel_rate_inter": "double", "block_conversions": "int", "monomer_conversions": "int", "submono_k": "int", "seed": "long"}


def read_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_tsv(spark, path, GRID_REQUIRED, GRID_OPTIONAL, strict=True)
