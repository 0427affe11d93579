"""Short motif scan: regions and a summary of each record."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import motifs as kernel
from repetend.kernels.motifs import MotifConfig
from repetend.operators.periodogram import map_records

REGION = T.StructType(
    [T.StructField("ssr_number", T.IntegerType()), T.StructField("motif_length", T.IntegerType()), T.StructField("motif_sequence", T.StringType())]
    + [T.StructField("repeats", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("normalized_motif", T.StringType())]
)
SUMMARY = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("length_bp", T.IntegerType()),
        T.StructField("ssr_flag", T.StringType()),
        T.StructField("dominant_motif", T.StringType()),
        T.StructField("dominant_motif_length", T.IntegerType()),
        T.StructField("dominant_motif_repeats", T.LongType()),
        T.StructField("dominant_motif_coverage_pct", T.DoubleType()),
        T.StructField("total_ssr_coverage_pct", T.DoubleType()),
        T.StructField("top_motifs", T.StringType()),
        T.StructField("ssr_method", T.StringType()),
        T.StructField("consensus_period_bp", T.IntegerType()),
        T.StructField("consensus_monomer", T.StringType()),
        T.StructField("ssr_raw_dominant_motif", T.StringType()),
        T.StructField("ssr_raw_dominant_motif_coverage_pct", T.DoubleType()),
        T.StructField("ssr_raw_total_coverage_pct", T.DoubleType()),
        T.StructField("ssr_raw_n_regions", T.LongType()),
        T.StructField("ssr_raw_top_motifs", T.StringType()),
        T.StructField("regions", T.ArrayType(REGION)),
    ]
)


def _row(name: str | None, sequence: str, period: int | None, cfg: MotifConfig) -> tuple:
    found = kernel.scan(sequence, period, cfg)
    raw, own = found.raw, found.chosen
    regions = [dict(zip(REGION.names, (i, h.length, h.motif, h.repeats, h.start, h.end, h.canonical), strict=True)) for i, h in enumerate(found.hits, 1)]
    return (
        *(name, len(sequence), "yes" if raw.total >= cfg.flag_pct else "no"),
        *(own.motif, own.motif_length, own.repeats, own.coverage, own.total, own.top, found.method, found.period, found.consensus),
        *(raw.motif, raw.coverage, raw.total, raw.n_regions, raw.top, regions),
    )


def scan(recs: DataFrame, cfg: MotifConfig = MotifConfig()) -> DataFrame:
    """Summary and regions (array) of each record; recs has record_id, seq (raw symbols) and top_period, which may be null."""

    def run(batch: pa.RecordBatch) -> dict:
        columns = (batch.column(c).to_pylist() for c in ("record_id", "seq", "top_period"))
        rows = [_row(i, s or "", p, cfg) for i, s, p in zip(*columns, strict=True)]
        return {name: [r[i] for r in rows] for i, name in enumerate(SUMMARY.names)}

    period = F.col("top_period") if "top_period" in recs.columns else F.lit(None)
    return map_records(recs.select("record_id", "seq", period.cast("int").alias("top_period")), run, SUMMARY)


def regions(scanned: DataFrame) -> DataFrame:
    """A row for each region: start counts from 1, end is the last symbol's number."""
    return scanned.select("record_id", F.inline("regions"))
