"""Indel irregularity of each record at a period."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import register as kernel
from repetend.kernels.register import RegisterConfig
from repetend.operators.periodogram import map_records

SCHEMA = T.StructType(
    [T.StructField("record_id", T.StringType()), T.StructField("array_length", T.IntegerType()), T.StructField("period_p", T.DoubleType()), T.StructField("n_kmer_groups", T.IntegerType())]
    + [T.StructField("n_pairs_total", T.LongType()), T.StructField("baseline_jitter_bp", T.DoubleType()), T.StructField("indel_event_count", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("indel_burden_pct", "indel_max_shift_bp", "indel_drift_bp_per_kb")]
    + [T.StructField("dropout_event_count", T.LongType()), T.StructField("dropout_rate_per_pair", T.DoubleType()), T.StructField("flag", T.StringType()), T.StructField("notes", T.StringType())]
)


def scan(recs: DataFrame, cfg: RegisterConfig = RegisterConfig()) -> DataFrame:
    """recs has record_id, seq (case counts: masked symbols are skipped) and period, which may be null."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for name, seq, period in zip(*(batch.column(c).to_pylist() for c in ("record_id", "seq", "period")), strict=True):
            r = kernel.analyze(seq or "", period, cfg)
            known = period if period is not None and period > 0 else None
            rows.append((name, len(seq or ""), known, r.n_groups, r.n_pairs, r.jitter, r.events, r.burden_pct, r.max_shift, r.drift_per_kb, r.dropouts, r.dropout_rate, r.flag, r.notes))
        return {n: [r[i] for r in rows] for i, n in enumerate(SCHEMA.names)}

    return map_records(recs.select("record_id", "seq", F.col("period").cast("double").alias("period")), run, SCHEMA)
