"""Homology of records at candidate periods."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import homology as kernel
from repetend.kernels import symbols
from repetend.kernels.homology import HomologyConfig
from repetend.operators.periodogram import map_records

SCHEMA = T.StructType(
    [T.StructField("record_id", T.StringType()), T.StructField("period", T.IntegerType()), T.StructField("phase_offset", T.IntegerType()), T.StructField("n_blocks", T.IntegerType())]
    + [T.StructField("homology_score", T.DoubleType()), T.StructField("subtype_count", T.IntegerType())]
)


def probe(recs: DataFrame, periods: DataFrame, cfg: HomologyConfig = HomologyConfig()) -> DataFrame:
    """A row for each (record_id, period) whose copies are alike."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for name, seq, own in zip(*(batch.column(c).to_pylist() for c in ("record_id", "seq", "own")), strict=True):
            code = symbols.codes(seq or "")
            found = (kernel.probe(code, p, cfg) for p in own)
            rows += [(name, h.period, h.offset, h.n_blocks, h.score, h.n_subtypes) for h in found if h is not None]
        return {n: [r[i] for r in rows] for i, n in enumerate(SCHEMA.names)}

    own = periods.groupBy("record_id").agg(F.array_sort(F.collect_set(F.col("period").cast("int"))).alias("own"))
    return map_records(recs.select("record_id", "seq").join(own, "record_id"), run, SCHEMA)
