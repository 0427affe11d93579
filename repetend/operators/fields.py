"""Fields of a wrapped record for inspection: columns, and how rows change at several resolutions, with bounded rows a record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import symbols
from repetend.kernels import width as W
from repetend.operators.periodogram import map_records

#: Blocks of rows of the finest resolution, at most.
MOST_BLOCKS = 256


def column_fields(recs: DataFrame, width: int) -> DataFrame:
    """record_id, column, ic and edge_rate of records with two rows or more, wrapped to a width."""
    schema = T.StructType.fromDDL("record_id string, fields array<struct<column: int, ic: double, edge_rate: double>>")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for seq in batch.column("seq").to_pylist():
            code = symbols.codes(seq or "")
            rows = W.rows_of(code, width)
            found = [] if len(rows) < 2 else zip(range(width), W.column_information(rows, W.base_shares(code)).tolist(), (rows[1:] != rows[:-1]).mean(axis=0).tolist(), strict=True)
            out.append([dict(zip(("column", "ic", "edge_rate"), x, strict=True)) for x in found])
        return {"record_id": batch.column("record_id"), "fields": out}

    return map_records(recs.select("record_id", "seq"), run, schema).select("record_id", F.inline("fields"))


def edge_pyramid(recs: DataFrame, width: int, most: int = MOST_BLOCKS) -> DataFrame:
    """record_id, height, block, pairs and changed: how many of a block's pairs of neighbouring rows differ in each column.

    Blocks are height pairs of rows high. The least height is the first power of two that gives at most so many blocks;
    each further level joins two blocks, up to one block for all. A record has fewer than 2 * most + 1 rows here,
    whatever its length.
    """
    schema = T.StructType.fromDDL("record_id string, blocks array<struct<height: int, block: int, pairs: int, changed: array<int>>>")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for seq in batch.column("seq").to_pylist():
            rows = W.rows_of(symbols.codes(seq or ""), width)
            n, own = len(rows) - 1, []
            height = 1 << max(0, (-(-n // most) - 1).bit_length())
            level = np.add.reduceat(rows[1:] != rows[:-1], np.arange(0, n, height), axis=0, dtype=np.int64) if n > 0 else np.empty((0, width))
            while len(level):
                own += [{"height": height, "block": b, "pairs": min(height, n - b * height), "changed": x} for b, x in enumerate(level.astype(int).tolist())]
                if len(level) == 1:
                    break
                level, height = np.add.reduceat(level, np.arange(0, len(level), 2), axis=0), 2 * height
            out.append(own)
        return {"record_id": batch.column("record_id"), "blocks": out}

    return map_records(recs.select("record_id", "seq"), run, schema).select("record_id", F.inline("blocks"))
