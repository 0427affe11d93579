"""Generators as table functions: simulated arrays of a parameter grid, and arrays of synthesis documents.

Each row of parameters is a task of its own; seeds follow from the row, never from the partition.
"""

from __future__ import annotations

import json
from dataclasses import fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.kernels import symbols, synth
from repetend.operators.periodogram import map_records

_TRUTH = "array_length int, n_monomers int, mean_intra_block_id double, mean_homologous_id double, mean_cross_position_id double, hor_signal double"
_MONOMERS = "array<struct<monomer_idx: int, block_idx: int, founder_idx: int, start: int, end: int>>"
_EVENTS = "array<struct<event_order: int, scope: string, source_idx: int, target_idx: int>>"


def simulate_grid(grid: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each case: parameters, seq, truth, monomers, events, and error for a case whose parameters are wrong.

    grid has case_id and any fields of GridRow; the rest takes the defaults. A case without a seed gets one from its name.
    """
    given = [f for f in fields(synth.GridRow) if f.name in grid.columns]
    kinds = {f.name: "double" if "rate" in f.name else "long" for f in fields(synth.GridRow)}
    schema = T.StructType.fromDDL(f"record_id string, {', '.join(f'{n} {k}' for n, k in kinds.items())}, seq string, {_TRUTH}, monomers {_MONOMERS}, events {_EVENTS}, error string")
    names = schema.names
    monomer, event = ("monomer_idx", "block_idx", "founder_idx", "start", "end"), ("event_order", "scope", "source_idx", "target_idx")

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for r in batch.to_pylist():
            own = {f.name: r[f.name] for f in given if r[f.name] is not None}
            row = replace(synth.GridRow(), **own)
            row = row if "seed" in own else replace(row, seed=symbols.named_seed(seed, r["record_id"]) >> 1)
            try:
                seq, truth, monomers, events = synth.simulate(row)
            except ValueError as error:
                out.append({"record_id": r["record_id"], **row.__dict__, "error": str(error)})
                continue
            out.append({"record_id": r["record_id"], **truth, "seq": seq, "monomers": [dict(zip(monomer, m, strict=True)) for m in monomers], "events": [dict(zip(event, e, strict=True)) for e in events]})
        return {n: [r.get(n) for r in out] for n in names}

    rows = grid.select(F.col("case_id").alias("record_id"), *[F.col(f.name).cast(kinds[f.name]).alias(f.name) for f in given])
    return map_records(rows, run, schema)


def alternatives(grid: DataFrame) -> DataFrame:
    """Readings of each case's array: the primary one, and two more where the monomer is made of equal parts."""
    sub = (F.col("monomer_len") / F.col("submono_k")).cast("int")
    unit = F.col("monomer_len") * F.col("hor_order")
    reading = lambda rank, tile, copies, founder, kind: F.struct(*[F.lit(x).alias(n) if isinstance(x, (int, str)) else x.cast("int").alias(n) for n, x in zip(("rank", "tile", "multiplicity", "founder", "kind"), (rank, tile, copies, founder, kind), strict=True)])
    first = reading(1, unit, F.col("hor_order"), F.col("monomer_len"), "primary")
    plain = F.array(first, reading(2, F.col("monomer_len"), F.col("submono_k"), sub, "submotif_hor_inside_monomer"), reading(3, sub, F.lit(1), sub, "submotif_as_monomer"))
    high = F.array(first, reading(2, unit, F.col("hor_order") * F.col("submono_k"), sub, "submotif_level_inside_horunit"), reading(3, F.col("monomer_len"), F.col("submono_k"), sub, "submotif_hor_inside_monomer"))
    return grid.select("case_id", F.inline(F.when(F.col("submono_k") < 2, F.array(first)).when(F.col("hor_order") == 1, plain).otherwise(high)))


TRUTH = (
    "record_id string, seq string, length_bp int, truth_class string, base_width_bp int, hor_k int, hor_length_bp int, n_complete_copies int, wobble_amplitude_bp double, wobble_periodicity_bp double, n_phase_shifts int, "
    "phase_shift_positions array<long>, phase_shift_offsets array<long>, n_segments int, reason string, structural_expression string, schema_version int, events_json string, "
    "periods array<struct<period_bp: int, period_score: double, source: string>>"
)


def synthesize(spark: SparkSession, documents: dict[str, dict], *, seed_offset: int = 0) -> DataFrame:
    """A row for each named document: sequence, truth and candidate periods. Documents are checked first."""
    for doc in documents.values():
        synth.validate(doc)
    rows = spark.createDataFrame([(name, json.dumps(doc)) for name, doc in documents.items()], "record_id string, doc string")
    schema = T.StructType.fromDDL(TRUTH)
    names = schema.names

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for name, text in zip(batch.column("record_id").to_pylist(), batch.column("doc").to_pylist(), strict=True):
            doc = json.loads(text)
            made = synth.synthesize(doc, name, doc.get("seed", 0) ^ seed_offset)
            periods = [dict(zip(("period_bp", "period_score", "source"), p, strict=True)) for p in made.periods]
            out.append(made.truth | {"record_id": made.array_id, "seq": made.sequence, "periods": periods})
        return {n: [r[n] for r in out] for n in names}

    return map_records(rows, run, schema)
