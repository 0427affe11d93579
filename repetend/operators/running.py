"""Running sums and maxima along an order, however many rows a key has.

A window over a key is one task for it. Here rows are dealt out by ranges of key and order instead, so a key of any size
spreads over as many tasks as it fills. Each range knows its own totals; those of the earlier ranges of the same key
are carried in. Only keys at the ends of ranges can have more than one range, at most two for each range, so the
carried table has at most twice as many rows as there are ranges, and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repetend.operators.shared import checkpointed

RANGE = "range_"


def ranged(rows: DataFrame, key: list[str], order: list[str], parts: int = 0) -> DataFrame:
    """rows with the number of their range of (key, order); kept, as ranges come from a sample and must not change."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(parts, *key, *order).withColumn(RANGE, F.spark_partition_id()))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Nulls are a key of their own."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[f"{n}_"]) for n in names))


def running(rows: DataFrame, key: list[str], order: list[str | Column], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, *, before: bool = False) -> DataFrame:
    """rows of ranged() with running sums and maxima (new name: column), each up to its row, or with before up to the one before it.

    Equal rows of the order stand in any order among themselves; order may go on where that of ranged() ends. Sums start at 0, maxima at null. Values are integers:
    sums of these are the same whatever the ranges are.
    """
    sums, maxima = sums or {}, maxima or {}
    least, most = F.min(F.struct(*key)), F.max(F.struct(*key))
    ends = rows.groupBy(RANGE).agg(F.array(least, most).alias("ends")).select(F.explode("ends").alias("end"))
    ends = ends.select(*[F.col(f"end.{c}").alias(f"{c}_") for c in key]).distinct()
    totals = rows.join(F.broadcast(ends), _same(rows, ends, key), "left_semi").groupBy(RANGE, *key).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()])
    # as many rows as there are ranges, two for some
    earlier = Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"{c}_") for c in (RANGE, *key)], *[F.sum(n).over(earlier).alias(f"{n}_carried") for n in sums], *[F.max(n).over(earlier).alias(f"{n}_carried") for n in maxima])
    own = Window.partitionBy(RANGE, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    with_carried = rows.join(F.broadcast(carried), _same(rows, carried, [RANGE, *key]), "left").select(*rows.columns, *[f"{n}_carried" for n in (*sums, *maxima)])
    zero = F.lit(0)
    found = {n: F.coalesce(F.sum(c).over(own), zero) + F.coalesce(f"{n}_carried", zero) for n, c in sums.items()}
    found |= {n: F.greatest(F.max(c).over(own), f"{n}_carried") for n, c in maxima.items()}
    return with_carried.withColumns(found).drop(*[f"{n}_carried" for n in (*sums, *maxima)])
