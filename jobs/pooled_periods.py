"""Repeat periods that the arrays of a cohort share: a pooled periodogram of each cohort of a table.

How often equal k-mers follow one another at a distance is summed over all arrays of a cohort, and related to the
number of places where arrays are long enough for it. Local maxima of that are the cohort's peaks; they are scored as
peaks of one array are.

    OUTPUT/cohort=C    d, h, places, n_arrays, rate, and of peaks rank and score2_norm

The row of distance 0 holds the cohort's arrays and k-mers. Histograms and counts of lengths come from one reading of the table and
are summed by cohort while still in the task that makes them, first in its kernel, so what is shuffled depends on cohorts and
distances and not on rows: a cohort that holds most of the table is no hot key. Places come from counts of lengths by running sums that spread over ranges. The table
is written with dynamic overwrite: a run replaces the cohorts that it works out, each of which has a row at least, and
leaves others. The same run again gives the same rows, as everything that is summed is a whole or decimal number.

    python -m jobs.pooled_periods --source TABLE --output FOLDER [--config FILE]
"""

from __future__ import annotations

from argparse import Namespace
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import arrays, command, configured, log
from repetend.operators import periodogram
from repetend.operators.long_records import local_maxima
from repetend.operators.running import ranged, running
from repetend.operators.shared import checkpointed

CONFIG = Path(__file__).with_suffix(".toml")
COLUMNS = "d int, h long, places long, n_arrays long, rate double, rank int, score2_norm double, cohort string"


@dataclass(frozen=True)
class Config:
    key: str = "doc_id"
    text: str = "text"
    cohort: str = "lang"
    alphabet: str = "prose"
    cohorts: tuple[str, ...] = ()
    k: int = 6
    top: int = 50
    least_share: float = 0.001


def places(distances: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """distances (cohort, d) with the places of all arrays from which one can go on by d, and the arrays that have any.

    An array with n k-mers has n - d of them. Longer arrays come first along the order, so both sums run over those
    that are long enough.
    """
    counts = lengths.withColumn("words", (F.col("length_bp") - k + 1).cast("bigint")).filter("words > 0")
    # at one place distances stand before lengths: an array must be longer
    rows = counts.select("cohort", (-F.col("words")).cast("bigint").alias("pos"), F.lit(1).alias("side"), F.col("n").alias("n"), (F.col("n") * F.col("words")).alias("words"))
    asked = distances.select("cohort", (-F.col("d")).cast("bigint").alias("pos"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("words"), *[c for c in distances.columns if c != "cohort"])
    both = ranged(rows.unionByName(asked, allowMissingColumns=True), ["cohort"], ["pos", "side"])
    summed = running(both, ["cohort"], ["pos", "side"], sums={"n_arrays": "n", "sum_words": "words"}).filter("side = 0")
    return summed.select(*[F.col(c).cast(kind) for c, kind in distances.dtypes], "n_arrays", (F.col("sum_words") - F.col("n_arrays") * F.col("d")).alias("places"))


def spectrum(recs: DataFrame, k: int) -> DataFrame:
    """cohort, d, h, n_arrays, places and rate of arrays (cohort, seq)."""
    counts = checkpointed(periodogram.pooled_counts(recs, k).groupBy("cohort", "of", "at").agg(F.sum("n").alias("n")))
    lengths = counts.filter("of = 'length'").select("cohort", F.col("at").alias("length_bp"), "n")
    none = lengths.select("cohort", F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("h")).distinct()
    found = counts.filter("of = 'd'").select("cohort", F.col("at").alias("d"), F.col("n").alias("h")).unionByName(none)
    return places(found, lengths, k).withColumn("rate", F.col("h") / F.greatest("places", F.lit(1)))


def ranked(pooled: DataFrame, cfg: Config) -> DataFrame:
    """The rows with rank and share of the score of peaks: local maxima of the rate, where absent distances have 0."""
    # decimals add up to the same in any order
    score = (F.col("rate") * F.log2("d")).cast("decimal(38,18)")
    tops = local_maxima(pooled.filter("d > 0"), "cohort", "d", "rate").filter("d > 1").select("cohort", "d", score.alias("score2"))
    total = tops.groupBy("cohort").agg(F.sum("score2").cast("double").alias("total"))
    shared = tops.join(total, "cohort").withColumn("score2_norm", F.col("score2").cast("double") / F.col("total")).filter(F.col("score2_norm") > cfg.least_share)
    # a cohort has fewer of these than its least share has parts
    rank = F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("score2"), "d"))
    best = shared.select("cohort", "d", rank.alias("rank"), "score2_norm").filter(F.col("rank") <= cfg.top)
    return pooled.join(best, ["cohort", "d"], "left")


def run(spark: SparkSession, source: str, output: str, cfg: Config = Config()) -> int:
    """Work the cohorts out; rows that the table has then."""
    table = spark.read.parquet(source)
    cohort = F.coalesce(F.col(cfg.cohort).cast("string"), F.lit(""))
    table = table.filter(cohort.isin(list(cfg.cohorts))) if cfg.cohorts else table
    recs = arrays(table, cfg.key, cfg.text, cfg.alphabet, cohort.alias("cohort"))

    found = ranked(checkpointed(spectrum(recs, cfg.k)), cfg).select("d", "h", "places", "n_arrays", "rate", "rank", "score2_norm", "cohort")
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cohort").parquet(output)
    kept = read(spark, output).count()
    log.info("%s: took %d arrays; %s has %d rows", source, table.count(), output, kept)
    return kept


def read(spark: SparkSession, output: str) -> DataFrame:
    """The table as it stands; the empty cohort's folder has the name that Spark gives to null."""
    return spark.read.schema(COLUMNS).parquet(output).fillna({"cohort": ""})


def main() -> None:
    def job(spark: SparkSession, args: Namespace) -> None:
        cfg = configured(Config, args.config)
        run(spark, args.source, args.output, cfg)

    command("pooled_periods: repeat periods that the arrays of a cohort share", {"source": "table of arrays", "output": "folder of the result"}, CONFIG, job)


if __name__ == "__main__":
    main()
