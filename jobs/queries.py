"""Each job as a registered query: run twice into one new folder of the shared one, and read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import configured, pooled_periods, screen_arrays
from repetend.operators.shared import shared_folder
from repetend.plans import oracles


def _six(name: str):  # noqa: ANN202
    return (F.floor(F.col(name) * 1e6 + 0.5) / 1e6).alias(name)


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/{job}-{uuid4().hex}"


def job1_screen_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of the documents table with their verdict and candidate periods; the second run finds nothing new."""
    folder, cfg = _folder(spark, "job1"), configured(screen_arrays.Config, screen_arrays.CONFIG)
    # the table may be one file, which a stream takes as a pattern only
    for _ in range(2):
        screen_arrays.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/out", f"{folder}/checkpoint", cfg)
    arrays, verdicts, periods = (screen_arrays.read(spark, f"{folder}/out", t).drop("batch") for t in screen_arrays.TABLES)
    judged = arrays.select("record_id", "length_bp", "status").join(verdicts, "record_id", "left").join(periods, "record_id", "left")
    reason = F.regexp_replace("reason", ":.*", "").alias("reason")
    return judged.select("record_id", "length_bp", "status", "verdict", "founder", "multiplicity", "tile", _six("confidence"), "n_clusters", reason, "period_bp", "period_score", "source")


def job2_pooled_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled periodogram of each language's documents with its ranked peaks."""
    folder, cfg = _folder(spark, "job2"), configured(pooled_periods.Config, pooled_periods.CONFIG)
    for _ in range(2):
        pooled_periods.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", cfg)
    found = pooled_periods.read(spark, f"{folder}/out")
    return found.select("cohort", "d", "h", "places", "n_arrays", _six("rate"), "rank", _six("score2_norm"))


QUERIES = {"job1_screen_arrays": job1_screen_arrays, "job2_pooled_periods": job2_pooled_periods}

ORACLE_SQL = {
    "job1_screen_arrays": oracles.chain(oracles.DOCUMENTS, *oracles.TO_VERDICTS, oracles.SHORT, oracles.PERIODS)
    + f"""
SELECT record_id, CAST(length(seq) AS INTEGER) AS length_bp, CASE WHEN length(seq) < 8 THEN 'too_short' ELSE 'ok' END AS status,
  CASE WHEN length(seq) >= 8 THEN v.verdict END AS verdict, founder, multiplicity, tile, {oracles.rounded("confidence")},
  CASE WHEN length(seq) >= 8 THEN n_clusters END AS n_clusters, CASE WHEN length(seq) >= 8 THEN reason END AS reason,
  CAST(period_bp AS INTEGER) AS period_bp, CAST(period_score AS DOUBLE) AS period_score, source
FROM seqs JOIN verdicts v USING (record_id) LEFT JOIN periods USING (record_id)""",
    "job2_pooled_periods": oracles.chain(oracles.DOCUMENTS, oracles.hist())
    + f""",
cohorts AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, coalesce(lang, '') AS cohort FROM documents),
pooled AS (SELECT cohort, d, sum(h) AS h FROM hist JOIN cohorts USING (record_id) GROUP BY cohort, d),
lengths AS (SELECT cohort, length(seq) - 5 AS words, count(*) AS n FROM seqs JOIN cohorts USING (record_id) WHERE length(seq) > 5 GROUP BY ALL),
asked AS (SELECT cohort, d, h FROM pooled UNION ALL SELECT DISTINCT cohort, 0, 0 FROM cohorts),
spectrum AS (
  SELECT p.cohort, d, h, coalesce(sum(n), 0) AS n_arrays, coalesce(sum(n * (words - d)), 0) AS places
  FROM asked p LEFT JOIN lengths l ON p.cohort = l.cohort AND words > d GROUP BY p.cohort, d, h),
rated AS (SELECT *, h / greatest(places, 1)::DOUBLE AS rate FROM spectrum),
around AS (
  SELECT *, CASE WHEN lag(d) OVER w = d - 1 THEN lag(rate) OVER w ELSE 0 END AS below, CASE WHEN lead(d) OVER w = d + 1 THEN lead(rate) OVER w ELSE 0 END AS above
  FROM rated WINDOW w AS (PARTITION BY cohort ORDER BY d)),
scored AS (SELECT *, CAST(rate * log2(d) AS DECIMAL(38, 18)) AS s FROM around WHERE rate > below AND rate > above AND d > 1),
shared AS (SELECT *, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY cohort) AS DOUBLE) AS score2_norm FROM scored),
best AS (
  SELECT cohort, d, score2_norm, row_number() OVER (PARTITION BY cohort ORDER BY s DESC, d) AS rank FROM shared WHERE score2_norm > 0.001)
SELECT r.cohort, CAST(r.d AS INTEGER) AS d, CAST(h AS BIGINT) AS h, CAST(places AS BIGINT) AS places, CAST(n_arrays AS BIGINT) AS n_arrays, {oracles.rounded("rate")},
  CAST(rank AS INTEGER) AS rank, {oracles.rounded("score2_norm")}
FROM rated r LEFT JOIN best b ON r.cohort = b.cohort AND r.d = b.d AND rank <= 50""",
}
