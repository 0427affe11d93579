"""Observation report: peaks, clusters, motifs and irregularity of each record, without a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repetend.kernels.motifs import MotifConfig
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.kernels.register import RegisterConfig
from repetend.operators import irregularity, motifs, periodogram, verdicts
from repetend.operators.shared import checkpointed
from repetend.operators.sequences import round_half_away


def _trimmed(x: Column, digits: int) -> Column:
    said = F.format_string(f"%.{digits}f", x)
    return F.regexp_replace(said, r"\.?0+$", "") if digits else said


def peaks_text(peaks: str = "peaks") -> Column:
    """period:share of all peaks, the largest share first."""
    ranked = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["score2_norm"]).alias("less"), p["rank"].alias("rank"), p["period"].alias("period"))))
    return F.array_join(F.transform(ranked, lambda p: F.concat(p["period"].cast("string"), F.lit(":"), _trimmed(-p["less"], 6))), ";")


def clusters_text(clusters: DataFrame) -> DataFrame:
    """record_id, number and period:score:peaks of all clusters, the highest score first."""
    said = F.concat(_trimmed(round_half_away(F.col("rep_period"), 2), 2), F.lit(":"), _trimmed(F.col("total_score"), 6), F.lit(":"), F.col("n_peaks").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("total_score")).alias("less"), "cluster", said.alias("said"))))
    return clusters.groupBy("record_id").agg(F.count("*").cast("int").alias("kite_n_clusters"), F.array_join(F.transform(rows, lambda x: x["said"]), ";").alias("kite_clusters"))


def report(recs: DataFrame, pcfg: PeriodogramConfig = PeriodogramConfig(), mcfg: MotifConfig = MotifConfig(), rcfg: RegisterConfig = RegisterConfig(), tol: float = 0.015) -> DataFrame:
    """Twenty columns a record; recs has record_id and seq as read."""
    pgrams = checkpointed(periodogram.periodograms(recs, pcfg))
    found = clusters_text(verdicts.clusters(periodogram.long_peaks(pgrams), tol))
    periods = pgrams.select("record_id", periodogram.top_period().alias("top_period"))
    with_period = recs.select("record_id", "seq").join(periods, "record_id", "left")
    ssr = motifs.scan(with_period, mcfg).select(
        "record_id", F.col("ssr_raw_total_coverage_pct").alias("ssr_total_coverage_pct"), F.col("ssr_raw_dominant_motif").alias("ssr_dominant_motif"),
        F.col("dominant_motif_length").alias("ssr_dominant_motif_length"), F.col("dominant_motif_repeats").alias("ssr_dominant_motif_repeats"),
        F.col("ssr_raw_dominant_motif_coverage_pct").alias("ssr_dominant_coverage_pct"), F.col("ssr_raw_top_motifs").alias("ssr_top_motifs"),
    )
    irreg = irregularity.scan(with_period.withColumnRenamed("top_period", "period"), rcfg)
    names = {"flag": "irreg_flag", "n_kmer_groups": "irreg_n_kmer_groups"} | {
        n: f"irreg_{n}" for n in ("indel_event_count", "indel_burden_pct", "indel_max_shift_bp", "indel_drift_bp_per_kb", "dropout_rate_per_pair", "baseline_jitter_bp")
    }
    own = pgrams.select("record_id", F.col("length_bp").alias("array_length"), F.size("peaks").alias("kite_n_peaks"), peaks_text().alias("kite_peaks"))
    joined = own.join(found, "record_id", "left").join(ssr, "record_id", "left").join(irreg.select("record_id", *[F.col(a).alias(b) for a, b in names.items()]), "record_id", "left")
    return joined.withColumns({"kite_n_clusters": F.coalesce("kite_n_clusters", F.lit(0)), "kite_clusters": F.coalesce("kite_clusters", F.lit(""))})
