"""The final outer join of verdicts, spatial validation and motifs, and the class cascade on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClassConfig:
    pure_ssr_pct: float = 80.0
    has_ssr_pct: float = 30.0
    density_min: float = 0.4


#: Columns of the summary and where they come from.
FROM_VERDICTS = {"verdict": "hor_verdict", "founder": "hor_founder", "multiplicity": "hor_multiplicity", "tile": "hor_tile", "confidence": "hor_confidence"}
FROM_TANDEM = {
    "decision_hint": "tv_decision",
    "host_period": "tv_host_period",
    "best_candidate_period": "tv_best_candidate_period",
    "best_candidate_kind": "tv_best_candidate_kind",
    "density": "tv_density",
    "spatial_contrast": "tv_spatial_contrast",
    "phase_contrast": "tv_phase_contrast",
    "n_windows_total": "tv_n_windows_total",
    "n_windows_present": "tv_n_windows_present",
    "reason": "tv_reason",
}
FROM_MOTIFS = {
    "ssr_flag": "ssr_flag",
    "dominant_motif": "ssr_dominant_motif",
    "dominant_motif_length": "ssr_dominant_motif_length",
    "dominant_motif_repeats": "ssr_dominant_motif_repeats",
    "dominant_motif_coverage_pct": "ssr_dominant_motif_coverage_pct",
    "total_ssr_coverage_pct": "ssr_total_coverage_pct",
    "top_motifs": "ssr_top_motifs",
    "ssr_method": "ssr_method",
    "consensus_period_bp": "consensus_period_bp",
    "consensus_monomer": "consensus_monomer",
    "ssr_raw_dominant_motif": "ssr_raw_dominant_motif",
    "ssr_raw_dominant_motif_coverage_pct": "ssr_raw_dominant_motif_coverage_pct",
    "ssr_raw_total_coverage_pct": "ssr_raw_total_coverage_pct",
    "ssr_raw_n_regions": "ssr_raw_n_regions",
    "ssr_raw_top_motifs": "ssr_raw_top_motifs",
}
REQUIRED_MOTIFS = tuple(FROM_MOTIFS)[:7]


def combined_class(verdict: Column, ssr_pct: Column, decision: Column, density: Column, cfg: ClassConfig = ClassConfig()) -> Column:
    """The first that holds: pure_ssr, a dense local subrepeat, hor, tr, unresolved; all but the first with or without ssr."""
    pct = F.coalesce(ssr_pct, F.lit(0.0))
    suffix = F.when(pct >= cfg.has_ssr_pct, "_with_ssr").otherwise("")
    local = F.coalesce((decision == "localized_subrepeat") & (density >= cfg.density_min), F.lit(False))
    base = F.when(local, "tr_with_subrepeat").when(verdict == "hor", "hor").when(verdict == "simple_tr", "tr").otherwise("unresolved")
    return F.when(pct >= cfg.pure_ssr_pct, "pure_ssr").otherwise(F.concat(base, suffix))


def merge(verdicts: DataFrame, tandem: DataFrame, motifs: DataFrame, cfg: ClassConfig = ClassConfig()) -> DataFrame:
    """One row for each record of any input. Optional motif columns are left out where the input lacks them."""
    missing = [c for c in REQUIRED_MOTIFS if c not in motifs.columns]
    if missing:
        raise ValueError(f"motif columns are missing: {missing}")
    picked = lambda df, names: df.select("record_id", *[F.col(a).alias(b) for a, b in names.items() if a in df.columns])
    joined = picked(verdicts, FROM_VERDICTS).join(picked(tandem, FROM_TANDEM), "record_id", "full").join(picked(motifs, FROM_MOTIFS), "record_id", "full")
    raw = F.col("ssr_raw_total_coverage_pct") if "ssr_raw_total_coverage_pct" in joined.columns else F.lit(None).cast("double")
    filled = joined.withColumns(
        {
            "hor_verdict": F.coalesce("hor_verdict", F.lit("unresolved")),
            "tv_decision": F.coalesce("tv_decision", F.lit("")),
            "ssr_flag": F.coalesce("ssr_flag", F.lit("no")),
            "ssr_dominant_motif_coverage_pct": F.coalesce("ssr_dominant_motif_coverage_pct", F.lit(0.0)),
            "subrepeat_coverage_pct": F.col("tv_density") * 100,
            "combined_class": combined_class(F.col("hor_verdict"), raw, F.col("tv_decision"), F.col("tv_density"), cfg),
        }
    )
    names = ["record_id", *FROM_VERDICTS.values(), *FROM_TANDEM.values(), *FROM_MOTIFS.values(), "subrepeat_coverage_pct", "combined_class"]
    return filled.select(*[n for n in names if n in filled.columns])


def tally(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))
