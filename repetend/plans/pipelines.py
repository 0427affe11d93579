"""Whole pipelines over records (record_id, seq)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repetend.kernels.motifs import MotifConfig
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.operators import motifs, periodogram, summary, tandem, verdicts
from repetend.operators.shared import checkpointed
from repetend.operators.summary import ClassConfig
from repetend.operators.tandem import TandemConfig
from repetend.operators.verdicts import VerdictConfig


@dataclass(frozen=True)
class AnalyzeConfig:
    periodogram: PeriodogramConfig = field(default_factory=PeriodogramConfig)
    verdict: VerdictConfig = field(default_factory=VerdictConfig)
    tandem: TandemConfig = field(default_factory=TandemConfig)
    windows: PeriodogramConfig = field(default_factory=PeriodogramConfig)
    motif: MotifConfig = field(default_factory=MotifConfig)
    classes: ClassConfig = field(default_factory=ClassConfig)


@dataclass(frozen=True)
class Analysis:
    periodograms: DataFrame
    verdicts: DataFrame
    tandem: DataFrame
    motifs: DataFrame
    summary: DataFrame

    def unpersist(self) -> None:
        self.periodograms.unpersist()


def analyze(records: DataFrame, cfg: AnalyzeConfig = AnalyzeConfig()) -> Analysis:
    """Periodogram, verdict, spatial validation and motifs, merged into one class a record.

    The periodograms are written to the shared folder, as three steps read them; their rows are small beside the sequences.
    """
    pgrams = checkpointed(periodogram.periodograms(records, cfg.periodogram))
    found = verdicts.judged(pgrams, cfg.verdict)
    checked = tandem.validate(records, found, pgrams, cfg.tandem, cfg.windows)
    periods = pgrams.select("record_id", periodogram.top_period().alias("top_period"))
    scanned = motifs.scan(records.select("record_id", "seq").join(periods, "record_id", "left"), cfg.motif)
    return Analysis(pgrams, found, checked, scanned, summary.merge(found, checked, scanned.drop("regions"), cfg.classes))


def class_counts(analysis: Analysis) -> DataFrame:
    return analysis.summary.groupBy("combined_class").agg(F.count("*").alias("n"))
