"""Registered queries of the engine: (spark, sf_dir) to a DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repetend.kernels.register import RegisterConfig
from repetend.kernels.rescoring import RescoreConfig
from repetend.operators import detect, evaluate, fields, generate, homology, irregularity, long_records, motifs, periodogram, report, rescore, sequences, summary, tandem, verdicts
from repetend.operators.periodogram import PeriodogramConfig
from repetend.operators.shared import checkpointed
from repetend.plans import pipelines
from repetend.plans.oracles import ORACLE_SQL as ORACLE_SQL

#: Without a random background every step has an SQL form.
PLAIN = PeriodogramConfig(replicates=0)
FLAGSHIP = "verdicts"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, unknown: bool = False) -> DataFrame:
    return sequences.from_text(_table(spark, sf_dir, "documents"), "doc_id", unknown=unknown)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.from_text(_table(spark, sf_dir, "benchmark"), "item_id")


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a strong period of 60 at their head."""
    head = F.concat(F.repeat(F.substring("seq", 1, 60), F.lit(8)), F.substring("seq", 1, 20), "seq")
    return _documents(spark, sf_dir).withColumn("seq", F.when(F.length("seq") >= 360, head).otherwise(F.col("seq")))


def _six(x: str | Column, name: str | None = None) -> Column:
    column = F.col(x) if isinstance(x, str) else x
    return (F.floor(column * 1e6 + 0.5) / 1e6).alias(name or x)


def sequence_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = sequences.records(_documents(spark, sf_dir, unknown=True), min_length=1000)
    return recs.select("record_id", "length_bp", "n_count", _six(sequences.n_fraction(F.col("seq")), "n_fraction"), "status")


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.composition(_documents(spark, sf_dir)).withColumn("gc_share", _six("gc_share"))


def kmer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodogram.distance_histogram(_documents(spark, sf_dir))


def kmer_histogram_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodogram.distance_histogram_sql(_benchmark(spark, sf_dir))


#: Symbols of a chunk in the queries: documents are shorter than the chunks of the operator.
CHUNK = 4096


def kmer_histogram_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same histogram with records cut into chunks."""
    return long_records.distance_histogram(_documents(spark, sf_dir), size=CHUNK)


def peaks_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same peaks with records cut into chunks, and distances into stretches."""
    found = long_records.peaks(_documents(spark, sf_dir), PLAIN, CHUNK, CHUNK)
    return found.select("record_id", "array_length", "rank", "period", "peak_height", _six("score"), _six("score2"), _six("score2_norm"))


def diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.diversity(sequences.records(_benchmark(spark, sf_dir)))
    return found.select("record_id", "distinct", _six("distinct_per_bp"), _six("entropy_bits"), _six("singleton_share"))


def motif_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _benchmark(spark, sf_dir).filter(F.length("seq") >= 5)
    motif = F.col("motif")
    motifs = long.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - 4), lambda i: F.substring("seq", i, F.lit(5)))).alias("motif")).distinct()
    return motifs.select("motif", sequences.reverse_complement(motif).alias("rc"), sequences.canonical_motif(motif).alias("canonical"), sequences.is_homopolymer(motif).alias("homopolymer"))


def _peaks(recs: DataFrame) -> DataFrame:
    return periodogram.long_peaks(periodogram.periodograms(recs, PLAIN))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _peaks(_documents(spark, sf_dir))
    return found.select("record_id", "array_length", "rank", "period", "peak_height", _six("score"), _six("score2"), _six("score2_norm"))


def peaks_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = periodogram.wide_peaks(periodogram.periodograms(_documents(spark, sf_dir), PLAIN))
    return wide.withColumns({c: _six(c) for c in ("score", "score_2", "score_3")})


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts.clusters(_peaks(_documents(spark, sf_dir)), min_period=20)
    return found.select("record_id", "cluster", _six("rep_period"), _six("total_score"), "n_peaks", "min_rank", F.array_join(F.col("periods").cast("array<string>"), ",").alias("periods"))


def _verdicts(recs: DataFrame) -> DataFrame:
    """One pass over the sequences: a verdict is worked out where its record's peaks are."""
    found = verdicts.judged(periodogram.periodograms(recs, PLAIN))
    reason = F.regexp_replace("reason", ":.*", "")
    return found.select("record_id", "verdict", "founder", "multiplicity", "tile", _six("founder_score"), _six("tile_score"), _six("confidence"), "n_clusters", reason.alias("reason"))


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(_documents(spark, sf_dir))


def verdicts_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(_controls(spark, sf_dir))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_rows(spark, sf_dir).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def emitted_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _controls(spark, sf_dir)
    pgrams = checkpointed(periodogram.periodograms(recs, PLAIN))  # three steps read it
    return verdicts.emitted_periods(checkpointed(verdicts.short_verdicts(verdicts.judged(pgrams))), periodogram.long_peaks(pgrams))


#: Kinds of events that are symbols; other kinds are unknown.
EVENT_KINDS = ("click", "view", "purchase", "signup")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = sequences.records(sequences.from_events(_table(spark, sf_dir, "events"), EVENT_KINDS), min_length=1)
    return recs.select("record_id", "seq", "length_bp", "n_count", "status")


def background_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the ten random replicates."""
    return periodogram.long_peaks(periodogram.periodograms(_documents(spark, sf_dir)))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _controls(spark, sf_dir)
    pgrams = checkpointed(periodogram.periodograms(recs, PLAIN))  # verdicts and hosts read it
    found = verdicts.judged(pgrams)
    return tandem.plan_windows(tandem.candidates(tandem.hosts(recs, found, pgrams)))


def window_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, gate, candidates and windows of each record."""
    ends = F.get("wins", F.size("wins") - 1)
    return _planned(spark, sf_dir).select("record_id", _six("host"), "gate", F.array_join(F.transform("cands", lambda c: F.concat(c["kind"], F.lit(":"), F.format_string("%.2f", c["period"]))), ",").alias("cands"), "window_bp", F.size("wins").alias("n_windows"), ends["s"].alias("last_start"))


def tandem_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _controls(spark, sf_dir)
    pgrams = checkpointed(periodogram.periodograms(recs, PLAIN))
    return tandem.validate(recs, verdicts.judged(pgrams), pgrams, windows_cfg=PLAIN)


def motif_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motifs.regions(motifs.scan(_motif_controls(spark, sf_dir)))


def motif_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = motifs.scan(_motif_controls(spark, sf_dir))
    return found.drop("regions", "top_motifs", "ssr_raw_top_motifs")


def _motif_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every third after 30 copies of its first three symbols; the period is unknown."""
    recs = _documents(spark, sf_dir)
    third = (F.col("record_id").cast("bigint") % 3 == 0) & (F.length("seq") >= 3)
    return recs.withColumn("seq", F.when(third, F.concat(F.repeat(F.substring("seq", 1, 3), F.lit(30)), "seq")).otherwise(F.col("seq")))


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of the whole pipeline with its defaults."""
    return pipelines.analyze(_controls(spark, sf_dir)).summary


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis(spark, sf_dir).groupBy("combined_class").agg(F.count("*").alias("n"))


def class_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer join and the cascade over rows made from customers, orders and parts."""
    customers, orders, parts = (_table(spark, sf_dir, t) for t in ("customer", "orders", "part"))
    found = customers.select(
        F.col("c_custkey").cast("string").alias("record_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "hor").when(F.col("c_mktsegment") == "AUTOMOBILE", "simple_tr").otherwise("unresolved").alias("verdict"),
        F.col("c_acctbal").alias("founder"), F.col("c_nationkey").alias("multiplicity"), F.col("c_acctbal").alias("tile"), F.lit(None).cast("double").alias("confidence"),
    )
    each = orders.groupBy((F.col("o_custkey") * 2).cast("string").alias("record_id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    checked = each.select(
        "record_id", F.when(F.col("f") > 0, "localized_subrepeat").otherwise("confirms_host").alias("decision_hint"), F.lit(None).cast("double").alias("host_period"), F.lit(None).cast("double").alias("best_candidate_period"),
        F.lit(None).cast("string").alias("best_candidate_kind"), (F.col("f") / F.col("n")).alias("density"), F.lit(0.0).alias("spatial_contrast"), F.lit(None).cast("double").alias("phase_contrast"),
        F.col("n").alias("n_windows_total"), F.col("f").alias("n_windows_present"), F.lit("made").alias("reason"),
    )
    ssr = parts.select(
        (F.col("p_partkey") * 3).cast("string").alias("record_id"), F.lit("no").alias("ssr_flag"), F.lit(None).cast("string").alias("dominant_motif"), F.lit(None).cast("int").alias("dominant_motif_length"),
        F.lit(0).alias("dominant_motif_repeats"), F.lit(0.0).alias("dominant_motif_coverage_pct"), F.lit(0.0).alias("total_ssr_coverage_pct"), F.lit(None).cast("string").alias("top_motifs"), (F.col("p_size") * 2.0).alias("ssr_raw_total_coverage_pct"),
    )
    merged = summary.merge(found, checked, ssr)
    return merged.select("record_id", "hor_verdict", "tv_decision", _six("tv_density"), "ssr_flag", "ssr_raw_total_coverage_pct", _six("subrepeat_coverage_pct"), "combined_class")


def irregularities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregularity of the controls at their best period, by all of their k-mers."""
    recs = _controls(spark, sf_dir)
    periods = periodogram.periodograms(recs, PLAIN).select("record_id", periodogram.top_period().alias("period"))
    found = irregularity.scan(recs.join(periods, "record_id", "left"), RegisterConfig(top_words=None))
    sixes = ("baseline_jitter_bp", "indel_burden_pct", "indel_max_shift_bp", "indel_drift_bp_per_kb", "dropout_rate_per_pair")
    return found.withColumns({c: _six(c) for c in sixes}).drop("notes")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report(_documents(spark, sf_dir))


def rescored_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All peaks of the controls; the ten best of each are aligned at 200 anchors."""
    recs = _controls(spark, sf_dir)
    return rescore.rescore(_peaks(recs), recs)


def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of pairs made of line items: the order's number gives the record, the line the rank, the part the anchor.

    Every fifth record is alike at its beginning only; every third one's copies are shifted by 7 to 11 places.
    """
    record, last = F.col("l_orderkey") % 40, F.col("length_bp") - 2 * F.col("period") - 10
    rows = _table(spark, sf_dir, "lineitem").select(record.alias("n"), F.col("l_linenumber").cast("int").alias("rank"), (F.col("l_linenumber") * 7 + 20).cast("int").alias("period"), (3000 + record * 10).cast("int").alias("length_bp"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    placed = rows.withColumn("anchor", F.col("l_partkey") * 31 % (last + 1))
    part = F.when(F.col("anchor") * 3 < last, F.col("q") + 900).otherwise(F.col("q") * 3 + 300)
    identity = F.when(F.col("n") % 5 == 0, part).otherwise(F.col("q") * 10 + F.col("n") % 6 * 100) / 1003
    pairs = placed.select(F.col("n").cast("string").alias("record_id"), "rank", "period", "length_bp", "anchor", identity.alias("identity"), (F.col("l_suppkey") % 5 - 2 + F.when(F.col("n") % 3 == 0, 9).otherwise(0)).cast("int").alias("shift"))
    sixes = ("identity_med", "identity_iqr", "identity_p25", "shift_consistency", "coverage_frac", "spatial_contrast")
    return rescore.pair_statistics(pairs).withColumns({c: _six(c) for c in sixes})


def self_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each control that recur 60 symbols later."""
    recs = _controls(spark, sf_dir)
    rows = recs.select("record_id", F.lit(1).alias("rank"), F.lit(60).alias("period"))
    found = rescore.rescore(rows, recs, RescoreConfig(samples=1, k=0))
    return found.select("record_id", "period", F.coalesce("scan_n_intervals", F.lit(-1)).alias("n_intervals"), _six("scan_occupancy_frac", "occupancy"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector over the controls with their own periods."""
    recs = sequences.records(_controls(spark, sf_dir), min_length=400)
    return detect.properties(detect.detect(recs, detect.auto_periods(recs, PLAIN)))


def column_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservation of the columns of each long document, wrapped to 64 symbols."""
    recs = _documents(spark, sf_dir).filter(F.length("seq") >= 640)
    return detect.features_at(recs, 64).select("record_id", "rows", _six("column_ic"), _six("fraction_conserved_columns"), _six("vertical_edge_rate"))


def edge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rows of each document, wrapped to 64 symbols, change in each column, from 8 blocks at most up to one."""
    found = fields.edge_pyramid(_documents(spark, sf_dir), 64, 8)
    return found.withColumn("changed", F.array_join(F.col("changed").cast("array<string>"), ","))


def column_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information and rate of change of every column of each document, wrapped to 64 symbols."""
    return fields.column_fields(_documents(spark, sf_dir), 64).select("record_id", "column", _six("ic"), _six("edge_rate"))


def paired_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the periods of their orders: some of these have another's id, some none."""
    recs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), "c_custkey", F.lit("ACGT").alias("seq"))
    number = F.col("o_custkey")
    key = F.when(number % 10 == 0, F.lit(None)).when(number % 7 == 0, F.concat(F.lit("x"), number.cast("string"))).otherwise(number.cast("string"))
    periods = _table(spark, sf_dir, "orders").select(key.cast("string").alias("record_id"), (F.col("o_orderkey") % 500 + 2).cast("int").alias("period_bp"), (F.col("o_orderkey") % 101 / 100).alias("period_score"))
    found = detect.arrays_with_periods(recs, periods, "c_custkey", allow_missing=True, allow_extra=True)
    best = F.get("own", F.lit(0))
    return found.select("record_id", F.coalesce(F.size("own"), F.lit(0)).alias("n_periods"), best["period_bp"].alias("best_period"), best["period_score"].alias("best_score"))


def resolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each part's line items that remain when those of smaller line numbers come first."""
    return evaluate.resolve_aliases(_spans(spark, sf_dir, F.col("l_linenumber").alias("period")), ["l_partkey"])


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined spans of each part's line items: a span begins at the order's number and is as long as the quantity."""
    return evaluate.union_intervals(_spans(spark, sf_dir), ["l_partkey"])


def _spans(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    start = F.col("l_orderkey") % 1000
    return _table(spark, sf_dir, "lineitem").select("l_partkey", start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"), *more)


def interval_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(100).cast("bigint").alias("h_start"), F.lit(600).cast("bigint").alias("h_end"))
    return evaluate.occupancy(_spans(spark, sf_dir), hosts, ["l_partkey"]).select("l_partkey", "covered", _six("share"))


def harmonic_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.harmonic_family(_peaks(_benchmark(spark, sf_dir))).select("record_id", "base", "n_members", _six("share"))


def coordinate_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of orders moved by the line items of the same customer bucket."""
    bucket = lambda c: (F.col(c) % 500).cast("string").alias("record_id")
    spans = _table(spark, sf_dir, "orders").select(bucket("o_orderkey"), (F.col("o_custkey") % 300).alias("start"), (F.col("o_orderkey") % 97).alias("len")).distinct()
    delta = F.when(F.col("l_returnflag") == "R", -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).cast("bigint")
    return evaluate.lift(spans, _table(spark, sf_dir, "lineitem").select(bucket("l_orderkey"), (F.col("l_partkey") % 400).alias("at"), delta.alias("delta")))


def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by market segment of the balance's sign against the nation's parity; some customers have no result."""
    customers = _table(spark, sf_dir, "customer")
    manifest = customers.select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("expected"))
    found = customers.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_acctbal") > 0, "even").otherwise("odd").alias("class"))
    return evaluate.accuracy(manifest, found).withColumn("accuracy", _six("accuracy"))


def fold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer")
    manifest = customers.select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("category"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("expected"))
    found = customers.select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_acctbal") > 0, "even").otherwise("odd").alias("class"))
    return evaluate.fold_accuracy(manifest, found, hash_column="record_id").select("category", "n_folds", _six("mean_accuracy"), _six("sd_accuracy"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each supplier's number and size; lengths are multiples of 12, so parts divide them."""
    n = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        n.cast("string").alias("case_id"), ((n % 9 + 4) * 12).cast("int").alias("monomer_len"), (n % 4 + 1).cast("int").alias("hor_order"), F.lit(12).alias("n_blocks"),
        F.lit(0.1).alias("sub_rate_intra"), F.lit(0.02).alias("sub_rate_inter"), (n % 3 + 1).cast("int").alias("submono_k"),
    )


def grid_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.alternatives(_grid(spark, sf_dir))


def simulated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the simulated arrays of the grid, beside their parameters."""
    columns = ("record_id", "monomer_len", "hor_order", "submono_k", "array_length", "hor_signal", "seq")
    made = checkpointed(generate.simulate_grid(_grid(spark, sf_dir)).select(*columns))  # three steps read it
    recs = sequences.records(made.select("record_id", "seq"), min_length=400)
    found = verdicts.judged(periodogram.periodograms(recs))
    return made.select("record_id", "monomer_len", "hor_order", "submono_k", "array_length", _six("hor_signal")).join(found, "record_id")


def homologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of the copies at the three best periods of each control."""
    recs = _controls(spark, sf_dir)
    return homology.probe(recs, _peaks(recs).filter("rank <= 3 and period >= 15"))


QUERIES = {
    "sequence_qc": sequence_qc,
    "composition": composition,
    "kmer_histogram": kmer_histogram,
    "kmer_histogram_sql": kmer_histogram_sql,
    "kmer_histogram_chunks": kmer_histogram_chunks,
    "peaks_chunks": peaks_chunks,
    "diversity": diversity,
    "motif_forms": motif_forms,
    "peaks": peaks,
    "peaks_wide": peaks_wide,
    "clusters": clusters,
    "verdicts": verdict_rows,
    "verdicts_controls": verdicts_controls,
    "verdict_counts": verdict_counts,
    "emitted_periods": emitted_periods,
    "event_sequences": event_sequences,
    "background_peaks": background_peaks,
    "window_plans": window_plans,
    "tandem_validation": tandem_validation,
    "motif_regions": motif_regions,
    "motif_summary": motif_summary,
    "analysis": analysis,
    "class_counts": class_counts,
    "class_cascade": class_cascade,
    "irregularities": irregularities,
    "reports": reports,
    "rescored_peaks": rescored_peaks,
    "pair_statistics": pair_statistics,
    "self_matches": self_matches,
    "detections": detections,
    "column_information": column_information,
    "edge_blocks": edge_blocks,
    "column_fields": column_fields,
    "paired_periods": paired_periods,
    "resolved_aliases": resolved_aliases,
    "interval_union": interval_union,
    "interval_occupancy": interval_occupancy,
    "harmonic_families": harmonic_families,
    "coordinate_lift": coordinate_lift,
    "category_accuracy": category_accuracy,
    "fold_accuracy": fold_accuracy,
    "grid_alternatives": grid_alternatives,
    "simulated_verdicts": simulated_verdicts,
    "homologies": homologies,
}
