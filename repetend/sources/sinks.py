"""Writers: tab-separated stage files, sequences and periodogram bundles. Nulls become text only here.

Number formats are built-in expressions, so writing stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def general(x: Column, digits: int) -> Column:
    """%g: so many significant digits, without zeros at the end; from 1e-5 down and 1e`digits` up with an exponent.

    Halves are those of the shortest decimal text, and go up.
    """
    trim = lambda s: F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    # the exponent after rounding, as printf has it
    said = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(said, r"e([+-]\d+)$", 1).try_cast("int")
    places = F.greatest(F.lit(digits - 1) - exponent, F.lit(0))
    fixed = F.lit(None).cast("string")
    for n in range(digits + 4):
        fixed = F.when(places == n, F.format_string(f"%.{n}f", x)).otherwise(fixed)
    mantissa = F.regexp_extract(said, r"^([^e]*)e", 1)
    tail = F.regexp_extract(said, r"(e[+-]\d+)$", 1)
    plain = (exponent >= -4) & (exponent < digits)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), "nan").when(x == 0, "0").when(plain, trim(fixed)).otherwise(F.concat(trim(mantissa), tail))


def fixed(x: Column, digits: int, *, trim: bool = False) -> Column:
    """Fixed places; trim drops zeros at the end."""
    said = F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))
    return F.when(F.instr(said, ".") > 0, F.regexp_replace(said, r"\.?0+$", "")).otherwise(said) if trim else said


def shortest(x: Column) -> Column:
    """The shortest text that reads back as the same number; whole numbers end in .0."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e16), F.concat(F.floor(x).cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def write_tsv(df: DataFrame, path: str, formats: dict[str, Column] | None = None, *, na: str = "", force: bool = False) -> None:
    """One folder of tab-separated files with a header; formats replaces columns by text. Fails where the path exists, unless forced."""
    said = {c: F.col(f"`{c}`").cast("string") for c in df.columns} | (formats or {})
    df.select(*[F.coalesce(said[c], F.lit(na)).alias(c) for c in df.columns]).write.mode("overwrite" if force else "errorifexists").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", na).csv(path)


def peak_formats() -> dict[str, Column]:
    return {c: fixed(F.col(c), n) for c, n in (("peak_height", 4), ("score", 10), ("score2", 10), ("score2_norm", 10), ("background", 4))}


def write_peaks(peaks: DataFrame, path: str, *, force: bool = False) -> None:
    write_tsv(peaks.withColumnRenamed("record_id", "case_id"), path, peak_formats(), na="NA", force=force)


def write_wide_peaks(wide: DataFrame, path: str, *, force: bool = False) -> None:
    scores = {c: fixed(F.col(c), 10) for c in wide.columns if c.startswith("score")}
    write_tsv(wide.withColumnRenamed("record_id", "case_id"), path, scores, na="NA", force=force)


def write_verdicts(found: DataFrame, path: str, *, force: bool = False) -> None:
    numbers = ("founder", "tile", "founder_score", "tile_score", "confidence")
    write_tsv(found.withColumnRenamed("record_id", "case_id"), path, {c: general(F.col(c), 6) for c in numbers}, force=force)


def write_clusters(found: DataFrame, path: str, *, force: bool = False) -> None:
    """One folder a record, clusters from the highest score down."""
    share = F.col("total_score") / F.sum("total_score").over(Window.partitionBy("record_id"))
    rows = found.select("record_id", "rep_period", "total_score", share.alias("score_frac"), "n_peaks", "min_rank", F.array_join(F.col("periods").cast("array<string>"), ",").alias("periods"))
    ordered = rows.repartition("record_id").sortWithinPartitions("record_id", F.desc("total_score"))
    ordered.write.mode("overwrite" if force else "errorifexists").partitionBy("record_id").option("sep", "\t").option("header", True).csv(path)


def write_tandem(rows: DataFrame, path: str, *, force: bool = False) -> None:
    formats = {c: general(F.col(c), 6) for c in ("host_period", "best_candidate_period", "density", "spatial_contrast")}
    write_tsv(rows, path, formats | {"phase_contrast": F.coalesce(general(F.col("phase_contrast"), 6), F.lit("NA"))}, force=force)


def write_motifs(summary: DataFrame, regions: DataFrame, prefix: str, *, force: bool = False) -> None:
    pct = [c for c in summary.columns if c.endswith("_pct")]
    write_tsv(summary.drop("regions"), f"{prefix}.ssr.tsv", {c: shortest(F.col(c)) for c in pct}, na="NA", force=force)
    write_tsv(regions, f"{prefix}.ssr_regions.tsv", force=force)


def write_summary(rows: DataFrame, path: str, *, force: bool = False) -> None:
    """Rows in order of record."""
    four = ("hor_founder", "hor_multiplicity", "hor_tile", "hor_confidence", "ssr_dominant_motif_length", "consensus_period_bp", "subrepeat_coverage_pct")
    formats = {c: general(F.col(c).cast("double"), 4) for c in rows.columns if c in four or c.startswith("ssr_") and c.endswith("_pct")}
    formats |= {c: general(F.col(c), 6) for c in ("tv_host_period", "tv_best_candidate_period", "tv_density", "tv_spatial_contrast", "tv_phase_contrast") if c in rows.columns}
    write_tsv(rows.orderBy("record_id"), path, formats, force=force)


def write_irregularity(rows: DataFrame, path: str, *, force: bool = False) -> None:
    numbers = [f.name for f in rows.schema.fields if f.dataType.typeName() == "double"]
    write_tsv(rows, path, {c: fixed(F.col(c), 6, trim=True) for c in numbers}, force=force)


def write_rescored(rows: DataFrame, path: str, *, force: bool = False) -> None:
    own = ("identity_med", "identity_iqr", "identity_p25", "shift_consistency", "coverage_frac", "spatial_contrast", "kmer_autocorr_founder", "kmer_phase_contrast", "scan_occupancy_frac")
    write_tsv(rows, path, {c: fixed(F.col(c), 4) for c in own if c in rows.columns}, na="NA", force=force)


def write_periods(rows: DataFrame, path: str, *, force: bool = False) -> None:
    write_tsv(rows.withColumnRenamed("record_id", "array_id"), path, {"period_score": fixed(F.col("period_score"), 4)}, force=force)


def write_detection(found: DataFrame, prefix: str, *, force: bool = False) -> None:
    """Properties, segments, width features, diagnostics as JSON, and consensus sequences."""
    from repetend.operators import detect

    def numbers(df: DataFrame) -> dict[str, Column]:
        out = {f.name: fixed(F.col(f.name), 4) for f in df.schema.fields if f.dataType.typeName() == "double"}
        return out | {f.name: F.array_join(F.col(f.name).cast("array<string>"), ",") for f in df.schema.fields if f.dataType.typeName() == "array"}

    parts = {"properties": detect.properties(found), "segments": detect.segments(found), "width_features": detect.width_features(found)}
    for name, rows in parts.items():
        write_tsv(rows.withColumnRenamed("record_id", "array_id"), f"{prefix}.{name}.tsv", numbers(rows), na="NA", force=force)
    found.drop("consensus").write.mode("overwrite" if force else "errorifexists").json(f"{prefix}.diagnostics.json")
    own = detect.consensus(found)
    name = F.when(F.col("part").startswith("seg"), F.concat("record_id", F.lit("_"), "part")).otherwise(F.concat("record_id", F.lit("."), "part"))
    head = F.concat(name, F.lit("  length="), F.length("seq").cast("string"), F.when(F.col("part") == "hor_unit", F.concat(F.lit("  k="), F.col("hor_k").cast("string"))).otherwise(""))
    write_fasta(own.select(head.alias("record_id"), "seq"), f"{prefix}.consensus.fa", force=force)


def write_fasta(recs: DataFrame, path: str, *, line: int = 80, force: bool = False) -> None:
    """Sequences in lines of so many symbols."""
    body = F.regexp_replace("seq", f"(.{{{line}}})(?=.)", "$1\n")
    recs.select(F.concat(F.lit(">"), "record_id", F.lit("\n"), body)).write.mode("overwrite" if force else "errorifexists").text(path)


def write_bundle(pgrams: DataFrame, path: str, k: int = 6, *, force: bool = False) -> None:
    """Profile and background of each record that has them, as headed lines of numbers from distance 1 on."""
    rows = pgrams.filter(F.size("profile") > 0)

    def channel(name: str, values: Column) -> Column:
        head = F.concat(F.lit(">"), "record_id", F.lit(f"|{name} length="), F.col("length_bp").cast("string"), F.lit(f" kmer={k}\n"))
        return F.concat(head, F.array_join(values, " "))

    whole = F.transform(F.slice("profile", 2, F.size("profile")), lambda x: F.floor(x + 0.5).cast("string"))
    level = F.transform(F.slice("background", 2, F.size("background")), lambda x: F.format_string("%.6f", x))
    rows.select(F.concat_ws("\n", channel("H", whole), channel("bg", level))).write.mode("overwrite" if force else "errorifexists").text(path)
