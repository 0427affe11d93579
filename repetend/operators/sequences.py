"""Sequence records: normalisation, quality control, composition, and sequences out of tables.

A record is record_id, seq, length_bp, n_count and status. Everything here is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MAX_UNKNOWN = 5000, 0.20
OK, TOO_SHORT, TOO_UNKNOWN = "ok", "too_short", "too_many_ns"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Letters of prose as symbols, in turn.
_AS_SYMBOLS = ("ACGT" * 7)[:26]


def normalise(seq: Column) -> Column:
    """A, C, G, T in upper case; U is T; any other symbol is N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def n_count(seq: Column) -> Column:
    # what a plain replacement takes away; a pattern would stop at each known symbol
    return (F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))).cast("int")


def n_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) == 0, 0.0).otherwise(n_count(seq) / F.length(seq))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical_motif(motif: Column) -> Column:
    """The least of all rotations of the motif and of its reverse complement."""
    own = F.upper(motif)

    def rotations(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(F.concat(s, s), i, F.length(s)))

    return F.when(F.length(own) == 0, "").otherwise(F.least(F.array_min(rotations(own)), F.array_min(rotations(reverse_complement(own)))))


def is_homopolymer(motif: Column) -> Column:
    return (F.length(motif) < 2) | motif.rlike(r"^(.)\1*$")


def divisors(n: Column) -> Column:
    """Proper divisors above 1, in order; none below 4."""
    return F.when(n < 4, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(2), n.cast("int") - 1), lambda d: n % d == 0))


def sealed(rows: DataFrame) -> DataFrame:
    """rows, whose expressions are worked out here once: later projections and filters can't be merged into them."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def round_half_away(x: Column, digits: int) -> Column:
    """Halves away from zero, of the product in binary (built-in round works on decimal digits)."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def qc_status(length: Column, unknown: Column, min_length: int = MIN_LENGTH, max_unknown: float = MAX_UNKNOWN) -> Column:
    share = F.when(length == 0, 0.0).otherwise(unknown / length)
    return F.when(length < min_length, TOO_SHORT).when(share > max_unknown, TOO_UNKNOWN).otherwise(OK)


def records(raw: DataFrame, *, min_length: int = MIN_LENGTH, max_unknown: float = MAX_UNKNOWN, fold: bool = True) -> DataFrame:
    """Records of raw (record_id, seq) with length, unknown symbols and status; nothing is dropped. fold normalises seq."""
    seq = normalise(F.col("seq")) if fold else F.col("seq")
    out = raw.select("record_id", seq.alias("seq"), *[c for c in raw.columns if c not in ("record_id", "seq")])
    out = out.withColumn("length_bp", F.length("seq").cast("int")).withColumn("n_count", n_count(F.col("seq")))
    return out.withColumn("status", qc_status(F.col("length_bp"), F.col("n_count"), min_length, max_unknown))


def composition(recs: DataFrame) -> DataFrame:
    """Counts of the symbols of each record, and its GC share among known ones."""
    count = lambda s: (F.length("seq") - F.length(F.replace("seq", F.lit(s)))).cast("bigint")
    out = recs.select("record_id", *[count(s).alias(f"n_{s.lower()}") for s in "ACGTN"])
    known = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    return out.withColumn("gc_share", F.when(known > 0, (F.col("n_c") + F.col("n_g")) / known))


def diversity(recs: DataFrame, k: int = 6) -> DataFrame:
    """Distinct k-mers for each symbol, entropy of their counts in bits, and share of those seen once."""
    words = recs.filter(F.col("length_bp") >= k).select("record_id", "length_bp", F.explode(F.transform(F.sequence(F.lit(1), F.col("length_bp") - k + 1), lambda i: F.substring("seq", i, F.lit(k)))).alias("word"))
    counts = words.filter(~F.col("word").contains("N")).groupBy("record_id", "length_bp", "word").agg(F.count("*").alias("n"))
    # sum(-p log2 p) = log2(total) - sum(n log2 n) / total
    agg = counts.groupBy("record_id", "length_bp").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    return agg.select("record_id", "distinct", (F.col("distinct") / F.col("length_bp")).alias("distinct_per_bp"), (F.log2("total") - F.col("weighted") / F.col("total")).alias("entropy_bits"), (F.col("single") / F.col("distinct")).alias("singleton_share"))


def from_text_column(text: Column, *, unknown: bool = False) -> Column:
    """Prose as a sequence: letters map to A, C, G, T in turn; other characters go, or become N."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]" if unknown else "[^a-z]+", "N" if unknown else "")
    return F.translate(letters, _ALPHABET, _AS_SYMBOLS)


def from_text(table: DataFrame, key: str, text: str = "text", *, unknown: bool = False) -> DataFrame:
    """Prose as sequences, see from_text_column."""
    return table.select(F.col(key).cast("string").alias("record_id"), from_text_column(F.col(text), unknown=unknown).alias("seq"))


def from_events(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A sequence a user: kinds of events in order of time, as A, C, G, T; other kinds are N."""
    symbol = F.coalesce(*[F.when(F.col("event_type") == kind, s) for kind, s in zip(kinds, "ACGT", strict=False)], F.lit("N"))
    own = events.filter("user_id is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", symbol.alias("s")))).alias("xs"))
    return own.select(F.col("user_id").cast("string").alias("record_id"), F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("seq"))


def repeated(recs: DataFrame, unit: int, copies: int) -> DataFrame:
    """Positive controls: the first symbols of each long enough record, over and over."""
    return recs.filter(F.length("seq") >= unit).select("record_id", F.repeat(F.substring("seq", 1, unit), F.lit(copies)).alias("seq"))
