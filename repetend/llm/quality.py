"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Unigrams and bigrams of lower-cased words are hashed into buckets, as many as the trained n-grams fill (bucket_count). Two multinomials over the
buckets are estimated with add-alpha smoothing: the raw one from every document, the target one from documents that
labels mark as good and not toxic. A document's score is the mean of log(target / raw) over its n-grams, so length
does not matter, and one fixed threshold decides on every document. Everything is DataFrame expressions.

Defined results: null and empty texts have no words, so they fail the base rules and their score is null. Weights are
whole millionths, so sums do not depend on row order and repeated rows score alike. A null doc_id is kept and is
never trusted. Where no document is trusted the target equals the raw corpus and every score is 0. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repetend.llm._common import SPACE_CLASS, let, reliable, words_of

#: Bounds of the bucket count; the upper one bounds the weights, which every task gets.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 13, 1 << 20
#: A bigram takes the low bits of its first word's hash and those from here on of its second word's.
PAIR_BITS = 20
#: Trained n-grams that a bucket holds on average, at least. Fewer, and prose that the target never saw falls below the
#: threshold; many more, and junk hides in the buckets of prose.
FILL = 16
#: Buckets counted in one row.
PART_BITS = 3
PART = 1 << PART_BITS
ALPHA = 1.0
#: At most so many trusted documents train the target (those of smallest id hash); it bounds the broadcast of their ids.
TRUSTED_ROWS = 20_000
#: Mean log ratio in millionths below which a document goes. Prose that the target never saw scores about 0 (down to
#: -0.09 where only a few hundred documents train the target), line noise and symbol junk below.
THRESHOLD = -100_000
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = r"[#*$%&|<>]"


#: Up to so many different repeated windows are looked up one by one; more are found by sorting windows with their places.
FEW = 16


def held(df: DataFrame, column: str) -> DataFrame:
    """df with a column evaluated once a row: the optimiser doesn't copy what a one-row explode gives."""
    return df.withColumn(column, F.explode(F.array(column)))


def windows_of(hashes: Column) -> Column:
    """A hash of each WINDOW of neighbouring words, from the words' hashes."""
    grams = F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(hashes) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.slice(grams, 1, F.size(hashes) - WINDOW + 1))


def repeated_words(grams: Column) -> Column:
    """How many words stand in a window, of the windows' hashes in a column, that the text has twice or more."""

    def sorted_places() -> Column:
        def twins(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        return let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins)

    def looked_up(twice: Column) -> Column:
        return F.filter(F.transform(grams, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def span(places: Column) -> Column:
        # a start covers WINDOW words, less what the next start covers again
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    twice = let(F.sort_array(grams), lambda s: F.array_distinct(F.filter(s, lambda h, j: F.coalesce(h == F.get(s, j - 1), F.lit(False)))))
    found = let(twice, lambda d: F.when(F.size(d) <= FEW, span(looked_up(d))).otherwise(span(sorted_places())))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(found)


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, words and the base counts of each row."""
    text = F.coalesce("text", F.lit(""))
    with_word = lambda lines: F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(with_word(F.split(text, "\n")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.when(F.instr("text", "\n") == 0, F.lit(0)).otherwise(dup_lines).cast("bigint").alias("n_dup_lines"),
    )
    rows = held(rows, "words").withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    rows = held(rows, "hashes").withColumn("grams", windows_of(F.col("hashes")))
    return held(rows, "grams").select("doc_id", "words", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), "n_symbols", "n_dup_lines", repeated_words(F.col("grams")).alias("n_repeat_words"))


def grams_of(words: Column, buckets: int) -> Column:
    """Buckets (buckets is a power of two) of all unigrams and bigrams; a bigram's follows from two parts of its words' hashes."""
    mask = F.lit(buckets - 1).cast("bigint")

    def both(h: Column) -> Column:
        n = F.size(h) - 1
        pairs = F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda x, y: x.bitwiseXOR(F.shiftright(y, PAIR_BITS)).bitwiseAND(mask))
        return F.concat(F.transform(h, lambda x: x.bitwiseAND(mask)), F.when(n > 0, pairs).otherwise(F.array().cast("array<bigint>")))

    return let(F.transform(words, lambda x: F.xxhash64(F.lower(x))), both)


def trusted_ids(labels: DataFrame, limit: int) -> DataFrame:
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def bucket_count(texts: DataFrame) -> int:
    """The greatest power of two that leaves each bucket FILL n-grams of the trusted texts on average, within the bounds."""
    n = texts.agg(F.sum(F.greatest(2 * F.size(words_of(F.col("text"))) - 1, F.lit(0)).cast("bigint"))).first()[0]
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(1, (n or 0) // FILL).bit_length() - 1))


def bucket_counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """part (a bucket div PART) and the counts of its PART buckets, in columns name0, name1 and so on.

    Nearly every task meets nearly every bucket, so its partial counts are PART to a row, which is less to look up and
    to shuffle than a row each.
    """
    # held first, so that the explode of many rows is compiled
    grams = held(texts.select(grams_of(words_of(F.col("text")), buckets).alias("grams")), "grams").select(F.explode("grams").alias("bucket"))
    placed = grams.select(F.shiftright("bucket", PART_BITS).alias("part"), F.col("bucket").bitwiseAND(F.lit(PART - 1).cast("bigint")).alias("place"))
    return placed.groupBy("part").agg(*[F.sum((F.col("place") == i).cast("bigint")).alias(f"{name}{i}") for i in range(PART)])


def weights(texts: DataFrame, trusted: DataFrame, buckets: int, alpha: float) -> Column:
    """Millionths of the log ratio of each bucket: one array of all buckets, as a scalar subquery."""
    raw, target = reliable(bucket_counts(texts, buckets, "raw")), reliable(bucket_counts(trusted, buckets, "target"))
    total = lambda df, name: df.agg(F.sum(sum(F.col(f"{name}{i}") for i in range(PART)))).first()[0] or 0
    all_raw, all_target = total(raw, "raw"), total(target, "target")

    def weight(i: int) -> Column:
        if not all_target:
            return F.lit(0).cast("bigint")
        n, t = (F.coalesce(f"{name}{i}", F.lit(0)) for name in ("raw", "target"))
        return F.round((F.log((t + alpha) / (all_target + alpha * buckets)) - F.log((n + alpha) / (all_raw + alpha * buckets))) * 1_000_000).cast("bigint")

    # every part has a row, so that a bucket is a place of the array; at most MOST_BUCKETS whole numbers
    parts = texts.sparkSession.range(buckets // PART).withColumnRenamed("id", "part").join(raw, "part", "left").join(target, "part", "left")
    rows = parts.select("part", F.array(*[weight(i) for i in range(PART)]).alias("w"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("part", "w"))).alias("all")).select(F.flatten(F.col("all")["w"])).scalar()


def quality(docs: DataFrame, labels: DataFrame, *, buckets: int | None = None, alpha: float = ALPHA, trusted_rows: int = TRUSTED_ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, the score llr (mean log ratio) and kept, one row for each row of docs.

    buckets is bucket_count() where it isn't given; it is a power of two, PART or more.
    """
    trusted = reliable(docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels, trusted_rows)), "doc_id").select("text"))
    if buckets is None:
        buckets = bucket_count(trusted)
    known = weights(docs.select("text"), trusted, buckets, alpha)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # a subquery may not be written into a function of an array, but the optimiser moves the column there: it is read once a task
    rows = held(base_features(docs).withColumn("grams", grams_of(F.col("words"), buckets)), "grams").withColumn("known", known)
    scored = rows.select(*base, F.size("grams").cast("bigint").alias("n_grams"), F.aggregate("grams", F.lit(0).cast("bigint"), lambda a, x: a + F.get("known", x)).alias("total"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("n_grams") > 0, F.col("total") / F.col("n_grams") / 1e6)
    above = (F.col("n_grams") > 0) & (F.col("total") >= threshold * F.col("n_grams"))
    return scored.select(*base, failed.alias("base_failed"), (~failed & above).alias("kept"), llr.alias("llr"))
