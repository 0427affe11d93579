"""Line dedup by winnowing over line hashes.

The lines with a word are hashed, white space and case aside. From every line a window runs on until it holds
MIN_WORDS words, and another runs back from it. The least hash of each window is its fingerprint and marks a position; a posting is that position with
the hash of its window. Two texts that share a run of at least MIN_WORDS words share a whole window, so they share a
posting: the guarantee holds whether the run is one long line or many short ones, and a common line is no hot posting,
as its windows differ. The windows that run on cover a shared run but for less than MIN_WORDS words at its end, and the one
that runs back from its last line covers these. So every line of a run that any earlier text shares goes, whichever text
has its other windows first. Each posting is joined with the first one of its window in order of doc_id, then place, never
with all of them. From the joined position the match is extended line by line both ways and the later run is deleted. A
line has a word at least, so MIN_WORDS lines each way reach both ends of the window; what the run has beyond them has
windows of its own, so extending further would only name the same lines again. A line is deleted only where an equal line stands earlier, so the first copy of every line
stays. Everything is DataFrame expressions.

Defined results: null and empty texts stay as they are. Rows with equal doc_id and text are one document: all of them
get the same result. Null doc_ids come first in order. Ties between equal ids go by the hash of the text. Lines without
a word are never counted nor deleted. All columns stay, and only text changes. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from repetend.llm._common import SPACE_CHARS, SPACE_CLASS, let, reliable, row_id_columns

MIN_WORDS = 50
_KEY = ("doc_id", "th")


def _lines(text: Column) -> Column:
    """Array of (place, hash, words) of the lines with a word."""
    plain = lambda x: F.regexp_replace(F.lower(F.btrim(x, F.lit(SPACE_CHARS))), SPACE_CLASS + "+", " ")
    described = F.transform(F.transform(F.split(text, "\n"), plain), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("w")))
    return F.filter(described, lambda x: x["w"] > 0)


def _same(a: Column, b: Column) -> Column:
    """How many elements at the beginning of both arrays are equal."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _before(a: Column, i: Column, n: int) -> Column:
    """At most n elements before place i, the nearest first."""
    low = F.greatest(i - n, F.lit(0))
    return F.reverse(F.slice(a, low + 1, i - low))


def repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text) and removed: places of the lines to delete, for documents that have any."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("ls"))
    enough = F.aggregate("ls", F.lit(0).cast("bigint"), lambda a, x: a + x["w"]) >= min_words
    texts = reliable(rows.filter(enough).dropDuplicates(list(_KEY)))

    lines = texts.select(*_KEY, F.posexplode("ls").alias("i", "x")).select(*_KEY, "i", "x.h", F.col("x.w").cast("bigint").alias("w"))
    own = Window.partitionBy(*_KEY)
    lines = lines.withColumn("start", F.sum("w").over(own.orderBy("i")) - F.col("w"))
    # the lines that begin within min_words words of this one's beginning, and those that end within as many of its end
    ahead = own.orderBy("start").rangeBetween(0, min_words - 1)
    behind = own.orderBy(F.col("start") + F.col("w")).rangeBetween(1 - min_words, 0)

    def posting(over: WindowSpec) -> Column:
        hs = F.xxhash64(F.collect_list("h").over(over))
        return F.struct(F.sum("w").over(over).alias("words"), F.min(F.struct("h", "i")).over(over)["i"].alias("p"), hs.alias("gram"))

    windows = lines.select(*_KEY, F.array(posting(ahead), posting(behind)).alias("both")).select(*_KEY, F.inline("both"))
    postings = reliable(windows.filter(F.col("words") >= min_words).select(*_KEY, "p", "gram").distinct())

    firsts = postings.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "p")).alias("f")).filter("n > 1")
    # joined on an expression: both sides are dealt out anew, so that the adaptive plan can split a frequent window
    key = F.col("gram").bitwiseXOR(F.lit(1))
    seeds = postings.withColumn("g", key).drop("gram").join(firsts.select(key.alias("g"), "f"), "g").filter(F.struct(*_KEY, "p") != F.col("f"))
    seeds = seeds.select(*_KEY, "p", F.col("f.doc_id").alias("sd"), F.col("f.th").alias("st"), F.col("f.p").alias("sp")).distinct()

    sources = texts.select(F.col("doc_id").alias("sd_"), F.col("th").alias("st_"), F.col("ls").alias("source"))
    hashed = lambda d, t: F.xxhash64(d, t)
    found = seeds.join(sources, (hashed("sd", "st") == hashed("sd_", "st_")) & F.col("sd").eqNullSafe(F.col("sd_")) & (F.col("st") == F.col("st_")))
    after = lambda a, i: F.slice(a, i + 1, min_words)
    found = found.select(*_KEY, "p", after(F.col("source"), F.col("sp")).alias("right"), _before(F.col("source"), F.col("sp"), min_words).alias("left"))
    mine = texts.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "ls")
    found = found.join(mine, (hashed("doc_id", "th") == hashed("d_", "t_")) & F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")))
    spans = found.select(
        *_KEY,
        (F.col("p") - _same(_before(F.col("ls"), F.col("p"), min_words), F.col("left"))).alias("lo"),
        (F.col("p") + _same(after(F.col("ls"), F.col("p")), F.col("right")) - 1).alias("hi"),
    ).filter("hi >= lo")

    # overlapping and touching spans become one, so that every line is named once
    far = F.max("hi").over(own.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("new", F.when(F.col("lo") <= far + 1, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(own.orderBy("lo", "hi")))
    runs = runs.groupBy(*_KEY, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    places = runs.groupBy(*_KEY).agg(F.flatten(F.collect_list(F.sequence("lo", "hi"))).alias("idx"))
    return places.join(mine, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_"))).select(*_KEY, F.transform("idx", lambda i: F.get("ls", i)["at"]).alias("removed"))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """docs with later copies of repeated runs of lines deleted from text; `removed` names a column for their places."""
    found = repeated_lines(docs, min_words=min_words)
    id_, th, places = row_id_columns(docs, ["gone_doc_id", "gone_th", "gone_places"])
    gone = found.select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("removed").alias(places))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[id_]) & (F.xxhash64(docs["text"]) == gone[th]), "left")

    def rest(text: Column) -> Column:
        def kept(parts: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(places))
            return F.transform(left, lambda i: F.get(parts, i))

        return F.array_join(let(F.split(text, "\n"), kept), "\n")

    text = F.when(F.col(places).isNull(), docs["text"]).otherwise(rest(docs["text"]))
    more = [F.coalesce(places, F.array().cast("array<int>")).alias(removed)] if removed else []
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns], *more)
