"""Evaluation and interval tools: accuracy by category, folds, interval union and occupancy, harmonic families, coordinate lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repetend.operators.running import ranged, running
from repetend.operators.shared import checkpointed, release


def accuracy(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Share of right classes by category; a record without a result is wrong. manifest: record_id, category, expected; found: record_id, class."""
    both = manifest.join(found.select("record_id", "class"), "record_id", "left")
    right = F.coalesce((F.col("class") == F.col("expected")).cast("int"), F.lit(0))
    return both.groupBy("category").agg(F.count("*").alias("n"), F.sum(right).alias("n_right"), F.avg(right).alias("accuracy"))


def fold_accuracy(manifest: DataFrame, found: DataFrame, folds: int = 5, hash_column: str | None = None) -> DataFrame:
    """Mean and sample deviation of the accuracy over folds by a stable hash of the record."""
    key = F.col(hash_column) if hash_column else F.crc32(F.col("record_id").cast("binary"))
    both = manifest.withColumn("fold", F.pmod(key, F.lit(folds))).join(found.select("record_id", "class"), "record_id", "left")
    right = F.coalesce((F.col("class") == F.col("expected")).cast("int"), F.lit(0))
    each = both.groupBy("category", "fold").agg(F.avg(right).alias("accuracy"))
    return each.groupBy("category").agg(F.count("*").alias("n_folds"), F.avg("accuracy").alias("mean_accuracy"), F.when(F.count("*") > 1, F.stddev_samp("accuracy")).alias("sd_accuracy"))


def union_intervals(spans: DataFrame, key: list[str]) -> DataFrame:
    """Joined spans (half-open start, end) of each key; touching spans become one. A key of any size spreads over tasks."""
    rows = ranged(spans.select(*key, "start", "end").filter("end > start"), key, ["start", "end"])
    seen = running(rows, key, ["start", "end"], maxima={"before": "end"}, before=True)
    new = checkpointed(seen.withColumn("new", F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).drop("before"))
    # of equal spans the one that begins a run stands first, whatever order they come in
    runs = running(new, key, ["start", "end", F.desc("new")], sums={"run": "new"})
    return runs.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("run")


def occupancy(spans: DataFrame, hosts: DataFrame, key: list[str]) -> DataFrame:
    """Share of each host span (h_start, h_end) that the joined spans of its key cover.

    Both ends of a host are looked up among the joined spans in one sorted run: what is covered up to a place is the
    length of all spans that begin before it, less what the last of them reaches beyond. No host meets a span.
    """
    joined = union_intervals(spans, key).select(*key, F.col("start").alias("pos"), F.lit(1).alias("side"), (F.col("end") - F.col("start")).alias("length"), F.col("end").alias("reach"))
    ends = F.array(*[F.struct(F.col(c).cast("bigint").alias("pos"), F.lit(c).alias("which")) for c in ("h_start", "h_end")])
    points = hosts.select(*key, "h_start", "h_end").distinct().select(*key, "h_start", "h_end", F.inline(ends)).withColumn("side", F.lit(0))
    both = ranged(joined.unionByName(points, allowMissingColumns=True), key, ["pos", "side"])
    found = running(both, key, ["pos", "side"], sums={"begun": "length"}, maxima={"furthest": "reach"}).filter("side = 0")
    covered = F.col("begun") - F.greatest(F.coalesce(F.col("furthest") - F.col("pos"), F.lit(0)), F.lit(0))
    at = lambda which: F.max(F.when(F.col("which") == which, covered))
    each = found.groupBy(*key, "h_start", "h_end").agg(F.greatest(at("h_end") - at("h_start"), F.lit(0)).cast("bigint").alias("covered"))
    return each.withColumn("share", F.when(F.col("h_end") > F.col("h_start"), F.col("covered") / (F.col("h_end") - F.col("h_start"))))


def resolve_aliases(intervals: DataFrame, key: list[str], share: float = 0.5) -> DataFrame:
    """The intervals (key, start, end, period) that remain when shorter periods come first.

    An interval goes if one of a shorter period that remains covers at least a share of its length. Equal rows are one;
    empty intervals go. Size classes go up by four, and have bins as wide as their intervals may be: an interval stands in
    two bins of its class at most, and asks the classes that are long enough to cover a share of it, in one and a half bins on
    average; a pair meets where its overlap begins. Pairs are two numbers each. Every round takes away what a certain interval
    covers, and with it the pairs of both sides, so what is kept shrinks; there are no more rounds than periods that follow one
    another so.
    """
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    own = ["start", "end", "period"]
    rows = intervals.select(*key, *[F.col(c).cast("bigint").alias(c) for c in own]).filter("end > start").distinct()
    rows = checkpointed(rows.withColumn("id", F.monotonically_increasing_id()))
    length = F.col("end") - F.col("start")
    class_ = F.floor((F.length(F.bin(length)) - 1) / 2).cast("int")
    bin_ = lambda place: F.call_function("shiftright", place, 2 * (F.col("class") + 1))
    in_bins = lambda df: df.withColumn("bin", F.explode(F.sequence(bin_(F.col("start")), bin_(F.col("end") - 1))))
    # lengths are whole numbers of at most 63 bits, so there are at most 32 classes
    classes = [r["class"] for r in rows.select(class_.alias("class")).distinct().collect()]
    long_enough = F.filter(F.array(*map(F.lit, classes or [0])), lambda c: F.pow(F.lit(4.0), c + 1) > share * length)
    held = in_bins(rows.withColumn("class", class_)).withColumnsRenamed({c: f"{c}_" for c in (*key, *own, "id", "class", "bin")})
    asked = in_bins(rows.withColumn("class", F.explode(long_enough)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*key, "class", "bin")]
    first = F.greatest("start", "start_")
    found = asked.join(held, [*same, F.col("period_") < F.col("period"), F.least("end", "end_") - first >= share * length, bin_(first) == F.col("bin")])
    edges, covered = checkpointed(found.select(F.col("id_").alias("by"), "id")), []
    while not edges.isEmpty():
        certain = edges.select("by").join(edges.select(F.col("id").alias("by")), "by", "left_anti").distinct()
        gone = checkpointed(edges.join(certain, "by", "left_semi").select("id").distinct())
        rest = checkpointed(edges.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("by")), "by", "left_anti"))
        release(edges)
        covered.append(gone)
        edges = rest
    for gone in covered:
        rows = rows.join(gone, "id", "left_anti")
    return rows.drop("id")


def harmonic_family(peaks: DataFrame, tol: float = 0.02, most: int = 20) -> DataFrame:
    """For each record the period whose near multiples hold the largest share: base, members and their sum; the shortest of equals."""
    base = peaks.select("record_id", F.col("period").alias("base"))
    multiple = F.floor(F.col("period") / F.col("base") + 0.5)
    near = (multiple >= 1) & (multiple <= most) & (F.abs(F.col("period") - multiple * F.col("base")) <= tol * multiple * F.col("base"))
    # a record has few peaks: each holds at least a thousandth of the score
    families = base.join(peaks.select("record_id", "period", "score2_norm"), "record_id").filter(near).groupBy("record_id", "base").agg(F.count("*").alias("n_members"), F.sum("score2_norm").alias("share"))
    order = Window.partitionBy("record_id").orderBy(F.desc(F.floor(F.col("share") * 1e9 + 0.5)), "base")
    return families.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def lift(spans: DataFrame, indels: DataFrame) -> DataFrame:
    """Spans (record_id, start, len) moved by insertions and deletions (record_id, at, delta) before and inside them.

    An indel before a span moves its start; one at its start or inside changes its length, which stays at least 0. Ends
    of spans and indels are sorted together and summed along, so no span meets every indel of its record, and a record
    of any number of them spreads over tasks.
    """
    ends = F.array(F.struct(F.col("start").cast("bigint").alias("pos"), F.lit(0).alias("side")), F.struct((F.col("start") + F.col("len")).cast("bigint").alias("pos"), F.lit(1).alias("side")))
    points = spans.select("record_id", "start", "len", F.inline(ends)).withColumn("delta", F.lit(0).cast("bigint"))
    changes = indels.select("record_id", F.col("at").cast("bigint").alias("pos"), F.lit(2).alias("side"), F.col("delta").cast("bigint").alias("delta"))
    # at one place ends stand before indels: those count as inside
    rows = ranged(points.unionByName(changes, allowMissingColumns=True), ["record_id"], ["pos", "side"])
    summed = running(rows, ["record_id"], ["pos", "side"], sums={"sum": "delta"}).filter("side < 2")
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("sum")))
    out = summed.groupBy("record_id", "start", "len").agg(at(0).alias("before"), at(1).alias("within"))
    length = F.col("len") + F.col("within") - F.col("before")
    return out.select("record_id", "start", "len", (F.col("start") + F.col("before")).alias("new_start"), F.greatest(length, F.lit(0).cast("bigint")).alias("new_len"))
