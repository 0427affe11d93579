"""URL filters with dated lists: an as-of join of captures with the list entries in force when they were fetched.

A list is a log of dated events: a pattern was added or removed under a category. The events of a pattern and category,
in order of date, become intervals in which the entry is in force. A capture looks up its host and every parent domain,
each alone and with every beginning of the path in whole parts; an entry counts if its interval holds the day of the fetch. The longest
pattern in force decides, then the latest, then the first category by name.

The join is on equal patterns, with the interval as a condition. A third of all captures may stand on one host, so
captures of a pattern are dealt to SALTS parts, and each interval, of which a pattern has few, goes to every part.
Nothing is broadcast. Rows equal in all three columns are looked up once and returned as often as they came.

Defined results: a null or malformed url, a url without a host and a null date are not blocked. Events with null
pattern, date or action, or an action other than add and remove, are left out. An addition and a removal on one day
leave the entry out of force. Intervals hold their first day and not their last. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of a url, without user, port and last dot; null if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.nullif(host, F.lit(""))


def patterns_of(url: Column, host: Column) -> Column:
    """The host and its parent domains, alone and with the first part, the first two parts and so on of the path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.split(path, "/")
    beginnings = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda x: x != "")
    with_path = F.flatten(F.transform(suffixes, lambda s: F.transform(beginnings, lambda x: F.concat(s, F.lit("/"), x))))
    return F.when(path == "", suffixes).otherwise(F.concat(suffixes, with_path))


def intervals(events: DataFrame) -> DataFrame:
    """pattern, category, since, until of entries in force; until is null while they still are."""
    known = events.filter("pattern is not null and day is not null and action in ('add', 'remove')")
    # on one day removals follow additions
    order = Window.partitionBy("pattern", "category").orderBy("day", "action")
    spans = known.withColumn("until", F.lead("day").over(order)).filter("action = 'add' and (until is null or until > day)")
    return spans.select("pattern", "category", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, events: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """page_id, url, day, host, blocked, pattern, category, since and n_active of each capture (page_id, url, day)."""
    rows = captures.groupBy("page_id", "url", "day").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    key = ["page_id", "url", "day", "host", "copies"]
    salt = F.pmod(F.xxhash64("page_id", "url", "day"), F.lit(salts)).cast("int")
    looked = rows.select(*key, salt.alias("salt"), F.explode_outer(patterns_of(F.col("url"), F.col("host"))).alias("pattern"))
    spans = intervals(events).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    holds = (looked["pattern"] == spans["pattern"]) & (looked["salt"] == spans["salt"]) & (looked["day"] >= spans["since"]) & (spans["until"].isNull() | (looked["day"] < spans["until"]))
    met = looked.join(spans, holds, "left")
    # the least of (-length, -day, category): longest, then latest, then first by name
    rank = F.when(spans["since"].isNotNull(), F.struct((-F.length(spans["pattern"])).alias("shorter"), (-F.unix_date(spans["since"])).alias("older"), spans["category"].alias("category"), spans["pattern"].alias("pattern"), spans["since"].alias("since")))
    best = met.groupBy(*key).agg(F.min(rank).alias("best"), F.count(spans["since"]).alias("n_active"))
    out = best.select("page_id", "url", "day", "host", F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.category").alias("category"), F.col("best.since").alias("since"), "n_active", "copies")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")
