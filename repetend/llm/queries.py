"""Registered queries of this subpackage and their SQL, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repetend.llm import filter_audit, langid, line_dedup, merge_replay, mpeg, packing, quality, secret_scan, sharding, simhash, url_lists, wfst
from repetend.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.digests(table(spark, sf_dir, "documents"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.digests(table(spark, sf_dir, "documents"))


def op6_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no days of fetching and no lists, so both follow by rule from pages.

    A page was fetched page_id * 37 mod 730 days after 2023-01-01. The host with least page n is on a list if
    n mod 3 = 0: added on day n * 11 mod 400, removed 120 days later, added again after 60 more. A domain of the
    host's last two labels is on the list `domains` from day n * 7 mod 700 on for 15 days if n mod 5 = 1.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("day", day(F.col("page_id") * 37 % 730))
    hosts = pages.select("page_id", url_lists.host_of(F.col("url")).alias("host")).filter("host is not null").groupBy("host").agg(F.min("page_id").alias("n"))
    n = F.col("n")
    event = lambda pattern, category, action, when: F.struct(pattern.alias("pattern"), F.lit(category).alias("category"), F.lit(action).alias("action"), day(when).alias("day"))
    first, host = n * 11 % 400, F.col("host")
    listed = F.array(event(host, "hosts", "add", first), event(host, "hosts", "remove", first + 120), event(host, "hosts", "add", first + 180))
    domain = F.substring_index("host", ".", -2)
    wide = F.array(event(domain, "domains", "add", n * 7 % 700), event(domain, "domains", "remove", n * 7 % 700 + 15))
    chosen = F.concat(F.when(n % 3 == 0, listed).otherwise(F.slice(listed, 1, 0)), F.when(n % 5 == 1, wide).otherwise(F.slice(wide, 1, 0)))
    return url_lists.evaluate(captures, hosts.select(F.inline(chosen)).distinct())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="removed")
    return edited.select("doc_id", "text", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(F.array_sort("removed").cast("array<string>"), ",").alias("removed_lines"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mpeg_audio": op5_mpeg_audio,
    "op6_dated_url_lists": op6_dated_url_lists,
    "op7_simhash": op7_simhash,
    "op8_jump_sharding": op8_jump_sharding,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_merge_replay": op12_merge_replay,
}
#: SQL that gives the same rows; the other queries hash or compute what SQL can't, and are held against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_dated_url_lists": r"""
WITH captures AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS day,
    nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1),
      '^.*@', ''), ':[0-9]*$', ''), '\.$', '') , '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS part
  FROM pages),
hosts AS (SELECT host, min(page_id) AS n FROM captures WHERE host IS NOT NULL GROUP BY host),
events AS (
  SELECT host AS pattern, 'hosts' AS category, 'add' AS action, n * 11 % 400 AS d FROM hosts WHERE n % 3 = 0
  UNION SELECT host, 'hosts', 'remove', n * 11 % 400 + 120 FROM hosts WHERE n % 3 = 0
  UNION SELECT host, 'hosts', 'add', n * 11 % 400 + 180 FROM hosts WHERE n % 3 = 0
  UNION SELECT regexp_extract(host, '([^.]+\.)?[^.]+$'), 'domains', 'add', n * 7 % 700 FROM hosts WHERE n % 5 = 1
  UNION SELECT regexp_extract(host, '([^.]+\.)?[^.]+$'), 'domains', 'remove', n * 7 % 700 + 15 FROM hosts WHERE n % 5 = 1),
dated AS (SELECT pattern, category, action, DATE '2023-01-01' + CAST(d AS INTEGER) AS day FROM events),
spans AS (
  SELECT pattern, category, day AS since, until FROM (
    SELECT *, lead(day) OVER (PARTITION BY pattern, category ORDER BY day, action) AS until FROM dated)
  WHERE action = 'add' AND (until IS NULL OR until > day)),
met AS (
  SELECT c.page_id, c.url, c.day, c.host, s.pattern, s.category, s.since,
    row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(s.pattern) DESC NULLS LAST, s.since DESC, s.category, s.pattern) AS r,
    count(s.since) OVER (PARTITION BY c.page_id, c.url) AS n_active
  FROM captures c LEFT JOIN spans s
    ON (c.host = s.pattern OR c.host LIKE '%.' || s.pattern OR (c.part <> '' AND c.host || '/' || c.part = s.pattern))
    AND c.day >= s.since AND (s.until IS NULL OR c.day < s.until))
SELECT page_id, url, day, host, pattern IS NOT NULL AS blocked, pattern, category, since, n_active FROM met WHERE r = 1
""",
    "op11_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
      + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
      + 16 * coalesce(CAST(split.doc_id > min(split.doc_id) OVER (PARTITION BY t) AS INTEGER), 0) AS mask
  FROM split LEFT JOIN marks USING (doc_id)),
groups AS (SELECT part, mask, count(*) AS n, sum(n_good) AS n_good, sum(n_toxic) AS n_toxic FROM (SELECT part, mask, good AS n_good, toxic AS n_toxic FROM failed) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM orders, range(1, 6) AS r(step)),
counts AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before + own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM groups, steps GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
""",
}
