"""ANSI SQL (as DuckDB runs it) that gives the rows of the registered queries, built from shared common table expressions."""

from __future__ import annotations

LETTERS, SYMBOLS = "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26]
ROUND = "floor(({x}) * 1e6 + 0.5) / 1e6"


def rounded(x: str, name: str | None = None) -> str:
    return f"{ROUND.format(x=x)} AS {name or x}"


def seqs(table: str, key: str, text: str = "text", unknown: str = "", name: str = "seqs") -> str:
    return f"""{name} AS (
  SELECT CAST({key} AS VARCHAR) AS record_id,
    regexp_replace(translate(lower(coalesce({text}, '')), '{LETTERS}', '{SYMBOLS}'), '[^ACGT]', '{unknown}', 'g') AS seq
  FROM {table})"""


def hist(k: int = 6) -> str:
    return f"""words AS (
  SELECT record_id, i, substr(seq, i, {k}) AS w FROM (
    SELECT record_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs WHERE length(seq) >= {k})),
gaps AS (SELECT record_id, i - lag(i) OVER (PARTITION BY record_id, w ORDER BY i) AS d FROM words WHERE NOT regexp_matches(w, '[^ACGT]')),
hist AS (SELECT record_id, d, count(*) AS h FROM gaps WHERE d IS NOT NULL GROUP BY record_id, d)"""


def peaks(k: int = 6, share: float = 0.001) -> str:
    return f"""around AS (
  SELECT record_id, d, h,
    CASE WHEN lag(d) OVER w = d - 1 THEN lag(h) OVER w ELSE 0 END AS l,
    CASE WHEN lead(d) OVER w = d + 1 THEN lead(h) OVER w ELSE 0 END AS r
  FROM hist WINDOW w AS (PARTITION BY record_id ORDER BY d)),
scored AS (
  SELECT a.record_id, length(seq) AS array_length, d, h,
    h / greatest(length(seq) - d - {k} + 1, 1)::DOUBLE AS score
  FROM around a JOIN seqs USING (record_id)
  WHERE h > l AND h > r AND d >= 1 AND d < length(seq) // 2 AND length(seq) >= {k} + 2),
shared AS (
  SELECT *, score * log2(d) AS score2, sum(score * log2(d)) OVER (PARTITION BY record_id) AS total FROM scored),
kept AS (
  SELECT *, CASE WHEN total > 0 THEN score2 / total ELSE 0 END AS score2_norm FROM shared),
peaks AS (
  SELECT record_id, array_length, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, d) AS rank,
    d AS period, h::DOUBLE AS peak_height, score, score2, score2_norm
  FROM kept WHERE score2_norm > {share})"""


def clusters(tol: float = 0.015, min_period: int = 20) -> str:
    return f"""gapped AS (
  SELECT *, CASE WHEN (period - lag(period) OVER w) / greatest(period, 1)::DOUBLE > {tol} THEN 1 ELSE 0 END AS breaks
  FROM peaks WHERE period >= {min_period} WINDOW w AS (PARTITION BY record_id ORDER BY period, rank)),
numbered AS (
  SELECT *, sum(breaks) OVER (PARTITION BY record_id ORDER BY period, rank ROWS UNBOUNDED PRECEDING) AS cluster FROM gapped),
clusters AS (
  SELECT record_id, cluster, floor(CASE WHEN sum(score2_norm) > 0 THEN sum(score2_norm * period) / sum(score2_norm) ELSE avg(period) END * 1e9 + 0.5) / 1e9 AS p,
    sum(score2_norm) AS s, count(*) AS n_peaks, min(rank) AS min_rank, max(array_length) AS array_length,
    string_agg(CAST(period AS VARCHAR), ',' ORDER BY period, rank) AS periods
  FROM numbered GROUP BY record_id, cluster)"""


def verdicts(tol: float = 0.015) -> str:
    near = lambda target: f"coalesce((SELECT max(n.s) FROM c n WHERE n.record_id = x.record_id AND abs(n.p - {target}) / ({target}) <= {tol}), 0)"
    return f"""c AS (
  SELECT *, sum(s) OVER (PARTITION BY record_id) AS total, count(*) OVER (PARTITION BY record_id) AS n_clusters,
    row_number() OVER (PARTITION BY record_id ORDER BY s DESC, p) AS place
  FROM (SELECT *, max(s) OVER (PARTITION BY record_id) AS best FROM clusters) WHERE s >= 0.01 * best),
top AS (SELECT record_id, cluster AS t_cluster, p AS tp, s AS ts, array_length, total, n_clusters FROM c WHERE place = 1),
a1 AS (
  SELECT c.record_id, c.p, c.s, floor(tp / c.p + 0.5) AS k FROM c JOIN top USING (record_id)
  WHERE c.p < tp AND c.s >= 0.1 * ts),
a2 AS (
  SELECT x.*, {near("2.0 * x.k * x.p")} AS two, {near("(x.k + 1.0) * x.p")} AS off
  FROM a1 x JOIN top USING (record_id) WHERE k >= 2 AND k <= 30 AND abs(tp - k * x.p) / tp <= {tol}),
a AS (
  SELECT record_id, p AS ap, s AS a_s, k AS ak FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p) AS r FROM a2 WHERE two >= off) WHERE r = 1),
b1 AS (
  SELECT top.record_id, k, c.p, c.s, row_number() OVER (PARTITION BY top.record_id, k ORDER BY c.s DESC, c.cluster DESC) AS r
  FROM top, range(2, 31) AS ks(k), c
  WHERE c.record_id = top.record_id AND c.cluster <> t_cluster AND abs(c.p - k * tp) / (k * tp) <= {tol}),
b2 AS (
  SELECT x.record_id, k, x.p, x.s, tp, ts, coalesce(lag(x.s) OVER (PARTITION BY x.record_id ORDER BY k), ts) AS prev
  FROM b1 x JOIN top ON x.record_id = top.record_id WHERE r = 1),
b3 AS (
  SELECT x.*, {near("2.0 * k * tp")} AS two, {near("(k + 1.0) * tp")} AS off FROM b2 x),
b AS (
  SELECT record_id, k AS bk, p AS bp, s AS bs FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY k) AS r FROM b3
    WHERE two >= off AND CASE WHEN k = 2 THEN s > 0.5 * ts ELSE s > prev AND s >= 0.05 * ts AND two > 0 END) WHERE r = 1),
cases AS (
  SELECT top.*, ap, a_s, ak, bk, bp, bs,
    CASE WHEN ap IS NOT NULL THEN 'a' WHEN bp IS NOT NULL THEN 'b'
      WHEN EXISTS (SELECT 1 FROM b2 WHERE b2.record_id = top.record_id) THEN 'm'
      WHEN (SELECT count(*) FROM c WHERE c.record_id = top.record_id AND c.s >= 0.1 * ts) = 1 THEN 'l' ELSE 'u' END AS kase
  FROM top LEFT JOIN a USING (record_id) LEFT JOIN b USING (record_id)),
raw AS (
  SELECT record_id, kase, array_length, n_clusters,
    floor((CASE WHEN kase = 'a' THEN ap ELSE tp END) * 100 + 0.5) / 100 AS founder,
    CAST(CASE kase WHEN 'a' THEN ak WHEN 'b' THEN bk WHEN 'm' THEN 1 WHEN 'l' THEN 1 END AS INTEGER) AS multiplicity,
    floor((CASE WHEN kase = 'b' THEN bp WHEN kase <> 'u' THEN tp END) * 100 + 0.5) / 100 AS tile,
    CASE WHEN kase = 'a' THEN a_s ELSE ts END AS founder_score,
    CASE WHEN kase = 'b' THEN bs WHEN kase <> 'u' THEN ts END AS tile_score,
    greatest(0, least(1, CASE kase WHEN 'a' THEN a_s + ts WHEN 'b' THEN ts + bs ELSE ts END / CASE WHEN total > 0 THEN total ELSE 1 END)) AS confidence
  FROM cases),
found AS (
  SELECT *, kase IN ('a', 'b') AND array_length > 0 AND tile > 0 AND array_length / tile < 6 AS few FROM raw),
verdicts AS (
  SELECT seqs.record_id,
    CASE WHEN few OR kase = 'u' OR kase IS NULL THEN 'unresolved' WHEN kase IN ('a', 'b') THEN 'hor' ELSE 'simple_tr' END AS verdict,
    founder, multiplicity, tile, founder_score, tile_score, confidence, CAST(coalesce(n_clusters, 0) AS INTEGER) AS n_clusters,
    CASE WHEN few THEN 'insufficient_tile_copies' WHEN kase = 'a' THEN 'top_is_multiple_of_founder'
      WHEN kase = 'b' THEN CASE WHEN multiplicity = 2 THEN 'k2_ratio' ELSE 'non_monotonic_bump' END
      WHEN kase = 'm' THEN 'monotonic_multiples' WHEN kase = 'l' THEN 'lone_significant_cluster'
      WHEN kase = 'u' THEN 'no_multiples' ELSE 'no_clusters' END AS reason
  FROM seqs LEFT JOIN found USING (record_id))"""


SHORT = """short AS (
  SELECT record_id, CASE WHEN verdict = 'unresolved' AND founder IS NULL THEN 'no_signal' ELSE verdict END AS verdict,
    CASE WHEN verdict = 'hor' THEN CAST(floor(founder + 0.5) AS INTEGER) END AS founder,
    CASE WHEN verdict = 'hor' THEN CAST(floor(tile + 0.5) AS INTEGER) WHEN verdict = 'simple_tr' THEN CAST(floor(founder + 0.5) AS INTEGER) END AS tile
  FROM verdicts)"""

PERIODS = """named AS (
  SELECT record_id, founder AS period_bp, 0.95 AS period_score, 'kite_founder' AS source FROM short WHERE verdict = 'hor'
  UNION ALL SELECT record_id, tile, 0.90, 'kite_tile' FROM short WHERE verdict = 'hor' AND tile <> founder
  UNION ALL SELECT record_id, tile, 0.95, 'kite_monomer' FROM short WHERE verdict = 'simple_tr'),
best AS (SELECT p.record_id, p.period, p.rank, verdict FROM peaks p JOIN short USING (record_id) WHERE rank <= 3),
periods AS (
  SELECT * FROM named
  UNION ALL SELECT record_id, period, 0.60, 'kite_secondary' FROM best WHERE verdict IN ('hor', 'simple_tr')
    AND NOT EXISTS (SELECT 1 FROM named n WHERE n.record_id = best.record_id AND n.period_bp = best.period)
  UNION ALL SELECT record_id, period, CASE rank WHEN 1 THEN 0.50 WHEN 2 THEN 0.40 ELSE 0.30 END, 'kite_peak' FROM best WHERE verdict = 'unresolved')"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


DOCUMENTS, BENCHMARK = seqs("documents", "doc_id"), seqs("benchmark", "item_id")
#: Sequences with a strong period of 60 at their head: positive controls.
CONTROLS = seqs("documents", "doc_id", name="own") + """,
seqs AS (SELECT record_id, CASE WHEN length(seq) >= 360 THEN repeat(substr(seq, 1, 60), 8) || substr(seq, 1, 20) || seq ELSE seq END AS seq FROM own)"""
TO_VERDICTS = (hist(), peaks(), clusters(), verdicts())

#: Documents, every third after 30 copies of its first three symbols.
MOTIF_CONTROLS = (
    seqs("documents", "doc_id", name="own")
    + """,
seqs AS (SELECT record_id, CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 AND length(seq) >= 3 THEN repeat(substr(seq, 1, 3), 30) || seq ELSE seq END AS seq FROM own)"""
)
#: (motif length, least repeats) of the motif scan.
SPECS = ((1, 20), (2, 9), (3, 6), *((n, 5) for n in range(4, 15)))


def motif_hits() -> str:
    """Stretches where symbols recur a motif length later, long enough for a hit; one after the other, as hits don't overlap."""
    leads = ", ".join(f"lead(b, {n}) OVER w AS l{n}" for n, _ in SPECS)
    same = " UNION ALL ".join(f"SELECT record_id, {n} AS n, {least} AS least, i FROM sym WHERE b = l{n}" for n, least in SPECS)
    return f"""letters AS (SELECT record_id, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS b FROM seqs WHERE length(seq) > 0),
sym AS (SELECT record_id, i, b, {leads} FROM letters WINDOW w AS (PARTITION BY record_id ORDER BY i)),
same AS ({same}),
islands AS (SELECT record_id, n, least, i, i - row_number() OVER (PARTITION BY record_id, n ORDER BY i) AS run FROM same),
stretches AS (
  SELECT record_id, n, least, min(i) AS a, max(i) + n + 1 AS e, row_number() OVER (PARTITION BY record_id, n ORDER BY min(i)) AS k
  FROM islands GROUP BY record_id, n, least, run HAVING (max(i) + n + 1 - min(i)) // n >= least),
scan AS (
  SELECT record_id, n, least, k, a AS start, (e - a) // n AS repeats, a + (e - a) // n * n AS past FROM stretches WHERE k = 1
  UNION ALL
  SELECT s.record_id, s.n, s.least, s.k, greatest(s.a, c.past), (s.e - greatest(s.a, c.past)) // s.n,
    CASE WHEN (s.e - greatest(s.a, c.past)) // s.n >= s.least THEN greatest(s.a, c.past) + (s.e - greatest(s.a, c.past)) // s.n * s.n ELSE c.past END
  FROM scan c JOIN stretches s ON s.record_id = c.record_id AND s.n = c.n AND s.k = c.k + 1),
hits AS (
  SELECT scan.record_id, n, repeats, start, start + repeats * n - 1 AS "end", substr(seq, start, n) AS motif FROM scan JOIN seqs USING (record_id) WHERE repeats >= least),
plain AS (
  SELECT *, row_number() OVER (PARTITION BY record_id, start ORDER BY n) AS place FROM hits WHERE motif <> repeat(substr(motif, 1, 1), n)),
single AS (SELECT * FROM hits WHERE n = 1 AND record_id NOT IN (SELECT record_id FROM plain)),
kept AS (SELECT record_id, n, repeats, start, "end", motif FROM plain WHERE place = 1 UNION ALL SELECT record_id, n, repeats, start, "end", motif FROM single)"""


ORACLE_SQL: dict[str, str] = {
    "sequence_qc": chain(seqs("documents", "doc_id", unknown="N"))
    + f"""
SELECT record_id, length(seq) AS length_bp, length(regexp_replace(seq, '[^N]', '', 'g')) AS n_count,
  {rounded("CASE WHEN length(seq) = 0 THEN 0.0 ELSE length(regexp_replace(seq, '[^N]', '', 'g')) / length(seq)::DOUBLE END", "n_fraction")},
  CASE WHEN length(seq) < 1000 THEN 'too_short'
    WHEN length(regexp_replace(seq, '[^N]', '', 'g')) / greatest(length(seq), 1)::DOUBLE > 0.2 THEN 'too_many_ns' ELSE 'ok' END AS status
FROM seqs""",
    "composition": chain(DOCUMENTS)
    + "\nSELECT record_id, "
    + ", ".join(f"length(seq) - length(replace(seq, '{s}', '')) AS n_{s.lower()}" for s in "ACGTN")
    + f", {rounded('''CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq)::DOUBLE END''', 'gc_share')} FROM seqs",
    "kmer_histogram": chain(DOCUMENTS, hist()) + "\nSELECT record_id, CAST(d AS INTEGER) AS d, h FROM hist",
    "kmer_histogram_sql": chain(BENCHMARK, hist()) + "\nSELECT record_id, CAST(d AS INTEGER) AS d, h FROM hist",
    "diversity": chain(BENCHMARK, hist())
    + f""", counts AS (SELECT record_id, w, count(*) AS n FROM words GROUP BY record_id, w)
SELECT record_id, count(*) AS "distinct", {rounded("count(*) / max(length(seq))::DOUBLE", "distinct_per_bp")},
  {rounded("log2(sum(n)) - sum(n * log2(n)) / sum(n)", "entropy_bits")}, {rounded("count(CASE WHEN n = 1 THEN 1 END) / count(*)::DOUBLE", "singleton_share")}
FROM counts JOIN seqs USING (record_id) GROUP BY record_id""",
    "motif_forms": chain(BENCHMARK)
    + """,
motifs AS (SELECT DISTINCT substr(seq, i, 5) AS motif FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM seqs WHERE length(seq) >= 5)),
forms AS (SELECT motif, reverse(translate(motif, 'ACGT', 'TGCA')) AS rc FROM motifs)
SELECT motif, rc, list_min(list_concat(
    list_transform(range(1, 6), lambda i: substr(motif || motif, i, 5)),
    list_transform(range(1, 6), lambda i: substr(rc || rc, i, 5)))) AS canonical,
  motif = repeat(substr(motif, 1, 1), 5) AS homopolymer FROM forms""",
    "peaks": chain(DOCUMENTS, hist(), peaks()) + f"\nSELECT record_id, CAST(array_length AS INTEGER) AS array_length, CAST(rank AS INTEGER) AS rank, CAST(period AS INTEGER) AS period, peak_height, {rounded('score')}, {rounded('score2')}, {rounded('score2_norm')} FROM peaks",
    "peaks_wide": chain(DOCUMENTS, hist(), peaks())
    + "\nSELECT seqs.record_id, CAST(length(seq) AS INTEGER) AS array_length, CAST(count(rank) AS INTEGER) AS n_peaks_kept, "
    + ", ".join(f"CAST(max(CASE WHEN rank = {i} THEN period END) AS INTEGER) AS monomer_size{t}, {rounded(f'max(CASE WHEN rank = {i} THEN score END)', 'score' + t)}" for i, t in ((1, ""), (2, "_2"), (3, "_3")))
    + " FROM seqs LEFT JOIN peaks USING (record_id) GROUP BY seqs.record_id, seq",
    "clusters": chain(DOCUMENTS, hist(), peaks(), clusters()) + f"\nSELECT record_id, CAST(cluster AS BIGINT) AS cluster, {rounded('p', 'rep_period')}, {rounded('s', 'total_score')}, CAST(n_peaks AS INTEGER) AS n_peaks, CAST(min_rank AS INTEGER) AS min_rank, periods FROM clusters",
    "verdicts": chain(DOCUMENTS, *TO_VERDICTS) + f"\nSELECT record_id, verdict, founder, multiplicity, tile, {rounded('founder_score')}, {rounded('tile_score')}, {rounded('confidence')}, n_clusters, reason FROM verdicts",
    "verdicts_controls": chain(CONTROLS, *TO_VERDICTS) + f"\nSELECT record_id, verdict, founder, multiplicity, tile, {rounded('founder_score')}, {rounded('tile_score')}, {rounded('confidence')}, n_clusters, reason FROM verdicts",
    "verdict_counts": chain(DOCUMENTS, *TO_VERDICTS) + "\nSELECT verdict, reason, count(*) AS n FROM verdicts GROUP BY verdict, reason",
    "emitted_periods": chain(CONTROLS, *TO_VERDICTS, SHORT, PERIODS) + "\nSELECT record_id, CAST(period_bp AS INTEGER) AS period_bp, CAST(period_score AS DOUBLE) AS period_score, source FROM periods",
    "event_sequences": """
SELECT CAST(user_id AS VARCHAR) AS record_id, string_agg(s, '' ORDER BY ts, event_id) AS seq, CAST(count(*) AS INTEGER) AS length_bp,
  CAST(count(CASE WHEN s = 'N' THEN 1 END) AS INTEGER) AS n_count,
  CASE WHEN count(CASE WHEN s = 'N' THEN 1 END) / count(*)::DOUBLE > 0.2 THEN 'too_many_ns' ELSE 'ok' END AS status
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END AS s
  FROM events WHERE user_id IS NOT NULL) GROUP BY user_id""",
    "class_cascade": f"""
WITH v AS (
  SELECT CAST(c_custkey AS VARCHAR) AS record_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'hor' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'simple_tr' ELSE 'unresolved' END AS verdict FROM customer),
t AS (
  SELECT CAST(o_custkey * 2 AS VARCHAR) AS record_id, CASE WHEN count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0 THEN 'localized_subrepeat' ELSE 'confirms_host' END AS decision,
    count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*)::DOUBLE AS density FROM orders GROUP BY o_custkey),
s AS (SELECT CAST(p_partkey * 3 AS VARCHAR) AS record_id, p_size * 2.0::DOUBLE AS pct FROM part),
j AS (
  SELECT record_id, coalesce(verdict, 'unresolved') AS hor_verdict, coalesce(decision, '') AS tv_decision, density, pct,
    CASE WHEN coalesce(pct, 0) >= 30 THEN '_with_ssr' ELSE '' END AS suffix
  FROM v FULL JOIN t USING (record_id) FULL JOIN s USING (record_id))
SELECT record_id, hor_verdict, tv_decision, {rounded("density", "tv_density")}, 'no' AS ssr_flag, pct AS ssr_raw_total_coverage_pct,
  {rounded("density * 100", "subrepeat_coverage_pct")},
  CASE WHEN pct >= 80 THEN 'pure_ssr' WHEN tv_decision = 'localized_subrepeat' AND density >= 0.4 THEN 'tr_with_subrepeat' || suffix
    WHEN hor_verdict = 'hor' THEN 'hor' || suffix WHEN hor_verdict = 'simple_tr' THEN 'tr' || suffix ELSE 'unresolved' || suffix END AS combined_class
FROM j""",
    "self_matches": chain(CONTROLS)
    + f""",
sym AS (SELECT record_id, length(seq) AS n, seq, unnest(range(0, length(seq) - 60)) AS i FROM seqs WHERE length(seq) >= 240),
hit AS (SELECT record_id, n, i, CASE WHEN substr(seq, i + 1, 1) = substr(seq, i + 61, 1) THEN 1 ELSE 0 END AS m FROM sym),
rate AS (SELECT *, sum(m) OVER w AS s, count(*) OVER w AS c FROM hit WINDOW w AS (PARTITION BY record_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)),
above AS (SELECT record_id, n, i, i - row_number() OVER (PARTITION BY record_id ORDER BY i) AS run FROM rate WHERE c = 60 AND s * (1.0::DOUBLE / 60) >= 0.55),
runs AS (SELECT record_id, n, min(i) AS a, least(max(i) + 60, n) AS b FROM above GROUP BY record_id, n, run HAVING count(*) >= 120),
seen AS (SELECT *, max(b) OVER (PARTITION BY record_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
part AS (SELECT record_id, count(*) AS k, sum(greatest(0, b - greatest(a, coalesce(before, a)))) AS covered FROM seen GROUP BY record_id)
SELECT record_id, 60 AS period, CAST(CASE WHEN length(seq) < 240 THEN -1 ELSE coalesce(k, 0) END AS INTEGER) AS n_intervals,
  {rounded("CASE WHEN length(seq) >= 240 THEN coalesce(covered, 0) / length(seq)::DOUBLE END", "occupancy")}
FROM seqs LEFT JOIN part USING (record_id)""",
    "column_information": chain(DOCUMENTS)
    + f""",
long AS (SELECT record_id, seq, length(seq) // 64 AS n FROM seqs WHERE length(seq) >= 640),
sym AS (SELECT record_id, n, i, substr(seq, i + 1, 1) AS b FROM (SELECT record_id, seq, n, unnest(range(0, length(seq))) AS i FROM long)),
share AS (SELECT record_id, b, count(*) / sum(count(*)) OVER (PARTITION BY record_id)::DOUBLE AS q FROM sym GROUP BY record_id, b),
cells AS (SELECT record_id, n, i % 64 AS c, b, count(*) AS k FROM sym WHERE i < n * 64 GROUP BY record_id, n, c, b),
level AS (SELECT record_id, n, c, sum(k / n::DOUBLE * log2(k / n::DOUBLE / q)) AS ic FROM cells JOIN share USING (record_id, b) GROUP BY record_id, n, c),
change AS (
  SELECT a.record_id, count(CASE WHEN a.b <> z.b THEN 1 END) / count(*)::DOUBLE AS rate FROM sym a JOIN sym z ON a.record_id = z.record_id AND z.i = a.i + 64
  WHERE z.i < a.n * 64 GROUP BY a.record_id)
SELECT record_id, CAST(n AS INTEGER) AS rows, {rounded("avg(ic)", "column_ic")}, {rounded("count(CASE WHEN ic >= 0.2 THEN 1 END) / 64.0::DOUBLE", "fraction_conserved_columns")},
  {rounded("any_value(rate)", "vertical_edge_rate")}
FROM level JOIN change USING (record_id) GROUP BY record_id, n""",
    "interval_union": """
WITH spans AS (SELECT l_partkey, l_orderkey % 1000 AS s, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
seen AS (SELECT *, max(e) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans WHERE e > s),
runs AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY l_partkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM seen)
SELECT l_partkey, min(s) AS "start", max(e) AS "end", count(*) AS n FROM runs GROUP BY l_partkey, run""",
    "interval_occupancy": f"""
WITH spans AS (SELECT l_partkey, l_orderkey % 1000 AS s, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
cells AS (SELECT DISTINCT l_partkey, unnest(range(greatest(s, 100), least(e, 600))) AS x FROM spans)
SELECT p_partkey AS l_partkey, count(x) AS covered, {rounded("count(x) / 500.0::DOUBLE", "share")} FROM part LEFT JOIN cells ON p_partkey = l_partkey GROUP BY p_partkey""",
    "harmonic_families": chain(BENCHMARK, hist(), peaks())
    + f""",
pairs AS (SELECT b.record_id, b.period AS base, p.score2_norm, floor(p.period / b.period::DOUBLE + 0.5) AS m, p.period FROM peaks b JOIN peaks p USING (record_id)),
families AS (SELECT record_id, base, count(*) AS n_members, sum(score2_norm) AS share FROM pairs WHERE m >= 1 AND m <= 20 AND abs(period - m * base) <= 0.02 * m * base GROUP BY record_id, base)
SELECT record_id, CAST(base AS INTEGER) AS base, n_members, {rounded("share")} FROM (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY floor(share * 1e9 + 0.5) DESC, base) AS r FROM families) WHERE r = 1""",
    "coordinate_lift": """
WITH spans AS (SELECT DISTINCT CAST(o_orderkey % 500 AS VARCHAR) AS record_id, o_custkey % 300 AS s, o_orderkey % 97 AS len FROM orders),
indels AS (SELECT CAST(l_orderkey % 500 AS VARCHAR) AS record_id, l_partkey % 400 AS pos, CASE WHEN l_returnflag = 'R' THEN -l_linenumber ELSE l_linenumber END AS delta FROM lineitem)
SELECT record_id, s AS "start", len, CAST(s + coalesce(sum(CASE WHEN pos < s THEN delta END), 0) AS BIGINT) AS new_start,
  CAST(greatest(0, len + coalesce(sum(CASE WHEN pos >= s AND pos < s + len THEN delta END), 0)) AS BIGINT) AS new_len
FROM spans LEFT JOIN indels USING (record_id) GROUP BY record_id, s, len""",
    "category_accuracy": f"""
SELECT c_mktsegment AS category, count(*) AS n, CAST(sum(ok) AS BIGINT) AS n_right, {rounded("avg(ok)", "accuracy")} FROM (
  SELECT *, CASE WHEN c_custkey % 7 <> 0 AND (c_nationkey % 2 = 0) = (c_acctbal > 0) THEN 1 ELSE 0 END AS ok FROM customer) GROUP BY c_mktsegment""",
    "fold_accuracy": f"""
WITH each AS (SELECT c_mktsegment AS category, c_custkey % 5 AS fold, avg(CASE WHEN (c_nationkey % 2 = 0) = (c_acctbal > 0) THEN 1 ELSE 0 END) AS a FROM customer GROUP BY 1, 2)
SELECT category, count(*) AS n_folds, {rounded("avg(a)", "mean_accuracy")}, {rounded("stddev_samp(a)", "sd_accuracy")} FROM each GROUP BY category""",
    "grid_alternatives": """
WITH g AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS case_id, CAST((s_suppkey % 9 + 4) * 12 AS INTEGER) AS m, CAST(s_suppkey % 4 + 1 AS INTEGER) AS o, CAST(s_suppkey % 3 + 1 AS INTEGER) AS k FROM supplier)
SELECT case_id, 1 AS rank, m * o AS tile, o AS multiplicity, m AS founder, 'primary' AS kind FROM g
UNION ALL SELECT case_id, 2, m, k, m // k, 'submotif_hor_inside_monomer' FROM g WHERE k >= 2 AND o = 1
UNION ALL SELECT case_id, 3, m // k, 1, m // k, 'submotif_as_monomer' FROM g WHERE k >= 2 AND o = 1
UNION ALL SELECT case_id, 2, m * o, o * k, m // k, 'submotif_level_inside_horunit' FROM g WHERE k >= 2 AND o > 1
UNION ALL SELECT case_id, 3, m, k, m // k, 'submotif_hor_inside_monomer' FROM g WHERE k >= 2 AND o > 1""",
    "window_plans": chain(CONTROLS, *TO_VERDICTS)
    + f""",
bestp AS (SELECT record_id, max(score2_norm) AS top, arg_max(period, (score2_norm, rank)) AS period FROM peaks GROUP BY record_id),
host AS (
  SELECT v.record_id, verdict, founder, greatest(coalesce(multiplicity, 1), 1) AS copies, multiplicity, top, length(seq) AS n,
    coalesce(CASE WHEN verdict = 'hor' AND tile > 0 THEN tile WHEN verdict = 'simple_tr' AND founder > 0 THEN founder END, period) AS host
  FROM verdicts v JOIN seqs USING (record_id) LEFT JOIN bestp USING (record_id)),
gated AS (
  SELECT *, CASE WHEN host IS NULL OR host <= 0 OR top IS NULL THEN 'no_host' WHEN verdict = 'hor' AND multiplicity = 2 THEN 'skip_k2' END AS g,
    coalesce(verdict = 'hor' AND copies >= 3 AND founder > 0, false) AS ladder FROM host),
inner_ AS (
  SELECT h.record_id, p.period, row_number() OVER (PARTITION BY h.record_id ORDER BY p.score2_norm DESC, p.rank) AS place
  FROM gated h JOIN peaks p USING (record_id)
  WHERE g IS NULL AND p.period >= 20 AND p.period < host * (1.0::DOUBLE / 3) AND p.score2_norm >= 0.03::DOUBLE * top
    AND NOT (ladder AND EXISTS (SELECT 1 FROM range(1, 30) AS r(m) WHERE m < copies AND abs(p.period - m * founder) / (m * founder) <= 0.05))),
cand AS (
  SELECT record_id, 0 AS place, 'founder' AS kind, founder AS period FROM gated WHERE g IS NULL AND ladder AND founder <= host * (1.0::DOUBLE / 3) * 1.01
  UNION ALL SELECT record_id, place, 'other', period FROM inner_ WHERE place <= 5),
cands AS (SELECT record_id, string_agg(kind || ':' || printf('%.2f', period::DOUBLE), ',' ORDER BY place) AS cands, max(period) AS widest FROM cand GROUP BY record_id),
sized AS (
  SELECT h.*, coalesce(c.cands, '') AS cands, CASE WHEN g IS NULL AND widest IS NULL THEN 'no_candidates' ELSE g END AS gate,
    CAST(floor(least(greatest(host / 3, widest * 3, 200), host) + 0.5) AS INTEGER) AS w
  FROM gated h LEFT JOIN cands c USING (record_id)),
stepped AS (SELECT *, greatest(w // 4, 1) AS step FROM sized)
SELECT record_id, {rounded("host")}, gate, CASE WHEN gate IS NULL OR gate = 'no_candidates' THEN cands END AS cands,
  CASE WHEN gate IS NULL THEN CAST(least(w, n) AS INTEGER) END AS window_bp,
  CASE WHEN gate IS NULL THEN CAST(CASE WHEN w >= n THEN 1 ELSE (n - w) // step + 1 + CASE WHEN (n - w) % step > 0 THEN 1 ELSE 0 END END AS INTEGER) END AS n_windows,
  CASE WHEN gate IS NULL THEN CAST(greatest(n - w, 0) AS INTEGER) END AS last_start
FROM stepped""",
    "motif_regions": "WITH RECURSIVE "
    + ",\n".join((MOTIF_CONTROLS, motif_hits()))
    + """
SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY n, start) AS INTEGER) AS ssr_number, CAST(n AS INTEGER) AS motif_length, lower(motif) AS motif_sequence,
  CAST(repeats AS INTEGER) AS repeats, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end",
  list_min(list_concat(list_transform(range(1, n + 1), lambda i: substr(motif || motif, i, n)),
    list_transform(range(1, n + 1), lambda i: substr(repeat(reverse(translate(motif, 'ACGT', 'TGCA')), 2), i, n)))) AS normalized_motif
FROM kept""",
    "motif_summary": "WITH RECURSIVE "
    + ",\n".join((MOTIF_CONTROLS, motif_hits()))
    + """,
named AS (
  SELECT record_id, repeats, "end" - start + 1 AS bp, row_number() OVER (PARTITION BY record_id ORDER BY n, start) AS place,
    list_min(list_concat(list_transform(range(1, n + 1), lambda i: substr(motif || motif, i, n)),
      list_transform(range(1, n + 1), lambda i: substr(repeat(reverse(translate(motif, 'ACGT', 'TGCA')), 2), i, n)))) AS form
  FROM kept),
forms AS (SELECT record_id, form, min(place) AS place, sum(repeats) AS repeats, sum(bp) AS bp FROM named GROUP BY ALL),
only_ AS (
  SELECT * FROM forms f WHERE NOT EXISTS (
    SELECT 1 FROM forms s WHERE s.record_id = f.record_id AND length(s.form) < length(f.form)
      AND repeat(s.form, length(f.form) // length(s.form)) = f.form)),
lead_ AS (SELECT * FROM only_ QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY bp DESC, place DESC) = 1),
totals AS (SELECT record_id, sum(bp) AS bp FROM only_ GROUP BY record_id),
regions AS (SELECT record_id, count(*) AS n FROM kept GROUP BY record_id),
shares AS (
  SELECT c.record_id, length(c.seq) AS length_bp, l.form, l.repeats, coalesce(r.n, 0) AS n_regions,
    coalesce(floor(100.0 * CAST(l.bp AS DOUBLE) / length(c.seq) * 100 + 0.5) / 100, 0.0) AS lead_pct, coalesce(floor(100.0 * CAST(t.bp AS DOUBLE) / length(c.seq) * 100 + 0.5) / 100, 0.0) AS total_pct
  FROM seqs c LEFT JOIN lead_ l USING (record_id) LEFT JOIN totals t USING (record_id) LEFT JOIN regions r USING (record_id))
SELECT record_id, CAST(length_bp AS INTEGER) AS length_bp, CASE WHEN total_pct >= 30.0 THEN 'yes' ELSE 'no' END AS ssr_flag, form AS dominant_motif, CAST(length(form) AS INTEGER) AS dominant_motif_length,
  CAST(coalesce(repeats, 0) AS BIGINT) AS dominant_motif_repeats, lead_pct AS dominant_motif_coverage_pct, total_pct AS total_ssr_coverage_pct, 'raw_fallback' AS ssr_method,
  CAST(NULL AS INTEGER) AS consensus_period_bp, CAST(NULL AS VARCHAR) AS consensus_monomer, form AS ssr_raw_dominant_motif, lead_pct AS ssr_raw_dominant_motif_coverage_pct,
  total_pct AS ssr_raw_total_coverage_pct, CAST(n_regions AS BIGINT) AS ssr_raw_n_regions
FROM shares""",
}
#: The forms for long records give the same rows.
ORACLE_SQL |= {"kmer_histogram_chunks": ORACLE_SQL["kmer_histogram"], "peaks_chunks": ORACLE_SQL["peaks"]}

ORACLE_SQL["pair_statistics"] = f"""
WITH rows_ AS (
  SELECT l_orderkey % 40 AS n, CAST(l_linenumber AS INTEGER) AS rank, CAST(l_linenumber * 7 + 20 AS INTEGER) AS period, 3000 + l_orderkey % 40 * 10 AS len, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
placed AS (SELECT *, len - 2 * period - 10 AS last, l_partkey * 31 % (len - 2 * period - 10 + 1) AS anchor FROM rows_),
pairs AS (
  SELECT CAST(n AS VARCHAR) AS record_id, rank, period, last, anchor,
    (CASE WHEN n % 5 = 0 THEN CASE WHEN anchor * 3 < last THEN q + 900 ELSE q * 3 + 300 END ELSE q * 10 + n % 6 * 100 END) / 1003::DOUBLE AS identity,
    CAST(l_suppkey % 5 - 2 + CASE WHEN n % 3 = 0 THEN 9 ELSE 0 END AS INTEGER) AS shift
  FROM placed),
whole AS (
  SELECT record_id, rank, period, quantile_cont(identity, 0.25) AS p25, quantile_cont(identity, 0.5) AS p50, quantile_cont(identity, 0.75) AS p75, count(*) AS n,
    avg(CASE WHEN identity >= 0.7 THEN 1 ELSE 0 END) AS cov, list_sort(list(shift) FILTER (WHERE identity >= 0.5)) AS shifts
  FROM pairs GROUP BY record_id, rank, period),
shifted AS (SELECT *, CASE WHEN len(shifts) >= 5 THEN shifts[len(shifts) // 2 + 1] END AS med FROM whole),
agreed AS (SELECT *, CASE WHEN med IS NOT NULL THEN len(list_filter(shifts, lambda x: abs(x - med) <= 1)) / len(shifts)::DOUBLE END AS agree FROM shifted),
bins AS (
  SELECT record_id, rank, period, least(anchor * 10 // (last + 1), 9) AS bin, avg(CASE WHEN identity >= 0.7 THEN 1 ELSE 0 END) AS share
  FROM pairs WHERE last > 0 GROUP BY ALL HAVING count(*) >= 5),
spread AS (SELECT record_id, rank, period, max(share) - min(share) AS contrast FROM bins GROUP BY ALL HAVING count(*) >= 2),
marked AS (SELECT *, abs(med) / period::DOUBLE > 0.05 AND agree >= 0.5 AS phantom FROM agreed LEFT JOIN spread USING (record_id, rank, period)),
flagged AS (
  SELECT *, CASE WHEN coalesce(phantom, false) THEN false WHEN contrast IS NOT NULL
      THEN p75 >= 0.7 AND greatest(p75 - p25, 0) >= 0.15 AND p50 < 0.7 AND cov BETWEEN 0.1 AND 0.5 AND contrast >= 0.4 END AS sub,
    arg_min(period, rank) FILTER (WHERE p50 >= 0.7 AND NOT coalesce(phantom, false)) OVER (PARTITION BY record_id) AS founder
  FROM marked)
SELECT record_id, rank, period, {rounded("p50", "identity_med")}, {rounded("greatest(p75 - p25, 0)", "identity_iqr")}, {rounded("p25", "identity_p25")}, CAST(n AS INTEGER) AS identity_n,
  med AS shift_med, {rounded("agree", "shift_consistency")}, phantom, {rounded("cov", "coverage_frac")}, {rounded("contrast", "spatial_contrast")},
  CASE WHEN sub AND period > founder * 0.25 THEN false ELSE sub END AS subrepeat, founder AS founder_period
FROM flagged"""

ORACLE_SQL["irregularities"] = (
    chain(CONTROLS, hist(), peaks())
    + f""",
base AS (
  SELECT s.record_id, length(seq) AS n, p.period FROM seqs s LEFT JOIN (SELECT record_id, arg_max(period, (score2_norm, rank)) AS period FROM peaks GROUP BY record_id) p USING (record_id)),
fit AS (SELECT * FROM base WHERE period > 0 AND n >= 10 * period),
known AS (SELECT w.record_id, w, i - 1 AS pos FROM words w JOIN fit USING (record_id) WHERE NOT regexp_matches(w, '[^ACGT]')),
copies AS (SELECT record_id, w, pos, lag(pos) OVER (PARTITION BY record_id, w ORDER BY pos) AS prior FROM known),
steps AS (SELECT *, pos - prior AS gap FROM copies WHERE prior IS NOT NULL),
usual AS (
  SELECT record_id, w, gap AS usual FROM (
    SELECT record_id, w, gap, row_number() OVER (PARTITION BY record_id, w ORDER BY count(*) DESC, gap) AS place FROM steps GROUP BY record_id, w, gap)
  WHERE place = 1 AND (record_id, w) IN (SELECT (record_id, w) FROM copies GROUP BY record_id, w HAVING count(*) >= 3)),
rated AS (
  SELECT s.*, u.usual, f.period, f.n, floor(gap / u.usual::DOUBLE + 0.5) AS k FROM steps s JOIN usual u USING (record_id, w) JOIN fit f USING (record_id)
  WHERE EXISTS (SELECT 1 FROM (VALUES (1.0::DOUBLE), (2.0), (3.0)) AS m(x) WHERE abs(u.usual - m.x * f.period) / (m.x * f.period) <= 0.05)
    OR EXISTS (SELECT 1 FROM (VALUES (1.0::DOUBLE), (2.0), (3.0), (4.0), (5.0)) AS m(x) WHERE abs(u.usual - f.period / m.x) / (f.period / m.x) <= 0.05)),
locked AS (
  SELECT record_id, w FROM rated GROUP BY record_id, w
  HAVING avg(CASE WHEN k BETWEEN 1 AND 6 AND abs(gap - k * usual) <= 0.05 * greatest(k, 1) * usual THEN 1 ELSE 0 END) >= 0.6),
n_locked AS (SELECT record_id, count(*) AS n_locked FROM locked GROUP BY record_id),
phases AS (
  SELECT record_id, w, ph // 6 AS phase FROM (
    SELECT c.record_id, c.w, pos % period AS ph, row_number() OVER (PARTITION BY c.record_id, c.w ORDER BY count(*) DESC, pos % period) AS place
    FROM copies c JOIN locked USING (record_id, w) JOIN fit USING (record_id) GROUP BY c.record_id, c.w, ph) WHERE place = 1),
n_phases AS (SELECT record_id, count(DISTINCT phase) AS n_phases FROM phases JOIN n_locked USING (record_id) WHERE n_locked >= 3 GROUP BY record_id),
parts AS (
  SELECT r.record_id, phase, floor(((prior + pos) // 2) / r.period::DOUBLE) AS bin, gap - k * usual AS rest, k - 1 AS skip
  FROM rated r JOIN phases USING (record_id, w) JOIN n_phases USING (record_id) WHERE n_phases >= 3 AND k BETWEEN 1 AND 6),
n_groups AS (SELECT record_id, count(DISTINCT phase) AS n_groups, count(*) AS n_pairs, CAST(sum(skip) AS BIGINT) AS drops, median(rest) AS mid FROM parts GROUP BY record_id),
noise AS (
  SELECT record_id, CASE WHEN any_value(n_pairs) < 2 THEN 1.0 ELSE greatest(1.0, 1.4826::DOUBLE * median(abs(rest - mid)) * 3) END AS jitter FROM parts JOIN n_groups USING (record_id) WHERE n_groups >= 3 GROUP BY record_id),
inner_ AS (SELECT record_id, bin, phase, median(rest) AS m FROM parts GROUP BY record_id, bin, phase),
shifts AS (SELECT record_id, bin, count(*) AS g, median(m) AS shift, list(m) AS ms FROM inner_ JOIN noise USING (record_id) GROUP BY record_id, bin),
judged AS (
  SELECT s.*, abs(shift) >= greatest(jitter, 0.05 * period) AS large,
    abs(shift) >= greatest(jitter, 0.05 * period) AND g >= greatest(3, ceil(0.5 * n_groups)) AND len(list_filter(ms, lambda x: sign(x) = sign(shift))) / g::DOUBLE >= 0.7 AS passes
  FROM shifts s JOIN noise USING (record_id) JOIN n_groups USING (record_id) JOIN fit USING (record_id)),
turned AS (SELECT *, CASE WHEN sign(shift) = lag(sign(shift)) OVER (PARTITION BY record_id ORDER BY bin) THEN 0 ELSE 1 END AS turn FROM judged),
signed AS (SELECT *, sum(turn) OVER (PARTITION BY record_id ORDER BY bin) AS run FROM turned),
passing AS (
  SELECT record_id, run, bin, CASE WHEN bin - lag(bin) OVER w <= 2 THEN 0 ELSE 1 END AS opens FROM signed WHERE passes WINDOW w AS (PARTITION BY record_id, run ORDER BY bin)),
spans AS (
  SELECT record_id, run, e, min(bin) AS a, max(bin) AS z FROM (SELECT *, sum(opens) OVER (PARTITION BY record_id, run ORDER BY bin) AS e FROM passing) GROUP BY record_id, run, e),
events AS (
  SELECT x.record_id, x.run, e, median(shift) AS shift FROM spans x JOIN signed b ON b.record_id = x.record_id AND b.run = x.run AND b.bin BETWEEN a AND z AND large GROUP BY ALL),
moved AS (SELECT record_id, count(*) AS n_events, sum(abs(shift)) AS total, max(abs(shift)) AS most, abs(sum(shift)) AS drift FROM events GROUP BY record_id),
done AS (
  SELECT b.record_id, b.n, b.period, n_locked, n_phases, n_groups, n_pairs, drops, jitter, n_events, total, most, drift,
    CASE WHEN b.period IS NULL OR b.period <= 0 THEN 'no_period' WHEN b.n < 10 * b.period THEN 'too_short'
      WHEN coalesce(n_locked, 0) < 3 OR coalesce(n_phases, 0) < 3 OR coalesce(n_groups, 0) < 3 THEN 'no_register_lock' ELSE 'ok' END AS flag
  FROM base b LEFT JOIN n_locked USING (record_id) LEFT JOIN n_phases USING (record_id) LEFT JOIN n_groups USING (record_id) LEFT JOIN noise USING (record_id) LEFT JOIN moved USING (record_id))
SELECT record_id, CAST(n AS INTEGER) AS array_length, CAST(period AS DOUBLE) AS period_p,
  CAST(CASE WHEN flag IN ('no_period', 'too_short') THEN 0 WHEN coalesce(n_locked, 0) < 3 THEN coalesce(n_locked, 0) WHEN n_phases < 3 THEN n_phases ELSE coalesce(n_groups, 0) END AS INTEGER) AS n_kmer_groups,
  CASE WHEN flag = 'ok' THEN n_pairs ELSE 0 END AS n_pairs_total, {rounded("CASE WHEN flag = 'ok' THEN jitter END", "baseline_jitter_bp")},
  CAST(CASE WHEN flag = 'ok' THEN coalesce(n_events, 0) END AS INTEGER) AS indel_event_count, {rounded("CASE WHEN flag = 'ok' THEN coalesce(total, 0) / n::DOUBLE * 100 END", "indel_burden_pct")},
  {rounded("CASE WHEN flag = 'ok' THEN coalesce(most, 0) END", "indel_max_shift_bp")}, {rounded("CASE WHEN flag = 'ok' THEN coalesce(drift, 0) / n::DOUBLE * 1000 END", "indel_drift_bp_per_kb")},
  CASE WHEN flag = 'ok' THEN drops END AS dropout_event_count, {rounded("CASE WHEN flag = 'ok' THEN drops / greatest(n_pairs, 1)::DOUBLE END", "dropout_rate_per_pair")}, flag
FROM done"""
)

ORACLE_SQL["edge_blocks"] = (
    chain(DOCUMENTS)
    + """,
long AS (SELECT record_id, seq, length(seq) // 64 - 1 AS n FROM seqs WHERE length(seq) >= 128),
sized AS (SELECT *, CASE WHEN n <= 8 THEN 1 ELSE CAST(pow(2, ceil(log2(ceil(n / 8::DOUBLE)))) AS BIGINT) END AS h0 FROM long),
levels AS (SELECT s.*, h0 * CAST(pow(2, l) AS BIGINT) AS height FROM sized s, range(0, 4) AS r(l) WHERE l = 0 OR ceil(n / (h0 * pow(2, l - 1))) > 1),
sym AS (SELECT record_id, n, i // 64 AS r, i % 64 AS c, substr(seq, i + 1, 1) <> substr(seq, i + 65, 1) AS x FROM (SELECT record_id, n, seq, unnest(range(0, n * 64)) AS i FROM long)),
cells AS (
  SELECT l.record_id, height, r // height AS block, c, count(*) AS pairs, count(CASE WHEN x THEN 1 END) AS changed FROM sym JOIN levels l USING (record_id) GROUP BY ALL)
SELECT record_id, CAST(height AS INTEGER) AS height, CAST(block AS INTEGER) AS block, CAST(any_value(pairs) AS INTEGER) AS pairs, string_agg(CAST(changed AS VARCHAR), ',' ORDER BY c) AS changed
FROM cells GROUP BY record_id, height, block"""
)
ORACLE_SQL["column_fields"] = (
    chain(DOCUMENTS)
    + f""",
long AS (SELECT record_id, seq, length(seq) // 64 AS n FROM seqs WHERE length(seq) >= 128),
sym AS (SELECT record_id, n, i, substr(seq, i + 1, 1) AS b, substr(seq, i + 65, 1) AS z FROM (SELECT record_id, seq, n, unnest(range(0, length(seq))) AS i FROM long)),
share AS (SELECT record_id, b, count(*) / sum(count(*)) OVER (PARTITION BY record_id)::DOUBLE AS q FROM sym GROUP BY record_id, b),
cells AS (SELECT record_id, n, i % 64 AS c, b, count(*) AS k, count(CASE WHEN i < (n - 1) * 64 AND b <> z THEN 1 END) AS x FROM sym WHERE i < n * 64 GROUP BY record_id, n, c, b)
SELECT record_id, CAST(c AS INTEGER) AS "column", {rounded("sum(k / n::DOUBLE * log2(k / n::DOUBLE / q))", "ic")}, {rounded("sum(x) / any_value(n - 1)::DOUBLE", "edge_rate")}
FROM cells JOIN share USING (record_id, b) GROUP BY record_id, c"""
)
ORACLE_SQL["paired_periods"] = """
WITH periods AS (
  SELECT CASE WHEN o_custkey % 10 = 0 THEN '' WHEN o_custkey % 7 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS key,
    CAST(o_orderkey % 500 + 2 AS INTEGER) AS period, max((o_orderkey % 101) / 100::DOUBLE) AS score FROM orders GROUP BY ALL),
grouped AS (SELECT key, CAST(count(*) AS INTEGER) AS n, arg_min(period, (-score, period)) AS period, max(score) AS score FROM periods GROUP BY key),
met AS (SELECT c_custkey, g.* FROM customer LEFT JOIN grouped g ON key = CAST(c_custkey AS VARCHAR)),
taker AS (SELECT min(c_custkey) AS c_custkey FROM met WHERE key IS NULL)
SELECT CAST(m.c_custkey AS VARCHAR) AS record_id, coalesce(m.n, f.n, 0) AS n_periods, coalesce(m.period, f.period) AS best_period, coalesce(m.score, f.score) AS best_score
FROM met m LEFT JOIN taker ON m.c_custkey = taker.c_custkey LEFT JOIN grouped f ON f.key = '' AND m.key IS NULL AND taker.c_custkey IS NOT NULL"""

#: Line numbers are 1 to 7, so that many steps settle all spans.
ORACLE_SQL["resolved_aliases"] = (
    """WITH spans AS (
  SELECT DISTINCT l_partkey, l_orderkey % 1000 AS s, l_orderkey % 1000 + CAST(l_quantity AS BIGINT) AS e, l_linenumber AS period FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0),
kept1 AS (SELECT * FROM spans WHERE period = 1)"""
    + "".join(
        f""",
kept{n} AS (
  SELECT * FROM kept{n - 1} UNION ALL
  SELECT * FROM spans x WHERE period = {n} AND NOT EXISTS (
    SELECT 1 FROM kept{n - 1} k WHERE k.l_partkey = x.l_partkey AND least(k.e, x.e) - greatest(k.s, x.s) >= 0.5 * (x.e - x.s)))"""
        for n in range(2, 8)
    )
    + """
SELECT l_partkey, s AS "start", e AS "end", CAST(period AS BIGINT) AS period FROM kept7"""
)

_PLANNED = ORACLE_SQL["window_plans"].partition("\nSELECT record_id, floor((host)")[0]
_THREE = "printf('%.3f', floor(({x}) * 1000 + 0.5) / 1000)"


def _decimals(x: str, digits: int, name: str) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits} AS {name}"


ORACLE_SQL["tandem_validation"] = (
    _PLANNED
    + f""",
planned AS (SELECT *, least(w, n) AS window_bp FROM stepped WHERE gate IS NULL),
wins AS (
  SELECT record_id, 0 AS s, n AS e FROM planned WHERE w >= n
  UNION ALL SELECT record_id, unnest(range(0, n - w + 1, step)) AS s, s + w FROM planned WHERE w < n
  UNION ALL SELECT record_id, n - w, n FROM planned WHERE w < n AND (n - w) % step > 0),
wtext AS (SELECT record_id || '|' || s AS record_id, substr(seq, s + 1, e - s) AS seq FROM wins JOIN seqs USING (record_id)),
wpeaks AS (WITH seqs AS (SELECT * FROM wtext), {hist()}, {peaks()} SELECT record_id AS win, rank, period, score2_norm FROM peaks),
wtop AS (SELECT win, max(score2_norm) AS top, arg_max(period, (score2_norm, rank)) AS period FROM wpeaks GROUP BY win),
cases_ AS (SELECT c.*, row_number() OVER (PARTITION BY record_id ORDER BY place) AS c FROM cand c JOIN planned USING (record_id)),
near_ AS (
  SELECT win, c.record_id, c.c, sum(p.score2_norm) AS near FROM cases_ c JOIN wins v USING (record_id) JOIN wpeaks p ON p.win = v.record_id || '|' || v.s
  WHERE c.kind = 'founder' AND abs(p.period - c.period) / c.period <= 0.02 GROUP BY ALL),
seen AS (
  SELECT c.record_id, c.c, c.kind, c.period, h.host, h.window_bp,
    CASE WHEN t.top IS NULL OR t.top <= 0 THEN 0 WHEN c.kind = 'founder' THEN CAST(coalesce(near, 0) / t.top >= 0.2 AS INTEGER)
      ELSE CAST(abs(t.period - c.period) / c.period <= 0.02 AND t.top >= 0.3 AS INTEGER) END AS shown,
    greatest(0, least(9, CAST(floor((v.s + v.e) / 2.0::DOUBLE / greatest(h.n, 1) * 10) AS INTEGER))) AS place,
    greatest(0, least(9, CAST(floor((floor((v.s + v.e) / 2.0::DOUBLE) % greatest(floor(h.host + 0.5), 1)) / greatest(floor(h.host / 10 + 0.5), 1)) AS INTEGER))) AS phase
  FROM cases_ c JOIN planned h USING (record_id) JOIN wins v USING (record_id) LEFT JOIN wtop t ON t.win = v.record_id || '|' || v.s
    LEFT JOIN near_ q ON q.win = v.record_id || '|' || v.s AND q.c = c.c),
whole AS (SELECT record_id, c, kind, period, host, window_bp, count(*) AS n, sum(shown) AS x FROM seen GROUP BY ALL),
spatial AS (SELECT record_id, c, CASE WHEN count(*) >= 2 THEN max(r) - min(r) ELSE 0.0 END AS sc FROM (SELECT record_id, c, place, sum(shown) / count(*)::DOUBLE AS r FROM seen GROUP BY ALL) GROUP BY record_id, c),
turned AS (SELECT record_id, c, CASE WHEN count(*) >= 2 THEN max(r) - min(r) END AS turn FROM (SELECT record_id, c, phase, sum(shown) / count(*)::DOUBLE AS r FROM seen GROUP BY ALL) GROUP BY record_id, c),
scored_ AS (
  SELECT w.*, x / n::DOUBLE AS density, sc, CASE WHEN window_bp < host * 0.95 THEN turn END AS pc FROM whole w JOIN spatial USING (record_id, c) JOIN turned USING (record_id, c)),
decided AS (
  SELECT *, CASE WHEN x < 3 THEN 'no_signal' WHEN density <= 0.35 OR sc >= 0.4 OR coalesce(pc >= 0.4, false) THEN 'localized'
    WHEN density >= 0.7 AND sc <= 0.15 AND coalesce(pc <= 0.15, true) THEN 'uniform' ELSE 'ambiguous' END AS decision FROM scored_),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY CASE decision WHEN 'localized' THEN 0 WHEN 'ambiguous' THEN 1 WHEN 'uniform' THEN 2 ELSE 3 END, -(sc + coalesce(pc, 0)), c) AS r,
    kind || '/' || CAST(CAST(floor(period + 0.5) AS BIGINT) AS VARCHAR) || ':d=' || {_THREE.format(x="density")} || ':sc=' || {_THREE.format(x="sc")} || ':pc=' || CASE WHEN pc IS NULL THEN 'nan' ELSE {_THREE.format(x="pc")} END || ':' || decision AS said
  FROM decided),
texts AS (SELECT record_id, CAST(count(*) AS INTEGER) AS n, string_agg(said, ';' ORDER BY r) AS said FROM ordered GROUP BY record_id)
SELECT s.record_id, verdict, {_decimals("s.host", 2, "host_period")}, CAST(CASE WHEN gate = 'no_host' AND s.host IS NULL THEN multiplicity ELSE copies END AS INTEGER) AS multiplicity,
  CASE WHEN gate IS NULL THEN CAST(least(w, s.n) AS INTEGER) END AS window_bp, coalesce(t.n, 0) AS n_candidates, coalesce(t.said, '') AS candidates,
  {_decimals("b.period", 1, "best_candidate_period")}, b.kind AS best_candidate_kind, {_decimals("b.density", 4, "density")}, {_decimals("b.sc", 4, "spatial_contrast")}, {_decimals("b.pc", 4, "phase_contrast")},
  CAST(coalesce(b.n, 0) AS INTEGER) AS n_windows_total, CAST(coalesce(b.x, 0) AS INTEGER) AS n_windows_present,
  CASE WHEN gate IS NOT NULL THEN gate WHEN b.decision = 'localized' THEN 'localized_subrepeat' WHEN b.decision = 'uniform' THEN 'confirms_host' ELSE b.decision END AS decision_hint,
  CASE WHEN gate IS NOT NULL THEN gate ELSE b.kind || ':' || b.decision END AS reason
FROM stepped s LEFT JOIN texts t USING (record_id) LEFT JOIN ordered b ON b.record_id = s.record_id AND b.r = 1"""
)
