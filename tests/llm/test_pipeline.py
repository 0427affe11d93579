import math
import zlib
from collections import Counter

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from repetend.llm import langid, packing, queries, secret_scan  # noqa: E402
from tests.llm.test_line_dedup import every_earlier  # noqa: E402
from tests.llm.test_near_copies import least_of_groups  # noqa: E402
from tests.llm.test_packing import check  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of what each stage returns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out, place = [docs.collect()], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SMALL)
        assert name == "pack" or result.columns == docs.columns
        result.write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out.append(docs.collect())
    return out


def gains(rows):
    """Gain of each trigram by language, counted in plain Python from the rows that may train."""
    counts = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(langid.trigrams(r.text).tolist())
    return {lang: {g: math.log(0.9 * n / sum(c.values()) * langid.SYMBOLS**3 + 0.1) for g, n in c.items()} for lang, c in counts.items()}


def gained(grams, row):
    """Whether a text's mean gain is enough for its number of trigrams."""
    return len(grams) > 0 and sum(row.get(g, math.log(0.1)) for g in grams.tolist()) / len(grams) >= langid.LEAST_GAIN - langid.SHORT / math.sqrt(len(grams))


def test_stages_against_brute_force(stages, spark):
    docs, known, edited, single, safe, packed = ({r.doc_id: r for r in rows} if i < 5 else rows for i, rows in enumerate(stages))
    table = gains(docs.values())
    fine = {i for i, r in docs.items() if any(gained(langid.trigrams(r.text or ""), row) for row in table.values())}
    assert set(known) == fine and len(fine) > 0.95 * len(docs)
    gone = every_earlier({i: r.text for i, r in known.items()}, 50)
    assert {i: r.text for i, r in edited.items()} == {i: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[i]) for i, r in known.items()}
    assert set(single) == least_of_groups({i: r.text for i, r in edited.items()})
    rule = secret_scan.rule(spark.createDataFrame([(r.text,) for r in single.values()], "text string"))
    assert {i: (r.text, r.n_chars) for i, r in safe.items()} == {i: (t := secret_scan.redact(r.text, secret_scan.scan(r.text, rule)), len(t)) for i, r in single.items()}
    check(packed, packing.SIZE)
    assert {r.doc_id for r in packed} == set(safe)


def test_run_gives_the_last_stage(stages, spark):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(key, stages[-1]))


def test_empty_documents_pass(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_sql_of_queries(spark):
    for name, sql in queries.ORACLE_SQL.items():
        with duckdb.connect() as c:
            for table in ("documents", "pages", "benchmark", "labels"):
                c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
            found = queries.QUERIES[name](spark, SMALL)
            columns = ", ".join(sorted(found.columns))
            want = c.execute(f"SELECT {columns} FROM ({sql})").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[x] for x in sorted(found.columns))) for r in found.collect())
