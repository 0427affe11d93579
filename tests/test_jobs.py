import logging
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobs import configured, pooled_periods, screen_arrays
from jobs import queries as jobs
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.operators import periodogram, sequences, verdicts

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__spark_entry__.__file__).parent


def plain(rows):
    return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query_equals_its_sql(spark, name):
    found = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
        want = c.execute(f"""SELECT {", ".join(f'"{x}"' for x in columns)} FROM ({__spark_entry__.oracle_sql()[name]})""").fetchall()
    assert plain(want) == plain([[r[x] for x in columns] for r in found.collect()])


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("part-*")}


def screened(spark, out):
    return {t: screen_arrays.read(spark, out, t) for t in screen_arrays.TABLES}


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_screen_takes_only_what_is_new(spark, docs, tmp_path, caplog):
    caplog.set_level(logging.INFO, "repetend.jobs")
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    cfg = configured(screen_arrays.Config, screen_arrays.CONFIG)
    docs.filter("doc_id % 3 = 0").coalesce(1).write.parquet(source)
    assert screen_arrays.run(spark, source, out, mark, cfg) == 1
    first = files(out)
    n_first = docs.filter("doc_id % 3 = 0").count()
    assert screened(spark, out)["arrays"].count() == n_first
    # nothing new: nothing is written
    assert screen_arrays.run(spark, source, out, mark, cfg) == 0
    assert files(out) == first and "nothing new" in caplog.text

    docs.filter("doc_id % 3 <> 0").coalesce(1).write.mode("append").parquet(source)
    assert screen_arrays.run(spark, source, out, mark, cfg) == 1
    assert {p: t for p, t in files(out).items() if p in first} == first
    both = screened(spark, out)
    assert [r["count"] for r in both["arrays"].groupBy("batch").count().orderBy("batch").collect()] == [n_first, docs.count() - n_first]
    # as one run over all of it
    recs = sequences.records(sequences.from_text(docs, "doc_id"), min_length=cfg.min_length).filter("status = 'ok'")
    peaks = periodogram.long_peaks(periodogram.periodograms(recs, PeriodogramConfig(replicates=0)))
    judged = verdicts.verdicts(peaks, recs)
    assert plain(both["verdicts"].select(judged.columns).collect()) == plain(judged.collect())
    periods = verdicts.emitted_periods(verdicts.short_verdicts(judged), peaks)
    assert plain(both["periods"].select(periods.columns).collect()) == plain(periods.collect())


def test_texts_are_dealt_out_once_and_before_they_become_symbols(docs):
    recs = screen_arrays.dealt_out(docs, configured(screen_arrays.Config, screen_arrays.CONFIG))
    plan = periodogram.periodograms(recs, PeriodogramConfig(replicates=0), dealt=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("translate(") < plan.index("RepartitionByExpression")


def test_symbols_and_unknown_ones_of_a_text(spark):
    text = "Aé b\n\nNZ 中9 K̂İ"
    for unknown in (False, True):
        low = [c if "a" <= c <= "z" else "N" * unknown for c in spark.sql("SELECT lower(?) AS s", args=[text]).first().s]
        seq = "".join(("ACGT" * 7)[ord(c) - 97] if c.islower() else c for c in low)
        got = sequences.records(sequences.from_text(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", unknown=unknown), fold=False).first()
        assert (got.seq, got.n_count) == (seq, seq.count("N"))


def test_screen_after_a_failure(spark, docs, tmp_path, monkeypatch):
    """A micro-batch that fails halfway runs again into the same folders."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    cfg = configured(screen_arrays.Config, screen_arrays.CONFIG)
    docs.repartition(2).write.parquet(source)
    with monkeypatch.context() as m:
        m.setattr(screen_arrays.verdicts, "emitted_periods", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivision|division by zero"):
            screen_arrays.run(spark, source, out, mark, cfg)
    assert Path(out, "verdicts").exists() and not Path(out, "periods").exists()
    screen_arrays.run(spark, source, out, mark, cfg)
    found = screened(spark, out)
    assert found["arrays"].count() == found["arrays"].select("record_id").distinct().count() == docs.count()
    assert found["verdicts"].count() == found["arrays"].filter("status = 'ok'").count() and found["periods"].count() > 0


def test_screen_of_fasta_files_and_odd_rows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    unit = "ACGGTCATTGCAAGCTTAGGCATCCAGT"
    (source / "one.fa").write_text(f">a first\n{unit * 20}\n{unit * 20}\n>b\nACG\n>c\n{'N' * 500}\n")
    cfg = screen_arrays.Config(format="fasta", min_length=100, replicates=0, max_files=1)
    screen_arrays.run(spark, str(source), out, str(tmp_path / "mark"), cfg)
    (source / "two.fa").write_text(f">d\n{unit.lower() * 40}\n")
    screen_arrays.run(spark, str(source), out, str(tmp_path / "mark"), cfg)
    got = {r.record_id: (r.status, r.length_bp, r.batch) for r in screened(spark, out)["arrays"].collect()}
    assert got == {"a": ("ok", 1120, 0), "b": ("too_short", 3, 0), "c": ("too_many_ns", 500, 0), "d": ("ok", 1120, 1)}
    founders = {r.record_id: r.founder for r in screened(spark, out)["verdicts"].collect()}
    assert founders == {"a": 28.0, "d": 28.0}
    # null texts are empty arrays
    spark.createDataFrame([(1, None), (None, "x" * 50)], "doc_id long, text string").write.parquet(str(tmp_path / "odd"))
    screen_arrays.run(spark, str(tmp_path / "odd"), f"{out}2", str(tmp_path / "mark2"), screen_arrays.Config(alphabet="prose", min_length=8))
    assert {(r.record_id, r.status) for r in screened(spark, f"{out}2")["arrays"].collect()} == {("1", "too_short"), (None, "ok")}
    with pytest.raises(ValueError):
        screen_arrays.run(spark, str(source), out, str(tmp_path / "mark3"), screen_arrays.Config(format="bam"))


def test_pooled_periods_by_hand(spark, tmp_path):
    out, unit = str(tmp_path / "out"), "ACGGTCATTGCAAGCTTAGGCATCCAGT"
    rows = [(1, unit * 5, "x"), (2, unit * 3, "x"), (3, "ACG", "x"), (4, unit[:20] * 4, None), (5, None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "in"))
    cfg = pooled_periods.Config(alphabet="dna")
    pooled_periods.run(spark, str(tmp_path / "in"), out, cfg)
    found = {(r.cohort, r.d): (r.h, r.n_arrays, r.places, r["rank"]) for r in pooled_periods.read(spark, out).collect()}
    # of 28 * n symbols, 28 * n - 5 are words, and 28 fewer have a word 28 places on
    assert found["x", 28] == (28 * 4 - 5 + 28 * 2 - 5, 2, 28 * 4 - 5 + 28 * 2 - 5, 1)
    assert found["", 20] == (55, 1, 55, 1)
    assert found["x", 0] == (0, 2, 28 * 8 - 10, None) and found["y", 0] == (0, 0, 0, None)


def test_pooled_periods_replace_their_cohorts(spark, docs, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.write.parquet(source)
    cfg = configured(pooled_periods.Config, pooled_periods.CONFIG)
    pooled_periods.run(spark, source, out, cfg)
    whole = plain(pooled_periods.read(spark, out).collect())
    pooled_periods.run(spark, source, out, cfg)
    assert plain(pooled_periods.read(spark, out).collect()) == whole
    # one cohort loses its texts: its rows go, the others' files stay
    before = files(out)
    docs.withColumn("text", F.when(F.col("lang") == "de", None).otherwise(F.col("text"))).write.mode("overwrite").parquet(f"{source}2")
    pooled_periods.run(spark, f"{source}2", out, pooled_periods.Config(cohorts=["de"]))
    assert {p for p in before if "cohort=de" not in str(p)} == {p for p in files(out) if "cohort=de" not in str(p)}
    assert [(r.d, r.h, r.n_arrays, r["rank"]) for r in pooled_periods.read(spark, out).filter("cohort = 'de'").collect()] == [(0, 0, 0, None)]


def test_command_line(docs, tmp_path):
    docs.limit(30).write.parquet(str(tmp_path / "in"))
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    for job, more in (("pooled_periods", []), ("screen_arrays", ["--checkpoint", str(tmp_path / "mark")])):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--source", str(tmp_path / "in"), "--output", str(tmp_path / job), *more], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "30" in done.stderr, done.stderr[-2000:]
    assert files(tmp_path / "pooled_periods") and files(tmp_path / "screen_arrays" / "verdicts")


def test_configurations(tmp_path):
    assert configured(pooled_periods.Config, pooled_periods.CONFIG).top == 50
    (tmp_path / "bad.toml").write_text("topp = 3\n")
    with pytest.raises(ValueError, match="topp"):
        configured(pooled_periods.Config, tmp_path / "bad.toml")
