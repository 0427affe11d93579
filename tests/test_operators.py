import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from repetend.operators import detect, evaluate, periodogram, rescore, sequences, summary, verdicts
from repetend.operators.periodogram import PeriodogramConfig
from repetend.plans import pipelines
from repetend.plans import queries as plans
from repetend.sources import fasta, sinks, tables

SMALL = "/root/testdata/sf0.001"


def dna(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def mutated(rnd, text, rate):
    return "".join(rnd.choice("ACGT") if rnd.random() < rate else c for c in text)


@pytest.fixture(scope="module")
def arrays(spark):
    """A plain array, one of higher order with five copies, short motifs, and noise."""
    rnd = random.Random(11)
    unit, kin = dna(rnd, 120), None
    kin = [mutated(rnd, unit, 0.15) for _ in range(5)]
    rows = [
        ("plain", "".join(mutated(rnd, unit, 0.05) for _ in range(150))),
        ("high", "".join(mutated(rnd, x, 0.01) for _ in range(40) for x in kin)),
        ("motif", "CA" * 3000),
        ("noise", dna(rnd, 9000)),
        ("short", "ACGTNNACGT"),
        ("empty", ""),
    ]
    return sequences.records(spark.createDataFrame(rows, "record_id string, seq string").repartition(3)).persist()


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found = plans.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    with duckdb.connect() as c:
        for path in Path(SMALL).glob("*.parquet"):
            c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        want = c.execute(f"""SELECT {", ".join(f'"{x}"' for x in columns)} FROM ({plans.ORACLE_SQL[name]})""").fetchall()
    plain = lambda rows: sorted(tuple(str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)
    assert plain(want) == plain([[r[x] for x in columns] for r in found.collect()])


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_package():
    import subprocess
    import sys
    import tempfile

    root = Path(__spark_entry__.__file__).parent
    with tempfile.TemporaryDirectory() as folder:
        import shutil

        shutil.copytree(root / "repetend", f"{folder}/repetend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copytree(root / "jobs", f"{folder}/jobs")
        shutil.copy(root / "__spark_entry__.py", folder)
        code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
        assert subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin"}).returncode == 0


def test_kernel_and_sql_forms_agree(spark, arrays):
    key = lambda r: (r.record_id, r.d, r.h)
    short = arrays.filter("record_id <> 'motif'")
    own = sorted(map(key, periodogram.distance_histogram(short).collect()))
    assert own == sorted(map(key, periodogram.distance_histogram_sql(short).collect()))
    cfg = PeriodogramConfig(replicates=0)
    lengths = short.select("record_id", "length_bp")
    sql = periodogram.periodogram_peaks_sql(periodogram.distance_histogram(short), lengths, cfg)
    rows = lambda df: sorted((r.record_id, r.rank, r.period, r.peak_height, round(r.score2_norm, 9)) for r in df.collect())
    assert rows(sql) == rows(periodogram.long_peaks(periodogram.periodograms(short, cfg)))


def test_analysis_of_known_arrays(spark, arrays):
    found = pipelines.analyze(arrays)
    rows = {r.record_id: r for r in found.summary.collect()}
    # noise keeps its one best peak, which may stand alone
    assert {i: r.combined_class for i, r in rows.items() if i != "noise"} == {"plain": "tr", "high": "hor", "motif": "pure_ssr", "short": "unresolved", "empty": "unresolved"}
    own = {r.record_id: r for r in found.verdicts.collect()}
    assert (own["high"].founder, own["high"].multiplicity, own["high"].tile) == (120.0, 5, 600.0) and own["plain"].multiplicity == 1
    emitted = verdicts.emitted_periods(verdicts.short_verdicts(found.verdicts), periodogram.long_peaks(found.periodograms))
    periods = {(r.record_id, r.period_bp, r.source) for r in emitted.collect()}
    assert {("high", 120, "kite_founder"), ("high", 600, "kite_tile"), ("plain", 120, "kite_monomer")} <= periods
    again = {r.record_id: r for r in pipelines.analyze(arrays.repartition(1)).summary.collect()}
    assert again == rows
    found.unpersist()


#: Peaks whose verdicts are known: period and share in order of rank.
GOLDEN = {
    "top": ([(300, 0.5), (100, 0.2), (600, 0.1), (200, 0.05)], 30_000, ("hor", 100.0, 3, 300.0, "top_is_multiple_of_founder")),
    "two": ([(100, 0.5), (200, 0.3), (400, 0.1), (300, 0.05)], 30_000, ("hor", 100.0, 2, 200.0, "k2_ratio")),
    "bump": ([(150, 0.5), (450, 0.24), (300, 0.1), (900, 0.05)], 30_000, ("hor", 150.0, 3, 450.0, "non_monotonic_bump")),
    "fall": ([(150, 0.5), (300, 0.2), (450, 0.1)], 30_000, ("simple_tr", 150.0, 1, 150.0, "monotonic_multiples")),
    "lone": ([(170, 0.9), (1234, 0.01)], 30_000, ("simple_tr", 170.0, 1, 170.0, "lone_significant_cluster")),
    "none": ([(170, 0.5), (1234, 0.4)], 30_000, ("unresolved", 170.0, None, None, "no_multiples")),
    "few": ([(300, 0.5), (100, 0.2), (600, 0.1)], 1500, ("unresolved", 100.0, 3, 300.0, "insufficient_tile_copies:n=5.00<6")),
    "low": ([(19, 0.9)], 30_000, ("unresolved", None, None, None, "no_clusters")),
}


def test_verdict_rules(spark):
    rows = [(name, length, i, p, s) for name, (peaks, length, _) in GOLDEN.items() for i, (p, s) in enumerate(peaks, 1)]
    peaks = spark.createDataFrame(rows, "record_id string, array_length int, rank int, period int, score2_norm double")
    found = {r.record_id: (r.verdict, r.founder, r.multiplicity, r.tile, r.reason) for r in verdicts.verdicts(peaks).collect()}
    assert found == {name: want for name, (*_, want) in GOLDEN.items()}


def test_all_classes(spark):
    cases = [
        ("hor", 85.0, "no_candidates", None, "pure_ssr"), ("hor", 40.0, "localized_subrepeat", 0.5, "tr_with_subrepeat_with_ssr"), ("simple_tr", 0.0, "localized_subrepeat", 0.4, "tr_with_subrepeat"),
        ("hor", 0.0, "localized_subrepeat", 0.39, "hor"), ("hor", 30.0, "confirms_host", 1.0, "hor_with_ssr"), ("simple_tr", 29.99, "", None, "tr"), ("simple_tr", 79.99, "", None, "tr_with_ssr"),
        ("unresolved", None, "localized_subrepeat", None, "unresolved"), (None, 50.0, None, None, "unresolved_with_ssr"),
    ]
    df = spark.createDataFrame(cases, "v string, s double, d string, x double, want string")
    F = sequences.F
    assert all(r.got == r.want for r in df.select("want", summary.combined_class(F.col("v"), F.col("s"), F.col("d"), F.col("x")).alias("got")).collect())


def test_rescore_keeps_every_row(spark, arrays):
    peaks = periodogram.long_peaks(periodogram.periodograms(arrays))
    found = rescore.rescore(peaks, arrays).collect()
    assert len(found) == peaks.count()
    by = {(r.record_id, r.period): r for r in found}
    assert by["high", 600].identity_med > by["high", 120].identity_med + 0.05 and by["high", 120].founder_period in (120, 600)
    assert all(r.identity_med is None and r.identity_n == 0 for r in found if r.period < 20 or r.rank > 10)


def test_detector_tables(spark, arrays):
    periods = detect.auto_periods(arrays)
    found = detect.detect(arrays, periods).persist()
    rows = {r.record_id: r for r in detect.properties(found).collect()}
    assert (rows["high"]["class"], rows["high"].base_width_bp, rows["high"].hor_k) == ("HOR", 120, 5) and rows["plain"]["class"] == "simple_TR"
    assert detect.width_features(found).filter("record_id = 'high' and width_bp = 120").first().best_lag == 5
    assert detect.consensus(found).filter("record_id = 'high'").count() == 2
    missing, extra = detect.unmatched(arrays, spark.createDataFrame([("high", 1), ("other", 2)], "record_id string, period_bp int"))
    assert missing.count() == 5 and extra.count() == 1
    found.unpersist()


def test_files_round_trip(spark, arrays, tmp_path):
    body = ">one two\nACGT\nacgu\n>two\n\nNNRY\n>three\n"
    (tmp_path / "a.fa").write_text(body)
    rows = [(r.record_id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()]
    assert rows == [("one", "ACGTacgu"), ("two", "NNRY"), ("three", "")]
    loaded = {r.record_id: (r.seq, r.n_count, r.status) for r in fasta.load_records(spark, str(tmp_path / "a.fa"), min_length=4).collect()}
    assert loaded == {"one": ("ACGTACGT", 0, "ok"), "two": ("NNNN", 4, "too_many_ns"), "three": ("", 0, "too_short")}
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\n@@II\n@r2\nGG\n+\nII\n")
    assert [(r.record_id, r.seq) for r in fasta.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("ordinal").collect()] == [("r1", "ACGT"), ("r2", "GG")]
    sinks.write_fasta(arrays.filter("record_id in ('plain', 'motif')"), str(tmp_path / "out.fa"))
    back = {r.record_id: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "out.fa")).collect()}
    assert back == {r.record_id: r.seq for r in arrays.collect() if r.record_id in back} and len(back) == 2
    peaks = periodogram.long_peaks(periodogram.periodograms(arrays, PeriodogramConfig(replicates=0)))
    sinks.write_peaks(peaks, str(tmp_path / "peaks"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_peaks(peaks, str(tmp_path / "peaks"))
    again = tables.read_peaks(spark, str(tmp_path / "peaks"))
    assert again.count() == peaks.count() and {r.record_id: r.top_period for r in tables.top_periods(again).collect()}["motif"] == 2
    found = verdicts.verdicts(peaks, arrays)
    sinks.write_verdicts(found, str(tmp_path / "verdicts"), force=True)
    assert {r.record_id: (r.verdict, r.multiplicity) for r in tables.read_verdicts(spark, str(tmp_path / "verdicts")).collect()} == {r.record_id: (r.verdict, r.multiplicity) for r in found.collect()}
    (tmp_path / "pairs").mkdir()
    for name in ("x.fa", "y.fa", "x.periods.tsv", "z.periods.tsv"):
        (tmp_path / "pairs" / name).write_text(">x")
    with pytest.raises(ValueError, match=r"sequences \['y'\], periods \['z'\]"):
        fasta.pair_files(spark, str(tmp_path / "pairs"), str(tmp_path / "pairs"))


def test_general_format(spark):
    values = [0.0, 1.0, 123456.0, 1234567.0, 0.0001, 0.00001234, 1.5, -2.25, 99999.96, 0.1 + 0.2, 1e-300, 12.0]
    F = sequences.F
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", sinks.general(F.col("x"), 6).alias("six"), sinks.general(F.col("x"), 4).alias("four"))
    for r in df.collect():
        assert r.six == f"{r.x:.6g}" and r.four == f"{r.x:.4g}", r


def test_interval_and_rounding_tools(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (2, 3, 3)], "k int, start long, end long")
    assert sorted((r.k, r.start, r.end, r.n) for r in evaluate.union_intervals(spans, ["k"]).collect()) == [(1, 0, 8, 2), (1, 10, 12, 1)]
    F = sequences.F
    df = spark.createDataFrame([(1.005,), (0.285,), (-2.5,), (2.5,)], "x double")
    assert [r.r for r in df.select(sequences.round_half_away(F.col("x"), 2).alias("r")).collect()] == [1.0, 0.28, -2.5, 2.5]
    assert [r.d for r in spark.range(13).select(sequences.divisors(F.col("id")).alias("d")).collect()][12] == [2, 3, 4, 6]


DOCUMENT = {
    "schema_version": 1, "seed": 5, "global": {"mutation_rate": 0.01, "indel_rate": 0.001},
    "templates": {"a": {"type": "HOR_slots", "monomer_length_bp": 120, "k": 4, "inter_slot_divergence": 0.2}, "b": {"type": "monomer", "monomer_length_bp": 90}},
    "structure": [{"type": "HOR", "template": "a", "n_copies": 40}, {"type": "SHIFT", "offset_bp": 30}, {"type": "HOR", "template": "a", "n_copies": 40}, {"type": "INSERTION", "length_bp": 600, "kind": "retro_like"}],
    "post_generation": [{"type": "INVERSION", "block": 0, "start_copy": 3, "length_copies": 2}, {"type": "DELETION", "block": 2, "start_copy": 5, "length_copies": 1}, {"type": "HYBRID", "block": 0, "at_copy": 9, "slot": 2, "source_slots": [1, 3]}],
}


def test_synthesis(spark):
    from repetend.kernels import synth
    from repetend.operators import generate

    simple = {"schema_version": 1, "templates": DOCUMENT["templates"], "structure": [{"type": "SIMPLE_TR", "template": "b", "n_copies": 120}], "modifiers": [{"wobble": {"amplitude_bp": 3, "period_rows": 20, "model": "sinusoidal"}}]}
    rows = {r.record_id: r for r in generate.synthesize(spark, {"one": DOCUMENT, "two": simple}).collect()}
    one, two = rows["one"], rows["two"]
    assert (one.truth_class, one.base_width_bp, one.hor_k, one.n_phase_shifts, one.phase_shift_offsets) == ("HOR", 120, 4, 1, [30])
    assert abs(one.phase_shift_positions[0] - 40 * 480) < 60 and abs(len(one.seq) - (79 * 480 + 630)) < 150 and len(one.seq) == one.length_bp
    assert one.structural_expression == "H([M_1..M_4],40,div=0.2)|shift(30)|H([M_1..M_4],40,div=0.2)+I(600,retro_like)"
    assert {(p.period_bp, p.source) for p in one.periods} >= {(120, "true_base"), (480, "true_hor_unit")}
    assert (two.truth_class, two.wobble_periodicity_bp) == ("simple_TR", 1800.0) and 1.5 < two.wobble_amplitude_bp < 2.5
    assert {r.record_id: r.seq for r in generate.synthesize(spark, {"two": simple, "one": DOCUMENT}).collect()} == {"one": one.seq, "two": two.seq}
    for change in ({"schema_version": 2}, {"structure": [{"type": "HOR", "template": "b", "n_copies": 2}]}, {"structure": [{"type": "SHIFT", "offset_bp": -5}]}, {"more": 1}, {"post_generation": [{"type": "DELETION", "block": 1, "start_copy": 1, "length_copies": 1}]}):
        with pytest.raises(ValueError):
            synth.validate(DOCUMENT | change)


def test_grid_and_detection_of_it(spark):
    from repetend.operators import generate

    grid = spark.createDataFrame([("h", 100, 3, 60, 0.12, 0.02, 1, 7), ("s", 90, 1, 100, 0.0, 0.05, 1, None), ("p", 90, 2, 20, 0.1, 0.02, 3, 1), ("bad", 100, 2, 10, 0.0, 0.0, 3, 1)], "case_id string, monomer_len int, hor_order int, n_blocks int, sub_rate_intra double, sub_rate_inter double, submono_k int, seed long")
    made = generate.simulate_grid(grid).persist()
    rows = {r.record_id: r for r in made.collect()}
    assert rows["bad"].error and rows["bad"].seq is None
    assert len(rows["h"].seq) == rows["h"].array_length == 18_000 and len(rows["h"].monomers) == rows["h"].n_monomers == 180 and rows["h"].hor_signal > 0.05
    assert rows["s"].mean_intra_block_id is None and 0.85 < rows["s"].mean_homologous_id < 0.95
    recs = sequences.records(made.filter("error is null and record_id <> 'p'").select("record_id", "seq"))
    found = {r.record_id: r for r in verdicts.verdicts(periodogram.long_peaks(periodogram.periodograms(recs)), recs).collect()}
    assert (found["h"].verdict, found["h"].multiplicity, found["s"].verdict) == ("hor", 3, "simple_tr")
    kinds = {(r.case_id, r["rank"]): (r.tile, r.multiplicity, r.founder) for r in generate.alternatives(grid.filter("case_id <> 'bad'")).collect()}
    assert kinds == {("h", 1): (300, 3, 100), ("s", 1): (90, 1, 90), ("p", 1): (180, 2, 90), ("p", 2): (180, 6, 30), ("p", 3): (90, 3, 30)}
    made.unpersist()


def test_stream_of_files(spark, tmp_path):
    from repetend.streaming import records

    rnd = random.Random(21)
    (tmp_path / "in").mkdir()
    unit = dna(rnd, 90)
    (tmp_path / "in" / "a.fa").write_text(">one\n" + unit * 80 + "\n>two x\nACGT\n")
    query = records.write_verdicts(records.read_fasta_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    rows = {r.record_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (rows["one"].verdict, rows["one"].founder) == ("simple_tr", 90.0) and rows["two"].reason == "no_clusters"


def test_fasta_marks_in_headers_line_ends_and_splits(spark, tmp_path):
    from repetend.sources import fasta

    rnd = random.Random(1)
    want = [(f"r{i}", "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 400)))) for i in range(200)]
    for end in ("\n", "\r\n"):
        text = end + "".join(f">{name} len>5 x{end}" + "".join(seq[k : k + 60] + end for k in range(0, len(seq), 60)) for name, seq in want)
        (tmp_path / "a.fa").write_bytes(text.encode())
        (tmp_path / "a.fq").write_bytes("".join(f"@{name} x>y{end}{seq}{end}+{end}{'@' * len(seq)}{end}" for name, seq in want).encode())
        for size in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                assert [(r.record_id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()] == want
                assert [(r.record_id, r.seq) for r in fasta.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("ordinal").collect()] == want
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
        both = [sorted((r.record_id, r.seq, r.status) for r in fasta.load_records(spark, str(tmp_path / f)).collect()) for f in ("a.fa", "a.fq")]
        assert both[0] == both[1] and len(both[0]) == 200
