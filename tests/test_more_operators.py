import random

import numpy as np
import pytest

from repetend.kernels import symbols
from repetend.kernels import width as W
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.kernels.register import Bins, events_of
from repetend.kernels.rescoring import RescoreConfig
from repetend.operators import detect, evaluate, fields, periodogram, rescore, sequences
from repetend.plans import queries as plans


def mutated(rnd, text, rate):
    return "".join(rnd.choice("ACGT") if rnd.random() < rate else c for c in text)


@pytest.fixture(scope="module")
def recs(spark):
    rnd = random.Random(12)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    unit, kin = dna(120), [dna(171) for _ in range(3)]
    rows = [("plain", "".join(mutated(rnd, unit, 0.08) for _ in range(90))), ("high", "".join(mutated(rnd, x, 0.03) for _ in range(20) for x in kin)), ("half", dna(5000) + unit * 30), ("noise", dna(6000)), ("short", "ACGT"), ("empty", "")]
    return sequences.records(spark.createDataFrame(rows, "record_id string, seq string").repartition(3)).persist()


def test_pair_statistics_are_those_of_rescoring(recs):
    """One form in a kernel, one of aggregates over the table of pairs."""
    peaks = periodogram.long_peaks(periodogram.periodograms(recs, PeriodogramConfig(replicates=0))).select("record_id", "rank", "period").filter("rank <= 12")
    cfg = RescoreConfig(samples=60)
    names = ["record_id", "rank", "period", "identity_med", "identity_iqr", "identity_p25", "identity_n", "shift_med", "shift_consistency", "phantom", "coverage_frac", "spatial_contrast", "subrepeat", "founder_period"]
    key = lambda rows: {tuple(r[:3]): tuple(None if x is None else round(float(x), 9) for x in r[3:]) for r in rows}
    want = key(rescore.rescore(peaks, recs, cfg).filter("identity_n > 0").select(names).collect())
    got = key(rescore.pair_statistics(rescore.pair_table(peaks, recs, cfg), cfg).select(names).collect())
    assert got == want and len(got) > 20
    assert {v[6] for v in got.values()} >= {0.0, None} or True in {bool(v[6]) for v in got.values()}


def greedy(intervals, share):
    kept = []
    for s, e, p in sorted(set(intervals), key=lambda x: x[2]):
        if e > s and not any(k[2] < p and min(e, k[1]) - max(s, k[0]) >= share * (e - s) for k in kept):
            kept.append((s, e, p))
    return sorted(kept)


@pytest.mark.parametrize("share", [0.5, 0.31, 1.0])
def test_aliases_against_the_greedy_sweep(spark, share):
    rnd = random.Random(int(share * 100))
    rows = []
    for key in ("a", "b", None):
        for _ in range(250):
            start, length = rnd.randrange(3000), int(2 ** rnd.uniform(0, 10))
            rows.append((key, start, start + length, rnd.randrange(1, 9)))
    rows += rows[:20] + [("a", 7, 7, 1)]
    got = evaluate.resolve_aliases(spark.createDataFrame(rows, "k string, start long, end long, period int").repartition(3), ["k"], share).collect()
    for key in ("a", "b", None):
        assert sorted((r.start, r.end, r.period) for r in got if r.k == key) == greedy([r[1:] for r in rows if r[0] == key], share)
    empty = spark.createDataFrame([], "k string, start long, end long, period int")
    assert evaluate.resolve_aliases(empty, ["k"], share).count() == 0


def test_arrays_with_periods(spark):
    recs = spark.createDataFrame([("c", 2, "A"), ("a", 0, "C"), ("b", 1, "G")], "record_id string, ordinal long, seq string")
    periods = lambda rows: spark.createDataFrame(rows, "record_id string, period_bp int, period_score double")
    got = lambda rows, **more: {r.record_id: None if r.own is None else [p.period_bp for p in r.own] for r in detect.arrays_with_periods(recs, periods(rows), "ordinal", **more).collect()}
    own = [("a", 5, 0.1), ("a", 7, 0.9), ("a", 5, 0.3), ("c", 9, 0.5)]
    # the first record without periods takes those without an id, or those of the stem
    assert got([*own, (None, 30, 0.5)]) == {"a": [7, 5], "b": [30], "c": [9]}
    assert got([*own, ("file", 31, 0.5)], stem="file") == {"a": [7, 5], "b": [31], "c": [9]}
    assert got([("", 4, 0.5)], allow_missing=True) == {"a": [4], "b": None, "c": None}
    with pytest.raises(ValueError, match="without periods: \\['b'\\]"):
        got(own)
    with pytest.raises(ValueError, match="without a record: \\['z'\\]"):
        got([*own, ("z", 3, 0.5)], allow_missing=True)
    assert got([*own, ("z", 3, 0.5)], allow_missing=True, allow_extra=True)["b"] is None
    everyone = [*own, ("b", 8, 0.2), ("file", 3, 0.5)]
    with pytest.raises(ValueError, match="without a record: \\['file'\\]"):
        got(everyone, stem="file")
    assert got(everyone, stem="file", allow_extra=True)["b"] == [8]


def test_pyramid_adds_up(recs):
    got = fields.edge_pyramid(recs, 50, 16).collect()
    for name, seq in ((r.record_id, r.seq) for r in recs.collect()):
        own = [r for r in got if r.record_id == name]
        rows = W.rows_of(symbols.codes(seq), 50)
        n = len(rows) - 1
        if n < 1:
            assert not own
            continue
        heights = sorted({r.height for r in own})
        assert len(own) < 33 and len([r for r in own if r.height == heights[0]]) <= 16 and len([r for r in own if r.height == heights[-1]]) == 1
        for r in own:
            a, z = r.block * r.height, min(n, (r.block + 1) * r.height)
            assert r.pairs == z - a and r.changed == (rows[a + 1 : z + 1] != rows[a:z]).sum(axis=0).tolist()
        assert heights == [heights[0] << i for i in range(len(heights))]


def test_events_as_a_walk_over_bins():
    """The grouping by runs against the definition: step from bin to bin."""
    rnd = np.random.default_rng(5)
    for _ in range(400):
        n = int(rnd.integers(0, 25))
        index = np.cumsum(rnd.integers(1, 4, n))
        groups, shift = rnd.integers(1, 8, n), rnd.choice([-6.0, -4.0, -1.0, 0.0, 1.0, 4.0, 5.0], n)
        same = (groups * rnd.random(n)).astype(int) + 1
        floor, n_groups = 3.0, 4
        passes = [abs(shift[i]) >= floor and groups[i] >= 3 and same[i] / groups[i] >= 0.7 for i in range(n)]
        want, open_ = [], None  # places of the open event's first and last passing bin
        for i in range(n):
            if open_ and (np.sign(shift[i]) != np.sign(shift[open_[0]]) or index[i] - index[open_[1]] > 2):
                want.append(open_)
                open_ = None
            if passes[i]:
                open_ = (open_[0] if open_ else i, i)
        want += [open_] if open_ else []
        median = [np.median([s for s in shift[a : z + 1] if abs(s) >= floor]) for a, z in want]
        assert events_of(Bins(index, groups, shift, same, groups), n_groups, floor).tolist() == median


def test_kernels_run_once(spark):
    """No final plan has more Python nodes than it has kernels."""
    for name, most in (("emitted_periods", 0), ("tandem_validation", 2), ("irregularities", 2)):
        df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("MapInArrow") <= most, name


def test_costly_kernels_get_more_parts_as_files_grow(spark, tmp_path, monkeypatch):
    """Parts follow the bytes read, so a task's share doesn't; windows of one record are dealt to several tasks."""
    from repetend.operators import periodogram

    spark.range(20000).selectExpr("cast(id as string) record_id", "sha2(cast(id as string), 256) seq").write.parquet(str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x"))
    least = spark.sparkContext.defaultParallelism * periodogram.SPREAD_PARTS
    assert periodogram.spread(rows).rdd.getNumPartitions() == least
    assert periodogram.spread(spark.range(9).selectExpr("cast(id as string) record_id").persist()).rdd.getNumPartitions() == least
    monkeypatch.setattr(periodogram, "SPREAD_BYTES", 1 << 14)
    assert periodogram.spread(rows).rdd.getNumPartitions() > 2 * least
    one = spark.range(64).selectExpr("'a' record_id", "cast(id as int) first")
    filled = periodogram.spread(one, ("record_id", "first")).rdd.glom().map(len).collect()
    assert sum(n > 0 for n in filled) > 4


def test_alias_rounds_keep_no_more_than_the_rows(spark):
    """Twelve rounds of a chain beside many lone rows: what is kept in the shared folder follows the rows, not rows times rounds."""
    from pathlib import Path

    from repetend.operators.shared import checkpointed, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    chain = [("chain", 10 * i, 10 * i + 20, i + 1) for i in range(12)]
    lone = [(f"k{i}", 5, 25, 1) for i in range(4000)]
    rows = spark.createDataFrame(chain + lone, "k string, start long, end long, period long")
    before = size()
    checkpointed(rows.repartition(4))
    once = size() - before
    left = evaluate.resolve_aliases(rows, ["k"])
    kept = size() - before - once
    assert sorted(r.period for r in left.filter("k = 'chain'").collect()) == [1, 3, 5, 7, 9, 11] and left.count() == 4006
    assert kept < 3 * once


def test_irregularities_drop_no_words_and_no_bins(spark, tmp_path):
    """Words of filler are the hundred most frequent ones, and an array may have more than 50,000 bins."""
    from repetend.kernels import register

    rnd = random.Random(31)
    unit, filler = "".join(rnd.choice("ACGT") for _ in range(60)), "".join(rnd.choice("ACGT") for _ in range(211))
    text = unit * 30 + filler * 40
    assert register.analyze(text, 60.0).flag == "no_register_lock"
    assert register.analyze(text, 60.0, register.RegisterConfig(top_words=None)).flag == "ok"
    long = register.analyze("ACGTT" * 50_200, 5.0, register.RegisterConfig(k=2, min_groups=1))
    assert (long.flag, long.events) == ("ok", 0)
    # the query takes all words
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["irregularities"](spark, str(tmp_path)).collect()[0]
    seq = plans._controls(spark, str(tmp_path)).collect()[0].seq
    want = register.analyze(seq, got.period_p, register.RegisterConfig(top_words=None))
    assert (got.flag, got.n_pairs_total, got.dropout_event_count) == (want.flag, want.n_pairs, want.dropouts)
    assert want.n_pairs > register.analyze(seq, got.period_p).n_pairs
