import random
import re

import numpy as np

from repetend.kernels import motifs, symbols
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.operators import periodogram, verdicts
from repetend.plans import queries as plans

PLAIN = PeriodogramConfig(replicates=0)


def arrays(spark):
    rnd = np.random.default_rng(5)
    dna = lambda n: "".join(rnd.choice(list("ACGT"), n))
    unit, kin = dna(90), [dna(60) for _ in range(4)]
    rows = [("simple", unit * 40), ("high", "".join(kin) * 20), ("short", "ACGT"), ("noise", dna(3000)), ("empty", ""), ("null", None), (None, unit * 40)]
    return spark.createDataFrame([*rows, *[(f"n{i}", dna(200 + 37 * i) + dna(80) * (i % 7)) for i in range(60)]], "record_id string, seq string").repartition(3)


def test_verdicts_of_rows_of_peaks_and_of_peaks_are_the_same(spark):
    recs = arrays(spark)
    pgrams = periodogram.periodograms(recs, PLAIN).localCheckpoint()
    one, two = verdicts.judged(pgrams), verdicts.verdicts(periodogram.long_peaks(pgrams), recs)
    assert one.schema.simpleString() == two.schema.simpleString()
    found = sorted(map(repr, one.collect()))
    assert found == sorted(map(repr, two.collect())) and len(found) == 67
    assert {r.reason for r in one.filter("record_id is null").collect()} == {"no_clusters"}
    assert {r.verdict for r in one.collect()} == {"hor", "simple_tr", "unresolved"}


def test_peaks_of_a_record_are_not_shuffled_for_its_verdict(spark):
    """Peaks were rows that two windows and three aggregates dealt out and sorted."""
    pgrams = periodogram.periodograms(arrays(spark), PLAIN).localCheckpoint()
    plan = verdicts.judged(pgrams)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_peaks_of_no_records(spark):
    none = arrays(spark).limit(0)
    pgrams = periodogram.periodograms(none, PLAIN)
    assert verdicts.judged(pgrams).count() == 0 and verdicts.verdicts(periodogram.long_peaks(pgrams), none).count() == 0


def test_runs_of_motifs_are_those_of_a_pattern():
    rnd, n = random.Random(7), 0
    for _ in range(1500):
        text = "".join("".join(rnd.choice(rnd.choice(("acgt", "ac", "acgtn"))) for _ in range(rnd.randint(1, 6))) * rnd.randint(1, 8) for _ in range(rnd.randint(0, 9)))
        length, repeats = rnd.randint(1, 6), rnd.randint(1, 5)
        want = [(m.start(), (m.end() - m.start()) // length) for m in re.finditer(rf"([acgt]{{{length}}})\1{{{repeats - 1},}}", text)]
        assert motifs._runs(symbols.codes(text, "dna"), length, repeats) == want
        n += len(want)
    assert n > 1000


def test_counts_of_a_cohort_leave_python_summed(spark):
    recs = arrays(spark).coalesce(1).selectExpr("CASE WHEN record_id LIKE 'n%' THEN record_id < 'n4' END AS cohort", "seq")
    found = periodogram.pooled_counts(recs).collect()
    assert len({(r.cohort, r.of, r.at) for r in found}) == len(found)  # a slice has each distance of a cohort once
    single = periodogram.distance_histogram(recs.selectExpr("string(cohort) AS record_id", "seq")).groupBy("record_id", "d").sum("h").collect()
    assert sorted((str(r.cohort).lower(), r.at, r.n) for r in found if r.of == "d") == sorted((str(r[0]).lower(), r[1], r[2]) for r in single)
    lengths = recs.selectExpr("cohort", "coalesce(length(seq), 0) AS at").groupBy("cohort", "at").count().collect()
    assert {(r.cohort, r.at, r.n) for r in found if r.of == "length"} == {tuple(r) for r in lengths}


def test_plans_of_windows_run_the_periodogram_once_and_carry_no_sequences(spark):
    planned = plans._planned(spark, "/root/testdata/sf0.001")
    plan = planned._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "seq" not in planned.columns and "peaks" not in planned.columns
