import random

import pytest
from pyspark.sql import functions as F

from repetend.operators import evaluate
from repetend.operators.running import RANGE, ranged, running


@pytest.fixture(scope="module")
def rows(spark):
    """One key has most rows, some keys are null, and many rows are equal in the order."""
    rnd = random.Random(4)
    made = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randrange(300), i, rnd.randrange(-5, 6)) for i in range(5000)]
    return made, spark.createDataFrame(made, "k string, pos long, i long, x long").repartition(3)


@pytest.mark.parametrize("before", [False, True])
def test_running_against_loops(rows, before):
    made, df = rows
    dealt = ranged(df, ["k"], ["pos", "i"], parts=16)
    got = {(r.i): (r.s, r.m) for r in running(dealt, ["k"], ["pos", "i"], sums={"s": "x"}, maxima={"m": "x"}, before=before).collect()}
    seen, want = {}, {}
    for k, _, i, x in sorted(made, key=lambda r: (r[0] or "", r[1], r[2])):
        s, m = seen.get(k, (0, None))
        after = (s + x, x if m is None else max(m, x))
        want[i], seen[k] = (s, m) if before else after, after
    assert got == want


def test_a_hot_key_spreads(rows):
    _, df = rows
    sizes = [r["count"] for r in ranged(df, ["k"], ["pos", "i"], parts=16).filter("k = 'hot'").groupBy(RANGE).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 0.25 * sum(sizes)


def test_interval_tools_on_one_hot_key(spark):
    """Union, occupancy and lift against loops over places."""
    rnd = random.Random(2)
    spans = [("hot" if rnd.random() < 0.9 else "b", s, s + rnd.randrange(0, 12)) for s in (rnd.randrange(2000) for _ in range(600))]
    hosts = [(k, s, s + rnd.randrange(0, 400)) for k in ("hot", "b", "none") for s in (rnd.randrange(2000) for _ in range(40))] + [("hot", 5, 5), ("b", 0, 5000)]
    left, right = spark.createDataFrame(spans, "k string, start long, end long"), spark.createDataFrame(hosts + hosts[:5], "k string, h_start long, h_end long")
    covered = {(k, x) for k, s, e in spans for x in range(s, e)}
    got = {(r.k, r.h_start, r.h_end): (r.covered, r.share) for r in evaluate.occupancy(left, right, ["k"]).collect()}
    want = {(k, s, e): sum((k, x) in covered for x in range(s, e)) for k, s, e in hosts}
    assert got == {h: (n, n / (h[2] - h[1]) if h[2] > h[1] else None) for h, n in want.items()}

    joined = evaluate.union_intervals(left, ["k"])
    assert {(r.k, x) for r in joined.collect() for x in range(r.start, r.end)} == covered
    # touching spans are one
    assert joined.alias("x").join(joined.alias("y"), F.expr("x.k = y.k and x.end = y.start")).count() == 0

    indels = [("hot", rnd.randrange(2000), rnd.choice((-3, -1, 1, 4))) for _ in range(500)]
    moved = {(r.start, r.len): (r.new_start, r.new_len) for r in evaluate.lift(left.filter("k = 'hot'").select(F.col("k").alias("record_id"), "start", (F.col("end") - F.col("start")).alias("len")), spark.createDataFrame(indels, "record_id string, at long, delta long")).collect()}
    for k, s, e in spans:
        if k == "hot":
            assert moved[s, e - s] == (s + sum(d for _, at, d in indels if at < s), max(0, e - s + sum(d for _, at, d in indels if s <= at < e)))


@pytest.mark.parametrize("last_first", [False, True])
def test_equal_spans_are_of_one_run_in_any_order(spark, monkeypatch, last_first):
    """Of equal spans either may come first where rows are read again."""
    kept = evaluate.checkpointed
    monkeypatch.setattr(evaluate, "checkpointed", lambda df: kept(df.repartition(1).sortWithinPartitions(F.asc("new") if last_first else F.desc("new"))))
    spans = spark.createDataFrame([("a", 0, 5), ("a", 10, 20), ("a", 10, 20), ("a", 10, 20), ("a", 15, 22), ("a", 40, 41), ("a", 40, 41)], "k string, start long, end long")
    assert sorted(map(tuple, evaluate.union_intervals(spans, ["k"]).collect())) == [("a", 0, 5, 1), ("a", 10, 22, 4), ("a", 40, 41, 2)]
