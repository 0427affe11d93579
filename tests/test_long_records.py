import random

import numpy as np
import pytest

from repetend.kernels import periodogram as kernel
from repetend.kernels import symbols, xorshift
from repetend.kernels.periodogram import PeriodogramConfig
from repetend.operators import long_records, periodogram, sequences


@pytest.fixture(scope="module")
def recs(spark):
    rnd = random.Random(9)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    unit = dna(171)
    rows = [("array", "".join(unit if rnd.random() < 0.7 else dna(171) for _ in range(40))), ("noise", dna(5000)), ("unknown", dna(900) + "N" * 700 + dna(900)), ("same", "A" * 3000), ("gap", "ACGTAC" + "N" * 4000 + "ACGTAC"), ("exact", dna(512)), ("short", "ACGTA"), ("empty", ""), ("seven", "ACGTACG")]
    return sequences.records(spark.createDataFrame(rows, "record_id string, seq string").repartition(2)).persist()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [7, 100, 512, 1 << 20])
def test_histogram_of_chunks(recs, size):
    assert rows_of(long_records.distance_histogram(recs, 6, size)) == rows_of(periodogram.distance_histogram(recs, 6))


@pytest.mark.parametrize(("size", "stretch", "replicates"), [(100, 64, 0), (333, 1000, 3), (1 << 20, 1 << 16, 10)])
def test_peaks_of_chunks(recs, size, stretch, replicates):
    cfg = PeriodogramConfig(replicates=replicates)
    names = ["record_id", "array_length", "rank", "period", "peak_height", "score", "score2", "score2_norm", "background"]
    got = sorted(long_records.peaks(recs, cfg, size, stretch).select(names).collect())
    want = sorted(periodogram.long_peaks(periodogram.periodograms(recs, cfg)).select(names).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) > 5
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_chunks_are_rows_of_their_own(spark, recs):
    """A record is dealt out: no task has more than a few of its chunks."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = recs.filter("record_id = 'array'")
        cut = long_records.chunks(one, 6, 64)
        sizes = [len(p) for p in cut.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == len(range(0, 171 * 40 - 5, 64)) and max(sizes) < 0.6 * sum(sizes)
    assert max(len(r.piece) for r in cut.collect()) == 64 + 5


def test_no_least_distance(recs):
    with pytest.raises(ValueError):
        long_records.peaks(recs, PeriodogramConfig(least_distance=5))


def test_parts_of_a_run_and_of_a_sequence():
    seeds = np.array([1, 77, 1 << 63], np.uint64)
    whole = xorshift.runs(seeds, 3000)
    for start in (0, 1, 255, 256, 1999):
        assert (xorshift.runs(xorshift.skipped(seeds, start), 1000 - start % 7) == whole[:, start : start + 1000 - start % 7]).all()
    code = symbols.codes("ACGTACGTNNACGTAC")
    p = kernel.part(code, 4)
    assert dict(zip(p.distance.tolist(), p.count.tolist(), strict=True)) == {4: 1, 6: 1, 10: 2}
    assert p.first.tolist() == [0, 1, 2, 3] and p.last.tolist() == [10, 11, 12, 3]
    assert kernel.part(code[:3], 4).word.size == 0


def test_chunks_without_replicates_keep_nothing(spark, recs):
    """Partial histograms are made again rather than written, and a row holds a chunk's lists."""
    from pathlib import Path

    from repetend.operators.shared import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = sum(1 for _ in folder.rglob("part-*"))
    found = long_records.peaks(recs, PeriodogramConfig(replicates=0), 500, 500)
    assert found.count() > 5 and sum(1 for _ in folder.rglob("part-*")) == before
    parts = long_records.partial_histograms(recs.filter("record_id = 'array'"), PeriodogramConfig(replicates=0), 500)
    assert parts.count() == len(range(0, 171 * 40 - 5, 500))
