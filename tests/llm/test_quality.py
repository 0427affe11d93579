import math
import random
import re

import xxhash

from repetend.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(word):
    """Spark's xxhash64 of a string."""
    return signed(xxhash.xxh64_intdigest(word.encode(), 42))


def base(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    w = [hashed(x.lower()) for x in WORD.findall(text or "")]
    return [x % buckets for x in w] + [(a ^ b >> 20) % buckets for a, b in zip(w, w[1:], strict=False)]


def test_against_brute_force(spark, corpus):
    good = "the cat sat on the mat and the dog ran to the old barn by the wide river while the sun went down over the hills " * 3
    texts = {i: f"{good} extra{i} words{i}" for i in range(8)} | {8: "### *** " * 40, 9: "a b c " * 30, 10: "x| " * 60, 11: "one two\none two\nthree", 12: None, 13: " ".join(f"{c}{c} |" for c in "qwertyuiop" * 4)}
    docs, labels = corpus(list(texts.items())), spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(8, 0, 0), (9, 1, 1), (10, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    buckets, threshold = 512, -100_000
    rows = {r.doc_id: r for r in quality.quality(docs, labels, buckets=buckets, threshold=threshold).collect()}
    raw, target = [0] * buckets, [0] * buckets
    for i, t in texts.items():
        for b in grams(t, buckets):
            raw[b] += 1
            target[b] += i < 6
    weight = [round(1e6 * (math.log((t + 1) / (sum(target) + buckets)) - math.log((r + 1) / (sum(raw) + buckets)))) for t, r in zip(target, raw, strict=True)]
    for i, t in texts.items():
        r, own = rows[i], grams(t, buckets)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        total = sum(weight[b] for b in own)
        assert r.base_failed == failed
        assert r.kept == (not failed and bool(own) and total >= threshold * len(own))
        assert (r.llr is None) == (not own)
        if own:
            assert abs(r.llr - total / len(own) / 1e6) < 1e-5


def test_repeated_words_both_ways(corpus):
    rnd = random.Random(31)
    texts = {i: " ".join(rnd.choice("abcdefgh"[: 2 + i % 7]) for _ in range(rnd.randrange(200))) for i in range(120)}
    rows = quality.base_features(corpus(list(texts.items()))).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: base(t)[4] for i, t in texts.items()}


def test_odd_rows_and_no_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() == 10
    for r in rows:
        assert r.llr in (None, 0.0)
    long = next(r for r in rows if r.doc_id == 5)
    assert long.n_words == 30_000 and long.n_repeat_words == 30_000 and not long.kept
    assert quality.quality(odd.limit(0), labels).count() == 0


def test_buckets_follow_the_trained_ngrams(spark, corpus):
    trusted = corpus([(i, "w " * 10_000) for i in range(40)])
    assert quality.bucket_count(trusted) == 1 << 15 and quality.bucket_count(trusted.limit(0)) == quality.LEAST_BUCKETS


def test_junk_does_not_hide_in_buckets_of_prose(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in rows.filter("quality = 0 or (quality = 1 and coalesce(toxic, 0) = 0)").groupBy("quality", "kept").count().collect()}
    assert n[1, True] > 2000 and not n.get((1, False)) and n[0, False] > 200 and n.get((0, True), 0) <= 2, n
