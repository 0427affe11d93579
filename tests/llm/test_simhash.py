import random
import re
from collections import defaultdict

import xxhash

from repetend.llm import simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=3):
    """Least key reachable from each key by links of at most radius bits."""
    keys = sorted(fps)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_against_brute_force(spark, corpus):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randrange(20, 300))]
        for _ in range(rnd.randrange(1, 9)):
            own = list(base)
            for _ in range(rnd.randrange(3)):
                own[rnd.randrange(len(own))] = rnd.choice(words).upper()
            texts[len(texts) * 3 + g % 3] = "\n ".join(own)
    texts |= {900: "", 901: None, 902: "x", 903: "X", 904: "a b", 905: "A\tB"}
    rows = {r.doc_id: r for r in simhash.near_duplicates(corpus(list(texts.items()))).collect()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == fps and all(len(r.fingerprint) == 16 for r in rows.values())
    assert {i: r.component_id for i, r in rows.items()} == classes(fps)


def test_links_lose_nothing_and_chains_join(spark):
    rnd = random.Random(3)
    fps = {0}
    while len(fps) < 60:  # a chain, each a few bits from the one before
        last = list(fps)[-1]
        for b in rnd.sample(range(64), rnd.randrange(1, 5)):
            last ^= 1 << b
        fps.add(last)
    fps |= {rnd.getrandbits(64) for _ in range(40)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == want
    pairs = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (300, 200)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert {roots[i] for i in range(101)} == {0} and {roots[i] for i in (200, 201, 300)} == {200}


def test_odd_rows(odd, corpus):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    empty = [r for r in rows if r.doc_id in (1, 2, 3, 7)]
    assert {r.fingerprint for r in empty} == {"0" * 16} and {r.component_id for r in empty} == {1}
    assert [r.component_id for r in rows if r.doc_id == 4] == [4, 4]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd).collect()
    by = defaultdict(int)
    for r in kept:
        by[r.doc_id] += 1
    assert by == {1: 1, 4: 1, 5: 1, 6: 1, None: 1} and all(r.fp == "x" for r in kept)
    same = "one two three four five six"
    assert [r.doc_id for r in simhash.keep_one(corpus([(9, same), (7, same), (None, same)])).collect()] == [7]


def test_columns_of_clashing_names_stay(corpus):
    docs = corpus([(1, "a b c d"), (2, "A b c d"), (3, "x y z")])
    for name in ("kept_id", "kept_tie", "kept_tie_", "own_tie"):
        docs = docs.withColumn(name, simhash.F.lit("keepme"))
    rows = simhash.keep_one(docs).collect()
    assert {r.doc_id for r in rows} == {1, 3} and all(r.kept_tie_ == r.own_tie == r.kept_id == r.kept_tie == "keepme" for r in rows)


def test_probes_are_never_broadcast(spark):
    """Spark takes the size of 66 probes for that of one fingerprint, which would bring all of them to the driver."""
    distinct = spark.range(3000).selectExpr("xxhash64(id) fp").distinct()
    found = simhash.links(distinct)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    assert "BroadcastHashJoin" not in plan and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
