import zlib
from collections import Counter

import xxhash

from repetend.llm import sharding


def jump(key, n):
    b, j, key = -1, 0, key % (1 << 64)
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_slots_and_growth(corpus):
    ids = [*range(1500), -1, -(2**63), 2**63 - 1, 12345678901234567]
    rows = sharding.shard(corpus([(i, f"text {i % 40} é") for i in ids])).collect()
    assert len(rows) == len(ids)
    for r in rows:
        text = f"text {r.doc_id % 40} é".encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert (r["shard"], r.grown_shard) == (jump(r.doc_id, 24), jump(r.doc_id, 25))
        assert r.grown_shard in (r["shard"], 24)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.02 < sum(r.grown_shard == 24 for r in rows) / len(rows) < 0.06


def test_odd_rows(odd):
    rows = sharding.shard(odd).collect()
    assert len(rows) == 10
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 1} == {(8, 0)}
    assert all(r["shard"] == jump(0, 24) for r in rows if r.doc_id is None)
    assert len({(r["shard"], r.slot) for r in rows}) == 10
    assert max(Counter(r["shard"] for r in rows if r.doc_id == 4).values()) == 2
    assert sharding.shard(odd.limit(0)).count() == 0


def test_text_ids_and_many_texts_of_one_id(spark, corpus):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z"), ("a", "x"), ("10", None)], "doc_id string, text string")
    rows = sharding.shard(docs).collect()
    assert {r.doc_id: r.shard for r in rows} == {k: jump(0 if k is None else xxhash.xxh64_intdigest(k.encode(), 42), 24) for k in ("a", "b", None, "10")}
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    slots = {}
    for r in sharding.shard(corpus([(None, f"text {i}") for i in range(500)])).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert list(map(sorted, slots.values())) == [list(range(500))]
