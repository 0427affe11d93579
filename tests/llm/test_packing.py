import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from repetend.llm import packing


def check(rows, size):
    """Sequences without gaps or overlaps; their lengths."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return [sum(n for _, n in p) for p in by.values()]


def test_ids_pieces_and_places(odd):
    rows = packing.pack(odd).collect()
    check(rows, packing.SIZE)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in odd.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), packing.SIZE):
            part = ids[s : s + packing.SIZE]
            expected[r.doc_id, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    assert packing.pack(odd.limit(0)).count() == 0


def test_fast_ids_equal_the_library():
    encode, exact = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x250)] + list("  \n\t'sreal aaab123ŁŒ")
    for _ in range(400):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        assert encode([text])[0] == exact.encode(text, add_special_tokens=False).ids


def test_fast_ids_equal_the_library_on_documents():
    encode, exact = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    assert encode(texts) == [x.ids for x in exact.encode_batch(texts, add_special_tokens=False)]


def test_plan_places_every_piece():
    rnd = random.Random(2)
    for size, tiers in ((8, (2, 4)), (64, (5, 16, 40)), (2048, packing.TIERS), (2048, ())):
        counts = Counter(rnd.randrange(1, size + 1) for _ in range(3000))
        sequences = packing.plan(counts, size, tiers)
        placed = Counter()
        for n, tier, lengths in sequences:
            for length in lengths:
                placed[length] += n
            # the opener is routed to this tier, and no piece is too long for it
            assert max(lengths) <= tier and not any(lengths[0] <= t < tier for t in tiers)
        assert placed == counts
        fills = [sum(w) for n, _, w in sequences for _ in range(n)]
        assert max(fills) <= size and sum(fills) > 0.97 * size * len(fills)
        assert sequences == sorted(sequences, key=lambda x: (-x[1], -sum(x[2]), x[2]))
    assert packing.plan({}) == []


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    placed = packing.plan({1500: 2, 1000: 4, 500: 3, 30: 10}, 2048, (1024,))
    assert placed[0] == (2, 2048, [1500, 500, 30]) and {t for _, t, _ in placed[1:]} == {1024}


def test_places_depend_on_the_tiers(corpus):
    rnd = random.Random(8)
    counts = Counter(int(2 ** rnd.uniform(0, 11)) for _ in range(5000))
    by = {tiers: packing.slots(packing.plan(counts, 2048, tiers)) for tiers in (packing.TIERS, (7,), (600,))}
    assert len({str([x[:5] for x in found]) for found in by.values()}) == 3
    docs = corpus([(i, "a b c d " * rnd.randrange(1, 300)) for i in range(60)])
    place = lambda tiers: sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in packing.pack(docs, tiers=tiers).collect())
    assert place(packing.TIERS) != place((7,))


def test_rows_of_a_plan_grow_with_the_logarithm_of_the_counts():
    rnd = random.Random(1)
    rows = []
    for scale in (10**3, 10**6, 10**9, 10**12):
        rows.append(len(packing.slots(packing.plan({n: rnd.randrange(scale) // (1 + n // 50) for n in range(1, 2049)}))))
    assert rows[3] < 150_000 and rows[3] < 3 * rows[1]


def test_step_groups_are_balanced(corpus):
    rows = packing.pack(corpus([(i, "a b c d " * (i % 700)) for i in range(600)]), group_sequences=32).collect()
    check(rows, packing.SIZE)
    tokens = Counter()
    for r in rows:
        tokens[r.step_group] += r.length
    assert max(tokens.values()) - min(tokens.values()) <= 2 * packing.SIZE
    assert {r.tier for r in rows} <= set(packing.TIERS) and all(r.length <= r.tier <= r.sequence_tier for r in rows)
    for tier in packing.TIERS:
        of = [len({r.sequence_id for r in rows if r.sequence_tier == tier and r.step_group == g}) for g in tokens]
        assert max(of) - min(of) <= 1


def test_parts_of_a_length_follow_its_count(corpus, monkeypatch):
    cut = packing.reliable(packing.pieces(corpus([(i, "a b c d " * (1500 if i % 2 else 1 + i % 5)) for i in range(300)])))
    kept = []
    monkeypatch.setattr(packing, "reliable", lambda df: kept.append(df.checkpoint()) or kept[-1])
    rows = packing.place(cut, salts=2, part_pieces=20).collect()
    check(rows, packing.SIZE)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, rows)) == sorted(map(key, cut.collect()))
    whole = [r for r in kept[1].collect() if r.length == packing.SIZE]
    n = sum(r.n for r in whole)
    assert n >= 300 and n // 20 - 3 <= len(whole) <= n // 20 + 1 and max(r.n for r in whole) < 60
