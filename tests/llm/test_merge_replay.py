import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from repetend.llm import merge_replay
from repetend.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return merge_replay.read_ranks()


def texts(rnd, n):
    pools = ["abc ", "aA1 .\n\t", "'srtdvmle ", "éßø中文字 ", "".join(map(chr, range(32, 127))), "😀‍ 　\x1c\x85́x", "ааб вг"]
    for _ in range(n):
        yield "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(80)))


def test_as_the_library(ranks):
    rnd = random.Random(2)
    rows = [*texts(rnd, 3000), "", " ", "a" * 5000, "ab" * 3000 + " " * 700, "<|endoftext|>", "1" * 999]
    encode, own = merge_replay.Encoder().encode, library(ranks)
    for at in range(0, len(rows), 100):
        assert [x.tolist() for x in encode(rows[at : at + 100])] == [own.encode_ordinary(x) for x in rows[at : at + 100]]


def test_ranks_in_any_order():
    """Ranks that no training gives: a merge may make a pair of smaller rank, and tokens no merge reaches."""
    rnd = random.Random(4)
    waited = odd = 0
    for _ in range(300):
        made = {bytes([b]) for b in range(256)}
        more = list({"".join(rnd.choice("ab") for _ in range(rnd.randrange(2, 6))).encode() for _ in range(rnd.randrange(1, 25))})
        rnd.shuffle(more)
        order = list(range(256, 256 + len(more)))
        rnd.shuffle(order)
        ranks = {b: i for i, b in enumerate(sorted(made))} | dict(zip(more, order, strict=True))
        vocabulary = merge_replay.Vocabulary(ranks)
        words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 40))) for _ in range(30)]
        own = library(ranks)
        raw = [w.encode() for w in words]
        ids, sizes = merge_replay.replay(raw, vocabulary)
        held = merge_replay._Words(raw, vocabulary)
        held.replay()
        odd += int(held.odd.sum())
        got = np.split(ids, np.cumsum(sizes)[:-1])
        for word, one, slow in zip(words, got, merge_replay.in_turn(raw, vocabulary), strict=True):
            if word.encode() not in ranks:
                assert one.tolist() == own.encode_ordinary(word) == slow
                waited += 1
    assert waited > 1000 and odd > 100


def test_a_table_that_is_emptied_gives_the_same(ranks, monkeypatch):
    rows, own = [*texts(random.Random(6), 300)], library(ranks)
    monkeypatch.setattr(merge_replay, "TABLE_BYTES", 0)
    encode = merge_replay.Encoder().encode
    for at in range(0, 300, 7):
        assert [x.tolist() for x in encode(rows[at : at + 7])] == [own.encode_ordinary(x) for x in rows[at : at + 7]]


def test_splits():
    """The spelt-out pattern against the module that knows Unicode's kinds, on all code points."""
    import regex

    want, split = regex.compile(public_tokenizers.PATTERN).findall, merge_replay.splitter(public_tokenizers.PATTERN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        text = f"a{c}{c}1 {c}'s{c} \n{c}"
        assert split(text) == want(text)
    upper = r"\p{Lu}+|[^\p{Lu}]+"
    assert merge_replay.splitter(upper)("abCDÉ1") == ["ab", "CDÉ", "1"]


def test_no_words():
    encode = merge_replay.Encoder().encode
    assert [x.tolist() for x in encode(["", ""])] == [[], []] and encode([]) == []
    ids, sizes = merge_replay.replay([], merge_replay.vocabulary())
    assert len(ids) == len(sizes) == 0


def digests(rows, own):
    out = []
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark, odd, ranks):
    got = sorted((tuple(r) for r in merge_replay.digests(odd).collect()), key=str)
    assert got == digests([(r.doc_id, r.text) for r in odd.collect()], library(ranks))
    assert merge_replay.digests(odd.limit(0)).count() == 0


def test_round_trip(spark, odd):
    back = merge_replay.decode(merge_replay.encode(odd))
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.bytes)) for r in back.collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in odd.collect())


def test_ids_that_are_no_tokens(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.bytes) for r in merge_replay.decode(rows).orderBy("doc_id").collect()] == [b"", b""]
    with pytest.raises(Exception, match="KeyError"):
        merge_replay.decode(rows.withColumn("ids", F.array(F.lit(60_000)))).collect()


def test_the_query(spark, ranks):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_merge_replay"](spark, SMALL).collect()), key=str)
    assert got == digests([(r.doc_id, r.text) for r in docs.collect()], library(ranks))
