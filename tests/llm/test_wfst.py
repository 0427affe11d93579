import random
import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from repetend.llm import wfst


@pytest.fixture(scope="module")
def both():
    return wfst.load(), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_equals_the_library(both):
    own, library = both
    rnd = random.Random(1)
    for letters in ("abcdeeettt  ▁\n.,'1230éß中文😀́\t-_ABC", "aab ", "thein r", "\n\r\t  "):
        for _ in range(1500):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(50)))
            assert own.encode(text) == library.encode(text), text
    for text in ("x" * 3000, " " * 50, "the" * 1000, "Internationalization " * 20):
        assert own.encode(text) == library.encode(text)


def test_round_trip(both):
    own, _ = both
    for text in ("", " ", "  a  b ", "Grüße\tan\n\nalle 😀", "x"):
        assert own.decode(own.encode(text)) == text


def field(number, kind, body):
    head = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    return head + (bytes([len(body)]) + body if kind == 2 else body)


def test_unigram_takes_the_path_of_least_weight():
    pieces = [("<unk>", 0.0, 2), ("▁", -4.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -5.0, 1), ("▁a", -4.5, 1), ("bb", -4.0, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    own = wfst.Transducer(model + field(2, 2, field(3, 0, b"\x01")))
    said = lambda text: [own.pieces[i][0] for i in own.encode(text)]
    assert said("abb") == ["▁a", "bb"] and said("ab") == ["▁a", "b"] and said("z") == ["▁", "<unk>"]


def test_query_columns(both, odd):
    own, library = both
    rows = wfst.digests(odd).collect()
    want = sorted((str(r.doc_id), len(library.encode(r.text or "")), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for r in odd.collect() for i in [library.encode(r.text or "")])
    assert sorted((str(r.doc_id), r.n_ids, r.ids_crc32) for r in rows) == want and all(r.round_trip for r in rows)
    encoded = wfst.encode(odd)
    assert encoded.filter("ids is null").count() == 2
    assert sorted((str(r.doc_id), r.text or "") for r in wfst.decode(encoded).collect()) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert wfst.digests(odd.limit(0)).count() == 0


def test_equals_the_library_on_documents(both):
    own, library = both
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    assert [own.encode(x) for x in texts] == library.encode(texts)


def test_normaliser():
    drop, keep = wfst.Normaliser(True, True), wfst.Normaliser(True, False)
    for text in ("", " ", "a", "  a  b ", "a b", "\ta  \n b   c", "▁ a"):
        squeezed = " ".join(x for x in text.split(" ") if x)
        assert drop.compose(text) == ("▁" + squeezed.replace(" ", "▁") if squeezed else "")
        assert keep.compose(text) == ("▁" + text.replace(" ", "▁") if text else "")
    assert wfst.Normaliser(False, True).compose(" a  b ") == "a▁b" and wfst.Normaliser(False, False).compose(" a ") == "▁a▁"


def test_unigram_path_against_every_path():
    rnd = random.Random(4)
    names = ["a", "b", "▁", "ab", "ba", "aab", "bb", "▁a", "▁ab", "abab"]
    pieces = [("<unk>", 0.0, 2), *[(x, -rnd.uniform(0.5, 6), 1) for x in names]]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    own = wfst.Transducer(model + field(2, 2, field(3, 0, b"\x01")))
    scores = {p: s for p, s, _ in own.pieces[1:]}

    def best(text):
        return max((scores[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores), default=0.0 if not text else -1e9)

    for _ in range(200):
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 12)))
        normal = own.normaliser.compose(text)
        found = [own.pieces[i][0] for i in own.encode(text)]
        assert "".join(found) == normal and abs(sum(scores[x] for x in found) - best(normal)) < 1e-6
