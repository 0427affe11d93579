import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from repetend.llm import langid

#: Common words of four languages.
WORDS = {
    "en": "the and that with have this from they which would there their what about when make like time just know people into year good some could them other than then".split(),
    "de": "der und die das nicht sein haben werden mit auch sich für über können schon wenn müssen zwischen größer straße mädchen natürlich weiß noch durch".split(),
    "fr": "le les des une est pas que dans pour avec être avoir sur plus mais comme où même après très français garçon déjà élève nous vous leur".split(),
    "es": "el los las una que por con para como más pero sus este entre también años cuando señor niño corazón después porque donde está hasta".split(),
}


@pytest.fixture(scope="module")
def spoken(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        lang = rnd.choice(list(WORDS))
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(6, 60))), lang, "extra"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)


def test_held_out_accuracy(spoken):
    rows = {r.doc_id: r for r in langid.languages(spoken).collect()}
    truth = {r.doc_id: r.lang for r in spoken.collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [i for i, r in rows.items() if r.held_out]
    assert len(out) > 60 and sum(rows[i].lang_pred == truth[i] for i in out) / len(out) > 0.97


def test_held_out_rows_never_train(spoken):
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    changed = spoken.withColumn("lang", F.when(fold == 2, "zz").otherwise(F.col("lang")))
    names, vectors = langid.prototypes(langid.training_rows(changed))
    again, same = langid.prototypes(langid.training_rows(spoken.repartition(5)))
    assert names == again == sorted(WORDS) and np.array_equal(vectors, same)


def slow_letters(text):
    """Folded letters, 0 for each run of other characters and for both ends."""
    parts = "".join(c.lower()[0] if unicodedata.category(c)[0] == "L" else " " for c in text).split()
    return [0, *[x for part in parts for x in [*map(ord, part), 0]]]


def slow_vector(text, dimensions=langid.DIMENSIONS):
    """Sum of bound vectors, a place and a trigram at a time."""

    def bit(point, place):
        x = (point * (dimensions // 64) + place // 64 + langid.SEED) * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return 1 if (x ^ x >> 31) >> place % 64 & 1 else -1

    found = slow_letters(text)
    own = {p: [bit(p, d) for d in range(dimensions)] for p in set(found)}
    threes = list(zip(found, found[1:], found[2:]))
    return np.array([sum(own[a][d - 2] * own[b][d - 1] * own[c][d] for a, b, c in threes) for d in range(dimensions)], float)


def test_bundle_is_the_sum_of_bound_vectors():
    text = "Où est-ce? 中a Ωμέγα 𐐀𐐩 \u0130x"
    assert np.array_equal(langid.bundle(*np.unique(langid.letter_trigrams(text), return_counts=True)), slow_vector(text))
    for grams in (langid.trigrams, langid.letter_trigrams):
        assert len(grams("")) == len(grams("123 !")) == 0 and len(grams("a")) == 1


def test_predictions_and_scores_against_the_definition(spark):
    rows = [(i, " ".join((WORDS[lang] * 2)[i : i + 6]) + "!", lang) for i in range(10) for lang in ("en", "de")]
    rows += [(40 + i, t, lang) for i, (t, lang) in enumerate((("αβγ δεζ ηθι", "el"), ("абв где жзи", "ru"), ("ηθι αβγ", None), ("где абв", None), ("", None), ("42", "en")))]
    found = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    sums = {}
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + slow_vector(text)
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    want = {}
    for _, text, _ in rows:
        own = {lang: float(unit(v) @ unit(slow_vector(text))) for lang, v in sums.items()}
        best = max(sorted(own), key=lambda x: round(own[x], 9))
        want[text] = (best, max(0.0, own[best])) if len(slow_letters(text)) > 1 else ("und", 0.0)
    texts = Counter((i, text) for i, text, _ in rows)
    assert len(found) == len(rows) and sum(texts.values()) == len(rows)
    by = {}
    for i, text, _ in rows:
        by.setdefault(i, set()).add((want[text][0], round(want[text][1], 6)))
    assert all((r.lang_pred, round(r.score, 6)) in by[r.doc_id] for r in found)
    assert sorted((r.doc_id, r.lang_pred) for r in found) == sorted((i, want[text][0]) for i, text, _ in rows)


def test_scripts_do_not_collide(spark):
    """Letters 37 code points apart are of one class, but have vectors of their own."""
    far = "".join(chr(ord(c) + 37 * 4) for c in "αβγδεζηθικλμ")
    rows = [(i, x, lang) for i in range(40) for x, lang in (("αβγ δεζ ηθι κλμ", "el"), (" ".join(far[k : k + 3] for k in (0, 3, 6, 9)), "zz"))]
    assert np.array_equal(langid.trigrams(rows[0][1]), langid.trigrams(rows[1][1]))
    found = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert Counter(r.lang_pred for r in found.collect()) == {"el": 40, "zz": 40}


def test_odd_rows(odd, spark):
    rows = langid.languages(odd).collect()
    assert len(rows) == 10
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3, 7)} == {("und", 0.0)}
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6)} == {"en"}
    blank = spark.createDataFrame([(1, "no language here", None)], "doc_id long, text string, lang string")
    assert langid.languages(blank).first().lang_pred == "und"
    assert langid.languages(odd.limit(0)).count() == 0
    kept = langid.reject(odd)
    # the long text is held out and shares hardly a trigram with the rest
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "6", "None"] and kept.columns == odd.columns


def test_unlearnt_languages_and_noise_go_and_short_texts_stay(spark):
    rnd = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    foreign = {
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri.",
    }
    noise = list(foreign.values()) + [" ".join("".join(rnd.choices(letters, k=rnd.randrange(3, 10))) for _ in range(n)) for n in [200] * 100 + [20] * 100]
    noise += [f"{rnd.getrandbits(3200):0800x}" for _ in range(20)]
    short = ["Avec.", "All rights reserved.", "und", "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience."]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    more = [(10**9 + i, t, None) for i, t in enumerate(noise + short)]
    kept = langid.reject(docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string")))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {i for i in ids if i >= 10**9} == {10**9 + len(noise) + i for i in range(len(short))}
    assert ids >= {r.doc_id for r in docs.select("doc_id", "text").collect() if len(langid.trigrams(r.text or ""))}


def test_letters_of_one_class_have_gains_of_their_own(spark):
    far = "".join(chr(ord(c) + 37 * 4) for c in "αβγδεζηθικλμ")
    text = "αβγ δεζ ηθι κλμ"
    other = " ".join(far[k : k + 3] for k in (0, 3, 6, 9))
    rows = [(i, text, "el") for i in range(40)] + [(100, other, None), (101, text + " " + text, None)]
    assert np.array_equal(langid.trigrams(text), langid.trigrams(other))
    kept = langid.reject(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.doc_id for r in kept.collect()} == {*range(40), 101}


def test_trigrams_beyond_the_table_are_looked_up(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**9, None, None), (10**9 + 1, "", "en"), (10**9 + 2, "Ωμέγα 中文", None), (None, "Avec.", None), (None, "Avec.", None)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rare = [(2 * 10**9 + i, " ".join(WORDS["de"][i % 5 :])[: 12 + i], None) for i in range(40)]
    docs = docs.union(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    want = Counter(langid.reject(docs).collect())
    for most in (0, 40, 400):
        monkeypatch.setattr(langid, "TABLE_GRAMS", most)
        assert Counter(langid.reject(docs).collect()) == want
    assert 1000 <= sum(want.values()) < docs.count()
