"""Language identification with hyperdimensional profiles.

Every letter, case folded, and white space (any run of other characters) has a random vector of +1 and -1, hashed from its
code point and a seed, so executors make them alike and letters of any script have their own. A trigram's vector binds its
letters' vectors, rotated once for each place to the right end, by multiplying them; a text's vector bundles (adds) its
trigrams' vectors. A language's prototype bundles all its training texts. A text gets the language whose prototype has the
greatest cosine with its vector.

Training bundles every training document where it is, as bundling is linear: a task gives DIMENSIONS numbers a language,
and as many come to the driver, whatever the corpus holds. reject() needs counts of trigrams of folded letters, all as
they are. Every task has the gains of the most frequent ones, TABLE_GRAMS at most. Where more are learnt, a text whose other
trigrams could decide has these looked up by a join with all counts.

reject() decides on the gain, not on the cosine: the mean over a text's trigrams of the log of their chance in a language
over the even chance of 1 / SYMBOLS ** 3, from the same counts. A cosine falls with a text's length as with its being foreign, so
no least cosine tells a short text from noise. Texts of the learnt languages gain about 6, prose unlike the training
texts about 3, unlearnt languages and letter noise less than 2, mostly below 1; relatives of a learnt one come nearest
(Dutch beside German 2.0 to 2.3). The mean of few trigrams varies more, so short texts need less.

Defined results: a text that is null or has no letter is `und` with score 0. Equal cosines go to the first language in
order of name. Without training rows every text is `und`. A null doc_id is taken as no id: such rows are not held out
and do train. Rows stand on their own; columns besides doc_id, text and lang are ignored. Texts are read whole.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import SLICE_ROWS, map_slices, release, reliable, row_id_columns

DIMENSIONS, SEED, SYMBOLS = 512, 20_231, 64
FOLDS, HELD = 4, 2
UNKNOWN = "und"
#: Least gain of a text of many trigrams, and how much less one of n trigrams needs, times sqrt(n); see reject().
LEAST_GAIN, SHORT = 2.75, 4.5
#: Share of the even chance of all trigrams in a language's chances.
EVEN = 0.1
#: Trigrams whose gains every task has.
TABLE_GRAMS = SYMBOLS**3
#: White space and the letters a to z, whose trigrams are counted in arrays; and other trigrams that a task holds at a time.
PLAIN, HELD_GRAMS = 27, 1 << 20
#: Trigrams bundled at a time.
BLOCK = 4096
#: Bits of a code point.
POINT = 21


def _fold(c: str) -> int:
    return ord(c.lower()[0]) if unicodedata.category(c)[0] == "L" else 0


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Code point of each letter below 65,536, case folded: 0 for what is no letter."""
    return np.array([_fold(chr(code)) for code in range(1 << 16)], np.int64)


def letters(text: str) -> np.ndarray:
    """Folded letters with one 0 at each end and for what stands between words."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = fold_table()
    found = table[np.minimum(codes, len(table) - 1)]
    high = codes >= len(table)
    if high.any():
        found[high] = [_fold(chr(c)) for c in codes[high]]
    found = np.concatenate(([0], found, [0]))
    return found[np.concatenate(([True], (found[1:] != 0) | (found[:-1] != 0)))]


def _threes(found: np.ndarray, base: int) -> np.ndarray:
    if len(found) < 3:
        return np.empty(0, found.dtype)
    return (found[:-2] * base + found[1:-1]) * base + found[2:]


def trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of classes (white space, a to z, 37 of other letters); none if the text has no letter."""
    found = letters(text)
    latin = (found >= ord("a")) & (found <= ord("z"))
    return _threes(np.where(latin, found - 96, np.where(found > 0, 27 + found % 37, 0)).astype(np.int32), SYMBOLS)


def letter_trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of letters, POINT bits each; none if the text has no letter."""
    return _threes(letters(text), 1 << POINT)


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A row of +1 and -1 for each code point: bits of mixed counters, 64 places each, the low bit first."""
    words = -(-dimensions // 64)
    x = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))).astype("<u8")
    bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def bundle(grams: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """Sum of the vectors of trigrams of letters, each as often as counted."""
    mask = (1 << POINT) - 1
    points, at = np.unique(np.concatenate((grams >> 2 * POINT, grams >> POINT & mask, grams & mask)), return_inverse=True)
    i, j, k = at.reshape(3, -1)
    base = letter_vectors(points, dimensions, seed)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    # whole numbers below 2 ** 24 add up exactly in any order
    kind = np.float32 if counts.sum() < 1 << 24 else np.float64
    total = np.zeros(dimensions, np.float64)
    for start in range(0, len(grams), BLOCK):
        now = slice(start, start + BLOCK)
        bound = first[i[now]] * second[j[now]] * base[k[now]]
        total += counts[now].astype(kind) @ bound.astype(kind)
    return total


def split_trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of white space and a to z, as places in plain_grams(), and the codes of all others."""
    found = letters(text)
    low = np.where(found > 0, found - 96, 0)
    own = low < PLAIN
    plain = own[:-2] & own[1:-1] & own[2:]
    return _threes(low, PLAIN)[plain], _threes(found, 1 << POINT)[~plain]


@lru_cache(1)
def plain_grams() -> np.ndarray:
    """Codes of all trigrams of white space and a to z."""
    low = np.arange(PLAIN, dtype=np.int64)
    point = np.where(low > 0, low + 96, 0)
    return (((point[:, None, None] << POINT) + point[:, None] << POINT) + point).ravel()


def count_trigrams(training: DataFrame) -> DataFrame:
    """lang, gram (code of its letters), n over every row of training (columns text and lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        others: dict[str, list[np.ndarray]] = {}

        def rows() -> pa.RecordBatch:
            parts = [(lang, plain_grams()[at], n[at]) for lang, n in sums.items() for at in [np.flatnonzero(n)]]
            parts += [(lang, *np.unique(np.concatenate(found), return_counts=True)) for lang, found in others.items()]
            names = pa.array([lang for lang, _, _ in parts], pa.string())
            return pa.RecordBatch.from_pydict(
                {
                    "lang": names.take(pa.array(np.repeat(np.arange(len(parts)), [len(at) for _, at, _ in parts]))),
                    "gram": pa.array(np.concatenate([at for _, at, _ in parts])),
                    "n": pa.array(np.concatenate([n for _, _, n in parts]).astype(np.int64)),
                }
            )

        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(split_trigrams(text))
                for lang, grams in by.items():
                    if lang not in sums and len(sums) >= 64 or held >= HELD_GRAMS:  # what is counted so far goes out; memory stays bounded
                        yield rows()
                        sums.clear()
                        others.clear()
                        held = 0
                    n = np.bincount(np.concatenate([x for x, _ in grams]), minlength=PLAIN**3)
                    sums[lang] = sums[lang] + n if lang in sums else n
                    others.setdefault(lang, []).extend(x for _, x in grams if len(x))
                    held += sum(len(x) for _, x in grams)
                others = {lang: found for lang, found in others.items() if found}
        if sums:
            yield rows()

    counted = training.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sum_vectors(training: DataFrame, dimensions: int, seed: int) -> DataFrame:
    """lang, place, value: sums of the vectors of all training texts, bundled where the texts are; whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            value = np.concatenate(list(sums.values()))
            return pa.RecordBatch.from_pydict({"lang": pa.array([x for x in sums for _ in range(dimensions)], pa.string()), "place": pa.array(list(range(dimensions)) * len(sums), pa.int32()), "value": value})

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                by: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(letter_trigrams(text))
                for lang, grams in by.items():
                    if lang not in sums and len(sums) >= 1024:  # what is summed so far goes out; memory stays bounded
                        yield rows()
                        sums.clear()
                    value = bundle(*np.unique(np.concatenate(grams), return_counts=True), dimensions, seed)
                    sums[lang] = sums[lang] + value if lang in sums else value
        if sums:
            yield rows()

    parts = training.select("text", "lang").mapInArrow(run, "lang string, place int, value double")
    return parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))


def prototypes(training: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their unit vectors."""
    rows = sum_vectors(training, dimensions, seed).toPandas()  # as many rows a language as there are dimensions
    names = sorted(rows["lang"].unique())
    vectors = np.zeros((len(names), dimensions))
    for i, name in enumerate(names):
        own = rows[rows["lang"] == name]
        vectors[i, own["place"].to_numpy()] = own["value"].to_numpy()
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return names, vectors / np.where(norms > 0, norms, 1)


@dataclass(frozen=True)
class Learnt:
    """Gains of the most frequent trigrams in each language, and how many trigrams each language has."""

    names: list[str]
    totals: np.ndarray
    grams: np.ndarray
    #: A row a language, a column a trigram of grams, and one more for those that no language has.
    table: np.ndarray
    #: Most copies that a trigram beyond grams has; 0 where there is none.
    beyond: int

    def places(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function from the trigrams that split_trigrams() gives to their columns."""
        own = _columns(self.grams, plain_grams())
        return lambda plain, others: np.concatenate((own[plain], _columns(self.grams, others)))


def _columns(grams: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(grams, wanted)
    return np.where(np.append(grams, -1)[at] == wanted, at, len(grams))


def gain(share: np.ndarray) -> np.ndarray:
    """Gain of a trigram with this share of a language's trigrams."""
    return np.log((1 - EVEN) * share * SYMBOLS**3 + EVEN)


def gains_table(at: np.ndarray, lang: np.ndarray, n: np.ndarray, grams: int, totals: np.ndarray) -> np.ndarray:
    """Gain of each trigram (a column) in each language (a row) from the counts of both; the last column's trigram is in none."""
    table = np.full((len(totals), grams + 1), np.log(EVEN), np.float32)
    table[lang, at] = gain(n / totals[lang])
    return table


def learn(counted: DataFrame, most: int) -> Learnt:
    """Gains of the most frequent trigrams, at most so many; counted is count_trigrams(), kept."""
    sums = sorted((r["lang"], r["n"]) for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    names, totals = [x for x, _ in sums], np.array([n for _, n in sums], np.float64)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) if names else F.lit(0)
    each = counted.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct((place - 1).cast("int").alias("lang"), "n")).alias("own"))
    if each.count() > most:
        each = each.orderBy(F.desc("all"), "gram").limit(most + 1)  # the last one bounds all others
    first = each.select("gram", "all", F.inline("own")).toArrow()
    gram, all_, lang, n = (first.column(c).to_numpy() for c in ("gram", "all", "lang", "n"))
    grams = np.unique(gram)
    beyond = 0
    if len(grams) > most:
        beyond, last = int(all_.min()), gram[np.lexsort((-gram, all_))[0]]
        gram, lang, n, grams = gram[gram != last], lang[gram != last], n[gram != last], grams[grams != last]
    return Learnt(names, totals, grams, gains_table(np.searchsorted(grams, gram), lang, n, len(grams), totals), beyond)


def known(grams: np.ndarray, table: np.ndarray) -> bool:
    """Whether a text of these trigrams (columns of the table) is in a language of the table."""
    if not len(grams) or not len(table):
        return False
    return bool(max(row[grams].mean(dtype=np.float64) for row in table) >= least_gain(len(grams)))


def least_gain(n: int) -> float:
    """Mean gain that a text of n trigrams needs."""
    return LEAST_GAIN - SHORT / np.sqrt(n)


def held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def identify(docs: DataFrame, names: list[str], vectors: np.ndarray, *, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 where negative) of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        def one(text: str | None) -> tuple[str, float]:
            grams = letter_trigrams(text or "")
            if not len(grams) or not len(names):
                return UNKNOWN, 0.0
            vector = bundle(*np.unique(grams, return_counts=True), dimensions, seed)
            cosines = vectors @ vector / (np.linalg.norm(vector) or 1)
            best = int(np.argmax(np.round(cosines, 9)))
            return names[best], float(min(1.0, max(0.0, cosines[best])))

        def run(batch: pa.RecordBatch) -> dict:
            found = [one(x) for x in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            return {"doc_id": ids, "held_out": [held_out(x) for x in ids.to_pylist()], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return run

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """text and lang of the rows that may train: labelled and not held out."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(fold != HELD, F.lit(True))).select("text", "lang")


def languages(docs: DataFrame, *, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Learn from the rows that may train and identify every row."""
    return identify(docs, *prototypes(training_rows(docs), dimensions, seed), dimensions=dimensions, seed=seed)


def _looked_up(docs: DataFrame, counted: DataFrame, learnt: Learnt, key: str) -> DataFrame:
    """Keys of the texts that the table leaves open and that gain enough with the counts of all their trigrams."""
    kernel_schema = "key string, size long, sums array<double>, gram array<long>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = learnt.places(), learnt.table.astype(np.float64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                out: dict[str, list] = {"key": [], "size": [], "sums": [], "gram": [], "times": []}
                part = batch.slice(start, SLICE_ROWS)
                for name, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    plain, others = split_trigrams(text or "")
                    at = places(plain, others)
                    beyond, times = np.unique(np.concatenate((plain_grams()[plain], others))[at == len(learnt.grams)], return_counts=True)
                    for column, value in zip(out.values(), (name, len(at), table[:, at].sum(axis=1), beyond, times), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.string()), pa.array(out["size"], pa.int64()), pa.array(out["sums"], pa.list_(pa.float64())), *[pa.array(out[c], pa.list_(pa.int64())) for c in ("gram", "times")]], names=list(out))

    made = docs.select(F.col(key).alias("key"), "text").dropDuplicates(["key"]).mapInArrow(run, kernel_schema)
    each = made.select("key", "size", "sums", F.inline(F.arrays_zip("gram", "times")))
    totals = F.array(*map(F.lit, learnt.totals.tolist()))
    place = F.array_position(F.array(*map(F.lit, learnt.names)), F.col("lang")).cast("int")
    more = F.log((1 - EVEN) * F.col("n") / F.element_at(totals, F.col("place")) * SYMBOLS**3 + EVEN) - F.log(F.lit(EVEN))
    met = each.join(counted.withColumn("place", place).hint("merge"), "gram").withColumn("more", more * F.col("times"))
    gained = met.groupBy("key", "place").agg(F.first("size").alias("size"), F.first("sums").alias("sums"), F.sum("more").alias("more"))
    mean = (F.element_at("sums", F.col("place")) + F.col("more")) / F.col("size")
    return gained.filter(mean >= LEAST_GAIN - SHORT / F.sqrt("size")).select("key").distinct()


def reject(docs: DataFrame) -> DataFrame:
    """Rows of docs that gain enough in a learnt language for their length; all columns stay as they are."""
    counted = reliable(count_trigrams(training_rows(docs)))
    learnt = learn(counted, TABLE_GRAMS)
    (state,) = row_id_columns(docs, ["state"])
    schema = T.StructType([*docs.schema, T.StructField(state, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = learnt.places(), learnt.table
        most = table.copy()
        if learnt.beyond:  # what a trigram beyond the table may gain
            most[:, -1] = gain(np.minimum(learnt.beyond / learnt.totals, 1)) + 1e-6
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = [places(*split_trigrams(text or "")) for text in part.column("text").to_pylist()]
                keep = [True if known(x, table) else None if learnt.beyond and known(x, most) else False for x in found]
                if learnt.beyond:
                    yield part.append_column(state, pa.array(keep, pa.bool_()))
                else:
                    yield part.filter(pa.array(keep, pa.bool_()))

    if not learnt.beyond:
        release(counted)
        return docs.mapInArrow(run, docs.schema)
    marked = docs.mapInArrow(run, schema)
    (key,) = row_id_columns(docs, ["text_key"])
    open_ = marked.filter(F.col(state).isNull()).withColumn(key, F.sha2(F.col("text").cast("binary"), 256))
    kept = _looked_up(open_, counted, learnt, key)
    late = open_.join(kept, open_[key] == kept["key"], "left_semi")
    return marked.filter(state).select(*docs.columns).unionByName(late.select(*docs.columns))
