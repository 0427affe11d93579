import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest

from repetend.llm import filter_audit
from repetend.llm.queries import ORACLE_SQL

DOCS = "doc_id long, text string, lang string, part string, mask int, digest string"
LABELS = "doc_id long, quality int, toxic int, good string"
COLUMNS = ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]


def fails(doc_id, text, everyone):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    return out | ({"E"} if doc_id is not None and any(i is not None and i < doc_id and t == text for i, t in everyone) else set())


def brute(docs, labels):
    """Every order is applied to the list, filter by filter."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    everyone = [(i, t) for i, t, _ in docs]
    failed = [fails(i, t, everyone) for i, t, _ in docs]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows = []
    for part in {p for *_, p in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        own = []
        for order in permutations("ABCDE"):
            left, out = [k for k, d in enumerate(docs) if d[2] == part], set()
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in failed[k]]
                redundant = sum(f in failed[k] for k in out)
                left = [k for k in left if f not in failed[k]]
                out |= set(gone)
                unique = sum(failed[k] == {f} for k, d in enumerate(docs) if d[2] == part)
                shapley[f] += len(gone)
                own.append((part, "".join(order), step, len(left), len(gone), redundant, unique, sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone), f))
        rows += [(*r[:-1], shapley[r[-1]]) for r in own]
    return sorted(rows)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts(rnd):
    word = lambda: rnd.choice(["x", "Ab", "Ünï", "q"]) + str(rnd.randrange(400))
    for _ in range(60):
        n = rnd.choice((0, 3, 99, 100, 101, 180))
        text = rnd.choice((" ", "\n", "\x1c ", "  ")).join(word() for _ in range(n))
        yield text.upper() if rnd.random() < 0.2 else text + rnd.choice(("", "", " | ", "é", "x" * 3000))


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    pool = list(texts(rnd))
    docs = [(i, rnd.choice(pool), rnd.choice(("en", "de", "", None))) for i in range(150)]
    # null ids and texts, rows that repeat, one id with two texts
    docs += [(None, pool[0], "en"), (None, None, None), (7, None, "de"), (200, None, "xx"), (3, docs[3][1], "en"), (3, docs[3][1], "en"), (4, "other", "en")]
    labels = [(i, rnd.choice((0, 1, None)), rnd.choice((0, 1, None))) for i in range(0, 210, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    return docs, labels


def test_against_brute_force(spark, case):
    docs, labels = case
    left = spark.createDataFrame([(*d, "z", 1, "d") for d in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(*x, "g") for x in labels], LABELS)
    assert found(filter_audit.audit(left, right)) == brute(docs, labels)


def test_sql_on_the_same_rows(spark, case):
    docs, labels = case
    with duckdb.connect() as c:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
        c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
        assert sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_filter_audit']})").fetchall()) == brute(docs, labels)


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(empty, labels).count() == 0
    rows = found(filter_audit.audit(spark.createDataFrame([(1, "one", None, "z", 1, "d")], DOCS), labels))
    assert len(rows) == 600 and rows == brute([(1, "one", None)], [])


def test_long_text():
    text = b" ".join(b"w%d" % (i % 977) for i in range(400_000))
    assert filter_audit.failures(text) == filter_audit.B
    assert filter_audit.failures(b"") == filter_audit.A


def test_packed_counts_of_many_parts():
    """Blocks whose parts end inside a byte, each against sums over rows."""
    rnd = np.random.default_rng(3)
    for parts, n in ((1, 1), (1, 4000), (7, 1000), (500, 900)):
        part, mask = rnd.integers(0, parts, n), rnd.integers(0, 128, n)
        names, counts = filter_audit.packed_counts(part, mask)
        assert names.tolist() == sorted(set(part.tolist()))
        for name, own in zip(names, counts, strict=True):
            m = mask[part == name]
            for (before, f), got in zip(filter_audit.subsets(), own, strict=True):
                fail, gone = (m >> f & 1) == 1, (m & before) > 0
                removed = fail & ~gone
                want = [(~gone & ~fail).sum(), removed.sum(), (fail & gone).sum(), ((m & 31) == 1 << f).sum(), (removed & (m & 32 > 0)).sum(), (removed & (m & 64 > 0)).sum()]
                assert got.tolist() == want


def test_blocks_of_a_task_add_up(spark, case, monkeypatch):
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) part", "cast(id * 37 % 128 as int) mask").coalesce(1)
    want = sorted(map(tuple, filter_audit.subset_counts(rows).collect()))
    monkeypatch.setattr(filter_audit, "BLOCK", 64)
    assert sorted(map(tuple, filter_audit.subset_counts(rows.repartition(5)).collect())) == want
