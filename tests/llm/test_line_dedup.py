import random
import re

from repetend.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def every_earlier(docs, min_words):
    """Places of the lines that lie in a run of at least min_words words which stands anywhere earlier, from every run."""
    seen, out = set(), {}
    for key in sorted(docs):
        plain = [" ".join(re.split(r"[\x20\x09-\x0D]+", x.strip(SPACE).lower())) for x in (docs[key] or "").split("\n")]
        own, gone = [(i, x, len(x.split(" "))) for i, x in enumerate(plain) if x], set()
        for b in range(1, len(own) + 1):  # runs that end before place b, in order of their ends
            for a in range(b):
                run = tuple(x[1] for x in own[a:b])
                if sum(x[2] for x in own[a:b]) >= min_words:
                    if run in seen:
                        gone |= {x[0] for x in own[a:b]}
                    seen.add(run)
        out[key] = gone
    return out


def test_long_passages_go_and_the_first_copy_stays(corpus):
    passage = " ".join(f"p{i}" for i in range(60))
    many = "\n".join(" ".join(f"q{i}x{k}" for k in range(9)) for i in range(8))
    short = "a line that many texts share"
    docs = corpus([(3, f"three\n{passage}\n{short}"), (1, f"{short}\none\n{passage}"), (2, f"two\n{many}\n{short}"), (5, f"{many}\nfive"), (8, f"{passage.upper()}\n\n{passage}")])
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert rows == {1: f"{short}\none\n{passage}", 3: f"three\n{short}", 2: f"two\n{many}\n{short}", 5: "five", 8: ""}


def test_odd_rows(odd, corpus):
    key = lambda x: (str(x.doc_id), x.text or "")
    assert sorted(map(key, line_dedup.dedup_lines(odd).collect())) == sorted(map(key, odd.collect()))
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0
    text = " ".join(f"w{i}" for i in range(70))
    rows = line_dedup.dedup_lines(corpus([(4, text), (4, text), (None, text), (None, None)])).collect()
    assert sorted(map(key, rows)) == [("4", ""), ("4", ""), ("None", ""), ("None", text)]
    named = corpus([(1, text), (2, text)]).withColumn("gone_th", line_dedup.F.lit(1)).withColumn("gone_doc_id", line_dedup.F.lit(2))
    out = line_dedup.dedup_lines(named)
    assert out.columns == named.columns and {r.doc_id: (r.text, r.gone_th, r.fp) for r in out.collect()} == {1: (text, 1, "x"), 2: ("", 1, "x")}


def test_tails_shared_with_a_later_copy_go(corpus):
    passage, tail = " ".join(f"p{i}" for i in range(60)), "a tail of five words\nand one of six words more"
    docs = {1: f"{passage}\nfirst", 2: f"{passage}\n{tail}\nsecond", 3: f"{passage}\n{tail}\nthird", 4: f"x\n{passage}\n{tail}"}
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(corpus(list(docs.items()))).collect()}
    assert rows == {1: docs[1], 2: f"{tail}\nsecond", 3: "third", 4: "x"}


def test_against_every_earlier_run(corpus):
    rnd = random.Random(12)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))) for _ in range(40)]
    for round_ in range(4):
        docs, runs = {}, [[rnd.choice(pool) for _ in range(rnd.randrange(1, 9))] for _ in range(5)]
        for i in range(40):
            parts = []
            for _ in range(rnd.randrange(5)):
                parts += rnd.choice(runs) if rnd.random() < 0.5 else [rnd.choice(pool), "", f"only {i} {rnd.random()}"]
            docs[i * 7 % 40] = "\n".join(x.upper() + "  " if rnd.random() < 0.1 else x for x in parts)
        want = every_earlier(docs, 15)
        rows = line_dedup.dedup_lines(corpus(list(docs.items()), parts=1 + round_), min_words=15, removed="gone").collect()
        assert {r.doc_id: set(r.gone) for r in rows} == want


def test_runs_of_many_more_lines_than_an_extension_go_whole(corpus):
    rnd = random.Random(3)
    run = [f"w{rnd.randrange(30)}" for _ in range(90)]
    docs = {1: "\n".join([*run, "one"]), 2: "\n".join(["two", *run[7:], "more of two"]), 3: "\n".join([*run[40:], "more of two", *run[:20]])}
    want = every_earlier(docs, 6)
    assert len(want[2]) == 83 and len(want[3]) == 71
    rows = line_dedup.dedup_lines(corpus(list(docs.items())), min_words=6, removed="gone").collect()
    assert {r.doc_id: set(r.gone) for r in rows} == want
