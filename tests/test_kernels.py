import random

import numpy as np
import pytest

from repetend.kernels import detector, homology, motifs, periodogram, register, rescoring, symbols, width, xorshift


def dna(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def mutated(rnd, text, rate):
    return "".join(rnd.choice("ACGT") if rnd.random() < rate else c for c in text)


def test_xorshift_streams():
    def slow(state, n):
        out = []
        for _ in range(n):
            state ^= state << 13 & symbols.MASK
            state ^= state >> 7
            state ^= state << 17 & symbols.MASK
            out.append(state)
        return out

    found = xorshift.runs(np.array([1, 987654321, 2**63 + 5], np.uint64), 700)
    for row, seed in zip(found, (1, 987654321, 2**63 + 5), strict=True):
        assert row.tolist() == slow(seed, 700)
    assert symbols.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_words_and_histogram():
    rnd = random.Random(1)
    for _ in range(40):
        text = "".join(rnd.choice("ACGTN") for _ in range(rnd.randrange(0, 80)))
        seen, want = {}, [0] * (len(text) + 1)
        for i in range(len(text) - 2):
            w = text[i : i + 3]
            if "N" not in w:
                if w in seen:
                    want[i - seen[w]] += 1
                seen[w] = i
        assert periodogram.histogram(symbols.codes(text), 3).tolist() == want
    assert symbols.letters(symbols.codes("acguTX-")) == "ACGTTNN"


def test_background_and_peaks():
    rnd = random.Random(2)
    unit = dna(rnd, 60)
    code = symbols.codes(unit * 100)
    cfg = periodogram.PeriodogramConfig()
    peaks, profile, level = periodogram.analyze("x", code, cfg)
    assert peaks.period.tolist() == [60] and abs(peaks.share.sum() - 1) < 1e-9 and (profile[60] > level[60])
    assert np.array_equal(level, periodogram.analyze("x", code, cfg)[2]) and not np.array_equal(level, periodogram.analyze("y", code, cfg)[2])
    for n in range(9):
        short = periodogram.analyze("x", symbols.codes("A" * n), cfg)
        assert len(short[0]) == 0 and len(short[1]) == (n + 1 if n >= 8 else 0)
    near = periodogram.find_peaks(np.array([0, 0, 5.0, 0, 4, 0, 3, 0] + [0] * 12), np.zeros(20), periodogram.PeriodogramConfig(least_distance=3, least_share=0))
    assert sorted(near.period.tolist()) == [2, 6]


def test_motif_hits_against_a_plain_scan():
    def plain(text, specs):
        out, starts, single = [], set(), []
        for n, least in specs:
            i = 0
            while i + n * least <= len(text):
                m, j = text[i : i + n], i + n
                if set(m) - set("acgt"):
                    i += 1
                    continue
                while text[j : j + n] == m:
                    j += n
                if (j - i) // n < least:
                    i += 1
                    continue
                if len(set(m)) == 1:
                    if n == 1:
                        single.append((n, m, i + 1, j))
                elif i + 1 not in starts:
                    starts.add(i + 1)
                    out.append((n, m, i + 1, j))
                i = j
        return out or single

    rnd, specs = random.Random(3), ((1, 5), (2, 3), (3, 2), (4, 2))
    for _ in range(400):
        text = "".join(rnd.choice(("a", "c", "ac", "acg", "n", "t", "tt")) for _ in range(rnd.randrange(20)))
        assert [(h.length, h.motif, h.start, h.end) for h in motifs.hits(text.upper(), specs)] == plain(text, specs)


def test_motif_forms_and_scan():
    assert motifs.canonical("GT") == "AC" and motifs.canonical("ttaggg") == "AACCCT" and motifs.canonical("") == ""
    assert motifs.unique_motifs(["ACAC", "AC", "AAT", "ACACAC"]) == ["AC", "AAT"]
    assert motifs.parse_specs("1:20, 2:9") == ((1, 20), (2, 9))
    with pytest.raises(ValueError):
        motifs.parse_specs("3")
    found = motifs.scan("CA" * 500, 2)
    assert (found.method, found.raw.total, found.raw.motif, found.consensus) == ("consensus_single", 100.0, "AC", "CA(500)")
    assert motifs.scan("ACGT", None).method == "raw_fallback"
    assert motifs.round_to(1.005, 2) == 1.0 and motifs.round_to(0.285, 2) == 0.28


def test_alignment_against_a_plain_recurrence():
    def plain(a, b, band):
        free, top = len(b) - len(a), 65535
        row = [0 if j <= free else top for j in range(len(b) + 1)]
        for i in range(1, len(a) + 1):
            lo, hi = max(i - band, 0), min(i + free + band, len(b))
            new = [top] * (len(b) + 1)
            if lo == 0:
                new[0] = i
            for j in range(max(lo, 1), hi + 1):
                cost = 0 if a[i - 1] == b[j - 1] != 4 else 1
                new[j] = min(row[j - 1] + cost, row[j] + 1, new[j - 1] + 1, top)
            row = new
        lo, hi = max(len(a) - band, 0), min(len(a) + free + band, len(b))
        return min((row[j], j) for j in range(lo, hi + 1))

    rnd = random.Random(4)
    cfg = rescoring.RescoreConfig(slop=4, band=6)
    for _ in range(12):
        period = rnd.randrange(10, 40)
        unit = [rnd.randrange(4) for _ in range(period)]
        code = np.array([x if rnd.random() > 0.15 else rnd.randrange(5) for _ in range(12) for x in unit if rnd.random() > 0.05], np.uint8)
        at = np.arange(0, len(code) - 2 * period - 4, 9)
        distance, end = rescoring.align(code, at, period, cfg)
        for i, a in enumerate(at):
            assert (distance[i], end[i]) == plain(code[a : a + period], code[a + period - 4 : a + 2 * period + 4], 6)


def test_rescoring_of_known_arrays():
    rnd = random.Random(5)
    unit = dna(rnd, 100)
    clean, noise = symbols.codes(unit * 80), symbols.codes(dna(rnd, 8000))
    cfg = rescoring.RescoreConfig()
    stats = lambda code, period: rescoring.pair_stats(rescoring.pairs_of(code, [period], "a", cfg)[0], len(code), cfg)
    own, other = stats(clean, 100), stats(noise, 100)
    assert own.median == 1.0 and own.shift == 0 and not own.phantom and other.median < 0.7
    assert stats(clean, 103).shift == -3 and stats(clean[:150], 100) is None
    assert rescoring.self_match(clean, 100, 0.55, 3) == (1, 7900) and rescoring.self_match(clean[:300], 100, 0.55, 3) is None
    half = symbols.codes(dna(rnd, 4000) + unit * 40)
    assert 0.45 < rescoring.self_match(half, 100, 0.55, 3)[1] / 8000 < 0.56
    strided = rescoring.RescoreConfig(strided=True, samples=40)
    assert len(rescoring.anchors(clean, 100, "a", strided)) == 40


def test_irregularity_of_known_arrays():
    rnd = random.Random(6)
    unit = dna(rnd, 100)
    assert register.analyze(unit * 60, 100.0).events == 0
    jumped = register.analyze(unit * 60 + unit[:30] + unit * 60, 100.0)
    assert (jumped.flag, jumped.events) == ("ok", 1) and abs(jumped.max_shift - 30) < 1
    assert register.analyze(unit * 5, 100.0).flag == "too_short" and register.analyze(unit, None).flag == "no_period"
    assert register.analyze((unit * 60).lower(), 100.0).flag == "no_register_lock" and register.analyze(dna(rnd, 6000), 100.0).flag == "no_register_lock"


def test_widths_and_families():
    cfg = width.DetectorConfig()
    assert width.divisors(12) == [2, 3, 4, 6] and width.divisors(3) == []
    found = width.widths([(100, 0.9), (30, 0.5)], 10_000, cfg)
    assert found[:4] == [100, 30, 20, 25] and {99, 101, 200, 300, 60, 90} <= set(found) and len(found) <= cfg.max_widths_per_array
    assert width.widths([(100, 0.9)], 90, cfg)[:3] == [20, 25, 50]
    with pytest.raises(ValueError):
        width.DetectorConfig(min_width=0)
    assert width.best_identity(np.array([0, 1, 2, 3]), np.array([1, 2, 3, 0])) == (1.0, 1.0)


def test_shift_and_jump_against_plain_loops():
    rnd = np.random.default_rng(7)
    rows = rnd.integers(0, 5, (12, 30)).astype(np.uint8)
    cfg = width.DetectorConfig()
    best = []
    for a, b in zip(rows, rows[1:], strict=False):
        score = {s: np.mean([a[c] == b[c + s] for c in range(30) if 0 <= c + s < 30]) for s in range(-5, 6)}
        best.append(next(s for s in (0, -1, 1, -2, 2, -3, 3, -4, 4, -5, 5) if score[s] == max(score.values())))
    assert width.shifts(rows, cfg).best.tolist() == best
    base = rnd.integers(0, 4, 40).astype(np.uint8)
    assert width.jump_at(np.stack([base] * 5), np.stack([np.roll(base, 7)] * 5)) == 7


def test_detector_classes():
    rnd = random.Random(8)
    unit = dna(rnd, 100)
    simple = detector.detect(symbols.codes("".join(mutated(rnd, unit, 0.05) for _ in range(200))), [(100, 0.95)])
    assert (simple.klass, simple.base, simple.consensus[0]) == ("simple_TR", 100, ("monomer", unit))
    kin = [mutated(rnd, unit, 0.12) for _ in range(5)]
    hor = detector.detect(symbols.codes("".join(mutated(rnd, x, 0.01) for _ in range(60) for x in kin)), [(100, 0.95), (500, 0.9)])
    assert (hor.klass, hor.base, hor.k, hor.unit) == ("HOR", 100, 5, 500) and hor.confidence > 0.9
    far = [mutated(rnd, dna(rnd, 100), 0.12) for _ in range(1)]
    far = [mutated(rnd, far[0], 0.12) for _ in range(5)]
    both = "".join(mutated(rnd, x, 0.01) for y in (kin, far) for _ in range(60) for x in y)
    mixed = detector.detect(symbols.codes(both), [(100, 0.95), (500, 0.9)])
    assert mixed.klass == "mixed" and mixed.n_segments == len(mixed.segments) > 2 and "block-consensus identity" in mixed.reason
    two = symbols.codes("".join(mutated(rnd, x, 0.02) * 1 for x in [unit] * 100) + "".join(mutated(rnd, x, 0.02) for x in [dna(rnd, 171)] * 60))
    assert detector.detect(two, [(100, 0.95), (171, 0.9)]).klass in ("mixed", "simple_TR", "ambiguous")
    assert detector.detect(symbols.codes(dna(rnd, 5000)), []).reason == "no widths available"
    assert detector.detect(symbols.codes(dna(rnd, 20_000)), [(100, 0.4)]).klass == "ambiguous"


def test_blocks_cover_and_align():
    cfg = width.DetectorConfig()
    for n in (5, 20, 100, 999, 5000):
        for unit in (None, 3, 7):
            found = detector.blocks_of(n, unit, [n // 3], cfg)
            assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
            if len(found) > 1:
                assert all(b - a >= cfg.min_segment_rows for a, b in found)


def test_homology():
    rnd = random.Random(9)
    unit = dna(rnd, 80)
    alike = homology.probe(symbols.codes("".join(mutated(rnd, unit, 0.02) for _ in range(50))), 80)
    assert alike.n_blocks >= 49 and alike.score > 0.8 and homology.probe(symbols.codes(dna(rnd, 4000)), 80) is None
    turned = motifs.reverse_complement(unit)
    assert np.array_equal(homology.sketches(symbols.codes(unit), 80, 0, 5), homology.sketches(symbols.codes(turned), 80, 0, 5))
    assert homology.probe(symbols.codes((unit + dna(rnd, 80)) * 20), 80, homology.HomologyConfig(floor=0)).n_subtypes == 2


def test_least_rotation_of_short_and_long_words():
    from repetend.kernels import motifs

    rnd = random.Random(2)
    for n in [*range(12), 5000]:
        for letters in ("AC", "ACGT", "A"):
            for _ in range(40 if n < 12 else 1):
                word = "".join(rnd.choice(letters) for _ in range(n))
                every = [s[i:] + s[:i] for s in (word, motifs.reverse_complement(word)) for i in range(n)]
                assert motifs.canonical(word) == min(every, default="")
    word = "".join(rnd.choice("ACGT") for _ in range(6000))
    assert motifs.canonical(word) == motifs.canonical(word[4321:] + word[:4321])


def test_bands_of_bits_against_the_recurrence():
    rng = np.random.default_rng(1)
    for trial in range(50):
        period = int(rng.integers(20, 700))
        code = np.tile(rng.integers(0, 4, period), 4).astype(np.uint8) if trial % 2 else rng.integers(0, 4, 4 * period).astype(np.uint8)
        changed = rng.random(len(code)) < rng.choice((0.0, 0.02, 0.3))
        code[changed] = rng.integers(0, 5, changed.sum())
        for _ in range(int(rng.integers(0, 15))):
            at = int(rng.integers(0, len(code) - 1))
            code = np.concatenate((code[:at], code[at + 1 :], code[:1]))
        cfg = rescoring.RescoreConfig(slop=int(rng.choice((0, 1, 10, 20))), band=int(rng.choice((0, 3, 20, 90))))
        at = rng.integers(cfg.slop, 2 * period - cfg.slop, 20)
        for got, want in zip(rescoring.distances(code, at, np.full(20, period), cfg), rescoring.align(code, at, period, cfg), strict=True):
            assert (got == want).all()


def test_periods_together_as_each_alone():
    code = np.random.default_rng(3).integers(0, 5, 9000).astype(np.uint8)
    for cfg in (rescoring.RescoreConfig(samples=7), rescoring.RescoreConfig(samples=7, gap=2)):
        periods = [1500, 20, 4490, 300, 301, 21]
        for p, found in zip(periods, rescoring.pairs_of(code, periods, "x", cfg), strict=True):
            distance, end = rescoring.align(code, rescoring.anchors(code, p, "x", cfg), p, cfg)
            assert (found.distance == distance).all() and (found.end == end).all()
    assert [len(p.at) for p in rescoring.pairs_of(code[:30], [20, 25], "x", rescoring.RescoreConfig())] == [0, 0]


def test_homology_of_many_kinds_is_exact_and_bounded():
    """Kinds against exact whole numbers, and memory that follows the kinds, not blocks times k-mers."""
    import tracemalloc

    rng = np.random.default_rng(5)
    code = np.where(rng.random(60000) < 0.11, rng.integers(0, 4, 60000), np.tile(rng.integers(0, 4, 20), 3000)).astype(np.uint8)
    tracemalloc.start()
    found = homology.probe(code, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.n_blocks > 2990 and found.n_subtypes > 900 and peak < 20 << 20

    few = code[:4000]
    found, word = homology.probe(few, 20), homology.canonical_words(few, 5)
    kinds = []
    for i in range(found.n_blocks):
        own = np.bincount(word[found.offset + 20 * i : found.offset + 20 * i + 16], minlength=1024)
        if not any(400 * int(own @ x) ** 2 >= 289 * int(own @ own) * int(x @ x) for x in kinds):
            kinds.append(own)
    assert found.n_subtypes == len(kinds) > 50


def test_identities_of_pairs_together():
    """Pairs of all lengths in one recurrence against a plain one each."""
    from repetend.kernels import synth

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + int(x != y)))
            row = new
        return 1 - row[-1] / max(len(a), len(b), 1)

    rng = np.random.default_rng(3)
    pairs = [tuple(rng.integers(0, 5, int(rng.integers(0, 12))).astype(np.uint8) for _ in range(2)) for _ in range(200)]
    assert synth.identities(pairs).tolist() == [plain(a.tolist(), b.tolist()) for a, b in pairs]


def test_records_are_rescored_together_as_each_alone(monkeypatch):
    """One alignment serves records of any lengths, and k-mer neighbours of a record are found once for all its rows."""
    from repetend.operators import rescore

    rnd, cfg = random.Random(8), rescoring.RescoreConfig(samples=50)
    records = [(symbols.codes("".join(mutated(rnd, unit, 0.05) for _ in range(n))), [len(unit), 2 * len(unit)], str(n)) for n, unit in ((12, dna(rnd, 40)), (30, dna(rnd, 25)), (9, dna(rnd, 90)))]
    records.insert(1, (symbols.codes("ACGT"), [20], "short"))
    together = rescoring.pairs_of_records(records, cfg)
    for (code, periods, name), own in zip(records, together, strict=True):
        for p, q in zip(rescoring.pairs_of(code, periods, name, cfg), own, strict=True):
            assert p.period == q.period and all(np.array_equal(getattr(p, n), getattr(q, n)) for n in ("at", "distance", "end"))
            assert np.array_equal(rescoring.distances(code, q.at, np.full(len(q.at), q.period), cfg)[0], q.distance) if len(q.at) else True

    calls, plain = [], symbols.neighbours
    monkeypatch.setattr(symbols, "neighbours", lambda word: calls.append(1) or plain(word))
    rows = [{"rank": i + 1, "period": p, "wanted": i < 2} for i, p in enumerate(range(40, 60))]
    found = rescore._rescored(records[0][0], "12", rows, cfg, True)
    assert len(found) == 20 and found[0][-3] == 40 and len(calls) == 1


def test_words_are_locked_together_as_each_alone():
    """Usual distances of all k-mers in one go, against loops; of equally frequent distances the least counts."""
    rng = np.random.default_rng(7)
    words = [np.unique(rng.integers(0, 900, int(rng.integers(1, 40)))) for _ in range(150)] + [np.arange(i, 900, 30) for i in range(5)] + [np.array([0, 30, 90, 120, 180])]

    def alone(places):
        gaps = np.diff(places).tolist()
        if len(places) < 3:
            return None
        usual = min(gaps, key=lambda g: (-gaps.count(g), g))
        if not any(abs(usual - t) / t <= register.TOLERANCE for t in [m * 30.0 for m in register.MULTIPLES] + [30.0 / m for m in register.DIVISORS]):
            return None
        n = [int(g / usual + 0.5) for g in gaps]
        near = [1 <= m <= register.MOST_SKIPPED + 1 and abs(g - m * usual) <= register.TOLERANCE * max(m, 1) * usual for g, m in zip(gaps, n)]
        return usual if sum(near) / len(near) >= register.NEAR_SHARE else None

    want = [(w.tolist(), float(u)) for w in words if (u := alone(w)) is not None]
    assert [(w.tolist(), u) for w, u in register.locked_words(words, 30.0)] == want and len(want) >= 6


def test_replicates_are_counted_together_as_each_alone(monkeypatch):
    """The envelope of all replicates, and states of stretches made by doubling, against one after the other."""
    seeds = np.array([3, 5, 1 << 63], np.uint64)
    plain = [seeds]
    for _ in range(1000):
        plain.append(xorshift._step(plain[-1]))
    assert np.array_equal(xorshift.runs(seeds, 1000), np.stack(plain[1:], axis=1)) and xorshift.STRIDE < 256

    code, cfg = symbols.codes(dna(random.Random(2), 700) + "N" * 9 + "ACGTACGGT" * 40), periodogram.PeriodogramConfig()
    together, drawn = periodogram.background(code, "x", cfg), list(periodogram.random_codes("x", np.bincount(code, minlength=5)[:4], len(code), 10))
    assert np.array_equal(periodogram.envelope_of(np.stack(drawn), 6), np.max([periodogram.histogram(d, 6) for d in drawn], axis=0))
    monkeypatch.setattr(periodogram, "SHORT", 0)
    assert np.array_equal(together, periodogram.background(code, "x", cfg))


def test_monomers_of_long_periods_take_little_room(monkeypatch):
    """Words ranked by doubling against words counted as text; room follows the sequence, not sequence times period."""
    import tracemalloc

    rnd, cfg = random.Random(6), motifs.MotifConfig(least_ratio=0.0, most_monomers=20)
    cases = [("".join(mutated(rnd, unit, 0.02) for _ in range(12)) + "NN" + dna(rnd, 40), p) for p, unit in ((7, dna(rnd, 7)), (50, dna(rnd, 50)), (64, dna(rnd, 64)))]
    text = [motifs.monomers(s, p, cfg) for s, p in cases]
    assert all(len({motifs.canonical(w) for w, _ in own}) == len(own) > 1 for own in text)
    monkeypatch.setattr(motifs, "TOGETHER", 0)
    assert [motifs.monomers(s, p, cfg) for s, p in cases] == text
    monkeypatch.undo()
    long = dna(rnd, 20000)
    tracemalloc.start()
    motifs.monomers(long, 3000, cfg)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_widths_of_an_array_share_its_words_and_shifts_go_together(monkeypatch):
    """k-mers are worked out once an array, and all shifts of all rows together, in blocks, against loops."""
    from repetend.kernels import symbols

    calls, words = [], symbols.words
    monkeypatch.setattr(symbols, "words", lambda code, k: calls.append(k) or words(code, k))
    rnd = random.Random(41)
    unit = dna(rnd, 60)
    found = detector.detect(symbols.codes(unit * 40 + dna(rnd, 300)), [(60, 0.9), (120, 0.5)])
    assert len(calls) == 1 and len(found.features) > 5
    rng = np.random.default_rng(41)
    for n, w, reach, block in ((9, 14, 5, 1 << 16), (30, 3, 5, 1 << 16), (30, 20, 5, 45), (2, 1, 2, 1)):
        monkeypatch.setattr(width, "SHIFT_BLOCK", block)
        rows = rng.integers(0, 5, (n, w)).astype(np.uint8)
        got = width._shares(rows, reach)
        for s in range(-reach, reach + 1):
            for r in range(n - 1):
                hits = [rows[r, i] == rows[r + 1, i + s] for i in range(w) if 0 <= i + s < w]
                assert got[s + reach, r] == (sum(hits) / len(hits) if hits else 0)
