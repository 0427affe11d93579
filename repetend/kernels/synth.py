"""Generators of arrays with known truth: a parameter grid's simulator, and documents that describe blocks, modifiers and events.

Random numbers are numpy's, in one stream for each step, seeded by the document's seed and the step's name: what one
step draws does not depend on the others, nor on where it runs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np

from repetend.kernels import symbols

A, C, G, T = range(4)
HOR, SIMPLE, SHIFT, INSERTION = "HOR", "SIMPLE_TR", "SHIFT", "INSERTION"
EVENTS = ("HYBRID", "INVERSION", "DUPLICATION", "DELETION")
#: GC share of the kinds of insertions that are drawn symbol by symbol.
INSERTION_GC = {"random": 0.5, "AT_rich": 0.2, "GC_rich": 0.8}
KINDS = (*INSERTION_GC, "retro_like", "segdup_like")
FIELDS = {
    "HOR_slots": {"monomer_length_bp", "k", "source", "sequence", "file", "gc_content", "inter_slot_divergence"},
    "monomer": {"monomer_length_bp", "source", "sequence", "file", "gc_content"},
    HOR: {"template", "n_copies"},
    SIMPLE: {"template", "n_copies"},
    SHIFT: {"offset_bp"},
    INSERTION: {"length_bp", "kind"},
    "HYBRID": {"block", "at_copy", "slot", "source_slots", "split_fraction"},
    "INVERSION": {"block", "start_copy", "length_copies"},
    "DUPLICATION": {"block", "start_copy", "length_copies"},
    "DELETION": {"block", "start_copy", "length_copies"},
}
TOP = {"schema_version", "seed", "global", "templates", "structure", "modifiers", "post_generation"}


def stream(seed: int, name: str) -> np.random.Generator:
    return np.random.default_rng(symbols.named_seed(seed & symbols.MASK, name))


def random_dna(n: int, gc: float, rng: np.random.Generator) -> np.ndarray:
    strong, coin = rng.random(n) < gc, rng.random(n) < 0.5
    return np.where(strong, np.where(coin, G, C), np.where(coin, A, T)).astype(np.uint8)


def substituted(code: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Each symbol is replaced by another one at the rate."""
    hit = rng.random(len(code)) < rate
    return np.where(hit, (code + rng.integers(1, 4, len(code))) % 4, code).astype(np.uint8)


def edited(code: np.ndarray, sub: float, indel: float, rng: np.random.Generator) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Substitutions, then insertions before symbols and deletions, each at half the indel rate; the indels as (place, change)."""
    code = substituted(code, sub, rng) if sub > 0 else code
    if indel <= 0:
        return code, []
    add, drop = rng.random(len(code)) < indel / 2, rng.random(len(code)) < indel / 2
    grown = np.insert(code, np.flatnonzero(add), rng.integers(0, 4, int(add.sum())).astype(np.uint8))
    kept = np.ones(len(grown), bool)
    kept[np.flatnonzero(drop) + np.cumsum(add)[drop]] = False
    return grown[kept], sorted([(int(i), 1) for i in np.flatnonzero(add)] + [(int(i), -1) for i in np.flatnonzero(drop)])


# documents


def validate(doc: dict) -> None:
    """Raises ValueError with everything that is wrong with a document."""
    wrong: list[str] = []

    def known(where: str, item: dict, kinds: tuple[str, ...]) -> str:
        kind = item.get("type", "")
        if kind not in kinds:
            wrong.append(f"{where}: type must be one of {kinds}, not {kind!r}")
        elif extra := set(item) - FIELDS[kind] - {"type"}:
            wrong.append(f"{where}: unknown fields {sorted(extra)}")
        return kind

    if extra := set(doc) - TOP:
        wrong.append(f"unknown fields {sorted(extra)}")
    if doc.get("schema_version") != 1:
        wrong.append("schema_version must be 1")
    if extra := set(doc.get("global", {})) - {"mutation_rate", "indel_rate", "output", "array_id"}:
        wrong.append(f"global: unknown fields {sorted(extra)}")
    templates, structure = doc.get("templates", {}), doc.get("structure")
    if not isinstance(structure, list):
        raise ValueError("structure must be a list of blocks")
    for name, t in templates.items():
        kind = known(f"templates.{name}", t, ("HOR_slots", "monomer"))
        source, length = t.get("source", "random"), t.get("monomer_length_bp", 0)
        if not isinstance(length, int) or length < 1:
            wrong.append(f"templates.{name}: monomer_length_bp must be positive")
        if kind == "HOR_slots" and t.get("k", 0) < 1:
            wrong.append(f"templates.{name}: k must be positive")
        if source == "sequence" and len(t.get("sequence") or "") != length:
            wrong.append(f"templates.{name}: the sequence must be as long as the monomer")
        if source not in ("random", "sequence"):
            wrong.append(f"templates.{name}: source {source!r} isn't supported")
    before = None
    for i, b in enumerate(structure):
        kind = known(f"structure[{i}]", b, (HOR, SIMPLE, SHIFT, INSERTION))
        if kind in (HOR, SIMPLE):
            t = templates.get(b.get("template"))
            if t is None:
                wrong.append(f"structure[{i}]: unknown template {b.get('template')!r}")
            elif kind == HOR and (t.get("type") != "HOR_slots" or t.get("k", 0) < 2):
                wrong.append(f"structure[{i}]: HOR needs a template of HOR_slots with k of 2 or more")
            before = t or before
        elif kind == SHIFT and b.get("offset_bp", 0) < 0:
            if before is None:
                wrong.append(f"structure[{i}]: a negative SHIFT must follow a repeat block")
            elif -b["offset_bp"] > before.get("monomer_length_bp", 0) // 2:
                wrong.append(f"structure[{i}]: a negative SHIFT may take half a monomer at most")
        elif kind == INSERTION and b.get("kind") not in KINDS:
            wrong.append(f"structure[{i}]: kind must be one of {KINDS}")
    for i, m in enumerate(doc.get("modifiers", [])):
        if m.get("target", "all") != "all" or m.get("wobble", {}).get("model", "random_walk") not in ("sinusoidal", "random_walk"):
            wrong.append(f"modifiers[{i}]: only a wobble of all rows, sinusoidal or random_walk")
    for i, e in enumerate(doc.get("post_generation", [])):
        kind = known(f"post_generation[{i}]", e, EVENTS)
        block = structure[e["block"]] if 0 <= e.get("block", -1) < len(structure) else {}
        if block.get("type") not in (HOR, SIMPLE):
            wrong.append(f"post_generation[{i}]: block {e.get('block')} is no repeat block")
            continue
        first = e.get("at_copy" if kind == "HYBRID" else "start_copy", 0)
        last = first if kind == "HYBRID" else first + e.get("length_copies", 0) - 1
        if first < 1 or last < first or last > block["n_copies"]:
            wrong.append(f"post_generation[{i}]: copies {first} to {last} aren't in a block of {block['n_copies']}")
        k = templates.get(block["template"], {}).get("k", 1)
        if kind == "HYBRID" and not all(1 <= s <= k for s in (e.get("slot", 0), *e.get("source_slots", (0, 0)))):
            wrong.append(f"post_generation[{i}]: slots must be 1 to {k}")
    if wrong:
        raise ValueError("; ".join(wrong))


@dataclass
class Array:
    """A sequence with the places of its copies (block, copy, slot, start, length) and fillers (block, offset or kind, start, length)."""

    code: np.ndarray
    copies: np.ndarray
    fillers: list[list]

    def lift(self, indels: list[tuple[int, int]]) -> None:
        """Move all spans by indels: one before a span moves it, one inside changes its length."""
        if not indels:
            return
        at, change = np.array(indels).T
        order = np.argsort(at, kind="stable")
        at, total = at[order], np.concatenate(([0], np.cumsum(change[order])))

        def moved(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            left, right = total[np.searchsorted(at, start)], total[np.searchsorted(at, start + length)]
            return start + left, np.maximum(length + right - left, 0)

        if len(self.copies):
            self.copies[:, 3], self.copies[:, 4] = moved(self.copies[:, 3], self.copies[:, 4])
        for f in self.fillers:
            f[2], f[3] = (int(x) for x in moved(np.array(f[2]), np.array(f[3])))


def make_templates(templates: dict, rng: np.random.Generator) -> dict[str, list[np.ndarray]]:
    """Slots of each template; all but the first differ from it at half the divergence."""
    out = {}
    for name in sorted(templates):
        t = templates[name]
        own = t.get("source") == "sequence"
        first = symbols.codes(t["sequence"]) if own else random_dna(t["monomer_length_bp"], t.get("gc_content", 0.5), rng)
        rate = t.get("inter_slot_divergence", 0.0) / 2
        out[name] = [first] + [substituted(first, rate, rng) for _ in range(1, t.get("k", 1))]
    return out


def _insertion(kind: str, n: int, so_far: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    if kind == "retro_like" and n >= 400:  # the same ends around a core
        end = random_dna(min(200, n // 3), 0.5, rng)
        return np.concatenate((end, random_dna(n - 2 * len(end), 0.5, rng), end))
    if kind == "segdup_like" and len(so_far) >= n:
        at = int(rng.integers(0, len(so_far) - n + 1))
        return so_far[at : at + n]
    return random_dna(n, INSERTION_GC.get(kind, 0.5), rng)


def expand(structure: list[dict], slots: dict[str, list[np.ndarray]], rng: np.random.Generator) -> Array:
    code, copies, fillers = np.empty(0, np.uint8), [], []
    for i, b in enumerate(structure):
        if b["type"] in (HOR, SIMPLE):
            units = slots[b["template"]] if b["type"] == HOR else slots[b["template"]][:1]
            sizes = np.tile([len(u) for u in units], b["n_copies"])
            starts = len(code) + np.cumsum(sizes) - sizes
            number = np.arange(len(sizes))
            copies.append(np.stack((np.full(len(sizes), i), number // len(units) + 1, number % len(units) + 1, starts, sizes), axis=1))
            code = np.concatenate((code, np.tile(np.concatenate(units), b["n_copies"])))
        elif b["type"] == SHIFT and b["offset_bp"] < 0:
            end = len(code) + b["offset_bp"]
            for c in copies:
                c[:, 4] = np.clip(end - c[:, 3], 0, c[:, 4])
            code = code[:end]
            fillers.append([i, b["offset_bp"], end, 0])
        else:
            if b["type"] == SHIFT:  # symbols like those just before
                near = code[-50:] if len(code) else np.arange(4, dtype=np.uint8)
                more, kind = near[rng.integers(0, len(near), b["offset_bp"])], b["offset_bp"]
            else:
                more, kind = _insertion(b["kind"], b["length_bp"], code, rng), b["kind"]
            fillers.append([i, kind, len(code), len(more)])
            code = np.concatenate((code, more))
    return Array(code, np.concatenate(copies) if copies else np.empty((0, 5), np.int64), fillers)


def wobble(array: Array, spec: dict, row: int, rng: np.random.Generator) -> tuple[float, float | None]:
    """Rows grow and shrink along a wave or a random walk; its deviation, and a wave's period in symbols."""
    n, size, period = len(array.code) // row, spec["amplitude_bp"], spec.get("period_rows", 0)
    if not n or size <= 0:
        return 0.0, None
    if spec.get("model", "random_walk") == "sinusoidal":
        offset = size * np.sin(2 * np.pi * np.arange(n) / max(period, 1))
    else:
        window = max(2, int(period / 4 + 0.5)) if period > 0 else 50
        rho, steps = 1 - 1 / window, rng.normal(0, size * np.sqrt(2 / window), 3 * window + n)
        offset, at = np.empty(len(steps)), 0.0
        for i, s in enumerate(steps):
            at = offset[i] = rho * at + s
        offset = offset[-n:]
    parts, indels, carried = [], [], 0.0
    for r, change in enumerate(np.diff(offset, prepend=0.0)):
        own = array.code[r * row : (r + 1) * row]
        carried += change
        whole = int(carried)
        carried -= whole
        if whole > 0:
            own = np.concatenate((own, own[rng.integers(0, len(own), whole)]))
            indels += [((r + 1) * row, 1)] * whole
        elif whole < 0:
            whole = max(whole, -len(own))
            own = own[:whole]
            indels += [((r + 1) * row - 1 - j, -1) for j in range(-whole)]
        parts.append(own)
    array.code = np.concatenate((*parts, array.code[n * row :]))
    array.lift(indels)
    return float(offset.std()), period * row if spec.get("model") == "sinusoidal" and period > 0 else None


def happen(array: Array, event: dict, slots: dict[str, list[np.ndarray]], structure: list[dict]) -> dict:
    """One event; what it did, for the truth."""
    kind, block = event["type"], event["block"]
    own = array.copies[array.copies[:, 0] == block]
    if kind == "HYBRID":
        place = own[(own[:, 1] == event["at_copy"]) & (own[:, 2] == event["slot"])]
        if not len(place):
            raise ValueError("HYBRID: no such copy")
        start, size = int(place[0, 3]), int(place[0, 4])
        a, b = (slots[structure[block]["template"]][s - 1] for s in event["source_slots"])
        if len(a) != size or len(b) != size:
            raise ValueError("HYBRID: the copy is no longer as long as its sources")
        cut = min(int(size * event.get("split_fraction", 0.5) + 0.5), size)
        array.code[start : start + size] = np.concatenate((a[:cut], b[cut:]))
        return {"type": kind, "block": block, "at_bp": start, "copy": event["at_copy"], "slot": event["slot"], "source_slots": list(event["source_slots"])}
    first = event["start_copy"]
    own = own[(own[:, 1] >= first) & (own[:, 1] < first + event["length_copies"])]
    if not len(own):
        raise ValueError(f"{kind}: no such copies")
    start, end = int(own[:, 3].min()), int((own[:, 3] + own[:, 4]).max())
    starts, ends = array.copies[:, 3], array.copies[:, 3] + array.copies[:, 4]
    if kind == "INVERSION":
        part = array.code[start:end][::-1]
        array.code[start:end] = np.where(part < 4, 3 - part, part)
        inside = (starts >= start) & (ends <= end)
        array.copies[inside, 3] = start + end - ends[inside]
    elif kind == "DUPLICATION":
        array.code = np.concatenate((array.code[:end], array.code[start:end], array.code[end:]))
        array.copies[starts >= end, 3] += end - start
        for f in array.fillers:
            f[2] += (end - start) * (f[2] >= end)
    else:
        array.code = np.delete(array.code, np.s_[start:end])
        array.lift([(p, -1) for p in range(start, end)])
    return {"type": kind, "block": block, "start_bp": start, "length_bp": end - start}


def expression(doc: dict) -> str:
    """The structure as a formula: repeats and insertions joined by + or by the shift between them."""
    out, shift = "", []
    for b in doc["structure"]:
        t = doc.get("templates", {}).get(b.get("template"), {})
        if b["type"] == SHIFT:
            shift.append(b["offset_bp"])
            continue
        if b["type"] == HOR:
            apart = t.get("inter_slot_divergence", 0.0)
            said = f"H([M_1..M_{t['k']}],{b['n_copies']}{f',div={apart:g}' if apart > 0 else ''})"
        elif b["type"] == SIMPLE:
            said = f"T(M({t['monomer_length_bp']}),{b['n_copies']})"
        else:
            said = f"I({b['length_bp']},{b['kind']})"
        out += (f"|shift({shift[0]})|" if len(shift) == 1 else "+") + said if out else said
        shift = []
    return out or "(empty)"


def classify(doc: dict) -> tuple[str, int, int | None, int, str]:
    """True class, base width, copies in a unit, complete copies and reason."""
    found = []
    for b in doc["structure"]:
        if b["type"] in (HOR, SIMPLE):
            t = doc["templates"][b["template"]]
            apart = b["type"] == HOR and t.get("inter_slot_divergence", 0.0) != 0
            found.append((t["monomer_length_bp"], t["k"] if apart else None, b["n_copies"] * (t["k"] if b["type"] == HOR and not apart else 1)))
    if not found:
        return "random", 0, None, 0, "no repeat blocks"
    width, k, _ = found[0]
    total = sum(f[2] for f in found)
    if any(f[:2] != (width, k) for f in found):
        return "mixed", width, k, total, "multiple repeat blocks with different base_width or k"
    return "simple_TR" if k is None else "HOR", width, k, total, "single repeat block" if len(found) == 1 else f"{len(found)} identical-architecture blocks (treated as one)"


def candidate_periods(doc: dict, rng: np.random.Generator) -> list[tuple[int, float, str]]:
    """True periods, and a near miss, a harmonic and a false one."""
    out: dict[int, tuple[float, str]] = {}
    for b in doc["structure"]:
        if b["type"] in (HOR, SIMPLE):
            t = doc["templates"][b["template"]]
            out.setdefault(t["monomer_length_bp"], (0.94, "true_base"))
            if b["type"] == HOR and t.get("inter_slot_divergence", 0.0) > 0 and t["k"] >= 2:
                out.setdefault(t["monomer_length_bp"] * t["k"], (0.88, "true_hor_unit"))
    if out:
        base = min(out)
        near = max(20, base + int(rng.integers(2, 5)) * (1 if rng.random() < 0.5 else -1))
        false = int(rng.choice(np.setdiff1d(np.arange(100, 5001), list(out))))
        for p, more in ((near, (0.71, "near_miss")), (base * (2 if rng.random() < 0.5 else 3), (0.65, "harmonic")), (false, (0.42, "false"))):
            out.setdefault(p, more)
    return [(p, s, source) for p, (s, source) in out.items()]


@dataclass
class Made:
    array_id: str
    sequence: str
    truth: dict
    periods: list[tuple[int, float, str]]


def synthesize(doc: dict, name: str = "array", seed: int | None = None) -> Made:
    """The array of a valid document, its truth and candidate periods."""
    validate(doc)
    seed = doc.get("seed", 0) if seed is None else seed
    general, structure = doc.get("global", {}), doc["structure"]
    slots = make_templates(doc.get("templates", {}), stream(seed, "templates"))
    array = expand(structure, slots, stream(seed, "structure"))
    size, period, rng = 0.0, None, stream(seed, "wobble")
    for m in doc.get("modifiers", []):
        row = next((doc["templates"][b["template"]]["monomer_length_bp"] for b in structure if b["type"] in (HOR, SIMPLE)), 0)
        if not row:
            raise ValueError("a wobble needs a repeat block")
        size, period = wobble(array, m["wobble"], row, rng)
    events = [happen(array, e, slots, structure) for e in doc.get("post_generation", [])]
    array.code, indels = edited(array.code, general.get("mutation_rate", 0.0), general.get("indel_rate", 0.0), stream(seed, "noise"))
    array.lift(indels)
    klass, width, k, total, reason = classify(doc)
    shifts = [f for f in array.fillers if isinstance(f[1], int)]
    name = general.get("array_id") or name
    truth = {
        "array_id": name, "length_bp": len(array.code), "truth_class": klass, "base_width_bp": width, "hor_k": k, "hor_length_bp": k and k * width, "n_complete_copies": total, "wobble_amplitude_bp": size,
        "wobble_periodicity_bp": period and float(period), "n_phase_shifts": len(shifts), "phase_shift_positions": [f[2] for f in shifts], "phase_shift_offsets": [f[1] for f in shifts], "n_segments": 1 + len(shifts),
        "reason": reason, "structural_expression": expression(doc), "schema_version": doc["schema_version"], "events_json": json.dumps(events, separators=(",", ":")),
    }
    return Made(name, symbols.letters(array.code), truth, candidate_periods(doc, stream(seed, "periods")))


# parameter grid


@dataclass(frozen=True)
class GridRow:
    monomer_len: int = 171
    hor_order: int = 12
    n_blocks: int = 100
    sub_rate_intra: float = 0.05
    sub_rate_inter: float = 0.03
    indel_rate_intra: float = 0.0
    indel_rate_inter: float = 0.0
    block_conversions: int = 0
    monomer_conversions: int = 0
    submono_k: int = 1
    seed: int = 0


def identities(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One less the edit distance by the longer length, of each pair; all go through the recurrence together."""
    la, lb = (np.array([len(p[i]) for p in pairs], np.int64) for i in range(2))
    most, wide = int(la.max(initial=0)), int(lb.max(initial=0))
    a, b = np.full((most, len(pairs)), 5, np.uint8), np.full((len(pairs), wide), 6, np.uint8)
    for n, (x, y) in enumerate(pairs):
        a[: len(x), n], b[n, : len(y)] = x, y
    ramp = np.arange(wide + 1, dtype=np.int32)
    # cells less their column's number: the chain of gaps along a row is a running minimum then
    row, last = np.zeros((len(pairs), wide + 1), np.int32), np.zeros(len(pairs), np.int64)
    last[la == 0] = lb[la == 0]
    step = np.empty_like(row[:, 1:])
    for i in range(1, most + 1):
        np.subtract(row[:, :-1], b == a[i - 1][:, None], out=step)
        row += 1
        np.minimum(row[:, 1:], step, out=row[:, 1:])
        np.minimum.accumulate(row, axis=1, out=row)
        done = np.flatnonzero(la == i)
        last[done] = row[done, lb[done]] + ramp[lb[done]]
    return 1 - last / np.maximum(np.maximum(la, lb), 1)


def identity(a: np.ndarray, b: np.ndarray) -> float:
    return float(identities([(a, b)])[0])


def simulate(row: GridRow, pairs: int = 40) -> tuple[str, dict, list[tuple], list[tuple]]:
    """Sequence, truth, monomers (index, block, founder, start, end) and conversions (order, scope, source, target)."""
    if min(row.monomer_len, row.hor_order, row.n_blocks) < 1:
        raise ValueError("monomer_len, hor_order and n_blocks must be positive")
    parts = max(row.submono_k, 1)
    if row.monomer_len % parts:
        raise ValueError("monomer_len must be a multiple of submono_k")
    rng = stream(row.seed, "simulate")
    base = np.tile(random_dna(row.monomer_len // parts, 0.5, rng), parts)
    founders = [base] if row.hor_order == 1 else [edited(base, row.sub_rate_intra, row.indel_rate_intra, rng)[0] for _ in range(row.hor_order)]
    order, n = row.hor_order, row.hor_order * row.n_blocks
    own = [edited(founders[i % order], row.sub_rate_inter, row.indel_rate_inter, rng)[0] for i in range(n)]
    events: list[tuple] = []
    for scope, times, count in (("block", row.block_conversions, row.n_blocks), ("monomer", row.monomer_conversions, n)):
        size = order if scope == "block" else 1
        for _ in range(times if count > 1 else 0):
            s, t = (int(x) for x in rng.choice(count, 2, replace=False))
            own[t * size : (t + 1) * size] = own[s * size : (s + 1) * size]
            events.append((len(events), scope, s, t))
    ends = np.cumsum([len(m) for m in own]).tolist()
    monomers = [(i, i // order, i % order, e - len(m), e) for i, (m, e) in enumerate(zip(own, ends, strict=True))]
    same_block, same_founder = order > 1, row.n_blocks > 1

    drawn: list[tuple[np.ndarray, np.ndarray]] = []

    def draw(kind: str) -> None:
        """At most so many pairs of monomers of a kind."""
        for _ in range(pairs):
            b, f = int(rng.integers(row.n_blocks)), int(rng.integers(order))
            c = b if kind == "intra" else (b + 1 + int(rng.integers(row.n_blocks - 1))) % row.n_blocks
            g = f if kind == "homologous" else (f + 1 + int(rng.integers(order - 1))) % order
            drawn.append((own[b * order + f], own[c * order + g]))

    kinds = [kind for kind, there in (("intra", same_block), ("homologous", same_founder), ("cross", same_block and same_founder)) if there]
    for kind in kinds:
        draw(kind)
    means = dict(zip(kinds, identities(drawn).reshape(len(kinds), pairs).mean(axis=1).tolist(), strict=True)) if drawn else {}
    intra, same, cross = (means.get(kind) for kind in ("intra", "homologous", "cross"))
    truth = row.__dict__ | {
        "array_length": ends[-1], "n_monomers": n, "mean_intra_block_id": intra, "mean_homologous_id": same, "mean_cross_position_id": cross,
        "hor_signal": same - cross if same is not None and cross is not None else None,
    }
    return symbols.letters(np.concatenate(own)), truth, monomers, events
