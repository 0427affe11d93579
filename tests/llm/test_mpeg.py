import hashlib
import random
import zlib
from fractions import Fraction

from repetend.llm import mpeg


def test_lossless_for_all_sizes():
    rnd = random.Random(0)
    for n in [*range(0, 200, 7), 1393, 1394, 1416, 1417, 1418, 2834, 2835, 100_000]:
        payload = rnd.randbytes(n) or bytes(64)
        media = mpeg.wrap(payload)
        audio = mpeg.parse(media)
        assert mpeg.unwrap(media, audio) == payload
        assert audio.unsynced == 0 and audio.bad == 0 and audio.checked == len(audio.offsets) + 1
        assert audio.table["frames"] == len(audio.offsets) and audio.duration == Fraction(1152 * len(audio.offsets), 32000)


def test_damage_is_found():
    payload = bytes(range(1, 255)) * 40
    media = bytearray(mpeg.wrap(payload))
    whole = mpeg.parse(bytes(media))
    media[whole.offsets[2] + 10] ^= 1  # side information under the checksum
    assert mpeg.parse(bytes(media)).bad == 1
    media[whole.offsets[4]] = 0  # a lost header
    hurt = mpeg.parse(bytes(media))
    assert len(hurt.offsets) < len(whole.offsets) and hurt.unsynced > 0 and hurt.offsets[-1] == whole.offsets[-1]
    junk = mpeg.parse(b"\xff\xfb\x90" + bytes(500))
    assert junk.offsets == [] and junk.duration is None
    assert mpeg.parse(b"").offsets == []


def test_headers_of_all_kinds():
    # MPEG 1 layer III, 128 kbit/s, 44.1 kHz; MPEG 2 layer III, 64 kbit/s, 22.05 kHz; layer I, 384 kbit/s, 48 kHz
    assert mpeg.header(bytes.fromhex("fffb9000")).length == 417
    two = mpeg.header(bytes.fromhex("fff38000"))
    assert (two.version, two.kbits, two.hertz, two.samples, two.length) == (20, 64, 22050, 576, 208)
    one = mpeg.header(bytes.fromhex("ffffc400"))
    assert (one.layer, one.kbits, one.samples, one.length) == (1, 384, 384, 384)
    for bad in ("fffb0000", "fffbf000", "fffb9c00", "ffeb9000", "ffe90000", "00fb9000"):
        assert mpeg.header(bytes.fromhex(bad)) is None


def bitwise(bits):
    value = 0xFFFF
    for b in bits:
        top = (value >> 15) ^ int(b)
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


#: Second, third and fourth byte of protected layer II headers, channels, subbands sent apart, bits of each subband's allocation.
SECOND = (
    ("fc8400", 2, 32, [4] * 11 + [3] * 12 + [2] * 4),  # 128 kbit/s, 48 kHz, stereo
    ("fc8000", 2, 32, [4] * 11 + [3] * 12 + [2] * 4),  # 128, 44.1
    ("fca050", 2, 8, [4] * 11 + [3] * 12 + [2] * 7),  # 192, 44.1, joint from the eighth subband
    ("fc80c0", 1, 32, [4] * 11 + [3] * 12 + [2] * 7),  # 128, 44.1, mono
    ("fc20c0", 1, 32, [4] * 2 + [3] * 6),  # 48, 44.1, mono
    ("fc28c0", 1, 32, [4] * 2 + [3] * 10),  # 48, 32, mono
    ("f48040", 2, 4, [4] * 4 + [3] * 7 + [2] * 19),  # MPEG 2: 64, 22.05, joint from the fourth subband
)


def test_checksums_of_layer_two():
    rnd = random.Random(1)
    assert sorted({sum(x[3]) for x in SECOND}) == [26, 38, 75, 88, 94]  # sums that the standard prints
    for head, channels, apart, widths in SECOND:
        for _ in range(20):
            bits = picks = ""
            for sb, width in enumerate(widths):
                for _ in range(channels if sb < apart else 1):
                    value = rnd.choice((0, rnd.randrange(1 << width)))
                    bits += f"{value:0{width}b}"
                    for _ in range((channels if sb >= apart else 1) if value else 0):
                        picks += f"{rnd.randrange(4):02b}"
            covered = bits + picks
            first = bytes.fromhex("ff" + head)
            h = mpeg.header(first)
            crc = bitwise(f"{int.from_bytes(first[2:]):016b}" + covered)
            filled = covered + "".join(rnd.choice("01") for _ in range(-len(covered) % 8))
            frame = (first + crc.to_bytes(2) + int(filled, 2).to_bytes(len(filled) // 8)).ljust(h.length, b"\x55")
            assert h.layer == 2 and h.protected and mpeg.second_bits(frame, 0, h) == len(covered)
            audio = mpeg.parse(frame * 3)
            assert (audio.checked, audio.bad, len(audio.offsets)) == (3, 0, 3)
            at = 48 + rnd.randrange(len(covered))
            hurt = bytearray(frame)
            hurt[at // 8] ^= 128 >> at % 8
            assert mpeg.parse(bytes(hurt) * 3).bad == 3
            at = 48 + len(covered)
            hurt = bytearray(frame)
            hurt[at // 8] ^= 128 >> at % 8  # the first bit that it does not cover
            assert mpeg.parse(bytes(hurt) * 3).bad == 0


def brute_feature(media):
    """Of files that wrap() makes: a tag of size bytes, then frames of 32 kHz, 1,152 samples each, by their rate alone."""
    at = 10 + (media[6] << 21 | media[7] << 14 | media[8] << 7 | media[9])
    rates = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    frames = []
    while at < len(media):
        rate = rates[media[at + 2] >> 4]
        frames.append((at, rate))
        at += 1152 // 8 * 1000 * rate // 32000
    frames = frames[1:]  # the first holds the table
    kbits = "+".join(f"{r}x{sum(x == r for _, x in frames)}" for r in sorted({x for _, x in frames}))
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o, _ in frames))
    n = len(frames)
    return f"frames={n};samples={1152 * n};hertz=32000;duration_us={36_000 * n};kbits={kbits};checked={n + 1};bad=0;unsynced=0;seek_crc32={seek}"


def test_features_of_short_and_very_long_texts(corpus):
    rnd = random.Random(4)
    texts = [None, "", "a", "é" * 500, "".join(rnd.choice("abc \n") for _ in range(3000)), "z" * 2_000_000]
    rows = {r.doc_id: r for r in mpeg.digests(corpus(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert rows[i].feature == brute_feature(mpeg.wrap(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))), i


def test_tags_at_both_ends():
    frames = mpeg.wrap(b"p" * 100)
    audio = mpeg.parse(frames + b"TAG" + b"Title".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(65))
    assert audio.tags == {"payload_bytes": "100", "TIT2": "Title", "TPE1": "Artist"} and audio.unsynced == 0


def test_query_columns(odd):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    rows = mpeg.digests(odd).collect()
    assert len(rows) == 10
    for r in rows:
        raw = next(t.encode() for t in texts[r.doc_id] if len(t.encode()) == r.n_bytes)
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert r.payload_bytes == len(payload) > 0 and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        media = mpeg.wrap(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    probed = mpeg.probe(mpeg.store(odd)).collect()
    assert all(p.n_frames >= 1 and p.bad == 0 and len(p.seek_offsets) == p.n_frames and p.duration_us == 36_000 * p.n_frames for p in probed)
    assert mpeg.digests(odd.limit(0)).count() == 0
