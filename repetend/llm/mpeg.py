"""Media columns: MPEG audio files in a binary column.

parse() walks any bytes: it skips ID3v2 and ID3v1 tags and reads their text frames, finds frame headers (MPEG 1, 2 and
2.5, layers I to III), accepts a header after lost synchronisation only if the next one agrees with it, reads Xing, Info
and VBRI tables, verifies the 16-bit checksums of protected frames of all three layers, and gives exact durations
and the byte offset of every frame.

wrap() stores bytes without loss as a valid silent MPEG 1 layer III stream: every frame has an empty side information
block under a checksum, and the payload stands in the ancillary bytes after it. The last frame takes the smallest
bitrate that holds the rest, so the rate varies and the file begins with a Xing table and its seek points.

Defined results: a null text is an empty payload, an empty payload is one block of 64 zero bytes; bytes without any
frame have no frames and a null duration; damaged frames are skipped and counted as bytes out of synchronisation, and so are frames of free format, which state no bitrate.
Equal texts give equal bytes. Rows stand on their own; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repetend.llm._common import map_slices

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index, samples of a frame.
RATES_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {10: (44100, 48000, 32000), 20: (22050, 24000, 16000), 25: (11025, 12000, 8000)}

#: Layer II, fixed as well: (subbands, bits of an allocation) from the lowest subband on. Of MPEG 1: middle rates, high rates,
#: low rates, low rates at 32 kHz; of MPEG 2: all.
ALLOCATIONS = {
    "middle": ((11, 4), (12, 3), (4, 2)),
    "high": ((11, 4), (12, 3), (7, 2)),
    "low": ((2, 4), (6, 3)),
    "low 32": ((2, 4), (10, 3)),
    "half": ((4, 4), (7, 3), (19, 2)),
}

BLOCK = 64
#: wrap(): 32 kHz mono, layer III, with checksum.
WRAP_HERTZ, HEAD = 32000, 4 + 2 + 17


class Header(NamedTuple):
    version: int  # 10, 20 or 25
    layer: int
    protected: bool
    kbits: int
    hertz: int
    length: int
    samples: int
    mono: bool
    mode: int
    extension: int


@lru_cache(4096)
def header(four: bytes) -> Header | None:
    """What four bytes say if they are a frame header with a stated bitrate."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 10, 2: 20, 0: 25}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate, speed, pad, mode = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1, four[3] >> 6
    if version is None or layer == 4 or rate in (0, 15) or speed == 3 or four[3] & 3 == 2:
        return None
    kbits = (RATES_1 if version == 10 else RATES_2)[layer][rate]
    hertz = HERTZ[version][speed]
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 10 else 1152
    length = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + pad
    return Header(version, layer, not four[1] & 1, kbits, hertz, length, samples, mode == 3, mode, four[3] >> 4 & 3)


_TABLE = []
for _i in range(256):
    _v = _i << 8
    for _ in range(8):
        _v = (_v << 1 ^ 0x8005 if _v & 0x8000 else _v << 1) & 0xFFFF
    _TABLE.append(_v)


@lru_cache(65536)
def crc16(data: bytes, bits: int = 0) -> int:
    """CRC-16 with polynomial 0x8005 and start 0xFFFF, highest bit first; of the last byte only so many bits, if given."""
    value = 0xFFFF
    for byte in data[:-1] if bits else data:
        value = (value << 8 & 0xFF00) ^ _TABLE[value >> 8 ^ byte]
    for k in range(bits):
        value ^= (data[-1] >> 7 - k & 1) << 15
        value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def allocation(h: Header) -> str:
    """Which of ALLOCATIONS a layer II frame follows."""
    each = h.kbits if h.mono else h.kbits // 2
    if h.version > 10:
        return "half"
    if each <= 48:
        return "low 32" if h.hertz == 32000 else "low"
    return "middle" if h.hertz == 48000 or each <= 80 else "high"


def second_bits(data: bytes, at: int, h: Header) -> int:
    """Bits after the checksum of a layer II frame that it covers: allocations, and a selection for each that is not nought."""
    field = int.from_bytes(data[at + 6 : at + 46].ljust(40, b"\0"))
    shared = 4 * (h.extension + 1) if h.mode == 1 else 32
    used = coded = 0
    for subband, width in enumerate(width for n, width in ALLOCATIONS[allocation(h)] for _ in range(n)):
        alone = h.mono or subband < shared
        for _ in range(1 if h.mono or not alone else 2):
            used += width
            if field >> 320 - used & (1 << width) - 1:
                coded += 1 if alone else 2
    return used + 2 * coded


def intact(data: bytes, at: int, h: Header) -> bool:
    """Whether the checksum of a protected frame is that of what it covers."""
    bits = second_bits(data, at, h) if h.layer == 2 else 8 * side_length(h)
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8], bits % 8) == int.from_bytes(data[at + 4 : at + 6])


def side_length(h: Header) -> int:
    """Bytes that the checksum covers after it in layers III and I."""
    if h.layer == 3:
        return (17 if h.mono else 32) if h.version == 10 else (9 if h.mono else 17)
    if h.layer == 1:
        shared = 4 * (h.extension + 1) if h.mode == 1 else 32
        return (32 * 4 if h.mono else (shared * 2 + 32 - shared) * 4) // 8
    return 0


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _text(body: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0]) if body else None
    return body[1:].decode(kind, "replace").strip("\0") if kind else ""


def tags_at(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of ID3v2 tags at the start, and where the audio begins."""
    found: dict[str, str] = {}
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
        p, end = at + 10, min(at + 10 + size, len(data))
        name, head = (3, 6) if major == 2 else (4, 10)
        if flags & 0x40 and major > 2 and p + 4 <= end:  # extended header
            p += _syncsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4])
        while p + head <= end and data[p] != 0:
            key = data[p : p + name].decode("latin-1")
            long = int.from_bytes(data[p + 3 : p + 6]) if major == 2 else _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8])
            body = data[p + head : min(p + head + long, end)]
            if key in ("TXXX", "TXX"):
                key, _, value = _text(body).partition("\0")
                found[key] = value
            elif key.startswith("T"):
                found[key] = _text(body)
            p += head + long
        at = at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    return found, min(at, len(data))


class Audio(NamedTuple):
    tags: dict[str, str]
    offsets: list[int]  # of audio frames, without the table's frame
    lengths: list[int]
    heads: list[int]  # bytes of each frame before its ancillary data, if its side information is empty
    samples: int
    hertz: int | None
    duration: Fraction | None
    kbits: dict[int, int]
    checked: int
    bad: int
    unsynced: int
    table: dict | None


def _table_of(data: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at `at`."""
    p = at + 4 + (2 if h.protected else 0) + side_length(h)
    kind = data[p : p + 4]
    if h.layer == 3 and kind not in (b"Xing", b"Info") and h.protected:
        p, kind = p - 2, data[p - 2 : p + 2]
    if kind in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[p + 4 : p + 8]), p + 8
        out = {"kind": kind.decode()}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], p = int.from_bytes(data[p : p + 4]), p + 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        n, scale, width = (int.from_bytes(data[p + i : p + i + 2]) for i in (18, 20, 22))
        steps = [int.from_bytes(data[p + 26 + i * width : p + 26 + (i + 1) * width]) * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": int.from_bytes(data[p + 10 : p + 14]), "frames": int.from_bytes(data[p + 14 : p + 18]), "toc": steps}
    return None


def parse(data: bytes) -> Audio:
    tags, at = tags_at(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[end + lo : end + hi].rstrip(b"\0 ").decode("latin-1"):
                tags.setdefault(key, value)
    offsets, lengths, heads, kbits = [], [], [], Counter()
    samples = checked = bad = unsynced = 0
    hertz = table = None
    duration, synced = Fraction(0), False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        fits = h is not None and h.length >= 4 and at + h.length <= end
        if fits and not synced:  # after a loss the next header has to agree, or the data to end there
            after = header(data[at + h.length : at + h.length + 4])
            fits = at + h.length == end or after is not None and (after.version, after.layer, after.hertz) == (h.version, h.layer, h.hertz)
        if not fits:
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            unsynced, at, synced = unsynced + following - at, following, False
            continue
        if h.protected:
            checked += 1
            bad += not intact(data, at, h)
        if not synced and table is None and not offsets and (table := _table_of(data, at, h)):
            pass
        else:
            offsets.append(at)
            lengths.append(h.length)
            heads.append(4 + 2 * h.protected + side_length(h))
            samples += h.samples
            duration += Fraction(h.samples, h.hertz) if hertz not in (None, h.hertz) else 0
            hertz = hertz or h.hertz
            kbits[h.kbits] += 1
        at, synced = at + h.length, True
    unsynced += max(0, end - at)
    same = sum(kbits.values())
    if not offsets:
        exact = None
    else:
        exact = Fraction(samples, hertz) if duration == 0 else sum((Fraction(header(data[o : o + 4]).samples, header(data[o : o + 4]).hertz) for o in offsets), Fraction(0))
    return Audio(tags, offsets, lengths, heads, samples if same else 0, hertz, exact, dict(kbits), checked, bad, unsynced, table)


@lru_cache(64)
def _frame_head(kbits_index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information; bytes of payload that follow."""
    four = bytes((0xFF, 0xFA, kbits_index << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    return four + crc16(four[2:] + side).to_bytes(2) + side, header(four).length - HEAD


def wrap(payload: bytes) -> bytes:
    """An MPEG audio file that holds the payload."""
    full, room = _frame_head(14)
    frames = [full + payload[i : i + room] for i in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room :]:
        head, space = next(x for x in map(_frame_head, range(1, 15)) if x[1] >= len(rest))
        frames.append(head + rest + bytes(space - len(rest)))
    body = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(body).to_bytes(4) + b"\0\0" + body
    size = len(tag)
    tag = b"ID3\x03\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + tag
    head, space = next(x for x in map(_frame_head, range(1, 15)) if x[1] >= 116)
    first = len(head) + space
    total = first + sum(map(len, frames))
    ends = [first]
    for x in frames:
        ends.append(ends[-1] + len(x))
    toc = bytes(min(255, ends[i * len(frames) // 100] * 256 // total) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4) + len(frames).to_bytes(4) + total.to_bytes(4) + toc
    return b"".join((tag, head, xing, bytes(space - len(xing)), *frames))


def unwrap(data: bytes, audio: Audio | None = None) -> bytes:
    """The payload of what wrap() made, from its parsed frames."""
    audio = audio or parse(data)
    body = b"".join([data[o + h : o + n] for o, n, h in zip(audio.offsets, audio.lengths, audio.heads, strict=True)])
    return body[: int(audio.tags["payload_bytes"])]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of a text: how many, and padded to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def feature(audio: Audio) -> str:
    rates = "+".join(f"{k}x{n}" for k, n in sorted(audio.kbits.items()))
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in audio.offsets))
    micros = audio.duration and audio.duration * 1_000_000
    return f"frames={len(audio.offsets)};samples={audio.samples};hertz={audio.hertz};duration_us={micros};kbits={rates};checked={audio.checked};bad={audio.bad};unsynced={audio.unsynced};seek_crc32={seek}"


AUDIO_COLUMNS = T.StructType(
    [T.StructField("n_frames", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("hertz", T.LongType())]
    + [T.StructField("duration_us", T.DoubleType()), T.StructField("checked", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("unsynced", T.LongType())]
    + [T.StructField("seek_offsets", T.ArrayType(T.LongType())), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))]
)


def probe(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """The key and AUDIO_COLUMNS of each row's bytes; null bytes are empty."""
    schema = T.StructType([media.schema[key], *AUDIO_COLUMNS])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        def run(batch: pa.RecordBatch) -> dict:
            found = [parse(x or b"") for x in batch.column("media").to_pylist()]
            return {
                key: batch.column(key),
                "n_frames": [len(a.offsets) for a in found],
                "samples": [a.samples for a in found],
                "hertz": [a.hertz for a in found],
                "duration_us": [None if a.duration is None else float(a.duration * 1_000_000) for a in found],
                "checked": [a.checked for a in found],
                "bad": [a.bad for a in found],
                "unsynced": [a.unsynced for a in found],
                "seek_offsets": [a.offsets for a in found],
                "tags": [list(a.tags.items()) for a in found],
            }

        return run

    return map_slices(media.select(key, F.col(column).cast("binary").alias("media")), kernel, schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the media bytes that hold each text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("media", T.BinaryType())])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        return lambda batch: {"doc_id": batch.column("doc_id"), "media": [wrap(payload_of(x)[1]) for x in batch.column("text").to_pylist()]}

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Digests of each text's stored media, all of them from the bytes read back."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.StringType() if n.endswith("sha256") or n == "feature" else T.LongType()) for n in names]])

    def kernel() -> Callable[[pa.RecordBatch], dict]:
        def one(text: str | None) -> tuple:
            n, payload = payload_of(text)
            media = wrap(payload)
            audio = parse(media)
            back = unwrap(media, audio)
            return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)

        def run(batch: pa.RecordBatch) -> dict:
            rows = [one(x) for x in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

        return run

    return map_slices(docs.select("doc_id", F.col("text").cast("string").alias("text")), kernel, schema)
