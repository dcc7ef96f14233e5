"""Operator 3, media columns: ISO base media containers walked without decoding payloads.

``mux`` stores bytes as fixed-size samples of one raw 8-bit track (ftyp, moov with the
sample tables, mdat); ``demux`` walks the nested boxes of any such container, resolves
stsz/stz2, stsc, stco/co64, stts and stss into byte ranges, the tables of movie fragments
(trex, tfhd, trun) too, and returns codec, duration and keyframe ranges. The payload is only
sliced, never decoded. Both are exact inverses.

A file says how many samples it has; none is believed to have more than bytes. Boxes deeper
than DEPTH, and tables that reach beyond their box, are errors of ``Broken``, so any bytes end
in tracks or in that.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from querent.llm.common import append, strings, table, texts

UNIT = 192
RATE = 8000
CHUNK = 32
KEY_EVERY = 16
CODEC = b"raw "
#: Boxes within boxes.
DEPTH = 32

#: Boxes whose payload is a list of boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Broken(ValueError):
    """Bytes that are no such container."""


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, *parts: bytes, flags: int = 0, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def timed(kind: bytes, before: bytes, duration: int, *parts: bytes, flags: int = 0) -> bytes:
    """A header box: two times, which are 0, then fields, a duration, and the rest; of the 64-bit version where the duration needs it."""
    wide = duration >= 1 << 32
    return full(kind, bytes(16 if wide else 8), before, struct.pack(">Q" if wide else ">I", duration), *parts, flags=flags, version=int(wide))


def padded(data: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of UNIT."""
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def mux(payload: bytes) -> bytes:
    """A container with one raw 8-bit mono track at RATE Hz; samples of UNIT bytes, CHUNK of them to a chunk."""
    if not payload or len(payload) % UNIT:
        raise ValueError("payload must be a positive multiple of the unit")
    n = len(payload) // UNIT
    duration = len(payload)
    chunks = -(-n // CHUNK)
    full_chunks, rest = divmod(n, CHUNK)
    runs = [(1, CHUNK, 1)] * bool(full_chunks) + [(full_chunks + 1, rest, 1)] * bool(rest)
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(CODEC, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">4HI", 1, 8, 0, 0, RATE << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(at: int) -> bytes:
        wide = at + len(payload) >= 1 << 32
        offsets = [at + i * CHUNK * UNIT for i in range(chunks)]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, n, UNIT)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full(b"stsz", struct.pack(">2I", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", struct.pack(">2H", 0, 0)), dinf, stbl)
        mdia = box(b"mdia", timed(b"mdhd", struct.pack(">I", RATE), duration, struct.pack(">2H", 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s3I", 0, b"soun", 0, 0, 0), b"samples\0"), minf)
        tkhd = timed(b"tkhd", struct.pack(">2I", 1, 0), duration, b"\0" * 8, struct.pack(">4H", 0, 0, 0x100, 0), _MATRIX, struct.pack(">2I", 0, 0), flags=7)
        mvhd = timed(b"mvhd", struct.pack(">I", RATE), duration, struct.pack(">IHH2I", 0x10000, 0x100, 0, 0, 0), _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + head), box(b"mdat", payload)))


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the payload of each box in a range; a size of 1 is a 64-bit one, 0 reaches to the end."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise Broken(f"box {kind!r} at {start} does not fit")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: list[tuple[int, int]] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)

    @property
    def key_ranges(self) -> list[tuple[int, int]]:
        return [self.samples[k - 1] for k in self.keys if 0 < k <= len(self.samples)]


Boxes = dict[bytes, tuple[int, int]]


def _ints(data: memoryview, at: Boxes, kind: bytes, skip: int, n: int, code: str = "I") -> tuple[int, ...]:
    """n numbers of a box, all within it."""
    start, end = at[kind]
    if start + skip + n * struct.calcsize(">" + code) > end:
        raise Broken(f"the table {kind!r} is cut short")
    return struct.unpack_from(f">{n}{code}", data, start + skip)


def _tables(data: memoryview, at: Boxes) -> Track:
    """A track by its sample tables."""

    def ints(kind: bytes, skip: int, n: int, code: str = "I") -> tuple[int, ...]:
        return _ints(data, at, kind, skip, n, code)

    track = Track()
    if b"tkhd" in at:
        (track.number,) = ints(b"tkhd", 20 if data[at[b"tkhd"][0]] == 1 else 12, 1)
    if b"mdhd" in at:
        track.timescale, track.duration = (*ints(b"mdhd", 20, 1), *ints(b"mdhd", 24, 1, "Q")) if data[at[b"mdhd"][0]] == 1 else ints(b"mdhd", 12, 2)
    if b"stsd" in at:
        track.codec = struct.pack(">I", *ints(b"stsd", 12, 1)).decode("latin-1")
    if b"stts" in at:
        (n,) = ints(b"stts", 4, 1)
        runs = ints(b"stts", 8, 2 * n)
        track.duration = sum(a * b for a, b in zip(runs[::2], runs[1::2], strict=True)) or track.duration
    if b"stsz" in at:
        same, n = ints(b"stsz", 4, 2)
        if same and n * same > len(data):
            raise Broken("more samples than bytes")
        sizes = (same,) * n if same else ints(b"stsz", 12, n)
    elif b"stz2" in at:
        ((word, n),) = (ints(b"stz2", 4, 2),)
        bits = word & 255
        if bits == 4:
            sizes = tuple(x for byte in ints(b"stz2", 12, (n + 1) // 2, "B") for x in (byte >> 4, byte & 15))[:n]
        elif bits in (8, 16):
            sizes = ints(b"stz2", 12, n, {8: "B", 16: "H"}[bits])
        else:
            raise Broken(f"sizes of {bits} bits")
    else:
        sizes = ()
    wide = b"co64" in at
    where = b"co64" if wide else b"stco"
    chunks = ints(where, 8, ints(where, 4, 1)[0], "Q" if wide else "I") if where in at else ()
    flat = ints(b"stsc", 8, 3 * ints(b"stsc", 4, 1)[0]) if b"stsc" in at else ()
    firsts, per = flat[::3], flat[1::3]
    i = 0
    for number, offset in enumerate(chunks, 1):
        if i >= len(sizes):
            break
        run = bisect_right(firsts, number) - 1
        for _ in range(min(per[run], len(sizes) - i) if run >= 0 else 0):
            track.samples.append((offset, offset + sizes[i]))
            offset += sizes[i]
            i += 1
    track.keys = list(ints(b"stss", 8, ints(b"stss", 4, 1)[0])) if b"stss" in at else list(range(1, len(track.samples) + 1))
    return track


#: Optional fields of a fragment's header and of its runs, in order: flag and number of bytes.
_HEADER = ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4), (0x20, 4))
_RUN, _SAMPLE = ((0x1, 4), (0x4, 4)), ((0x100, 4), (0x200, 4), (0x400, 4), (0x800, 4))
#: A sample's flag that tells it is no keyframe.
_NO_KEY = 0x10000


def _optional(data: memoryview, at: int, end: int, flags: int, fields: tuple[tuple[int, int], ...]) -> tuple[dict[int, int], int]:
    """The fields that the flags say are there, and the place after them."""
    found = {}
    for flag, size in fields:
        if flags & flag:
            if at + size > end:
                raise Broken("a fragment is cut short")
            found[flag] = int.from_bytes(data[at : at + size], "big")
            at += size
    return found, at


def _fragment(data: memoryview, track: Track, header: tuple[int, int], runs: list[tuple[int, int]], defaults: tuple[int, int, int], moof: int) -> None:
    """Adds the samples of a fragment's runs. defaults: duration, size and flags of a sample."""
    start, end = header
    if start + 8 > end:
        raise Broken("a fragment is cut short")
    own, _ = _optional(data, start + 8, end, int.from_bytes(data[start + 1 : start + 4], "big"), _HEADER)
    duration, size, flags = (own.get(flag, x) for flag, x in zip((0x8, 0x10, 0x20), defaults, strict=True))
    base = own.get(0x1, moof)
    at = base
    for start, end in runs:
        if start + 8 > end:
            raise Broken("a fragment is cut short")
        told = int.from_bytes(data[start + 1 : start + 4], "big")
        n = int.from_bytes(data[start + 4 : start + 8], "big")
        head, place = _optional(data, start + 8, end, told, _RUN)
        each = sum(4 for flag, _ in _SAMPLE if told & flag)
        if n * each > end - place or not each and n * max(1, size) > len(data):
            raise Broken("more samples than bytes")
        if 0x1 in head:
            at = base + head[0x1] - (head[0x1] >> 31 << 32)  # a signed number
        for i in range(n):
            sample, place = _optional(data, place, end, told, _SAMPLE)
            length = sample.get(0x200, size)
            mark = sample.get(0x400, head[0x4] if i == 0 and 0x4 in head else flags)
            track.samples.append((at, at + length))
            track.duration += sample.get(0x100, duration)
            if not mark & _NO_KEY:
                track.keys.append(len(track.samples))
            at += length


def demux(media: bytes) -> list[Track]:
    """Tracks of a container; Broken or struct.error if it is not one."""
    data = memoryview(media)
    tracks: list[Track] = []
    tables: list[Boxes] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[int, Boxes, list[tuple[int, int]]]] = []  # start of the moof, boxes of a traf, its runs
    ranges = [(0, len(data), 0, None, 0)]  # start, end, depth, boxes of the track or fragment around, start of the moof
    while ranges:
        start, end, depth, at, moof = ranges.pop()
        if depth > DEPTH:
            raise Broken("boxes nested too deep")
        below = []
        for kind, s, e in walk(data, start, end):
            if kind == b"trak":
                tables.append({})
                below.append((s, e, depth + 1, tables[-1], moof))
            elif kind == b"traf":
                fragments.append((moof, {}, []))
                below.append((s, e, depth + 1, fragments[-1][1], moof))
                fragments[-1][2].extend((rs, re_) for k, rs, re_ in walk(data, s, e) if k == b"trun")
            elif kind in CONTAINERS:
                below.append((s, e, depth + 1, at, s - 8 if kind == b"moof" else moof))
            elif kind == b"trex" and e - s >= 24:
                number, _, *own = struct.unpack_from(">5I", data, s + 4)
                defaults[number] = tuple(own)
            elif at is not None:
                at.setdefault(kind, (s, e))
        ranges += below[::-1]
    tracks = [_tables(data, x) for x in tables]
    by = {t.number: t for t in tracks[::-1]}
    for moof, at, runs in fragments:
        if b"tfhd" not in at:
            raise Broken("a fragment without a header")
        (number,) = _ints(data, at, b"tfhd", 4, 1)
        if number not in by:
            raise Broken("a fragment of no track")
        if not by[number].samples:
            by[number].duration = 0  # what the header of a fragmented track says is none
        _fragment(data, by[number], at[b"tfhd"], runs, defaults.get(number, (0, 0, 0)), moof)
    return tracks


def payload(media: bytes, track: Track) -> bytes:
    """The samples of a track in order; adjoining ones are sliced together."""
    out: list[bytes] = []
    start = end = -1
    for s, e in track.samples:
        if e > len(media):
            raise ValueError("sample beyond the end")
        if s == end:
            end = e
        else:
            if end > start >= 0:
                out.append(media[start:end])
            start, end = s, e
    if end > start >= 0:
        out.append(media[start:end])
    return b"".join(out)


def inspect(df: DataFrame, column: str = "media") -> DataFrame:
    """Adds codec, duration_ms, n_samples, keyframes (array of byte ranges) of the first track, and error.

    Null or broken containers: null values, and the reason in error.
    """

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None, None, None, None, "null")
        tracks = demux(media)
        if not tracks:
            raise Broken("no track")
        track = tracks[0]
        ranges = track.key_ranges
        duration = track.duration * 1000 // max(1, track.timescale)
        if duration >= 1 << 63 or any(not 0 <= s <= e < 1 << 63 for s, e in ranges):
            raise Broken("numbers beyond 63 bits")
        return (track.codec, duration, len(track.samples), [{"start": s, "end": e} for s, e in ranges], None)

    def work(array: pa.Array) -> list[pa.Array]:
        rows: list[tuple] = []
        for media in array.to_pylist():
            try:
                rows.append(one(media))
            except (Broken, struct.error) as e:
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        return [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]

    return append(df, column, "codec string, duration_ms long, n_samples long, keyframes array<struct<start:long,end:long>>, error string", work)


def store(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds media (binary): the column's UTF-8 bytes, padded, in a container. Null: as empty."""
    return append(docs, column, "media binary", lambda a: [pa.array([mux(padded(x.encode())) for x in strings(a)], type=pa.binary())])


def _digest(array: pa.Array) -> list[pa.Array]:
    rows = []
    for text in strings(array):
        raw = text.encode()
        media = mux(padded(raw))
        (track,) = demux(media)
        back = payload(media, track)
        keys = track.key_ranges
        spans = zlib.crc32(struct.pack(f">{2 * len(keys)}Q", *(x for r in keys for x in r)))
        feature = f"{track.codec.strip()}/{track.timescale}; {track.duration / track.timescale:.3f} s; {len(track.samples)} samples; {len(keys)} keyframes {keys[0][0]}-{keys[-1][1]} crc {spans:08x}"
        rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)]


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through a container and back: sizes, digests and features of the stored form."""
    return append(texts(table(spark, sf_dir, "documents")), "text", DIGEST, _digest).drop("text")
