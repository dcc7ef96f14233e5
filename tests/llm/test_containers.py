"""Containers of any bytes, and fragmented ones."""

from __future__ import annotations

import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm import media_columns as M


def read(media: bytes) -> list[M.Track] | None:
    try:
        return M.demux(media)
    except (M.Broken, struct.error):
        return None


def tables(n: int, same: int) -> bytes:
    return M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.box(b"minf", M.box(b"stbl", M.full(b"stsz", struct.pack(">2I", same, n)), M.full(b"stco", struct.pack(">2I", 1, 0)), M.full(b"stsc", struct.pack(">4I", 1, 1, 0xFFFFFFFF, 1)))))))


def test_nested_boxes_end_in_an_error():
    media = b""
    for _ in range(3000):
        media = M.box(b"moov", media)
    with pytest.raises(M.Broken, match="deep"):
        M.demux(media)


def test_a_claim_of_samples_is_held_against_the_bytes():
    began = time.time()
    for media in (tables(0xFFFFFFFF, 1), tables(1 << 26, 1), tables(0xFFFFFFFF, 0), tables(1 << 26, 0)):
        assert read(media) is None
    assert time.time() - began < 1
    (track,) = M.demux(tables(5, 4))
    assert track.samples == [(4 * i, 4 * i + 4) for i in range(5)]


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12))
def test_changed_bytes_give_tracks_or_an_error(seed, changes):
    rng = random.Random(seed)
    media = bytearray(M.mux(M.padded(bytes(rng.randrange(256) for _ in range(rng.randrange(2000))))) if seed % 2 else fragmented()[0])
    for _ in range(changes):
        at = rng.randrange(len(media) if rng.random() < 0.3 else min(len(media), 700))
        media[at : at + 4] = rng.choice([b"\xff\xff\xff\xff", b"\0\0\0\0", b"\0\0\0\x01", b"moov", b"trak", b"trun", bytes([rng.randrange(256)])])
    read(bytes(media[: rng.randrange(len(media) + 1)] if rng.random() < 0.3 else media))


def test_changed_bytes_in_a_column(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, b""), (2, b"\0" * 40), (3, M.box(b"moov")), (4, M.mux(M.padded(b"x"))), (5, fragmented()[0]), (6, tables(0xFFFFFFFF, 1)), (7, M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.full(b"mdhd", struct.pack(">2QIQI", 0, 0, 1, 2**64 - 1, 0), version=1)))))]
    for i in range(60):
        media = bytearray(M.mux(M.padded(b"abc" * i)))
        media[rng.randrange(500)] = rng.randrange(256)
        rows.append((10 + i, bytes(media)))
    got = {r["id"]: r for r in M.inspect(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert len(got) == len(rows) and [got[i]["error"] is None for i in range(8)] == [False, False, False, False, True, True, False, False]
    assert all((r["error"] is None) == (r["codec"] is not None) for r in got.values())


def fragmented() -> tuple[bytes, list[bytes]]:
    """Two fragments of one track: the first with sizes in its runs, the second with those of its header and of trex."""
    rng = random.Random(1)
    samples = [bytes(rng.randrange(256) for _ in range(n)) for n in (5, 9, 2, 7, 7, 4, 4, 4)]
    mdhd = M.timed(b"mdhd", struct.pack(">I", 1000), 0, struct.pack(">2H", 0, 0))
    tkhd = M.timed(b"tkhd", struct.pack(">2I", 7, 0), 0, bytes(60))
    stsd = M.full(b"stsd", struct.pack(">I", 1), M.box(b"avc1", bytes(8)))
    trak = M.box(b"trak", tkhd, M.box(b"mdia", mdhd, M.box(b"minf", M.box(b"stbl", stsd))))
    moov = M.box(b"moov", trak, M.box(b"mvex", M.full(b"trex", struct.pack(">5I", 7, 1, 40, 4, 0x10000))))

    def fragment(tfhd, runs, data):
        def moof(offsets):
            return M.box(b"moof", M.full(b"mfhd", struct.pack(">I", 1)), M.box(b"traf", tfhd, *[run(x) for run, x in zip(runs, offsets, strict=True)]))

        sizes = [len(x) for x in data]
        head = len(moof([0] * len(runs))) + 8
        return moof([head + sum(sizes[:i]) for i in range(len(runs))]) + M.box(b"mdat", *data)

    # run of three samples: offset, first flags (a keyframe), durations and sizes of each; then one of two with flags of each
    first = lambda x: M.full(b"trun", struct.pack(">Ii", 3, x), struct.pack(">I", 0), *(struct.pack(">2I", 10 * k, len(s)) for k, s in enumerate(samples[:3], 1)), flags=0x1 | 0x4 | 0x100 | 0x200)
    second = lambda x: M.full(b"trun", struct.pack(">Ii", 2, x), *(struct.pack(">2I", 7, f) for f in (0x10000, 0)), flags=0x1 | 0x200 | 0x400)
    third = lambda x: M.full(b"trun", struct.pack(">Ii", 3, x), flags=0x1)
    one = fragment(M.full(b"tfhd", struct.pack(">II", 7, 100), flags=0x20000 | 0x8), [first, second], [b"".join(samples[:3]), b"".join(samples[3:5])])
    two = fragment(M.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), [third], [b"".join(samples[5:])])
    return M.box(b"ftyp", b"iso5", bytes(4)) + moov + one + two, samples


def test_fragments():
    media, samples = fragmented()
    (track,) = M.demux(media)
    assert [media[s:e] for s, e in track.samples] == samples and M.payload(media, track) == b"".join(samples)
    assert (track.codec, track.timescale, track.duration) == ("avc1", 1000, 10 + 20 + 30 + 2 * 100 + 3 * 40)
    # the first run's first sample, then those that its header and trex do not mark as others
    assert track.keys == [1, 5]


def test_a_fragment_of_no_track():
    with pytest.raises(M.Broken, match="no track"):
        M.demux(M.box(b"moof", M.box(b"traf", M.full(b"tfhd", struct.pack(">I", 3)))))
