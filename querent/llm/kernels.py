"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow batch at a time with numpy: words are found
and hashed by array operations over the UTF-8 bytes, never in a loop over words.
A batch is cut into pieces of whole documents of at most ``PIECE`` bytes (one
longer document is its own piece), so memory follows the longest document.

Null texts are empty texts in every kernel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 2**64))

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls and grown by doubling."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        seed = np.full(size, base, dtype=np.uint64)
        seed[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(seed)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))  # an array of its own from here on
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
        return x


def sums(values: np.ndarray) -> np.ndarray:
    """Of values (uint64): what ``windows`` and ``runs`` hash from."""
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values * _power("up", _BASE, len(values)), out=total[1:])
    return total


def runs(total: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive values from each of some places on, by the ``sums`` of all."""
    with np.errstate(over="ignore"):
        return mix((total[at + k] - total[at]) * _power("down", _BASE_INV, len(total))[at])


def windows(values: np.ndarray, k: int, total: np.ndarray | None = None) -> np.ndarray:
    """Hash of every run of k consecutive values (uint64); length len(values) - k + 1 or 0. total: their ``sums``."""
    n = len(values)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    total = sums(values) if total is None else total
    with np.errstate(over="ignore"):
        return mix((total[k:] - total[:-k]) * _power("down", _BASE_INV, n - k + 1))


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 4096
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[starts:ends] for every pair: eight bytes at a time through a bijective mixer, so no pattern of bytes cancels out."""
    eight = eights(data)
    size = ends - starts
    out = mix(size.astype(np.uint64) + _BASE)
    live = np.flatnonzero(size <= LONG_WORD) if len(size) and size.max() > LONG_WORD else np.arange(len(size))
    at = 0
    while len(live):
        part = np.minimum(size[live] - at, 8)
        out[live] = mix(out[live] ^ (eight[starts[live] + at] & _MASK[part]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest())
    return out


def equal_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sizes bytes from ``at`` on and from ``to`` on are the same, byte by byte; a and b are eights()."""
    same = np.arange(len(at))
    step = 0
    while len(same) and step < max(1, int(sizes[same].max())):
        place = np.maximum(np.minimum(step, sizes[same] - 8), 0)
        same = same[(a[at[same] + place] ^ b[to[same] + place]) & _MASK[np.minimum(sizes[same], 8)] == 0]
        step += 8
    out = np.zeros(len(at), dtype=bool)
    out[same] = True
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a first index of each, number of each) of strings that differ in a byte; hashes only propose which are the same."""
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    eight = eights(data)
    others = np.flatnonzero(first[of] != np.arange(len(of)))
    like = first[of[others]]
    same = (sizes[others] == sizes[like]) & equal_spans(eight, starts[others], eight, starts[like], np.minimum(sizes[others], sizes[like]))
    alone = others[~same]
    known: dict[tuple[int, bytes], int] = {}
    more: list[int] = []
    for i in alone.tolist():
        key = (int(of[i]), data[starts[i] : starts[i] + sizes[i]].tobytes())
        if key not in known:
            known[key] = len(first) + len(more)
            more.append(i)
        of[i] = known[key]
    return np.concatenate([first, np.array(more, dtype=np.int64)]), of


def crowded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Keys that more than ``most`` different strings have."""
    names, of, times = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[of] > most)
    if not len(at):
        return names[:0]
    first, _ = distinct_spans(data, starts[at], sizes[at], spans(data, starts[at], starts[at] + sizes[at]))
    names, times = np.unique(keys[at[first]], return_counts=True)
    return names[times > most]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values; length len(values) - w + 1 or 0."""
    if len(values) < w:
        return values[:0]
    size = 1
    while size * 2 <= w:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = w - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


#: Lowest bits of a gram that winnow gives to its place.
PLACE_BITS = 24


def winnow(grams: np.ndarray, w: int, bits: int = PLACE_BITS) -> np.ndarray:
    """For every w consecutive grams (at most 2**bits), the index of the leftmost least one.

    Order is by the bits above the lowest, so equal content always picks the same place.
    More than 2**bits grams are taken in stretches that overlap by w - 1.
    """
    size = 1 << bits
    if w > size:
        raise ValueError(f"a window of {w} grams is longer than a stretch")
    low = _U(size - 1)
    out = np.empty(max(0, len(grams) - w + 1), dtype=np.int64)
    for at in range(0, len(out), size - w + 1):
        part = grams[at : at + size]
        least = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), w)
        out[at : at + len(least)] = (least & low).astype(np.int64) + at
    return out


@dataclass
class Piece:
    """Some whole documents: their bytes end to end."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def pieces(texts: pa.Array | pa.ChunkedArray, limit: int = PIECE) -> Iterator[Piece]:
    """Cuts a string column into pieces of whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    lengths = np.diff(offsets)
    if texts.null_count:
        lengths = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = first + 1
        size = lengths[first]
        while last < n and size + lengths[last] <= limit and last - first < 65536:
            size += lengths[last]
            last += 1
        own = np.zeros(last - first + 1, dtype=np.int64)
        np.cumsum(lengths[first:last], out=own[1:])
        if own[-1] == offsets[last] - offsets[first]:
            block = raw[offsets[first] : offsets[last]]
        else:
            block = np.concatenate([raw[offsets[i] : offsets[i] + lengths[i]] for i in range(first, last)])
        yield Piece(first, block, own)
        first = last


@dataclass
class Words:
    """Words of a piece: byte ranges, hashes, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def separators(inside: str) -> np.ndarray:
    """Table of the bytes that separate words.

    ``space``: 0x20 and 0x09-0x0D. ``alnum``: all ASCII but digits and letters.
    """
    table = np.zeros(256, dtype=bool)
    if inside == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif inside == "alnum":
        table[:0x80] = True
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = False
    else:
        raise ValueError(inside)
    return table


SPACE = separators("space")
ALNUM = separators("alnum")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else unchanged."""
    return _LOWER[data]


def words(piece: Piece, table: np.ndarray, fold: bool) -> Words:
    """Finds and hashes the words of a piece; no word crosses a document."""
    data = lower(piece.data) if fold else piece.data
    n = len(data)
    inside = np.ones(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(table[data], out=inside[1:-1])
    cut = np.zeros(n + 1, dtype=bool)
    cut[piece.offsets] = True
    body = inside[1:-1]
    starts = np.flatnonzero(body & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(body & (~inside[2:] | cut[1:])) + 1
    return Words(starts, ends, spans(data, starts, ends), np.searchsorted(starts, piece.offsets))


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of every word, from the first words of the documents."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spread(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that stay within one document, ascending."""
    sizes = np.maximum(np.diff(first) - k + 1, 0)
    if not sizes.sum():
        return np.empty(0, dtype=np.int64)
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return base + np.arange(sizes.sum())
