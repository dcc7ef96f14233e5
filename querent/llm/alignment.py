"""Operator 13, which tokens of two tokenizers cover the same bytes, and in how many documents.

A text is encoded by both tokenizers; byte offsets at which a token of either ends cut the
tokens into groups, and all A-B pairs of a group are linked. A pair of ids is one packed
int64 key, A's id in the upper half. Counting takes three steps: each task merges its
documents' distinct keys by np.unique into partial counts; these are range-partitioned,
sorted, and summed over runs; each partition becomes a shard of two sorted arrays in the
shared folder. A second pass over the stored links maps the shards into memory and looks
keys up by searchsorted, so nothing is broadcast but the highest count of each A id, whose
size the vocabulary bounds. Where the shared folder is no mounted path (an object store),
the same counts are joined with the links instead, hot keys apart.

Both tokenizers end a token wherever a space follows a character that is not white space
(``Pair`` checks that of the vocabularies), so a text is encoded piece by piece between such
places, and the ids of pieces seen before come from a cache. ``Pair.whole`` is the plain path,
which also takes texts that a piece does not give back byte for byte. Groups and links of many
documents are made at once from the offsets.

Null and empty texts, and texts whose tokens do not spell them, have no tokens: zeros and
an empty groups_sha256. Repeated rows are documents each. Columns besides doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm.common import hot_join, shared_folder, strings, table, texts

#: The tokenizers of op13_alignment.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces whose ids a worker keeps, and their characters, twice at most; then those that are not used again go. Bounds memory only.
CACHE, CACHE_CHARS = 120_000, 4 << 20
#: Distinct keys that a task merges before it passes its partial counts on. Bounds memory only.
MERGED = 2_000_000
#: Bytes of documents that are aligned at a time.
CHUNK = 512 << 10
#: New pieces that are encoded as one text.
TOGETHER = 2000
#: Links of a group from which its distinct ids are multiplied.
OUTER = 4096

_EDGE = re.compile(r"(?<=\S)(?= )")
_loaded: dict[tuple[str, str], Pair] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of times of each."""
    own, inverse = np.unique(keys, return_inverse=True)
    out = np.zeros(len(own), dtype=np.int64)
    np.add.at(out, inverse, times)
    return own, out


class Pair:
    """Both tokenizers, and the ids of the pieces that they have encoded."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a: dict[int, bytes] = {i: bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.size_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        self.size_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # ids as text, with what follows them in a group: for A a comma or the bar, for B a comma or the group's end
        self.text = [f"{i}{x}" for i in range(len(self.size_a)) for x in ",|"] + [f"{i}{x}" for i in range(len(self.size_b)) for x in ",;"]
        # no piece of B goes on with a space, and A's pre-tokenizer is the usual one, which starts anew at a space
        self.cuts = not any(re.search("[^▁]▁", x) for x in pieces) and '"use_regex":true' in self.a.to_str().replace(" ", "")
        self.space = [self.b.piece_to_id("▁")]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.before = self.known  # what was known before the cache was full; pieces that are used again go over
        self.held = 0

    def _checked(self, spaced: str, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        """Ids as little-endian 32-bit numbers; None if they do not spell the text."""
        data = spaced.encode()
        if b"".join([self.bytes_a[i] for i in a]) != data or b"".join([self.bytes_b[i] for i in b]) != data:
            return None
        return array("i", a).tobytes(), array("i", b).tobytes()

    def whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of space+text without the cache; None for texts without tokens."""
        if not text:
            return None
        return self._checked(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces: those that end in no white space as one text, as a token ends between them; the rest one by one."""
        together = [x for x in pieces if not x[-1].isspace()]
        for start in range(0, len(together), TOGETHER):
            self._learn_together(together[start : start + TOGETHER])
        single = [x for x in pieces if x not in self.known]
        if single:
            of_a = self.a.encode_batch_fast(single, add_special_tokens=False)
            of_b = self.b.encode([x[1:] for x in single], num_threads=1)
            for x, a, b in zip(single, of_a, of_b, strict=True):
                self.known[x] = self._checked(x, a.ids, b if len(x) > 1 else self.space)
        self.held += sum(map(len, pieces))

    def _learn_together(self, pieces: list[str]) -> None:
        text = "".join(pieces)
        found = self._checked(text, self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]))
        if found is None:
            return
        ends = np.cumsum(np.array([len(x.encode()) for x in pieces]))
        cuts = []
        for data, sizes in zip(found, (self.size_a, self.size_b), strict=True):
            at = np.cumsum(sizes[np.frombuffer(data, dtype="<i4")])
            place = np.searchsorted(at, ends)
            if not np.array_equal(at[place], ends):
                return
            cuts.append((4 * (place + 1)).tolist())
        i = j = 0
        (a, b), known = found, self.known
        for x, k, m in zip(pieces, *cuts, strict=True):
            known[x] = a[i:k], b[j:m]
            i, j = k, m

    def ids(self, own: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both tokenizers for each text; None for texts without tokens."""
        if len(self.known) > CACHE or self.held > CACHE_CHARS:
            self.before, self.known, self.held = self.known, {}, 0
        split = [_EDGE.split(" " + x) if x and self.cuts else [] for x in own]
        missing = set(chain.from_iterable(split)).difference(self.known)
        again = missing.intersection(self.before)
        for x in again:
            self.known[x] = self.before[x]
            self.held += len(x)
        if missing := list(missing.difference(again)):
            self._learn(missing)
        out: list[tuple[bytes, bytes] | None] = []
        for text, pieces in zip(own, split, strict=True):
            found = list(map(self.known.__getitem__, pieces))
            if not found or None in found:
                out.append(self.whole(text))
            else:
                of_a, of_b = zip(*found, strict=True)
                out.append((b"".join(of_a), b"".join(of_b)))
        return out


@dataclass
class Aligned:
    """Of each document: tokens, groups, links, the digest of the groups; then the distinct keys of all with how often each occurs, and where each document's end."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha: list[str]
    keys: np.ndarray
    times: np.ndarray
    ends: np.ndarray


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def aligned(both: Pair, ids: list[tuple[bytes, bytes] | None]) -> Aligned:
    """Alignment of documents by their ids, all at once: texts with tokens are laid end to end, so that offsets of both kinds of tokens are comparable."""
    n = len(ids)
    of_a, of_b = (np.frombuffer(b"".join([x[k] for x in ids if x]), dtype="<i4").astype(np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) // 4 if x else 0 for x in ids], dtype=np.int64) for k in (0, 1))
    end_a, end_b = np.cumsum(both.size_a[of_a]), np.cumsum(both.size_b[of_b])
    last_a = end_b[np.searchsorted(end_b, end_a)] == end_a if len(of_a) else np.empty(0, dtype=bool)
    last_b = end_a[np.searchsorted(end_a, end_b)] == end_b if len(of_b) else np.empty(0, dtype=bool)
    in_a, in_b = (np.concatenate([[0], np.cumsum(x)[:-1]])[: len(x)] for x in (last_a, last_b))  # the group of each token
    groups = int(last_a.sum())
    own_a, own_b = np.bincount(in_a, minlength=groups), np.bincount(in_b, minlength=groups)
    at_a, at_b = _offsets(own_a), _offsets(own_b)
    docs = np.repeat(np.arange(n), n_a)[last_a]  # the document of each group
    n_groups = np.bincount(docs, minlength=n)
    # groups in order, each its A ids and then its B ids, as places of a list of texts
    codes = np.empty(len(of_a) + len(of_b), dtype=np.int64)
    codes[np.arange(len(of_a)) + at_b[in_a]] = 2 * of_a + last_a
    codes[np.arange(len(of_b)) + at_a[in_b + 1]] = 2 * (len(both.size_a) + of_b) + last_b
    stops = _offsets(n_a + n_b)
    sha = [hashlib.sha256("".join(map(both.text.__getitem__, codes[i:j].tolist()))[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
    links = own_a * own_b
    n_links = np.zeros(n, dtype=np.int64)
    np.add.at(n_links, docs, links)
    # pairs: every A token with each B token of its group; large groups go by their distinct ids
    large = links > OUTER
    many = np.where(large, 0, own_b)[in_a]
    first = np.repeat(at_b[in_a], many)
    place = np.arange(int(many.sum())) - np.repeat(_offsets(many)[:-1], many)
    doc, key = np.repeat(docs[in_a], many) if groups else np.empty(0, dtype=np.int64), np.repeat(of_a, many) << 32 | of_b[first + place]
    times = np.ones(len(key), dtype=np.int64)
    for g in np.flatnonzero(large).tolist():
        (xa, na), (xb, nb) = (np.unique(x[at[g] : at[g + 1]], return_counts=True) for x, at in ((of_a, at_a), (of_b, at_b)))
        doc = np.concatenate([doc, np.full(len(xa) * len(xb), docs[g])])
        key = np.concatenate([key, (xa[:, None] << 32 | xb[None, :]).ravel()])
        times = np.concatenate([times, np.multiply.outer(na, nb).ravel()])
    bits_a, bits_b = (len(x).bit_length() for x in (both.size_a, both.size_b))
    if large.any() or n.bit_length() + bits_a + bits_b > 63:
        order = np.lexsort((key, doc))
        doc, key, times = doc[order], key[order], times[order]
    else:  # a document, A's id and B's in one number, which sorts several times as fast
        packed = np.sort(doc << (bits_a + bits_b) | (key >> 32) << bits_b | key & ((1 << 32) - 1))
        doc, key = packed >> (bits_a + bits_b), (packed >> bits_b & ((1 << bits_a) - 1)) << 32 | packed & ((1 << bits_b) - 1)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))[: len(key)]
    times = np.add.reduceat(times, new) if len(new) else times
    return Aligned(n_a, n_b, n_groups, n_links, sha, key[new], times, np.searchsorted(doc[new], np.arange(n), side="right"))


def pair(path_a: str | None = None, path_b: str | None = None) -> Pair:
    import public_tokenizers

    key = (path_a or public_tokenizers.path(BYTE_BPE), path_b or public_tokenizers.path(PIECE_BPE))
    if key not in _loaded:
        _loaded[key] = Pair(*key)
    return _loaded[key]


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of documents of about CHUNK bytes together, a longer one alone."""
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"


def links(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row for each document: its numbers of tokens, groups and links, the digest of its groups, and its distinct keys with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in batches:
            for start, stop in _chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                got = aligned(both, both.ids(strings(batch.column(1).slice(start, stop - start))))
                offsets = pa.array(np.concatenate([[0], got.ends]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (got.keys, got.times)]
                numbers = [pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *numbers, pa.array(got.sha, pa.string()), *lists], names=[x.split()[0] for x in LINKS.split(", ")])

    return texts(docs).mapInArrow(run, LINKS)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A thousand documents at a time, so that arrays over their links stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            yield batch.slice(start, 1000)


def counts(found: DataFrame) -> DataFrame:
    """(key, n): in how many documents each key occurs, sorted by key over range partitions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = n = np.empty(0, dtype=np.int64)
        for batch in _slices(batches):
            own, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            keys, n = summed(np.concatenate([keys, own]), np.concatenate([n, times]))
            if len(keys) > MERGED:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                keys = n = np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((2, 0), dtype=np.int64)  # the run that the next batch may go on with
        for batch in batches:
            keys = np.concatenate([last[0], batch.column(0).to_numpy()])
            n = np.concatenate([last[1], batch.column(1).to_numpy()])
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            last = np.stack([keys[-1:], n[-1:]])
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(n[:-1])], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], names=["key", "n"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = found.select("keys").mapInArrow(partial, "key long, n long")
    return sent.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(runs, "key long, n long")


def mounted(folder: str) -> str | None:
    """The path of a folder in the file system of the machines; None for any other store."""
    got = re.fullmatch(r"(?:file:(?://)?)?(/.*)", folder)
    return got and got[1]


def write_shards(sorted_counts: DataFrame, folder: str) -> tuple[list[tuple[int, int, str]], np.ndarray, np.ndarray]:
    """A shard of each partition, two arrays in folder: (first key, last key, name) in order of the keys. And each A id with its highest count.

    A repeated task writes the same shard again, under another name until it is whole.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        keys, n = (np.concatenate(x) for x in zip(*got, strict=True))
        name = f"{TaskContext.get().partitionId():06d}"
        for kind, values in (("key", keys), ("n", n)):
            own = f"{folder}/.{name}-{kind}-{uuid.uuid4().hex}"
            with open(own, "wb") as file:
                np.save(file, values)
            os.replace(own, f"{folder}/{name}-{kind}.npy")
        ids = keys >> 32
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        size = len(first)
        yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(np.repeat(keys[:1], size)), pa.array(np.repeat(keys[-1:], size)), pa.array(ids[first]), pa.array(np.maximum.reduceat(n, first))], names=["name", "low", "high", "a", "best"])

    # a row for each A id of a shard, so as many as the vocabulary has and one more a shard
    rows = sorted_counts.mapInArrow(run, "name string, low long, high long, a long, best long").toArrow()
    shards = sorted({(low, high, name) for low, high, name in zip(rows["low"].to_pylist(), rows["high"].to_pylist(), rows["name"].to_pylist(), strict=True)})
    ids = rows["a"].to_numpy()
    best = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int64)
    np.maximum.at(best, ids, rows["best"].to_numpy())
    return shards, np.arange(len(best)), best


class Shards:
    """Count shards mapped into memory; pages are shared by the workers of a machine."""

    def __init__(self, folder: str, shards: list[tuple[int, int, str]]):
        self.last = np.array([high for _, high, _ in shards], dtype=np.int64)
        self.files = [f"{folder}/{name}" for _, _, name in shards]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which some shard has."""
        out = np.empty(len(keys), dtype=np.int64)
        start = 0
        for k, stop in enumerate(np.searchsorted(keys, self.last, side="right").tolist()):
            if stop > start:
                if k not in self.open:
                    self.open[k] = tuple(np.load(f"{self.files[k]}-{kind}.npy", mmap_mode="r") for kind in ("key", "n"))
                own, n = self.open[k]
                at = np.minimum(np.searchsorted(own, keys[start:stop]), len(own) - 1)
                if not np.array_equal(own[at], keys[start:stop]):
                    raise ValueError("a key that no shard has")
                out[start:stop] = n[at]
            start = stop
        if start < len(keys):
            raise ValueError("a key that no shard has")
        return out


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(found: DataFrame, folder: str, shards: list[tuple[int, int, str]], best: np.ndarray) -> DataFrame:
    """Totals of each document, its keys searched in the shards."""
    sent = found.sparkSession.sparkContext.broadcast(best)  # one number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, highest = Shards(folder, shards), sent.value
        for batch in _slices(batches):
            lists = batch.column(batch.num_columns - 2)
            keys, times = lists.flatten().to_numpy(), batch.column(batch.num_columns - 1).flatten().to_numpy()
            own, inverse = np.unique(keys, return_inverse=True)
            n = maps.of(own)
            top = n == highest[own >> 32] if len(own) else np.empty(0, dtype=bool)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            totals = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]])) for x in (times * top[inverse], times * n[inverse])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x.astype(np.int64)) for x in totals), batch.column(5)], names=[x.split()[0] for x in OUT.split(", ")])

    return found.mapInArrow(run, OUT)


def joined(found: DataFrame, by: DataFrame) -> DataFrame:
    """Totals of each document by a join with the counts (key, n), which shuffles all links; for folders that can't be mapped."""
    best = by.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("best"))
    own = found.withColumn("_row", F.monotonically_increasing_id())
    rows = own.select("_row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("_row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    met = hot_join(rows, by, "key", "n", rows.count()).withColumn("a", F.shiftright("key", 32)).join(best, "a")
    totals = met.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = own.join(totals, "_row", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_best", "count_sum")})
    return out.select(*[x.split()[0] for x in OUT.split(", ")])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, map_shards: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    map_shards=False takes the join that serves folders which are no mounted path.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    links(docs, path_a, path_b).write.option("compression", "zstd").parquet(f"{folder}/links")
    found = spark.read.parquet(f"{folder}/links")
    path = mounted(folder) if map_shards else None
    if path is None:
        counts(found).write.parquet(f"{folder}/counts")
        return joined(found, spark.read.parquet(f"{folder}/counts"))
    shards, _, best = write_shards(counts(found), f"{path}/shards")
    return looked_up(found, f"{path}/shards", shards, best)


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """a, b, n: in how many documents each pair of token ids is linked."""
    return counts(links(docs, path_a, path_b)).select(F.shiftright("key", 32).cast("int").alias("a"), F.col("key").bitwiseAND((1 << 32) - 1).cast("int").alias("b"), "n")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment totals of all documents."""
    return align(table(spark, sf_dir, "documents"))
