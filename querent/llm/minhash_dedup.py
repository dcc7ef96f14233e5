"""Operator 2, near-duplicates by MinHash bands and odd sketches.

A document's set is its distinct SHINGLE-word shingles. Documents of one set are one class
at once; everything after works on classes. A class is named by 63 bits of a digest of its set,
and no name is taken that two sets share: 64 more bits tell them apart, and if any differ under
one name, all names are made anew (``signed``). The threshold is a
parameter, and both filters follow it (``limits``): bands of MinHash values put classes into
buckets (a pair just at the threshold misses all buckets with a chance of at most MISSED);
``exchange`` leaves only the buckets that several classes share. An odd sketch folds all
PERMUTATIONS samples into a parity bitmap; the population count of the XOR of two sketches
estimates high similarities closely, and pairs estimated under a floor (DEVIATIONS below
the threshold) are dropped before their texts are read. The rest are confirmed on full sets.

Buckets are never expanded to pairs of rows. First the members of a bucket meet two of them;
verified links are contracted, and buckets that lie in one component are done, so a bucket
of near copies costs two comparisons a member. What is left is cut into blocks of at most
BLOCK members, each pair of blocks of a bucket a task of its own. It compares sketches of
members of different components as bit matrices; only members with a candidate go on, with
their texts, to the same tasks for exact comparison, which give the links of a spanning
forest. So every pair of a bucket has been compared or lies in one component: no link
between components is lost, and no step makes more rows than members times blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import buckets, cut, fresh, hold, hot_join, probed, table, texts
from querent.llm.components import components
from querent.llm.exchange import repeated, unpack

SHINGLE = 5
PERMUTATIONS = 192
SKETCH_BITS = 1024
#: Links have 100 * intersection >= percent * union; this is the percent of op2_minhash_dedup.
PERCENT = 85
#: Largest chance that a pair just at the threshold shares no band.
MISSED = 5e-7
#: Deviations of a sample of PERMUTATIONS between the threshold and the least estimate that is kept; a pair just at 0.80 or 0.85 is dropped with a chance under 5e-7.
DEVIATIONS = 5.7
#: Least and most bits of the filter that keeps texts of no candidate out of a shuffle: 16 for each candidate class in between.
FILTER_BITS = 1 << 16, 1 << 28

_RNG = np.random.Generator(np.random.PCG64(7))
_A = (_RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_MIXED = np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32)


def shingle_sets(piece: K.Piece) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than a shingle: the whole sequence; no words: empty."""
    w = K.words(piece, K.SPACE, True)
    grams = K.windows(w.hashes, SHINGLE)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(K.windows(w.hashes[a:b], b - a))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """PERMUTATIONS least values of 32-bit linear hashes of a non-empty set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = None
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 2048):
            part = (np.multiply.outer(_A, x[at : at + 2048]) + _B[:, None]).min(axis=1)
            least = part if least is None else np.minimum(least, part)
    return least


def bands(least: np.ndarray, like: Limits) -> np.ndarray:
    """A 64-bit hash of each band's rows and number."""
    own = least[: like.bands * like.rows].astype(np.uint64).reshape(like.bands, like.rows)
    h = np.arange(1, like.bands + 1, dtype=np.uint64)
    for i in range(like.rows):
        h = K.mix(h ^ own[:, i])
    return h


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (permutation, value) samples."""
    place = (K.mix(_MIXED | least.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=SKETCH_BITS).astype(np.uint8) & 1)


def estimate(differing: int, bits: int = SKETCH_BITS, samples: int = PERMUTATIONS) -> float:
    """Jaccard similarity from the population count of two sketches' XOR."""
    if 2 * differing >= bits:
        return 0.0
    return 1 + bits / (4 * samples) * float(np.log1p(-2 * differing / bits))


@dataclass(frozen=True)
class Limits:
    """A threshold in percent, the bands and rows that find it, and the most differing bits of a pair estimated at its floor or above."""

    percent: int
    bands: int
    rows: int
    most_differing: int


def limits(percent: int) -> Limits:
    """The filters of a threshold: bands of as many rows as MISSED allows, and the sketches' floor."""
    share = percent / 100
    fit = [r for r in range(1, PERMUTATIONS + 1) if (1 - share**r) ** (PERMUTATIONS // r) <= MISSED]
    if not fit or percent > 100:
        raise ValueError(f"no bands of {PERMUTATIONS} values find pairs of {percent} %")
    floor = share - DEVIATIONS * math.sqrt(share * (1 - share) / PERMUTATIONS)
    return Limits(percent, PERMUTATIONS // max(fit), max(fit), max(d for d in range(SKETCH_BITS // 2) if estimate(d) >= floor))


def _key(values: np.ndarray, salt: int = 0) -> tuple[int, int] | tuple[None, None]:
    """63 bits of a digest of a set, and 64 others; nulls for the empty set."""
    if not len(values):
        return None, None
    digest = hashlib.blake2b(values.tobytes(), digest_size=16, salt=salt.to_bytes(16, "little")).digest()
    return int.from_bytes(digest[:8]) >> 1, int.from_bytes(digest[8:], signed=True)


def signatures(docs: DataFrame, like: Limits, salt: int = 0) -> DataFrame:
    """doc_id, _h (of the text), n_shingles, key and other (of the set; null for the empty set), bands, sketch (as eight-byte words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                n, key, other, band, sketch = [], [], [], [], []
                for values in shingle_sets(piece):
                    n.append(len(values))
                    own = _key(values, salt)
                    key.append(own[0])
                    other.append(own[1])
                    if len(values):
                        least = signature(values)
                        band.append(bands(least, like).view(np.int64))
                        sketch.append(odd_sketch(least).view(np.int64))
                    else:
                        band.append(None)
                        sketch.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.n), batch.column(2).slice(piece.first, piece.n), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(other, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    names=["doc_id", "_h", "n_shingles", "key", "other", "bands", "sketch"],
                )

    return texts(docs, F.xxhash64(F.col("text").cast("string")).alias("_h")).mapInArrow(run, "doc_id long, _h long, n_shingles long, key long, other long, bands array<long>, sketch array<long>")


def signed(docs: DataFrame, like: Limits) -> tuple[DataFrame, DataFrame, int]:
    """signatures(docs) and its classes, both cut, under a salt by which no two sets share a name; and the salt."""
    for salt in range(16):
        sig = cut(signatures(docs, like, salt))
        first = {x: F.first(x).alias(x) for x in ("n_shingles", "bands", "sketch")}
        by = sig.where("n_shingles > 0").groupBy("key").agg(*first.values(), F.min("other").alias("_low"), F.max("other").alias("_high"))
        classes, seen = probed(by, [F.count(F.when(F.col("_low") != F.col("_high"), 1))], rows=20_000)
        if not seen[1]:
            return sig, classes.drop("_low", "_high"), salt
    raise RuntimeError("sets share a name under every salt")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Filter over the keys; what reaches the driver is bounded by FILTER_BITS."""
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (16 * keys.count()).bit_length()))
    rows = keys.select((F.col("key") % size).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _candidate_texts(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """(key, text) for each wanted key: the text of any one document of the class."""
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        size = 64 * len(bits)
        for batch in batches:
            for piece in K.pieces(batch.column(0)):
                key = [_key(x, salt)[0] for x in shingle_sets(piece)]
                at = [i for i, k in enumerate(key) if k is not None and bits[(p := k % size) >> 6] >> np.uint64(p & 63) & np.uint64(1)]
                yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in at], pa.int64()), batch.column(0).take(pa.array([piece.first + i for i in at], pa.int64()))], names=["key", "text"])

    near = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, text string")
    # copies of a text become one in each task, before any shuffle
    return near.dropDuplicates(["key"]).join(wanted, "key", "left_semi")


def _confirmed(held: DataFrame, pairs: DataFrame, like: Limits) -> DataFrame:
    """Those pairs of class keys (a, b) whose full sets reach the similarity; held has the text of each key."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    own = held.join(wanted, "key", "left_semi")
    left = own.withColumnsRenamed({"key": "a", "text": "ta"})
    right = own.withColumnsRenamed({"key": "b", "text": "tb"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                turns = [x for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for x in pair]
                sets = [x for piece in K.pieces(pa.array(turns, pa.string())) for x in shingle_sets(piece)]
                hit = []
                for x, y in zip(sets[::2], sets[1::2], strict=True):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    hit.append(100 * same >= like.percent * (len(x) + len(y) - same))
                yield batch.filter(pa.array(hit, pa.bool_())).select([0, 1]).rename_columns(["u", "v"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def _alike(pairs: DataFrame, classes: DataFrame, like: Limits) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity and whose sketches do not rule it out, with their differing bits."""
    own = classes.select("key", "n_shingles", "sketch")
    left = own.withColumnsRenamed({"key": "a", "n_shingles": "na", "sketch": "sa"})
    right = own.withColumnsRenamed({"key": "b", "n_shingles": "nb", "sketch": "sb"})
    differing = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda x, y: x + y)
    sizes = F.lit(100) * F.least("na", "nb") >= F.lit(like.percent) * F.greatest("na", "nb")
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return both.withColumn("differing", differing).where(sizes & (F.col("differing") <= like.most_differing)).select("a", "b", "differing")


def shared_bands(classes: DataFrame, like: Limits) -> DataFrame:
    """(bucket, key): the bands of each class that another class has too."""

    def marks(piece: K.Piece, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = rows.column(3).flatten().to_numpy().view(np.uint64)
        return np.repeat(np.arange(piece.n), like.bands), np.tile(np.arange(like.bands), piece.n), values

    rows = classes.select(F.col("key").alias("doc_id"), F.lit("").alias("text"), F.lit(0).cast("long").alias("_h"), "bands")
    found = repeated(rows, marks, buckets(classes)).select(F.col("doc_id").alias("key"), "places")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [unpack(x) for x in batch.column(2).to_pylist()]
            own = batch.column(1).flatten().to_numpy().reshape(-1, like.bands)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[i][x] for i, x in enumerate(at)] or [np.empty(0, dtype=np.int64)])), batch.column(0).take(pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at])))], names=["bucket", "key"])

    return classes.select("key", "bands").join(found, "key").mapInArrow(pick, "bucket long, key long")


#: Members of a bucket in a block, and about as many shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22


def _blocked(members: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """members (bucket, key, n_shingles, ...) with i <= j: each once for every pair of blocks of its bucket that its own block is in."""
    n = F.count(F.lit(1))
    sizes = members.groupBy("bucket").agg(n.alias("_n"), F.ceil(F.greatest(n / block, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("g"))
    own = hot_join(members, sizes, "bucket", "_n", total).withColumn("own", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _candidates(comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, like: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of members of different components whose sizes and sketches allow the similarity."""
    xs, ys = [], []
    for at in range(0, len(comp), 256):
        differing = np.zeros((min(256, len(comp) - at), len(comp)), dtype=np.uint16)
        for w in range(sketch.shape[1]):
            differing += np.bitwise_count(sketch[at : at + 256, w][:, None] ^ sketch[:, w][None, :])
        a, b = size[at : at + 256][:, None], size[None, :]
        ok = (differing <= like.most_differing) & (comp[at : at + 256][:, None] != comp[None, :]) & (100 * np.minimum(a, b) >= like.percent * np.maximum(a, b))
        x, y = np.nonzero(ok)
        x += at
        xs.append(x[x < y])
        ys.append(y[x < y])
    return np.concatenate(xs), np.concatenate(ys)


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketch = group["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(group.num_rows, -1)
    return group["comp"].to_numpy(), group["n_shingles"].to_numpy(), sketch


def _involved(group: pa.Table, like: Limits) -> pa.Table:
    x, y = _candidates(*_columns(group), like)
    return group.take(pa.array(np.union1d(x, y)))


def _shared(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intersection sizes of pairs of sets, by products of incidence matrices over the shingles that several have."""
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    sizes = np.array([len(v) for v in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    many = times[inverse] > 1
    owner, place = owner[many], column[inverse[many]]
    out = np.zeros(len(x), dtype=np.int64)
    by = np.argsort(place, kind="stable")
    owner, place = owner[by], place[by]
    width = max(1, (8 << 20) // max(1, len(sets)))
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        low, high = np.searchsorted(place, (start, start + width))
        matrix = np.zeros((len(sets), min(width, int(place[-1]) + 1 - start)), dtype=np.float32)
        matrix[owner[low:high], place[low:high] - start] = 1
        total += matrix @ matrix.T
    if len(x):
        out = total[x, y].astype(np.int64)
    return out


def _spanning(group: pa.Table, like: Limits) -> pa.Table:
    """Links (u, v) of a spanning forest over the confirmed pairs of a block."""
    comp, size, sketch = _columns(group)
    x, y = _candidates(comp, size, sketch, like)
    sets = [v for piece in K.pieces(group["text"]) for v in shingle_sets(piece)]
    same = _shared(sets, x, y) if sets else np.empty(0, dtype=np.int64)
    hit = 100 * same >= like.percent * (size[x] + size[y] - same)
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    edges = []
    key = group["key"].to_pylist()
    for p, q in zip(x[hit].tolist(), y[hit].tolist(), strict=True):
        a, b = find(int(comp[p])), find(int(comp[q]))
        if a != b:
            root[a] = b
            edges.append((key[p], key[q]))
    return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})


class Links:
    """The components that confirmed links make so far."""

    def __init__(self, held: DataFrame, like: Limits):
        self.held = held
        self.like = like
        self.found: DataFrame | None = None

    def take(self, edges: DataFrame) -> None:
        """Adds confirmed links (u, v)."""
        edges, n = probed(edges, [])
        if n[0]:
            stars = edges if self.found is None else edges.union(self.found.select("node", "component"))
            self.found = hold(components(stars))

    def labelled(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with the component of a key, itself if it has no link."""
        if self.found is None:
            return rows.withColumn(name, F.col(key))
        own = self.found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return rows.join(own, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_component", key)).drop("_node", "_component")

    def add(self, pairs: DataFrame) -> None:
        """Confirms pairs (a, b, differing): first the likeliest of each b, then those that still lie in different components."""
        pairs, n = probed(pairs, [])
        if n[0]:
            self.take(_confirmed(self.held, pairs.groupBy("b").agg(F.min_by("a", "differing").alias("a")).select("a", "b"), self.like))
            apart, n = probed(self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b"), [])
            if n[0]:
                self.take(_confirmed(self.held, apart, self.like))


def links(docs: DataFrame, classes: DataFrame, like: Limits, block: int = BLOCK, salt: int = 0) -> DataFrame | None:
    """(node, component) over class keys, from confirmed links that connect all linked classes; None if there are none."""
    members, total = probed(shared_bands(classes, like), [])
    state = Links(hold(_candidate_texts(docs, hold(members.select("key").distinct()), salt), rows=20_000, memory=False), like)
    ends = members.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("_n")).where("low < high")
    met = hot_join(members, hold(ends), "bucket", "_n", total[0]).drop("_n")
    pairs = met.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).union(met.where("key not in (low, high)").select("high", "key"))
    state.add(_alike(pairs, classes, like))
    alive, n = probed(state.labelled(met.where("key not in (low, high)").select("bucket", "key"), "key", "comp"), [])
    apart = alive.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("_n")).where("least < most").select("bucket", "_n")
    left, n = probed(hot_join(alive, hold(apart), "bucket", "_n", n[0]).select("bucket", "key", "comp"), [])
    if n[0]:
        by = ["bucket", "i", "j"]
        schema = "bucket long, i int, j int, key long, comp long, n_shingles long, sketch array<long>"
        sized = hold(left.join(classes.select("key", "n_shingles", "sketch"), "key"))
        involved = hold(_blocked(sized, n[0], block).select(*schema_names(schema)).groupBy(*by).applyInArrow(lambda group: _involved(group, like), schema))
        texts_too = involved.join(state.held, "key").select(*schema_names(schema), "text")
        state.take(texts_too.groupBy(*by).applyInArrow(lambda group: _spanning(group, like), "u long, v long").distinct())
    return state.found


def schema_names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def near_duplicates(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """doc_id, _h, n_shingles, key, component_id (least doc_id reachable by links), kept (it is that document).

    Links are pairs of Jaccard similarity of percent / 100 or more. Documents without words are linked with nothing and kept. A null doc_id is never a component's least unless all are null;
    repeated rows of one doc_id share their component and are kept together.
    """
    like = limits(percent)
    sig, classes, salt = signed(docs, like)
    found = links(docs, classes, like, block, salt)
    least = sig.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    if found is not None:
        labelled = least.join(found, least["key"] == found["node"], "left").withColumn("comp", F.coalesce("component", "key"))
        by = labelled.groupBy("comp").agg(F.min("least").alias("low"))
        least = labelled.join(by, "comp").select("key", F.col("low").alias("least"))
    # held, so that the join is one of two plain shuffles and can split a set with very many copies over tasks
    least = hold(least, rows=200_000)
    out = sig.select("doc_id", "_h", "n_shingles", "key").join(least, "key", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "_h", "n_shingles", "key", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents less those that are not their component's least; their columns are unchanged, rows repeated in id and text become one."""
    key, other, text = fresh("_id", docs), fresh("_g", docs), fresh("_h", docs)
    gone = near_duplicates(docs, percent=percent).where("not kept").select(F.col("doc_id").alias(key), F.col("_h").alias(other))
    own = docs.withColumn(text, F.xxhash64(F.col("text").cast("string")))
    left = own.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(text) == F.col(other)), "left_anti")
    return left.dropDuplicates(["doc_id", text]).select(*docs.columns)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_h", "key")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.x WHERE r.c < b.y),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""
