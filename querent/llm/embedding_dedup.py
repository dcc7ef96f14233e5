"""Operator 12, near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample so that the signs of rotated vectors lose little
(``itq``: signs and the best rotation for them, in turns); as vectors are not moved, two of
them at a given angle differ in few signs wherever they lie, a dense group included. All
signs, one code a vector, are cut into tables of some bits (``Tables``: about the logarithm
of the number of vectors), as many as let a pair just at the threshold share no table with a
chance of at most MISSED. Vectors that share a table's bits meet; those whose first
CODE_BITS signs differ little are reranked with their original vectors in double precision.

Equal vectors are one class at once. Groups of near copies are not compared pair by pair:
where many classes share a bucket, pivots among them are drawn, and classes within half the
threshold's angle of a pivot are its ball. All pairs of a ball are links, by the triangle
inequality. A class that meets a ball in some bucket is held against the pivot: the bound
shows that all of the ball or none of it links with the class, else the class is compared
with the ball's members, in blocks. What lies in no ball is compared within its buckets, in
blocks; a pair counts in the first table that it shares. So work grows with the members of
a dense group, no step makes a row for each pair, and no link that the tables reach is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import cut, hold, hot_join, probed, table
from querent.llm.components import components

#: Least cosine of a link in op12_embedding_dedup.
COSINE = 0.9
#: Chance that a pair just at the threshold shares no table, for rotations that know nothing of the data.
MISSED = 0.01
#: Vectors, and bytes of them, that the rotations are learned from.
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
#: Turns of learning a rotation, and most columns of one.
TURNS, COLUMNS = 20, 256
#: Signs that a pair is filtered by, and deviations above their expected differences at the threshold.
CODE_BITS, DEVIATIONS = 128, 5.7
#: Classes of a bucket from which pivots are drawn, how many are, and least members of a ball.
CROWD, PIVOTS, BALL = 512, 8, 32
#: Members in a block, and rows that a task's group has about.
BLOCK, GROUP = 512, 20_000
#: Slack of bounds on angles.
SLACK = 1e-7


def unit_rows(column: pa.ListArray) -> list[bytes | None]:
    """Each vector at length 1 in double precision; None for null, zero and empty ones, and for those with null or non-finite components."""
    out: list[bytes | None] = [None] * len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    offsets, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for size in np.unique(sizes[known]).tolist():
        at = np.flatnonzero(known & (sizes == size))
        if not size:
            continue
        m = values[offsets[at][:, None] + np.arange(size)]
        with np.errstate(all="ignore"):
            most = np.abs(m).max(axis=1)
            ok = np.isfinite(m).all(axis=1) & (most > 0)
            m = m[ok] / most[ok][:, None]
            m = m / np.sqrt((m * m).sum(axis=1))[:, None] + 0.0
        for i, x in zip(at[ok].tolist(), m, strict=True):
            out[i] = x.tobytes()
    return out


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, unit (the vector at length 1, or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit_rows(batch.column(1)), pa.binary())], names=["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, unit binary")


@dataclass(frozen=True)
class Tables:
    """A threshold, the bits of a table, the number of tables, and the most signs of CODE_BITS that a kept pair differs in."""

    cosine: float
    bits: int
    tables: int
    differing: int


def tables(n: int, cosine: float) -> Tables:
    """Tables for n vectors."""
    if not 0 < cosine < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    bits = min(40, max(8, math.ceil(math.log2(max(n, 2))) - 2))
    apart = math.acos(cosine) / math.pi  # chance that a sign differs
    number = math.ceil(math.log(MISSED) / math.log1p(-((1 - apart) ** bits)))
    number = max(number, math.ceil(CODE_BITS / bits))
    return Tables(cosine, bits, number, math.ceil(CODE_BITS * apart + DEVIATIONS * math.sqrt(CODE_BITS * apart * (1 - apart))))


def orthogonal(size: int, rng: np.random.Generator) -> np.ndarray:
    q, r = np.linalg.qr(rng.standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def itq(x: np.ndarray, start: np.ndarray, turns: int = TURNS) -> np.ndarray:
    """A rotation from start on that brings x closer to its own signs, turn by turn."""
    turned = start
    for _ in range(turns):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ turned >= 0, 1.0, -1.0))
        turned = u @ v
    return turned


def rotations(size: int, like: Tables, x: np.ndarray | None = None) -> np.ndarray:
    """Directions (size, tables * bits) whose signs are the code: columns of rotations, learned on x if it has rows enough.

    Many dimensions are mixed by a random rotation and learned COLUMNS at a time.
    """
    rng = np.random.Generator(np.random.PCG64([size, like.bits]))
    out, have = [], 0
    while have < like.bits * like.tables:
        own = orthogonal(size, rng)
        if x is not None and len(x) >= 4 * min(size, COLUMNS):
            part = x[rng.random(len(x)) < 0.5] if len(x) >= 16 * size else x
            for a in range(0, size, COLUMNS):
                columns = own[:, a : a + COLUMNS]
                own[:, a : a + COLUMNS] = columns @ itq(part @ columns, orthogonal(columns.shape[1], rng))
        # a random order, so that the bits of one table do not follow the order of columns
        out.append(own[:, rng.permutation(size)])
        have += size
    return np.ascontiguousarray(np.concatenate(out, axis=1)[:, : like.bits * like.tables])


def learn(classes: DataFrame, n: int, like: Tables) -> dict[int, np.ndarray]:
    """Rotations for each dimension that a sample of the classes holds often enough; at most SAMPLE vectors and SAMPLE_BYTES reach the driver."""
    widest = classes.agg(F.max(F.octet_length("unit"))).first()[0] or 8
    rows = max(64, min(SAMPLE, SAMPLE_BYTES // widest))
    share = max(1, math.ceil((1 << 30) * min(1.0, rows / max(n, 1))))
    got = classes.where(F.pmod(F.xxhash64("unit", F.lit(12)), F.lit(1 << 30)) < share).select("unit").limit(rows).toArrow()["unit"].to_pylist()
    by: dict[int, list[bytes]] = {}
    for x in sorted(got):
        by.setdefault(len(x) // 8, []).append(x)
    return {size: rotations(size, like, matrix(own)) for size, own in by.items() if len(own) >= 64}


def matrix(own: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(own), dtype=np.float64).reshape(len(own), -1)


def signs(x: np.ndarray, directions: np.ndarray, like: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's bucket in each table, and its first CODE_BITS signs as two words."""
    bits = (x @ directions >= 0).astype(np.uint64)
    places = np.arange(like.bits, dtype=np.uint64)
    chunks = (bits.reshape(len(x), like.tables, like.bits) << places).sum(axis=2, dtype=np.uint64)
    number = K.mix(np.arange(1, like.tables + 1, dtype=np.uint64) ^ np.uint64(x.shape[1] << 32))
    code = np.packbits(bits[:, :CODE_BITS].astype(np.uint8), axis=1).view(np.int64)
    return K.mix(chunks ^ number).view(np.int64), code


def coded(classes: DataFrame, models: dict[int, np.ndarray], like: Tables) -> DataFrame:
    """c, size (dimensions), keys (a bucket in each table), code."""
    sent = classes.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = part.column(1).to_pylist()
                sizes = np.array([len(x) // 8 for x in own])
                keys = np.empty((len(own), like.tables), dtype=np.int64)
                code = np.empty((len(own), CODE_BITS // 64), dtype=np.int64)
                for size in np.unique(sizes).tolist():
                    directions = sent.value.get(size)
                    if directions is None:
                        if size not in other:
                            other.clear()
                            other[size] = rotations(size, like)
                        directions = other[size]
                    i = np.flatnonzero(sizes == size)
                    keys[i], code[i] = signs(matrix([own[k] for k in i.tolist()]), directions, like)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())) for m in (keys, code)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), *lists], names=["c", "size", "keys", "code"])

    return classes.select("c", "unit").mapInArrow(run, "c long, size int, keys array<long>, code array<long>")


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of rows of unit vectors, exact for small ones too."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(axis=1)) / 2))


def _angles(pairs: DataFrame) -> DataFrame:
    """pairs (u1 and u2 binary units, ...) with their angle in place of the units; 4 for vectors of other dimensions."""
    kept = [f for f in pairs.schema.fields if f.name not in ("u1", "u2")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                u1, u2 = (part.column(part.schema.get_field_index(x)).to_pylist() for x in ("u1", "u2"))
                out = np.full(len(u1), 4.0)
                sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(u1, u2, strict=True)])
                for size in np.unique(sizes[sizes > 0]).tolist():
                    i = np.flatnonzero(sizes == size)
                    out[i] = angle(matrix([u1[k] for k in i.tolist()]), matrix([u2[k] for k in i.tolist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in names), pa.array(out)], names=[*names, "angle"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return pairs.mapInArrow(run, StructType([*kept, StructField("angle", DoubleType())]))


def balls(members: DataFrame, classes: DataFrame, crowded: DataFrame, like: Tables, total: int) -> tuple[DataFrame, int]:
    """(c, ball, angle): classes within half the threshold's angle of the pivot of a ball, which is the pivot's class; and how many.

    A class looks at the pivots of the fullest of its buckets; a ball has BALL members or more.
    """
    met = hot_join(members.select("bucket", "c"), crowded, "bucket", "n", total)
    fullest = hold(met.groupBy("c").agg(F.max(F.struct("n", "bucket")).alias("x")).select("c", F.col("x.bucket").alias("bucket")))
    drawn = [F.min_by("c", F.xxhash64("c", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = fullest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *drawn).where(F.col("n") >= BALL)
    pivots = hold(pivots.select("bucket", "n", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("ball")))
    own = classes.select("c", F.col("unit").alias("u1"))
    theirs = classes.select(F.col("c").alias("ball"), F.col("unit").alias("u2"))
    sizes = pivots.groupBy("bucket").agg(F.max("n").alias("n"), F.collect_list("ball").alias("balls"))  # PIVOTS at most
    asked = hot_join(fullest, sizes, "bucket", "n", total).select("c", F.explode("balls").alias("ball"))
    counted = asked.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).join(theirs, "ball")
    near = _angles(hot_join(asked, counted, "ball", "n", total).join(own, "c").select("c", "ball", "u1", "u2"))
    half = math.acos(like.cosine) / 2 - SLACK
    near = hold(near.where(F.col("angle") <= half).select("c", "ball", "angle"))
    around = near.groupBy("ball").agg(F.count(F.lit(1)).alias("n"))
    # of several, the pivot with most classes around it, so that a group lies in few balls
    fuller = hot_join(near, around, "ball", "n", total).groupBy("c").agg(F.max(F.struct("n", "ball", "angle")).alias("x"))
    best = hold(fuller.select("c", F.col("x.ball").alias("ball"), F.col("x.angle").alias("angle")))
    large = best.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BALL)
    out, n = probed(hot_join(best, large, "ball", "n", total).select("c", "ball", "angle"), [])
    return out, n[0]


def _rooted(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least number in the component of each of n nodes under edges (x, y)."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal values of a sorted array, some at a time."""
    at, d = np.arange(len(group)), 1
    while len(at := at[at + d < len(group)]) and len(at := at[group[at] == group[at + d]]):
        yield at, at + d
        d += 1


def _dealt(members: DataFrame, total: int, count: str) -> DataFrame:
    """members (group, c, ...) with own, i, j: each once for every pair of blocks of its group that its own block is in; count is a column with the group's size."""
    own = members.withColumn("g", F.ceil(F.col(count) / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("c", F.lit(5)), F.col("g")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "g", count)


def _slots(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """rows with slot, of about GROUP rows; those of equal values in by go together."""
    return rows.withColumn("slot", F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(n / GROUP)))).cast("int"))


def _block_order(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The table in order of its blocks, and a number for each."""
    group = group.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("c", "ascending")])
    new = np.zeros(group.num_rows, dtype=bool)
    for x in ("bucket", "i", "j"):
        v = group[x].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return group, np.cumsum(new)


def _alike(group: pa.Table, number: np.ndarray, like: Tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a block, or of two, whose codes differ little."""
    code = group["code"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(group.num_rows, -1)
    own, size = group["own"].to_numpy(), group["size"].to_numpy()
    same = group["i"].to_numpy() == group["j"].to_numpy()
    for x, y in _pairs(number):
        ok = (same[x] | (own[x] != own[y])) & (size[x] == size[y])
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(code[x] ^ code[y]).sum(axis=1, dtype=np.int64) <= like.differing
        yield x[ok], y[ok]


MEMBER = "bucket long, i int, j int, own int, c long, size int, code array<long>"
FOUND = "c long, more long, root long"


def _involved(group: pa.Table, like: Tables) -> pa.Table:
    group, number = _block_order(group)
    hit = np.zeros(group.num_rows, dtype=bool)
    for x, y in _alike(group, number, like):
        hit[x] = hit[y] = True
    return group.select([x.split()[0] for x in MEMBER.split(", ")]).filter(pa.array(hit))


def _reranked(group: pa.Table, like: Tables) -> pa.Table:
    """For each class with links in these blocks: how many vectors it gains that it shares no earlier table with, and the least class that it is connected with."""
    group, number = _block_order(group)
    units_ = group["unit"].to_pylist()
    keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    bucket, weight, c = group["bucket"].to_numpy(), group["weight"].to_numpy(), group["c"].to_numpy()
    vectors = {size: matrix([u for u in units_ if len(u) == size]) for size in {len(u) for u in units_}}
    sizes = np.array([len(u) for u in units_])
    place = np.zeros(len(units_), dtype=np.int64)
    for size in vectors:
        place[sizes == size] = np.arange(int((sizes == size).sum()))
    more = np.zeros(group.num_rows, dtype=np.int64)
    xs, ys = [], []
    for x, y in _alike(group, number, like):
        first = np.argmax(keys[x] == keys[y], axis=1)
        ok = keys[x, first] == bucket[x]
        x, y = x[ok], y[ok]
        hit = np.zeros(len(x), dtype=bool)
        for size, v in vectors.items():
            at = np.flatnonzero(sizes[x] == size)
            hit[at] = np.einsum("ij,ij->i", v[place[x[at]]], v[place[y[at]]]) >= like.cosine
        x, y = x[hit], y[hit]
        np.add.at(more, x, weight[y])
        np.add.at(more, y, weight[x])
        xs.append(x)
        ys.append(y)
    nodes, at = np.unique(c, return_inverse=True)
    x, y = (at[np.concatenate(v)] if v else np.empty(0, dtype=np.int64) for v in (xs, ys))
    root = nodes[_rooted(x, y, len(nodes))]
    total = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(total, at, more)
    keep = total > 0
    return pa.table({"c": nodes[keep], "more": total[keep], "root": root[keep]})


def _with_ball(group: pa.Table, like: Tables) -> pa.Table:
    """Links between classes that ask (not inside) and members of a ball, for each pair of their blocks."""
    group, number = _block_order(group)
    inside, weight, c, ball = (group[x].to_numpy() for x in ("inside", "weight", "c", "bucket"))
    units_ = group["unit"].to_pylist()
    more, root = np.zeros(group.num_rows, dtype=np.int64), c.copy()
    edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        a, b = (start + np.flatnonzero(x) for x in (~inside[start:stop], inside[start:stop]))
        if len(a) and len(b):
            hit = matrix([units_[i] for i in a.tolist()]) @ matrix([units_[i] for i in b.tolist()]).T >= like.cosine
            more[a], more[b] = hit @ weight[b], weight[a] @ hit
    linked = more > 0
    root[linked] = ball[linked]
    return pa.table({"c": c[linked], "more": more[linked], "root": root[linked]})


def _ball_links(members: DataFrame, classes: DataFrame, ball: DataFrame, like: Tables, total: int) -> DataFrame:
    """(c, more, root) of links within balls, and between balls and the classes that meet them in a bucket."""
    weights = classes.select("c", "weight")
    own = hold(ball.join(weights, "c"))
    sizes = hold(own.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("all"), F.max("angle").alias("radius")))
    inside = hot_join(own, sizes, "ball", "n", total).select("c", (F.col("all") - F.col("weight")).alias("more"), F.col("ball").alias("root"))
    # classes and the balls of their buckets; of two balls, the members of the one of lower number ask
    homes = ball.select("c", F.col("ball").alias("home"))
    placed = members.select("bucket", "c").join(homes, "c", "left")
    shown = hold(placed.where("home is not null").select("bucket", F.col("home").alias("ball")).distinct())
    several = shown.groupBy("bucket").agg(F.count(F.lit(1)).alias("balls"), F.collect_list("ball").alias("list"))
    crowd = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(several, "bucket")
    asked = hot_join(placed, crowd.select("bucket", "n", "list"), "bucket", "n", total).select("c", "home", F.explode("list").alias("ball"))
    asked, n = probed(asked.where("home is null or home < ball").select("c", "ball").distinct(), [])
    theirs = sizes.join(classes.select(F.col("c").alias("ball"), F.col("unit").alias("u2")), "ball")
    counted = asked.groupBy("ball").agg(F.count(F.lit(1)).alias("asking")).join(theirs, "ball")
    met = hot_join(asked, counted, "ball", "asking", n[0]).join(classes.select("c", "weight", F.col("unit").alias("u1")), "c")
    full = math.acos(like.cosine)
    near = hold(_angles(met.select("c", "ball", "weight", "n", "all", "radius", "u1", "u2")).where(F.col("angle") - F.col("radius") <= full + SLACK))
    whole = F.col("angle") + F.col("radius") <= full - SLACK
    linked = near.where(whole)
    asking = linked.select("c", F.col("all").alias("more"), F.col("ball").alias("root"))
    gained = linked.groupBy("ball").agg(F.sum("weight").alias("more"))
    answering = hot_join(own, sizes.select("ball", "n").join(gained, "ball"), "ball", "n", total).select("c", "more", F.col("ball").alias("root"))
    # the rest: blocks of asking classes with blocks of members
    rest = near.where(~whole)
    pairs = rest.groupBy("ball").agg(F.count(F.lit(1)).alias("asking"), F.first("n").alias("n"))
    pairs = hold(pairs.select("ball", F.col("n").alias("held"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("ga"), F.ceil(F.col("n") / BLOCK).cast("int").alias("gb")))
    part = lambda g: F.pmod(F.xxhash64("c", F.lit(5)), F.col(g)).cast("int")
    left = rest.select("c", "ball", "weight").join(pairs, "ball").select("c", "weight", F.col("ball").alias("bucket"), part("ga").alias("i"), F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("j"), F.lit(False).alias("inside"))
    right = hot_join(own.select("c", "ball", "weight"), pairs, "ball", "held", total).select("c", "weight", F.col("ball").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("ga") - 1)).alias("i"), part("gb").alias("j"), F.lit(True).alias("inside"))
    both, n = probed(left.union(right), [])
    blocks = _slots(both.join(classes.select("c", "unit"), "c"), n[0], "bucket", "i", "j")
    compared = blocks.groupBy("slot").applyInArrow(lambda group: _with_ball(group, like), FOUND)
    return inside.union(asking).union(answering).union(compared)


def _bucket_links(members: DataFrame, classes: DataFrame, codes: DataFrame, like: Tables, total: int) -> DataFrame:
    """(c, more, root) of links between classes (members) that lie in no ball."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met, n = probed(_dealt(hot_join(members, sizes, "bucket", "n", total), total, "n"), [])
    by = ["bucket", "i", "j"]
    names = [x.split()[0] for x in MEMBER.split(", ")]
    involved, n = probed(_slots(met, n[0], *by).select(*names, "slot").groupBy("slot").applyInArrow(lambda group: _involved(group, like), MEMBER), [])
    whole = _slots(involved, 4 * n[0], *by).join(codes.select("c", "keys"), "c").join(classes.select("c", "unit", "weight"), "c")
    return whole.groupBy("slot").applyInArrow(lambda group: _reranked(group, like), FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, crowd: int = CROWD) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable by links), kept (it is that vector).

    Links are pairs of cosine >= the threshold. Null and zero vectors and those with null or non-finite components have no
    links; vectors of different lengths have none with each other. Repeated rows are vectors each, so a row that repeats
    links with its copies. A null vec_id is never a component's least unless all are null. Columns besides vec_id and embedding are ignored.
    """
    rows, total = probed(units(vectors), [], memory=False)
    grouped = rows.where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes, n = probed(grouped.withColumn("c", F.monotonically_increasing_id()), [], rows=100_000)
    like = tables(n[0], cosine)
    codes = hold(coded(classes, learn(classes, n[0], like), like), rows=100_000)
    members = codes.select(F.explode("keys").alias("bucket"), "c", "size", "code")
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts, crowds = probed(counts, [F.sum("n"), F.count(F.when(F.col("n") > crowd, 1))])
    all_met = crowds[1] or 0
    members = cut(hot_join(members, counts, "bucket", "n", all_met).drop("n"))
    found = None
    if crowds[2]:
        ball, n = balls(members, classes, counts.where(F.col("n") > crowd), like, all_met)
        if n:
            found = _ball_links(members, classes, ball, like, all_met)
            members = members.join(ball.select("c"), "c", "left_anti")
    others = _bucket_links(members, classes, codes, like, all_met)
    found, some = probed(others if found is None else found.union(others), [])
    by = classes.select("c", "unit", "weight", "least")
    if some[0]:
        near = hold(components(found.select(F.col("c").alias("u"), F.col("root").alias("v"))))
        more = found.groupBy("c").agg(F.sum("more").alias("more"))
        by = by.join(more, "c", "left").join(near.withColumnRenamed("node", "c"), "c", "left")
        by = by.withColumns({"comp": F.coalesce("component", "c"), "more": F.coalesce("more", F.lit(0))})
        least = by.groupBy("comp").agg(F.min("least").alias("low"))
        by = by.join(least, "comp")
    else:
        by = by.withColumns({"more": F.lit(0), "low": F.col("least")})
    by = hold(by.select("unit", "weight", (F.col("more") + F.col("weight") - 1).alias("n_links"), "low"), rows=100_000)
    met = hot_join(rows.where("unit is not null"), by, "unit", "weight", total[0]).select("vec_id", "n_links", F.coalesce("low", "vec_id").alias("component_id"))
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
