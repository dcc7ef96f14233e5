"""Example selection: exact nearest neighbours with gates, thresholds and backfill.

The ten strategies are one plan with parameters. Targets are a stated set of checked size
that travels to the pool; each task scores its part of the pool in blocks. One matrix product
gives rough keys of all pairs of a block; those that can be among the best k are computed
exactly, and a task keeps the best k of every target. A window over these few rows picks the
k of all. No pair of rows is ever materialised.

The gate is a similarity join of the distinct skeletons of both sides (``similarity_join``);
a pool row carries the targets' skeletons that its own passes with.

Scores are in double precision, from differences of the vectors, so equal vectors have
equal scores; ties go to the lower pool id. A zero vector has similarity 0 with every
vector. Rows whose vector is null, empty, of another length than the first target's,
or has null or non-finite components are not offered, and get no examples. Null skeletons
count as the word None; a null db_id or question differs from every other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.operators.similarity_join import similar

#: Targets that travel at once; more are taken in parts.
BLOCK = 4096
#: Most targets of one call: all of them pass through the driver, part by part. A longer set is split by the caller.
TARGETS = 1 << 18
THRESHOLD = 0.85


@dataclass(frozen=True)
class Strategy:
    """metric: euclidean, cosine or hybrid (distance less skeleton similarity); gate: keep similar skeletons only; backfill: put the others behind instead."""

    metric: str = "euclidean"
    masked: bool = False
    most: float | None = None
    skeleton: str | None = None
    gate: bool = False
    backfill: bool = True
    other_question: bool = False


# Strategy names are those of the command line.
STRATEGIES = {
    "COSSIMILAR": Strategy(metric="cosine", other_question=True),
    "EUCDISTANCE": Strategy(),
    "EUCDISTANCETHRESHOLD": Strategy(most=THRESHOLD),
    "EUCDISSKLSIMTHR": Strategy(masked=True, skeleton="skeleton", gate=True),
    "EUCDISQUESTIONMASK": Strategy(masked=True),
    "EUCDISPRESKLSIMTHR": Strategy(skeleton="pre_skeleton", gate=True),
    "EUCDISPRESKLSIMPLUS": Strategy(metric="hybrid", skeleton="pre_skeleton"),
    "EUCDISMASKPRESKLSIMTHR": Strategy(masked=True, skeleton="pre_skeleton", gate=True),
    "EUCDISMASKPRESKLSIMTHRSHIFT": Strategy(masked=True, skeleton="pre_skeleton", gate=True, backfill=False),
}


def similarity(a: str, b: str) -> float:
    """Multiset Jaccard similarity of two token strings."""
    x, y = a.strip().split(" "), b.strip().split(" ")
    both = sum((Counter(x) & Counter(y)).values())
    return both / (len(x) + len(y) - both)


def select(pool: DataFrame, targets: DataFrame, strategy: Strategy, k: int, cross_domain: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """(t_idx, c_idx, rank, score, sim): the first k pool rows of each target.

    Both sides have idx, db_id, question, vector, and the strategy's skeleton column. score is the distance, the
    similarity, or the hybrid; sim the skeleton similarity (null if the strategy has none). A target may get fewer than k.
    """
    names = ["idx", "db_id", "question", "vector", *([strategy.skeleton] if strategy.skeleton else [])]
    if missing := [c for c in names if c not in pool.columns or c not in targets.columns]:
        raise ValueError(f"the strategy needs the columns {missing} on both sides")
    held = _held(targets.select(*names).orderBy("idx"))
    parts = []
    for at in range(0, max(1, len(held)), BLOCK):
        own = held.iloc[at : at + BLOCK]
        rows = pool.select(*names)
        parts.append(_block(_gated(rows, own, strategy, threshold) if strategy.gate else rows, own, strategy, k, cross_domain, threshold))
    return ranked(parts, strategy, k)


def ranked(parts: list[DataFrame], strategy: Strategy, k: int) -> DataFrame:
    """The first k of the best rows of all tasks."""
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    order = [F.col("late"), F.col("key"), F.col("c_idx")]
    chosen = best.withColumn("rank", F.row_number().over(Window.partitionBy("t_idx").orderBy(*order))).where(F.col("rank") <= k)
    score = F.lit(0.0) - F.col("key") if strategy.metric == "cosine" else F.col("key")
    return chosen.select("t_idx", "c_idx", "rank", score.alias("score"), "sim")


def _held(targets: DataFrame) -> pd.DataFrame:
    """The targets on the driver, if they are as few as was said."""
    rows = targets.limit(TARGETS + 1).toPandas()
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} targets: split them")
    return rows


def vectors(column: pa.ListArray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a vector of that width (None: that of the first one) and finite components, and the matrix of these."""
    values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    offsets, sizes = column.offsets.to_numpy(), np.diff(column.offsets.to_numpy())
    known = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    if width is None:
        width = int(sizes[known][0]) if known.any() else 0
    at = np.flatnonzero(known & (sizes == width))
    m = values[offsets[at][:, None] + np.arange(width)]
    ok = np.isfinite(m).all(axis=1)
    return at[ok], m[ok]


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


class Scan:
    """The best k pool rows of a block of targets so far, and the bounds that further rows must meet."""

    def __init__(self, targets: pd.DataFrame, tv: np.ndarray, strategy: Strategy, k: int, cross_domain: bool, threshold: float):
        self.strategy, self.k, self.cross_domain, self.threshold, self.tv = strategy, k, cross_domain, threshold, tv
        self.db, self.question, self.idx = (targets[c].to_numpy() for c in ("db_id", "question", "idx"))
        self.lengths = _lengths(tv)
        self.kinds, self.kind = np.unique(targets[strategy.skeleton].to_numpy(dtype=str), return_inverse=True) if strategy.skeleton else (None, None)
        self.known: dict[tuple[str, str], float] = {}
        self.rows = tuple(np.empty(0, dtype=d) for d in (np.int64, np.int32, np.float64, np.int64, object))  # target, late, key, c_idx, skeleton
        self.late, self.key = np.full(len(tv), 2), np.full(len(tv), np.inf)  # of the k-th row

    def _near(self, at: slice, cv: np.ndarray, c_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs by one matrix product, and how far they may be off."""
        product = self.tv[at] @ cv.T
        if self.strategy.metric == "cosine":
            both = self.lengths[at][:, None] * c_lengths[None, :]
            return -np.divide(product, both, out=np.zeros_like(product), where=both > 0), np.full(len(product), 1e-9)
        near = np.sqrt(np.maximum((self.lengths[at] ** 2)[:, None] + (c_lengths**2)[None, :] - 2 * product, 0))
        return near, 1e-6 * (1 + self.lengths[at] + c_lengths.max())

    def _exact(self, i: np.ndarray, j: np.ndarray, cv: np.ndarray, c_lengths: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for start in range(0, len(i), 1 << 16):
            x, y = self.tv[i[start : start + (1 << 16)]], cv[j[start : start + (1 << 16)]]
            if self.strategy.metric == "cosine":
                both = self.lengths[i[start : start + (1 << 16)]] * c_lengths[j[start : start + (1 << 16)]]
                product = (x * y).sum(axis=1)
                out[start : start + (1 << 16)] = -np.divide(product, both, out=np.zeros_like(product), where=both > 0)
            else:
                out[start : start + (1 << 16)] = np.sqrt(((y - x) ** 2).sum(axis=1))
        return out

    def _sims(self, skeletons: np.ndarray) -> np.ndarray:
        """Similarities of the targets' skeletons and these."""
        kinds, of = np.unique(skeletons.astype(str), return_inverse=True)
        for pair in ((a, b) for a in self.kinds for b in kinds if (a, b) not in self.known):
            self.known[pair] = similarity(*pair)
        return np.array([[self.known[a, b] for b in kinds] for a in self.kinds])[:, of]

    def add(self, c_idx: np.ndarray, cv: np.ndarray, db: np.ndarray, question: np.ndarray, skeletons: np.ndarray | None, passing: list | None) -> None:
        """Takes in pool rows, about a thousand at a time. passing: for each row, the targets' skeletons that its own passes the gate with."""
        s, k = self.strategy, self.k
        c_lengths = _lengths(cv)
        sims = self._sims(skeletons) if s.metric == "hybrid" else None
        gate = None
        if s.gate:
            gate = np.zeros((len(self.kinds), len(cv)), dtype=bool)
            sizes = [len(x) for x in passing]
            gate[np.concatenate([np.asarray(x, dtype=np.int64) for x in passing]) if sum(sizes) else np.empty(0, dtype=np.int64), np.repeat(np.arange(len(cv)), sizes)] = True
        found = []
        for start in range(0, len(self.tv), 512):
            at = slice(start, start + 512)
            near, slack = self._near(at, cv, c_lengths)
            ok = np.ones(near.shape, dtype=bool)
            if self.cross_domain:
                ok &= db[None, :] != self.db[at][:, None]
            if s.other_question:
                ok &= question[None, :] != self.question[at][:, None]
            if s.most is not None:
                ok &= near <= self.threshold + slack[:, None]
            rough = near - sims[self.kind[at]] if sims is not None else near
            first = gate[self.kind[at]] if gate is not None else np.ones(near.shape, dtype=bool)
            for level, own in ((0, ok & first), (1, ok & ~first)):
                if level and (gate is None or not s.backfill):
                    continue
                bound = np.where(self.late[at] > level, np.inf, np.where(self.late[at] == level, self.key[at] + slack, -np.inf))
                ranked = np.where(own, rough, np.inf)
                if near.shape[1] > k:
                    bound = np.minimum(bound, np.partition(ranked, k - 1, axis=1)[:, k - 1] + 2 * slack)
                i, j = np.nonzero(own & (ranked <= bound[:, None]))
                if not len(i):
                    continue
                key = self._exact(i + start, j, cv, c_lengths)
                if s.most is not None:
                    i, j, key = i[key <= self.threshold], j[key <= self.threshold], key[key <= self.threshold]
                if sims is not None:
                    key = key - sims[self.kind[i + start], j]
                found.append((i + start, np.full(len(i), level, dtype=np.int32), key, c_idx[j], np.empty(len(i), dtype=object) if skeletons is None else skeletons[j]))
        if not found:
            return
        t, late, key, c, skeleton = (np.concatenate(x) for x in zip(self.rows, *found, strict=True))
        order = np.lexsort((c, key, late, t))
        t, late, key, c, skeleton = (x[order] for x in (t, late, key, c, skeleton))
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        kept = rank < k
        self.rows = tuple(x[kept] for x in (t, late, key, c, skeleton))
        full = rank == k - 1
        self.late[t[full]], self.key[t[full]] = late[full], key[full]


def _block(pool: DataFrame, targets: pd.DataFrame, strategy: Strategy, k: int, cross_domain: bool, threshold: float, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The best rows of each task for a block of targets. bounds: late and key that the k-th row of each target does not exceed, where known."""
    at, tv = vectors(pa.array([None if v is None else list(v) for v in targets["vector"]], pa.list_(pa.float64())))
    targets = targets.iloc[at].reset_index(drop=True)
    sent = pool.sparkSession.sparkContext.broadcast((targets, tv, None if bounds is None else tuple(b[at] for b in bounds)))
    columns = ["idx", "db_id", "question", "vector"] + [c for c in (strategy.skeleton, "_passing") if c in pool.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tv, known = sent.value
        if not len(own):
            return
        scan = Scan(own, tv, strategy, k, cross_domain, threshold)
        if known is not None:
            scan.late, scan.key = known[0].copy(), known[1].copy()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = dict(zip(columns, batch.slice(start, 1024).columns, strict=True))
                rows, cv = vectors(part["vector"], tv.shape[1])
                if not len(rows):
                    continue
                take = pa.array(rows)
                db, question = (part[c].take(take).to_numpy(zero_copy_only=False) for c in ("db_id", "question"))
                skeletons = part[strategy.skeleton].take(take).to_numpy(zero_copy_only=False) if strategy.skeleton else None
                scan.add(part["idx"].take(take).to_numpy(), cv, db, question, skeletons, part["_passing"].take(take).to_pylist() if strategy.gate else None)
        t, late, key, c, skeleton = scan.rows
        sims = [similarity(scan.kinds[scan.kind[i]], str(x)) for i, x in zip(t.tolist(), skeleton.tolist(), strict=True)] if strategy.skeleton else [None] * len(t)
        yield pa.RecordBatch.from_arrays([pa.array(own["idx"].to_numpy()[t], pa.int64()), pa.array(c, pa.int64()), pa.array(late, pa.int32()), pa.array(key, pa.float64()), pa.array(sims, pa.float64())], names=["t_idx", "c_idx", "late", "key", "sim"])

    return pool.select(*columns[:3], F.col("vector").cast("array<double>").alias("vector"), *columns[4:]).mapInArrow(run, "t_idx long, c_idx long, late int, key double, sim double")


def _gated(pool: DataFrame, targets: pd.DataFrame, strategy: Strategy, threshold: float) -> DataFrame:
    """The pool with _passing: the numbers of those skeletons of the targets, in order, that a row's own is similar enough to."""
    spark, column = pool.sparkSession, strategy.skeleton
    kinds = np.unique(targets.iloc[vectors(pa.array([None if v is None else list(v) for v in targets["vector"]], pa.list_(pa.float64())))[0]][column].to_numpy(dtype=str)).tolist()
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(kinds)], "_kind int, text string")
    own = pool.select(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("text"))
    passing = similar(asked, own, threshold).join(asked.withColumnRenamed("text", "a"), "a")
    passing = passing.groupBy(F.col("b").alias("_own")).agg(F.collect_list("_kind").alias("_passing"))  # of the targets, which are few
    met = pool.withColumn("_own", F.coalesce(F.col(column).cast("string"), F.lit("None"))).join(passing, "_own", "left").drop("_own")
    return met.withColumn("_passing", F.coalesce("_passing", F.array().cast("array<int>")))


class Draw:
    """The first k pool rows of each target so far, in an order that numbers and seed fix. Arrays of k places a target, whatever the pool's size."""

    #: Targets and pool rows whose keys are made at once.
    SIDE = 256, 1024

    def __init__(self, targets: pd.DataFrame, k: int, seed: int = 0, cross_domain: bool = False):
        self.t_idx, self.db, self.k, self.cross_domain = targets["t_idx"].to_numpy(dtype=np.int64), targets["t_db"].to_numpy(dtype=object), k, cross_domain
        with np.errstate(over="ignore"):
            self.part = self.t_idx.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed + 1)
        most = np.iinfo(np.int64).max
        self.free, self.key, self.c_idx = np.ones((len(targets), k), dtype=bool), np.full((len(targets), k), most), np.full((len(targets), k), most)

    def _keys(self, at: slice, own: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self.part[at][:, None] + own[None, :]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x >>= np.uint64(1)
        return x.view(np.int64)

    def add(self, c_idx: np.ndarray, db: np.ndarray) -> None:
        for start in range(0, len(c_idx), self.SIDE[1]):
            self._add(c_idx[start : start + self.SIDE[1]], db[start : start + self.SIDE[1]])

    def _add(self, c_idx: np.ndarray, db: np.ndarray) -> None:
        k, codes = self.k, None
        own = c_idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for start in range(0, len(self.t_idx), self.SIDE[0]):
            at = slice(start, start + self.SIDE[0])
            keys, bound = self._keys(at, own), self.key[at, -1]
            if self.free[at, -1].any() and len(c_idx) > k:  # only the first rows of a task
                if codes is None:
                    codes = pd.factorize(np.concatenate([self.db, db]))[0] if self.cross_domain else np.zeros(len(self.db) + len(db), dtype=np.int64)
                ranked = np.where(codes[: len(self.db)][at][:, None] == codes[None, len(self.db) :], np.iinfo(np.int64).max, keys) if self.cross_domain else keys
                bound = np.minimum(bound, np.partition(ranked, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(keys <= bound[:, None])
            if self.cross_domain and len(i):
                other = np.asarray(db[j] != self.db[at][i], dtype=bool)
                i, j = i[other], j[other]
            if not len(i):
                continue
            changed, i_own = np.unique(i, return_inverse=True)
            rows = changed + start
            target = np.concatenate([np.repeat(np.arange(len(rows)), k), i_own])
            free = np.concatenate([self.free[rows].ravel(), np.zeros(len(i), dtype=bool)])
            key = np.concatenate([self.key[rows].ravel(), keys[i, j]])
            c = np.concatenate([self.c_idx[rows].ravel(), c_idx[j]])
            order = np.lexsort((c, key, free, target))
            first = order[np.arange(len(order)) - np.searchsorted(target[order], target[order]) < k]
            for held, new in ((self.free, free), (self.key, key), (self.c_idx, c)):
                held[rows] = new[first].reshape(len(rows), k)

    def rows(self) -> Iterator[pd.DataFrame]:
        for start in range(0, len(self.t_idx), 4096):
            at = slice(start, start + 4096)
            i, j = np.nonzero(~self.free[at])
            yield pd.DataFrame({"t_idx": self.t_idx[at][i], "c_idx": self.c_idx[at][i, j], "key": self.key[at][i, j]})


def select_random(pool: DataFrame, targets: DataFrame, k: int, seed: int = 0, cross_domain: bool = False) -> DataFrame:
    """(t_idx, c_idx, rank): k pool rows of each target in an order fixed by the seed.

    A task's k first suffice, so only these are ranked. Each pair's place is fixed by itself, so each pair is looked at: the
    work grows with targets times pool, and is dealt evenly over the cores.
    """
    held = _held(targets.select(F.col("idx").alias("t_idx"), F.col("db_id").alias("t_db")))
    sent = pool.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = Draw(sent.value, k, seed, cross_domain)
        for c in batches:
            draw.add(c["idx"].to_numpy(dtype=np.int64), c["db_id"].to_numpy(dtype=object))
        yield from draw.rows()

    dealt = pool.select("idx", "db_id").repartition(pool.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.mapInPandas(run, "t_idx long, c_idx long, key long")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("t_idx").orderBy("key", "c_idx"))).where(F.col("rank") <= k).select("t_idx", "c_idx", "rank")
