"""Operator 11, a Merkle manifest of a dataset: trees of three children, one a source, and one over their roots.

Every parent stores its preimage, the concatenated hexadecimal hashes of its children. A
leaf's proof comes from the preimages of its ancestors: its own slot of 64 characters is
excised for the siblings, and a replacement is spliced in there to fold another leaf up to
the root.

Leaves get exact positions by range partitions (a source in a third of all rows spans many),
and SPAN consecutive ones, 3 to the power LEVELS, are a block: one group of bounded size,
in which LEVELS levels of parents are made at once. The blocks of a source are the leaves of
the next round, so a tree over a hundred billion rows takes four rounds. Downwards, a block's
preimages towards the root join its row, not its leaves, and are dealt out within it.

A leaf is the hash of doc_id, source, lang, n_chars and text: ``-`` for a null, else the
UTF-8 byte count, a colon and the value. Leaves of a source ascend by doc_id, null first; rows
of one doc_id by their hashes, so repeated rows are leaves each and any order of equal ones is
the same. A null source is a source. An empty table has no root and gives no rows. Columns
besides the five are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm.common import cut, table

ARITY = 3
LEVELS = 7
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(fields: dict[str, Column]) -> Column:
    """The hash of a row's fields, in their order."""

    def one(x: Column) -> Column:
        x = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.sha2(F.concat(*(one(x) for x in fields.values())).cast("binary"), 256)


def climb(nodes: list[str], levels: int | None) -> tuple[list[list[str]], str]:
    """Preimages of each level above the nodes, and the hash on top; levels None: until one node remains."""
    above = []
    while len(nodes) > 1 if levels is None else len(above) < levels:
        above.append(["".join(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [digest(x) for x in above[-1]]
    return above, nodes[0]


def way(above: list[list[str]], place: int) -> tuple[list[str], list[int]]:
    """Preimages of a node's ancestors, lowest first, and the slot of the way up in each."""
    out, slots = [], []
    for level in above:
        slots.append(place % ARITY)
        place //= ARITY
        out.append(level[place])
    return out, slots


def siblings(preimages: list[str], slots: list[int]) -> str:
    """The preimages without the own slots: the proof, level by level, left to right."""
    return "".join(x[: HEX * s] + x[HEX * (s + 1) :] for x, s in zip(preimages, slots, strict=True))


def folded(node: str, preimages: list[str], slots: list[int]) -> str:
    """The root over a replaced leaf."""
    for x, s in zip(preimages, slots, strict=True):
        node = digest(x[: HEX * s] + node + x[HEX * (s + 1) :])
    return node


def placed(items: DataFrame, order: list[str]) -> DataFrame:
    """items (tree, ...) with place, gapless from 0 within each tree by order, and total, the items of its tree."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *order, "_tie"]  # the tie only spreads equal items over partitions
    dealt = items.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    names = [*items.columns, "_part", "_at"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for x in batch.column(0).to_pylist():
                last, n = (x, n + 1) if x == last else (x, 0)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=names)

    kept = cut(dealt.select("tree", *(c for c in items.columns if c != "tree")).mapInArrow(number, items.select("tree", *(c for c in items.columns if c != "tree")).withColumns({"_part": F.lit(0), "_at": F.lit(0).cast("long")}).schema))
    counts = kept.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("tree")
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("total"))
    return kept.join(offsets, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_before")).select(*items.columns, "place", "total")


#: A block: its place and its number among its tree's blocks, the hash on top, and its members in order.
BLOCKS = "tree string, place long, total long, node string, nodes array<string>"


def blocks(items: DataFrame, carried: str, levels: int) -> DataFrame:
    """A row for each ARITY ** levels consecutive items (tree, place, total, node, and carried columns, which become lists)."""
    span = ARITY**levels
    names = [x.split()[0] for x in carried.split(", ")] if carried else []
    kinds = ["long" if x.endswith(" long") else "string" for x in carried.split(", ")] if carried else []
    schema = BLOCKS + "".join(f", {n} array<{k}>" for n, k in zip(names, kinds, strict=True))

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        total, place = group["total"][0].as_py(), group["place"][0].as_py()
        _, top = climb(group["node"].to_pylist(), levels if total > span else None)
        lists = {"nodes": ("node", pa.string()), **{n: (n, pa.int64() if k == "long" else pa.string()) for n, k in zip(names, kinds, strict=True)}}
        return pa.table({"tree": [group["tree"][0].as_py()], "place": pa.array([place // span], pa.int64()), "total": pa.array([-(-total // span)], pa.int64()), "node": [top], **{n: pa.array([group[c].to_pylist()], pa.list_(t)) for n, (c, t) in lists.items()}})

    return items.withColumn("_block", F.expr(f"place div {span}")).select("tree", "_block", "place", "total", "node", *names).groupBy("tree", "_block").applyInArrow(work, schema)


def rise(items: DataFrame, carried: str, levels: int) -> list[DataFrame]:
    """Rounds of blocks, until each tree is one block."""
    rounds = [cut(blocks(items, carried, levels))]
    while rounds[-1].agg(F.max("total")).first()[0] not in (None, 1):
        rounds.append(cut(blocks(rounds[-1].select("tree", "place", "total", "node"), "", levels)))
    return rounds


#: A node's way to the root: preimages and slots, and the hashes on top of its source and of all.
WAY = "preimages array<string>, slots array<int>, subroot string, root string"


def descend(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """The blocks of the first round, each with its way to the root; top has (tree, WAY) for each tree."""
    ways = top
    for k in range(len(rounds) - 1, -1, -1):
        by = ["tree"] if k == len(rounds) - 1 else ["tree", "place"]
        ways = rounds[k].join(ways, by)
        if k:
            ways = ways.select("tree", "place", "total", "nodes", *(x.split()[0] for x in WAY.split(", "))).mapInArrow(lambda batches: _dealt(batches, levels), "tree string, place long, " + WAY)
    return ways


def _ways(row: dict, levels: int) -> Iterator[tuple[list[str], list[int]]]:
    """The way of each of a block's nodes."""
    above, _ = climb(row["nodes"], levels if row["total"] > 1 else None)
    for i in range(len(row["nodes"])):
        preimages, slots = way(above, i)
        yield preimages + row["preimages"], slots + row["slots"]


def _dealt(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """A row for each node of the blocks, which are the blocks of the round below."""
    span = ARITY**levels
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string()]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            rows = [(row["tree"], row["place"] * span + i, p, s, row["subroot"], row["root"]) for i, (p, s) in enumerate(_ways(row, levels))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "place", "preimages", "slots", "subroot", "root"])


@dataclass
class Manifest:
    """Rounds of blocks of the sources' trees and of the tree over their roots."""

    sources: list[DataFrame]
    top: list[DataFrame]
    levels: int


def build(docs: DataFrame, replaced: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of docs. replaced: columns in place of some of FIELDS, which make the leaves that ``audit`` folds."""
    own = {x: F.col(x) for x in FIELDS}
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))  # a null source comes first
    items = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("node"), leaf(own | (replaced or {})).alias("other"))
    sources = rise(placed(items, ["doc_id", "node"]), "doc_id long, other string", levels)
    subroots = sources[-1].select(F.lit("").alias("tree"), "node", F.col("tree").alias("source"))
    return Manifest(sources, rise(placed(subroots, ["source"]), "source string", levels), levels)


def _source_ways(manifest: Manifest) -> DataFrame:
    """(tree, WAY) of each source's root."""
    levels = manifest.levels
    none = {"preimages": F.array().cast("array<string>"), "slots": F.array().cast("array<int>"), "subroot": F.lit(None).cast("string"), "root": F.col("node")}
    top = manifest.top[-1].select("tree", *(c.alias(n) for n, c in none.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows = [(s, p, slots, n, row["root"]) for s, n, (p, slots) in zip(row["source"], row["nodes"], _ways(row, levels), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "preimages", "slots", "subroot", "root"])

    return descend(manifest.top, top, levels).select("total", "source", "nodes", "preimages", "slots", "root").mapInArrow(run, "tree string, " + WAY)


def audit(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (over the replaced leaf), verified, siblings (the proof itself) of each leaf."""
    levels = manifest.levels
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.string()]
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                rows = []
                for doc_id, node, other, (preimages, slots) in zip(row["doc_id"], row["nodes"], row["other"], _ways(row, levels), strict=True):
                    proof, root = siblings(preimages, slots), folded(other, preimages, slots)
                    rows.append((doc_id, node, row["subroot"], row["root"], digest(proof), root, root == row["root"], proof))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ways = descend(manifest.sources, _source_ways(manifest), levels)
    held = ways.select("total", "nodes", "doc_id", "other", "preimages", "slots", "subroot", "root")
    return held.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings string")


def parents(manifest: Manifest) -> DataFrame:
    """The stored preimages: source, level (1 above the leaves), position, preimage, node, of the sources' trees."""
    levels = manifest.levels
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                above, _ = climb(row["nodes"], levels if row["total"] > 1 else None)
                source = None if row["tree"] == "n" else row["tree"][1:]
                rows = [(source, base + h + 1, row["place"] * ARITY ** (levels - h - 1) + i, x, digest(x)) for h, level in enumerate(above) for i, x in enumerate(level)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["source", "level", "position", "preimage", "node"])

    out = None
    for k, one in enumerate(manifest.sources):
        rows = one.select("tree", "place", "total", "nodes").mapInArrow(lambda batches, base=k * levels: run(batches, base), "source string, level int, position long, preimage string, node string")
        out = rows if out is None else out.union(rows)
    return out


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; where 2 divides the checksum of a doc_id, the folded leaf has lost its text's line ends."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return audit(build(docs, {"text": text})).drop("siblings")


def _oracle(depth: int = 13) -> str:
    """SQL for up to 3 ** depth leaves of a source and as many sources."""

    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(field(text if x == "text" else x) for x in FIELDS) + ")"

    step = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: " + step.format(x="xor(c, b)") + "))"
    parts = [
        f"d AS (SELECT doc_id, source, {hashed('text')} AS leaf, {hashed('t')} AS other FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM documents))",
        "a0 AS (SELECT coalesce('s' || source, 'n') AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h FROM d)",
        "x AS (SELECT coalesce('s' || source, 'n') AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, doc_id, leaf, other FROM d)",
    ]
    for name, depth_of in (("a", depth), ("b", depth)):
        for i in range(depth_of):
            many = f"(SELECT k FROM {name}{i} GROUP BY k HAVING count(*) > 1)"
            parts.append(f"{name}{i + 1} AS (SELECT k, p // 3 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM {name}{i} WHERE k IN {many} GROUP BY k, p // 3 UNION ALL SELECT k, p, h FROM {name}{i} WHERE k NOT IN {many})")
            parts.append(f"{name}s{i} AS (SELECT k, p // 3 AS p, list(h ORDER BY p) AS l FROM {name}{i} WHERE k IN {many} GROUP BY k, p // 3)")
        if name == "a":
            parts.append(f"b0 AS (SELECT '' AS k, row_number() OVER (ORDER BY encode(k)) - 1 AS p, h, k AS source FROM a{depth})")
    proof, fold, joins = [], "other", []
    for name, key, place in (("a", "x.k", "x.p"), ("b", "''", "b0.p")):
        for i in range(depth):
            t = f"{name}s{i}"
            down, slot = f"({place} // {3 ** (i + 1)})", f"({place} // {3**i} % 3 + 1)"
            joins.append(f"LEFT JOIN {t} ON {t}.k = {key} AND {t}.p = {down}")
            rest = f"array_to_string({t}.l[1:{slot} - 1], '')", f"array_to_string({t}.l[{slot} + 1:], '')"
            proof.append(f"coalesce({rest[0]} || {rest[1]}, '')")
            joins.append(f", LATERAL (SELECT CASE WHEN {t}.l IS NULL THEN {fold} ELSE sha256({rest[0]} || {fold} || {rest[1]}) END AS f) f{t}")
            fold = f"f{t}.f"
    # joins first, then the folds, each of which uses the one below
    body = "FROM x JOIN b0 ON b0.source = x.k " + " ".join(j for j in joins if j.startswith("LEFT")) + " " + " ".join(j for j in joins if j.startswith(","))
    return f"WITH {', '.join(parts)} SELECT x.doc_id, x.leaf, b0.h AS subroot, r.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, {fold} AS folded_root, {fold} = r.h AS verified {body}, b{depth} r"


OP11_SQL = _oracle(8)
