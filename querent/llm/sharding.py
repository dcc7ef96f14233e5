"""Operator 7, sharding by balanced label propagation.

Documents that share a group (a link is a group of two; copies of one text are one group)
should share a shard, and the shards' row counts stay at most one apart throughout. Labels
start balanced. In each round a join gives every linked document the number of its
neighbours in each shard, and it asks to move to the shard with most of them. Swaps and
cycles between shards are granted first; what is left over is paid back by documents
without links, which move the other way. Where a flow exceeds its quota, the first documents
by group size and group go, so small groups stay whole.

First only shards with unlinked documents left are open (ties: the lower shard), so a group
larger than a shard fills one after another. When no more can move so, linked documents ask
for every shard and make room for each other; ties then fall by group and round, so that
about as many ask each way. A shard that no one could enter is shut for the next round. After
PATIENCE rounds in which nothing moved, or 2 * rounds in all, what is still parted stays so.

Neighbour counts are aggregates by (group, shard), at most one row for each shard however
large the group; members of a hot group are not brought together to meet them. Ranks within a shard come from a range partitioning and counts by
partition, never from a window over a whole shard. Rounds cut lineage by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm.common import cut, hot_join, hot_limit, table

SHARDS = 8
ROUNDS = 16
PATIENCE = 4


def ranked(df: DataFrame, classes: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with a gapless rank from 0 within each class, by order; rows of a class may lie in many partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *classes, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", *classes).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*classes).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_part", *classes).orderBy(*order)
    out = dealt.join(F.broadcast(offsets), ["_part", *classes])
    return out.withColumn(name, (F.row_number().over(within) - 1 + F.col("_before")).cast("long")).drop("_part", "_before")


def _way(a: int, b: int, flows: dict[tuple[int, int], int], left: list[int]) -> list[int]:
    """Shards from a to b of a shortest way along flows, or by an unlinked document where some are left; empty if there is none."""
    came = {a: a}
    queue = [a]
    for x in queue:
        for y in range(len(left)):
            if y not in came and (flows.get((x, y), 0) or left[x]):
                came[y] = x
                queue.append(y)
    if b not in came:
        return []
    way = [b]
    while way[-1] != a:
        way.append(came[way[-1]])
    return way[::-1]


def _quotas(asked: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """(linked documents that may go from a to b, unlinked documents that go from a to b) for each ordered pair.

    Every shard loses as many as it gets. Cycles of linked documents come first, those of two shards before longer ones.
    """
    rest, left = dict(sorted(asked.items())), list(free)
    go, back = dict.fromkeys(rest, 0), dict.fromkeys([(a, b) for a in range(len(free)) for b in range(len(free))], 0)
    for a, b in rest:
        n = min(rest[a, b], rest.get((b, a), 0))
        for x in ((a, b), (b, a)) if n else ():
            rest[x] -= n
            go[x] += n
    for have in ([0] * len(left), left):
        for a, b in rest:
            while rest[a, b] and (way := _way(b, a, rest, have)):
                steps = [((x, y), rest.get((x, y), 0)) for x, y in zip(way, way[1:], strict=False)]
                n = min(rest[a, b], *(own or have[x] for (x, _), own in steps))
                rest[a, b] -= n
                go[a, b] += n
                for (x, y), own in steps:
                    if own:
                        rest[x, y] -= n
                        go[x, y] += n
                    else:
                        have[x] -= n
                        back[x, y] += n
    return go, {x: n for x, n in back.items() if n}


def propagate(nodes: DataFrame, members: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard) with row counts at most one apart.

    nodes has distinct ``node`` (long); members has (node, grp), groups of linked nodes; repeats count once, groups of one link nothing.
    """
    members = members.distinct()
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    total = nodes.count()
    members = cut(hot_join(members, sizes, "grp", "size", total))
    hot = F.col("size") > hot_limit(total)
    linked = members.groupBy("node").agg(F.min(F.struct("size", "grp")).alias("first"))
    start = ranked(nodes.select("node"), [], [F.xxhash64("node"), "node"], "place")
    start = start.select("node", F.pmod("place", F.lit(shards)).cast("int").alias("shard")).join(linked, "node", "left")
    free = cut(ranked(start.where("first is null").select("node", "shard"), ["shard"], ["node"], "turn"))
    labels = cut(start.where("first is not null").select("node", "shard", "first"))
    have = {r["shard"]: r["n"] for r in free.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = [have.get(s, 0) for s in range(shards)]
    used = [0] * shards
    paid: list[tuple[int, int, int, int]] = []
    swapping, idle, shut = False, 0, set()
    for turn in range(2 * rounds):
        swapping = swapping or turn >= rounds
        by = members.join(labels.select("node", "shard"), "node")
        seen = by.groupBy("grp", "size", "shard").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("shard", "at")
        # the counts of hot groups, a row for each shard, travel to their members
        met = by.where(~hot).join(seen.where(~hot), ["grp", "size"]).unionByName(by.where(hot).join(F.broadcast(seen.where(hot)), ["grp", "size"]))
        votes = met.groupBy("node", "at").agg(F.sum(F.col("c") - (F.col("at") == F.col("shard")).cast("int")).alias("c"))
        targets = [s for s in range(shards) if (s not in shut if swapping else left[s])]
        open_to = F.col("at").isin(targets) if targets else F.lit(False)
        best = votes.join(labels, "node").where(open_to | (F.col("at") == F.col("shard")))
        # one's own copy counts at home, so that all of a group see the same order of shards
        tie = F.xxhash64("first.grp", "at", F.lit(turn)) if swapping else F.lit(0).cast("long")
        rank = F.struct((F.col("c") + (F.col("at") == F.col("shard")).cast("int")).alias("c"), tie.alias("tie"), (-F.col("at")).alias("low"))
        best = best.groupBy("node", "shard", "first").agg(F.max(rank).alias("best"))
        asks = cut(best.select("node", "shard", "first", (-F.col("best.low")).cast("int").alias("to")).where("to <> shard"))
        asked = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}
        go, back = _quotas(asked, left)
        entered = {b for (_, b), n in go.items() if n}
        if swapping:
            shut = {b for _, b in asked} - entered
            idle = 0 if entered else idle + 1
            if idle == PATIENCE or not entered and not shut and len(targets) == shards:
                break
        if not entered:
            swapping = True
            continue
        if any(go[x] < n for x, n in asked.items()):
            quota = F.create_map(*(F.lit(x) for (a, b), n in go.items() for x in (a * shards + b, n)))
            asks = ranked(asks, ["shard", "to"], ["first", "node"], "turn").where(F.col("turn") < quota[F.col("shard") * shards + F.col("to")])
        labels = cut(labels.join(asks.select("node", "to"), "node", "left").select("node", F.coalesce("to", "shard").alias("shard"), "first"))
        for (b, a), n in sorted(back.items()):
            paid.append((b, used[b], used[b] + n, a))
            used[b] += n
            left[b] -= n
    where = F.col("shard")
    for b, low, high, a in paid:
        where = F.when((F.col("shard") == b) & (F.col("turn") >= low) & (F.col("turn") < high), F.lit(a)).otherwise(where)
    return labels.select("node", "shard").union(free.select("node", where.alias("shard")))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null under this law).

    Groups are equal texts; null counts as empty. Repeated rows are rows of their own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("grp"))
    base = cut(own.withColumn("node", F.monotonically_increasing_id()))
    labels = propagate(base.select("node"), base.select("node", "grp"), shards)
    out = ranked(base.join(labels, "node").drop("grp"), ["shard"], ["node"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of equal row counts, copies of a text together."""
    return assign(table(spark, sf_dir, "documents"))
