"""Pairs of token strings whose multiset Jaccard similarity reaches a threshold, by prefixes.

A multiset is made a set: the i-th occurrence of a token is an element of its own, and the
similarity of the multisets is that of these sets. Elements get one order, the rare ones
first; two texts at the threshold share an element among the first few of both (the prefix),
so only texts that meet in the index of prefixes, and whose sizes allow it, are compared.

Equal texts are one: the join is over distinct texts, and a text in a third of all rows is
joined once. Elements that are in very many prefixes are dealt over tasks by the other
side's texts. An element is a number of its own (checked: no two share one), and a prefix
travels with all elements of its text in order. So a pair that meets several times counts
only at the first element that both have, where its similarity is known, too: no pair is
shuffled, and what is compared is compared once, exactly.

A null text pairs with nothing; outer white space is no part, and an empty text is the one
empty token, as in the similarity itself.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.similarity import WHITE
from querent.operators import skew
from querent.sources.stored import stored

#: Prefixes with an element from which it is dealt over tasks, and texts in a part of it.
HOT = 20_000
_EPSILON = 1e-9


def elements(text: Column) -> Column:
    """A text's elements: its tokens, each with the number of equal ones before it."""
    tokens = F.split(F.trim(text, F.lit(WHITE)), " ", -1)
    by = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    # in sorted order, the first place of a token is how many it is away from its number
    return F.transform(by, lambda x, i: F.concat_ws(" ", x["t"], (i - F.array_position(F.transform(by, lambda y: y["t"]), x["t"]) + 1).cast("string")))


def _code(element: Column, seed: int) -> Column:
    return F.xxhash64(element, F.lit(seed))


def _coded(frequency: DataFrame) -> DataFrame:
    """frequency (element, df) with code, a number for each element that no other has."""
    for seed in count():
        out = stored(frequency.withColumn("code", _code(F.col("element"), seed)), "elements")
        if out.count() == out.select("code").distinct().count():
            return out


def _ordered(texts: DataFrame, frequency: DataFrame, total: int, most: int) -> DataFrame:
    """text, n, own: the codes of a text's elements, rare ones first. Elements of very many texts, a bounded number, stay in their tasks."""
    rows, limit = texts.select("text", "n", F.explode("elements").alias("element")), max(skew.LEAST, total // skew.HOT)
    if most <= limit:
        found = rows.join(frequency, "element")
    else:
        few = F.broadcast(frequency.where(F.col("df") > limit))
        found = rows.join(few, "element").union(rows.join(few, "element", "left_anti").join(frequency.where(F.col("df") <= limit), "element"))
    own = found.groupBy("text", "n").agg(F.array_sort(F.collect_list(F.struct("df", "code"))).alias("own"))  # a text's own elements
    return own.select("text", "n", F.transform("own", lambda x: x["code"]).alias("own"))


def _prefixes(ordered: DataFrame, threshold: float) -> DataFrame:
    """id, n, own, place, element: the elements of each text that one of a similar text is among."""
    most = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - _EPSILON).cast("int") + 1
    return ordered.select(F.col("text").alias("id"), "n", "own", F.posexplode(F.slice("own", 1, F.greatest(most, F.lit(1)))).alias("place", "element"))


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the distinct texts a of left and b of right (a column text each) with a similarity of at least threshold, which is above 0."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    sides = [stored(df.select(F.col("text").cast("string").alias("text")).where("text is not null").distinct().select("text", elements(F.col("text")).alias("elements")).withColumn("n", F.size("elements")), "texts") for df in (left, right)]
    both = sides[0].select(F.explode("elements").alias("element")).union(sides[1].select(F.explode("elements").alias("element")))
    frequency = _coded(both.groupBy("element").agg(F.count(F.lit(1)).alias("df")))
    total, most = frequency.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.max("df"), F.lit(0))).first()
    own, other = (stored(_prefixes(_ordered(x, frequency, total, most), threshold), "prefixes") for x in sides)
    # an element of very many prefixes of the one side goes to several tasks, with the other side's texts copied to each
    parts = own.groupBy("element").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("g")).where("g > 1")
    salted = own.join(parts, "element", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("g")).cast("int"), F.lit(0))).drop("g")
    copied = other.join(parts, "element", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))).drop("g")
    a, b = salted.withColumnsRenamed({"id": "a", "n": "na", "own": "oa", "place": "pa"}), copied.withColumnsRenamed({"id": "b", "n": "nb", "own": "ob", "place": "pb"})
    least = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - _EPSILON
    # after this element at most so many more can be shared
    room = F.lit(1) + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 + F.least("pa", "pb")
    enough = room * (1 + threshold) >= F.lit(threshold) * (F.col("na") + F.col("nb")) - _EPSILON
    first = ~F.arrays_overlap(F.slice("oa", 1, F.col("pa")), F.slice("ob", 1, F.col("pb")))
    shared = F.size(F.array_intersect("oa", "ob"))
    met = a.join(b, ["element", "part"]).where(least & enough).where(first).select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("sim"))
    return met.where(F.col("sim") >= threshold)
