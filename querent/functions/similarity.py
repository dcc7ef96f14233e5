"""Similarity of token strings, in Arrow batches, and of vectors, as Catalyst expressions."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WHITE = " \t\n\x0b\f\r"


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, Counter[str]] = {}

    def counted(text: str) -> Counter[str]:
        if text not in known:
            known[text] = Counter(text.strip(WHITE).split(" "))
        return known[text]

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = counted(x), counted(y)
        both = (p & q).total()
        return both / (p.total() + q.total() - both)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard_multiset(a: Column, b: Column) -> Column:
    """Multiset Jaccard similarity of two token strings: two empty ones give 1.

    Outer white space is no part; every single space splits. One pass over each text, in Arrow batches: array lambdas
    would compare every token with every other.
    """
    return _jaccard(a, b)


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda n, v: n + v)


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
