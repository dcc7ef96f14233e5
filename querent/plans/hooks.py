"""Encoders of texts and annotators of questions, as pluggable factories that run on the executors.

An encoder gives a vector for each text, an annotator the tokens of each text. A factory is
picklable; each task makes one of its own and hands it Arrow batches. The defaults work offline
and need nothing: ``encoder`` fits a better one on the corpus, ``lemmas`` induces one from a
lexicon; results depend on what is plugged in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Annotator(Protocol):
    def __call__(self, texts: list[str]) -> list[list[str]]: ...


@dataclass(frozen=True)
class HashedWords:
    """Default encoder: counts of words and of pairs of neighbours, hashed to signed places, of length one."""

    size: int = 256

    def __call__(self) -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.size), dtype=np.float32)
            for i, text in enumerate(texts):
                words = re.findall(r"\w+|[^\w\s]", text.lower())
                for part in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                    h = zlib.crc32(part.encode())
                    out[i, h % self.size] += 1 if h & 1 << 31 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        return encode


#: Endings that the default annotator takes off, with what takes their place; the first that fits a long enough word.
_ENDINGS = (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ss", "ss"), ("us", "us"), ("is", "is"), ("s", ""))


@dataclass(frozen=True)
class PlainTokens:
    """Default annotator: words and marks in lower case, plural endings off if wanted."""

    singular: bool = True

    def __call__(self) -> Annotator:
        def lemma(word: str) -> str:
            for end, put in _ENDINGS:
                if word.endswith(end) and len(word) > len(end) + 2:
                    return word[: -len(end)] + put
            return word

        def annotate(texts: list[str]) -> list[list[str]]:
            found = [re.findall(r"\d+(?:\.\d+)?|\w+|[^\w\s]", t.lower()) for t in texts]
            return [[lemma(x) for x in own] for own in found] if self.singular else found

        return annotate


def _added(df: DataFrame, column: str, to: str, kind: ArrayType, work: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    schema = StructType([*(f for f in df.schema.fields if f.name != to), StructField(to, kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = work()
        for batch in batches:
            texts = ["" if x is None or x is pd.NA else x for x in batch[column].tolist()]
            yield batch.assign(**{to: list(make(texts)) if texts else []})[schema.names]

    return df.mapInPandas(run, schema)


def with_vectors(df: DataFrame, encoder: Callable[[], Encoder], column: str = "question", to: str = "vector") -> DataFrame:
    """df with the vector of a text column; a null text is an empty one."""
    return _added(df, column, to, ArrayType(FloatType()), encoder)


def with_tokens(df: DataFrame, annotator: Callable[[], Annotator], column: str = "question", to: str = "toks") -> DataFrame:
    """df with the tokens of a text column; a null text is an empty one."""
    return _added(df, column, to, ArrayType(StringType()), annotator)
