"""Small corpora with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, bucket int, score double, places string, _h string"


def words(text: str | None) -> list[bytes]:
    return SPACE.findall((text or "").encode())


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    sentence = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, line = sentence(70), sentence(45)
    out: list[str | None] = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            out.append(sentence(rng.randint(40, 200)))
        elif kind == 1:
            out.append(f"{sentence(30)}\n{passage}\n{sentence(20)}")
        elif kind == 2:
            out.append(f"{line}\t{sentence(rng.randint(1, 60))}")
        elif kind == 3:
            own = (out[0] or "").split(" ")
            own[rng.randrange(len(own))] = "changed"
            out.append(" ".join(own))
        elif kind == 4:
            out.append(sentence(rng.randint(0, 6)))
        else:
            out.append(f"{line} {line} {sentence(5)} {passage}"[: rng.randint(100, 900)])
    long = sentence(20_000)
    return [*out, None, "", " \t\n", "a", "a b c d", "A b C d", out[0], out[0], (out[1] or "").upper(), "x" * 5000, "ab" * 3000, long, long[:60_000], passage, None]


def frame(spark, rows=None):
    """Documents with doc_ids out of order, one repeated row, and extra columns of clashing names."""
    rows = texts() if rows is None else rows
    full = [((7 * i) % 1009 if i != 3 else None, t, "en", "s", len(t or ""), 1, 2, 0.5, "x", "y") for i, t in enumerate(rows)]
    return spark.createDataFrame([*full, *full[5:6]], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
