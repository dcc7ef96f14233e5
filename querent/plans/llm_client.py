"""Calls to a language model, in batches on the executors, with a pluggable client.

A client is a picklable factory; each task makes one client and calls it for every batch.
A failed call is retried a bounded number of times and then becomes a status row, so one
bad prompt never stops a run. Credentials come from the environment of the executors.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.plans.ledger import Ledger

MAX_TOKENS = 200
STOP = ";"
#: Models that complete a batch of prompts at once, one answer each; the others chat, one prompt at a time, with any number of answers.
COMPLETION_MODELS = ("text-davinci-003", "code-davinci-002")
ASKED = "idx long, db_id string, p_sqls array<string>, total_tokens long, status string"


@dataclass
class Answers:
    """texts[i]: the answers to prompt i."""

    texts: list[list[str]]
    total_tokens: int = 0


class Client(Protocol):
    def __call__(self, prompts: list[str], n: int, temperature: float) -> Answers: ...


@dataclass(frozen=True)
class Replay:
    """Offline client: known answers by prompt, else a fixed query chosen by the prompt's digest."""

    known: tuple[tuple[str, tuple[str, ...]], ...] = ()
    default: tuple[str, ...] = ("1",)

    def __call__(self) -> Client:
        table = dict(self.known)

        def answer(prompts: list[str], n: int, temperature: float) -> Answers:
            texts = []
            for p in prompts:
                own = table.get(p)
                if own is None:
                    at = int.from_bytes(hashlib.sha256(p.encode()).digest()[:4])
                    own = tuple(self.default[(at + i) % len(self.default)] for i in range(n))
                texts.append(list(own[:n]))
            return Answers(texts, sum(len(p.split()) for p in prompts))

        return answer


@dataclass(frozen=True)
class OpenAICompatible:
    """Client for any endpoint of the public chat-completions form. URL and key are read from the environment of the task."""

    model: str
    url_variable: str = "LLM_BASE_URL"
    key_variable: str = "LLM_API_KEY"
    timeout_s: int = 60

    def __call__(self) -> Client:
        import json
        import urllib.request

        url, key = os.environ[self.url_variable], os.environ.get(self.key_variable, "")

        def post(path: str, body: dict) -> dict:
            request = urllib.request.Request(f"{url}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
                return json.load(reply)

        def answer(prompts: list[str], n: int, temperature: float) -> Answers:
            common = {"model": self.model, "temperature": temperature, "max_tokens": MAX_TOKENS, "stop": [STOP]}
            if self.model in COMPLETION_MODELS:
                reply = post("completions", common | {"prompt": prompts})
                return Answers([[c["text"]] for c in sorted(reply["choices"], key=lambda c: c["index"])], reply["usage"]["total_tokens"])
            texts, total = [], 0
            for p in prompts:
                reply = post("chat/completions", common | {"n": n, "messages": [{"role": "user", "content": p}]})
                texts.append([c["message"]["content"] for c in reply["choices"]])
                total += reply["usage"]["total_tokens"]
            return Answers(texts, total)

        return answer


def ask(
    prompts: DataFrame,
    factory: Callable[[], Client],
    n: int = 1,
    temperature: float = 0.0,
    batch_size: int = 1,
    retries: int = 3,
    pause_s: float = 1.0,
    model: str = "",
    ledger: str = "",
    calls_per_s: float | None = None,
) -> DataFrame:
    """(idx, db_id, p_sqls, total_tokens, status) of prompts (idx, db_id, prompt). total_tokens is on the first row of a batch.

    ledger: a folder that all executors reach; what was answered there before is not asked again, and its tokens are those
    that were paid then. calls_per_s: a bound on the calls of all executors together, which share it evenly.
    """
    if model in COMPLETION_MODELS and n != 1:
        raise ValueError("completion models give one answer")
    if model and model not in COMPLETION_MODELS and batch_size != 1:
        raise ValueError("chat models take one prompt at a time")
    tasks = prompts.sparkSession.sparkContext.defaultParallelism
    every_s = tasks / calls_per_s if calls_per_s else 0.0  # of one task, as no more of them run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, last = factory(), 0.0
        book = Ledger(ledger) if ledger else None

        def called(part: list[str]) -> tuple[str, list[list[str]], int]:
            nonlocal last
            status = ""
            for attempt in range(retries + 1):
                if (wait := last + every_s - time.monotonic()) > 0:
                    time.sleep(wait)
                last = time.monotonic()
                try:
                    got = client(part, n, temperature)
                    return "ok", got.texts, got.total_tokens
                except Exception as e:  # whatever the service raises
                    status = f"error: {type(e).__name__}: {e}"[:300]
                    if attempt < retries:
                        time.sleep(pause_s)
            return status, [[] for _ in part], 0

        for whole in batches:
            for at in range(0, len(whole), batch_size):
                part = whole.iloc[at : at + batch_size]
                asked = part["prompt"].tolist()
                keys = [Ledger.key(p, model, n, temperature, max_tokens=MAX_TOKENS) for p in asked] if book else []
                held = [book.get(k) for k in keys] if book else [None] * len(asked)
                missing = [i for i, x in enumerate(held) if x is None]
                status, tokens = "ok", sum(x[1] for x in held if x)
                texts = [x[0] if x else [] for x in held]
                if missing:
                    status, new, paid = called([asked[i] for i in missing])
                    tokens += paid
                    for place, (i, own) in enumerate(zip(missing, new, strict=True)):
                        texts[i] = own
                        if book and status == "ok":
                            book.put(keys[i], own, paid if place == 0 else 0)
                statuses = [status if i in missing else "ok" for i in range(len(asked))]
                yield pd.DataFrame({"idx": part["idx"].to_numpy(), "db_id": part["db_id"].to_numpy(), "p_sqls": texts, "total_tokens": [tokens, *[0] * (len(part) - 1)], "status": statuses})

    rows = prompts.select("idx", "db_id", "prompt")
    return (rows.coalesce(tasks) if calls_per_s else rows).mapInPandas(run, ASKED)


def token_totals(answers: DataFrame) -> DataFrame:
    """One row: calls' rows, failed ones, and the sum of total_tokens over all."""
    return answers.agg(F.count(F.lit(1)).alias("answers"), F.coalesce(F.sum((F.col("status") != "ok").cast("long")), F.lit(0)).alias("failed"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
