"""Paid answers are asked for once, whatever fails between."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

import pytest

from querent.plans.ledger import Ledger
from querent.plans.llm_client import Answers, Replay, ask


@dataclass(frozen=True)
class Paid:
    """Leaves a file for each prompt it answers; dies without an error that is caught after so many in a task."""

    folder: str
    dies_after: int = 10**9

    def __call__(self):
        done = [0]

        def answer(prompts, n, temperature):
            if done[0] >= self.dies_after:
                os._exit(1)
            for p in prompts:
                with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                    f.write(p)
            done[0] += len(prompts)
            return Answers([[f"{p}-{i}" for i in range(n)] for p in prompts], 5 * len(prompts))

        return answer


def paid(folder):
    return sorted(open(os.path.join(folder, x)).read() for x in os.listdir(folder))


@pytest.mark.parametrize("batch_size", [1, 3])
def test_a_killed_task_repeats_no_call(spark, tmp_path, batch_size):
    calls, ledger = tmp_path / "calls", f"file://{tmp_path}/ledger"
    calls.mkdir()
    prompts = spark.createDataFrame([(i, "d", f"p{i}") for i in range(20)], "idx long, db_id string, prompt string").repartition(2)
    with pytest.raises(Exception):  # noqa: B017  Spark's own, when the task's process is gone
        ask(prompts, Paid(str(calls), 4), 2, batch_size=batch_size, ledger=ledger).collect()
    before = len(paid(calls))
    assert 0 < before < 20
    got = ask(prompts, Paid(str(calls)), 2, batch_size=batch_size, ledger=ledger).collect()
    assert paid(calls) == sorted(f"p{i}" for i in range(20))
    assert {r["idx"]: list(r["p_sqls"]) for r in got} == {i: [f"p{i}-0", f"p{i}-1"] for i in range(20)}
    assert sum(r["total_tokens"] for r in got) == 100 and {r["status"] for r in got} == {"ok"}
    again = ask(prompts, Paid(str(calls)), 2, batch_size=batch_size, ledger=ledger)
    assert sum(r["total_tokens"] for r in again.collect()) == 100 and len(paid(calls)) == 20
    ask(prompts.limit(1), Paid(str(calls)), 2, temperature=0.5, ledger=ledger).collect()
    assert len(paid(calls)) == 21  # other parameters are another question


def test_entries(tmp_path):
    book = Ledger(str(tmp_path))
    key = Ledger.key("p", "m", 1, 0.0)
    assert key != Ledger.key("p", "m", 2, 0.0) != Ledger.key("p", "m", 1, 0.0, stop=";") and book.get(key) is None
    book.put(key, ["a", 'b"'], 7)
    book.put(key, ["a", 'b"'], 7)
    assert book.get(key) == (["a", 'b"'], 7) == Ledger(f"file://{tmp_path}").get(key)


def test_failures_are_not_kept(spark, tmp_path):
    class Failing:
        def __call__(self):
            def answer(prompts, n, temperature):
                raise ValueError("no")

            return answer

    prompts = spark.createDataFrame([(0, "d", "p")], "idx long, db_id string, prompt string")
    assert ask(prompts, Failing(), retries=1, pause_s=0, ledger=str(tmp_path)).first()["status"].startswith("error: ValueError")
    assert ask(prompts, Replay(), ledger=str(tmp_path)).first()["status"] == "ok"


def test_calls_are_paced(spark):
    prompts = spark.createDataFrame([(i, "d", f"p{i}") for i in range(12)], "idx long, db_id string, prompt string").repartition(12)
    began = time.time()
    assert ask(prompts, Replay(), calls_per_s=4).count() == 12
    assert time.time() - began >= 12 / 4 - 1.5
