"""Questions to SQL: prompts by one selector, answers, then prompts by skeletons of these answers, and final answers.

Every stage is a function of DataFrames; the catalog and links are computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.functions.answers import answer_sql
from querent.functions.sql_text import skeleton
from querent.operators import prompts as P
from querent.operators import selection, voting
from querent.plans.llm_client import Client, ask
from querent.sources.catalog import Catalog
from querent.sources.stored import stored

#: Examples offered for each shot; the budget may pass over many.
SCOPE = 100


@dataclass(frozen=True)
class Config:
    layout: str = "SQL"
    style: str = "QA"
    shots: int = 9
    max_seq_len: int = 4096
    max_ans_len: int = 200
    first_selector: str = "EUCDISQUESTIONMASK"
    selector: str = "EUCDISMASKPRESKLSIMTHR"
    n: int = 1
    temperature: float = 0.0
    cross_domain: bool = False
    scope: int = SCOPE
    tokenizer: Callable[[], Callable[[str], int]] | None = None
    ledger: str = ""
    calls_per_s: float | None = None


def with_skeletons(items: DataFrame, databases: DataFrame, query: str = "query", to: str = "skeleton") -> DataFrame:
    """items (db_id, query) with the skeleton; a query that does not start with exactly SELECT stands for itself, an empty one has none."""
    names = databases.select("db_id", "table_names", "column_names")
    q = F.col(query)
    skel = F.when(F.length(F.coalesce(q, F.lit(""))) == 0, F.lit(None)).when(F.trim(q).startswith("SELECT"), skeleton(q, F.col("table_names"), F.col("column_names"))).otherwise(q)
    return items.join(names, "db_id").withColumn(to, skel).drop("table_names", "column_names")


def build_prompts(targets: DataFrame, pool: DataFrame, databases: DataFrame, config: Config, selector: str) -> DataFrame:
    """idx, db_id, prompt, prompt_tokens, n_examples, response, chosen."""
    asked = P.rendered(targets, databases, config.layout)
    if not config.shots:
        nothing = targets.sparkSession.createDataFrame([], "t_idx long, rank int, c_idx long, example string")
        return P.few_shot(asked, nothing, config.style, 0, config.max_seq_len, config.max_ans_len, tokenizer=config.tokenizer)
    if selector == "RANDOM":
        ranked = selection.select_random(pool, targets, config.shots * config.scope, cross_domain=config.cross_domain)
    else:
        ranked = selection.select(pool, targets, selection.STRATEGIES[selector], config.shots * config.scope, config.cross_domain)
    solved = P.rendered(pool, databases, config.layout)
    texts = solved.select(F.col("idx").alias("c_idx"), P.example(config.style, F.col("question"), F.col("query"), F.col("block")).alias("example"))
    offers = ranked.join(texts, "c_idx").select("t_idx", "rank", "c_idx", "example")
    return P.few_shot(asked, offers, config.style, config.shots, config.max_seq_len, config.max_ans_len, tokenizer=config.tokenizer)


def answered(prompts: DataFrame, client: Callable[[], Client], config: Config, results: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """idx, db_id, sql: the clean answer, or with several answers the winner of the vote over their results."""
    # calls are paid: what comes back is written once, and all that follows reads the table
    raw = stored(ask(stored(prompts.select("idx", "db_id", "prompt"), "prompts"), client, config.n, config.temperature, ledger=config.ledger, calls_per_s=config.calls_per_s), "answers")
    candidates = raw.select("idx", "db_id", F.posexplode_outer("p_sqls").alias("cand_no", "sql")).withColumn("sql", answer_sql(F.coalesce("sql", F.lit(""))))
    candidates = candidates.withColumn("cand_no", F.coalesce("cand_no", F.lit(0)))
    if config.n == 1 or results is None:
        return candidates.where("cand_no = 0").select("idx", "db_id", "sql")
    return voting.winners(candidates, results(candidates)).select("idx", "db_id", "sql")


def run(targets: DataFrame, pool: DataFrame, catalog: Catalog, client: Callable[[], Client], config: Config, results: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """idx, db_id, sql after two passes. targets and pool: idx, db_id, question, vector, query."""
    databases = catalog.per_database()
    pool = with_skeletons(pool, databases).withColumn("pre_skeleton", F.col("skeleton"))
    first = answered(build_prompts(with_skeletons(targets, databases), pool, databases, config, config.first_selector), client, config, results)
    guessed = with_skeletons(first, databases, "sql", "pre_skeleton").select("idx", F.coalesce("pre_skeleton", F.lit("")).alias("pre_skeleton"))
    return answered(build_prompts(with_skeletons(targets, databases).join(guessed, "idx"), pool, databases, config, config.selector), client, config, results)
