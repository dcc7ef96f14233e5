"""Prompt layouts, example styles and budgeted few-shot prompts.

A layout is a family (how a schema is written) with wording. The schema text depends on the
database alone, so it is rendered once a database and joined to its questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.answers import gold_answer, token_count

# Fixed texts: prompts must equal those that models were measured with.
_SQL = "/* Given the following database schema: */\n{schema}"
_TEXT = "Given the following database schema:\n{schema}"
_TEXT_FK = "Given the following database schema:\n{schema} \nAnd their foreign keys:\n{fks}"
_SIGN = "### Complete sqlite SQL query only and with no explanation\n### SQLite SQL tables, with their properties:\n#\n{schema}\n#"
_SIGN_FK = _SIGN + "\n### Their foreign keys:\n#\n# Foreign_keys=({fks})\n#"
_SIGN_PLAIN = "### Complete sqlite SQL query\n### SQLite SQL tables, with their properties:\n#\n{schema}\n#"
_SIGN_COT = "### Let's think step by step. Complete sqlite SQL query only and with no explanation\n### SQLite SQL tables, with their properties:\n#\n{schema}\n#"
_BASE = "{schema}\n"
_BASE_FK = "{schema}\nForeign_keys=[{fks}]\n"
_TASK = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n"
_ASK = 'Write a sql to answer the question "{question}"\n\n### Input:\n{schema}\n'
_ASK_RULE = 'Write a sql only and with no explanation to answer the question "{question}"\n\n### Input:\n{schema}\n'
_CBR = "# The following are the table names and column names needed to generate SQL:\nTables: {tables}\nColumns: *, {columns}\nForeign keys: {fks}"
_SELECT, _A_SELECT = "\nSELECT ", "\nA: SELECT "


@dataclass(frozen=True)
class Layout:
    """info and question are templates; schema names the way tables are written."""

    schema: str
    info: str
    question: str
    gap: str = "\n"
    suffix: str = _SELECT


LAYOUTS = {
    "SQL": Layout("ddl", _SQL, "/* Answer the following: {question} */", "\n\n"),
    "SQLWRULE": Layout("ddl", _SQL, "/* Answer the following with no explanation: {question} */", "\n\n"),
    "SQLCOT": Layout("ddl", _SQL, "/* Let's think step by step. Answer the following: {question} */", "\n\n", ""),
    "TEXT": Layout("colon", _TEXT, "Answer the following: {question}"),
    "TEXTWFK": Layout("colon", _TEXT_FK, "Answer the following: {question}"),
    "TEXTWRULE": Layout("colon", _TEXT, "Answer the following with no explanation: {question}"),
    "TEXTCOT": Layout("colon", _TEXT, "Let's think step by step. Answer the following: {question}", suffix=""),
    "NUMBERSIGN": Layout("sign", _SIGN, "### {question}"),
    "NUMBERSIGNWFK": Layout("sign", _SIGN_FK, "### {question}"),
    "NUMBERSIGNWORULE": Layout("sign", _SIGN_PLAIN, "### {question}"),
    "NUMBERSIGNCOT": Layout("sign", _SIGN_COT, "### {question}", suffix=""),
    "BASELINE": Layout("list", _BASE_FK, 'Q: "{question}"', "", _A_SELECT),
    "BASELINEWOFK": Layout("list", _BASE, 'Q: "{question}"', "", _A_SELECT),
    "INSTRUCTION": Layout("call", _TASK + _ASK, "### Response:"),
    "INSTRUCTIONWFK": Layout("call", _TASK + _ASK[:-1] + "\nForeign Keys:{fks}\n", "### Response:"),
    "INSTRUCTIONWRULE": Layout("call", _TASK + _ASK_RULE, "### Response:"),
    "INSTRUCTIONCOT": Layout("call", _TASK + "Let's think step by step. " + _ASK, "### Response:", suffix=""),
    "CBR": Layout("none", _CBR, '# translate "{question}" into SQL query only and with no explanation:'),
}

_PREFIX = "/* Some SQL examples are provided based on similar problems: */\n"
#: (prefix, template) of the example styles; {full} is the layout's whole question block.
STYLES = {
    "ONLYSQL": (_PREFIX, "{query}"),
    "QA": (_PREFIX, "/* Answer the following: {question} */\n{query}"),
    "QAWRULE": (_PREFIX, "/* Answer the following with no explanation: {question} */\n{query}"),
    "COMPLETE": ("", "{full}\n{query}"),
    "NUMBERSIGNQA": ("### Some example pairs of question and corresponding SQL query are provided based on similar problems:\n\n", "### {question}\n{query}"),
    "BASELINEQA": ("", "Example Q: {question}\nExample A: {query}"),
}
GAP = "\n\n"


def filled(template: str, **parts: Column) -> Column:
    """A template with columns in the places of their names."""
    out: list[Column] = []
    rest = template
    while rest:
        found = [(rest.index(f"{{{x}}}"), x) for x in parts if f"{{{x}}}" in rest]
        if not found:
            out.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            out.append(F.lit(rest[:at]))
        out.append(parts[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out) if out else F.lit("")


def _schema(kind: str) -> Column:
    """Text of a database's tables, from Catalog.per_database()."""
    cols = lambda t: F.array_join(t["columns"], ", ")
    line = {
        "ddl": lambda t: t["ddl"],
        "colon": lambda t: F.concat(t["table_name"], F.lit(": "), cols(t)),
        "sign": lambda t: F.concat(F.lit("# "), t["table_name"], F.lit("("), cols(t), F.lit(")")),
        "list": lambda t: F.replace(F.concat(F.lit("Table "), t["table_name"], F.lit(", columns = ["), cols(t), F.lit("]")), F.lit("'"), F.lit("")),
        "call": lambda t: F.concat(t["table_name"], F.lit("("), cols(t), F.lit(")")),
        "none": lambda t: t["table_name"],
    }[kind]
    return F.array_join(F.transform("tables", line), "\n\n" if kind == "ddl" else "\n")


def rendered(questions: DataFrame, databases: DataFrame, name: str) -> DataFrame:
    """questions (with db_id, question) and block, the layout's question block, and prompt, the target with its suffix."""
    layout = LAYOUTS[name]
    own = databases.select(
        "db_id",
        _schema(layout.schema).alias("_schema"),
        F.array_join("fks", ", ").alias("_fks"),
        F.array_join(F.transform("tables", lambda t: t["table_name"]), ", ").alias("_tables"),
        F.array_join(F.flatten(F.transform("tables", lambda t: F.transform(t["columns"], lambda c: F.concat_ws(".", t["table_name"], c)))), ", ").alias("_columns"),
    )
    parts = {"question": F.col("question"), "schema": F.col("_schema"), "fks": F.col("_fks"), "tables": F.col("_tables"), "columns": F.col("_columns")}
    block = filled(layout.info + layout.gap + layout.question, **parts)
    out = questions.join(own, "db_id").withColumn("block", block)
    return out.withColumn("prompt", F.concat("block", F.lit(layout.suffix))).drop("_schema", "_fks", "_tables", "_columns")


def example(style: str, question: Column, query: Column, block: Column) -> Column:
    return filled(STYLES[style][1], question=question, query=query, full=block)


def few_shot(targets: DataFrame, examples: DataFrame, style: str, shots: int, max_seq_len: int, max_ans_len: int = 200, count: Callable[[Column], Column] = token_count, tokenizer: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """idx, db_id, prompt, prompt_tokens, n_examples, response, chosen (ids of the examples).

    targets: idx, db_id, prompt, query. examples: t_idx, rank, c_idx, example (its text); of each target at most a bounded
    scope. In order of rank an example is taken if the whole prompt with it and the answer fit; one that does not fit is
    passed over, and later ones may still fit. The counter sees the whole prompt each time, so it need not be additive.
    count is a Catalyst expression; a tokenizer (a factory of functions) counts in Arrow batches instead.
    """
    prefix = STYLES[style][0]
    listed = examples.groupBy("t_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "c_idx", "example"))).alias("offers"))
    joined = targets.join(listed, targets["idx"] == listed["t_idx"], "left")
    with_all = lambda done, text: F.concat(F.lit(prefix), done, text, F.lit(GAP), F.col("prompt"))
    none = F.array().cast("array<long>")
    start = F.struct(F.lit("").alias("done"), none.alias("chosen"), count(F.col("prompt")).cast("long").alias("tokens"))

    def step(state: Column, offer: Column) -> Column:
        tokens = count(with_all(state["done"], offer["example"])).cast("long")
        take = (F.size(state["chosen"]) < shots) & (tokens + max_ans_len <= max_seq_len)
        return F.struct(
            F.when(take, F.concat(state["done"], offer["example"], F.lit(GAP))).otherwise(state["done"]).alias("done"),
            F.when(take, F.concat(state["chosen"], F.array(offer["c_idx"]))).otherwise(state["chosen"]).alias("chosen"),
            F.when(take, tokens).otherwise(state["tokens"]).alias("tokens"),
        )

    offers = F.coalesce("offers", F.array().cast("array<struct<rank:int,c_idx:bigint,example:string>>"))
    if tokenizer is not None:
        out = _counted(joined.select("idx", "db_id", "prompt", "query", offers.alias("offers")), prefix, shots, max_seq_len - max_ans_len, tokenizer)
    else:
        out = joined.withColumn("s", F.aggregate(offers, start, step))
    prompt = F.when(F.size("s.chosen") > 0, F.concat(F.lit(prefix), F.col("s.done"), F.col("prompt"))).otherwise(F.col("prompt"))
    return out.select("idx", "db_id", prompt.alias("prompt"), F.col("s.tokens").alias("prompt_tokens"), F.size("s.chosen").alias("n_examples"), gold_answer(F.col("query")).alias("response"), F.col("s.chosen").alias("chosen"))


def _counted(rows: DataFrame, prefix: str, shots: int, most: int, tokenizer: Callable[[], Callable[[str], int]]) -> DataFrame:
    """rows (idx, db_id, prompt, query, offers) with s (done, chosen, tokens): the fold over offers by a counter in Python."""
    kind = "idx long, db_id string, prompt string, query string, s struct<done:string,chosen:array<long>,tokens:long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = tokenizer()
        for batch in batches:
            folded = []
            for prompt, offers in zip(batch["prompt"], batch["offers"], strict=True):
                done, chosen, tokens = "", [], count(prompt)
                for offer in offers:
                    if len(chosen) == shots:
                        break
                    now = count(prefix + done + offer["example"] + GAP + prompt)
                    if now <= most:
                        done, tokens = done + offer["example"] + GAP, now
                        chosen.append(offer["c_idx"])
                folded.append({"done": done, "chosen": chosen, "tokens": tokens})
            yield batch[["idx", "db_id", "prompt", "query"]].assign(s=folded)

    return rows.mapInPandas(run, kind)
