"""Command line: python -m querent preprocess | prompts | ask | export."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.answers import answer_sql
from querent.operators import metrics, prompts, relations, selection, voting
from querent.plans import dataset, encoder, hooks, lemmas, llm_client, pipeline, tokens
from querent.sources import files, sinks, sqlite
from querent.sources.stored import stored


def preprocess(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes question and linking files; with a lexicon, questions and names are matched by the lemmas it gives."""
    folder = dataset.Folder(args.data_dir, args.data_type)
    lexicon = spark.read.csv(args.lexicon, sep="\t", schema="form string, lemma string") if args.lexicon else None
    dataset.preprocess(spark, folder, lemmas.fit(lexicon).annotator() if lexicon is not None else hooks.PlainTokens())


def make_prompts(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes <out>/questions.json: the task of a split, with its arguments and estimated costs."""
    folder = dataset.Folder(args.data_dir, args.data_type)
    frames = folder.catalog(spark)
    strategy = selection.STRATEGIES.get(args.selector_type) if args.k_shot else None
    config = pipeline.Config(layout=args.prompt_repr, style=args.example_type or "QA", shots=args.k_shot, max_seq_len=args.max_seq_len, max_ans_len=args.max_ans_len, cross_domain=args.split == "train", scope=args.scope_factor, tokenizer=tokens.TokenFile(args.tokenizer) if args.tokenizer else None)
    # vectors of both sides come from one encoder, fitted on the questions of the pool
    factory = encoder.fit(files.questions(spark, folder.train)) if strategy and args.encoder == "fitted" else hooks.HashedWords()
    targets = dataset.items(spark, folder, args.split, frames, strategy, factory, guesses=args.pre_test_result)
    pool = dataset.items(spark, folder, "train", frames, strategy, factory)
    found = stored(pipeline.build_prompts(targets, pool, frames.per_database(), config, args.selector_type or ""), "prompts")
    costs = {r["model"]: r["cost"] for r in metrics.costs(spark, found, args.max_ans_len).collect()}
    given = {k: str(v) for k, v in vars(args).items() if k != "run"}
    name = sinks.run_name(args.prompt_repr, args.k_shot, args.selector_type or "", args.example_type or "", args.max_seq_len, args.max_ans_len)
    sinks.write_task(found, given, costs, f"{args.out}/{args.data_type.upper()}-{args.split.upper()}_{name}/questions.json")


def _executed(spark: SparkSession, candidates: DataFrame, folder: str) -> DataFrame:
    """Results of all candidates over stored copies of their databases."""
    tables = {db: sqlite.snapshot(spark, path) for db, path in sqlite.databases(folder)}
    return voting.execute(spark, candidates, tables=tables)


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes a line for each question of <question>/questions.json: the answer, or the winner of the vote over n."""
    rows = files.task(spark, f"{args.question}/questions.json").select("idx", "db_id", "prompt")
    name = f"{args.question}/RESULTS_MODEL-{args.model}"
    if args.mini_index_path:
        rows, name = relations.subset(rows, files.positions(spark, args.mini_index_path)), f"{name}_MINI"
    rows = relations.batches(rows, args.batch_size, args.start_index, args.end_index)
    client = llm_client.Replay(default=("count(*) FROM t",)) if args.model == "replay" else llm_client.OpenAICompatible(args.model)
    model = "" if args.model == "replay" else args.model
    answers = stored(llm_client.ask(rows, client, args.n, args.temperature, args.batch_size, model=model, ledger=args.ledger or f"{args.question}/ledger", calls_per_s=args.calls_per_s), "answers")
    candidates = answers.select("idx", "db_id", F.posexplode_outer(F.slice("p_sqls", 1, args.n)).alias("cand_no", "sql"))
    candidates = stored(candidates.withColumns({"cand_no": F.coalesce("cand_no", F.lit(0)), "sql": answer_sql(F.coalesce("sql", F.lit("")))}), "candidates")
    best = candidates.where("cand_no = 0") if args.n == 1 else voting.winners(candidates, _executed(spark, candidates, args.db_dir))
    sinks.write_lines(best.select("idx", "sql").coalesce(1), f"{name}.txt", append=args.start_index > 0)
    print(llm_client.token_totals(answers).first().asDict())


def export(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes the predictions of a text file as the one document that the other benchmark reads."""
    queries = files.lines(spark, args.output, keep_blank=False).select("idx", F.col("value").alias("sql"))
    reference = files.questions(spark, args.bird_dev).select("idx", "question_id", "db_id")
    if not reference.count() or queries.count() != reference.count():
        raise SystemExit("the predictions are not as many as the questions")
    sinks.write_export(queries, reference, args.output.replace(".txt", ".json"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="querent")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        own = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for flag, settings in options:
            own.add_argument(f"--{flag}", **settings)
        own.set_defaults(run=run)

    folder = ("data_dir", {"required": True}), ("data_type", {"choices": ["spider", "realistic", "bird"], "default": "spider"})
    command("preprocess", preprocess, *folder, ("lexicon", {"default": "", "help": "file of forms and lemmas, a tab between them, that a lemmatiser is induced from; plural endings alone without one"}))
    command(
        "prompts",
        make_prompts,
        *folder,
        ("split", {"choices": ["train", "test"], "required": True}),
        ("k_shot", {"type": int, "default": 0}),
        ("prompt_repr", {"choices": sorted(prompts.LAYOUTS), "required": True}),
        ("example_type", {"choices": sorted(prompts.STYLES)}),
        ("selector_type", {"choices": ["RANDOM", *sorted(selection.STRATEGIES)]}),
        ("max_seq_len", {"type": int, "default": 2048}),
        ("max_ans_len", {"type": int, "default": 200}),
        ("scope_factor", {"type": int, "default": 100}),
        ("pre_test_result", {}),
        ("encoder", {"choices": ["fitted", "hashed"], "default": "fitted"}),
        ("tokenizer", {"default": "", "help": "vocabulary file of a tokenizer that budgets and costs are counted with; words and marks without one"}),
        ("out", {"required": True}),
    )
    command(
        "ask",
        ask,
        ("question", {"required": True}),
        ("model", {"default": "gpt-3.5-turbo"}),
        ("start_index", {"type": int, "default": 0}),
        ("end_index", {"type": int, "default": 1_000_000}),
        ("temperature", {"type": float, "default": 0.0}),
        ("mini_index_path", {"default": ""}),
        ("batch_size", {"type": int, "default": 1}),
        ("n", {"type": int, "default": 5}),
        ("ledger", {"default": "", "help": "folder of paid answers; by the question's own unless named"}),
        ("calls_per_s", {"type": float}),
        ("db_dir", {"default": "dataset/spider/database"}),
    )
    command("export", export, ("output", {"required": True}), ("bird_dev", {"required": True}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("querent").getOrCreate(), args)


if __name__ == "__main__":
    main()
