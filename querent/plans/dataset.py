"""Dataset folders: merged splits, converted questions, linking files, and what prompts need of them.

A folder has tables.json, question files, and database/<db_id>/<db_id>.sqlite; linking files are
written to enc/. One-file outputs are Spark folders with one part, which the readers take by path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.answers import question_tokens, with_evidence
from querent.operators import linking, relations
from querent.operators.selection import Strategy
from querent.plans.hooks import Annotator, Encoder, HashedWords, PlainTokens, with_tokens, with_vectors
from querent.plans.pipeline import with_skeletons
from querent.sources import catalog as C
from querent.sources import documents, files, sinks, sqlite
from querent.sources.stored import stored


@dataclass(frozen=True)
class Folder:
    """Files of a dataset by kind."""

    path: str
    kind: str = "spider"

    @property
    def train(self) -> str:
        return f"{self.path}/" + ("train.json" if self.kind == "bird" else "train_spider_and_others.json")

    @property
    def test(self) -> str:
        return f"{self.path}/" + ("spider-realistic.json" if self.kind == "realistic" else "dev.json")

    @property
    def tables(self) -> str:
        return f"{self.path}/tables.json"

    @property
    def databases(self) -> str:
        return f"{self.path}/database"

    def links(self, section: str) -> str:
        return f"{self.path}/enc/{section}_schema-linking.jsonl"

    def catalog(self, spark: SparkSession) -> C.Catalog:
        """From the database files where there are any, else from tables.json; stored once in enc/ for the contents of these."""
        if not files.exists(spark, self.databases):
            return C.snapshot(spark, files.digest(spark, self.tables), f"{self.path}/enc", lambda: C.read_tables_json(spark, self.tables))
        found = sqlite.databases(self.databases)
        return C.snapshot(spark, sqlite.stamp(found), f"{self.path}/enc", lambda: sqlite.catalog(spark, found))


def converted(questions: DataFrame, evidence: bool = True) -> DataFrame:
    """Questions of the other dataset in the common form: evidence behind the question if wanted, question_toks, and query for SQL."""
    text = with_evidence(F.col("question"), F.col("evidence")) if evidence else F.col("question")
    out = questions.withColumn("question", text)
    return out.withColumns({"question_toks": question_tokens(F.col("question")), "query": F.col("SQL")})


def records(questions: DataFrame, catalog: C.Catalog, cells: DataFrame | None, annotator: Callable[[], Annotator] = PlainTokens()) -> DataFrame:
    """idx and all fields of a linking record for questions (idx, db_id, question, question_toks).

    Names are matched with annotated tokens on both sides. Without cells there are no value links.
    """
    own = with_tokens(questions.select("idx", "db_id", "question", "question_toks"), annotator)
    own = stored(own.withColumn("toks", F.coalesce("toks", F.array().cast("array<string>"))), "questions")

    def displayed(df: DataFrame) -> DataFrame:
        return stored(with_tokens(df, annotator, "display", "_toks").withColumn("display", F.array_join("_toks", " ")), "names")

    columns, tables = displayed(catalog.columns), displayed(catalog.tables)
    links = linking.name_links(own, columns.drop("_toks"), tables.drop("_toks"))
    if cells is not None:
        links = links.unionByName(linking.number_links(own, columns)).unionByName(linking.value_links(own, cells))
    found = sinks.linking_records(own, stored(links, "links"))
    star = F.array(F.array(F.lit("<type: text>"), F.lit("*")))
    typed = columns.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("col_id", F.concat(F.array(F.concat(F.lit("<type: "), F.col("type"), F.lit(">"))), F.col("_toks")).alias("t")))).alias("c"))
    typed = typed.select("db_id", F.concat(star, F.transform("c", lambda x: x["t"])).alias("columns"))
    named = tables.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_id", F.col("_toks").alias("t")))), lambda x: x["t"]).alias("tables"))
    text_keys = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<int,int>")), lambda k, _: k.cast("string"))
    lists = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<int,array<int>>")), lambda k, _: k.cast("string"))
    schema = C.preprocessed(catalog).select(
        "db_id",
        "table_bounds",
        F.map_concat(F.create_map(F.lit("0"), F.lit(None).cast("int")), text_keys(F.col("column_to_table"))).alias("column_to_table"),
        lists(F.col("table_to_columns")).alias("table_to_columns"),
        text_keys(F.col("foreign_keys")).alias("foreign_keys"),
        lists(F.col("foreign_keys_tables")).alias("foreign_keys_tables"),
        "primary_keys",
    )
    out = found.join(own.select("idx", F.col("question").alias("raw_question"), F.col("question_toks").alias("question_for_copying")), "idx")
    for part in (typed, named, schema):
        out = out.join(part, "db_id")
    order = "raw_question db_id question question_for_copying sc_link cv_link columns tables table_bounds column_to_table table_to_columns foreign_keys foreign_keys_tables primary_keys"
    return out.select("idx", *order.split())


def preprocess(spark: SparkSession, folder: Folder, annotator: Callable[[], Annotator] = PlainTokens(), values: bool | None = None) -> None:
    """Merges or converts the question files, and writes a linking file for each section; values (of cells) are linked unless the databases are of the large kind."""
    source = ("train/train.json",) if folder.kind == "bird" else ("train_spider.json", "train_others.json")
    parts = [files.questions(spark, f"{folder.path}/{p}") for p in source]
    train = relations.union_splits(*parts)
    if folder.kind == "bird":
        train = converted(train)
        test = converted(files.questions(spark, f"{folder.path}/dev/dev.json"))
        sinks.write_json_array(test, folder.test, indent=True)
        both = [spark.read.text(f"{folder.path}/{p}", wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("n", "v")) for p in ("dev/dev_tables.json", "train/train_tables.json")]
        merged = both[0].withColumn("k", F.lit(0)).union(both[1].withColumn("k", F.lit(1)))
        documents.write(merged.withColumn("idx", F.struct("k", "n")), F.col("v"), folder.tables)
    sinks.write_json_array(train, folder.train, indent=folder.kind == "bird")
    frames = folder.catalog(spark)
    wanted = folder.kind != "bird" if values is None else values
    cells = stored(sqlite.cells(spark, sqlite.databases(folder.databases), frames), "cells") if wanted and files.exists(spark, folder.databases) else None
    for section, path in (("test", folder.test), ("train", folder.train)):
        sinks.write_json_lines(records(files.questions(spark, path), frames, cells, annotator).orderBy("idx").coalesce(1), folder.links(section))


def items(spark: SparkSession, folder: Folder, section: str, frames: C.Catalog, strategy: Strategy | None, encoder: Callable[[], Encoder] = HashedWords(), guesses: str | None = None) -> DataFrame:
    """idx, db_id, question, query, skeleton, pre_skeleton and vector of a section's questions, as a strategy needs them.

    Masked strategies encode masked questions of the linking file. guesses: a file with a preliminary query for each question.
    """
    asked = files.questions(spark, folder.test if section == "test" else folder.train).select("idx", "db_id", "question", "query")
    databases = frames.per_database()
    out = with_skeletons(asked, databases)
    if guesses:
        guessed = asked.select("idx", "db_id").join(files.lines(spark, guesses).select("idx", F.col("value").alias("guess")), "idx")
        out = out.join(with_skeletons(guessed, databases, "guess", "pre_skeleton").select("idx", "pre_skeleton"), "idx", "left")
    else:
        out = out.withColumn("pre_skeleton", F.col("skeleton"))
    if strategy is None:
        return out
    text = "question"
    if strategy.masked:
        linked = files.json_lines(spark, folder.links(section), files.LINKING)
        if linked is None:
            raise FileNotFoundError(folder.links(section))
        found = stored(files.links(linked), "links")
        of = lambda *kinds: found.where(F.col("kind").isin(*kinds))
        masks = linking.masked_questions(linked.select("idx", "db_id", F.col("question").alias("toks")), of("col", "tab"), of("num"), of("cell"))
        out = out.join(masks, "idx")
        text = "masked"
    return stored(with_vectors(out, encoder, text).withColumn("vector", F.col("vector").cast("array<double>")), "items")
