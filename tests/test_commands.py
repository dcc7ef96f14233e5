"""The command line, end to end, on a small dataset folder."""

from __future__ import annotations

import json
import sqlite3

import public_tokenizers
import pytest

from querent.__main__ import main
from querent.plans import dataset
from querent.operators import prompts
from querent.plans import tokens
from querent.sources import catalog, files, sqlite

QUESTIONS = [("how many singers are there ?", "SELECT count(*) FROM singer"), ("show the name of singers from France", "SELECT name FROM singer WHERE country = 'France'"), ("which concert was in 2014 ?", "SELECT title FROM concert WHERE year = 2014"), ("names of singers by age", "SELECT name FROM singer ORDER BY age")]
TABLES = {
    "db_id": "music",
    "table_names": ["singer", "concert"],
    "table_names_original": ["singer", "concert"],
    "column_names": [[-1, "*"], [0, "singer id"], [0, "name"], [0, "country"], [0, "age"], [1, "concert id"], [1, "title"], [1, "year"], [1, "singer id"]],
    "column_names_original": [[-1, "*"], [0, "singer_id"], [0, "name"], [0, "country"], [0, "age"], [1, "concert_id"], [1, "title"], [1, "year"], [1, "singer_id"]],
    "column_types": ["text", "number", "text", "text", "number", "number", "text", "number", "number"],
    "primary_keys": [1, 5],
    "foreign_keys": [[8, 1]],
}


def rows(items, evidence=False):
    out = []
    for i, (q, sql) in enumerate(items):
        out.append({"db_id": "music", "question": q, "question_toks": q.split(" "), "query": sql} if not evidence else {"question_id": i, "db_id": "music", "question": q, "evidence": "age in years" if i else "", "SQL": sql})
    return json.dumps(out)


def database(folder):
    (folder / "database" / "music").mkdir(parents=True)
    con = sqlite3.connect(folder / "database" / "music" / "music.sqlite")
    con.executescript("CREATE TABLE singer (singer_id INTEGER PRIMARY KEY, name TEXT, country TEXT, age INTEGER); CREATE TABLE concert (concert_id INTEGER PRIMARY KEY, title TEXT, year INTEGER, singer_id INTEGER REFERENCES singer(singer_id)); INSERT INTO singer VALUES (1, 'Ann', 'France', 30), (2, 'Bob', 'Spain', 40); INSERT INTO concert VALUES (1, 'Gala', 2014, 1);")
    con.commit()
    con.close()
    (folder / "tables.json").write_text(json.dumps([TABLES]))


def written(path):
    (part,) = path.glob("part-*")
    return part.read_text()


def test_from_files_to_answers(spark, tmp_path):
    database(tmp_path)
    (tmp_path / "train_spider.json").write_text(rows(QUESTIONS[:2]))
    (tmp_path / "train_others.json").write_text(rows(QUESTIONS[2:]))
    (tmp_path / "dev.json").write_text(rows([("how many concerts are there ?", "SELECT count(*) FROM concert"), ("show names of singers from Spain", "SELECT name FROM singer WHERE country = 'Spain'")]))
    main(["preprocess", "--data_dir", str(tmp_path)], spark)
    assert len(json.loads(written(tmp_path / "train_spider_and_others.json"))) == 4
    linked = [json.loads(x) for x in written(tmp_path / "enc" / "test_schema-linking.jsonl").splitlines()]
    assert [x["raw_question"] for x in linked] == ["how many concerts are there ?", "show names of singers from Spain"]
    assert linked[0]["question"] == ["how", "many", "concert", "are", "there", "?"] and linked[0]["question_for_copying"][2] == "concerts"
    assert linked[0]["sc_link"]["q_tab_match"] == {"2,1": "TEM"} and linked[1]["cv_link"]["cell_match"] == {"5,3": "EXACTMATCH"}
    assert linked[0]["tables"] == [["singer"], ["concert"]] and linked[0]["columns"][:2] == [["<type: text>", "*"], ["<type: number>", "singer", "id"]]
    assert linked[0]["table_bounds"] == [1, 5, 9] and linked[0]["primary_keys"] == [1, 5] and linked[0]["foreign_keys"] == {"8": 1}
    read = files.json_lines(spark, str(tmp_path / "enc" / "test_schema-linking.jsonl"), files.LINKING)
    assert read.count() == 2 and read.where("size(table_to_columns) = 2 and raw_question is not null").count() == 2
    (tmp_path / "guess.txt").write_text("SELECT count(*) FROM singer\nSELECT name FROM singer WHERE age = 3\n")
    out = tmp_path / "process"
    main(["prompts", "--data_dir", str(tmp_path), "--split", "test", "--k_shot", "1", "--prompt_repr", "SQL", "--example_type", "QA", "--selector_type", "EUCDISMASKPRESKLSIMTHR", "--max_seq_len", "4096", "--pre_test_result", str(tmp_path / "guess.txt"), "--out", str(out)], spark)
    (run,) = out.iterdir()
    task = json.loads(written(run / "questions.json"))
    assert [q["n_examples"] for q in task["questions"]] == [1, 1] and "how many singers" in task["questions"][0]["prompt"] and "from France" in task["questions"][1]["prompt"]
    assert set(task["costs"]) >= {"gpt-4"} and task["args"]["k_shot"] == "1"
    for n in (1, 3):
        main(["ask", "--question", str(run), "--model", "replay", "--n", str(n), "--db_dir", str(tmp_path / "database")], spark)
        assert written(run / "RESULTS_MODEL-replay.txt").splitlines() == ["SELECT count(*) FROM t"] * 2
    main(["prompts", "--data_dir", str(tmp_path), "--split", "train", "--prompt_repr", "TEXT", "--out", str(out)], spark)
    # the other test file of the same kind of folder, budgets by a real tokenizer
    (tmp_path / "spider-realistic.json").write_text(rows([("number of concerts ?", "SELECT count(*) FROM concert")]))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    main(["prompts", "--data_dir", str(tmp_path), "--data_type", "realistic", "--split", "test", "--k_shot", "2", "--prompt_repr", "SQL", "--selector_type", "EUCDISTANCE", "--encoder", "hashed", "--tokenizer", vocabulary, "--out", str(tmp_path / "other")], spark)
    (run,) = (tmp_path / "other").iterdir()
    (asked,) = json.loads(written(run / "questions.json"))["questions"]
    assert run.name.startswith("REALISTIC-TEST") and asked["n_examples"] == 2 and asked["prompt_tokens"] == tokens.TokenFile(vocabulary)()(asked["prompt"])


@pytest.mark.parametrize("most", [40, 60, 90, 500])
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_budget_by_a_tokenizer(spark, most, name):
    """Examples are taken while the whole prompt fits, by the tokenizer's own count; one that does not fit is passed over."""
    targets = spark.createDataFrame([(0, "d", "the asked prompt", "SELECT 1"), (1, "d", "another", "SELECT 2")], "idx long, db_id string, prompt string, query string")
    sizes = [5, 40, 3, 8]
    examples = spark.createDataFrame([(0, r, 10 + r, " ".join(["word"] * k)) for r, k in enumerate(sizes)], "t_idx long, rank int, c_idx long, example string")
    factory = tokens.TokenFile(public_tokenizers.path(name))
    got = {r["idx"]: r for r in prompts.few_shot(targets, examples, "QA", 3, most, 10, tokenizer=factory).collect()}
    count, done, chosen = factory(), "", []
    for r, k in enumerate(sizes):
        text = prompts.STYLES["QA"][0] + done + " ".join(["word"] * k) + prompts.GAP + "the asked prompt"
        if len(chosen) < 3 and count(text) + 10 <= most:
            done, chosen = done + " ".join(["word"] * k) + prompts.GAP, [*chosen, 10 + r]
    assert list(got[0]["chosen"]) == chosen and got[0]["prompt_tokens"] == count(got[0]["prompt"]) and got[1]["n_examples"] == 0


def test_other_dataset(spark, tmp_path):
    database(tmp_path)
    for section in ("train", "dev"):
        (tmp_path / section).mkdir()
        (tmp_path / section / f"{section}.json").write_text(rows(QUESTIONS, evidence=True))
        (tmp_path / section / f"{section}_tables.json").write_text(json.dumps([TABLES]))
    (tmp_path / "tables.json").unlink()
    main(["preprocess", "--data_dir", str(tmp_path), "--data_type", "bird"], spark)
    got = files.questions(spark, str(tmp_path / "dev.json")).collect()
    assert got[0]["question"] == QUESTIONS[0][0] and got[1]["question"] == QUESTIONS[1][0] + " age in years" and got[1]["query"] == QUESTIONS[1][1]
    assert got[1]["question_toks"][-3:] == ["age", "in", "years"]
    assert len(json.loads(written(tmp_path / "tables.json"))) == 2
    linked = json.loads(written(tmp_path / "enc" / "train_schema-linking.jsonl").splitlines()[1])
    assert linked["cv_link"] == {"num_date_match": {}, "cell_match": {}} and linked["sc_link"]["q_tab_match"]
    (tmp_path / "out.txt").write_text("SELECT 1 /* x */\nSELECT 2\n\nSELECT 3\nSELECT 4\n")
    main(["export", "--output", str(tmp_path / "out.txt"), "--bird_dev", str(tmp_path / "dev.json")], spark)
    made = json.loads(written(tmp_path / "out.json"))
    assert list(made) == ["0", "1", "2", "3"] and made["1"] == "SELECT 2\t----- bird -----\tmusic"
    (tmp_path / "short.txt").write_text("SELECT 1\n")
    with pytest.raises(SystemExit):
        main(["export", "--output", str(tmp_path / "short.txt"), "--bird_dev", str(tmp_path / "dev.json")], spark)


def test_key_sets(spark, tmp_path):
    own = TABLES | {"foreign_keys": [[8, 1], [4, 3], [7, 4], [1, 3]]}
    (tmp_path / "t.json").write_text(json.dumps([own]))
    got = {r["column"]: r["representative"] for r in catalog.key_sets(catalog.read_databases(spark, str(tmp_path / "t.json"))).collect()}
    # [1, 3] joins the first set that has either; column 3 is then in two, and the later set counts
    assert got == {"__concert.singer_id__": "__singer.singer_id__", "__singer.singer_id__": "__singer.singer_id__", "__singer.age__": "__singer.country__", "__singer.country__": "__singer.country__", "__concert.year__": "__singer.country__"}


def test_query_reader(tmp_path):
    database(tmp_path)
    path = str(tmp_path / "database" / "music" / "music.sqlite")
    assert sqlite.execute_query(path, "SELECT count(*) FROM singer") == [(2,)]
    assert sqlite.execute_query(path, ["SELECT 1", "SELECT 2"]) == [[(1,)], [(2,)]]
    with pytest.raises(TypeError):
        sqlite.execute_query(path, 5)


def test_folder_without_databases(spark, tmp_path):
    (tmp_path / "tables.json").write_text(json.dumps([TABLES]))
    assert dataset.Folder(str(tmp_path)).catalog(spark).kept().tables.count() == 2


def test_lemmas_of_a_lexicon(spark, tmp_path):
    """A name of the schema is found by a form whose lemma only the lexicon knows."""
    database(tmp_path)
    (tmp_path / "train_spider.json").write_text(rows([("who sang in the concert ?", "SELECT name FROM singer")]))
    (tmp_path / "train_others.json").write_text("[]")
    (tmp_path / "dev.json").write_text(rows([("whose titles rang ?", "SELECT title FROM concert")]))
    (tmp_path / "forms.tsv").write_text("sang\tsinger\nrang\tyear\ntitles\ttitle\nnames\tname\n")
    main(["preprocess", "--data_dir", str(tmp_path), "--lexicon", str(tmp_path / "forms.tsv")], spark)
    (linked,) = [json.loads(x) for x in written(tmp_path / "enc" / "test_schema-linking.jsonl").splitlines()]
    assert linked["question"] == ["whose", "title", "year", "?"]
    assert set(linked["sc_link"]["q_col_match"]) == {"1,6", "2,7"}


def test_catalog_is_stored_for_contents(spark, tmp_path, monkeypatch):
    """One snapshot serves all uses while the database's contents are the same; a new column makes another one, and an unfinished one is made anew."""
    database(tmp_path)
    made = []
    real = sqlite.catalog
    monkeypatch.setattr(sqlite, "catalog", lambda *x: made.append(1) or real(*x))
    folder = dataset.Folder(str(tmp_path))
    rows_of = lambda c: [sorted(map(tuple, df.collect())) for df in (c.tables, c.columns, c.foreign_keys)]
    first = rows_of(folder.catalog(spark))
    assert rows_of(folder.catalog(spark)) == first == rows_of(real(spark, sqlite.databases(folder.databases))) and len(made) == 1
    (kept,) = (tmp_path / "enc").glob("catalog-*")
    (kept / "foreign_keys" / "_SUCCESS").unlink()
    assert rows_of(folder.catalog(spark)) == first and len(made) == 2
    con = sqlite3.connect(tmp_path / "database" / "music" / "music.sqlite")
    con.executescript("ALTER TABLE singer ADD COLUMN height INTEGER")
    con.close()
    assert "height" in {r["column_name"] for r in folder.catalog(spark).columns.collect()} and len(made) == 3


def test_catalog_of_a_file_is_stored(spark, tmp_path):
    (tmp_path / "tables.json").write_text(json.dumps([TABLES]))
    folder = dataset.Folder(str(tmp_path))
    assert folder.catalog(spark).columns.count() == folder.catalog(spark).columns.count() == 8
    (tmp_path / "tables.json").write_text(json.dumps([TABLES | {"db_id": "other"}]))
    assert {r["db_id"] for r in folder.catalog(spark).tables.collect()} == {"other"}
    assert len(list((tmp_path / "enc").glob("catalog-*"))) == 2
