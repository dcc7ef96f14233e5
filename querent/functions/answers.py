"""Clean-up of model answers and of candidate SQL, and dataset text forms, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of formats that other tools read.
EXPORT_MARK = "\t----- bird -----\t"
CURRENT_YEAR = "2020"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """Line ends to spaces, runs of white space to one space, outer white space off."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def before_comment(text: Column) -> Column:
    """What stands before the first `/*`, outer white space off first."""
    return F.split_part(stripped(text), F.lit("/*"), F.lit(1))


def with_select(sql: Column) -> Column:
    """`SELECT ` in front unless the text starts with exactly `SELECT`."""
    return F.when(sql.startswith("SELECT"), sql).otherwise(F.concat(F.lit("SELECT "), sql))


def answer_sql(response: Column) -> Column:
    """A model's answer as one SQL line."""
    return with_select(before_comment(one_line(response)))


def gold_answer(query: Column) -> Column:
    """A known query without its first seven characters (`SELECT `)."""
    return F.substring(one_line(query), 8, 1 << 30)


def fixed_year(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)\s*", CURRENT_YEAR)


def joined_operators(sql: Column) -> Column:
    for spaced, joined in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        sql = F.replace(sql, F.lit(spaced), F.lit(joined))
    return sql


def without_distinct(sql: Column) -> Column:
    """The first statement with its `distinct` words taken out; quoted text and all else as it was."""
    first = F.regexp_extract(sql, r"^(?:'[^']*'?|\"[^\"]*\"?|[^;'\"])*;?", 0)
    parts = F.regexp_extract_all(first, F.lit(r"'[^']*'?|\"[^\"]*\"?|\w+|[^\w'\"]+"), F.lit(0))
    return F.array_join(F.filter(parts, lambda t: F.lower(t) != "distinct"), "")


def question_tokens(question: Column) -> Column:
    """Split at spaces, empty parts dropped, one closing mark detached from longer parts."""
    parts = F.filter(F.split(question, " "), lambda t: t != "")
    split = lambda t: F.when((F.length(t) > 1) & t.rlike(r"[?.:;,]$"), F.array(F.regexp_replace(t, r".$", ""), F.right(t, F.lit(1)))).otherwise(F.array(t))
    return F.flatten(F.transform(parts, split))


def with_evidence(question: Column, evidence: Column) -> Column:
    """Question and evidence, if any, with a space between; outer white space off."""
    has = F.coalesce(F.length(evidence), F.lit(0)) > 0
    return stripped(F.when(has, F.concat_ws(" ", question, evidence)).otherwise(question))


def export_line(sql: Column, db_id: Column) -> Column:
    return F.concat(before_comment(sql), F.lit(EXPORT_MARK), db_id)


def token_count(text: Column) -> Column:
    """Default token counter: words and single marks."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0)))
