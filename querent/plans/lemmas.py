"""A lemmatiser that is induced from a lexicon of forms and their lemmas.

A form becomes its lemma by an ending change: cut letters go, others come. For every ending of
up to MAX_SUFFIX letters the change that most forms of this ending take is its rule; an ending
whose rule is that of the longest shorter ending with a rule needs none of its own and is left
out, so what is kept is the smallest table of endings that decides alike. Forms that the rules
get wrong are exceptions. A word takes its exception, else the rule of its longest ending.

A lexicon is rows (form, lemma), in any case and any number. Nulls and empty values are left
out; of several lemmas of a form, the one of most rows counts, then the least. An empty lexicon
gives no rules and leaves every word as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.operators.skew import split_join
from querent.plans.hooks import Annotator, PlainTokens
from querent.sources.stored import stored

#: Letters of the longest ending, and forms that a rule must hold for.
MAX_SUFFIX, LEAST = 6, 2
#: Bytes of rules and exceptions that an annotator may take to its tasks, and what an entry takes there besides its text.
MODEL_BYTES, ENTRY_BYTES = 64 << 20, 250


def settled(lexicon: DataFrame) -> DataFrame:
    """form, lemma: one row a form, in lower case."""
    rows = lexicon.select(F.lower(F.col("form")).alias("form"), F.lower(F.col("lemma")).alias("lemma")).where("form <> '' and lemma <> ''")
    counted = rows.groupBy("form", "lemma").agg((-F.count(F.lit(1))).alias("n"))
    return counted.groupBy("form").agg(F.min(F.struct("n", "lemma"))["lemma"].alias("lemma"))


def _endings(word: str, least: Column) -> Column:
    """The lengths from least of the endings of a word."""
    most = F.least(F.length(word), F.lit(MAX_SUFFIX))
    return F.explode(F.when(least <= most, F.sequence(least, most)))


def _changed(word: Column, cut: Column, add: Column) -> Column:
    out = F.concat(F.left(word, F.length(word) - cut), add)
    return F.when(out == "", word).otherwise(out)


def rules(pairs: DataFrame) -> DataFrame:
    """suffix, cut, add, n (forms that take this change) of the endings that need a rule; pairs has one row a form."""
    common = F.expr("size(filter(sequence(1, least(length(form), length(lemma))), i -> left(form, i) = left(lemma, i)))")
    change = pairs.withColumn("common", common).select("form", (F.length("form") - F.col("common")).alias("cut"), F.expr("substring(lemma, common + 1)").alias("add"))
    taken = change.select("form", "cut", "add", _endings("form", F.col("cut")).alias("k")).groupBy(F.expr("right(form, k)").alias("suffix"), "cut", "add").agg(F.count(F.lit(1)).alias("n"))
    best = taken.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "cut", "add")).alias("r"))
    best = stored(best.select("suffix", F.col("r.cut").alias("cut"), F.col("r.add").alias("add"), (-F.col("r.n")).alias("n")).where(F.col("n") >= LEAST), "endings")
    shorter = best.where("suffix <> ''").select(F.col("suffix").alias("own"), F.explode(F.sequence(F.lit(0), F.length("suffix") - 1)).alias("k")).select("own", "k", F.expr("right(own, k)").alias("suffix"))
    next_best = split_join(shorter, best.drop("n"), ["suffix"]).groupBy(F.col("own").alias("suffix")).agg(F.max(F.struct("k", "cut", "add")).alias("p"))
    alike = (F.col("cut") == F.coalesce("p.cut", F.lit(0))) & (F.col("add") == F.coalesce("p.add", F.lit("")))
    return best.join(next_best, "suffix", "left").where(~alike).select("suffix", "cut", "add", "n")


def _by_rules(words: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """Distinct words, in a column of this name, with lemma by rules."""
    asked = words.select(column, _endings(column, F.lit(0)).alias("_k")).select(column, "_k", F.expr(f"right(`{column}`, _k)").alias("suffix"))
    found = split_join(asked, rules.select("suffix", "cut", "add"), ["suffix"]).groupBy(column).agg(F.max(F.struct("_k", "cut", "add")).alias("_r"))
    word = F.col(column)
    return words.join(found, column, "left").select(column, F.coalesce(_changed(word, F.col("_r.cut"), F.col("_r.add")), word).alias("lemma"))


@dataclass(frozen=True)
class Lemmas:
    """rules (suffix, cut, add, n) and exceptions (form, lemma)."""

    rules: DataFrame
    exceptions: DataFrame

    def of(self, words: DataFrame, column: str = "word") -> DataFrame:
        """word, lemma of each distinct word, by joins: for vocabularies and models of any size. A null word has no row."""
        own = words.select(F.lower(F.col(column)).alias("word")).where("word is not null").distinct()
        named = self.exceptions.select(F.col("form").alias("word"), F.col("lemma").alias("_own"))
        return _by_rules(own, self.rules, "word").join(named, "word", "left").select("word", F.coalesce("_own", "lemma").alias("lemma"))

    def annotator(self, most_bytes: int = MODEL_BYTES) -> Callable[[], Annotator]:
        """A factory for with_tokens. The model's size is measured first; one beyond most_bytes is refused, `of` takes it."""
        entries = self.rules.select("suffix", F.to_json(F.struct("cut", "add"))).union(self.exceptions.select("form", "lemma")).toDF("a", "b")
        size = entries.agg(F.coalesce(F.sum(F.octet_length("a") + F.octet_length("b") + ENTRY_BYTES), F.lit(0))).first()[0]
        if size > most_bytes:
            raise ValueError(f"rules and exceptions of {size} bytes are too large for an annotator")
        changes = {r["suffix"]: (r["cut"], r["add"]) for r in self.rules.collect()}
        named = {r["form"]: r["lemma"] for r in self.exceptions.collect()}
        return Annotated(self.rules.sparkSession.sparkContext.broadcast((changes, named)))


@dataclass(frozen=True)
class Annotated:
    """Words and marks of texts in lower case, each as its lemma."""

    model: Broadcast

    def __call__(self) -> Annotator:
        changes, named = self.model.value
        plain = PlainTokens(singular=False)()

        def lemma(word: str) -> str:
            if word in named:
                return named[word]
            for k in range(min(len(word), MAX_SUFFIX), -1, -1):
                if rule := changes.get(word[len(word) - k :]):
                    return word[: len(word) - rule[0]] + rule[1] or word
            return word

        return lambda texts: [[lemma(x) for x in own] for own in plain(texts)]


def fit(lexicon: DataFrame) -> Lemmas:
    """Rules and exceptions of a lexicon."""
    pairs = stored(settled(lexicon), "lexicon")
    found = stored(rules(pairs), "rules")
    guessed = _by_rules(pairs.select("form"), found, "form").withColumnRenamed("lemma", "guess")
    wrong = pairs.join(guessed, "form").where("lemma <> guess").select("form", "lemma")
    return Lemmas(found, stored(wrong, "exceptions"))


def accuracy(model: Lemmas, lexicon: DataFrame) -> DataFrame:
    """One row: n forms of a lexicon, and how many of them the model gives the lemma of (hits)."""
    pairs = settled(lexicon)
    both = pairs.join(model.of(pairs, "form").select(F.col("word").alias("form"), F.col("lemma").alias("given")), "form")
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("lemma") == F.col("given")).cast("long")), F.lit(0)).alias("hits"))
