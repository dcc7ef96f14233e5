"""Operator 1, toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause (``grammar_machines``). A word offers its class (target,
negation, report verb or other) and, if the lexicon has it, a nucleus: an insult or a threat
with the weight of its entry. The insult machine takes one nucleus; the threat machine takes
one and wants a target soon after it; the target machine weighs an insult by whether its clause
aims it at someone, before or after it; the negation machine lowers a nucleus in the scope
of a negation, the reported-speech machine one after a report verb. They are composed to
two machines (insults, threats), run over the clauses in which the lexicon matches; the weight
of a clause is the sum over its paths, one for each nucleus, and a document's the sum over its clauses.

An undirected nucleus alone is no evidence: what no more than the strongest such path of its
machine gives (``lone``) hardly counts (``evidence``). A logistic curve turns the sum of both
machines' evidence to 0..1.

Insult weights are log odds of the entry, learned from labels on a sample of at most SAMPLE
labelled rows (the rows of least hash of doc_id). Threats are a fixed list, and so rare in a
sample that their weights are log odds of a clause that aims the threat at someone, shrunk
towards the middle insult weight (FIRM where no insult is learned) by as many documents as
an insult needs for support. The curve is fitted on the same rows.
Scoring reads every whole text in one map. The only inputs of a score are the words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import append, cut, strings, table, texts
from querent.llm.transducers import Machine, compose, copies

#: Most labelled rows that are learned from.
SAMPLE = 24_000
#: Lengths in bytes of the word beginnings that can be stems.
STEMS = (4, 5, 6)
#: Toxic documents of the sample that must have a stem or word, and its least log odds.
SUPPORT, LEAST_ODDS = 4, 2.5
THRESHOLD = 0.3

# Fixed word classes of the grammar, in the languages of the corpus.
THREATS = ("kill", "hurt", "destroy", "burn", "shoot", "töten", "verletzen", "tuer", "frapper", "matar", "herir")
TARGETS = ("you", "your", "yours", "u", "they", "them", "he", "she", "him", "her", "du", "dich", "dein", "ihr", "euch", "sie", "tu", "toi", "ton", "vous", "votre", "eux", "tú", "ti", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "never", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "wrote", "quoted", "quote", "reported", "called", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

#: Words after a negation that it still governs, and words after a threat among which its target must be.
SCOPE, REACH = 3, 4
#: Weights of arcs: a nucleus in the scope of a negation, in reported speech, aimed at a target, and aimed at none.
NEGATED, REPORTED, TARGETED, UNDIRECTED = 0.35, 0.6, 1.25, 0.5
#: Share of what one undirected nucleus can give that counts as evidence.
HARDLY = 0.1
#: Weight of a threat where labels tell nothing.
FIRM = 4.0

# Symbols: other words, targets, negations, report verbs; an insult or a threat taken as the nucleus.
OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = "o", "t", "n", "r", "I", "H"
_PLAIN = (OTHER, TARGET, NEGATION, REPORT)


def insult_machine() -> Machine:
    """Exactly one insult."""
    return Machine(0, copies((0, 1), _PLAIN) | {(0, INSULT): [(1, INSULT, 1.0)]}, {1: 1.0})


def threat_machine() -> Machine:
    """Exactly one threat, directed if a target follows within REACH words."""
    arcs = copies((0, "aimed", "none"), _PLAIN) | {(0, THREAT): [(REACH, THREAT, 1.0)]}
    for left in range(1, REACH + 1):
        for x in _PLAIN:
            arcs[left, x] = [("aimed" if x == TARGET else left - 1 if left > 1 else "none", x, 1.0)]
    return Machine(0, arcs, {"aimed": TARGETED, "none": UNDIRECTED, **dict.fromkeys(range(1, REACH + 1), UNDIRECTED)})


def target_machine() -> Machine:
    """An insult weighs more where its clause has a target, before or after it, and less where it has none."""
    arcs = copies(("clear", "seen", "bare", "aimed"), _PLAIN)
    arcs["clear", TARGET] = [("seen", TARGET, 1.0)]
    arcs["clear", INSULT] = [("bare", INSULT, UNDIRECTED)]
    arcs["seen", INSULT] = [("aimed", INSULT, TARGETED)]
    arcs["bare", TARGET] = [("aimed", TARGET, TARGETED / UNDIRECTED)]
    return Machine("clear", arcs, dict.fromkeys(("bare", "aimed"), 1.0))


def negation_machine() -> Machine:
    """A nucleus among the SCOPE words after a negation is weighed down."""
    arcs = {}
    for left in range(SCOPE + 1):
        for x in (*_PLAIN, INSULT, THREAT):
            arcs[left, x] = [(SCOPE if x == NEGATION else max(0, left - 1), x, NEGATED if left and x in (INSULT, THREAT) else 1.0)]
    return Machine(0, arcs, dict.fromkeys(range(SCOPE + 1), 1.0))


def report_machine(quoted: bool) -> Machine:
    """A nucleus after a report verb, or in a clause with quotation marks, is weighed down."""
    arcs = copies(("direct", "told"), (*_PLAIN, INSULT, THREAT)) | {("direct", REPORT): [("told", REPORT, 1.0)]}
    arcs |= {("told", x): [("told", x, REPORTED)] for x in (INSULT, THREAT)}
    return Machine("told" if quoted else "direct", arcs, {"direct": 1.0, "told": 1.0})


@cache
def grammar_machines(quoted: bool) -> tuple[Machine, Machine]:
    """The composed machines of insults and of threats."""
    rest = compose(negation_machine(), report_machine(quoted))
    return compose(compose(insult_machine(), target_machine()), rest), compose(threat_machine(), rest)


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3B, 0x3F]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_CHAR = re.compile(r"[^\W\d_]")
#: Bytes of a UTF-8 character by its first byte (0: no first byte), and the least code point of each length.
_SIZE = np.zeros(256, dtype=np.uint8)
_SIZE[0xC2:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:0xF5] = 2, 3, 4
_LEAST = (0, 0, 0x80, 0x800, 0x10000)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter of _WORD."""
    out = np.zeros(0x110000, dtype=bool)
    out[[ord(c) for c in _CHAR.findall("".join(map(chr, range(0x110000))))]] = True
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the bytes that belong to letters of _WORD; bytes that are no UTF-8 within their document do not."""
    out = _LETTER[data]
    lead = np.flatnonzero(_SIZE[data])
    if not len(lead):
        return out
    n = len(data)
    inner = np.zeros(n + 4, dtype=bool)
    inner[:n] = (data & 0xC0) == 0x80
    inner[offsets] = False
    low = np.zeros(n + 4, dtype=np.int64)
    low[:n] = data & 0x3F
    sizes = _SIZE[data[lead]]
    for size in (2, 3, 4):
        at = lead[sizes == size]
        code = data[at].astype(np.int64) & (0x7F >> size)
        whole = np.ones(len(at), dtype=bool)
        for k in range(1, size):
            whole &= inner[at + k]
            code = code << 6 | low[at + k]
        whole &= (code >= _LEAST[size]) & (code < 0x110000)
        at = at[whole][_letters()[code[whole]]]
        for k in range(size):
            out[at + k] = True
    return out


def words(piece: K.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of all runs of letters, then of all pairs of runs joined by an apostrophe: every word that _WORD finds is among them."""
    inside = letters(piece.data, piece.offsets)
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[piece.offsets] = True
    edge = np.concatenate(([False], inside, [False]))
    starts = np.flatnonzero(inside & (~edge[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside & (~edge[2:] | cut[1:])) + 1
    document = np.searchsorted(piece.offsets, starts, side="right")
    joined = np.flatnonzero((starts[1:] == ends[:-1] + 1) & (document[1:] == document[:-1]))
    joined = joined[piece.data[ends[joined]] == 0x27]
    return np.concatenate([starts, starts[joined]]), np.concatenate([ends, ends[joined + 1]])


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of whole words and of their first STEMS bytes; 0 where a word is not longer."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(K._BYTE[data] * K._power("up", K._BASE, n), out=total[1:])
        down = K._power("down", K._BASE_INV, n + 1)[starts]
        base = total[starts]
        out = [K.mix((total[ends] - base) * down)]
        for size in STEMS:
            stop = starts + size
            h = K.mix((total[np.minimum(stop, n)] - base) * down + np.uint64(size))
            out.append(np.where(stop < ends, h, np.uint64(0)))
    return tuple(out)


def _code(stem: str) -> tuple[int, int]:
    """(kind, hash) of a lexicon entry: kind 0 is a word, i the i-th stem length."""
    raw = np.frombuffer(stem.rstrip("*").encode(), dtype=np.uint8)
    if not stem.endswith("*"):
        return 0, int(beginnings(raw, np.array([0]), np.array([len(raw)]))[0][0])
    longer = np.concatenate([raw, raw[:1]])
    kind = STEMS.index(len(raw)) + 1
    return kind, int(beginnings(longer, np.array([0]), np.array([len(longer)]))[kind][0])


@dataclass
class Grammar:
    """Weights of insult and threat entries (`stem*` or `word`), and the curve."""

    insults: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -3.0

    def compiled(self) -> list[np.ndarray]:
        """Sorted hashes of the entries by kind."""
        by: list[list[int]] = [[] for _ in range(len(STEMS) + 1)]
        for entry in [*self.insults, *self.threats]:
            kind, code = _code(entry)
            by[kind].append(code)
        return [np.unique(np.array(x, dtype=np.uint64)) for x in by]

    def weight(self, word: str, entries: dict[str, float]) -> float:
        raw = word.encode()
        best = entries.get(word, 0.0)
        for size in STEMS:
            if len(raw) > size:
                best = max(best, entries.get(raw[:size].decode(errors="replace") + "*", 0.0))
        return best

    @property
    def lone(self) -> tuple[float, float]:
        """The most that one undirected insult gives, and one undirected threat."""
        return tuple(UNDIRECTED * max([0.0, *x.values()]) for x in (self.insults, self.threats))

    def offers(self, words: list[str]) -> list[list[tuple[str, float]]]:
        """The symbols that each word offers: its class, and its nuclei with the weights of their entries."""
        out = []
        for word in words:
            own = [(TARGET if word in _TARGETS else NEGATION if word in _NEGATIONS else REPORT if word in _REPORTS else OTHER, 1.0)]
            own += [(x, w) for x, entries in ((INSULT, self.insults), (THREAT, self.threats)) if (w := self.weight(word, entries))]
            out.append(own)
        return out

    def parts(self, words: list[str], quoted: bool = False) -> tuple[float, float]:
        """Weights of a clause by the machine of insults and by that of threats: sums over their accepting paths."""
        offers = self.offers(words)
        return tuple(machine.weight(offers) for machine in grammar_machines(quoted))

    def clause(self, words: list[str], quoted: bool = False) -> float:
        """Weight of a clause."""
        return sum(self.parts(words, quoted))

    def evidence(self, insults: float, threats: float) -> float:
        return sum(max(0.0, raw - lone) + HARDLY * min(raw, lone) for raw, lone in zip((insults, threats), self.lone, strict=True))

    def curve(self, insults: float, threats: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * self.evidence(insults, threats) + self.offset))))

    def raws(self, array: pa.Array, compiled: list[np.ndarray]) -> np.ndarray:
        """Raw values (insults, threats) of the texts of a batch; clauses are read only where a word, or what could be one, matches."""
        out = np.zeros((len(array), 2))
        for piece in K.pieces(array):
            data = K.lower(piece.data)
            body = K.Piece(piece.first, data, piece.offsets)
            starts, ends = words(body)
            hit = np.zeros(len(starts), dtype=bool)
            for own, hashes in zip(compiled, beginnings(data, starts, ends), strict=True):
                if len(own):
                    hit |= own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            cuts = np.union1d(np.flatnonzero(_ENDS[data]), piece.offsets)
            place = np.searchsorted(cuts, starts[at], side="right")
            first = np.unique(place)
            owner = np.searchsorted(piece.offsets, cuts[first - 1], side="right") - 1
            for p, d in zip(first, owner, strict=True):
                text = data[cuts[p - 1] : cuts[p] if p < len(cuts) else len(data)].tobytes().decode(errors="replace")
                out[piece.first + d] += self.parts(_WORD.findall(text), text.count('"') >= 2 or "“" in text or "«" in text)
        return out


_TARGETS, _NEGATIONS, _REPORTS = frozenset(TARGETS), frozenset(NEGATIONS), frozenset(REPORTS)


def _entries(text: str) -> set[str]:
    """Words of a text and the beginnings that can be stems of them."""
    found: set[str] = set()
    low = text.translate(_FOLD)
    for word in set(_WORD.findall(low)):
        found.add(word)
        raw = word.encode()
        for size in STEMS:
            if len(raw) > size:
                try:
                    found.add(raw[:size].decode() + "*")
                except UnicodeDecodeError:
                    pass
    return found


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sampled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """text, toxic of at most about ``bound`` labelled documents: those of least hash of doc_id. Labels that are null or disagree are none."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    n = own.count()
    place = (F.xxhash64("id") / F.lit(float(1 << 63)) + 1) / 2
    picked = own.where(place < F.lit(min(1.0, bound / max(1, n)))).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    return docs.join(F.broadcast(picked), docs["doc_id"] == picked["id"]).select("text", "toxic")


def _counted(rows: DataFrame, entries: frozenset[str] | None) -> dict[str, int]:
    """Documents that have each entry; of the given ones, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in strings(batch.column(0)):
                found.update(_entries(text) if entries is None else _entries(text) & entries)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["entry", "n"])

    counted = rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r["entry"]: r["n"] for r in (counted.where(F.col("n") >= SUPPORT) if entries is None else counted).collect()}


def _aimed(rows: DataFrame) -> dict[tuple[str, int], int]:
    """Documents of each label that aim a threat at someone, neither negated nor reported, by threat."""
    single = {x: Grammar({}, {x: 1.0}) for x in THREATS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            columns = [(x, own.raws(batch.column(0), own.compiled())[:, 1]) for x, own in single.items()]
            for label in (0, 1):
                is_label = batch.column(1).to_numpy() == label
                found.update({(x, label): int((is_label & (raw >= TARGETED)).sum()) for x, raw in columns})
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], names=["entry", "toxic", "n"])

    counted = rows.select("text", "toxic").mapInArrow(run, "entry string, toxic int, n long").groupBy("entry", "toxic").agg(F.sum("n").alias("n"))
    return {(r["entry"], r["toxic"]): r["n"] for r in counted.collect()}


def _threats(rows: DataFrame, bad: int, good: int, firm: float) -> dict[str, float]:
    """Threat weights: log odds of an aimed threat, shrunk towards firm."""
    seen, out = _aimed(rows), {}
    for x in THREATS:
        b, g = seen.get((x, 1), 0), seen.get((x, 0), 0)
        odds = math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1))
        weight = ((b + g) * odds + SUPPORT * firm) / (b + g + SUPPORT)
        if weight > 0:
            out[x] = weight
    return out


def fit(rows: DataFrame) -> Grammar:
    """Grammar from (text, toxic) rows of bounded number; without toxic rows, the fixed threats alone."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Grammar({}, dict.fromkeys(THREATS, FIRM))
    with_bad = _counted(rows.where("toxic = 1"), None)
    with_good = _counted(rows.where("toxic = 0"), frozenset(with_bad))
    odds = {x: math.log((n + 0.5) / (bad + 1)) - math.log((with_good.get(x, 0) + 0.5) / (good + 1)) for x, n in with_bad.items()}
    kept = {x: w for x, w in odds.items() if w >= LEAST_ODDS and with_good.get(x, 0) <= 0.1 * with_bad[x]}
    insults = {x: w for x, w in kept.items() if x.endswith("*") or not any(x.encode().startswith(y.rstrip("*").encode()) for y in kept if y.endswith("*") and len(y) - 1 < len(x))}
    firm = float(np.median(list(insults.values()))) if insults else FIRM
    grammar = Grammar(insults, _threats(rows, bad, good, firm))
    compiled = grammar.compiled()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = grammar.raws(batch.column(0), compiled)
            yield pa.RecordBatch.from_arrays([pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), batch.column(1)], names=["insults", "threats", "toxic"])

    found = rows.mapInArrow(run, "insults double, threats double, toxic int").toArrow()
    evidence = [grammar.evidence(x, y) for x, y in zip(found["insults"].to_pylist(), found["threats"].to_pylist(), strict=True)]
    grammar.slope, grammar.offset = _logistic(np.array(evidence), found["toxic"].to_numpy())
    # whatever the labels, one undirected nucleus alone stays under the threshold
    bound = math.log(THRESHOLD / (1 - THRESHOLD)) - 0.05
    insult, threat = grammar.lone
    grammar.offset = min(grammar.offset, bound - grammar.slope * max(grammar.evidence(insult, 0.0), grammar.evidence(0.0, threat)))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a slightly shrunk logistic curve, by Newton's method."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    shrink = np.diag([0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + shrink, a.T @ (y - p) - shrink @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(b[0]), 0.01), float(b[1])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= THRESHOLD). Null and empty texts get the curve's value at 0."""
    compiled = grammar.compiled()

    def work(array: pa.Array) -> list[pa.Array]:
        scores = [grammar.curve(x, y) for x, y in grammar.raws(array, compiled).tolist()]
        return [pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32())]

    return append(docs, "text", "score double, predicted int", work)


def accepted(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The documents that are not predicted toxic; their columns are unchanged."""
    own = score(docs.select(*(F.col(c).alias(f"_own_{c}") for c in docs.columns), F.col("text").cast("string").alias("text")), grammar)
    return own.where("predicted = 0").select(*(F.col(f"_own_{c}").alias(c) for c in docs.columns))


def held_out() -> object:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Grammar from the labelled documents that are not held out. A null doc_id is in neither part: it has no label, and its held_out is null."""
    return fit(cut(sampled(texts(docs), labels.where(~held_out()))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the grammar learned from labels that are not held out."""
    docs = texts(table(spark, sf_dir, "documents"))
    grammar = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, grammar).select("doc_id", held_out().alias("held_out"), "score", "predicted")
