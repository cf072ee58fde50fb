"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Text is folded: compatibility forms and accents to plain letters, lower case, look-alike letters of other scripts to Latin
ones, digits and signs that stand before a letter to the letter they imitate. Where such stand behind a letter only
(``idio7``), a second folding takes them for letters as well, and the better reading of a word counts. Lexicon entries are
whole words (``idiot$``) or word beginnings (``lowei``). Their weights are
log odds learned from labelled rows: beginnings and words of toxic rows that are far commoner there than in the others
(a bound on the chance of that, corrected for the number of candidates, decides), in the most specific form that loses no
row. Phrases (a hit with the word before or after it) that only clean rows have are exceptions: such a hit does not count.
The summed weights, and the sum per square root of length, go through a logistic curve fitted to the same rows.

Rows whose crc32(doc_id) mod 5 is 0 are held out and never learned from. The fit uses at most ``SAMPLE`` labelled rows,
chosen by hash of the id; nothing else is bounded. A feature must be in a 200th of the toxic training rows, so at most 200
times the mean number of features of such a row reach the driver; phrases are those of hits in the sample. Every document is
scored, whole. The fit is the same however the table is dealt out.

Defined results: null and empty texts score as a text without hits; a null doc_id is not held out; labels of documents
that are missing, and null labels, are ignored; repeated rows get equal scores; without both classes in the training rows
the seed words alone score, on a fixed curve; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import heapq
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, cut, slim

SAMPLE = 30_000
#: Smallest shingle hashes by which near copies among training rows are told.
SKETCH = 32
#: Common insults, used at this weight until labels say otherwise.
SEED_WEIGHT = 2.0
SEEDS = ("idiot", "moron", "stupid", "imbecile", "scum", "loser", "pathetic", "worthless", "disgusting", "retard", "bastard", "asshole", "bitch", "dumm", "idiota", "estúpido", "crétin", "salaud")
LOOKALIKE = dict(zip("аеорсухіјѕԁһӏкмтвнαεοριυνκτ", "aeopcyxijsdhlkmtbhaeopiuvkt", strict=True))
FOLD = str.maketrans(LOOKALIKE)
LEET = str.maketrans("013457@$!|", "oieastasil")
IMITATES = re.compile(r"[013457@$!|]+(?=[^\W\d_])")
#: Behind a letter; an exclamation mark there is one.
TRAILS = re.compile(r"(?<=[^\W\d_])[013457@$|]+")
MARKS = re.compile(r"[\u0300-\u036f]+")
WORDS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    if not text.isascii():
        text = text.translate(FOLD)
    return IMITATES.sub(lambda m: m[0].translate(LEET), text)


def views(text: str) -> list[str]:
    """The folded text, and if letters are followed by what imitates letters the reading with those, of the same length."""
    folded = fold(text)
    if TRAILS.search(folded) is None:
        return [folded]
    return [folded, TRAILS.sub(lambda m: m[0].translate(LEET), folded)]


def features_of(folded: str) -> set[str]:
    """Word beginnings of 4 to 8 letters, and whole words of any length, marked with ``$``."""
    found = set()
    for w in set(WORDS.findall(folded)):
        n = len(w)
        if n >= 3:
            found.add(w + "$")
            found.update(w[:k] for k in range(4, min(n, 8) + 1))
    return found


def is_letter(c: str) -> bool:
    return WORDS.match(c) is not None


@dataclasses.dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-4.0, 1.5, 0.5)

    def automaton(self):
        a = ahocorasick.Automaton()
        by: dict[str, list[tuple[bool, float]]] = {}
        for e, w in self.weights.items():
            by.setdefault(e.rstrip("$"), []).append((e.endswith("$"), w))
        for word, how in by.items():
            a.add_word(word, (len(word), how))
        a.make_automaton()
        return a

    def hits(self, automaton, folded: str) -> Iterator[tuple[int, int, float]]:
        """Word start, word end and weight; one hit, the heaviest, per word."""
        if not len(automaton):
            return
        best: dict[int, tuple[int, float]] = {}
        for last, (n, how) in automaton.iter(folded):
            at = last - n + 1
            if at and is_letter(folded[at - 1]):
                continue
            end = WORDS.match(folded, at).end()
            w = max((w for whole, w in how if not whole or end == last + 1), default=0.0)
            if w > best.get(at, (0, 0.0))[1]:
                best[at] = (end, w)
        for at, (end, w) in best.items():
            yield at, end, w

    def total(self, automaton, texts: list[str]) -> float:
        """The weights of the words of a text, given in its views; an exception phrase in any of them takes a hit out."""
        best: dict[int, float] = {}
        for folded in texts:
            for at, end, w in self.hits(automaton, folded):
                if self.exceptions and any(p in self.exceptions for p in phrases(folded, at, end)):
                    w = 0.0
                best[at] = max(best.get(at, 0.0), w)
        return math.fsum(best.values())

    def score(self, total: float, length: int) -> float:
        a, b, c = self.curve
        x = a + b * math.log1p(total) + c * total / math.sqrt(length / 100 + 1)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def phrases(folded: str, at: int, end: int) -> tuple[str, str]:
    """The hit with the whole word before it and the whole word behind it, however far they are."""
    stop = at
    while stop and not is_letter(folded[stop - 1]):
        stop -= 1
    start = stop
    while start and is_letter(folded[start - 1]):
        start -= 1
    after = WORDS.search(folded, end)
    word = folded[at:end]
    return f"{folded[start:stop]} {word}", f"{word} {after[0] if after else ''}"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(toxic, text)`` of at most ``most`` labelled rows that are not held out. Written once.

    Near copies would make every word of their text look toxic. Rows with the same label and the same smallest hash of their
    3-word runs are compared with the one of them with the smallest doc_id; those that share half of their ``SKETCH``
    smallest hashes with it are left out, others (which have a common passage only) stay.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "known")  # at most ``most`` pairs of numbers
    rows = slim(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    ddl = "doc_id bigint, toxic int, text string, sketch array<bigint>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = []
            for t in b.column(2).to_pylist():
                words = t.encode().lower().split()
                runs = set(zip(words, words[1:], words[2:])) if len(words) > 2 else {tuple(words)}  # noqa: B905
                low.append(heapq.nsmallest(SKETCH, {xxhash.xxh64_intdigest(b" ".join(r)) >> 1 for r in runs}))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *b.columns[1:], pa.array(low, pa.list_(pa.int64()))], schema=schema)

    rows = cut(rows.mapInArrow(run, ddl), "sketched").withColumn("low", F.get("sketch", F.lit(0)))
    # at most ``most`` documents (and repeats of their rows): the first of a smallest hash is one row
    order = F.struct("doc_id", F.xxhash64("text").alias("h"), "sketch")
    first = rows.groupBy("toxic", "low").agg(F.min(order).alias("f"))
    met = rows.dropDuplicates(["toxic", "doc_id", "text"]).join(first, ["toxic", "low"])
    itself = (F.col("doc_id") == F.col("f.doc_id")) & (F.xxhash64("text") == F.col("f.h"))
    shared = F.size(F.array_intersect("sketch", "f.sketch"))
    apart = 2 * shared < F.least(F.size("sketch"), F.size("f.sketch"))
    return cut(met.where(itself | apart).select("toxic", "text"), "training")


def _counts(rows: DataFrame, ddl: str, of, last) -> DataFrame:
    """One Arrow pass with two Counters a task, filled by ``of()(views, counter)``; then ``last`` of the sums by key."""
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, add = Counter(), Counter(), of()
        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                add(views(t), pos if toxic else neg)
        keys = list(pos | neg)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], schema=schema
        )

    return last(rows.mapInArrow(run, ddl).groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def _surprise(pos: np.ndarray, neg: np.ndarray, p0: float) -> np.ndarray:
    """A bound on -log of the chance that pos of pos + neg rows are toxic, if the share were p0 (0 where below p0)."""
    n = pos + neg
    p = pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log(p / p0), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - p0)), 0)
    return np.where(p > p0, n * kl, 0.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Lexicon:
    rows = training_rows(docs, labels, most)
    n = {t: c for t, c in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    seeds = {w + "$": SEED_WEIGHT for w in map(fold, SEEDS)}
    if not n_pos or not n_neg:
        return Lexicon(seeds)
    ddl = "key string, pos bigint, neg bigint"
    least = max(3, n_pos // 200)

    def all_features():
        return lambda texts, c: c.update(set().union(*map(features_of, texts)))

    top = lambda df: df.where(F.col("pos") >= least)
    candidates = {r[0] for r in _counts(rows.where("toxic = 1"), ddl, all_features, top).collect()} | set(seeds)
    held = rows.sparkSession.sparkContext.broadcast(candidates)

    def known_features():
        return lambda texts, c: c.update(set().union(*map(features_of, texts)) & held.value)

    found = sorted(_counts(rows, ddl, known_features, lambda df: df).collect())  # the candidates' counts
    weights = dict(seeds)
    if found:
        keys = [r[0] for r in found]
        pos, neg = (np.array([r[k] for r in found], float) for k in (1, 2))
        odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        sure = _surprise(pos, neg, n_pos / (n_pos + n_neg)) >= math.log(len(keys) / 0.01)
        by = {k: (p, o) for k, p, o, s in zip(keys, pos, odds, sure, strict=True) if s and o >= 1.5}
        # the most specific form that loses under a third of the rows, then no form whose beginning is in the lexicon
        wider = {}
        for k, (p, _) in by.items():
            up = k[:-1]
            wider[up] = max(wider.get(up, 0), p)
            if k.endswith("$"):
                for j in range(4, min(len(up), 8) + 1):
                    wider[up[:j]] = max(wider.get(up[:j], 0), p)
        exact = {k: v for k, v in by.items() if k.endswith("$") or wider.get(k, 0) < 0.7 * v[0]}
        kept: dict[str, float] = {}
        for k, (_, o) in sorted(exact.items(), key=lambda x: (len(x[0].rstrip("$")), x[0].endswith("$"), x[0])):
            w = k.rstrip("$")
            if not any(w[:j] in kept and kept[w[:j]] >= o - 0.5 for j in range(4, len(w) + 1)):
                kept[k] = float(o)
        for k, p, ng, o in zip(keys, pos, neg, odds, strict=True):
            if k in weights and p + ng >= 5:  # labels know this seed
                weights[k] = float(max(0.0, o))
        weights |= kept
    weights = {k: min(w, 6.0) for k, w in weights.items() if w >= 0.5}
    lexicon = Lexicon(weights)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def contexts():
        lex, automaton = shared.value, shared.value.automaton()
        seen = lambda text: {p for at, end, _ in lex.hits(automaton, text) for p in phrases(text, at, end) if len(p.split()) == 2}
        return lambda texts, c: c.update(set().union(*map(seen, texts)))

    only_clean = lambda df: df.where("neg >= 3 AND pos = 0")
    lexicon = dataclasses.replace(lexicon, exceptions=frozenset(r[0] for r in _counts(rows, ddl, contexts, only_clean).collect()))
    return dataclasses.replace(lexicon, curve=_curve(rows, lexicon, lexicon.curve))


def _totals(rows: DataFrame, lexicon: Lexicon, ddl: str, make) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for b in batches:
            totals, lengths = [], []
            for t in b.column(b.num_columns - 1):
                text = t.as_py() or ""
                lengths.append(len(text))
                totals.append(shared.value.total(automaton, views(text)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *make(totals, lengths)], schema=schema)

    return rows.mapInArrow(run, ddl)


def _curve(rows: DataFrame, lexicon: Lexicon, start: tuple[float, float, float]) -> tuple[float, float, float]:
    """Logistic regression (Newton steps, a little ridge) on log(1 + total) and total by root of length."""
    make = lambda totals, lengths: [pa.array(totals, pa.float64()), pa.array(lengths, pa.int64())]
    got = _totals(rows, lexicon, "toxic int, total double, length bigint", make).toPandas()  # at most SAMPLE rows
    got = got.sort_values(["toxic", "total", "length"])  # sums must not depend on the tasks' order
    y = got["toxic"].to_numpy(float)
    total, length = got["total"].to_numpy(), got["length"].to_numpy()
    x = np.stack([np.ones(len(y)), np.log1p(total), total / np.sqrt(length / 100 + 1)], 1)
    beta = np.array([math.log(y.mean() / (1 - y.mean())), 0.0, 0.0])
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    # a heavier total never lowers the score
    return (float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2])))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, held_out, score, predicted, weight`` for every row, one pass, no shuffle."""

    def make(totals: list[float], lengths: list[int]) -> list[pa.Array]:
        return [pa.array([lexicon.score(t, n) for t, n in zip(totals, lengths, strict=True)], pa.float64()), pa.array(totals, pa.float64())]

    rows = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = _totals(rows, lexicon, "doc_id bigint, held_out boolean, score double, weight double", make)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight")


def op1(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
