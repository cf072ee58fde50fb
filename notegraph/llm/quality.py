"""Quality rules: surface counts, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials with add-one smoothing are counted: the raw
one over all documents, the trusted one over all documents labelled good. A document's score is the mean over its
n-grams (and ``PRIOR`` neutral ones) of log p_trusted - log p_raw. It is kept if the rules pass it and the score is at least ``threshold``, which is
set between what all trusted documents and all documents labelled bad score (see ``least_score``). A row scores higher where its
own words count, so for the threshold each trusted row is scored with its own words taken out of the trusted counts
(``Model.left_out``). The comparison is deterministic for every document.

``verdicts`` reads the text twice, ``keep_good`` three times. To be counted the text meets the labels' ids in one shuffle; else what
travels is a row of counts per task, and for the threshold a row of numbers per document.

Defined results: null text has no words, so the rules reject it; a text without words scores 0; ``n_symbols`` and lines
follow the raw text; texts of any length are counted whole; repeated rows get equal verdicts; with no trusted rows every score
is 0 and only the rules decide; an empty table gives no rows; extra columns are ignored by ``verdicts`` and kept by ``keep_good``.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, cut, slim

BUCKETS = 1 << 16
#: Share of the trusted rows that may score below the threshold, and the largest margin (in nats) below that point.
TAIL, MARGIN = 0.001, 0.2
#: Tuning rows from which on labelled bad rows, and the spread of the rows themselves, narrow the margin.
FEW, SPREAD = 20, 100
#: N-grams of neutral evidence added to every document, so that short ones are not rejected on a few rare words.
PRIOR = 50
#: Bins a round in which a score of a given rank is looked for.
BINS = 4096
HELD = 150_000
SYMBOLS = b"#*$%&|<>"
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """64-bit hash by word (bytes); forgets all when it holds ``HELD`` words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > HELD:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of every word and every word pair."""
    pairs = hashes[:-1] * MIX[0] ^ (hashes[1:] * MIX[1] + MIX[2])
    return (np.concatenate([hashes, pairs]) * MIX[3] >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window += (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29))) * MIX[k]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    if not again.any():
        return 0
    step = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    step[at] += 1
    step[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(step)))


def surface(text: str, raw: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """``word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    chars = sum(map(len, words)) if len(raw) == len(text) else len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in raw:
        lines = Counter(raw.split(b"\n"))
        dup = sum(n - 1 for line, n in lines.items() if n > 1 and line.split())
    return chars, symbols, dup, repeated_words(hashes)


@dataclasses.dataclass(frozen=True)
class Model:
    """Trusted counts (plus one) and share of the raw text by bucket, and the least mean that is kept.

    The raw multinomial also covers n-grams the trusted rows, being fewer, have not met: both are smoothed by what the
    other's scale gives a bucket.
    """

    good: np.ndarray
    share: np.ndarray
    threshold: float = float("-inf")

    @functools.cached_property
    def total(self) -> float:
        return float(self.good.sum())

    @functools.cached_property
    def ratio(self) -> np.ndarray:
        """Log ratio by bucket; 0 where nothing is trusted."""
        return self._log(self.good, self.share, self.total) if self.total > BUCKETS else np.zeros(BUCKETS)

    @staticmethod
    def _log(good: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
        smooth = 0.1 * total
        return np.log((good + smooth * share) / (total + smooth)) - np.log(share)

    def score(self, at: np.ndarray) -> float:
        return float(self.ratio[at].sum() / (len(at) + PRIOR)) if len(at) else 0.0

    def left_out(self, at: np.ndarray) -> float:
        """What a counted row would score, were it not counted; without meaning for other rows."""
        if not len(at):
            return 0.0
        b, n = np.unique(at, return_counts=True)
        good, total = np.maximum(self.good[b] - n, 1), max(self.total - len(at), BUCKETS)
        return float((n * self._log(good, self.share[b], total)).sum() / (len(at) + PRIOR))


def labelled_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, good``: every id labelled good (quality 1) or bad (quality 0), once a label."""
    return labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).distinct()


def counted(rows: DataFrame, known: DataFrame) -> Model:
    """Both multinomials, over every row of (doc_id, text) and over every one that is labelled good."""
    ddl = "bucket int, raw bigint, good bigint"
    schema = arrow_of(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, waiting = WordHashes(), np.zeros((2, BUCKETS), np.int64), ([], [])

        def settle(most: int) -> None:
            for k in (0, 1):
                if sum(map(len, waiting[k])) > most:
                    sums[k] += np.bincount(np.concatenate(waiting[k]), minlength=BUCKETS)
                    waiting[k].clear()

        for b in batches:
            for t, g in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = (t.as_py() or "").encode().split()
                if words:
                    waiting[int(g)].append(ngram_buckets(known.of(words)).astype(np.int32))
                    if len(waiting[int(g)]) >= 256 or len(words) > 100_000:
                        settle(0)
        settle(0)
        good, raw = sums[1], sums.sum(axis=0)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(good[at])], schema=schema)

    # the ids are as many as the labels: both sides are shuffled, whatever the size; rows without an id are dealt by number
    one = F.coalesce("doc_id", F.monotonically_increasing_id())
    rows = rows.select(one.alias("key"), F.col("doc_id").isNull().alias("none"), "text")
    trusted = known.where("good").select(F.col("doc_id").alias("key"), F.lit(False).alias("none"), "good")
    both = rows.join(trusted.hint("shuffle_hash"), ["key", "none"], "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for k, r, g in both.mapInArrow(count, ddl).groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect():  # at most BUCKETS rows
        raw[k] += r
        good[k] += g
    return Model(good, raw / raw.sum())


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """Count both multinomials and set the threshold from what all labelled rows score; also the scores of all rows."""
    known = cut(labelled_ids(labels), "labelled")
    rows = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = counted(rows, known)
    scored = cut(score(rows, model), "scored")
    if model.total == BUCKETS:
        return model, scored
    seen = scored.where(~base_failed()).join(known.hint("merge"), "doc_id")
    seen = cut(seen.select("good", F.when(F.col("good"), F.col("left_out")).otherwise(F.col("score")).alias("score")), "tuning")
    return dataclasses.replace(model, threshold=least_score(seen)), scored


def nth(scores: DataFrame, n: int) -> float:
    """The n-th least ``score`` (the least: 0) of a table that has so many, exactly: the bin that holds it is dealt into ``BINS`` bins
    until it holds one value, so no task and no list holds more than bins."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        at = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        inside = scores.where(F.col("score").between(low, high)).groupBy(at.alias("bin"))
        for r in sorted(inside.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):  # at most BINS rows
            if n < r["n"]:
                low, high = r["low"], r["high"]
                break
            n -= r["n"]
    return float(low)


def quantile(scores: DataFrame, n: int, share: float) -> float:
    """Of ``n`` scores, linear between the two nearest ranks, as SQL's ``percentile``."""
    at = share * (n - 1)
    low = nth(scores, math.floor(at))
    return low if at == math.floor(at) else low + (at - math.floor(at)) * (nth(scores, math.floor(at) + 1) - low)


def least_score(known: DataFrame) -> float:
    """The threshold, from (good, score) of labelled rows that the rules pass, trusted ones as if not counted.

    It lies below all but ``TAIL`` of the good rows: halfway to the next bad row below that point, and no further down than
    the median lies above it, nor than ``MARGIN``.
    """
    good = known.where("good")
    n = good.count()
    if not n:
        return float("-inf")
    low, margin = quantile(good, n, TAIL), MARGIN
    if n >= SPREAD:
        margin = min(margin, quantile(good, n, 0.5) - low)
    if n >= FEW:
        below = known.where(~F.col("good") & (F.col("score") < low)).agg(F.max("score")).first()[0]
        if below is not None:
            margin = min(margin, (low - float(below)) / 2)
    return low - margin


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the surface counts, ``score`` and ``left_out`` for every row of (doc_id, text)."""
    ddl = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, score double, left_out double"
    schema = arrow_of(ddl)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                raw = text.encode()
                words = raw.split()
                hashes = known.of(words)
                at = ngram_buckets(hashes)
                out.append((len(words), *surface(text, raw, words, hashes), held.value.score(at), held.value.left_out(at)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema
            )

    return rows.mapInArrow(run, ddl)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``kept``, ``score`` for every document."""
    model, scored = fit(docs, labels)
    out = scored.drop("left_out").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept; all columns stay. Equal (doc_id, text) rows have equal verdicts; null and blank texts go; an
    empty table gives no rows."""
    model, _ = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            keep = []
            for t in b.column(b.schema.get_field_index("text")):
                words = (t.as_py() or "").encode().split()
                hashes = known.of(words)
                bad = len(words) < 10 or 100 * repeated_words(hashes) > 20 * len(words)
                keep.append(not bad and held.value.score(ngram_buckets(hashes)) >= held.value.threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op4(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return verdicts(docs, labels)
