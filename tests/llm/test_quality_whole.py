"""What op4 fits comes from all labelled rows, whatever their number."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.llm import quality

MANY = 20_500  # more than the 20,000 rows that were once the most


def test_every_trusted_row_is_counted_and_scored(spark):
    d = spark.range(MANY).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)) for k in range(12)]).alias("text"))
    more = spark.createDataFrame([(MANY, "a b c"), (None, "d e f"), (None, None), (3, "one two three"), (-1, "x y z")], "doc_id long, text string")
    labels = d.select("doc_id", F.lit(1).alias("quality")).unionByName(spark.createDataFrame([(None, 1), (3, 1), (MANY, 0), (MANY + 9, 1)], "doc_id long, quality int"))
    model, scored = quality.fit(d.unionByName(more), labels)
    # 12 words and 11 pairs a row; row 3 is there a second time, with 3 words and 2 pairs
    assert model.good.sum() - quality.BUCKETS == MANY * 23 + 5
    assert scored.count() == MANY + 5
    kept = quality.verdicts(d.unionByName(more), labels)
    assert kept.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    low = np.array([r[0] for r in scored.where(f"doc_id < {MANY} AND doc_id >= 0 AND n_words = 12").where(~quality.base_failed()).select("left_out").collect()])
    tail, half = np.quantile(low, quality.TAIL), np.quantile(low, 0.5)
    assert model.threshold == pytest.approx(tail - min(quality.MARGIN, half - tail), abs=1e-9)


def test_left_out_is_the_score_without_the_label(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(rng.choices(words, k=30))) for k in range(25)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    fit = lambda ids: quality.fit(d, spark.createDataFrame([(k, 1) for k in ids], "doc_id long, quality int"))[1]
    whole = {r.doc_id: r.left_out for r in fit(range(25)).collect()}
    for k in (0, 7, 24):
        without = {r.doc_id: r.score for r in fit([i for i in range(25) if i != k]).collect()}
        assert whole[k] == pytest.approx(without[k], abs=1e-12)


@pytest.mark.parametrize("parts", [1, 3])
def test_ranks_are_exact(spark, monkeypatch, parts):
    monkeypatch.setattr(quality, "BINS", 3)
    rng = random.Random(parts)
    for values in ([0.5], [0.25] * 9, [-1e-300, 0.0, 1e300], [rng.choice([rng.gauss(0, 1), 0.125]) for _ in range(300)]):
        rows = spark.createDataFrame([(v,) for v in values], "score double").repartition(parts)
        for n in {0, len(values) // 3, len(values) - 1}:
            assert quality.nth(rows, n) == sorted(values)[n]
        assert math.isclose(quality.quantile(rows, len(values), 0.001), rows.agg(F.percentile("score", 0.001)).first()[0], abs_tol=1e-12)


def test_scores_do_not_depend_on_parts(spark):
    rng = random.Random(1)
    rows = [(k % 90 if k % 10 else None, " ".join(rng.choices("abcdefghijklmnop", k=25))) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60)], "doc_id long, quality int")
    got = []
    for parts in (1, 5):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got.append(sorted(((r.doc_id or -1, r.score, r.kept) for r in quality.verdicts(d, labels).collect())))
    assert got[0] == got[1] and not re.search("nan", str(got))
