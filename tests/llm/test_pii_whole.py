"""What op3 learns and calibrates comes from all documents, whatever their number."""

import random

import pytest
from pyspark.sql import functions as F

from notegraph.llm import pii

MANY = 10_400  # more than the 10,000 rows a label that were once the most


def test_every_row_is_learned_from(spark):
    n = F.col("id")
    candidate = lambda t, covered: spark.range(MANY).select(F.lit(1).alias("kind"), t.alias("t"), F.concat(F.lit("so "), n.cast("string"), F.lit(" is ")).alias("before"), F.lit(" x").alias("after"), covered.alias("meets"), covered.alias("covered"))
    sure = candidate(F.lit("10.2.3.4"), F.lit(True))
    other = candidate(F.concat(F.lit("7.8."), n.cast("string")), F.lit(False))
    rows = pii.training_rows(sure.unionByName(other).unionByName(sure.limit(9)))
    got = {(r.made, r.label): r["count"] for r in rows.groupBy("made", "label").count().collect()}
    assert got[(False, 0)] == got[(False, 1)] == MANY and got[(True, 0)] > 1000 < got[(True, 1)]


def loop(rows, weights):
    """The calibration as a loop over one kind's (m, label, made, docs)."""
    zeros = sum(made + weights[0] * docs for _, y, made, docs in rows if y == 0)
    ones = wrong = 0.0
    best, scores = float("inf"), sorted({r[0] for r in rows}, reverse=True)
    for m, after in zip(scores, [*scores[1:], scores[-1]], strict=True):
        here = [(y, made + weights[y] * docs) for at, y, made, docs in rows if at == m]
        ones, wrong = ones + sum(w for y, w in here if y), wrong + sum(w for y, w in here if not y)
        if any(y for y, _ in here) and wrong <= pii.ALLOWED * zeros and wrong <= pii.WRONG * (ones + wrong):
            best = (m + after) / 2
    return best


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_calibration_equals_a_loop(spark, monkeypatch, ranges):
    monkeypatch.setattr(pii, "RANGES", ranges)
    rng = random.Random(ranges)
    weights = {0: 0.25, 1: 0.5}
    rows = []
    for k in range(3):
        for _ in range(400):
            y = rng.random() < 0.4
            rows.append((k, round(rng.gauss(2.5 * y - k / 2, 0.8), 2), int(y), rng.randrange(2), 1 + rng.randrange(3)))
    rows += [(0, 9.0, 1, 1, 0), (2, -9.0, 0, 0, 4)]
    d = spark.createDataFrame(rows, "kind int, m double, label int, made long, docs long").repartition(3)
    want = {k: loop([r[1:] for r in rows if r[0] == k], weights) for k in range(3)} | {3: float("inf")}
    got = pii.calibrated(d, weights)
    assert got == pytest.approx(want) and min(want.values()) < float("inf")
    assert set(pii.calibrated(d.limit(0), weights).values()) == {float("inf")}


def test_bins_leave_no_split_to_a_sample():
    for n in (0, 1, 10_000, 10_001, 10_404, 10_405, 3_000_000):
        assert max(pii.bins(n) ** 2, 10_000) >= n
    assert pii.bins(10_000) == 32
