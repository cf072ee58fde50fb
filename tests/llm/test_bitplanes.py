"""Bit-plane clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from notegraph.llm import bitplanes

SCHEMA = "vec_id long, embedding array<float>, label int, planes string, ints string, cluster string, x int"


def plain(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(1024 * float(np.float32(c))) for c in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [r[1] for r in first[:k]]

    def assign():
        gaps = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for _, v in kept]
        return [(min(range(len(g)), key=lambda c: (g[c], c)), min(g)) for g in gaps]

    for _ in range(rounds):
        label = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (x, _) in zip(kept, label, strict=True) if x == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    label = assign()
    total = sum(d for _, d in label)
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, sum(e for x, e in label if x == c), total, told[c]) for (i, _), (c, d) in zip(kept, label, strict=True)]


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "p", "i", "c", 0) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in bitplanes.op12(spark, table.repartition(3)).collect()), key=str)


def made(n, seed, width=1.0):
    r = random.Random(seed)
    return [(k, [r.uniform(-width, width) for _ in range(64)]) for k in range(n)]


def test_awkward_rows(spark):
    rows = made(120, 1)
    rows += [(200 + k, rows[3][1]) for k in range(60)]  # a third are copies
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65)]
    rows += [(304, [None] + [0.5] * 63), (305, [math.nan] + [0.5] * 63), (306, [math.inf] + [0.5] * 63), (307, [0.0] * 64), (308, [-0.0] * 64), (309, [-1e-9] * 64)]
    rows += [(310, [1.0] * 64), (311, [-1.0] * 64), (312, [700.25] * 64), (313, [-700.25, 700.25] * 32)]
    assert run(spark, rows) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("rows", [[], made(1, 2), made(5, 3), [(k, [0.25] * 64) for k in range(20)], [(1, None)]])
def test_few_rows(spark, rows):
    """Empty tables, fewer rows than centroids, and empty clusters."""
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_products_by_planes():
    r = np.random.default_rng(4)
    for places in (1, 2, 12, 28):
        top = 1 << (places - 1)
        x, y = (r.integers(-top, top, (50, 64)) for _ in range(2))
        x[0], x[1] = -top, top - 1
        px, py = bitplanes.planes_of(x, places), bitplanes.planes_of(y, places)
        assert (bitplanes.products(px, py) == x @ y.T).all()
        assert (bitplanes.norms(px) == (x * x).sum(1)).all()
        assert (bitplanes.sums(px) == x.sum(0)).all()


def test_too_large_is_an_error(spark):
    with pytest.raises(ValueError, match="binary places"):
        run(spark, [(1, [3e5] * 64)])
