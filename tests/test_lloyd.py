"""Many k-means fits in one job, and what is built on them, against plain loops over the whole query results."""

import struct
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notegraph.operators import cluster as C
from notegraph.operators import lloyd
from notegraph.operators import quality as Q
from notegraph.plans import vector_queries as V


def place(i):
    h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return h - (1 << 64) if h >> 63 else h, i


def unit(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def plain(ids, x, k, dims, seed=42, rounds=20):
    order = sorted(range(len(ids)), key=lambda j: place(ids[j]))[: lloyd.SAMPLE]
    c = lloyd.starts(x[order], lloyd.Setting(k, dims, seed))
    x = unit(x[:, :dims]) if dims else x

    def label():
        return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)

    for _ in range(rounds):
        near = label()
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        moved = np.linalg.norm(new - c, axis=1).max()
        c = new
        if moved <= 1e-4:
            break
    return label()


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = sorted((r.id, r.vec, r.label) for r in V.vecs(spark, sf).collect())
    return [r[0] for r in rows], np.array([r[1] for r in rows]), [r[2] for r in rows]


def test_all_fits_are_what_each_is_alone(spark, vectors):
    ids, x, groups = vectors
    groups = [g if i % 11 else None for i, g in zip(ids, groups, strict=True)]
    rows = spark.createDataFrame([(i, g, v.tolist()) for i, g, v in zip(ids, groups, x, strict=True)], "id long, grp int, vec array<double>").repartition(5)
    settings = [lloyd.Setting(k, d, seed) for k in (2, 5) for d in (8, None) for seed in (1, 2)]
    labels, _ = lloyd.fit(rows, settings, least=5)
    got = {r.id: r.labels for r in labels.collect()}
    for g in set(groups) - {None}:
        own = [j for j in range(len(ids)) if groups[j] == g]
        for s, setting in enumerate(settings):
            want = plain([ids[j] for j in own], x[own], setting.k, setting.dims, setting.seed)
            assert [got[ids[j]][s] for j in own] == want.tolist()
    assert len(got) == sum(g is not None for g in groups)


def test_equal_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(9)] + [(20, 1, [0.0, 1.0])], "id long, grp int, vec array<double>")
    labels, _ = lloyd.fit(rows, [lloyd.Setting(3)], least=2)
    assert {(r.id, r.labels[0]) for r in labels.collect()} == {(i, 0) for i in range(9)}
    assert lloyd.fit(rows.limit(0), [lloyd.Setting(3)])[0].count() == 0


def nested(spark):
    """Eight groups of 12, in three levels of two."""
    r = np.random.default_rng(1)
    rows = []
    for g in range(8):
        at = np.array([8.0 * (g >> 2), 2.0 * (g >> 1 & 1), 0.5 * (g & 1), 0.0])
        rows += [(g * 100 + k, (at + 0.01 * r.normal(size=4)).tolist()) for k in range(12)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


@pytest.mark.parametrize("last", [{"k": 2}, {"min_size": 4, "min_samples": 3}])
def test_three_levels_keep_unrelated_clusters_apart(spark, monkeypatch, last):
    monkeypatch.setattr(C, "truncated", lambda v, d: v)
    passes = [C.Pass("c", None, parent="b", **last), C.Pass("a", None, 2), C.Pass("b", None, 2, "a")]
    got = C.cluster_dag(nested(spark), passes)
    groups = defaultdict(set)
    for r in got.where("pass_id = 'c'").collect():
        groups[r.label].add(r.id)
        assert r.label.startswith(f"{r.parent_label}_")
    assert sorted(map(sorted, groups.values())) == [[g * 100 + k for k in range(12)] for g in range(8)]
    stats = {r.pass_id: (r.rows, r.clusters, r.least, r.most) for r in C.dag_stats(got).collect()}
    assert stats == {"a": (96, 2, 48, 48), "b": (96, 4, 24, 24), "c": (96, 8, 12, 12)}


def test_pass_needs_one_algorithm():
    for bad in ({}, {"k": 2, "min_size": 3}):
        with pytest.raises(ValueError):
            C.Pass("a", 8, **bad)


def test_dag_query(spark, sf, vectors):
    """The whole result of the query, pass by pass."""
    ids, x, _ = vectors
    x = np.array([r for r in x])
    want = set()

    def divide(own, p, full):
        for j, label in zip(own, plain([ids[j] for j in own], x[own], p.k, p.dims), strict=True):
            want.add((p.id, ids[j], f"{full}{label}"))

    by = {p.id: p for p in V.DAGS}
    divide(list(range(len(ids))), by["areas"], "")
    for child, parent in (("fine", "areas"), ("points", "fine")):
        groups = defaultdict(list)
        for pass_id, i, label in sorted(want):
            if pass_id == parent:
                groups[label].append(ids.index(i))
        for label, own in groups.items():
            if len(own) >= by[child].least:
                divide(own, by[child], f"{label}_")
    assert {tuple(r) for r in V.dag(spark, sf).collect()} == want


def rand(a, b):
    two = lambda n: n * (n - 1) / 2
    cells, ca, cb = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, q in zip(a, b, strict=True):
        cells[p, q] += 1
        ca[p] += 1
        cb[q] += 1
    idx, sa, sb = (sum(map(two, c.values())) for c in (cells, ca, cb))
    if two(len(a)) == 0:
        return 1.0
    expected, top = sa * sb / two(len(a)), (sa + sb) / 2
    return 1.0 if top == expected else (idx - expected) / (top - expected)


def silhouette(x, label):
    d = 1 - x @ x.T
    out = []
    for i in range(len(x)):
        own = label == label[i]
        others = [d[i, label == c].mean() for c in set(label) - {label[i]}]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = d[i, own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_within_hub_grid_query(spark, sf, vectors):
    ids, x, groups = vectors
    got = {(r.grp, r.dims, r.k): (r.n, r.ari, r.silhouette) for r in V.QUERIES["within_hub_grid"][0](spark, sf).collect()}
    assert len(got) == len(set(groups)) * 4
    for (g, dims, k), (n, ari, sil) in got.items():
        own = [j for j in range(len(ids)) if groups[j] == g]
        runs = [plain([ids[j] for j in own], x[own], k, dims, seed) for seed in range(3)]
        assert n == len(own)
        if n < 2 * k:
            assert (ari, sil) == (0.0, 0.0)
            continue
        assert ari == pytest.approx(np.mean([rand(runs[a], runs[b]) for a, b in combinations(range(3), 2)]), abs=2e-6)
        assert sil == pytest.approx(silhouette(unit(x[own][:, :dims]), runs[0]), abs=2e-6)


def test_groups_too_small_for_k_score_nothing(spark):
    rows = spark.createDataFrame([(i, 1, [float(i % 3 == c) for c in range(3)]) for i in range(7)], "id long, grp int, vec array<double>")
    got = {r.k: (r.n, r.ari, r.silhouette) for r in Q.stability_grid(rows, [3], [2, 4]).collect()}
    assert got[4] == (7, 0.0, 0.0) and got[2][1] >= 0.0


def test_grid_titles(spark, sf, vectors):
    got = V.QUERIES["kmeans_grid_titles"][0](spark, sf).collect()
    names = {r.doc_id: (r.text or "")[:40] for r in V.table(spark, sf, "documents").select("doc_id", "text").collect()}
    ids, x, _ = vectors
    assert len(got) == 2 * (4 + 8)
    for r in got:
        own = [i for i, label in zip(ids, plain(ids, x, r.k, r.dims), strict=True) if label == r.label]
        assert r.n == len(own)
        assert r.names == (",".join(names[i] for i in sorted(own)[:8] if i in names) or None)
