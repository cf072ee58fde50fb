"""Hierarchical density clustering against a tree built by hand, copies and equal distances included."""

import numpy as np
import pytest

from notegraph.operators import tree as T


def reachability(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, k]
    return np.round(np.maximum(d, np.maximum(core[:, None], core[None])), 9)


def spanning(m):
    n = len(m)
    best, frm, out = m[0].copy(), np.zeros(n, int), []
    done = np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, best).argmin())
        out.append((float(best[j]), int(frm[j]), j))
        done[j] = True
        nearer = ~done & (m[j] < best)
        best[nearer], frm[nearer] = m[j][nearer], j
    return out


def parts(rows, edges):
    near = {r: [] for r in rows}
    for _, a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, out = set(), []
    for r in rows:
        if r not in seen:
            group, todo = [], [r]
            seen.add(r)
            while todo:
                group.append(todo.pop())
                for q in near[group[-1]]:
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
            out.append(set(group))
    return out


def best(rows, edges, least, birth=0.0, root=False):
    """(stability, chosen groups) of a cluster from the top down: at each level all edges of that length go at once.

    The root is never chosen itself.
    """
    all_, own = set(rows), 0.0
    while edges:
        top = max(e[0] for e in edges)
        rate = 1 / max(top, T.TINY)
        edges = [e for e in edges if e[0] < top]
        large = [p for p in parts(rows, edges) if len(p) >= least]
        if len(large) == 1:
            own += (len(rows) - len(large[0])) * (rate - birth)
            rows, edges = large[0], [e for e in edges if e[1] in large[0]]
            continue
        own += len(rows) * (rate - birth)
        below = [best(p, [e for e in edges if e[1] in p], least, rate) for p in large]
        kids = sum(b[0] for b in below)
        return (kids, [g for b in below for g in b[1]]) if root or kids > own else (own, [all_])
    return own, [] if root else [all_]


def expected(x, least, k):
    groups = best(set(range(len(x))), spanning(reachability(x, k)), least, root=True)[1]
    label = {}
    for j, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))):
        label |= dict.fromkeys(g, j)
    return {i: label.get(i, -1) for i in range(len(x))}


def run(spark, x, least, samples, **more):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>").repartition(3)
    return {r.id: r.label for r in T.density_tree(rows, least, samples, **more).collect()}


def blobs(seed, sizes, dims=3, noise=40):
    r = np.random.default_rng(seed)
    made = [r.normal(r.normal(0, 4, dims), r.uniform(0.05, 0.9), (n, dims)) for n in sizes]
    return np.concatenate([*made, r.uniform(-8, 8, (noise, dims))])


def test_blobs_of_several_densities(spark):
    x = blobs(1, [60, 40, 30, 25, 80])
    got = run(spark, x, 8, 5)
    assert got == expected(x, 8, 4)
    assert len(set(got.values())) > 4


def test_bands(spark):
    """The tree in many bands is the tree in one."""
    x = blobs(2, [50, 45, 30])
    assert run(spark, x, 6, 4, band=40) == expected(x, 6, 3)


def test_copies_and_equal_distances(spark):
    """A grid has nothing but ties; copies weigh; a third of all rows are one vector."""
    grid = np.array([[a, b, 0.0] for a in range(7) for b in range(7)])
    x = np.concatenate([grid, grid + [20, 0, 0], np.full((60, 3), 9.0), [[9.0, 9.0, 9.5]] * 3, [[40.0, 40, 40]]])
    assert run(spark, x, 5, 3) == expected(x, 5, 2)


def test_few_rows(spark):
    for n in (0, 1, 3, 6):
        assert set(run(spark, np.eye(3)[np.arange(n) % 3] if n else np.empty((0, 3)), 5, 3).values()) <= {-1}


def test_two_thousand_rows(spark):
    x = blobs(3, [300, 250, 200, 200, 150, 150, 120, 100], dims=8, noise=530)
    assert run(spark, x, 15, 10) == expected(x, 15, 9)


@pytest.mark.parametrize("seed", [5, 6])
def test_spanning_tree_weight(spark, seed, monkeypatch):
    """The edges found hold a tree as light as the smallest, with cells of a few rows."""
    x = blobs(seed, [40, 40], noise=60)
    from notegraph.operators.density import cores

    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    same, near, core = cores(rows, 3, 0)
    got = sorted((r.w, r.a, r.b) for r in T.spanning_edges(core, near, same.select("id", "vec"), cell=16).collect())
    up = list(range(len(x)))

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    total = 0.0
    for w, a, b in got:
        if find(a) != find(b):
            up[find(a)] = find(b)
            total += w
    assert len({find(p) for p in range(len(x))}) == 1
    assert total == pytest.approx(sum(e[0] for e in spanning(reachability(x, 3))))


def test_rows_are_not_copied_for_every_cell(spark):
    from notegraph import session
    from notegraph.operators import density as D

    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(60, 8)) + 40 * np.eye(8)[g] for g in range(6)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    app = spark.sparkContext.applicationId
    before = set(session._written.get(app, []))
    got = D.neighbours(rows, 3, cell=6).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(got.sort_values(["a", "dist"])["dist"].to_numpy().reshape(360, 3), np.sort(d, axis=1)[:, 1:4])
    _, near, core = D.cores(rows, 2)
    edges = T.spanning_edges(core, near, rows, cell=6).toPandas()
    m = reachability(x, 2)
    assert np.allclose(m[edges["a"], edges["b"]], edges["w"])
    assert edges["w"].sum() == pytest.approx(sum(e[0] for e in spanning(m)))
    # the listed edges, both ways, are the largest table: no row stands in a table once for each cell that it is compared with
    written = [p for p in session._written[app] if p not in before]
    assert max(spark.read.parquet(p).count() for p in written) <= 4 * 360
