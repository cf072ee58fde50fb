"""Graph, search, ranking, tables, sources and streams on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegraph.operators import cluster as C
from notegraph.operators import browse as B
from notegraph.operators import embed as M
from notegraph.operators import explorer as X
from notegraph.operators import graph as G
from notegraph.operators import quality as Q
from notegraph.operators import search as S
from notegraph.operators import tables as T
from notegraph.operators import tasks as K
from notegraph.sources import notes as N
from notegraph.streaming import changes as W
from notegraph.streaming import cycle as Y


def test_traverse_cycle_and_diamond(spark):
    links = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("c", "a", "k"), ("a", "d", "k"), ("d", "e", "k"), ("b", "e", "k"), ("e", "f", "other")], "from_id string, to_id string, kind string")
    got = {(r.id, r.depth) for r in G.traverse(links, spark.createDataFrame([("a",)], "id string"), 3, ["k"]).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 1), ("e", 2)}


def test_hub_scores(spark):
    blocks = spark.createDataFrame([("d1", G.DOC, "D1"), ("d2", G.DOC, "D2"), ("s1", G.SEG, "s"), ("s2", G.SEG, "s")], "id string, kind string, title string")
    links = spark.createDataFrame([("s1", "d1", "contains"), ("s2", "d2", "contains"), ("s2", "d1", "links_to")], "from_id string, to_id string, kind string")
    links = links.unionByName(spark.createDataFrame([("d2", "t1", "about"), ("d2", "d1", "mentions"), ("s1", "d1", "groups")], links.schema))
    got = {r.id: (r.links_in, r.links_out, r.segments, r.score) for r in G.hub_scores(blocks, links).collect()}
    assert got == {"d1": (3, 0, 1, round(0.5 * np.log(4) + 0.2 * np.log(2), 6)), "d2": (0, 2, 1, round(0.3 * np.log(3) + 0.2 * np.log(2), 6))}


def test_tag_details(spark):
    blocks = spark.createDataFrame([("t1", G.TAG, "a", None), ("t2", G.TAG, "b", None), ("s1", G.SEG, "s", "2024-01-02"), ("s2", G.SEG, "s", "2024-03-01")], "id string, kind string, title string, block_time string")
    links = spark.createDataFrame([("s1", "t1", "groups"), ("s2", "t1", "groups"), ("d1", "t1", "about"), ("t1", "d1", "defines")], "from_id string, to_id string, kind string")
    got = {r.id: (r.segments, r.links_in, r.links_out, r.last_active, r.score) for r in G.tag_details(blocks, links).collect()}
    assert got == {"t1": (2, 1, 1, "2024-03-01", round(0.5 * np.log(4) + 0.3 * np.log(2) + 0.2 * np.log(3), 6)), "t2": (0, 0, 0, None, 0.0)}


def test_related_filters_and_deletes(spark):
    blocks = spark.createDataFrame([("a", "k", "A", "x", "1"), ("b", "k", "B", "y", "2"), ("c", "k", "C", "x", "2")], "id string, kind string, title string, source string, pass_id string")
    links = spark.createDataFrame([("a", "b", "p"), ("c", "a", "q"), ("c", "a", "p")], "from_id string, to_id string, kind string")
    start = spark.createDataFrame([("a",)], "id string")
    show = lambda **kw: {(r.id, r.link_kind, r.direction) for r in G.related(blocks, links, start, **kw).collect()}
    assert show() == {("b", "p", "outgoing"), ("c", "q", "incoming"), ("c", "p", "incoming")}
    assert show(kind="p", direction="incoming") == {("c", "p", "incoming")} and show(direction="outgoing") == {("b", "p", "outgoing")}
    kept, left = T.delete_where(blocks, links, source="x", pass_id="2")
    assert {r.id for r in kept.collect()} == {"a", "b"} and left.count() == 1
    with pytest.raises(ValueError):
        T.delete_where(blocks, links)


def test_knn_in_blocks(spark, monkeypatch):
    """Several blocks of queries, several batches, ties: the same as brute force."""
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 6))
    v = np.concatenate([v, v[:20]]) / np.linalg.norm(np.concatenate([v, v[:20]]), axis=1)[:, None]
    table = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id int, vec array<double>").repartition(3)
    got = {}
    for x in S.knn(table.where("id % 10 = 0").withColumnRenamed("id", "query_id"), table, 5).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.id
    for q, found in got.items():
        dist = np.round(np.sqrt(np.maximum(0, 2 - 2 * v @ v[q])), 6)
        assert [found[k] for k in range(1, 6)] == sorted(range(len(v)), key=lambda k: (dist[k], k))[:5]
    assert len(got) == 32


def test_orphans_and_cascade(spark):
    blocks = spark.createDataFrame([("s1", G.SEG), ("s2", G.SEG), ("t", G.TAG)], "id string, kind string")
    links = spark.createDataFrame([("s1", "t", "groups"), ("s2", "d", "contains")], "from_id string, to_id string, kind string")
    assert [r.id for r in G.orphans(blocks, links).collect()] == ["s2"]
    kept, left = T.delete_cascade(blocks, links, spark.createDataFrame([("t",)], "id string"))
    assert {r.id for r in kept.collect()} == {"s1", "s2"} and [r.kind for r in left.collect()] == ["contains"]


def test_phrase_search(spark):
    rows = spark.createDataFrame([(1, "Follow-up notes", "plan the follow up"), (2, "up follow", "nothing"), (3, "Café plans", "follow the sun, up")], "id int, title string, content string")
    found, lengths = S.postings(rows, ["title", "content"])
    q = spark.createDataFrame([("a", "follow-up"), ("b", "title: cafe plans"), ("c", "follow sun"), ("d", "- *"), ("e", "nothing up")], "query_id string, text string")
    got = {}
    for r in S.keyword_search(found, lengths, S.parse_queries(q)).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert got == {"a": {1}, "b": {3}, "c": {3}, "e": {2}}


def test_knn(spark):
    v = spark.createDataFrame([("e1", [1.0, 0.0, 0.0, 0.0]), ("e2", [0.9938837, 0.1104315, 0.0, 0.0]), ("e3", [0.0, 0.0, 1.0, 0.0])], "id string, vec array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, vec array<double>")
    assert [r.id for r in S.knn(q, v, 2).orderBy("rank").collect()] == ["e1", "e2"]


def test_rerank(spark):
    near = [np.cos(a) for a in (0.0, 0.1, 0.15)], [np.sin(a) for a in (0.0, 0.1, 0.15)]
    rows = [("q", [1.0, 0.0], k, f"n{k}", [float(near[0][k]), float(near[1][k])], 0.9) for k in range(3)] + [("q", [1.0, 0.0], 3, "far", [0.0, 1.0], 0.5), ("q", [1.0, 0.0], 4, "none", None, 0.4)]
    df = spark.createDataFrame(rows, "query_id string, qvec array<double>, pos long, id string, vec array<double>, score double")
    got = [r.id for r in S.rerank(df, 3).orderBy("rank").collect()]
    assert got[1:] == ["far", "none"] and got[0] in {"n0", "n1", "n2"}
    no = df.withColumn("vec", F.lit(None).cast("array<double>"))
    assert [r.id for r in S.rerank(no, 3).orderBy("rank").collect()] == ["n0", "n1", "n2"]
    angle = np.arccos(0.9)
    vecs = np.array([[1.0, 0.0], [np.cos(angle), np.sin(angle)]])
    assert list(S.near_groups(vecs, 0.05)) == [0, 1] and list(S.near_groups(vecs, 0.2)) == [0, 0]


def test_maps_merge_and_labels_replace(spark):
    rows = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", None)], "id string, metadata map<string,string>")
    up = spark.createDataFrame([("a", {"y": "3"}), ("b", {"z": "4"})], "id string, metadata map<string,string>")
    assert {r.id: r.metadata for r in T.merge_map(rows, up, "id", "metadata").collect()} == {"a": {"x": "1", "y": "3"}, "b": {"z": "4"}}
    b = spark.createDataFrame([("a", {"p": "9", "o": "1"}), ("b", {"p": "8"})], "id string, assignments map<string,string>")
    got = T.assign_labels(b, "p", spark.createDataFrame([("a", 5)], "id string, label int"))
    assert {r.id: r.assignments for r in got.collect()} == {"a": {"o": "1", "p": "5"}, "b": {}}


def test_incremental(spark):
    old = spark.createDataFrame([("f", "h1"), ("f", "h2"), ("g", "h3")], "source_path string, hash string")
    new = spark.createDataFrame([("f", "h1"), ("f", "h4"), ("h", "h5")], "source_path string, hash string")
    docs = lambda d: d.groupBy("source_path").agg(F.max("hash").alias("hash"))
    status = T.change_status(docs(new), docs(old))
    assert {r.source_path: r.status for r in status.collect()} == {"f": "changed", "g": "deleted", "h": "new"}
    diff = T.segment_diff(old, new, status.where("status <> 'unchanged'").select("source_path"))
    assert {(r.hash, r.status) for r in diff.collect()} == {("h1", "kept"), ("h2", "removed"), ("h4", "added"), ("h3", "removed"), ("h5", "added")}


def blobs(spark):
    r = np.random.default_rng(42)
    rows = [(f"{c}-{k}", [float(x) for x in np.eye(8)[c] + 0.05 * r.normal(size=8)], c) for c in range(3) for k in range(20)]
    return spark.createDataFrame(rows, "id string, vec array<double>, truth int")


def test_kmeans_finds_blobs(spark):
    v = blobs(spark)
    got = C.kmeans(v.select("id", "vec"), 3).join(v.select("id", "truth"), "id")
    assert Q.adjusted_rand(got.select(F.col("label").alias("la"), F.col("truth").alias("lb"))).first().ari == 1.0
    assert C.pass_stats(got).first().clusters == 3


def test_pass_order():
    a, b = C.Pass("a", 8, 2), C.Pass("b", 8, 2, "a")
    assert C.ordered([b, a]) == [a, b]
    for bad in ([C.Pass("a", 8, 2, "z")], [a, a], [C.Pass("a", 8, 2, "b"), b]):
        with pytest.raises(ValueError):
            C.ordered(bad)


def test_similarity_gap_equals_pairs(spark):
    v = blobs(spark)
    m = {r.id: (np.array(r.vec), r.truth) for r in v.collect()}
    unit = v.select("id", F.expr("transform(vec, x -> x / sqrt(aggregate(vec, 0D, (s, y) -> s + y * y)))").alias("vec"), F.col("truth").alias("label"))
    ids = sorted(m)
    u = {i: x / np.linalg.norm(x) for i, (x, _) in m.items()}
    same = [u[a] @ u[b] for a in ids for b in ids if a < b and m[a][1] == m[b][1]]
    other = [u[a] @ u[b] for a in ids for b in ids if a < b and m[a][1] != m[b][1]]
    got = Q.similarity_gap(unit).first()
    assert got.within_mean == pytest.approx(np.mean(same), abs=1e-5) and got.between_mean == pytest.approx(np.mean(other), abs=1e-5)


def test_loops(spark):
    rows = [("a", "t", "2024-01-01", [1.0, 0.0]), ("b", "t", "2024-07-19", [1.0, 0.0]), ("c", "t", "2024-01-11", [1.0, 0.0]), ("d", "t", "2024-11-01", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, topic string, day string, vec array<double>").withColumn("day", F.to_date("day"))
    assert {(r.a, r.b) for r in Q.idea_loops(df, 0.9, 180).collect()} == {("a", "b"), ("c", "b")}


def test_embedding_failures_are_kept(spark):
    class Picky(M.HashingModel):
        def embed_texts(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return super().embed_texts(texts)

    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, ""), (4, None)], "id int, text string")
    got = {r.block_id: (r.vec is not None, r.error) for r in M.embed(df, Picky).collect()}
    assert got == {1: (True, None), 2: (False, "bad text")}


def test_tasks_and_streams(spark):
    text = "---\nstream: My Work\nstatus: active\nlast_active: 2024-01-01\n---\n\n## Context\n\nctx\n\n## LEFT OFF\nhere\n\n## Log\n- a\n"
    s = K.parse_streams(spark.createDataFrame([("p", text)], "path string, content string"))
    r = s.first()
    assert (r.stream, r.status, r.context, r.left_off, r.log) == ("My Work", "active", "ctx", "here", "- a")
    found = K.find_streams(s, spark.createDataFrame([("my-work",), ("My Work!",), ("MY WORK",), ("other",)], "name string"))
    assert {x.name for x in found.collect()} == {"my-work", "My Work!", "MY WORK"}
    ev = spark.createDataFrame([("s", 1, "l1", None, "active", "x", "A"), ("s", 2, None, "c", None, "y", "B"), ("s", 3, "l3", None, None, None, "A")], "slug string, seq int, left_off string, context string, status string, log string, session string")
    assert tuple(K.fold_streams(ev).first()) == ("s", "l3", "c", "active", "x\ny", "A,B")


def test_note_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "sub/a b.md").write_bytes("# A\r\nx é".encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_text("no note")
    (tmp_path / ".trash/d.md").write_text("gone")
    got = {r.path: r.content for r in N.scan_notes(spark, str(tmp_path)).collect()}
    assert got == {"sub/a b.md": "# A\nx é"}


def test_exports(spark, tmp_path):
    seg = spark.createDataFrame([("p.md", "H", "text")], "path string, section_heading string, content string")
    N.export_ndjson(seg, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().content == "text"
    N.export_markdown(seg, str(tmp_path / "m"))
    assert "## H (p.md)" in [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]


def test_density_finds_blobs_and_noise(spark):
    from notegraph.operators import density as D

    v = blobs(spark).select("id", "vec").unionByName(spark.createDataFrame([("far", [9.0] * 8), ("lone", [-9.0] * 8)], "id string, vec array<double>"))
    got = {r.id: r.label for r in D.density(v, 5, 4, reach=0.5).collect()}
    assert got["far"] == got["lone"] == -1
    for c in range(3):
        assert len({got[f"{c}-{k}"] for k in range(20)}) == 1
    assert {x for x in got.values() if x >= 0} == {0, 1, 2}


def test_neighbours_are_exact_between_parts(spark):
    """Against all distances: cells of several parts, more copies of a vector than k, numbers that are far apart."""
    from notegraph.operators import density as D

    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(c * 5, 1, (60, 3)) for c in range(4)] + [np.ones((45, 3))])
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(m)], "id long, vec array<double>").repartition(3)
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for cell in (20, 1024):
        got = D.neighbours(rows, 4, cell=cell).toPandas()
        assert (got.groupby("a").size() == 4).all() and got["a"].nunique() == len(m)
        for a, g in got.groupby("a"):
            assert np.sort(g["dist"]) == pytest.approx(np.sort(d[a])[:4], abs=1e-5)
            assert list(g["dist"]) == pytest.approx([d[a, b] for b in g["b"]], abs=1e-5)
    assert D.neighbours(rows.limit(2), 4).count() == 2 and D.neighbours(rows.limit(0), 4).count() == 0


def test_density_weighs_copies(spark):
    from notegraph.operators import density as D

    rows = [(f"x{i}", [0.0, 0.0]) for i in range(6)] + [(f"y{i}", [5.0, i / 10]) for i in range(5)] + [("z", [9.0, 9.0])]
    v = spark.createDataFrame(rows, "id string, vec array<double>")
    got = {r.id: r.label for r in D.density(v, 5, 4, reach=0.5).collect()}
    assert {got[f"x{i}"] for i in range(6)} == {0} and {got[f"y{i}"] for i in range(5)} == {1} and got["z"] == -1
    free = {r.id: r.label for r in D.density(v, 5, 4, quantile=0.9).collect()}
    assert len({free[f"x{i}"] for i in range(6)}) == 1 and free["x0"] >= 0


def test_loops_between_parts(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(90, 4))
    m /= np.linalg.norm(m, axis=1)[:, None]
    rows = [(i, None if i == 7 else "t" if i % 3 else "u", None if i == 8 else f"2024-0{1 + i % 9}-11", None if i == 10 else m[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, topic string, day string, vec array<double>")
    ok = [i for i in range(90) if i not in (7, 8, 10)]
    want = {(a, b) for a in ok for b in ok if (a % 3 > 0) == (b % 3 > 0) and b % 9 - a % 9 >= 1 and m[a] @ m[b] >= 0.5}
    for part in (11, 1024):
        got = [(r.a, r.b) for r in Q.idea_loops(df, 0.5, 20, part).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pages(spark):
    rows = [(i, "k", f"2024-01-{i:02d}", ["a"] if i % 2 else None, ["b"] if i == 4 else None) for i in range(1, 8)]
    blocks = spark.createDataFrame(rows, "id int, kind string, block_time string, tags array<string>, given_tags array<string>")
    got, info = B.browse_page(blocks, 3, 1, kind="k")
    assert [r.id for r in got.collect()] == [6, 5, 4] and tuple(info.first()) == (3, 7, True, 4)
    got, info = B.browse_page(blocks, 3, 4)
    assert [r.id for r in got.collect()] == [3, 2, 1] and tuple(info.first()) == (3, 7, False, None)
    got, info = B.browse_page(blocks, 3, 0, ["b"])
    assert [r.id for r in got.collect()] == [4] and tuple(info.first()) == (1, 7, False, None)
    got, info = B.browse_page(blocks, 3, kind="none")
    assert got.collect() == [] and tuple(info.first()) == (0, 0, False, None)
    assert [r.id for r in B.recent(blocks, 2, ["a", "b"]).collect()] == [7, 5]


def test_open_notes(spark):
    blocks = spark.createDataFrame(
        [("d2", G.DOC, "Plan", None, None), ("d1", G.DOC, "Plan", None, None), ("d3", G.DOC, "Garden plan", None, None), ("s1", G.SEG, "x", "text", "2024"), ("s2", G.SEG, "roses", "garden", None)],
        "id string, kind string, title string, content string, block_time string",
    )
    links = spark.createDataFrame([("s1", "d1", "contains"), ("s2", "d3", "contains"), ("d3", "d1", "links_to"), ("s1", "d3", "links_to")], "from_id string, to_id string, kind string")
    found, entries = G.open_notes(blocks, links, spark.createDataFrame([("Plan",), ("garden",), ("nothing",), (None,), ("Plan",), ("?!",)], "title string"))
    assert {r.wanted: tuple(r)[1:] for r in found.collect()} == {
        "Plan": ("d1", "Plan", True, 1, 2, 0), "garden": ("d3", "Garden plan", True, 1, 2, 1), "nothing": (None, None, False, 0, 0, 0), "?!": (None, None, False, 0, 0, 0),
    }
    assert {(r.wanted, r.id, r.content) for r in entries.collect()} == {("Plan", "s1", "text"), ("garden", "s2", "garden")}


def test_explorer(spark):
    rows = [("a", "data_block", None, "x", "in/n.md", "2024-05-06"), ("b", "data_block", "T", None, None, "no day at all"), ("c", "data_block", "", "x", "", None), ("d", "data_block", "T", "x", "inside/n.md", None)]
    rows += [("e", "data_block", "T", "x", "/in/deep/n.md", None), ("f", "context_block:document", None, "whole", "in/n.md", None)]
    blocks = spark.createDataFrame(rows, "id string, kind string, title string, content string, source_path string, block_time string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0, float(k)]) for k, i in enumerate("abcdef")], "id string, vec array<double>")
    shown = X.data_blocks(blocks, vectors, ["in"])
    assert {r.id: (r.title, r.content, r.source_path) for r in shown.collect()} == {"a": ("", "x", "in/n.md"), "b": ("T", "", "T"), "c": ("", "x", "c"), "e": ("T", "x", "/in/deep/n.md")}
    assert {r.id for r in X.data_blocks(blocks, vectors).collect()} == set("abcde")
    labels = spark.createDataFrame([("p", "a", "1"), ("q", "a", "1_2")], "pass_id string, id string, label string")
    got = {r.id: r for r in X.payload(shown, blocks, labels).collect()}
    assert got["a"].cluster_assignments == {"p": "1", "q": "1_2"} and got["b"].cluster_assignments == {}
    assert (got["a"].date, got["b"].date, got["a"].source_content, got["b"].source_content) == ("2024-05", None, "whole", "")


def test_fine_grid(spark):
    rng = np.random.default_rng(1)
    points = [(int(i), (np.eye(4)[i % 2] + 0.01 * rng.standard_normal(4)).tolist()) for i in range(20)]
    vectors = spark.createDataFrame([*points, (99, [0.0, 0.0, 1.0, 0.0])], "id bigint, vec array<double>")
    parents = spark.createDataFrame([(i, 7) for i, _ in points] + [(99, 8)], "id bigint, label int")
    got = X.fine_grid(vectors, parents, 7, [4], [5, 50], [2, 20]).collect()
    assert {(r.method, r.setting) for r in got} == {("density", 5), ("kmeans", 2)}, "settings that want more rows are left out"
    assert sorted(r.n for r in got if r.method == "kmeans") == [10, 10] and {r.pct for r in got if r.method == "kmeans"} == {50.0}
    assert sum(r.n for r in got if r.method == "density") == 20


def test_compiled_pages(spark):
    rows = [(1, "index", None, "old"), (2, "index", None, "new"), (3, "hub_summary", "tag:a/b!", "hub"), (4, "concept", None, None), (5, "other", "x", "y"), (6, None, "x", "y"), (7, "concept", "tag:?", "z")]
    got = N.compiled_pages(spark.createDataFrame(rows, "id int, context_type string, scope string, content string"))
    assert {tuple(r) for r in got.collect()} == {("INDEX.md", "new"), ("hubs/a-b.md", "hub"), ("concepts/unknown.md", ""), ("concepts/unnamed.md", "z")}


def test_stream_context(spark):
    files = [("s/my-work.md", "---\nstream: My Work\nlinked_sessions: [s1, s2]\n---\n## Context\nc\n"), ("s/bare.md", "## Log\n- a\n")]
    wanted = spark.createDataFrame([("my-work",), ("MY WORK",), ("bare",), ("none",)], "name string")
    got = {r.name: r for r in K.stream_context(spark.createDataFrame(files, "path string, content string"), wanted).collect()}
    assert got["my-work"].linked_sessions == ["s1", "s2"] and got["MY WORK"].context == "c" and got["my-work"].status == "active"
    assert (got["bare"].found, got["bare"].stream, got["bare"].last_active, got["bare"].log, got["bare"].linked_sessions) == (True, "bare", "", "- a", [])
    assert got["none"].found is False and got["none"].slug is None


def stream_of(spark, folder, batches, schema):
    """A stream that takes the given lists of rows one a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_settle(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [("a", at(0), "pending"), ("b", at(0), "pending"), ("c", at(0), "active"), ("d", at(0), "pending")],
        [("a", at(20), "pending"), ("b", at(40), "active"), ("d", at(10), "active")],
        [("a", at(200), "pending"), ("z", at(3000), "active")],
        [("z", at(3500), "active"), ("late", at(3490), "pending")],
    ]
    rows = stream_of(spark, str(tmp_path / "in"), batches, "path string, event_ts string, status string").withColumn("event_ts", F.to_timestamp("event_ts"))
    got = W.run_available(W.settle(rows, 30), "settle").collect()
    assert sorted((r.path, r.fire_at.strftime("%M:%S")) for r in got) == [("a", "00:50"), ("b", "00:30")], "once each; d was taken in time, late is still waiting"


def test_ingest_cycles(spark, tmp_path):
    class Failing(M.HashingModel):
        def embed_texts(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no vector for bad")
            return super().embed_texts(texts)

    base = str(tmp_path / "store")
    Y.create(spark, base)
    one, two = "# A\nfirst\n# B\nbad text\n", "# A\nfirst\n# C\nnew\nzzz write to Ann\n"
    batches = [[("n.md", "2024-01-01 00:00:00", "older"), ("n.md", "2024-01-01 00:00:01", one), ("m.md", "2024-01-01 00:00:00", "same\nzzz look it up")], [("n.md", "2024-01-02 00:00:00", two), ("m.md", "2024-01-02 00:00:00", "same\nzzz look it up")]]
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "path string, event_ts string, content string")
        for _ in range(2):  # a batch that runs again replaces itself
            Y.run_cycle(batch, base, k, Failing)
    diff = Y.read(spark, base, "diff").groupBy("batch", "path", "status").count()
    assert {tuple(r) for r in diff.collect()} == {(0, "n.md", "added", 2), (0, "m.md", "added", 1), (1, "n.md", "kept", 1), (1, "n.md", "added", 1), (1, "n.md", "removed", 1)}
    assert {(r.path, r.content.split("\n")[0]) for r in Y.segments_now(spark, base).collect()} == {("n.md", "first"), ("n.md", "new"), ("m.md", "same")}
    assert Y.read(spark, base, "vectors").where("vec IS NULL").collect()[0].error == "no vector for bad"
    assert Y.vectors_now(spark, base).count() == 3 and Y.read(spark, base, "vectors").where("vec IS NOT NULL").count() == 3, "kept segments keep their vectors"
    assert {(r.batch, r.title) for r in Y.read(spark, base, "tasks").collect()} == {(0, "look it up"), (1, "write to Ann")}
    Y.run_cycle(spark.createDataFrame([("x.md", "2024-01-03 00:00:00", "bad")], "path string, event_ts string, content string"), base, 2, Failing)
    assert Y.vectors_now(spark, base).count() == 3
    Y.retry(spark, base, 1000, M.HashingModel)
    assert Y.vectors_now(spark, base).count() == 4, "what failed is tried again"


def test_ingest_replaces_paths(spark, tmp_path):
    batches = [[("a", "2024-01-01", "# A\nx"), ("b", "2024-01-01", "y")], [("a", "2024-01-02", "z"), ("b", "2024-01-02", "")]]
    rows = stream_of(spark, str(tmp_path / "in"), batches, "path string, event_ts string, content string")
    from notegraph.operators.text import split_notes

    got = W.ingest(rows, split_notes, "again")
    assert {(r.path, r.content) for r in got.collect()} == {("a", "z")}


def test_knn_passes_on_k_rows_a_task_however_many_are_equal(spark):
    rows = [(f"v{k:04d}", [1.0, 0.0]) for k in range(1000)] + [("near", [0.8, 0.6]), ("a-tie", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, vec array<double>").repartition(3)
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [0.8, 0.6])], "query_id string, vec array<double>")
    assert S._nearest(queries, vectors, 4).count() <= 2 * 4 * 3
    got = sorted((r.query_id, r["rank"], r.id, r.dist) for r in S.knn(queries, vectors, 4).collect())
    assert [g[2] for g in got] == ["near", "a-tie", "v0000", "v0001", "a-tie", "v0000", "v0001", "v0002"]
    assert got[1][3] == pytest.approx(0.632456) and got[4][3] == 0.0
