"""Vector, clustering and idea-over-time queries: embeddings with their labels, dated by the event of the same number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.vectors import dot, head, norm, unit
from notegraph.operators import cluster as C
from notegraph.operators import density as D
from notegraph.operators import quality as I
from notegraph.operators.tree import density_tree
from notegraph.plans.views import table
from notegraph.session import cut


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("vec"), F.col("label").cast("int").alias("label"))


def times(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("block_time"), "user_id", "event_type")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """The given labels as a finished pass; label 0 is its noise."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") - 1).cast("int").alias("label"))


def dated(spark: SparkSession, sf: str) -> DataFrame:
    return vecs(spark, sf).join(times(spark, sf), "id").withColumn("day", F.to_date("block_time"))


def pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are the users of the events; those with an even number exist."""
    seg = times(spark, sf).select("id", F.col("user_id").alias("doc"))
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc"))
    got = C.doc_pool(vecs(spark, sf), seg, docs)
    return got.select("id", "n", F.posexplode("vec").alias("pos", "x")).select("id", "n", "pos", F.round("x", 6).alias("x"))


def means(spark: SparkSession, sf: str) -> DataFrame:
    return C.centroids(vecs(spark, sf).select("id", "vec"), labels(spark, sf))


def bridge_rows(spark: SparkSession, sf: str) -> DataFrame:
    noise = vecs(spark, sf).drop("label").join(labels(spark, sf).where("label < 0"), "id", "left_semi")
    return C.bridges(noise, means(spark, sf), -0.05)


def parented(spark: SparkSession, sf: str) -> DataFrame:
    """A child pass: inside each label, by the hundred of the id."""
    return labels(spark, sf).where("label >= 0").select("id", F.col("label").alias("parent_label"), F.floor(F.col("id") / 100).cast("int").alias("label"))


def pass_rows(spark: SparkSession, sf: str) -> DataFrame:
    roots = labels(spark, sf).where("label >= 0").select("label").distinct().select(F.lit("areas").alias("pass_id"), F.lit(None).cast("string").alias("parent_pass"), F.lit(64).alias("dims"), F.col("label").cast("string").alias("id"))
    kids = parented(spark, sf).select("parent_label", "label").distinct().select(F.lit("fine").alias("pass_id"), F.lit("areas").alias("parent_pass"), F.lit(32).alias("dims"), F.concat_ws("_", F.col("parent_label").cast("string"), F.col("label").cast("string")).alias("id"))
    return roots.unionByName(kids)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A results grid to pick from: mean absolute value per (label, place) of the vectors."""
    v = vecs(spark, sf).select("label", F.posexplode("vec").alias("dims", "x"))
    return v.groupBy("label", "dims").agg(F.round(F.avg(F.abs("x")), 6).alias("score"))


def probe_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the first ``dims`` numbers' squares, by dims: a rising curve."""
    v = vecs(spark, sf)
    out = None
    for d in (8, 16, 24, 32, 48, 64):
        one = v.agg(F.round(F.avg(norm(F.slice("vec", 1, d))), 6).alias("accuracy")).select(F.lit(d).alias("dims"), "accuracy")
        out = one if out is None else out.unionByName(one)
    return out


def hub_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two seeded k-means runs inside each length tertile of the labelled vectors."""
    lengths = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").cast("long").alias("length"))
    rows = cut(vecs(spark, sf).drop("label").join(I.length_tertiles(lengths), "id"), "tertiles")
    out = None
    for bucket in ("short", "medium", "long"):
        part = rows.where(F.col("bucket") == bucket).select("id", "vec")
        one, two = (C.kmeans(part, 4, 32, seed) for seed in (1, 2))
        pairs = one.select("id", F.col("label").alias("la")).join(two.select("id", F.col("label").alias("lb")), "id")
        ari = I.adjusted_rand(pairs).select(F.lit(bucket).alias("bucket"), "ari")
        out = ari if out is None else out.unionByName(ari)
    return out


def silhouette_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The cosine silhouette of the given labels over the first 8, 16, 32 and 64 numbers, by label."""
    v = vecs(spark, sf)
    each = v.select(F.explode(F.array(*[F.lit(d) for d in (8, 16, 32, 64)])).alias("dims"), "label", "vec")
    return I.silhouettes(each.select("dims", "label", unit(F.slice("vec", F.lit(1), F.col("dims"))).alias("vec")), "dims")


def dag(spark: SparkSession, sf: str) -> DataFrame:
    return C.cluster_dag(vecs(spark, sf).select("id", "vec"), DAGS).select("pass_id", "id", "label")


DAGS = [C.Pass("points", 16, 2, "fine", least=4), C.Pass("fine", 32, 3, "areas"), C.Pass("areas", 64, 4)]

UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))))"
V = f"v AS (SELECT vec_id AS id, {UNIT} AS vec, CAST(label AS INTEGER) AS label FROM embeddings)"
DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]))"
E = f"{V}, e AS (SELECT id, label, generate_subscripts(vec, 1) AS pos, unnest(vec) AS x FROM v)"
L = "l AS (SELECT vec_id AS id, CAST(label - 1 AS INTEGER) AS label FROM embeddings)"
T = "t AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS block_time, CAST(ts AS DATE) AS day, user_id, event_type FROM events)"
CENTRE = f"{E}, {L}, c AS (SELECT l.label, pos, avg(x) AS m FROM e JOIN l USING (id) WHERE l.label >= 0 GROUP BY 1, 2)"
CID = "substr(sha256('cluster:{}:' || {}), 1, 16)"

QUERIES = {
    "load_vectors": (
        lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first")),
        "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings",
    ),
    "normalise_vectors": (
        lambda s, d: vecs(s, d).select("id", F.round(norm(F.col("vec")), 6).alias("norm"), F.round(F.get("vec", F.lit(3)), 6).alias("fourth")),
        f"WITH {V} SELECT id, round(sqrt({DOT.format('vec', 'vec')}), 6) AS norm, round(vec[4], 6) AS fourth FROM v",
    ),
    "truncate_norm": (
        lambda s, d: vecs(s, d).select("id", F.posexplode(head(F.col("vec"), 8)).alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x")),
        f"WITH {E}, h AS (SELECT id, pos, x FROM e WHERE pos <= 8) SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM h",
    ),
    "doc_pool": (
        pooled,
        f"WITH {E}, {T} SELECT user_id AS id, count(*) AS n, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) AS x FROM e JOIN t USING (id) WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY user_id, pos",
    ),
    "centroids": (
        lambda s, d: means(s, d).select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x")),
        f"WITH {CENTRE} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) AS x FROM c",
    ),
    "temporal": (
        lambda s, d: C.temporal(labels(s, d), times(s, d)).select("label", "first_date", "last_date", F.size("dates").cast("long").alias("n"), F.array_join("dates", ",").alias("dates")),
        f"WITH {L}, {T} SELECT label, min(substr(block_time, 1, 10)) AS first_date, max(substr(block_time, 1, 10)) AS last_date, count(*) AS n, string_agg(substr(block_time, 1, 10), ',' ORDER BY block_time) AS dates FROM l JOIN t USING (id) WHERE label >= 0 GROUP BY 1",
    ),
    "bridges": (
        bridge_rows,
        f"""WITH {CENTRE}, s AS (SELECT e.id, c.label, round(sum(x * m), 6) AS similarity, row_number() OVER (PARTITION BY e.id ORDER BY sum(x * m) DESC, c.label) AS place
        FROM e JOIN l USING (id) JOIN c USING (pos) WHERE l.label < 0 GROUP BY 1, 2), two AS (SELECT * FROM s WHERE place <= 2)
        SELECT id, label, similarity, CAST(place AS INTEGER) AS place FROM two WHERE id IN (SELECT id FROM two WHERE place = 2 AND similarity >= -0.05)""",
    ),
    "bridge_blocks": (
        lambda s, d: C.bridge_blocks("areas", bridge_rows(s, d).withColumn("id", F.col("id").cast("string"))),
        f"""WITH {CENTRE}, s AS (SELECT e.id, c.label, round(sum(x * m), 6) AS similarity, row_number() OVER (PARTITION BY e.id ORDER BY sum(x * m) DESC, c.label) AS place
        FROM e JOIN l USING (id) JOIN c USING (pos) WHERE l.label < 0 GROUP BY 1, 2), two AS (SELECT * FROM s WHERE place <= 2)
        SELECT substr(sha256('bridge:areas:' || id), 1, 16) AS id, CAST(id AS VARCHAR) AS source_block_id, string_agg({CID.format('areas', 'label')}, ',' ORDER BY place) AS near
        FROM two WHERE id IN (SELECT id FROM two WHERE place = 2 AND similarity >= -0.05) GROUP BY two.id""",
    ),
    "cluster_ids": (
        lambda s, d: C.pass_blocks("areas", labels(s, d), times(s, d))[0],
        f"""WITH {L}, {T} SELECT {CID.format('areas', 'label')} AS id, 'areas cluster ' || label AS title, CAST(label AS VARCHAR) AS label, count(*) AS members, min(block_time) AS first_date, max(block_time) AS last_date
        FROM l LEFT JOIN t USING (id) WHERE label >= 0 GROUP BY l.label""",
    ),
    "write_pass": (
        lambda s, d: C.pass_blocks("fine", parented(s, d), times(s, d), "parent_label", "areas")[1].withColumn("to_id", F.col("to_id").cast("string")),
        f"""WITH {L}, p AS (SELECT id, label AS parent, CAST(floor(id / 100) AS INTEGER) AS child FROM l WHERE label >= 0)
        SELECT {CID.format('fine', "parent || '_' || child")} AS from_id, CAST(id AS VARCHAR) AS to_id, 'groups' AS kind FROM p
        UNION ALL SELECT DISTINCT {CID.format('areas', 'parent')}, {CID.format('fine', "parent || '_' || child")}, 'contains' FROM p""",
    ),
    "propagate_labels": (
        lambda s, d: C.propagate(labels(s, d), times(s, d).select("id", F.col("user_id").alias("doc"))),
        f"WITH {L}, {T} SELECT t.id, l.label FROM t JOIN l ON l.id = t.user_id",
    ),
    "pass_stats": (
        lambda s, d: C.pass_stats(labels(s, d)),
        f"""WITH {L}, z AS (SELECT label, count(*) AS n FROM l GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (label >= 0) AS clusters, round(100.0 * sum(n) FILTER (label < 0) / sum(n), 4) AS noise_pct,
        min(n) FILTER (label >= 0) AS least, CAST(quantile_cont(n, 0.5) FILTER (label >= 0) AS DOUBLE) AS median, max(n) FILTER (label >= 0) AS most FROM z""",
    ),
    "pass_health": (
        lambda s, d: C.pass_health(labels(s, d)),
        f"""WITH {L}, z AS (SELECT label, count(*) AS n FROM l GROUP BY 1), q AS (SELECT sum(n) AS rows, count(*) FILTER (label >= 0) AS k, 100.0 * sum(n) FILTER (label < 0) / sum(n) AS noise, min(n) FILTER (label >= 0) AS least, max(n) FILTER (label >= 0) AS most FROM z)
        SELECT k BETWEEN 6 AND 18 AS count_ok, noise < 20 AS noise_ok, 100 * most <= 40 * rows AS largest_ok, least >= 30 AS smallest_ok FROM q""",
    ),
    "cluster_samples": (
        lambda s, d: C.samples(labels(s, d), times(s, d).select("id", F.concat("event_type", F.lit("-"), F.col("id").cast("string")).alias("name"))),
        f"""WITH {L}, {T}, r AS (SELECT label, t.id, event_type || '-' || t.id AS name, row_number() OVER (PARTITION BY label ORDER BY t.id) AS k FROM l JOIN t USING (id))
        SELECT label, (SELECT count(*) FROM l WHERE l.label = r.label) AS n, string_agg(name, ',' ORDER BY id) AS names FROM r WHERE k <= 6 GROUP BY label""",
    ),
    "cluster_snippets": (
        lambda s, d: C.cluster_snippets(labels(s, d), table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))),
        f"""WITH {L}, r AS (SELECT label, id, substr(text, 1, 180) AS snippet, CAST(row_number() OVER (PARTITION BY label ORDER BY sha256(id || ':1')) AS INTEGER) AS n FROM l JOIN documents ON doc_id = id) SELECT * FROM r WHERE n <= 5""",
    ),
    "cluster_timeline": (
        lambda s, d: labels(s, d).where("label = 2").join(times(s, d), "id").select("id", "block_time", "event_type").orderBy("block_time", "id"),
        f"WITH {L}, {T} SELECT id, block_time, event_type FROM l JOIN t USING (id) WHERE label = 2",
    ),
    "pass_points": (
        lambda s, d: times(s, d).join(labels(s, d), "id").select("id", "label", "block_time"),
        f"WITH {L}, {T} SELECT id, label, block_time FROM t JOIN l USING (id)",
    ),
    "cluster_hierarchy": (
        lambda s, d: parented(s, d).groupBy("parent_label", "label").agg(F.count("*").alias("members")),
        f"WITH {L} SELECT label AS parent_label, CAST(floor(id / 100) AS INTEGER) AS label, count(*) AS members FROM l WHERE label >= 0 GROUP BY l.label, floor(id / 100)",
    ),
    "discover_passes": (
        lambda s, d: C.discover_passes(pass_rows(s, d)),
        f"""WITH {L} SELECT 'areas' AS pass_id, CAST(NULL AS VARCHAR) AS parent_pass, 64 AS dims, count(DISTINCT label) AS clusters, 1 AS place FROM l WHERE label >= 0
        UNION ALL SELECT 'fine', 'areas', 32, count(DISTINCT (label, floor(id / 100))), 2 FROM l WHERE label >= 0""",
    ),
    "explorer_payload": (
        lambda s, d: times(s, d).join(labels(s, d), "id", "left").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 500).alias("snippet")), "id", "left").select("id", "label", "block_time", F.char_length("snippet").alias("snippet_len")),
        f"WITH {L}, {T} SELECT t.id, l.label, t.block_time, CAST(length(substr(text, 1, 500)) AS INTEGER) AS snippet_len FROM t LEFT JOIN l USING (id) LEFT JOIN documents ON doc_id = t.id",
    ),
    "source_snippets": (
        lambda s, d: table(s, d, "documents").join(table(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.substring("text", 1, 500).alias("snippet")),
        "SELECT doc_id, substr(text, 1, 500) AS snippet FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    ),
    "density_clusters": (lambda s, d: D.density(vecs(s, d).select("id", "vec"), 5, 4, quantile=0.3), None),
    "hub_stability": (hub_stability, None),
    "kmeans": (lambda s, d: C.kmeans(vecs(s, d).select("id", "vec"), 8), None),
    "cluster_within": (lambda s, d: C.cluster_within(vecs(s, d).select("id", "vec"), labels(s, d), 3), None),
    "kmeans_grid": (lambda s, d: C.kmeans_grid(vecs(s, d).select("id", "vec"), [16, 64], [4, 8]), None),
    "kmeans_grid_titles": (lambda s, d: C.kmeans_grid(vecs(s, d).select("id", "vec"), [16, 64], [4, 8], table(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("name"))), None),
    "cluster_dag": (dag, None),
    "cluster_dag_stats": (lambda s, d: C.dag_stats(dag(s, d)), None),
    "density_tree": (lambda s, d: density_tree(vecs(s, d).select("id", "vec"), 5, 3), None),
    "within_hub_grid": (lambda s, d: I.stability_grid(vecs(s, d).select("id", F.col("label").alias("grp"), "vec"), [16, 64], [2, 4]), None),
    "silhouette_grid": (
        silhouette_grid,
        f"""WITH {V}, d AS (SELECT unnest([8, 16, 32, 64]) AS dims), s AS (SELECT id, label, dims, vec[1:dims] AS x FROM v, d),
        u AS (SELECT id, label, dims, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda y: y * y)))) AS x FROM s),
        p AS (SELECT a.dims, a.id, a.label, b.label AS other, sum(1 - {DOT.format('a.x', 'b.x')}) AS gap, count(*) AS n FROM u a JOIN u b ON a.dims = b.dims AND a.id <> b.id GROUP BY 1, 2, 3, 4),
        q AS (SELECT dims, id, max(gap / n) FILTER (label = other) AS a, min(gap / n) FILTER (label <> other) AS b FROM p GROUP BY 1, 2)
        SELECT dims, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q GROUP BY 1""",
    ),
    "project_2d": (lambda s, d: C.project_2d(vecs(s, d)), None),
    "similarity_gap": (
        lambda s, d: I.similarity_gap(vecs(s, d)),
        f"""WITH {E}, s AS (SELECT label, pos, sum(x) AS s FROM e GROUP BY 1, 2), a AS (SELECT pos, sum(x) AS s FROM e GROUP BY 1),
        q AS (SELECT (SELECT sum(s * s) FROM s) AS own, (SELECT sum(s * s) FROM a) AS every, (SELECT count(*) FROM v) AS n, (SELECT sum(k * (k - 1)) FROM (SELECT count(*) AS k FROM v GROUP BY label)) AS pairs)
        SELECT round((own - n) / pairs, 6) AS within_mean, round((every - own) / (n * (n - 1) - pairs), 6) AS between_mean, round((own - n) / pairs - (every - own) / (n * (n - 1) - pairs), 6) AS gap FROM q""",
    ),
    "cluster_quality": (
        lambda s, d: I.scatter(vecs(s, d)),
        f"""WITH {E}, m AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2), g AS (SELECT pos, avg(x) AS m FROM e GROUP BY 1),
        d AS (SELECT id, e.label, sum((x - m) * (x - m)) AS d2 FROM e JOIN m ON m.label = e.label AND m.pos = e.pos GROUP BY 1, 2), s AS (SELECT label, avg(sqrt(d2)) AS s, sum(d2) AS w, count(*) AS n FROM d GROUP BY 1),
        mm AS (SELECT a.label AS l1, b.label AS l2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM m a JOIN m b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2),
        db AS (SELECT avg(r) AS db FROM (SELECT l1, max((a.s + b.s) / gap) AS r FROM mm JOIN s a ON a.label = l1 JOIN s b ON b.label = l2 GROUP BY 1)),
        bb AS (SELECT sum(n * (m.m - g.m) * (m.m - g.m)) AS b FROM m JOIN g USING (pos) JOIN s ON s.label = m.label)
        SELECT round(db, 6) AS davies_bouldin, round((b / ((SELECT count(*) FROM s) - 1)) / ((SELECT sum(w) FROM s) / ((SELECT count(*) FROM v) - (SELECT count(*) FROM s))), 4) AS calinski_harabasz FROM db, bb""",
    ),
    "silhouette": (lambda s, d: I.cluster_quality(vecs(s, d)), None),
    "linear_probe": (lambda s, d: I.linear_probe(vecs(s, d), [8, 64], iterations=30), None),
    "ari": (
        lambda s, d: I.adjusted_rand(times(s, d).join(labels(s, d), "id").select(F.col("label").alias("la"), F.col("event_type").alias("lb"))),
        f"""WITH {L}, {T}, c AS (SELECT label AS la, event_type AS lb, count(*) AS n FROM t JOIN l USING (id) GROUP BY 1, 2),
        q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS idx, (SELECT sum(n) FROM c) AS t, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY la)) AS sa, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY lb)) AS sb)
        SELECT round((idx - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM q""",
    ),
    "seeded_sample": (
        lambda s, d: I.seeded_sample(table(s, d, "documents").where("length(text) > 50").select(F.col("doc_id").alias("id")), 200),
        "SELECT doc_id AS id FROM documents WHERE length(text) > 50 ORDER BY sha256(doc_id || ':42') LIMIT 200",
    ),
    "length_tertiles": (
        lambda s, d: I.length_tertiles(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").cast("long").alias("length"))),
        """WITH c AS (SELECT floor(quantile_cont(length(text), 0.33)) AS c0, floor(quantile_cont(length(text), 0.67)) AS c1 FROM documents)
        SELECT doc_id AS id, length(text) AS length, CASE WHEN length(text) <= c0 THEN 'short' WHEN length(text) <= c1 THEN 'medium' ELSE 'long' END AS bucket FROM documents, c""",
    ),
    "length_histogram": (
        lambda s, d: I.histogram(table(s, d, "documents").select(F.char_length("text").alias("length")), "length", 500),
        "SELECT CAST(floor(length(text) / 500) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1",
    ),
    "idea_loops": (
        lambda s, d: I.idea_loops(dated(s, d).select("id", F.col("label").alias("topic"), "day", "vec"), 0.1, 1),
        f"""WITH {V}, {T}, x AS (SELECT v.id, label, day, vec FROM v JOIN t USING (id)), p AS (SELECT a.label AS topic, a.id AS a, b.id AS b, CAST(b.day - a.day AS INTEGER) AS gap, {DOT.format('a.vec', 'b.vec')} AS s
        FROM x a JOIN x b ON a.label = b.label AND b.day - a.day >= 1) SELECT topic, a, b, gap, round(s, 6) AS similarity FROM p WHERE s >= 0.1""",
    ),
    "trajectory_coherence": (
        lambda s, d: I.trajectory_coherence(dated(s, d).select(F.col("label").alias("topic"), F.struct("block_time", "id").alias("at"), "vec")),
        f"""WITH {E}, {T}, r AS (SELECT e.id, label, pos, x, row_number() OVER (PARTITION BY label, pos ORDER BY block_time, e.id) AS k FROM e JOIN t USING (id)),
        d AS (SELECT label, pos, k, x - lag(x) OVER (PARTITION BY label, pos ORDER BY k) AS d FROM r), f AS (SELECT *, lag(d) OVER (PARTITION BY label, pos ORDER BY k) AS e FROM d),
        c AS (SELECT label, k, sum(d * e) / greatest(1e-16, sqrt(sum(d * d)) * sqrt(sum(e * e))) AS c FROM f WHERE k > 2 GROUP BY 1, 2)
        SELECT label AS topic, round(avg(c), 6) AS coherence, count(*) AS turns FROM c GROUP BY 1""",
    ),
    "cosine_matrix": (
        lambda s, d: means(s, d).select("label", unit(F.col("vec")).alias("a")).join(F.broadcast(means(s, d).select(F.col("label").alias("other"), unit(F.col("vec")).alias("b"))), F.col("label") <= F.col("other")).select("label", "other", F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("a"), F.col("b")))), 6).alias("cosine")),
        f"""WITH {CENTRE}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1)
        SELECT a.label, b.label AS other, round(least(1.0, greatest(-1.0, sum(a.m * b.m) / (na.n * nb.n))), 6) AS cosine FROM c a JOIN c b ON a.pos = b.pos AND a.label <= b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY a.label, b.label, na.n, nb.n""",
    ),
    "grid_best": (
        lambda s, d: I.best_by(grid(s, d), "label", "dims", "score"),
        f"""WITH {E}, g AS (SELECT label, CAST(pos - 1 AS INTEGER) AS dims, round(avg(abs(x)), 6) AS score FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, dims) AS k FROM g)
        SELECT label, dims AS best_dims, score AS best_score FROM r WHERE k = 1""",
    ),
    "plateau": (
        lambda s, d: I.plateau(probe_scores(s, d), 0.1, 0.05),
        f"""WITH {E}, ds AS (SELECT unnest([8, 16, 24, 32, 48, 64]) AS dims), p AS (SELECT dims, round(avg(n), 6) AS accuracy FROM (SELECT dims, id, sqrt(sum(x * x)) AS n FROM ds JOIN e ON pos <= dims GROUP BY 1, 2) GROUP BY 1),
        g AS (SELECT dims, lead(accuracy) OVER (ORDER BY dims) - accuracy AS ng, accuracy - lag(accuracy) OVER (ORDER BY dims) AS gg FROM p)
        SELECT min(dims) FILTER (ng < 0.1) AS plateau, max(dims) FILTER (gg > 0.05) AS sweet_spot FROM g""",
    ),
    "revisit_metrics": (
        lambda s, d: I.revisits(table(s, d, "orders").select(F.col("o_custkey").alias("cluster"), F.to_date("o_orderdate").alias("day"))),
        """WITH o AS (SELECT o_custkey AS cluster, CAST(o_orderdate AS DATE) AS day FROM orders), w AS (SELECT *, day - lag(day) OVER (PARTITION BY cluster ORDER BY day) AS wait, max(day) OVER () AS newest FROM o),
        p AS (SELECT cluster, count(*) AS members, min(day) AS f, max(day) AS l, count(*) FILTER (wait > 60) AS returns, count(*) FILTER (day >= newest - 90) AS recent, max(newest) AS newest FROM w GROUP BY 1)
        SELECT cluster, members, returns, recent, CAST(l - f AS INTEGER) AS span_days, round(members / greatest((l - f) / 30.0, 1.0), 2) AS velocity, round(recent / 3.0, 2) AS velocity_recent, CAST(newest - l AS INTEGER) AS days_since FROM p WHERE members >= 2""",
    ),
    "timeline_export": (
        lambda s, d: labels(s, d).where("label >= 0").join(times(s, d), "id").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 400).alias("snippet")), "id", "left").select("label", "id", F.substring("block_time", 1, 10).alias("day"), "snippet"),
        f"WITH {L}, {T} SELECT label, t.id, substr(block_time, 1, 10) AS day, substr(text, 1, 400) AS snippet FROM l JOIN t USING (id) LEFT JOIN documents ON doc_id = t.id WHERE label >= 0",
    ),
    "activity_heatmap": (
        lambda s, d: I.activity(table(s, d, "events"), F.col("ts")),
        """WITH x AS (SELECT epoch(ts) AS t FROM events), e AS (SELECT min(t) AS lo, (max(t) - min(t)) / 100 AS size FROM x), b AS (SELECT CAST(least(99, floor((t - lo) / size)) AS INTEGER) AS bucket, count(*) AS n FROM x, e GROUP BY 1)
        SELECT bucket, n, round(n / max(n) OVER (), 6) AS share, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS seen FROM b""",
    ),
    "date_range_counts": (
        lambda s, d: table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")),
        "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    ),
    "label_counts": (
        lambda s, d: table(s, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n")),
        "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    ),
    "labels_io": (
        lambda s, d: table(s, d, "labels").join(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti").where("quality IS NOT NULL").select("doc_id", "quality"),
        "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND doc_id NOT IN (SELECT item_id FROM benchmark)",
    ),
}
