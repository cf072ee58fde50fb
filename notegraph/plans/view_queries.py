"""Pages, opened notes, explorer tables, compiled pages, settled tasks and whole ingest cycles, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.ids import make_id
from notegraph.operators import browse as B
from notegraph.operators import cluster as C
from notegraph.operators import explorer as E
from notegraph.operators import graph as G
from notegraph.operators import quality as I
from notegraph.operators import tables as M
from notegraph.operators import tasks as K
from notegraph.operators.embed import HashingModel
from notegraph.plans.stream_queries import _two_tags, tagged_blocks
from notegraph.plans.text_queries import STREAMS, stream_files, wanted_streams
from notegraph.plans.vector_queries import CENTRE, CID, L, T, bridge_rows, labels, parented, times, vecs
from notegraph.plans.views import blocks, graph_sql, links, table
from notegraph.session import shared_dir
from notegraph.sources.notes import compiled_pages
from notegraph.streaming import changes as S
from notegraph.streaming import cycle as Y


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as segments with tags (their parts), classified tags (the event of their number) and a time of arrival."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit("data_block").alias("kind"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderstatus").alias("content"),
        F.date_format(F.date_add("o_orderdate", (F.col("o_orderkey") % 97).cast("int")), "yyyy-MM-dd").alias("ingested_at"),
    )
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.array("event_type").alias("given_tags"))
    return o.join(tagged_blocks(spark, sf), "id").join(ev, "id", "left")


def _tags(spark: SparkSession, sf: str) -> list[str]:
    return [*_two_tags(spark, sf), "click"]


DATED = """two AS (SELECT DISTINCT p_name FROM part ORDER BY 1 LIMIT 2),
hit AS (SELECT l_orderkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN (FROM two) UNION SELECT event_id FROM events WHERE event_type = 'click'),
b AS (SELECT o_orderkey AS id, o_orderpriority AS source, strftime(o_orderdate, '%Y-%m-%d') AS block_time, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 97 AS INTEGER), '%Y-%m-%d') AS ingested_at FROM orders),
f AS (SELECT * FROM b WHERE source = '1-URGENT' AND block_time >= '1994-01-01' ORDER BY block_time DESC, id LIMIT 101 OFFSET 10)"""


def _page(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    return B.browse_page(dated(spark, sf), k, 10, _tags(spark, sf) if k == 100 else None, source="1-URGENT", after="1994-01-01")


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.select(
        F.col("doc_id").alias("id"), F.lit("data_block").alias("kind"), F.col("source").alias("title"), F.col("lang").alias("source"),
        F.lit(None).cast("string").alias("block_time"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.lit(None).cast("array<string>").alias("given_tags"),
    )
    short = B.summary(rows)
    return short.withColumn("tags", F.array_join("tags", ",")).withColumn("given_tags", F.array_join("given_tags", ","))


def wanted_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers, of the odd ones only their number: no title, but a word of one; and titles of nothing."""
    c = table(spark, sf, "customer")
    number = F.regexp_replace("c_name", "^[^0-9]*", "")
    nothing = F.concat(F.lit("nothing "), "c_name")
    return c.select(F.explode(F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(number), nothing)).alias("title"))


ASKED = """asked AS (SELECT substr(sha256('doc:customers/' || c_custkey || '.md'), 1, 16) AS doc_id, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE regexp_replace(c_name, '^[^0-9]*', '') END AS wanted FROM customer)"""


def opened(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return G.open_notes(blocks(spark, sf), links(spark, sf), wanted_titles(spark, sf))


def mapped_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as segments (every seventh without a path, every second of those without a title) and as documents."""
    d = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    key, none = F.col("doc_id"), F.lit(None).cast("string")
    seg = d.select(
        key.cast("string").alias("id"), F.lit("data_block").alias("kind"), F.when(key % 14 != 0, F.col("lang")).alias("title"), F.col("text").alias("content"),
        F.when(key % 7 != 0, path).alias("source_path"),
    ).join(times(spark, sf).select(F.col("id").cast("string").alias("id"), "block_time"), "id", "left")
    docs = d.select(F.concat(F.lit("d"), key.cast("string")).alias("id"), F.lit("context_block:document").alias("kind"), none.alias("title"), F.concat(F.lit("doc "), "text").alias("content"), path.alias("source_path"), none.alias("block_time"))
    return seg.unionByName(docs)


FOLDERS = ["src0", "src1", "src2", "src3"]


def shown(spark: SparkSession, sf: str) -> DataFrame:
    return E.data_blocks(mapped_blocks(spark, sf), vecs(spark, sf).select(F.col("id").cast("string").alias("id"), "vec"), FOLDERS)


SHOWN = """shown AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text AS content, CASE WHEN doc_id % 14 <> 0 THEN lang ELSE '' END AS title,
  CASE WHEN doc_id % 7 <> 0 THEN source || '/' || doc_id || '.md' WHEN doc_id % 14 <> 0 THEN lang ELSE CAST(doc_id AS VARCHAR) END AS source_path, block_time
  FROM documents d JOIN embeddings ON vec_id = doc_id LEFT JOIN t ON t.id = doc_id WHERE doc_id % 7 = 0 OR source IN ('src0', 'src1', 'src2', 'src3'))"""


def clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and links of the passes ``areas`` and, inside it, ``fine``."""
    parts = []
    for pass_id, up, rows, parent in (("areas", None, labels(spark, sf), None), ("fine", "areas", parented(spark, sf), "parent_label")):
        found, held = C.pass_blocks(pass_id, rows, times(spark, sf), parent, up)
        parts.append((found.select(F.lit(pass_id).alias("pass_id"), F.lit(up).cast("string").alias("parent_pass"), F.lit(32 if up else 64).alias("dims"), "*"), held))
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


CLUSTERS = f"""{L}, {T}, p AS (SELECT id, label AS parent, CAST(floor(id / 100) AS INTEGER) AS child FROM l WHERE label >= 0),
k AS (SELECT 'areas' AS pass_id, CAST(NULL AS VARCHAR) AS parent_pass, 64 AS dims, CAST(parent AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS up, * FROM p
  UNION ALL SELECT 'fine', 'areas', 32, parent || '_' || child, CAST(parent AS VARCHAR), * FROM p),
cl AS (SELECT substr(sha256('cluster:' || pass_id || ':' || label), 1, 16) AS id, pass_id, parent_pass, dims, label, up, pass_id || ' cluster ' || label AS title, count(*) AS members, min(block_time) AS first_date, max(block_time) AS last_date
  FROM k LEFT JOIN t USING (id) GROUP BY ALL)"""


def explorer_map(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda rows, name: rows.where("label >= 0").select(F.lit(name).alias("pass_id"), F.col("id").cast("string").alias("id"), F.col("full").alias("label"))
    areas = text(labels(spark, sf).withColumn("full", C.full_label()), "areas")
    fine = text(parented(spark, sf).withColumn("full", C.full_label("parent_label")), "fine")
    got = E.payload(shown(spark, sf), mapped_blocks(spark, sf), areas.unionByName(fine))
    of = lambda k: F.element_at("cluster_assignments", k).alias(k)
    inside = (F.abs("x") <= 1) & (F.abs("y") <= 1)
    return got.select("id", "source_path", F.sha2("source_content", 256).alias("source_sha"), "date", of("areas"), of("fine"), inside.alias("inside"))


def bridge_list(spark: SparkSession, sf: str) -> DataFrame:
    found = C.bridge_blocks("areas", bridge_rows(spark, sf).withColumn("id", F.col("id").cast("string")))
    return E.bridge_list(found, table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")))


def compiled(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as hub pages, parts as concepts (several of a name), regions as what has no page, and three single pages."""
    one = lambda rows, kind, key, scope, text: rows.select(F.lit(kind).alias("context_type"), F.col(key).cast("long").alias("id"), scope.alias("scope"), text.alias("content"))
    cust, part, region = (table(spark, sf, t) for t in ("customer", "part", "region"))
    rows = one(cust, "hub_summary", "c_custkey", F.concat(F.lit("tag:a/"), "c_name", F.lit("!")), F.col("c_mktsegment"))
    rows = rows.unionByName(one(part, "concept", "p_partkey", F.col("p_name"), F.col("p_partkey").cast("string")))
    for kind in ("index", "recent_activity", "graph_health", "other"):
        rows = rows.unionByName(one(region, kind, "r_regionkey", F.lit(None).cast("string"), F.col("r_name")))
    return compiled_pages(rows)


def settled(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of their user's task file: pending after a view or a click."""
    e = S.read_table(spark, f"{sf}/events.parquet")
    status = F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("active")
    rows = e.select(F.concat(F.lit("tasks/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("ts").cast("timestamp").alias("event_ts"), status.alias("status"))
    got = S.run_available(S.settle(rows, 6 * 3600), "settle")
    return got.select("path", F.date_format("fire_at", "yyyy-MM-dd HH:mm:ss").alias("fire_at"))


def ingest_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """All documents come in; then the labelled ones again: those of quality 1 as they were, of the others the odd ones with a
    section more and the even ones with another text. What each cycle wrote."""
    base = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    Y.create(spark, base)
    path = F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    first = F.concat(F.lit("## A\n"), "text", F.lit("\nzzz check "), "lang", F.lit("\n"))
    at = lambda day: F.lit(day).cast("timestamp").alias("event_ts")
    docs = S.read_table(spark, f"{sf}/documents.parquet").select(path, first.alias("content"), at("2024-01-01"))
    Y.run_stream(docs, base, HashingModel, "docs")
    again = S.read_table(spark, f"{sf}/labels.parquet").select("doc_id", "quality").join(table(spark, sf, "documents"), "doc_id")
    more = F.concat(first, F.lit("# B\nnew "), F.col("lang"), F.lit("\nzzz again\n"))
    edited = F.when(F.col("quality") == 1, first).when(F.col("doc_id") % 2 == 1, more).otherwise("## A\nother\n")
    Y.run_stream(again.select(path, edited.alias("content"), at("2024-01-02")), base, HashingModel, "labels", 1_000_000)
    second = (F.col("batch") >= 1_000_000).alias("second")
    show = lambda name, key, value: Y.read(spark, base, name).select(F.lit(name).alias("wrote"), second, F.col(key).alias("block"), value.alias("value"))
    out = show("diff", "id", F.col("status")).unionByName(show("tasks", "block_id", F.col("title")))
    return out.unionByName(show("vectors", "block_id", F.coalesce("error", F.size("vec").cast("string"))))


def named_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by name: toxic ones wait for review, some are missing or blank."""
    key = F.col("doc_id")
    name = F.when(F.col("toxic") == 1, "NEEDS_REVIEW").when(key % 5 == 0, "  ").when(key % 7 != 0, F.concat(F.lit("q"), F.col("quality").cast("string")))
    return table(spark, sf, "labels").select(key.alias("id"), name.alias("label"))


NAMED = "named AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'NEEDS_REVIEW' WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 <> 0 THEN 'q' || quality END AS label FROM labels)"


def lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").cast("long").alias("length"))


def half_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two kinds of vectors, of which even numbers lack the second."""
    e = table(spark, sf, "embeddings")
    return e.select(make_id(F.lit("seg"), F.col("vec_id").cast("string")).alias("block_id"), "embedding", F.when(F.col("vec_id") % 2 == 1, F.col("embedding")).alias("content_only"))


ID = "substr(sha256(path || ':' || substr(sha256({}), 1, 16)), 1, 16)"
CYCLE = f"""WITH a AS (SELECT doc_id, lang, 'n/' || doc_id || '.md' AS path, regexp_replace(text, '^\\s+', '') || chr(10) || 'zzz check ' || lang AS c FROM documents),
e AS (SELECT a.* FROM a JOIN labels USING (doc_id) WHERE quality <> 1), odd AS (SELECT *, 'new ' || lang || chr(10) || 'zzz again' AS m FROM e WHERE doc_id % 2 = 1),
d AS (SELECT false AS second, {ID.format("c")} AS block, 'added' AS value FROM a UNION ALL SELECT true, {ID.format("c")}, 'kept' FROM odd UNION ALL SELECT true, {ID.format("m")}, 'added' FROM odd
  UNION ALL SELECT true, {ID.format("c")}, 'removed' FROM e WHERE doc_id % 2 = 0 UNION ALL SELECT true, {ID.format("'other'")}, 'added' FROM e WHERE doc_id % 2 = 0)
SELECT 'diff' AS wrote, * FROM d UNION ALL SELECT 'vectors', second, block, '64' FROM d WHERE value = 'added'
UNION ALL SELECT 'tasks', false, {ID.format("c")}, 'check ' || lang FROM a UNION ALL SELECT 'tasks', true, {ID.format("m")}, 'new ' || lang FROM odd"""

QUERIES = {
    "browse_page": (
        lambda s, d: _page(s, d, 100)[0].select("id", "block_time"),
        f"WITH {DATED} SELECT id, block_time FROM f WHERE id IN (SELECT id FROM hit) ORDER BY block_time DESC, id LIMIT 100",
    ),
    "browse_page_info": (
        lambda s, d: _page(s, d, 25)[1],
        f"""WITH {DATED}, n AS (SELECT count(*) AS total FROM b WHERE source = '1-URGENT' AND block_time >= '1994-01-01')
        SELECT greatest(0, least(25, total - 10)) AS count, total, total - 10 > 25 AS has_more, CASE WHEN total - 10 > 25 THEN 35 END AS next_offset FROM n""",
    ),
    "recent_ingested": (
        lambda s, d: B.recent(dated(s, d), 20, _tags(s, d), "ingested_at", "data_block", "1-URGENT").select("id", "ingested_at"),
        f"""WITH {DATED}, r AS (SELECT id, ingested_at FROM b WHERE source = '1-URGENT' ORDER BY ingested_at DESC, id LIMIT 60)
        SELECT * FROM r WHERE id IN (SELECT id FROM hit) ORDER BY ingested_at DESC, id LIMIT 20""",
    ),
    "block_summary": (
        summaries,
        """SELECT doc_id AS id, 'data_block' AS kind, source AS title, lang AS source, CAST(NULL AS VARCHAR) AS block_time, substr(text, 1, 500) AS content, lang || ',' || source AS tags, '' AS given_tags FROM documents""",
    ),
    "open_notes": (
        lambda s, d: opened(s, d)[0],
        graph_sql(f"""{ASKED} |with| SELECT wanted, doc_id, c_name AS note_title, true AS found, (SELECT count(*) FROM links WHERE to_id = doc_id AND kind = 'contains') AS entries,
        (SELECT count(*) FROM links WHERE to_id = doc_id) AS inbound, (SELECT count(*) FROM links WHERE from_id = doc_id) AS outbound FROM asked
        UNION ALL SELECT 'nothing ' || c_name, NULL, NULL, false, 0, 0, 0 FROM asked"""),
    ),
    "open_note_entries": (
        lambda s, d: opened(s, d)[1].select("wanted", "doc_id", "id", "title", "content", "block_time"),
        graph_sql(f"{ASKED} |with| SELECT wanted, doc_id, b.id, b.title, b.content, b.block_time FROM asked JOIN links ON to_id = doc_id AND links.kind = 'contains' JOIN blocks b ON b.id = from_id"),
    ),
    "explorer_blocks": (
        lambda s, d: shown(s, d).select("id", F.sha2("content", 256).alias("sha"), "title", "source_path", "block_time"),
        f"WITH {T}, {SHOWN} SELECT id, sha256(content) AS sha, title, source_path, block_time FROM shown",
    ),
    "explorer_map": (
        explorer_map,
        f"""WITH {L}, {T}, {SHOWN} SELECT shown.id, source_path, sha256(CASE WHEN contains(source_path, '/') THEN substr('doc ' || content, 1, 500) ELSE '' END) AS source_sha, substr(block_time, 1, 7) AS date,
        CASE WHEN label >= 0 THEN CAST(label AS VARCHAR) END AS areas, CASE WHEN label >= 0 THEN label || '_' || CAST(floor(l.id / 100) AS INTEGER) END AS fine, true AS inside FROM shown JOIN l ON l.id = doc_id""",
    ),
    "cluster_blocks": (
        lambda s, d: clusters(s, d)[0],
        f"WITH {CLUSTERS} SELECT id, pass_id, parent_pass, dims, label, title, members, first_date, last_date FROM cl",
    ),
    "cluster_overview": (
        lambda s, d: E.overview(clusters(s, d)[0]),
        f"WITH {CLUSTERS} SELECT pass_id, title, members, first_date, last_date FROM cl",
    ),
    "contained_clusters": (
        lambda s, d: E.hierarchy(*clusters(s, d), "areas"),
        f"WITH {CLUSTERS} SELECT 'areas cluster ' || up AS coarse_cluster, title AS fine_cluster, members FROM cl WHERE up IS NOT NULL",
    ),
    "sub_clusters": (
        lambda s, d: E.sub_clusters(*clusters(s, d), "areas"),
        f"WITH {CLUSTERS} SELECT id, title, members, (SELECT count(*) FROM cl k WHERE k.up = cl.label) AS children FROM cl WHERE pass_id = 'areas'",
    ),
    "bridge_list": (
        bridge_list,
        f"""WITH {CENTRE}, s AS (SELECT e.id, c.label, round(sum(x * m), 6) AS similarity, row_number() OVER (PARTITION BY e.id ORDER BY sum(x * m) DESC, c.label) AS place
        FROM e JOIN l USING (id) JOIN c USING (pos) WHERE l.label < 0 GROUP BY 1, 2), two AS (SELECT * FROM s WHERE place <= 2)
        SELECT substr(sha256('bridge:areas:' || id), 1, 16) AS id, CAST(id AS VARCHAR) AS source_block_id, string_agg({CID.format("areas", "label")}, ',' ORDER BY place) AS near, substr(any_value(text), 1, 200) AS content
        FROM two JOIN documents ON doc_id = id WHERE id IN (SELECT id FROM two WHERE place = 2 AND similarity >= -0.05) GROUP BY two.id""",
    ),
    "fine_grid": (lambda s, d: E.fine_grid(vecs(s, d).select("id", "vec"), labels(s, d), 3, [16, 64], [5], [2, 4]), None),
    "compiled_pages": (
        compiled,
        """SELECT 'hubs/a-' || regexp_replace(c_name, '[^A-Za-z0-9_ -]', '', 'g') || '.md' AS rel_path, c_mktsegment AS content FROM customer
        UNION ALL SELECT 'concepts/' || p_name || '.md', CAST(max(p_partkey) AS VARCHAR) FROM part GROUP BY p_name
        UNION ALL SELECT unnest(['INDEX.md', 'RECENT.md', 'HEALTH.md']), r FROM (SELECT max_by(r_name, r_regionkey) AS r FROM region)""",
    ),
    "stream_context": (
        lambda s, d: K.stream_context(stream_files(s, d), wanted_streams(s, d).unionByName(table(s, d, "region").select(F.col("r_name").alias("name")))).withColumn("linked_sessions", F.size("linked_sessions")),
        f"""WITH {STREAMS} SELECT CASE WHEN CAST(regexp_extract(path, '[0-9]+') AS INTEGER) % 2 = 0 THEN lower(stream) ELSE upper(stream) END AS name, true AS found, stream, regexp_extract(path, '[0-9]+') AS slug, status, last_active,
        0 AS linked_sessions, context, left_off, log FROM st UNION ALL SELECT r_name, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region""",
    ),
    "settle": (
        settled,
        """WITH w AS (SELECT 'tasks/' || user_id || '.md' AS path, ts, CASE WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'active' END AS status FROM events),
        n AS (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, status) AS nxt FROM w)
        SELECT path, strftime(min(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS fire_at FROM n WHERE status = 'pending' AND
        (nxt - ts >= INTERVAL 6 HOUR OR (nxt IS NULL AND ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM w) - INTERVAL 1 MINUTE)) GROUP BY 1""",
    ),
    "ingest_cycle": (ingest_cycle, CYCLE),
    "finished_labels": (
        lambda s, d: I.finished_labels(named_labels(s, d)),
        f"WITH {NAMED} SELECT * FROM named WHERE trim(label) <> '' AND label <> 'NEEDS_REVIEW'",
    ),
    "left_to_label": (
        lambda s, d: I.left_to_label(lengths(s, d), named_labels(s, d)),
        f"WITH {NAMED} SELECT doc_id AS id, length(text) AS length FROM documents WHERE doc_id NOT IN (SELECT id FROM named WHERE trim(label) <> '' AND label <> 'NEEDS_REVIEW')",
    ),
    "tertile_samples": (
        lambda s, d: I.tertile_samples(lengths(s, d), 40),
        """WITH c AS (SELECT floor(quantile_cont(length(text), 0.33)) AS c0, floor(quantile_cont(length(text), 0.67)) AS c1 FROM documents),
        b AS (SELECT doc_id AS id, length(text) AS length, CASE WHEN length(text) <= c0 THEN 'short' WHEN length(text) <= c1 THEN 'medium' ELSE 'long' END AS bucket FROM documents, c)
        SELECT id, length, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256(id || ':42')) AS n FROM b) WHERE n <= 40""",
    ),
    "needs_content_vectors": (
        lambda s, d: M.needs_vectors(blocks(s, d), half_embedded(s, d), "content_only").select("id"),
        graph_sql("""|with| SELECT id FROM blocks WHERE kind = 'data_block' AND content <> '' AND id NOT IN (SELECT substr(sha256('seg:' || vec_id), 1, 16) FROM embeddings WHERE vec_id % 2 = 1)"""),
    ),
}
