"""Streaming queries over the events and documents, embedding jobs, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.ids import doc_id, make_id
from notegraph.operators import browse as B
from notegraph.operators import cluster as C
from notegraph.operators import embed as M
from notegraph.operators import tables as T
from notegraph.operators import text as X
from notegraph.plans.graph_queries import _embedded
from notegraph.plans.text_queries import MARKED, events_stream
from notegraph.plans.vector_queries import labels, vecs
from notegraph.plans.views import blocks, graph_sql, marked_notes, order_tags, path_of, table
from notegraph.sources.notes import render_pages
from notegraph.streaming import changes as S


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of the note of their user; errors are of a file that is no note, logins of an excluded folder."""
    e = S.read_table(spark, f"{sf}/events.parquet")
    ext = F.when(F.col("event_type") == "error", ".txt").otherwise(".md")
    folder = F.when(F.col("event_type") == "login", ".trash/").otherwise("notes/")
    return e.select(F.concat(folder, F.col("user_id").cast("string"), ext).alias("path"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("props").alias("content"))


SEEN = """w AS (SELECT CASE event_type WHEN 'login' THEN '.trash/' ELSE 'notes/' END || user_id || CASE event_type WHEN 'error' THEN '.txt' ELSE '.md' END AS path, ts FROM events),
n AS (SELECT * FROM w WHERE ends_with(path, '.md') AND NOT starts_with(path, '.trash'))"""


def stream_notes(spark: SparkSession, sf: str) -> DataFrame:
    got = S.run_available(S.watch(changes(spark, sf), [".trash/**"]), "watch")
    return got.groupBy("path").agg(F.count("*").alias("n"))


def dedupe_changes(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_available(S.dedupe(S.watch(changes(spark, sf), [".trash/**"])), "dedupe").select("path")


def debounce(spark: SparkSession, sf: str) -> DataFrame:
    got = S.run_available(S.debounce(S.watch(changes(spark, sf), [".trash/**"]), "6 hours", "1 minute"), "debounce")
    return got.select("path", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Marked notes arrive as changes, are split and numbered; the same as the batch split."""
    d = S.read_table(spark, f"{sf}/documents.parquet")
    content = F.concat(F.lit("## "), "source", F.lit("\n"), F.col("text"), F.lit("\nzzz check "), "lang", F.lit("\n"))
    rows = d.select(F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"), F.lit("2024-01-01").cast("timestamp").alias("event_ts"))
    got = S.ingest(rows, X.split_notes, "ingest")
    return got.select("path", "section_heading", F.array_join("instructions", ",").alias("instructions"), F.sha2("clean_content", 256).alias("sha"))


def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = S.read_table(spark, f"{sf}/events.parquet")
    when = lambda k, v: F.when(F.col("event_type") == k, v)
    text = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    rows = e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("slug"), F.col("event_id").alias("seq"), when("purchase", text).alias("left_off"), when("click", text).alias("context"),
        when("view", F.lit("active")).alias("status"), F.when(~F.col("event_type").isin("purchase", "click", "view"), text).alias("log"), F.date_format("ts", "yyyy-MM-dd").alias("session"),
    )
    got = S.run_available(S.fold(rows), "fold", "update")
    last = got.groupBy("slug").agg(F.max_by(F.struct("left_off", "context", "status", "log", "sessions"), "batch").alias("s"))
    return last.select("slug", "s.*")


def vectors_after(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of even numbers are written anew, negated."""
    old = _embedded(spark, sf).select("block_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))
    ev = table(spark, sf, "benchmark").select(make_id(F.lit("seg"), F.col("item_id").cast("string")).alias("block_id"), F.lit(9.0).alias("first"))
    return T.upsert(old, ev, ["block_id"])


def embedded_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of segments (even numbers) and of documents (odd ones)."""
    e, key = table(spark, sf, "embeddings"), F.col("vec_id").cast("string")
    of = F.when(F.col("vec_id") % 2 == 0, make_id(F.lit("seg"), key)).otherwise(doc_id(path_of(F.col("vec_id"))))
    return e.select(of.alias("block_id"), "embedding")


def embedded_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("data_block").alias("kind"), F.col("text").alias("content"))
    have = table(spark, sf, "labels").select(F.col("doc_id").alias("block_id"))
    got = M.embed_missing(d, have, M.HashingModel)
    return got.select("block_id", F.size("vec").alias("dim"), "error")


def tagged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("block_time"))
    t = order_tags(spark, sf).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return o.join(t, "id", "left")


def _two_tags(spark: SparkSession, sf: str) -> list[str]:
    return [r[0] for r in table(spark, sf, "part").select("p_name").distinct().orderBy("p_name").limit(2).collect()]


QUERIES = {
    "stream_notes": (stream_notes, f"WITH {SEEN} SELECT path, count(*) AS n FROM n GROUP BY 1"),
    "dedupe_changes": (dedupe_changes, f"WITH {SEEN} SELECT DISTINCT path FROM n"),
    "debounce": (
        debounce,
        f"""WITH {SEEN}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM n),
        s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
        x AS (SELECT path, min(ts) AS first, max(ts) + INTERVAL 6 HOUR AS fire, count(*) AS n FROM s GROUP BY path, k)
        SELECT path, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, n FROM x WHERE fire <= (SELECT max(ts) FROM n) - INTERVAL 1 MINUTE""",
    ),
    "stream_ingest": (
        stream_ingest,
        """SELECT 'n/' || doc_id || '.md' AS path, source AS section_heading, 'check ' || lang AS instructions,
        sha256(trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ')) AS sha FROM documents""",
    ),
    "stream_fold": (
        stream_fold,
        """WITH e AS (SELECT 'user-' || user_id AS slug, event_id AS seq, event_type AS k, event_type || ' ' || event_id AS t, strftime(ts, '%Y-%m-%d') AS day FROM events)
        SELECT slug, max_by(t, seq) FILTER (k = 'purchase') AS left_off, max_by(t, seq) FILTER (k = 'click') AS context, max(CASE WHEN k = 'view' THEN 'active' END) AS status,
        coalesce(string_agg(t, chr(10) ORDER BY seq) FILTER (k NOT IN ('purchase', 'click', 'view')), '') AS log, string_agg(DISTINCT day, ',' ORDER BY day) AS sessions FROM e GROUP BY 1""",
    ),
    "embed_blocks": (
        embedded_docs,
        "SELECT doc_id AS block_id, 64 AS dim, CAST(NULL AS VARCHAR) AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND trim(text) <> ''",
    ),
    "write_vectors": (
        vectors_after,
        """SELECT substr(sha256('seg:' || vec_id), 1, 16) AS block_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)
        UNION ALL SELECT substr(sha256('seg:' || item_id), 1, 16), 9.0 FROM benchmark""",
    ),
    "reset_vectors": (
        lambda s, d: M.reset(embedded_kinds(s, d), blocks(s, d), "data_block").select("block_id"),
        graph_sql("""emb2 AS (SELECT substr(sha256(CASE vec_id % 2 WHEN 0 THEN 'seg:' || vec_id ELSE 'doc:customers/' || vec_id || '.md' END), 1, 16) AS block_id FROM embeddings)
        |with| SELECT block_id FROM emb2 WHERE block_id NOT IN (SELECT id FROM blocks WHERE kind = 'data_block')"""),
    ),
    "browse_tags": (
        lambda s, d: B.page(B.tagged(tagged_blocks(s, d), _two_tags(s, d)), 100).select("id", "block_time"),
        """WITH two AS (SELECT DISTINCT p_name FROM part ORDER BY 1 LIMIT 2) SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS block_time FROM orders
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name IN (FROM two)) ORDER BY 2 DESC, 1 LIMIT 100""",
    ),
    "render_pages": (
        lambda s, d: render_pages(blocks(s, d).where("kind <> 'data_block'")).select("rel_path", F.sha2("content", 256).alias("sha")),
        graph_sql("""|with| SELECT CASE kind WHEN 'context_block:tag' THEN 'tags/' ELSE 'notes/' END || substr(trim(regexp_replace(title, '[\\\\/:*?"<>|]', '-', 'g')), 1, 100) || '.md' AS rel_path,
        sha256('# ' || title || chr(10) || chr(10) || coalesce(content, '')) AS sha FROM blocks WHERE kind <> 'data_block'"""),
    ),
    "ordered_unique": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("n")),
        "SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n FROM documents",
    ),
    "drill_subset": (lambda s, d: C.kmeans(vecs(s, d).select("id", "vec").join(labels(s, d).where("label = 3").select("id"), "id", "left_semi"), 3), None),
    "workstream_events": (
        lambda s, d: events_stream(s, d).groupBy("session").agg(F.count("*").alias("n"), F.count("left_off").alias("left_offs")),
        "SELECT strftime(ts, '%Y-%m-%d') AS session, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS left_offs FROM events GROUP BY 1",
    ),
    "export_segments": (
        lambda s, d: X.split_notes(marked_notes(s, d).select("path", "content")).select(F.to_json(F.struct("path", "section_date", "tags", "links")).alias("line")),
        f"""WITH {MARKED}, q AS (SELECT path, day, coalesce(array_to_string(list_transform(tags, lambda x: '"' || x || '"'), ','), '') AS t, coalesce(array_to_string(list_transform(links, lambda x: '"' || x || '"'), ','), '') AS l FROM s)
        SELECT '{{"path":"' || path || '","section_date":"' || day || '","tags":[' || t || '],"links":[' || l || ']}}' AS line FROM q""",
    ),
}
