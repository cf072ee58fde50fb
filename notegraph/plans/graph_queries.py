"""Graph, browse and table-maintenance queries with their SQL. name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.ids import doc_id, make_id, short_hash
from notegraph.operators import browse as B
from notegraph.operators import graph as G
from notegraph.operators import tables as T
from notegraph.plans.views import blocks, graph_sql, links, path_of, table

AS_OF = "1998-08-02"
#: Four weeks behind the last orders but one day: some tags are older, some are not.
LATER = "2001-08-28"


def _b(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf)


def _negative(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of customers in debt: the start set of walks and deletions."""
    return table(spark, sf, "customer").where("c_acctbal < 0").select(doc_id(path_of(F.col("c_custkey"))).alias("id"))


NEGATIVE = "neg AS (SELECT substr(sha256('doc:customers/' || c_custkey || '.md'), 1, 16) AS id FROM customer WHERE c_acctbal < 0)"


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("pos"), make_id(F.lit("seg"), F.col("event_id").cast("string")).alias("id"))


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as incoming links: a user's document to the segment with the event's number, often repeated."""
    ev = table(spark, sf, "events")
    return ev.select(
        doc_id(path_of(F.col("user_id"))).alias("from_id"),
        doc_id(path_of(F.col("user_id") + 1)).alias("to_id"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("weight"),
        "event_id",
    )


def _half_life(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of segments: orders of the known past, and all with finished ones changed."""
    o = table(spark, sf, "orders")
    path = path_of(F.col("o_custkey")).alias("source_path")
    text = F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus")
    old = o.where("o_orderdate < '1997-01-01'").select(path, short_hash(text).alias("hash"))
    new_text = F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return old, o.select(path, short_hash(new_text).alias("hash"))


SNAPSHOTS = """
old AS (SELECT 'customers/' || o_custkey || '.md' AS source_path, substr(sha256(o_orderkey || ' ' || o_orderstatus), 1, 16) AS hash FROM orders WHERE o_orderdate < '1997-01-01'),
new AS (SELECT 'customers/' || o_custkey || '.md' AS source_path,
  substr(sha256(o_orderkey || ' ' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END), 1, 16) AS hash FROM orders),
oldd AS (SELECT source_path, sha256(string_agg(hash, ',' ORDER BY hash)) AS hash FROM old GROUP BY 1),
newd AS (SELECT source_path, sha256(string_agg(hash, ',' ORDER BY hash)) AS hash FROM new GROUP BY 1),
status AS (SELECT coalesce(o.source_path, n.source_path) AS source_path,
  CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM oldd o FULL JOIN newd n USING (source_path)),
chg AS (SELECT source_path FROM status WHERE status <> 'unchanged'),
diff AS (SELECT coalesce(o.source_path, n.source_path) AS source_path, coalesce(o.hash, n.hash) AS hash,
  CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'kept' END AS status
  FROM (SELECT DISTINCT * FROM old WHERE source_path IN (FROM chg)) o FULL JOIN (SELECT DISTINCT * FROM new WHERE source_path IN (FROM chg)) n
  ON o.source_path = n.source_path AND o.hash = n.hash)
"""


def _documents_of(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source_path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ","), 256).alias("hash"))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _half_life(spark, sf)
    return T.change_status(_documents_of(new), _documents_of(old))


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _half_life(spark, sf)
    return T.segment_diff(old, new, _status(spark, sf).where("status <> 'unchanged'").select("source_path"))


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(make_id(F.lit("seg"), F.col("vec_id").cast("string")).alias("block_id"), "embedding")


EMBEDDED = "emb AS (SELECT substr(sha256('seg:' || vec_id), 1, 16) AS block_id FROM embeddings)"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(make_id(F.lit("seg"), F.col("vec_id").cast("string")).alias("id"), "label")


def merge_metadata(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    one = lambda *kv: F.create_map(*kv)
    rows = o.select(F.col("o_orderkey").alias("id"), one(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("metadata"))
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), one(F.lit("event"), F.col("event_type"), F.lit("status"), F.lit("seen")).alias("metadata"))
    out = T.merge_map(rows, ev, "id", "metadata")
    return out.select("id", *[F.element_at("metadata", k).alias(k) for k in ("status", "priority", "event")])


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    segs = table(spark, sf, "orders").select(
        make_id(F.lit("seg"), F.col("o_orderkey").cast("string")).alias("id"), F.create_map(F.lit("old"), F.col("o_orderstatus"), F.lit("p1"), F.lit("stale")).alias("assignments")
    )
    return T.assign_labels(segs, "p1", _labels(spark, sf)).select("id", F.element_at("assignments", "old").alias("old"), F.element_at("assignments", "p1").alias("p1"))


G_ = graph_sql
QUERIES = {
    "hub_scores": (
        lambda s, d: G.hub_scores(blocks(s, d), links(s, d)),
        G_("""|with| SELECT id, title, links_in, links_out, segments, round(0.5 * ln(1 + links_in) + 0.3 * ln(1 + links_out) + 0.2 * ln(1 + segments), 6) AS score FROM
        (SELECT b.id, b.title, (SELECT count(*) FROM links l WHERE l.to_id = b.id AND l.kind <> 'contains') AS links_in, (SELECT count(*) FROM links l WHERE l.from_id = b.id) AS links_out,
          (SELECT count(*) FROM links l WHERE l.to_id = b.id AND l.kind = 'contains') AS segments FROM blocks b WHERE b.kind = 'context_block:document')"""),
    ),
    "tag_details": (
        lambda s, d: G.tag_details(blocks(s, d), links(s, d)),
        G_("""|with| SELECT id, title, segments, links_in, links_out, last_active, round(0.5 * ln(1 + links_in + segments) + 0.3 * ln(1 + links_out) + 0.2 * ln(1 + segments), 6) AS score FROM
        (SELECT t.id, t.title, (SELECT count(*) FROM links l WHERE l.to_id = t.id AND l.kind = 'groups') AS segments, (SELECT count(*) FROM links l WHERE l.to_id = t.id AND l.kind <> 'groups') AS links_in,
          (SELECT count(*) FROM links l WHERE l.from_id = t.id) AS links_out, (SELECT max(e.block_time) FROM blocks e JOIN links l ON l.from_id = e.id WHERE l.to_id = t.id AND l.kind = 'groups') AS last_active
          FROM blocks t WHERE t.kind = 'context_block:tag')"""),
    ),
    "cooccurring_tags": (
        lambda s, d: G.cooccurring_tags(blocks(s, d), links(s, d), 10),
        G_("""|with| SELECT t.title AS tag, o.title AS other, shared FROM (SELECT a.to_id AS x, b.to_id AS y, count(*) AS shared,
          row_number() OVER (PARTITION BY a.to_id ORDER BY count(*) DESC, b.to_id) AS n FROM links a JOIN links b ON a.from_id = b.from_id AND a.to_id <> b.to_id
          WHERE a.kind = 'groups' AND b.kind = 'groups' GROUP BY 1, 2) JOIN blocks t ON t.id = x JOIN blocks o ON o.id = y WHERE n <= 10"""),
    ),
    "orphans": (
        lambda s, d: G.orphans(blocks(s, d), links(s, d).where("kind <> 'links_to'")).select("id", "title"),
        G_("""|with| SELECT id, title FROM blocks b WHERE kind = 'data_block' AND NOT EXISTS (SELECT 1 FROM links WHERE kind = 'groups' AND (from_id = b.id OR to_id = b.id))"""),
    ),
    "stale_tags": (
        lambda s, d: G.stale_tags(blocks(s, d), links(s, d), F.lit(LATER).cast("date"), 4),
        G_(f"""|with| SELECT t.id, t.title, count(*) AS segments, max(b.block_time) AS last_active FROM blocks t JOIN links l ON l.to_id = t.id AND l.kind = 'groups' JOIN blocks b ON b.id = l.from_id
        WHERE t.kind = 'context_block:tag' GROUP BY 1, 2 HAVING max(b.block_time) < strftime(DATE '{LATER}' - INTERVAL 28 DAY, '%Y-%m-%d')"""),
    ),
    "stats": (
        lambda s, d: G.stats(blocks(s, d), links(s, d), _embedded(s, d)),
        G_(f"""{EMBEDDED} |with| SELECT 'blocks' AS metric, kind, count(*) AS n FROM blocks GROUP BY kind UNION ALL SELECT 'links', kind, count(*) FROM links GROUP BY kind
        UNION ALL SELECT 'embedded', 'all', count(DISTINCT block_id) FROM emb"""),
    ),
    "links_of": (
        lambda s, d: G.links_of(links(s, d), _negative(s, d), "to", "links_to"),
        G_(f"{NEGATIVE} |with| SELECT from_id, to_id, kind FROM links WHERE kind = 'links_to' AND to_id IN (FROM neg)"),
    ),
    "related": (
        lambda s, d: G.related(blocks(s, d), links(s, d), _negative(s, d), 5),
        G_(f"""{NEGATIVE}, both_ways AS (SELECT from_id AS start_id, to_id AS id, kind AS link_kind, 'outgoing' AS direction FROM links WHERE from_id IN (FROM neg)
        UNION ALL SELECT to_id, from_id, kind, 'incoming' FROM links WHERE to_id IN (FROM neg)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY start_id, direction ORDER BY link_kind, id) AS n FROM both_ways)
        |with| SELECT start_id, r.id, b.kind, b.title, link_kind, direction FROM ranked r JOIN blocks b ON b.id = r.id WHERE n <= 5"""),
    ),
    "related_filtered": (
        lambda s, d: G.related(blocks(s, d), links(s, d), _negative(s, d), 3, "links_to", "incoming"),
        G_(f"""{NEGATIVE}, r AS (SELECT to_id AS start_id, from_id AS id, kind AS link_kind, row_number() OVER (PARTITION BY to_id ORDER BY kind, from_id) AS n FROM links WHERE kind = 'links_to' AND to_id IN (FROM neg))
        |with| SELECT start_id, r.id, b.kind, b.title, link_kind, 'incoming' AS direction FROM r JOIN blocks b ON b.id = r.id WHERE n <= 3"""),
    ),
    "delete_by_source": (
        lambda s, d: T.delete_where(blocks(s, d), links(s, d), source="1-URGENT")[1],
        G_("""gone AS (SELECT id FROM blocks WHERE source = '1-URGENT') |with| SELECT * FROM links WHERE from_id NOT IN (FROM gone) AND to_id NOT IN (FROM gone)"""),
    ),
    "traverse": (
        lambda s, d: G.traverse(links(s, d), _negative(s, d), 2, ["contains", "links_to"]),
        G_(f"""{NEGATIVE}, e AS (SELECT from_id AS a, to_id AS b FROM links WHERE kind IN ('contains', 'links_to') UNION SELECT to_id, from_id FROM links WHERE kind IN ('contains', 'links_to')),
        h1 AS (SELECT DISTINCT t.id AS s, e.b AS id FROM neg t JOIN e ON e.a = t.id), h2 AS (SELECT DISTINCT s, e.b AS id FROM h1 JOIN e ON e.a = h1.id)
        |with| SELECT start_id, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT id AS start_id, id, 0 AS depth FROM neg UNION ALL SELECT s, id, 1 FROM h1 UNION ALL SELECT s, id, 2 FROM h2) GROUP BY 1, 2"""),
    ),
    "hub_members": (
        lambda s, d: G.hub_members(links(s, d), _negative(s, d)),
        G_(f"""{NEGATIVE} |with| SELECT from_id AS id, to_id AS hub_id, n AS links FROM (SELECT from_id, to_id, count(*) AS n, row_number() OVER (PARTITION BY from_id ORDER BY count(*) DESC, to_id) AS r
        FROM links WHERE to_id IN (FROM neg) GROUP BY 1, 2) WHERE r = 1"""),
    ),
    "hub_members_dated": (
        lambda s, d: G.hub_members_dated(blocks(s, d), links(s, d), 8),
        G_("""|with| SELECT hub_id, b.id, b.block_time, CAST(row_number() OVER (PARTITION BY hub_id ORDER BY b.block_time, b.id) AS INTEGER) AS place
        FROM (SELECT DISTINCT from_id, to_id AS hub_id FROM links WHERE kind IN ('contains', 'links_to')) l JOIN blocks b ON b.id = l.from_id
        WHERE b.kind = 'data_block' AND block_time IS NOT NULL AND length(content) > 8"""),
    ),
    "doc_segments": (
        lambda s, d: G.doc_segments(blocks(s, d), links(s, d)),
        G_("|with| SELECT l.to_id AS doc, b.id, b.title, b.block_time FROM links l JOIN blocks b ON b.id = l.from_id WHERE l.kind = 'contains' AND b.kind = 'data_block'"),
    ),
    "tag_segments": (
        lambda s, d: G.tag_segments(blocks(s, d), links(s, d), 10),
        G_("""|with| SELECT * FROM (SELECT l.to_id AS tag, b.id, b.title, b.block_time, CAST(row_number() OVER (PARTITION BY l.to_id ORDER BY b.block_time DESC NULLS LAST, b.id) AS INTEGER) AS n
        FROM links l JOIN blocks b ON b.id = l.from_id WHERE l.kind = 'groups' AND b.kind = 'data_block') WHERE n <= 10"""),
    ),
    "note_view": (
        lambda s, d: G.note_view(blocks(s, d), links(s, d)),
        G_("""|with| SELECT b.id, b.title, coalesce(h.segments, 0) AS segments, h.newest, coalesce(i.n, 0) AS incoming, coalesce(o.n, 0) AS outgoing FROM blocks b
        LEFT JOIN (SELECT l.to_id, count(*) AS segments, max(s.block_time) AS newest FROM links l JOIN blocks s ON s.id = l.from_id WHERE l.kind = 'contains' GROUP BY 1) h ON h.to_id = b.id
        LEFT JOIN (SELECT to_id, count(*) AS n FROM links GROUP BY 1) i ON i.to_id = b.id
        LEFT JOIN (SELECT from_id, count(*) AS n FROM links GROUP BY 1) o ON o.from_id = b.id WHERE b.kind = 'context_block:document'"""),
    ),
    "valid_links": (
        lambda s, d: G.valid_links(links(s, d), blocks(s, d))[0],
        G_("|with| SELECT * FROM links WHERE from_id IN (SELECT id FROM blocks) AND to_id IN (SELECT id FROM blocks)"),
    ),
    "unresolved_links": (
        lambda s, d: G.valid_links(links(s, d), blocks(s, d))[1],
        G_("|with| SELECT * FROM links WHERE NOT (from_id IN (SELECT id FROM blocks) AND to_id IN (SELECT id FROM blocks))"),
    ),
    "browse": (
        lambda s, d: B.page(B.browse(_b(s, d), "data_block", "1-URGENT", "1994-01-01", "1996-12-31"), 50, 10).select("id", "title", "block_time"),
        G_("""|with| SELECT id, title, block_time FROM blocks WHERE kind = 'data_block' AND source = '1-URGENT' AND block_time >= '1994-01-01' AND block_time <= '1996-12-31'
        ORDER BY block_time DESC NULLS LAST, id LIMIT 50 OFFSET 10"""),
    ),
    "browse_total": (
        lambda s, d: B.browse(_b(s, d), "data_block").groupBy("source").agg(F.count("*").alias("total")),
        G_("|with| SELECT source, count(*) AS total FROM blocks WHERE kind = 'data_block' GROUP BY 1"),
    ),
    "by_kind": (
        lambda s, d: B.page(B.browse(_b(s, d), "data_block"), 100).select("id", "title", "block_time"),
        G_("|with| SELECT id, title, block_time FROM blocks WHERE kind = 'data_block' ORDER BY block_time DESC NULLS LAST, id LIMIT 100"),
    ),
    "recent": (
        lambda s, d: B.recent(_b(s, d), 25).select("id", "kind", "block_time"),
        G_("|with| SELECT id, kind, block_time FROM blocks ORDER BY block_time DESC NULLS LAST, id LIMIT 25"),
    ),
    "recent_days": (
        lambda s, d: B.recent_days(_b(s, d), 90, F.lit(AS_OF).cast("date"), "data_block").select("id", "block_time"),
        G_(f"|with| SELECT id, block_time FROM blocks WHERE kind = 'data_block' AND block_time >= strftime(DATE '{AS_OF}' - INTERVAL 90 DAY, '%Y-%m-%d')"),
    ),
    "since": (
        lambda s, d: B.since(_b(s, d), "1998-01-01T09:30:00", "data_block").select("id", "block_time"),
        G_("|with| SELECT id, block_time FROM blocks WHERE kind = 'data_block' AND block_time >= '1998-01-01'"),
    ),
    "summary_view": (
        lambda s, d: B.summary(_b(s, d), 5),
        G_("|with| SELECT id, kind, title, source, block_time, substr(content, 1, 5) AS content FROM blocks"),
    ),
    "timeline_filter": (
        lambda s, d: B.timeline(_b(s, d), "1995-06-30", None, "urgent").select("id", "block_time"),
        G_("|with| SELECT id, block_time FROM blocks WHERE substr(block_time, 1, 10) <= '1995-06-30' AND (lower(content) LIKE '%urgent%' OR lower(source_path) LIKE '%urgent%')"),
    ),
    "block_lookup": (
        lambda s, d: B.lookup(_b(s, d).select("id", "title"), _wanted(s, d)).select("pos", "id", "title", "found"),
        G_("|with| SELECT e.event_id AS pos, substr(sha256('seg:' || e.event_id), 1, 16) AS id, b.title, b.id IS NOT NULL AS found FROM events e LEFT JOIN blocks b ON b.id = substr(sha256('seg:' || e.event_id), 1, 16)"),
    ),
    "insert_ignore": (
        lambda s, d: T.insert_ignore(links(s, d), _visits(s, d), ["from_id", "to_id", "kind"], ["event_id"]),
        G_("""|with| SELECT from_id, to_id, kind, weight, event_id FROM (SELECT substr(sha256('doc:customers/' || user_id || '.md'), 1, 16) AS from_id, substr(sha256('doc:customers/' || (user_id + 1) || '.md'), 1, 16) AS to_id,
        event_type AS kind, value AS weight, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) v WHERE n = 1
        AND NOT EXISTS (SELECT 1 FROM links l WHERE l.from_id = v.from_id AND l.to_id = v.to_id AND l.kind = v.kind)"""),
    ),
    "delete_cascade": (
        lambda s, d: T.delete_cascade(blocks(s, d), links(s, d), _negative(s, d))[1],
        G_(f"{NEGATIVE} |with| SELECT * FROM links WHERE from_id NOT IN (FROM neg) AND to_id NOT IN (FROM neg)"),
    ),
    "merge_metadata": (
        merge_metadata,
        """SELECT o_orderkey AS id, CASE WHEN event_id IS NULL THEN o_orderstatus ELSE 'seen' END AS status, o_orderpriority AS priority, event_type AS event
        FROM orders LEFT JOIN events ON event_id = o_orderkey""",
    ),
    "assign_labels": (
        assigned,
        "SELECT substr(sha256('seg:' || o_orderkey), 1, 16) AS id, o_orderstatus AS old, CAST(label AS VARCHAR) AS p1 FROM orders LEFT JOIN embeddings ON vec_id = o_orderkey",
    ),
    "change_detect": (_status, f"WITH {SNAPSHOTS} SELECT * FROM status"),
    "segment_diff": (_diff, f"WITH {SNAPSHOTS} SELECT * FROM diff"),
    "ingest_report": (
        lambda s, d: T.report(_diff(s, d)),
        f"WITH {SNAPSHOTS} SELECT status, count(*) AS n, count(DISTINCT source_path) AS files FROM diff GROUP BY 1",
    ),
    "known_hashes": (
        lambda s, d: _documents_of(_half_life(s, d)[0]),
        f"WITH {SNAPSHOTS} SELECT * FROM oldd",
    ),
    "update_doc_hash": (
        lambda s, d: T.upsert(_documents_of(_half_life(s, d)[0]), _documents_of(_half_life(s, d)[1]), ["source_path"]),
        f"WITH {SNAPSHOTS} SELECT source_path, coalesce(n.hash, o.hash) AS hash FROM oldd o FULL JOIN newd n USING (source_path)",
    ),
    "needs_embedding": (
        lambda s, d: T.needs_vectors(blocks(s, d), _embedded(s, d)).select("id"),
        G_(f"{EMBEDDED} |with| SELECT id FROM blocks WHERE kind = 'data_block' AND content <> '' AND id NOT IN (SELECT block_id FROM emb)"),
    ),
    "embedded_blocks": (
        lambda s, d: T.with_vectors(blocks(s, d), _embedded(s, d)).select("id", "title"),
        G_(f"{EMBEDDED} |with| SELECT id, title FROM blocks WHERE id IN (SELECT block_id FROM emb)"),
    ),
    "same_cluster": (
        lambda s, d: B.same_label(_labels(s, d), table(s, d, "benchmark").select(make_id(F.lit("seg"), F.col("item_id").cast("string")).alias("id"))),
        """SELECT substr(sha256('seg:' || a.vec_id), 1, 16) AS start_id, substr(sha256('seg:' || b.vec_id), 1, 16) AS id, b.label FROM embeddings a JOIN embeddings b ON a.label = b.label
        WHERE a.vec_id IN (SELECT item_id FROM benchmark)""",
    ),
}
