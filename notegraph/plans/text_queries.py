"""Text and task queries over the documents, conversations and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.ids import segment_id
from notegraph.operators import tasks as K
from notegraph.operators import text as X
from notegraph.plans.views import conversation_notes, marked_notes, notes, table
from notegraph.session import spread

DAY = "printf('%04d-%02d-%02d', 2000 + doc_id % 25, 1 + doc_id % 12, 1 + doc_id % 28)"
#: The three segments of each note of ``marked_notes``: the text with what is behind it, the fence, the part behind the marker.
MARKED = f"""m AS (SELECT doc_id, lang, source, 'n/' || doc_id || '.md' AS path, {DAY} AS day, regexp_replace(text, '^\\s+', '') AS text,
  chr(10) || 'see [[' || source || '|alias]] and #lang/' || lang AS seen FROM documents),
c AS (SELECT *, regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g') || seen AS clean_content, text || seen || chr(10) || 'zzz review ' || source AS content FROM m),
h AS (SELECT *, regexp_extract_all(clean_content, '(?:^|[^\\w\\p{{L}}\\p{{N}}])#([a-zA-Z0-9_/\\-]+)', 1) AS found FROM c),
s AS (SELECT doc_id, lang, source, path, day, content, clean_content, 'review ' || source AS instructions, list_filter(found, lambda x, i: list_position(found, x) = i) AS tags, [source] AS links, day || ' heading' AS heading FROM h
  UNION ALL SELECT doc_id, lang, source, path, day, t, t, '', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 'Second' FROM (SELECT *, '```' || chr(10) || '# not a heading' || chr(10) || '```' AS t FROM m)
  UNION ALL SELECT doc_id, lang, source, path, day, 'last ' || lang, 'last ' || lang, '', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 'Second' FROM m)"""
GRAPH = f"{MARKED}, g AS (SELECT substr(sha256(path || ':' || substr(sha256(content), 1, 16)), 1, 16) AS id, list_distinct([lang, source] || tags) AS all_tags, * FROM s)"


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return X.split_notes(marked_notes(spark, sf).select("path", "content"))


def split_notes(spark: SparkSession, sf: str) -> DataFrame:
    seg = X.with_granularity(_segments(spark, sf))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return seg.select("path", F.sha2("content", 256).alias("content_sha"), F.sha2("clean_content", 256).alias("clean_sha"), joined("instructions"), joined("tags"), joined("links"), "section_heading", "section_date", "granularity", "raw_hash")


def heading_sections(spark: SparkSession, sf: str) -> DataFrame:
    seg = X.split_notes(conversation_notes(spark, sf))
    return seg.select("path", "section_heading", F.regexp_replace("content", r"(?U)\s+", " ").alias("words"))


def marker_split(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation between marker lines come back as segments."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n qQq \n")
    whole = c.groupBy("conv_id").agg(text.alias("content"))
    parts = whole.select("conv_id", F.posexplode(F.split("content", X.MARKER, -1)).alias("part", "raw"))
    return parts.select("conv_id", "part", F.regexp_replace(X.strip(F.col("raw")), r"(?U)\s+", " ").alias("words"))


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = marked_notes(spark, sf).select("path", "content")
    b, k = X.graph_rows(n, X.split_notes(n))
    return b.groupBy("kind").agg(F.count_distinct("id").alias("n")).unionByName(k.groupBy("kind").agg(F.count("*").alias("n")))


def build_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = marked_notes(spark, sf).select("path", "content")
    return X.graph_rows(n, X.split_notes(n))[1]


def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    """Documents link to their source; a note of that name exists for half of the sources."""
    seg = _segments(spark, sf)
    homes = table(spark, sf, "documents").select("source").distinct().where("cast(substring(source, 4) as int) < 10")
    return X.resolve_links(seg, homes.select(F.concat(F.lit("home/"), "source", F.lit(".md")).alias("path"))).select("path", "target", "target_path")


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Each raw document, its own signs, lines and addresses in it, behind noise that the cleaning must remove."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    noisy = F.concat(F.lit("> **note** ![pic](http://x.y/z.png) [anchor](http://a.b) http://raw.url/x\n- [ ] task\n---\n\n\n\n"), "text")
    return d.select("doc_id", F.sha2(F.regexp_replace(X.clean(noisy), r"(?U)\s+", " "), 256).alias("sha"))


def tagged_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The raw documents with tags before and behind, one of them twice, and what is no tag."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("#"), "lang", F.lit(" "), "text", F.lit(" #a/"), "source", F.lit(",#"), "lang", F.lit(" x#no")).alias("content"))


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as workstream updates: views set the status, clicks the context, others add a log line."""
    e = table(spark, sf, "events")
    when = lambda k, v: F.when(F.col("event_type") == k, v)
    text = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    return e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("slug"),
        F.col("event_id").alias("seq"),
        when("purchase", text).alias("left_off"),
        when("click", text).alias("context"),
        when("view", F.lit("active")).alias("status"),
        F.when(~F.col("event_type").isin("purchase", "click", "view"), text).alias("log"),
        F.date_format("ts", "yyyy-MM-dd").alias("session"),
    )


def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as workstream files."""
    c = table(spark, sf, "customer")
    content = F.concat(
        F.lit("---\nstream: "), "c_name", F.lit("\nstatus: "), F.when(F.col("c_acctbal") > 0, "active").otherwise("paused"), F.lit("\nlast_active: 2024-01-"), F.format_string("%02d", 1 + F.col("c_custkey") % 28),
        F.lit("\n---\n# x\n\n## Context\n\nsegment "), "c_mktsegment", F.lit("\n\n## LEFT OFF\nbalance of "), "c_name", F.lit("\n\n## Log\n- one\n- two\n"),
    )
    return c.select(F.concat(F.lit("streams/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


STREAMS = """st AS (SELECT 'streams/' || c_custkey || '.md' AS path, c_name AS stream, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'paused' END AS status,
  '2024-01-' || printf('%02d', 1 + c_custkey % 28) AS last_active, 'segment ' || c_mktsegment AS context, 'balance of ' || c_name AS left_off, '- one' || chr(10) || '- two' AS log FROM customer)"""


def wanted_streams(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(F.upper("c_name")).alias("name"))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    seg = _segments(spark, sf).withColumn("id", segment_id(F.col("path"), F.col("content")))
    return K.dispatch(seg)


def task_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as task files, changed when ordered."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "active").otherwise("done")
    text = F.concat(F.lit("---\nstatus: "), status, F.lit("\nowner: x\n---\nsee [[c"), F.col("o_custkey").cast("string"), F.lit("]] and [[c"), F.col("o_custkey").cast("string"), F.lit("]] [[b]]\n"))
    return o.select(F.concat(F.lit("tasks/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), text.alias("content"), F.col("o_orderdate").cast("timestamp").alias("mtime"))


def label_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Label tables as prose replies with a fenced JSON array, one reply a document."""
    lab = table(spark, sf, "labels")
    item = F.concat(F.lit('[{"id": '), F.col("doc_id").cast("string"), F.lit(', "quality": '), F.col("quality").cast("string"), F.lit("}]"))
    raw = F.when(F.col("toxic") == 1, F.concat(F.lit("Here it is:\n```json\n"), item, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Sure: "), item, F.lit(" ok")))
    rows = lab.select(raw.alias("raw"))
    return rows.select(F.explode(X.json_rows(F.col("raw"), "array<struct<id:bigint,quality:int>>")).alias("x")).select("x.id", "x.quality")


EXCLUDE = ["src1/**", "**/src2/**", "*1.md", "src3", "**/7.md"]
QUERIES = {
    "split_notes": (
        split_notes,
        f"""WITH {MARKED} SELECT path, sha256(content) AS content_sha, sha256(clean_content) AS clean_sha, instructions, array_to_string(tags, ',') AS tags, array_to_string(links, ',') AS links,
        heading AS section_heading, day AS section_date, 'section' AS granularity, substr(sha256(content), 1, 16) AS raw_hash FROM s""",
    ),
    "front_matter": (
        lambda s, d: marked_notes(s, d).select("path", F.array_join(X.front_tags(F.col("content")), ",").alias("tags"), F.sha2(X.body(F.col("content")), 256).alias("body_sha")),
        f"""SELECT 'n/' || doc_id || '.md' AS path, lang || ',' || source AS tags, sha256('## ' || {DAY} || ' heading' || chr(10) || text || chr(10) || 'see [[' || source
        || '|alias]] and #lang/' || lang || chr(10) || 'zzz review ' || source || chr(10) || '# Second' || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || ' qQq' || chr(10) || 'last ' || lang || chr(10)) AS body_sha FROM documents""",
    ),
    "heading_sections": (
        heading_sections,
        """SELECT 'conv/' || conv_id || '.md' AS path, turn || ' ' || role AS section_heading, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS words
        FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""",
    ),
    "marker_split": (
        marker_split,
        """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS part, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS words FROM conversations""",
    ),
    "inline_tags": (
        lambda s, d: tagged_notes(s, d).select("doc_id", F.explode(X.tags(F.col("content"))).alias("tag")),
        """SELECT doc_id, unnest(list_distinct(regexp_extract_all('#' || lang || ' ' || text || ' #a/' || source || ',#' || lang || ' x#no', '(?:^|[^\\w\\p{L}\\p{N}])#([a-zA-Z0-9_/\\-]+)', 1))) AS tag FROM documents""",
    ),
    "wikilinks": (
        lambda s, d: marked_notes(s, d).select("path", F.explode(X.wikilinks(F.col("content"))).alias("link")),
        "SELECT 'n/' || doc_id || '.md' AS path, source AS link FROM documents",
    ),
    "instructions": (
        lambda s, d: marked_notes(s, d).select("path", F.explode(X.instructions(X.body(F.col("content")))).alias("instruction")),
        "SELECT 'n/' || doc_id || '.md' AS path, 'review ' || source AS instruction FROM documents",
    ),
    "meaningful_filter": (
        lambda s, d: notes(s, d).select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where(X.meaningful(F.col("line"))).groupBy("path").agg(F.count("*").alias("lines")),
        """SELECT path, count(*) AS lines FROM (SELECT source || '/' || doc_id || '.md' AS path, unnest(string_split(text, chr(10))) AS line FROM documents)
        WHERE NOT regexp_matches(line, '^\\s*(|---|-\\s+\\[\\s*\\]|-|-\\s+[xX]|-?\\s*https?://\\S+)\\s*$') GROUP BY 1""",
    ),
    "clean_text": (
        cleaned,
        """SELECT doc_id, sha256('note anchor task' || CASE WHEN t = '' THEN '' ELSE ' ' || t END) AS sha FROM
        (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^>[\\t ]?', '', 'g'), 'https?://\\S+', '', 'g'),
        '(?s)\\*{1,3}(.*?)\\*{1,3}|_{1,3}(.*?)_{1,3}', '\\1\\2', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)""",
    ),
    "content_ids": (
        lambda s, d: notes(s, d).select("path", segment_id(F.col("path"), F.col("content")).alias("id")),
        "SELECT p AS path, substr(sha256(p || ':' || substr(sha256(text), 1, 16)), 1, 16) AS id FROM (SELECT source || '/' || doc_id || '.md' AS p, text FROM documents)",
    ),
    "exclude_paths": (
        lambda s, d: notes(s, d).where(~X.excluded(F.col("path"), EXCLUDE)).select("path"),
        """SELECT path FROM (SELECT source || '/' || doc_id || '.md' AS path FROM documents) WHERE NOT (starts_with(path, 'src1/') OR contains('/' || path, '/src2/')
        OR ends_with(path, '1.md') OR starts_with(path, 'src3/') OR ends_with(path, '/7.md'))""",
    ),
    "filename_date": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", X.filename_date(F.concat(F.lit("journal/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" note.md"))).alias("day")),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    ),
    "weekly_date": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", X.weekly_date(F.concat(F.lit("WK - "), F.date_format("o_orderdate", "yy-MM-dd"), F.lit(".md"))).alias("day")),
        "SELECT o_orderkey, '20' || strftime(o_orderdate, '%y-%m-%d') AS day FROM orders",
    ),
    "valid_date": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.valid_date(F.format_string("%04d-%02d-%02d", 1990 + F.col("l_linenumber"), 1 + F.col("l_orderkey") % 14, 1 + F.col("l_partkey") % 31)).alias("day")),
        """SELECT l_orderkey, l_linenumber, CASE WHEN try_cast(t AS DATE) IS NOT NULL THEN t END AS day FROM
        (SELECT *, printf('%04d-%02d-%02d', 1990 + l_linenumber, 1 + l_orderkey % 14, 1 + l_partkey % 31) AS t FROM lineitem)""",
    ),
    "resolve_time": (
        lambda s, d: table(s, d, "orders").select("o_orderkey", X.resolve_time(
            F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderstatus") == "O", F.lit("1999-02-30")), F.col("o_orderdate").cast("timestamp")).alias("at")),
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM orders",
    ),
    "stem_index": (
        lambda s, d: X.stem_index(notes(s, d).select(F.regexp_replace("path", r"[0-9]\.md$", ".md").alias("path"))),
        """SELECT regexp_extract(path, '([^/]*)\\.md$', 1) AS stem, min(path) AS target_path FROM (SELECT source || '/' || regexp_replace(doc_id || '.md', '[0-9]\\.md$', '.md') AS path FROM documents)
        WHERE NOT ends_with(path, '/.md') GROUP BY 1 UNION ALL SELECT '.md', min(path) FROM (SELECT source || '/' || regexp_replace(doc_id || '.md', '[0-9]\\.md$', '.md') AS path FROM documents) WHERE ends_with(path, '/.md') HAVING count(*) > 0""",
    ),
    "resolve_links": (
        resolve_links,
        "SELECT 'n/' || doc_id || '.md' AS path, source AS target, CASE WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'home/' ELSE '' END || source || '.md' AS target_path FROM documents",
    ),
    "build_graph": (
        build_graph,
        f"""WITH {GRAPH} SELECT id AS from_id, substr(sha256('doc:' || path), 1, 16) AS to_id, 'contains' AS kind FROM g
        UNION ALL SELECT id, substr(sha256('tag:' || tag), 1, 16), 'groups' FROM (SELECT id, unnest(all_tags) AS tag FROM g)
        UNION ALL SELECT id, substr(sha256('doc:' || link || '.md'), 1, 16), 'links_to' FROM (SELECT id, unnest(links) AS link FROM g)""",
    ),
    "graph_counts": (
        graph_counts,
        f"""WITH {GRAPH}, t AS (SELECT id, unnest(all_tags) AS tag FROM g) SELECT 'context_block:document' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'data_block', count(DISTINCT id) FROM g
        UNION ALL SELECT 'context_block:tag', count(DISTINCT tag) FROM t UNION ALL SELECT 'contains', count(*) FROM g UNION ALL SELECT 'groups', count(*) FROM t UNION ALL SELECT 'links_to', count(*) FROM g WHERE len(links) > 0""",
    ),
    "tag_nodes": (
        lambda s, d: _segments(s, d).select(F.explode("tags").alias("tag")).distinct(),
        f"WITH {MARKED} SELECT DISTINCT unnest(tags) AS tag FROM s",
    ),
    "granularity_backfill": (
        lambda s, d: X.with_granularity(X.split_notes(conversation_notes(s, d))).select("path", "section_heading", "granularity"),
        """WITH c AS (SELECT * FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')
        SELECT 'conv/' || conv_id || '.md' AS path, turn || ' ' || role AS section_heading, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN 'document' ELSE 'section' END AS granularity FROM c""",
    ),
    "json_from_text": (label_replies, "SELECT doc_id AS id, quality FROM labels"),
    "dispatch_tasks": (
        lambda s, d: tasks(s, d).select("title", F.sha2("body", 256).alias("body_sha"), F.regexp_extract("file_name", "^(.*)-[0-9a-f]{8}\\.md$", 1).alias("slug")),
        f"""WITH {GRAPH} SELECT instructions AS title, 'review-' || source AS slug, sha256('---' || chr(10) || 'status: pending' || chr(10) || 'source_block_id: ' || id || chr(10) || 'source_note: "[[' || doc_id || ']]"' || chr(10) || '---'
        || chr(10) || '# ' || instructions || chr(10) || chr(10) || '## Context' || chr(10) || chr(10) || content || chr(10) || chr(10) || '## User instruction' || chr(10) || chr(10) || '> ' || instructions || chr(10)
        || chr(10) || '## Task' || chr(10) || chr(10) || '{K.TASK_NOTE.replace("'", "''")}' || chr(10) || chr(10) || '## Human Todo' || chr(10) || chr(10) || '## Results' || chr(10)) AS body_sha FROM g WHERE instructions <> ''""",
    ),
    "pending_tasks": (
        lambda s, d: K.pending(task_files(s, d), F.lit("1998-01-01 00:00:00").cast("timestamp"), 30).select("path"),
        "SELECT 'tasks/' || o_orderkey || '.md' AS path FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 30 SECOND",
    ),
    "task_links": (
        lambda s, d: task_files(s, d).select("path", F.element_at(K.front_matter(F.col("content")), "status").alias("status"), F.array_join(X.wikilinks(X.body(F.col("content"))), ",").alias("links")),
        "SELECT 'tasks/' || o_orderkey || '.md' AS path, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'active' ELSE 'done' END AS status, 'c' || o_custkey || ',b' AS links FROM orders",
    ),
    "parse_streams": (lambda s, d: K.parse_streams(stream_files(s, d)), f"WITH {STREAMS} SELECT * FROM st"),
    "list_streams": (
        lambda s, d: K.list_streams(K.parse_streams(stream_files(s, d)), None, 12),
        f"WITH {STREAMS} SELECT stream, status, last_active, substr(left_off, 1, 12) AS preview FROM st",
    ),
    "find_stream": (
        lambda s, d: K.find_streams(K.parse_streams(stream_files(s, d)), wanted_streams(s, d)),
        "SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE upper(c_name) END AS name, c_name AS stream FROM customer",
    ),
    "fold_streams": (
        lambda s, d: K.fold_streams(events_stream(s, d)),
        """WITH e AS (SELECT 'user-' || user_id AS slug, event_id AS seq, event_type AS k, event_type || ' ' || event_id AS t, strftime(ts, '%Y-%m-%d') AS day FROM events)
        SELECT slug, max_by(t, seq) FILTER (k = 'purchase') AS left_off, max_by(t, seq) FILTER (k = 'click') AS context, max(CASE WHEN k = 'view' THEN 'active' END) AS status,
        coalesce(string_agg(t, chr(10) ORDER BY seq) FILTER (k NOT IN ('purchase', 'click', 'view')), '') AS log, string_agg(DISTINCT day, ',' ORDER BY day) AS sessions FROM e GROUP BY 1""",
    ),
}
