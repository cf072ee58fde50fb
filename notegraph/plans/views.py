"""The driver tables seen as a note graph, in Spark and (for the checks) as SQL text.

customer -> document, order -> segment, part name -> tag; an order is contained in its customer's document, groups with
the tags of its parts and links to the next customer's document (past the last key: a dangling link). Documents have links of
their own: to the seventh next (``mentions``), to the tag of the part of their number (``about``), and back from some (``defines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.ids import doc_id, make_id, tag_id

BLOCK_COLUMNS = ["id", "kind", "content", "title", "source", "source_path", "block_time", "tags"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def path_of(custkey: Column) -> Column:
    return F.concat(F.lit("customers/"), custkey.cast("string"), F.lit(".md"))


def order_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (order key, tag)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", F.col("p_name").alias("tag")).distinct()


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None).cast("string")
    cust = table(spark, sf, "customer")
    docs = cust.select(
        doc_id(path_of(F.col("c_custkey"))).alias("id"),
        F.lit("context_block:document").alias("kind"),
        F.col("c_mktsegment").alias("content"),
        F.col("c_name").alias("title"),
        F.lit("vault").alias("source"),
        path_of(F.col("c_custkey")).alias("source_path"),
        null.alias("block_time"),
    )
    orders = table(spark, sf, "orders")
    segs = orders.select(
        make_id(F.lit("seg"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("data_block").alias("kind"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_orderpriority").alias("source"),
        path_of(F.col("o_custkey")).alias("source_path"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("block_time"),
    )
    tags = order_tags(spark, sf).select("tag").distinct().select(
        tag_id(F.col("tag")).alias("id"),
        F.lit("context_block:tag").alias("kind"),
        null.alias("content"),
        F.col("tag").alias("title"),
        null.alias("source"),
        null.alias("source_path"),
        null.alias("block_time"),
    )
    return docs.unionByName(segs).unionByName(tags)


def links(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(make_id(F.lit("seg"), F.col("o_orderkey").cast("string")).alias("from_id"), "o_custkey", "o_orderkey")
    contains = orders.select("from_id", doc_id(path_of(F.col("o_custkey"))).alias("to_id"), F.lit("contains").alias("kind"))
    next_doc = orders.select("from_id", doc_id(path_of(F.col("o_custkey") + 1)).alias("to_id"), F.lit("links_to").alias("kind"))
    groups = order_tags(spark, sf).select(
        make_id(F.lit("seg"), F.col("l_orderkey").cast("string")).alias("from_id"), tag_id(F.col("tag")).alias("to_id"), F.lit("groups").alias("kind")
    )
    cust = table(spark, sf, "customer").select("c_custkey")
    mentions = cust.select(doc_id(path_of(F.col("c_custkey"))).alias("from_id"), doc_id(path_of(F.col("c_custkey") + 7)).alias("to_id"), F.lit("mentions").alias("kind"))
    part = table(spark, sf, "part").select("p_partkey", tag_id(F.col("p_name")).alias("tag"))
    about = part.select(doc_id(path_of(F.col("p_partkey"))).alias("from_id"), F.col("tag").alias("to_id"), F.lit("about").alias("kind"))
    defines = part.where("p_partkey % 3 = 0").select(F.col("tag").alias("from_id"), doc_id(path_of(F.col("p_partkey"))).alias("to_id"), F.lit("defines").alias("kind"))
    return contains.unionByName(groups).unionByName(next_doc).unionByName(mentions).unionByName(about).unionByName(defines)


GRAPH_SQL = """
order_tags AS (SELECT DISTINCT l_orderkey, p_name AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
blocks AS (
  SELECT substr(sha256('doc:customers/' || c_custkey || '.md'), 1, 16) AS id, 'context_block:document' AS kind, c_mktsegment AS content, c_name AS title,
         'vault' AS source, 'customers/' || c_custkey || '.md' AS source_path, CAST(NULL AS VARCHAR) AS block_time FROM customer
  UNION ALL
  SELECT substr(sha256('seg:' || o_orderkey), 1, 16), 'data_block', o_orderpriority || ' ' || o_orderstatus, 'order ' || o_orderkey,
         o_orderpriority, 'customers/' || o_custkey || '.md', strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL
  SELECT substr(sha256('tag:' || tag), 1, 16), 'context_block:tag', NULL, tag, NULL, NULL, NULL FROM (SELECT DISTINCT tag FROM order_tags)),
links AS (
  SELECT substr(sha256('seg:' || o_orderkey), 1, 16) AS from_id, substr(sha256('doc:customers/' || o_custkey || '.md'), 1, 16) AS to_id, 'contains' AS kind FROM orders
  UNION ALL
  SELECT substr(sha256('seg:' || l_orderkey), 1, 16), substr(sha256('tag:' || tag), 1, 16), 'groups' FROM order_tags
  UNION ALL
  SELECT substr(sha256('seg:' || o_orderkey), 1, 16), substr(sha256('doc:customers/' || (o_custkey + 1) || '.md'), 1, 16), 'links_to' FROM orders
  UNION ALL
  SELECT substr(sha256('doc:customers/' || c_custkey || '.md'), 1, 16), substr(sha256('doc:customers/' || (c_custkey + 7) || '.md'), 1, 16), 'mentions' FROM customer
  UNION ALL
  SELECT substr(sha256('doc:customers/' || p_partkey || '.md'), 1, 16), substr(sha256('tag:' || p_name), 1, 16), 'about' FROM part
  UNION ALL
  SELECT substr(sha256('tag:' || p_name), 1, 16), substr(sha256('doc:customers/' || p_partkey || '.md'), 1, 16), 'defines' FROM part WHERE p_partkey % 3 = 0)
"""


def graph_sql(body: str) -> str:
    """A statement over ``blocks`` and ``links``; ``body`` may start with further ``name AS (...),`` tables after ``|``."""
    extra, _, rest = body.rpartition("|with|")
    return f"WITH {GRAPH_SQL}{', ' + extra if extra else ''} {rest}"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """``path, content``: the documents as plain notes."""
    d = table(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))


def marked_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The raw documents as notes: front matter, a dated heading, the text as it is with a wiki link, an inline tag and an
    instruction behind it, then a second section with a heading inside a fence and a part behind a marker line.

    A document's number picks its date.
    """
    d = table(spark, sf, "documents")
    day = F.format_string("%04d-%02d-%02d", 2000 + F.col("doc_id") % 25, 1 + F.col("doc_id") % 12, 1 + F.col("doc_id") % 28)
    content = F.concat(
        F.lit("---\ntags: ["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\n---\n## "), day, F.lit(" heading\n"),
        F.col("text"), F.lit("\nsee [["), F.col("source"), F.lit("|alias]] and #lang/"), F.col("lang"), F.lit("\nzzz review "), F.col("source"),
        F.lit("\n# Second\n```\n# not a heading\n```\n qQq\nlast "), F.col("lang"), F.lit("\n"),
    )
    return d.select("doc_id", "lang", "source", day.alias("day"), F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


def conversation_notes(spark: SparkSession, sf: str) -> DataFrame:
    """One note per conversation: a section ``## turn role`` for each turn, in order."""
    c = table(spark, sf, "conversations")
    one = F.struct("turn", F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("t"))
    notes = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: x["t"]), "")
    return notes.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
