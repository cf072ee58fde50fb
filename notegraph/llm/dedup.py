"""Exact deduplication against a persistent digest index.

The index is a folder of rows ``(digest, keep_id, run)``, a table bucketed and sorted by digest. New data is reduced to one row
per digest, anti-joined with the index by sort-merge (the index side needs no shuffle: it is bucketed) and what is left is
appended. What has been kept stays: a digest that an earlier run appended keeps its id, and new rows with it are dropped. With
``supersede`` a larger doc_id wins instead: it is appended as well, and the largest id of a digest is the one that stays.

Within one table batches go in with descending ids, so "first come stays" is "the largest doc_id stays". The number of buckets
follows the first batch and is kept beside the table, so that a later session, which knows only the folder, goes on with it.

Defined results: null text counts as empty; texts are compared whole; a null doc_id is below every other; of rows with equal
text and equal doc_id one stays; an empty table gives no rows; extra columns are ignored by ``digests`` and kept by ``keep_one``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import cut, lowered, remove, salt, shared_dir, slim

#: Rows of the first batch in a bucket, and rows of a table for which one more salt is used.
BUCKET_ROWS, SALT_ROWS = 1 << 20, 1 << 17


def digests(docs: DataFrame) -> DataFrame:
    """``(row_id, doc_id, digest)``: SHA-256 of the text with A-Z lower-cased. Written once: row ids stay fixed."""
    rows = slim(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.unhex(F.sha2(lowered(F.col("text")), 256)).alias("digest"),
    )
    return cut(rows, "digests")


class DigestIndex:
    """A bucketed, sorted, append-only table of the digests kept so far.

    ``path`` is its folder (default: a new one under the shared folder), ``name`` the catalog's. A new object on an existing
    folder continues it, in the same session or a later one.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.buckets = buckets
        if not spark.catalog.tableExists(self.name) and self._exists(f"{self.path}-buckets"):
            self.buckets = spark.read.parquet(f"{self.path}-buckets").first()[0]
            self._register()

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def _register(self) -> None:
        columns = "digest BINARY, keep_id BIGINT, run STRING"
        self.spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _create(self, first: DataFrame) -> None:
        if self.spark.catalog.tableExists(self.name):
            return
        self.buckets = self.buckets or 1 << max(3, (first.count() // BUCKET_ROWS).bit_length())
        # one row, written before any digest: a folder without it holds no index
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(f"{self.path}-buckets")
        self._register()

    def table(self) -> DataFrame:
        """``digest, keep_id, run`` as appended."""
        return self.spark.table(self.name)

    def current(self) -> DataFrame:
        """One row per digest: that with the largest ``keep_id`` (an id that is not null before null)."""
        best = self.table().groupBy("digest").agg(F.max(F.struct("keep_id", "run")).alias("b"))
        return best.select("digest", "b.keep_id", "b.run")

    def append(self, hashed: DataFrame, run: str, supersede: bool = False) -> None:
        """Add the digests of a batch that the index does not hold; within the batch the largest doc_id stays."""
        self._create(hashed)
        best = hashed.groupBy("digest").agg(F.max("doc_id").cast("long").alias("keep_id"))
        held = self.table().select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep")).hint("merge")
        known = F.col("digest") == F.col("__digest")
        if supersede:
            known = known & F.coalesce(F.col("__keep") >= F.col("keep_id"), F.col("keep_id").isNull())
        fresh = best.join(held, known, "left_anti").withColumn("run", F.lit(run))
        # dealt by the bucket key first, so that every bucket gets one sorted file an append
        files = fresh.repartition(self.table_buckets(), "digest")
        files.write.bucketBy(self.table_buckets(), "digest").sortBy("digest").mode("append").option("path", self.path).format("parquet").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def table_buckets(self) -> int:
        if self.buckets is None:
            self.buckets = self.spark.read.parquet(f"{self.path}-buckets").first()[0]
        return self.buckets

    def drop(self) -> None:
        """Forget the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
        remove(self.spark, f"{self.path}-buckets")


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2, supersede: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` (and ``row_id``).

    With an index that holds a text's digest already, ``keep_id`` is the id that stays and no new row of it is kept.
    Equal texts may hold a third of all rows, so the verdict reaches the rows by a join on (digest, salt), keys made by a
    map-side-combined aggregate; a key holds at most about ``SALT_ROWS`` rows.
    """
    spark = docs.sparkSession
    hashed = digests(docs)
    own = index is None
    index = index or DigestIndex(spark)
    run = uuid.uuid4().hex
    low, high, n = hashed.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if batches > 1 and low is not None and high > low:
        edges = [low + (high - low) * k // batches for k in range(1, batches)]
        part = F.lit(0)
        for e in edges:
            part = part + (F.coalesce(F.col("doc_id"), F.lit(low)) > e).cast("int")
        for k in reversed(range(batches)):
            index.append(hashed.where(part == k), run, supersede)
    else:
        index.append(hashed, run, supersede)
    salted = hashed.withColumn("salt", salt(F.col("row_id"), max(8, n // SALT_ROWS)))
    # of the row that stays repeats may exist: the first row number is it
    counted = salted.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", (-F.col("row_id")).alias("back"))).alias("best"))
    sizes = counted.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    verdict = sizes.join((index.table() if own else index.current()).hint("merge"), "digest")
    stays = F.when((F.col("run") == run) & F.col("best.doc_id").eqNullSafe(F.col("keep_id")), -F.col("best.back"))
    verdict = verdict.select("digest", "group_size", "keep_id", stays.alias("keep_row"))
    spread = counted.select("digest", "salt").join(verdict, "digest")
    out = salted.join(spread, ["digest", "salt"]).select(
        "row_id",
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if own:
        out = cut(out, "verdicts")
        index.drop()
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of every group of equal texts; all columns stay.

    The (id, digest) pairs to drop are joined away; where they are few Spark sends them to the tasks (it checks their
    size), else both sides are dealt out. Pairs that occur on several rows are rare: only where there are some, those
    rows are gathered and one of each is put back. Null and empty texts are one group. An empty table gives no rows.
    """
    groups = exact_groups(docs).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    pairs = cut(groups.groupBy("__id", "__sha").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "pairs")
    lost = pairs.where(~F.col("kept") | (F.col("n") > 1)).select("__id", "__sha")
    again = pairs.where(F.col("kept") & (F.col("n") > 1)).select("__id", "__sha")
    marked = docs.withColumn("__sha2", F.sha2(lowered(docs["text"]), 256))

    def same(other: DataFrame):
        return (marked["__sha2"] == other["__sha"]) & marked["doc_id"].eqNullSafe(other["__id"])

    left = marked.join(lost, same(lost), "left_anti")
    if not again.isEmpty():
        left = left.unionByName(marked.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "__sha2"]))
    return left.drop("__sha2")


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_groups(docs).drop("row_id")


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
