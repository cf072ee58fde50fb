"""The ingest cycle of a watched folder as a stream: split, difference, vectors, tasks.

A store is a folder of tables, each batch a partition of its own (``batch=N``) written by overwriting, so a batch that runs
twice replaces itself and reads only what earlier batches wrote. A cycle costs its own notes and joins by path and id; nothing
of earlier batches is written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions.ids import segment_id, short_hash
from notegraph.operators.embed import EmbeddingModel, embed
from notegraph.operators.tasks import dispatch
from notegraph.operators.text import clean, split_notes
from notegraph.streaming.changes import current, newest

SCHEMAS = {
    "files": "path string, hash string",
    "segments": "path string, id string, content string, clean_content string, instructions array<string>, tags array<string>, links array<string>, section_heading string, section_date string",
    "diff": "path string, id string, status string",
    "vectors": "block_id string, vec array<double>, error string",
    "tasks": "file_name string, title string, body string, block_id string",
}


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    """All batches of a table of the store."""
    return spark.read.schema(f"{SCHEMAS[table]}, batch bigint").parquet(f"{base}/{table}")


def segments_now(spark: SparkSession, base: str) -> DataFrame:
    """The segments of every note as it is now."""
    return current(read(spark, base, "segments"), read(spark, base, "files")).drop("batch")


def vectors_now(spark: SparkSession, base: str) -> DataFrame:
    """``block_id, vec`` of the segments of now that have a vector."""
    made = read(spark, base, "vectors").where("vec IS NOT NULL").select("block_id", "vec").dropDuplicates(["block_id"])
    return made.join(segments_now(spark, base).select(F.col("id").alias("block_id")), "block_id", "left_semi")


def create(spark: SparkSession, base: str) -> None:
    """Empty tables, so that the first cycle is like any other."""
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/{table}/batch=-1")


def run_cycle(batch: DataFrame, base: str, number: int, make: Callable[[], EmbeddingModel]) -> None:
    """One cycle over changes (path, event_ts, content); null content: the note is gone, and its segments with it.

    Notes whose bytes are those of the last version are left alone. The others are split; segments of equal path and content
    keep their id, and so their vector. New segments and those whose vector failed before are embedded; a failure is a row
    with its message, and is tried again when its note changes (:func:`retry` takes all of them). New segments with
    instructions give task files.
    """
    spark = batch.sparkSession

    def before(table: str) -> DataFrame:
        return read(spark, base, table).where(F.col("batch") < number)

    def write(rows: DataFrame, table: str) -> DataFrame:
        path = f"{base}/{table}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(SCHEMAS[table]).parquet(path)

    known = current(before("files"), before("files")).select("path", F.col("hash").alias("old"))
    seen = newest(batch).withColumn("hash", short_hash(F.col("content"))).join(known, "path", "left")
    changed = seen.where("NOT old <=> hash").select("path", "content", "hash")
    # segments first: the table of files is what makes a batch count
    split = split_notes(changed.where("content IS NOT NULL").select("path", "content")).withColumn("id", segment_id(F.col("path"), F.col("content")))
    segments = write(split.select(*[f.split()[0] for f in SCHEMAS["segments"].split(", ")]), "segments")
    files = write(changed.select("path", "hash"), "files")
    old = current(before("segments"), before("files")).join(files.select("path"), "path", "left_semi").select("path", "id").distinct().withColumn("o", F.lit(True))
    new = segments.select("path", "id").distinct().withColumn("n", F.lit(True))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    diff = write(old.join(new, ["path", "id"], "full_outer").select("path", "id", status.alias("status")), "diff")
    have = before("vectors").where("vec IS NOT NULL").select(F.col("block_id").alias("id"))
    todo = segments.select("id", clean(F.col("content")).alias("text")).dropDuplicates(["id"]).join(have, "id", "left_anti")
    write(embed(todo, make), "vectors")
    fresh = segments.join(diff.where("status = 'added'").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    write(dispatch(fresh, "id"), "tasks")


def retry(spark: SparkSession, base: str, number: int, make: Callable[[], EmbeddingModel]) -> None:
    """Vectors for all segments of now that have none, written as batch ``number`` (one that no cycle uses)."""
    have = read(spark, base, "vectors").where((F.col("batch") != number) & F.col("vec").isNotNull()).select(F.col("block_id").alias("id"))
    todo = segments_now(spark, base).select("id", clean(F.col("content")).alias("text")).dropDuplicates(["id"]).join(have, "id", "left_anti")
    embed(todo, make).write.mode("overwrite").parquet(f"{base}/vectors/batch={number}")


def run_stream(changes: DataFrame, base: str, make: Callable[[], EmbeddingModel], name: str = "cycle", first: int = 0) -> None:
    """Cycles over a stream of changes into the store at ``base``.

    ``first``: the number of the stream's first batch; a stream that goes on with a store of another one starts behind it.
    """
    query = (
        changes.writeStream.foreachBatch(lambda batch, n: run_cycle(batch, base, first + n, make))
        .option("checkpointLocation", f"{base}/state-{name}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
