"""Table maintenance as joins: idempotent inserts, cascades, merges, diffs. Inputs are never changed; results are new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The incoming rows to append: first by ``order`` of each key, and not there yet."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    return first.join(target.select(*keys), keys, "left_anti")


def delete_cascade(blocks: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the blocks in ``gone(id)``, and without links that touch them."""
    kept = blocks.join(gone, "id", "left_anti")
    left = links.join(gone, links.from_id == gone.id, "left_anti")
    return kept, left.join(gone, left.to_id == gone.id, "left_anti")


def delete_where(blocks: DataFrame, links: DataFrame, source_path: str | None = None, source: str | None = None, pass_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Delete, with their links, the blocks of a file, of a source or of a cluster pass (column ``pass_id``); all that is given must hold."""
    wanted = {"source_path": source_path, "source": source, "pass_id": pass_id}
    hit = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if not hit:
        raise ValueError("nothing says what to delete")
    where = hit[0]
    for h in hit[1:]:
        where = where & h
    return delete_cascade(blocks, links, blocks.where(where).select("id").distinct())


def merge_map(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Shallow merge of a MAP column: keys of ``updates(key, column)`` win."""
    u = updates.select(key, F.col(column).alias("__u"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base, new = F.coalesce(F.col(column), empty), F.coalesce(F.col("__u"), empty)
    keep = F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k))
    return rows.join(u, key, "left").withColumn(column, F.map_concat(keep, new)).drop("__u")


def assign_labels(blocks: DataFrame, pass_id: str, labels: DataFrame) -> DataFrame:
    """``assignments[pass_id]`` replaced for all blocks: set where ``labels(id, label)`` has one, else removed."""
    u = labels.select("id", F.col("label").cast("string").alias("__l"))
    other = F.map_filter("assignments", lambda k, _: k != pass_id)
    new = F.map_concat(other, F.create_map(F.lit(pass_id), F.col("__l")))
    return blocks.join(u, "id", "left").withColumn("assignments", F.when(F.col("__l").isNotNull(), new).otherwise(other)).drop("__l")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows, and the target's that they do not replace."""
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def change_status(current: DataFrame, known: DataFrame, key: str = "source_path", hashed: str = "hash") -> DataFrame:
    """``key, status``: new, changed, unchanged or deleted, by content hash."""
    c = current.select(key, F.col(hashed).alias("__new"))
    k = known.select(key, F.col(hashed).alias("__old"))
    status = (
        F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "deleted").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    )
    return c.join(k, key, "full_outer").select(key, status.alias("status"))


def segment_diff(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """``source_path, hash, status`` (kept, added, removed) for the segments of documents in ``changed(source_path)``.

    Kept segments keep their id, and so their vectors.
    """
    o = old.join(changed, "source_path", "left_semi").select("source_path", "hash").distinct().withColumn("o", F.lit(True))
    n = new.join(changed, "source_path", "left_semi").select("source_path", "hash").distinct().withColumn("n", F.lit(True))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    return o.join(n, ["source_path", "hash"], "full_outer").select("source_path", "hash", status.alias("status"))


def report(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("source_path").alias("files"))


def needs_vectors(blocks: DataFrame, embeddings: DataFrame, column: str | None = None) -> DataFrame:
    """Segments with content and no vector; with ``column`` (of several kinds of vectors in a row) none of that kind."""
    if column is not None:
        embeddings = embeddings.where(F.col(column).isNotNull())
    rows = blocks.where("kind = 'data_block' AND content IS NOT NULL AND content <> ''")
    return rows.join(embeddings.select(F.col("block_id").alias("id")), "id", "left_anti")


def with_vectors(blocks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return blocks.join(embeddings.select(F.col("block_id").alias("id")), "id", "left_semi")
