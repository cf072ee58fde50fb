"""Tables that a map of a corpus is drawn from: its embedded blocks, its clusters by pass, their order and their bridges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.operators.cluster import kmeans_grid, project_2d, truncated
from notegraph.operators.density import density
from notegraph.session import cut


def in_folders(path: Column, folders: list[str]) -> Column:
    """True for a path that is one of the folders or below one; for all where none is named, and where there is no path."""
    if not folders:
        return F.lit(True)
    bare = F.regexp_replace(path, r"\A/+", "")
    below = reduce(lambda a, b: a | b, [(bare == f) | bare.startswith(f + "/") for f in folders])
    return path.isNull() | (path == "") | below


def data_blocks(blocks: DataFrame, vectors: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """``id, content, title, block_time, source_path, vec`` of the segments that have a vector (``vectors(id, vec)``) and lie in
    the folders. Without a path the title stands for it, without that the id; absent texts are empty."""
    name = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = blocks.where((F.col("kind") == "data_block") & in_folders(F.col("source_path"), folders or []))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    path = F.coalesce(name("source_path"), name("title"), "id").alias("source_path")
    return rows.select("id", text("content"), text("title"), "block_time", path).join(vectors.select("id", "vec"), "id")


def payload(shown: DataFrame, blocks: DataFrame, assigned: DataFrame, most: int = 500) -> DataFrame:
    """The blocks to draw: ``id, content, source_path, source_content, x, y, date, cluster_assignments``.

    ``shown``: rows of :func:`data_blocks`; ``assigned(pass_id, id, label)``: labels without noise. The date is the month; a time
    that is none gives null. Source content: the beginning of the document of that path.
    """
    docs = blocks.where("kind = 'context_block:document' AND source_path IS NOT NULL")
    docs = docs.groupBy("source_path").agg(F.substring(F.min_by("content", "id"), 1, most).alias("source_content"))
    maps = assigned.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pass_id", "label")))).alias("cluster_assignments"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = shown.join(project_2d(shown.select("id", "vec")), "id").join(docs, "source_path", "left").join(maps, "id", "left")
    date = F.date_format(F.try_to_date(F.substring("block_time", 1, 10), "yyyy-MM-dd"), "yyyy-MM").alias("date")
    return rows.select("id", "content", "source_path", F.coalesce("source_content", F.lit("")).alias("source_content"), "x", "y", date, F.coalesce("cluster_assignments", empty).alias("cluster_assignments"))


def overview(clusters: DataFrame) -> DataFrame:
    """Each pass's clusters, the largest first: ``pass_id, title, members, first_date, last_date``."""
    return clusters.select("pass_id", "title", "members", "first_date", "last_date").orderBy("pass_id", F.desc("members"), "title")


def hierarchy(clusters: DataFrame, links: DataFrame, pass_id: str) -> DataFrame:
    """Clusters of a pass and those they contain: ``coarse_cluster, fine_cluster, members``."""
    up = clusters.where(F.col("pass_id") == pass_id).select(F.col("id").alias("from_id"), F.col("title").alias("coarse_cluster"))
    down = clusters.select(F.col("id").alias("to_id"), F.col("title").alias("fine_cluster"), "members")
    rows = links.where("kind = 'contains'").join(up, "from_id").join(down, "to_id")
    return rows.select("coarse_cluster", "fine_cluster", "members").orderBy("coarse_cluster", F.desc("members"), "fine_cluster")


def bridge_list(bridges: DataFrame, texts: DataFrame, most: int = 200) -> DataFrame:
    """Bridges with the beginning of the block they stand for (``texts(id, content)``)."""
    named = texts.select(F.col("id").alias("source_block_id"), F.substring("content", 1, most).alias("content"))
    return bridges.join(named, "source_block_id").select("id", "source_block_id", "near", "content")


def sub_clusters(clusters: DataFrame, links: DataFrame, pass_id: str) -> DataFrame:
    """``id, title, members, children`` of a pass's clusters: how many clusters each contains, 0 included."""
    kids = links.where("kind = 'contains'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("children"))
    rows = clusters.where(F.col("pass_id") == pass_id).join(kids, "id", "left")
    return rows.select("id", "title", "members", F.coalesce("children", F.lit(0).cast("long")).alias("children"))


def fine_grid(vectors: DataFrame, parents: DataFrame, label: int, dims: list[int], min_sizes: list[int], ks: list[int]) -> DataFrame:
    """Settings tried inside one parent cluster: ``method, dims, setting, label, n, pct``; density has a row for its noise (-1).

    Only the members of ``label`` in ``parents(id, label)`` are looked at; settings that want more rows than there are, are left
    out. All k-means settings are fitted in one job; a density setting is a fit of its own.
    """
    rows = cut(vectors.join(parents.where(F.col("label") == label).select("id"), "id", "left_semi").select("id", "vec"), "members")
    total = rows.count()
    heads = ["method", "dims", "setting", "label", "n", "pct"]
    parts = []
    if total and any(k < total for k in ks):
        sizes = kmeans_grid(rows, dims, ks)
        parts.append(sizes.select(F.lit("kmeans").alias("method"), "dims", F.col("k").alias("setting"), F.col("label").cast("long").alias("label"), "n", "pct"))
    for d in dims:
        for m in (m for m in min_sizes if m <= total):
            sizes = density(truncated(rows, d), m).groupBy("label").agg(F.count("*").alias("n"))
            head = [F.lit("density").alias("method"), F.lit(d).alias("dims"), F.lit(m).alias("setting")]
            parts.append(sizes.select(*head, F.col("label").cast("long").alias("label"), "n", F.round(100 * F.col("n") / total, 2).alias("pct")))
    schema = "method string, dims int, setting int, label bigint, n bigint, pct double"
    return reduce(DataFrame.unionByName, [p.select(*heads) for p in parts]) if parts else vectors.sparkSession.createDataFrame([], schema)
