"""Filters, projections, sorts and pages over ``blocks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = (F.desc_nulls_last, "block_time")


def browse(blocks: DataFrame, kind: str | None = None, source: str | None = None, after: str | None = None, before: str | None = None) -> DataFrame:
    """The filter of all browsing. Times compare as text; both date filters drop rows without a time."""
    out = blocks
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if source is not None:
        out = out.where(F.col("source") == source)
    if after is not None:
        out = out.where(F.col("block_time") >= after)
    if before is not None:
        out = out.where(F.col("block_time") <= before)
    return out


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest first, then id: a top-k, not a full sort."""
    return rows.orderBy(F.desc_nulls_last("block_time"), "id").offset(offset).limit(limit)


def browse_page(blocks: DataFrame, k: int, offset: int = 0, tags: list[str] | None = None, **filters: str | None) -> tuple[DataFrame, DataFrame]:
    """A page of at most ``k`` rows, and one row ``count, total, has_more, next_offset`` about it.

    Filters are those of :func:`browse`. Tags (of both tag columns) hold back rows of the page that was fetched, one row longer
    than shown; the total does not count by them. The page is a top-k and at most ``k + 1`` rows.
    """
    rows = browse(blocks, **filters)
    fetched = page(rows, k + 1, offset)
    met = tagged(fetched, tags, "tags", "given_tags") if tags else fetched
    got = met.agg(F.count("*").alias("got"))
    more = F.col("got") > k
    info = got.join(rows.agg(F.count("*").alias("total"))).select(
        F.least("got", F.lit(k).cast("long")).alias("count"), "total", more.alias("has_more"), F.when(more, F.lit(offset + k)).alias("next_offset")
    )
    return page(met, k), info


def tagged(rows: DataFrame, tags: list[str], *columns: str) -> DataFrame:
    """Rows with any of ``tags`` in any of the tag columns."""
    have = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns or ("tags",)])
    return rows.where(F.arrays_overlap(have, F.array(*map(F.lit, tags))))


def recent_days(blocks: DataFrame, days: int, as_of: Column, kind: str | None = None) -> DataFrame:
    since = F.date_format(F.date_sub(as_of, days), "yyyy-MM-dd")
    return browse(blocks, kind).where(F.col("block_time") >= since)


def since(blocks: DataFrame, start: str, kind: str | None = None) -> DataFrame:
    """Dated on or after the date part of ``start``; oldest first."""
    return browse(blocks, kind).where(F.col("block_time") >= start[:10]).orderBy("block_time", "id")


def recent(blocks: DataFrame, k: int, tags: list[str] | None = None, order: str = "block_time", kind: str | None = None, source: str | None = None) -> DataFrame:
    """The newest k of a kind and source; with tags (of both tag columns, where there are two) the filter comes after fetching
    3k, as a list of recent blocks wants. ``order``: ``block_time``, or ``ingested_at`` for what came in last."""
    rows = browse(blocks, kind, source).orderBy(F.desc_nulls_last(order), "id").limit(3 * k if tags else k)
    columns = [c for c in ("tags", "given_tags") if c in blocks.columns]
    return tagged(rows, tags, *columns).orderBy(F.desc_nulls_last(order), "id").limit(k) if tags else rows


def summary(blocks: DataFrame, most: int = 500) -> DataFrame:
    """The short form of blocks; the tag columns come with it where the table has them."""
    tags = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tags", "given_tags") if c in blocks.columns]
    return blocks.select("id", "kind", "title", "source", "block_time", F.substring("content", 1, most).alias("content"), *tags)


def timeline(blocks: DataFrame, until: str, source: str | None = None, query: str | None = None) -> DataFrame:
    """Up to a date; source equal; text or path holds the query, whatever the case."""
    out = blocks.where(F.substring("block_time", 1, 10) <= until)
    if source is not None:
        out = out.where(F.col("source") == source)
    if query:
        q = query.lower()
        out = out.where(F.lower("content").contains(q) | F.lower("source_path").contains(q))
    return out


def same_label(assigned: DataFrame, ids: DataFrame) -> DataFrame:
    """``start_id, id, label``: members with the label of each block in ``ids(id)``."""
    start = assigned.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("start_id"), "label")
    return start.join(assigned, "label").select("start_id", "id", "label")


def lookup(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(pos, id)`` answered in its order: the block, or found = false."""
    got = wanted.join(blocks.withColumn("found", F.lit(True)), "id", "left")
    return got.withColumn("found", F.coalesce("found", F.lit(False)))


def newest_per(rows: DataFrame, key: str, k: int) -> DataFrame:
    rank = Window.partitionBy(key).orderBy(F.desc_nulls_last("block_time"), "id")
    return rows.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k)
