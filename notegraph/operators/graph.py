"""Joins, aggregates and traversals over ``blocks`` and ``links``. All take and return DataFrames; ``as_of`` replaces "now"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.operators.search import keyword_search, parse_queries, postings
from notegraph.session import cut

DOC, SEG, TAG = "context_block:document", "data_block", "context_block:tag"


def links_of(links: DataFrame, ids: DataFrame, direction: str = "from", kind: str | None = None) -> DataFrame:
    """Links whose ``from``/``to`` end is in ``ids(id)``."""
    end = links[f"{direction}_id"]
    out = links if kind is None else links.where(links["kind"] == kind)
    return out.join(ids.select("id"), end == ids["id"], "left_semi")


def related(blocks: DataFrame, links: DataFrame, ids: DataFrame, limit: int = 20, kind: str | None = None, direction: str = "both") -> DataFrame:
    """Neighbours with link kind and direction, at most ``limit`` per block and direction.

    ``kind``: only links of it. ``direction``: outgoing, incoming or both.
    """
    links = links if kind is None else links.where(F.col("kind") == kind)
    start = ids.select(F.col("id").alias("start_id"))
    out = links.join(start, links.from_id == start.start_id).select("start_id", F.col("to_id").alias("id"), F.col("kind").alias("link_kind"), F.lit("outgoing").alias("direction"))
    back = links.join(start, links.to_id == start.start_id).select("start_id", F.col("from_id").alias("id"), F.col("kind").alias("link_kind"), F.lit("incoming").alias("direction"))
    both = {"outgoing": out, "incoming": back}.get(direction) if direction != "both" else out.unionByName(back)
    if both is None:
        raise ValueError(f"no direction {direction}")
    rank = Window.partitionBy("start_id", "direction").orderBy("link_kind", "id")
    both = both.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= limit).drop("n")
    return both.join(blocks.select("id", "kind", "title"), "id").select("start_id", "id", "kind", "title", "link_kind", "direction")


def traverse(links: DataFrame, starts: DataFrame, max_hops: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """``start_id, id, depth``: breadth first over undirected links from many starts at once, least depth first.

    Each frontier is written, so that a hop reads the one before and never computes it again.
    """
    edges = links if kinds is None else links.where(F.col("kind").isin(kinds))
    edges = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = starts.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("depth"))
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.join(edges, front.id == edges.a).select("start_id", F.col("b").alias("id")).distinct()
        front = step.join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti").withColumn("depth", F.lit(hop))
        front = cut(front, "frontier")
        seen = seen.unionByName(front)
    return seen


def hub_scores(blocks: DataFrame, links: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), limit: int | None = None) -> DataFrame:
    """Documents by 0.5 ln(1+in) + 0.3 ln(1+out) + 0.2 ln(1+segments).

    In: all links to the document but ``contains``; out: all links of the document itself. One pass over links per direction,
    combined map-side.
    """
    docs = blocks.where(F.col("kind") == DOC).select("id", "title")
    held = F.col("kind") == "contains"
    into = links.groupBy(F.col("to_id").alias("id")).agg(F.count_if(~held).alias("links_in"), F.count_if(held).alias("segments"))
    out = links.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("links_out"))
    out = _counted(docs.join(into, "id", "left").join(out, "id", "left")).select("id", "title", "links_in", "links_out", "segments")
    a, b, c = weights
    score = a * F.log1p(F.col("links_in")) + b * F.log1p(F.col("links_out")) + c * F.log1p(F.col("segments"))
    out = out.withColumn("score", F.round(score, 6))
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.na.fill(0, ["links_in", "links_out", "segments"])


def tag_details(blocks: DataFrame, links: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), limit: int | None = None) -> DataFrame:
    """Tags by 0.5 ln(1+in+segments) + 0.3 ln(1+out) + 0.2 ln(1+segments), with the newest time of their segments.

    Segments: links of the kind ``groups`` to the tag; in: all other links to it; out: its own links.
    """
    tags = blocks.where(F.col("kind") == TAG).select("id", "title")
    grouped = F.col("kind") == "groups"
    into = links.groupBy(F.col("to_id").alias("id")).agg(F.count_if(grouped).alias("segments"), F.count_if(~grouped).alias("links_in"))
    out = links.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("links_out"))
    times = blocks.where("block_time IS NOT NULL").select(F.col("id").alias("from_id"), "block_time")
    newest = links.where(grouped).join(times, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.max("block_time").alias("last_active"))
    rows = _counted(tags.join(into, "id", "left").join(out, "id", "left")).join(newest, "id", "left")
    a, b, c = weights
    score = a * F.log1p(F.col("links_in") + F.col("segments")) + b * F.log1p("links_out") + c * F.log1p("segments")
    rows = rows.withColumn("score", F.round(score, 6)).select("id", "title", "segments", "links_in", "links_out", "last_active", "score")
    return rows if limit is None else rows.orderBy(F.desc("score"), "id").limit(limit)


def cooccurring_tags(blocks: DataFrame, links: DataFrame, limit: int | None = 10) -> DataFrame:
    """Tag pairs sharing segments, counted, the commonest ``limit`` per tag.

    Pairs come from a segment's own few tags (an array), not from a join of the links with themselves.
    """
    tags = links.where("kind = 'groups'").groupBy("from_id").agg(F.array_sort(F.collect_set("to_id")).alias("t")).where(F.size("t") > 1)
    pairs = tags.select("t", F.explode("t").alias("tag_id")).select("tag_id", F.explode("t").alias("other_id")).where("tag_id <> other_id")
    counts = pairs.groupBy("tag_id", "other_id").agg(F.count("*").alias("shared"))
    if limit is not None:
        rank = Window.partitionBy("tag_id").orderBy(F.desc("shared"), "other_id")
        counts = counts.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= limit).drop("n")
    names = blocks.where(F.col("kind") == TAG).select("id", "title")
    named = counts.join(names.select(F.col("id").alias("tag_id"), F.col("title").alias("tag")), "tag_id")
    return named.join(names.select(F.col("id").alias("other_id"), F.col("title").alias("other")), "other_id").select("tag", "other", "shared")


def orphans(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Segments without any link but ``contains``, either way."""
    real = links.where("kind <> 'contains'")
    segs = blocks.where(F.col("kind") == SEG)
    segs = segs.join(real, segs["id"] == real["from_id"], "left_anti")
    return segs.join(real, segs["id"] == real["to_id"], "left_anti")


def stale_tags(blocks: DataFrame, links: DataFrame, as_of: Column, weeks: int = 4) -> DataFrame:
    """Tags whose newest segment is more than ``weeks`` weeks before ``as_of``."""
    limit = F.date_format(F.date_sub(as_of, weeks * 7), "yyyy-MM-dd")
    return tag_details(blocks, links).where(F.col("last_active") < limit).select("id", "title", "segments", "last_active")


def stats(blocks: DataFrame, links: DataFrame, embedded: DataFrame | None = None) -> DataFrame:
    """``metric, kind, n``: counts by block kind and by link kind, and blocks with vectors."""
    out = blocks.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("blocks").alias("metric"), "kind", "n")
    out = out.unionByName(links.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("links").alias("metric"), "kind", "n"))
    if embedded is not None:
        out = out.unionByName(embedded.agg(F.count_distinct("block_id").alias("n")).select(F.lit("embedded").alias("metric"), F.lit("all").alias("kind"), "n"))
    return out


def hub_members(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """Segments linking to ``hubs(id)``; one with several goes to the hub it links to most, then the smallest id."""
    met = links.join(hubs.select(F.col("id").alias("to_id")), "to_id").groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    best = met.groupBy("from_id").agg(F.max_by("to_id", F.struct("n", F.translate("to_id", "0123456789abcdef", "fedcba9876543210"))).alias("hub_id"), F.max("n").alias("links"))
    return best.select(F.col("from_id").alias("id"), "hub_id", "links")


def hub_members_dated(blocks: DataFrame, links: DataFrame, least: int = 50) -> DataFrame:
    """Dated members of every document, text over ``least`` characters, with their place in time order."""
    segs = blocks.where((F.col("kind") == SEG) & F.col("block_time").isNotNull() & (F.char_length("content") > least))
    met = links.where("kind IN ('contains', 'links_to')").select(F.col("from_id").alias("id"), F.col("to_id").alias("hub_id")).distinct().join(segs, "id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("hub_id").orderBy("block_time", "id"))).select("hub_id", "id", "block_time", "place")


def doc_segments(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Every document's segments."""
    held = links.where("kind = 'contains'").select(F.col("from_id").alias("id"), F.col("to_id").alias("doc"))
    return held.join(blocks.where(F.col("kind") == SEG), "id").select("doc", "id", "title", "block_time")


def tag_segments(blocks: DataFrame, links: DataFrame, limit: int = 10) -> DataFrame:
    """Every tag's newest ``limit`` segments."""
    met = links.where("kind = 'groups'").select(F.col("from_id").alias("id"), F.col("to_id").alias("tag"))
    met = met.join(blocks.where(F.col("kind") == SEG).select("id", "title", "block_time"), "id")
    rank = Window.partitionBy("tag").orderBy(F.desc_nulls_last("block_time"), "id")
    return met.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= limit).select("tag", "id", "title", "block_time", "n")


def note_view(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Each document with its segment count, link counts and newest segment."""
    docs = blocks.where(F.col("kind") == DOC).select("id", "title")
    held = doc_segments(blocks, links).groupBy(F.col("doc").alias("id")).agg(F.count("*").alias("segments"), F.max("block_time").alias("newest"))
    into = links.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"))
    out = links.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("outgoing"))
    full = docs.join(held, "id", "left").join(into, "id", "left").join(out, "id", "left")
    return full.na.fill(0, ["segments", "incoming", "outgoing"]).select("id", "title", "segments", "newest", "incoming", "outgoing")


def open_notes(blocks: DataFrame, links: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each ``wanted(title)`` opened: the note of that title (of several the smallest id), else the best note among the five best
    keyword hits for it.

    Returns ``wanted, doc_id, note_title, found, entries, inbound, outbound`` and the entries, all columns of the note's
    segments with ``wanted`` and ``doc_id``. Titles of no note are in the first with found = false.
    """
    docs = blocks.where(F.col("kind") == DOC).select("id", "title")
    asked = wanted.select(F.col("title").alias("wanted")).where("wanted IS NOT NULL").distinct()
    exact = asked.join(docs, asked.wanted == docs.title).groupBy("wanted").agg(F.min("id").alias("doc_id"))
    rest = cut(asked.join(exact, "wanted", "left_anti"), "titles")
    parsed = parse_queries(rest.select(F.col("wanted").alias("query_id"), F.col("wanted").alias("text")))
    found, lengths = postings(blocks.select("id", "title", "content"), ["title", "content"], parsed.select(F.explode("terms").alias("term")))
    hits = keyword_search(found, lengths, parsed, 5).join(docs.select("id"), "id", "left_semi")
    near = hits.groupBy(F.col("query_id").alias("wanted")).agg(F.min_by("id", "rank").alias("doc_id"))
    met = cut(exact.unionByName(near), "opened")
    held = doc_segments(blocks, links).select(F.col("doc").alias("doc_id"), "id")
    entries = met.join(held, "doc_id").join(blocks, "id")
    ids = met.select("doc_id").distinct()
    count = lambda rows, key, name: rows.select(F.col(key).alias("doc_id")).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias(name))
    out = asked.join(met, "wanted", "left").join(docs.select(F.col("id").alias("doc_id"), F.col("title").alias("note_title")), "doc_id", "left")
    for part in (count(held, "doc_id", "entries"), count(links, "to_id", "inbound"), count(links, "from_id", "outbound")):
        out = out.join(part, "doc_id", "left")
    out = out.na.fill(0, ["entries", "inbound", "outbound"])
    return out.select("wanted", "doc_id", "note_title", F.col("doc_id").isNotNull().alias("found"), "entries", "inbound", "outbound"), entries


def valid_links(links: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with both ends, and the unresolved ones (to be kept and tried again)."""
    ids = blocks.select("id").distinct()
    ok = links.join(ids, links.from_id == ids.id, "left_semi").join(ids, links.to_id == ids.id, "left_semi")
    bad = links.join(ok, ["from_id", "to_id", "kind"], "left_anti")
    return ok, bad
