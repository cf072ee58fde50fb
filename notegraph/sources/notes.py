"""Note folders in, segments and pages out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.text import excluded

#: What is no note anywhere: hidden folders (editor state, version control, trash) and templates. Callers name their own.
EXCLUDE = ["**/.*/**", "**/templates/**"]


def relative(path: Column, root: str) -> Column:
    plain = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    return F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), f"^{plain}/", "")


def decoded(files: DataFrame, root: str, exclude: list[str] | None = None) -> DataFrame:
    """``path, content, mtime, hash`` of binary files; those that are not UTF-8 are left out, as are excluded paths.

    The hash is of the bytes, the content has ``\\r\\n`` turned into ``\\n``; so a file that did not change never looks changed.
    """
    rows = files.where(F.is_valid_utf8(F.col("content"))).select(
        relative(F.col("path"), root).alias("path"),
        F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n").alias("content"),
        F.col("modificationTime").alias("mtime"),
        F.substring(F.sha2("content", 256), 1, 16).alias("hash"),
    )
    return rows.where(~excluded(F.col("path"), EXCLUDE if exclude is None else exclude))


def scan_notes(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """All ``*.md`` files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return decoded(files, root, exclude)


def stream_notes(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """New ``*.md`` files as they arrive. A file source reads each path once: write an edit as a new file."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return decoded(files, root, exclude)


def export_ndjson(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").json(path)


def as_markdown(segments: DataFrame) -> DataFrame:
    """``value``: a readable block of text per segment."""
    head = F.concat(F.lit("## "), F.coalesce("section_heading", F.lit("segment")), F.lit(" ("), "path", F.lit(")"))
    return segments.select(F.concat_ws("\n", head, "content", F.lit("")).alias("value"))


def export_markdown(segments: DataFrame, path: str) -> None:
    as_markdown(segments).write.mode("overwrite").text(path)


def safe_name(title: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|]', "-")), 1, 100)


def render_pages(blocks: DataFrame) -> DataFrame:
    """``rel_path, content`` of generated pages (kind, title, content), a folder by kind."""
    kind = F.regexp_replace("kind", "^context_block:", "")
    folder = F.when(kind == "cluster", "clusters").when(kind == "bridge", "bridges").when(kind == "tag", "tags").otherwise("notes")
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return blocks.select(F.concat(folder, F.lit("/"), safe_name(F.col("title")), F.lit(".md")).alias("rel_path"), body.alias("content"))


#: Pages of one name, by the type of what they show; a hub or a concept has a page of its own in that folder.
SINGLE_PAGES = {"index": "INDEX.md", "recent_activity": "RECENT.md", "graph_health": "HEALTH.md"}
FOLDER_PAGES = {"hub_summary": "hubs", "concept": "concepts"}


def plain_name(name: Column) -> Column:
    """A name as a file name: slashes are dashes, other signs but dash, underscore and blank are left out."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(name, r"[/\\]", "-"), r"(?U)[^\p{L}\p{N}\-_ ]", ""))
    return F.when(kept == "", "unnamed").otherwise(kept)


def compiled_pages(blocks: DataFrame) -> DataFrame:
    """``rel_path, content`` of compiled blocks (id, context_type, scope, content), routed by type; other types give no page.

    Of blocks of one path the one of the greatest id stays, as the last written would.
    """
    kind = F.col("context_type")
    path = F.lit(None).cast("string")
    for t, name in SINGLE_PAGES.items():
        path = F.when(kind == t, name).otherwise(path)
    own = plain_name(F.replace(F.coalesce("scope", F.lit("unknown")), F.lit("tag:"), F.lit("")))
    for t, folder in FOLDER_PAGES.items():
        path = F.when(kind == t, F.concat(F.lit(folder + "/"), own, F.lit(".md"))).otherwise(path)
    rows = blocks.select(path.alias("rel_path"), "id", F.coalesce("content", F.lit("")).alias("content")).where("rel_path IS NOT NULL")
    return rows.groupBy("rel_path").agg(F.max_by("content", "id").alias("content"))
