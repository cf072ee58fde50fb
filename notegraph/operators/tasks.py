"""Instruction and workstream tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.operators.text import stem, strip


# Fixed value: part of the task file format, which the programs that pick tasks up are told to read.
TASK_NOTE = (
    "Process the user instruction(s) above in the context of the source block.\n"
    "The instruction text is the user's own words \u2014 interpret and execute accordingly."
)


def slug(text: Column, most: int = 50) -> Column:
    """Words in lower case, joined by dashes, without signs: part of a file name."""
    words = F.split(F.lower(text), r"(?U)[\s_]+")
    words = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"(?U)[^\w-]", "")), lambda w: w != "")
    return F.substring(F.btrim(F.array_join(words, "-"), F.lit("-")), 1, most)


def task_title(instructions: Column, content: Column) -> Column:
    """The first instruction if it says something, else the content's first line."""
    said = F.get(F.filter(F.slice(instructions, 1, 1), lambda x: F.char_length(x) > 5), F.lit(0))
    line = F.nullif(strip(F.regexp_extract(content, r"(?U)\A\s*(\S[^\n]*)", 1)), F.lit(""))
    return F.substring(F.coalesce(said, line, F.lit("untitled task")), 1, 80)


def dispatch(segments: DataFrame, block_id: str | None = None) -> DataFrame:
    """``file_name, title, body``: a pending task for each segment (path, id, content, instructions) that gives one.

    ``block_id``: a column to return as such.
    """
    rows = segments.where(F.size("instructions") > 0).withColumn("title", task_title(F.col("instructions"), F.col("content")))
    quoted = F.array_join(F.transform("instructions", lambda z: F.concat(F.lit("> "), z)), "\n")
    body = F.concat(
        F.lit("---\nstatus: pending\nsource_block_id: "), F.col("id"), F.lit('\nsource_note: "[['), stem(F.col("path")), F.lit(']]"\n---\n# '), F.col("title"),
        F.lit("\n\n## Context\n\n"), strip(F.col("content")), F.lit("\n\n## User instruction\n\n"), quoted,
        F.lit(f"\n\n## Task\n\n{TASK_NOTE}\n\n## Human Todo\n\n## Results\n"),
    )
    return rows.select(F.concat(slug(F.col("title")), F.lit("-"), F.substring("id", 1, 8), F.lit(".md")).alias("file_name"), "title", body.alias("body"), *([F.col(block_id).alias("block_id")] if block_id else []))


def front_matter(content: Column) -> Column:
    """``key: value`` lines of the front matter as a map (the last of a key wins)."""
    head = F.regexp_extract(content, r"(?sd)\A---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"\A[A-Za-z_]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\A([A-Za-z_]+):", 1).alias("key"), strip(F.regexp_replace(x, r"\A[A-Za-z_]+:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def pending(tasks: DataFrame, as_of: Column, settle_seconds: int = 30) -> DataFrame:
    """Task files (path, content, mtime) that are pending and unchanged for ``settle_seconds``."""
    status = F.element_at(front_matter(F.col("content")), "status")
    return tasks.where((status == "pending") & (F.col("mtime").cast("timestamp") <= as_of - F.make_interval(secs=F.lit(settle_seconds))))


def section(content: Column, name: str) -> Column:
    """Text under ``## name`` up to the next heading of that level."""
    return strip(F.regexp_extract(content, rf"(?msd)^## {name}[ \t]*\n(.*?)(?=^## |\z)", 1))


def parse_streams(files: DataFrame) -> DataFrame:
    """``path, stream, status, last_active, context, left_off, log`` of workstream files (path, content)."""
    head = front_matter(F.col("content"))
    return files.select(
        "path",
        *[F.element_at(head, k).alias(k) for k in ("stream", "status", "last_active")],
        section(F.col("content"), "Context").alias("context"),
        section(F.col("content"), "LEFT OFF").alias("left_off"),
        section(F.col("content"), "Log").alias("log"),
    )


def list_streams(streams: DataFrame, status: str | None = None, preview: int = 150) -> DataFrame:
    """Active first, then by last activity; a short preview."""
    rows = streams if status is None else streams.where(F.col("status") == status)
    return rows.select("stream", "status", "last_active", F.substring("left_off", 1, preview).alias("preview")).orderBy(F.col("status") != "active", "last_active", "stream")


def find_streams(streams: DataFrame, wanted: DataFrame, key: Column | None = None) -> DataFrame:
    """For each ``wanted(name)`` the stream whose slug is it, or is its slug, or whose name equals it in any case, in that order.

    ``key``: the slug, by default made of the stream's name.
    """
    s = streams.withColumn("slug", slug(F.col("stream")) if key is None else key)
    met = (
        wanted.join(s, wanted["name"] == s["slug"]).select("name", F.lit(1).alias("rule"), "stream")
        .unionByName(wanted.join(s, slug(wanted["name"]) == s["slug"]).select("name", F.lit(2).alias("rule"), "stream"))
        .unionByName(wanted.join(s, F.lower(wanted["name"]) == F.lower(s["stream"])).select("name", F.lit(3).alias("rule"), "stream"))
    )
    return met.groupBy("name").agg(F.min_by("stream", F.struct("rule", "stream")).alias("stream"))


def stream_context(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full state of the stream that each ``wanted(name)`` means (see :func:`find_streams`); ``found`` is false where none is meant.

    Columns: name, found, slug, stream, status, last_active, linked_sessions, context, left_off, log. A file without a name, a
    status or a day of activity has its file name, ``active`` and the empty text there.
    """
    sessions = F.element_at(front_matter(F.col("content")), "linked_sessions")
    listed = F.filter(F.transform(F.split(F.regexp_replace(sessions, r"[\[\]]", ""), ","), strip), lambda x: x != "")
    more = files.select("path", F.coalesce(listed, F.array().cast("array<string>")).alias("linked_sessions"))
    s = parse_streams(files).join(more, "path").withColumn("slug", stem(F.col("path")))
    s = s.withColumn("stream", F.coalesce("stream", "slug")).withColumn("status", F.coalesce("status", F.lit("active"))).withColumn("last_active", F.coalesce("last_active", F.lit("")))
    met = find_streams(s, wanted, F.col("slug"))
    rest = ["slug", "status", "last_active", "linked_sessions", "context", "left_off", "log"]
    one = s.groupBy("stream").agg(F.min_by(F.struct(*rest), "slug").alias("s"))
    full = wanted.distinct().join(met, "name", "left").join(one, "stream", "left")
    return full.select("name", F.col("stream").isNotNull().alias("found"), "stream", *[F.col(f"s.{c}").alias(c) for c in rest])


def fold_streams(events: DataFrame) -> DataFrame:
    """State of each slug after its update events (slug, seq, left_off, context, status, log, session): the last value
    that is set wins, log lines are joined in order, sessions are a set."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    log = F.array_sort(F.collect_list(F.when(F.col("log").isNotNull(), F.struct("seq", "log"))))
    return events.groupBy("slug").agg(
        last("left_off"),
        last("context"),
        last("status"),
        F.array_join(F.transform(log, lambda x: x["log"]), "\n").alias("log"),
        F.array_join(F.array_sort(F.collect_set("session")), ",").alias("sessions"),
    )
