"""Streams of change events ``(path, event_ts, content)`` and of workstream updates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notegraph.operators.text import excluded
from notegraph.session import shared_dir


def watch(changes: DataFrame, exclude: list[str]) -> DataFrame:
    """Only notes, and not the excluded ones."""
    return changes.where(F.col("path").endswith(".md") & ~excluded(F.col("path"), exclude))


def dedupe(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One event of a path within the watermark."""
    return changes.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["path"])


def debounce(changes: DataFrame, quiet: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """``path, first, fire_at, n``: a path's burst of changes, once it has been quiet for ``quiet``."""
    return (
        changes.withWatermark("event_ts", delay)
        .groupBy("path", F.session_window("event_ts", quiet).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("path", F.col("w.start").alias("first"), F.col("w.end").alias("fire_at"), "n")
    )


STATE = "left_off string, context string, status string, log string, sessions string"


def fold(updates: DataFrame) -> DataFrame:
    """The running state of each slug after its update events (slug, seq, left_off, context, status, log, session)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, context, status, log, sessions = state.get if state.exists else (None, None, None, "", "")
        rows = pd.concat(list(frames)).sort_values("seq")
        seen = set(filter(None, sessions.split(",")))
        lines = [log] if log else []
        for r in rows.itertuples():
            left = r.left_off if r.left_off is not None else left
            context = r.context if r.context is not None else context
            status = r.status if r.status is not None else status
            if r.log is not None:
                lines.append(r.log)
            if r.session is not None:
                seen.add(r.session)
        new = (left, context, status, "\n".join(lines), ",".join(sorted(seen)))
        state.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["slug", "left_off", "context", "status", "log", "sessions"])

    return updates.groupBy("slug").applyInPandasWithState(step, f"slug string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def settle(changes: DataFrame, seconds: int = 30, delay: str = "1 minute") -> DataFrame:
    """``path, fire_at``: each task file (path, event_ts, status) that stayed pending for ``seconds`` without a change, once.

    Event time decides, so that a run over old changes gives what a run at their time gave: a gap of ``seconds`` behind a
    pending version fires, whether the next change ends it or the watermark passes it. Of changes at the same time the last by
    status counts. A path that has fired stays silent.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, status, fired = state.get if state.exists else (None, None, False)
        wait, at = seconds * 1000, None
        if state.hasTimedOut:
            if status == "pending" and not fired:
                at = last + wait
        else:
            rows = pd.concat(list(frames)).sort_values(["ms", "status"])
            for ms, now in zip(rows["ms"].tolist(), rows["status"].tolist(), strict=True):
                if last is not None and at is None and not fired and status == "pending" and ms - last >= wait:
                    at = last + wait
                if last is None or ms >= last:  # a late change of the past does not undo a newer one
                    last, status = ms, now
        fired = fired or at is not None
        state.update((last, status, fired))
        if status == "pending" and not fired:
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if at is not None:
            yield pd.DataFrame({"path": [key[0]], "ms": [at]})

    rows = changes.select("path", "event_ts", F.unix_millis("event_ts").alias("ms"), "status").withWatermark("event_ts", delay).groupBy("path")
    out = rows.applyInPandasWithState(step, "path string, ms bigint", "last bigint, status string, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("path", F.timestamp_millis("ms").alias("fire_at"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote.

    Each batch is written under its number, so that a batch that runs again replaces its own output. Output and
    checkpoint are in the shared folder. In update mode the caller takes the last row of a key.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def newest(batch: DataFrame) -> DataFrame:
    """The last version of each path; of versions of one time the greatest content."""
    return batch.groupBy("path").agg(F.max_by("content", F.struct("event_ts", "content")).alias("content"))


def current(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Of ``rows(path, batch, ...)`` those written by the last batch that had the path (``files(path, batch)``)."""
    last = files.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi")


def ingest(changes: DataFrame, process: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A cycle a batch: the newest version of each path goes through ``process``, whose rows keep the path.

    A path that comes in a later batch again replaces what it gave before, also where it now gives nothing.
    """
    spark = changes.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def cycle(batch: DataFrame, number: int) -> None:
        files = newest(batch)
        files.select("path").write.mode("overwrite").parquet(f"{base}/files/batch={number}")
        process(files).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = changes.writeStream.foreachBatch(cycle).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark.read.parquet(f"{base}/out"), spark.read.parquet(f"{base}/files")).drop("batch")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream. The last letter is a pattern: a stream takes files by pattern."""
    stem, last = path.removesuffix(".parquet")[:-1], path.removesuffix(".parquet")[-1]
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{stem}[{last}].parquet")
