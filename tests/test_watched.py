"""Edits and deletions of files reach the ingest cycle, also after a restart."""

import os

from pyspark.sql import functions as F

from notegraph.operators.embed import HashingModel
from notegraph.sources import watched as W
from notegraph.streaming import cycle as Y


def put(root, name, text, at):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    os.utime(path, (at, at))


def drain(spark, root, state, check, into):
    rows = W.watched(spark, str(root), str(state)).select("path", "content")
    write = lambda batch, _: batch.write.mode("append").parquet(str(into))
    rows.writeStream.foreachBatch(write).option("checkpointLocation", str(check)).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("path string, content string").parquet(str(into)) if any(into.glob("*.parquet")) else None
    return sorted((r.path, r.content) for r in got.collect()) if got else []


def test_edits_and_deletions_come_again(spark, tmp_path):
    root, state, check = tmp_path / "notes", tmp_path / "state", tmp_path / "check"
    put(root, "a.md", "one\r\ntwo", 1000)
    put(root, "sub/b.md", "bee", 1000)
    put(root, "c.txt", "no note", 1000)
    put(root, "bad.md", b"\xff\xfe\xff", 1000)
    assert drain(spark, root, state, check, tmp_path / "1") == [("a.md", "one\ntwo"), ("sub/b.md", "bee")]
    put(root, "a.md", "edited!", 2000)
    (root / "sub/b.md").unlink()
    put(root, "d.md", "new", 2000)
    assert drain(spark, root, state, check, tmp_path / "2") == [("a.md", "edited!"), ("d.md", "new"), ("sub/b.md", None)]
    assert drain(spark, root, state, check, tmp_path / "3") == [], "nothing changed"
    put(root, "a.md", "edited?", 3000)  # as long as before: the time tells
    assert drain(spark, root, state, check, tmp_path / "4") == [("a.md", "edited?")]


def test_a_planned_batch_is_planned_again(tmp_path):
    """Between two listings the difference is the same whatever happened to the folder since."""
    root, state = tmp_path / "notes", tmp_path / "state"
    reader = W.FolderReader({"path": str(root), "state": str(state)})
    start = reader.initialOffset()
    assert reader.latestOffset() == start, "an empty folder"
    put(root, "a.md", "x", 1000)
    end = reader.latestOffset()
    first = reader.partitions(start, end)
    put(root, "b.md", "y", 1000)
    (root / "a.md").unlink()
    again = W.FolderReader({"path": str(root), "state": str(state)})
    assert again.partitions(start, end) == first
    assert list(again.read(first[0])) == [], "gone by now"
    after = again.latestOffset()
    parts = again.partitions(end, after)
    assert [p.changed for p in parts if p.changed][0][0][0] == "b.md" and [p.gone for p in parts if p.gone][0][0][0] == "a.md"


def test_cycle_follows_the_folder(spark, tmp_path):
    root, state, base = tmp_path / "notes", tmp_path / "state", str(tmp_path / "store")
    Y.create(spark, base)

    def now():
        Y.run_stream(W.watched(spark, str(root), str(state)), base, HashingModel)
        return sorted((r.path, r.content) for r in Y.segments_now(spark, base).collect())

    put(root, "a.md", "# A\nfirst\n# B\nsecond\n", 1000)
    put(root, "b.md", "bee", 1000)
    assert now() == [("a.md", "first"), ("a.md", "second"), ("b.md", "bee")]
    put(root, "a.md", "# A\nfirst\n# B\nother\n", 2000)
    (root / "b.md").unlink()
    assert now() == [("a.md", "first"), ("a.md", "other")]
    status = Y.read(spark, base, "diff").where("batch = 1").groupBy("path", "status").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in status.collect()} == {("a.md", "kept", 1), ("a.md", "added", 1), ("a.md", "removed", 1), ("b.md", "removed", 1)}
    put(root, "b.md", "bee", 3000)
    assert now() == [("a.md", "first"), ("a.md", "other"), ("b.md", "bee")], "a file that comes back"
    assert Y.vectors_now(spark, base).count() == 3
