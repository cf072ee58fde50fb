"""The Merkle manifest against a tree built by hand, on rows with every awkward value."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from notegraph.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at int, g string, path string, n long, digest string"
MORE = (1, "x", "y", 2, "z")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*told)


def tree(digests):
    """The root and for each leaf its siblings, level by level, as (before, after)."""
    paths = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        up, over = [], []
        for lo in range(0, len(digests), 3):
            run = digests[lo : lo + 3]
            for k in range(len(run)):
                for x in under[lo + k]:
                    paths[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            over.append([x for part in under[lo : lo + 3] for x in part])
        digests, under = up, over
    return digests[0], paths


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, upper = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (_, _, digest, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + above
            flat = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                flat = leaf(*r[:4], r[4].replace("\n", ""))
            for before, after in path:
                flat = sha(before, flat, after)
            proof = sha("".join(b + a for b, a in path))
            out.append((r[0], digest, trees[s][0], root, proof, flat, flat == root))
    return out


def made():
    texts = [None, "", "a\nb", "\n\n", "é 😀\nx", "x" * 300_000, "same\ntext"]
    rows = [(k, ["s", None, "t", "S", "é"][k % 5] if k % 3 else "s", "en", k, texts[k % 7]) for k in range(180)]
    rows += [(k, "s", None, None, f"row {k}\n") for k in range(1000, 1900)]  # one source with most rows: two blocks
    rows += [(None, "s", "en", 1, "no id\n"), (None, "s", "en", 1, "no id\n"), (7, "s", "en", 1, "again"), (7, "s", "en", 1, "again"), (-5, "lone", "de", 2, "b\n")]
    return [(*r, *MORE) for r in rows]


def shown(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_manifest(spark):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.op11(spark, docs).collect()
    assert shown(got) == shown(expected(rows))
    assert any(r.verified for r in got) and any(not r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 4, 10])
def test_small_trees(spark, n):
    rows = [(k, "s", "en", 1, "t\n", *MORE) for k in range(n)]
    assert shown(merkle.op11(spark, spark.createDataFrame(rows, SCHEMA)).collect()) == shown(expected(rows) if rows else [])


def test_more_levels_than_a_block(spark, monkeypatch):
    """Blocks of nine leaves: three rounds give the same tree."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(k, f"s{k % 2}", "en", 1, f"t{k}\n", *MORE) for k in range(260)]
    assert shown(merkle.op11(spark, spark.createDataFrame(rows, SCHEMA)).collect()) == shown(expected(rows))


def test_verify(spark):
    rows = [(k, f"s{k % 4}", "en", 1, f"text {k}", *MORE) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    proofs = merkle.manifest(docs).cache()
    assert merkle.verify(proofs, docs).where("verified").count() == 40
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 11, "other").otherwise(F.col("text")))
    assert [r.doc_id for r in merkle.verify(proofs, changed).where("NOT verified").collect()] == [11]
    added = docs.withColumn("doc_id", F.col("doc_id") + 35)
    assert merkle.verify(proofs, added).where("verified").count() == 0
    # a proof whose siblings were changed proves nothing
    forged = proofs.withColumn("path", F.transform("path", lambda p: F.struct(F.upper(p["before"]).alias("before"), p["after"].alias("after"))))
    assert merkle.verify(forged, docs).where("verified").count() < 40
    proofs.unpersist()
