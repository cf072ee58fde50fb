"""Bottom-k fingerprints against exact shingle sets, on rows with every awkward value."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from notegraph.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, bucket int, sketch string, key string, to int, guest boolean, next string"
MORE = (9, "s", "k", 1, True, "n")
R = random.Random(8)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(500)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h >> 16


def hashes(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {chained(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def bottom(text):
    return sorted(hashes(text))[:128]


def shown(s):
    return "".join(f"{h:012x}" for h in s)


def jaccard(a, b):
    """The estimate: common and all hashes up to where both sketches are complete."""
    end = min([s[-1] for s in (a, b) if len(s) == 128], default=1 << 48)
    a, b = ({h for h in s if h <= end} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    at = sorted(((-(1 << 63) if i is None else i), signed(t or ""), t or "", i) for i, t, *_ in rows)
    out = []
    for k, (_, _, text, doc_id) in enumerate(at):
        follow = at[(k + 1) % len(at)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        a, b, c = bottom(text), bottom(edited), bottom(follow)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), jaccard(a, b), jaccard(a, c)))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA).repartition(4)
    return [tuple(r) for r in fp.op13(spark, docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]


def check(spark, rows):
    assert sorted(run(spark, rows), key=str) == sorted(expected(rows), key=str)


BASE = [None, "", " \n\t", "one", "Two Words", "a b c d e", "a b c d e f", prose(40, 1), prose(40, 1).upper(), "x" * 50_000, prose(20_000, 2), "é 😀 ÀÉ " * 30, "a b " * 200, "odd space" * 7]


def test_awkward_rows(spark):
    rows = [(k * 7 - 20, t) for k, t in enumerate(BASE)]
    rows += [(1, prose(300, 3)), (1, prose(300, 3)), (1, prose(90, 4)), (None, prose(60, 5)), (None, "no id"), (1 << 62, "far"), (-(1 << 62), "low")]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(5, "only one row of text here")], [(None, None)], [(1, "a"), (2, "b")]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_buckets_and_hot_ids(spark, monkeypatch):
    """Many buckets, sparse ids, and a third of all rows without an id."""
    monkeypatch.setattr(fp, "ROWS", 16)
    r = random.Random(1)
    rows = [(r.randrange(-(10**15), 10**15) if k % 2 else k, prose(r.randint(0, 30), k)) for k in range(400)]
    rows += [(None, prose(8, k)) for k in range(200)] + [(77, prose(8, k)) for k in range(100)]
    check(spark, rows)


def test_sketches_of_parts_merge(spark):
    parts = [(k % 3, prose(200, k % 40)) for k in range(120)] + [(3, ""), (3, None), (None, "a b c")]
    made = spark.createDataFrame(parts, "g int, text string").select("g", fp.sketch(F.col("text")).alias("sketch"))
    got = {r.g: list(r.sketch) for r in fp.merged(made, "g").collect()}
    for g in (0, 1, 2, 3, None):
        assert got[g] == sorted(set().union(*[hashes(t) for x, t in parts if x == g]))[:128]
    two = spark.createDataFrame([(prose(300, 1), prose(250, 2))], "a string, b string").select(fp.union(fp.sketch(F.col("a")), fp.sketch(F.col("b"))).alias("u"))
    assert list(two.first().u) == sorted(hashes(prose(300, 1)) | hashes(prose(250, 2)))[:128]


def test_estimates(spark):
    pairs = []
    for k in range(60):
        a = prose(1500, k).split()
        cut_at = 25 * k
        pairs.append((" ".join(a), " ".join(a[:cut_at])))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    rows = rows.select("a", "b", fp.resemblance(F.col("x"), F.col("y")).alias("j"), fp.containment(F.col("y"), F.col("x")).alias("c"), fp.containment(F.col("x"), F.col("y")).alias("d"), fp.distinct_shingles(F.col("x")).alias("n"), (fp.read(fp.told(F.col("x"))) == F.col("x")).alias("same"))
    off = []
    for r in rows.collect():
        a, b = hashes(r.a), hashes(r.b)
        assert r.same
        assert r.c == 1.0, "a part is contained in the whole"
        off.append((abs(r.j - len(a & b) / len(a | b)), abs(r.d - len(a & b) / len(a)), abs(r.n / len(a) - 1)))
    means = [sum(x) / len(off) for x in zip(*off, strict=True)]
    assert means[0] < 0.05 and means[1] < 0.05 and means[2] < 0.1
    assert max(x[0] for x in off) < 0.2
