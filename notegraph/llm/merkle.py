"""Merkle manifest of a dataset: one digest for all rows, and for each row the siblings that prove it is in there.

Each row is a leaf, each source a tree, the sources' roots the leaves of a last tree. A node is the SHA-256 of up to ``FANOUT``
consecutive digests. One level of a tree is a slot pivot: rows are grouped by their parent, a conditional aggregate per slot
spreads the children into ``FANOUT`` columns, the columns joined are hashed, and the columns without the own slot are a
child's siblings.

Rows are dealt by (tree, block of ``FANOUT ** LEVELS`` leaves), so one shuffle serves ``LEVELS`` levels and no task needs more than
a block at a time, however large a source is. Going up, only digests are written, each round a small part of the one before; going
down, the blocks are pivoted once more and meet the path above them. Positions in a source come from a range partitioning: rows
of a (source, range) pair are counted and numbered, and the counts of the ranges before are added.

Defined results: a null value is ``-``, any other its UTF-8 length, a colon and the value; a null doc_id comes first; rows with
equal doc_id are ordered by their leaf digest, equal rows are leaves of their own; a null source is a tree of its own, before all
others; an empty table gives no rows; texts are hashed whole; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.common import cut, slim

#: Children of a node; levels that one shuffle serves (a block is FANOUT ** LEVELS leaves).
FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the values: each ``-`` if null, else UTF-8 byte count, colon, value."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*told), 256)


def tree_key(source: Column) -> Column:
    """A string that is never null and sorts as the source does, null first."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows(g, by, digest, ...)`` with ``at``, the place from 0 within ``g`` by (by, digest), and ``n``, the rows of ``g``."""
    dealt = cut(rows.repartitionByRange("g", "by", "digest").withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("c"))
    # as many rows as ranges at most, for one g
    whole = Window.partitionBy("g")
    ahead = F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("g", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"), F.sum("c").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "part").orderBy("by", "digest"))
    return dealt.join(starts, ["g", "part"]).withColumn("at", F.col("ahead") + inside - 1).drop("part", "ahead", "by")


def pivot_level(nodes: DataFrame, below: int, paths: bool) -> DataFrame:
    """The parents of ``nodes(g, n, block, at, digest[, members])``; ``below`` levels lie under the nodes.

    A tree that is down to one node there stays as it is. ``members`` are the leaves under a node with their paths so far.
    """
    kept = ["digest", "members"] if paths else ["digest"]
    slot = F.col("at") % FANOUT
    slots = [F.max(F.when(slot == k, F.struct(*kept))).alias(f"s{k}") for k in range(FANOUT)]
    spread = nodes.groupBy("g", "n", "block", F.expr(f"at div {FANOUT}").alias("at")).agg(*slots)
    digest = [F.coalesce(F.col(f"s{k}.digest"), F.lit("")) for k in range(FANOUT)]
    grows = F.col("n") > FANOUT**below
    out = ["g", "n", "block", "at", F.when(grows, F.sha2(F.concat(*digest), 256)).otherwise(digest[0]).alias("digest")]
    if paths:
        told = []
        for k in range(FANOUT):
            before, after = (F.concat(F.lit(""), *x).alias(c) for x, c in ((digest[:k], "before"), (digest[k + 1 :], "after")))
            step = F.when(grows, F.array(F.struct(before, after))).otherwise(F.array().cast(PATH))
            told.append(F.transform(f"s{k}.members", _longer(step)))
        out.append(F.flatten(F.array_compact(F.array(*told))).alias("members"))
    return spread.select(*out)


def _longer(step: Column) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["item"].alias("item"), F.concat(m["path"], step).alias("path"))


def pivot_block(nodes: DataFrame, below: int, item: Column | None = None) -> DataFrame:
    """``g, n, block, digest[, members]``: ``LEVELS`` levels of ``nodes(g, n, at, digest)`` after one shuffle; ``item`` goes along."""
    size = FANOUT**LEVELS
    keep = [F.array(F.struct(item.alias("item"), F.array().cast(PATH).alias("path"))).alias("members")] if item is not None else []
    rows = nodes.select("g", "n", F.expr(f"at div {size}").alias("block"), (F.col("at") % size).alias("at"), "digest", *keep)
    rows = rows.repartition("g", "block")
    for k in range(LEVELS):
        rows = pivot_level(rows, below + k, item is not None)
    return rows.drop("at")


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The nodes ``(g, n, at, digest)`` of every ``LEVELS``-th level, from the leaves to one node a tree."""
    rounds, below = [leaves], 0
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1 and FANOUT**below < most:
        rounds.append(cut(pivot_block(rounds[-1], below).withColumnRenamed("block", "at"), "nodes"))
        below += LEVELS
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns of the leaves with their ``path`` (nearest siblings first) and the columns of ``above(g, path, ...)``.

    ``above`` has one row a tree; each round's blocks meet the row of the node they make.
    """
    top = above.withColumn("at", F.lit(0).cast("long"))
    more = [c for c in above.columns if c not in ("g", "path")]
    for k in reversed(range(len(rounds) - 1)):
        names = carry if k == 0 else ("at",)
        blocks = pivot_block(rounds[k], k * LEVELS, F.struct(*names)).select("g", F.col("block").alias("at"), "members")
        met = blocks.join(top, ["g", "at"]).select("g", *more, F.col("path").alias("up"), F.explode("members").alias("m"))
        top = met.select("g", *more, "m.item.*", F.concat("m.path", "up").alias("path"))
    if len(rounds) == 1:  # trees of one leaf
        top = rounds[0].drop("at").join(top.drop("at"), "g").select("g", *more, *carry, "path")
    return top


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings make."""
    return F.aggregate(path, digest, lambda x, p: F.sha2(F.concat(p["before"], x, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def manifest(docs: DataFrame, **also: Column) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, path`` of every row, and ``also``: columns over ``FIELDS`` read in the same scan."""
    rows = slim(docs, *FIELDS)
    rows = rows.select(tree_key(F.col("source")).alias("g"), "doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("digest"), *[c.alias(k) for k, c in also.items()])
    leaves = cut(ranked(cut(rows.withColumn("by", F.col("doc_id")), "leaves")).withColumn("leaf", F.col("digest")), "ranked")
    rounds = climb(leaves)
    subroots = rounds[-1].where("at = 0").select(F.lit("").alias("g"), F.col("g").alias("by"), F.col("g").alias("tree"), "digest")
    sources = cut(ranked(subroots).withColumn("subroot", F.col("digest")), "subroots")
    upper = climb(sources)
    root = upper[-1].select("g", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = cut(descend(upper, root, "tree", "subroot").select(F.col("tree").alias("g"), "path", "subroot", "root"), "tree-paths")
    return descend(rounds, above, "doc_id", "source", "leaf", *also).drop("g", "at")


def verify(proofs: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, verified`` of the rows of ``docs``: whether some proof of that doc_id leads from the row to its root.

    A row whose doc_id has no proof is not verified.
    """
    rows = slim(docs, *FIELDS).select("doc_id", leaf_digest(*map(F.col, FIELDS)).alias("leaf"))
    met = proofs.select("root", "path", F.col("doc_id").alias("__id"), F.col("leaf").alias("__leaf"))
    met = met.where(folded(F.col("__leaf"), F.col("path")) == F.col("root")).select("__id", "__leaf").distinct()
    found = rows.join(met, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("leaf") == F.col("__leaf")), "left")
    return found.select("doc_id", "leaf", F.col("__leaf").isNotNull().alias("verified"))


def tampered_leaf() -> Column:
    """The leaf without the line feeds of its text, where crc32 of the doc_id is even and there are some; else null."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return F.when(hit, leaf_digest(*[flat if c == "text" else F.col(c) for c in FIELDS]))


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = manifest(docs, tampered=tampered_leaf())
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 12) -> str:
    """SQL with one step a level; sources of up to FANOUT ** levels rows."""
    told = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    h = lambda text: "sha256(" + " || ".join([*map(told, FIELDS[:-1]), told(text)]) + ")"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    step = "list_reduce(list_prepend({0}, range(8)), lambda c, k: {1})".format("xor(c, CAST(b AS BIGINT))", bit)
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ord(s)::BIGINT)), lambda c, b: {step}))"
    parts = [f"""leaves AS (SELECT row_number() OVER () AS r, doc_id, source, {h('text')} AS leaf,
  CASE WHEN ({crc}) % 2 = 0 THEN {h("replace(text, chr(10), '')")} END AS flat FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
n0 AS (SELECT source, n, i, leaf AS d FROM placed)"""]  # fmt: skip
    level = """n{1} AS MATERIALIZED (SELECT {2} n, i // 3 AS i, CASE WHEN n > {3} THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM n{0} GROUP BY {2} n, i // 3),
p{0} AS MATERIALIZED (SELECT {2} n, i // 3 AS up, CASE WHEN n > {3} THEN list(d ORDER BY i) END AS run FROM n{0} GROUP BY {2} n, i // 3)"""
    for k in range(levels):
        parts.append(level.format(k, k + 1, "source,", 3**k))
    parts.append(f"""tops AS (SELECT source, d AS subroot FROM n{levels}),
sources AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, subroot AS d, source FROM tops),
n100 AS (SELECT n, i, d FROM sources)""")  # fmt: skip
    for k in range(100, 106):
        parts.append(level.format(k, k + 1, "", 3 ** (k - 100)))
    joins, before, after = [], [], []
    for k in [*range(levels), *range(100, 106)]:
        at, base = ("x.i", k) if k < 100 else ("s.i", k - 100)
        same = "p{0}.source IS NOT DISTINCT FROM x.source AND ".format(k) if k < 100 else ""
        joins.append(f"JOIN p{k} ON {same}p{k}.up = {at} // {3 ** (base + 1)}")
        slot = f"({at} // {3**base}) % 3"
        before.append(f"coalesce(array_to_string(p{k}.run[1:{slot}], ''), '')")
        after.append(f"coalesce(array_to_string(p{k}.run[{slot} + 2:], ''), '')")
    runs = [f"p{k}.run IS NOT NULL" for k in [*range(levels), *range(100, 106)]]
    path = ", ".join(f"struct_pack(b := {b}, a := {a}, go := {g})" for b, a, g in zip(before, after, runs, strict=True))
    parts.append(f"""paths AS (SELECT x.doc_id, x.leaf, x.flat, s.d AS subroot, n106.d AS root, [{path}] AS path
  FROM placed x JOIN sources s ON s.source IS NOT DISTINCT FROM x.source CROSS JOIN n106 {' '.join(joins)}),
folds AS (SELECT *, sha256(array_to_string(list_transform(path, lambda p: p.b || p.a), '')) AS proof_sha256,
  list_reduce(list_prepend(struct_pack(b := coalesce(flat, leaf), a := '', go := true), path),
    lambda x, p: struct_pack(b := CASE WHEN p.go THEN sha256(p.b || x.b || p.a) ELSE x.b END, a := '', go := true)).b AS folded_root FROM paths)""")  # fmt: skip
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds"


ORACLE = _oracle()
