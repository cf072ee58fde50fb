"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, document after document in the order of a hash, are packed into blocks of ``BLOCK`` words. The mix is
a run of shards of ``SHARD`` block slots. Every slot draws a hashed uniform number and belongs to the source in whose stretch
of the unit interval that lies; so a shard's counts are a multinomial draw with the targets' shares. Over the whole mix a
multinomial is off its mean by about the root of a source's slots, which for small sources is more than "near the target":
each shard's drawn count is therefore scaled by wanted / drawn of its source (cumulated counts are scaled and rounded down, so
that the whole mix has exactly the wanted number), which spreads the correction over all shards. The j-th slot of a source
takes block perm(j mod blocks) of pass j div blocks, perm an affine permutation of the block numbers that differs by source and
pass, and slots meet blocks in a join by (source, block).

Nothing depends on partitions or row numbers: order, chunks and draws are hashes of (doc_id, text) and of fixed numbers, so
reruns agree however the table is dealt.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating; they share 150% of all words; a target stops
at twice its source, and the excess is reshared by weight until none is above. With sources sorted by cap / weight the
level of the rest is the largest of (total - caps before) / (weights from here on); so no loop is needed.

A source may hold a third of all rows: offsets in its run of words are sums within (source, chunk) plus sums of chunk
totals, with about the root of the rows in a chunk and as many chunks. Slots are drawn in ranges and dealt out by (source,
shard) before they are listed, so their number is that of the tasks times a constant.

Defined results: null and empty texts have size 0 and take 0; null source is a source of its own; repeated rows count each;
texts of any length count whole; extra columns are ignored (``mixed_documents`` keeps them); no rows in, no rows out; if no
document has a word every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.common import WORD, cut, slim

BLOCK, SHARD = 64, 1024
WEIGHTS = (3, 1, 2)
SEED = 20
#: A share of a document as a whole number: so many make one.
UNIT = 1 << 20
#: Cells of the unit interval in which slots look for their source; slots that one task draws or lists.
CELLS, SLOTS = 1024, 1 << 20
#: Primes; one that does not divide the number of blocks is coprime to it.
PRIMES = (2654435761, 2246822519, 3266489917, 668265263, 374761393)


def _keys() -> list[Column]:
    """What names a row, whatever its partition: its id and two hashes of id and text."""
    return [F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(1), "text", "doc_id").alias("g")]


def sizes(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, h, g, size, copies)``, written once; rows that are equal in all of it are one with ``copies``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = slim(docs, "doc_id", "source", "text").select("source", *_keys(), size)
    return cut(rows.groupBy("source", "doc_id", "h", "g", "size").agg(F.count("*").alias("copies")), "sizes")


def targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """One row per source: number, size, target, blocks, and its stretch [low, high) of the unit interval.

    The windows run over the sources, not over documents.
    """
    by = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("number", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("number") % len(weights) + 1))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(every) * share).withColumn("most", F.col("source_size") * cap)
    rank = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    by = by.withColumn("target", F.least("most", F.max("level").over(every) * F.col("weight")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    high = F.when(F.col("total") > 0, F.sum("target").over(upto) / F.sum("target").over(every)).otherwise(0.0)
    by = by.withColumn("high", F.least(F.lit(1.0), high))
    by = by.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    by = by.withColumn("high", F.when(F.lead("number").over(order).isNull() & (F.col("total") > 0), 1.0).otherwise(F.col("high")))
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / block))
    by = by.withColumn("slots", F.ceil(F.col("total") / block))
    want = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * cap)
    by = by.withColumn("want", F.coalesce(want, F.lit(0.0)).cast("long"))
    return cut(by.select("source", "number", "source_size", "target", "low", "high", "blocks", "slots", "want"), "targets")


def uniform(*of: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def drawn_counts(targeted: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``(number, shard, n)``: the multinomial counts, as drawn."""
    spark = targeted.sparkSession
    slots = targeted.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    at = F.col("id")
    range_ = spark.range(0, int(slots), 1, max(8, int(slots) // SLOTS + 1)).select(F.floor(at / shard).alias("shard"), uniform(F.lit(seed), at).alias("u"))
    range_ = range_.withColumn("cell", F.floor(F.col("u") * CELLS))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    held = targeted.where("high > low").select("number", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)).alias("cell"))
    held = cut(held, "stretches")  # at most CELLS rows and two a source
    met = range_.join(held, "cell").where("u >= low AND u < high")
    return met.groupBy("number", "shard").agg(F.count("*").alias("n"))


def shard_counts(targeted: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``(number, blocks, shard, first, n)``: the source's slots first .. first+n-1 are in the shard."""
    drawn = cut(drawn_counts(targeted, shard, seed).withColumn("part", F.floor(F.col("shard") / 1024)), "drawn")
    parts = drawn.groupBy("number", "part").agg(F.sum("n").alias("of_part"))
    whole = Window.partitionBy("number").orderBy("part")
    parts = parts.withColumn("base", F.sum("of_part").over(whole) - F.col("of_part"))
    parts = parts.withColumn("all", F.sum("of_part").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    near = Window.partitionBy("number", "part").orderBy("shard")
    rows = drawn.withColumn("upto", F.sum("n").over(near)).join(parts.select("number", "part", "base", "all"), ["number", "part"])
    rows = rows.join(targeted.select("number", "blocks", "want"), "number")
    after = F.col("base") + F.col("upto")
    scaled = lambda x: F.when(x == F.col("all"), F.col("want")).otherwise(F.floor(x * (F.col("want") / F.col("all"))))
    rows = rows.select("number", "blocks", "shard", scaled(after - F.col("n")).alias("first"), scaled(after).alias("end"))
    none = targeted.where("want > 0").join(parts.select("number").distinct(), "number", "left_anti")
    rows = rows.unionByName(none.select("number", "blocks", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("want").alias("end")))
    return rows.select("number", "blocks", "shard", "first", (F.col("end") - F.col("first")).alias("n")).where("n > 0")


def drawn_blocks(counts: DataFrame, seed: int = SEED, slots: int = 0) -> DataFrame:
    """``(number, block, uses)``: how often the mix takes each block. ``slots``: about how many there are, for the tasks."""
    dealt = counts.repartition(max(8, slots // SLOTS + 1), "number", "shard")
    slots_ = dealt.select("number", "blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    primes = F.filter(F.array(*[F.lit(p) for p in PRIMES]), lambda p: F.col("blocks") % p != 0)
    hashed = F.xxhash64(F.lit(seed), "number", turn)
    a = F.get(primes, F.pmod(hashed, F.size(primes)).cast("int"))
    b = F.pmod(F.xxhash64(F.lit(seed + 1), "number", turn), F.col("blocks"))
    at = F.col("slot") % F.col("blocks")
    wide = lambda c: c.cast("decimal(19,0)")
    short = F.pmod(F.pmod(a, F.col("blocks")) * at + b, F.col("blocks"))
    long = F.pmod(wide(F.pmod(a, F.col("blocks"))) * wide(at) + wide(b), wide(F.col("blocks"))).cast("long")
    block = F.when(F.col("blocks") < 3_000_000_000, short).otherwise(long)
    return slots_.select("number", block.alias("block")).groupBy("number", "block").agg(F.count("*").alias("uses"))


def placed(sized: DataFrame, targeted: DataFrame) -> DataFrame:
    """Each row with words: its source's number and its first word's place in the source's run of words.

    Copies of a row follow one another, ``copy`` their number; (number, start) names a copy.
    """
    chunks = max(1, math.isqrt(sized.count()))
    known = targeted.select(F.col("source").alias("__source"), "number")
    rows = sized.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(3)), F.lit(chunks))).withColumn("words", F.col("size") * F.col("copies"))
    totals = rows.groupBy("number", "chunk").agg(F.sum("words").alias("sum"))
    totals = totals.select("number", "chunk", (F.sum("sum").over(Window.partitionBy("number").orderBy("chunk")) - F.col("sum")).alias("base"))
    near = Window.partitionBy("number", "chunk").orderBy("h", "g", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("words").over(near) - F.col("words"))
    rows = rows.join(totals.hint("merge"), ["number", "chunk"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.select("doc_id", "h", "g", "size", "number", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("start"))


def taken_words(sized: DataFrame, targeted: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``doc_id, h, g, size, number, start, taken`` of every row with words."""
    slots = targeted.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    drawn = drawn_blocks(shard_counts(targeted, shard, seed), seed, int(slots))
    at = placed(sized, targeted).withColumn("end", F.col("start") + F.col("size"))
    pieces = at.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    words = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    pieces = pieces.withColumn("words", words)
    # by sort-merge: packed rows look small to the planner, and a copy of them in every task would grow with the input
    met = pieces.join(drawn.hint("merge"), ["number", "block"], "left")
    uses = F.coalesce(F.col("uses"), F.lit(0))
    return met.groupBy("number", "start", "doc_id", "h", "g", "size").agg(F.sum(F.col("words") * uses).alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken``."""
    sized = sizes(docs)
    targeted = targets(sized, block=block)
    got = taken_words(sized, targeted, block, shard, seed).join(targeted.select("number", "source", "source_size", "target"), "number")
    none = sized.where("size = 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    none = none.join(targeted.select(F.col("source").alias("__source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__source")))
    none = none.withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source", "source_size", "target", "taken"]
    return got.select(*columns).unionByName(none.select(*columns))


def running(rows: DataFrame, of: Column, name: str) -> DataFrame:
    """``rows(number, class, sub, words, h, doc_id, ...)`` with the sum of ``of`` over its source up to each row, short documents first.

    Sums of whole numbers, so that every run agrees; sources are cut by class of size and part of it, and only the cuts' sums are
    added in one place.
    """
    place = ["number", "class", "sub"]
    rows = rows.withColumn("__of", of)
    sums = rows.groupBy(*place).agg(F.sum("__of").alias("__sum"))
    ahead = F.sum("__sum").over(Window.partitionBy("number").orderBy("class", "sub").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*place, F.coalesce(ahead, F.lit(0)).alias("__start"))
    inside = F.sum("__of").over(Window.partitionBy(*place).orderBy("words", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(starts, place).withColumn(name, F.col("__start") + inside).drop("__of", "__start")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The documents as the mix has them: none, one or two rows of each. All columns stay.

    A document's share of words taken, 0 to 2 of its size, is rounded up or down by where the cumulated shares of its source
    pass whole numbers, documents of like size next to each other. What a source is then off its words, less than a longest
    document or two, is made good by rounding some of its shortest the other way. One without words stays once; rows with
    equal id and text go together.
    """
    sized = sizes(docs)
    targeted = targets(sized, block=block)
    got = taken_words(sized, targeted, block, shard, seed).groupBy("number", "doc_id", "h", "g").agg(F.sum("taken").alias("taken"), F.sum("size").alias("words"))
    got = got.withColumn("part", F.round(F.col("taken") / F.col("words") * UNIT).cast("long")).withColumn("class", F.floor(4 * F.log2("words")).cast("int"))
    got = cut(got, "shares")
    got = got.withColumn("sub", F.pmod("h", F.lit(max(1, got.count() >> 20))))
    upto = F.col("upto") + F.pmod(F.xxhash64(F.lit(seed + 2), "number"), F.lit(UNIT))
    times = F.floor(upto / UNIT) - F.floor((upto - F.col("part")) / UNIT)
    once = cut(running(got, F.col("part"), "upto").withColumn("times", F.least(times, F.lit(2)).cast("long")).drop("upto"), "rounded")
    off = once.groupBy("number").agg((F.sum("taken") - F.sum(F.col("times") * F.col("words"))).alias("off"))
    turn = F.when((F.col("off") > 0) & (F.col("times") * UNIT < F.col("part")), 1).when((F.col("off") < 0) & (F.col("times") * UNIT > F.col("part")), -1).otherwise(0)
    # by class of size and part of it as well: a source may hold a third of all documents
    place = ["number", "class", "sub"]
    near = once.groupBy(*place).agg(F.lit(1).alias("one")).drop("one").join(off, "number")
    turned = running(once.join(near, place).withColumn("turn", turn), F.abs("turn") * F.col("words"), "spent")
    times = F.col("times") + F.when(F.col("spent") <= F.abs("off"), F.col("turn")).otherwise(0)
    uses = turned.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("g").alias("__g"), times.cast("int").alias("__uses"))
    none = sized.where("size = 0").select("doc_id", "h", "g", F.lit(1)).distinct().toDF("__id", "__h", "__g", "__uses")
    uses = cut(uses.where("__uses > 0").unionByName(none), "uses")
    keyed = docs.withColumn("__h1", F.xxhash64("doc_id", "text"))
    met = keyed.join(uses.hint("merge"), docs["doc_id"].eqNullSafe(uses["__id"]) & (keyed["__h1"] == uses["__h"]))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__uses")))).select(*[docs[c] for c in docs.columns])


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
