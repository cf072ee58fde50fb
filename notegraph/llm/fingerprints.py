"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest different 48-bit hashes of a text's runs of ``WIDTH`` lower-cased words. The
smallest hashes of a union are among the smallest of its parts, so sketches of parts merge into the sketch of the whole. Up to the
smaller of two sketches' ends both are complete: there the share of common hashes estimates resemblance and containment, and how
dense the hashes lie estimates their number; sets of fewer than ``K`` shingles are compared exactly.

Texts meet their successor by id without a second move: quantiles of the ids cut the table into buckets (found by binary search in a
sorted array), texts are dealt by bucket once, and the first row of each bucket is sent along to the bucket before. An id with
more rows than a bucket (null, say) is cut further by the hash of its texts.

Defined results: a null text is empty; fewer than ``WIDTH`` words are one shingle, none make an empty sketch; two empty sketches are
alike (1), an empty and another are not (0), and an empty one is contained in any (1); a null doc_id counts as the smallest long;
rows with equal doc_id follow each other by the hash of their texts; a single row is its own successor; an empty table gives no rows;
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.common import slim

WIDTH, K, BITS = 5, 128, 48
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a bucket, and buckets at most (a list of so many ids is sent to the tasks).
ROWS, BUCKETS = 256, 1 << 16
LEAST = -(1 << 63)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The hashes of a text's runs of ``width`` words, repeats included."""
    # a hash takes its words one after another and skips those that are not there
    one = lambda w, i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + k) for k in range(width)]), 64 - BITS)
    last = lambda w: F.greatest(F.size(w) - width, F.lit(0))
    runs = lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last(w)), lambda i: one(w, i)))
    return let(F.array_remove(F.split(F.lower(text), SPACES), ""), runs)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return smallest(shingle_hashes(F.coalesce(text, F.lit("")), width), k)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return smallest(F.concat(a, b), k)


def _end(s: Column, k: int) -> Column:
    """Up to here a sketch holds all hashes."""
    return F.when(F.size(s) < k, F.lit(1 << BITS)).otherwise(F.get(s, F.lit(k - 1)))


def _shares(a: Column, b: Column, k: int, f: Callable[[Column, Column, Column], Column]) -> Column:
    """``f`` of the numbers of hashes in both, in ``a`` and in ``b``, up to where both sketches are complete."""
    upto = lambda s, end: F.size(F.filter(s, lambda h: h <= end))
    counts = let(F.least(_end(a, k), _end(b, k)), lambda end: F.struct(upto(F.array_intersect(a, b), end).alias("both"), upto(a, end).alias("a"), upto(b, end).alias("b")))
    return let(counts, lambda c: f(c["both"], c["a"], c["b"]))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated Jaccard similarity of the shingle sets."""
    share = lambda both, x, y: F.when(x + y > 0, both / (x + y - both)).otherwise(1.0)
    return _shares(a, b, k, share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the shingles of ``a`` that ``b`` has as well."""
    return _shares(a, b, k, lambda both, x, y: F.when(x > 0, both / x).when(F.size(a) == 0, 1.0).otherwise(0.0))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """The estimated number of different shingles; exact where the sketch is not full."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * float(1 << BITS) / F.get(s, F.lit(k - 1)))


def told(s: Column) -> Column:
    """A sketch as text: 12 hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def read(text: Column) -> Column:
    """The sketch that :func:`told` has written."""
    return F.transform(F.regexp_extract_all(text, F.lit(f".{{{BITS // 4}}}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def merged(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """``by, sketch`` of ``parts(by, sketch)``: the sketches of the parts of each group as one.

    Repeats of a hash fall together map-side, and a task passes on at most ``k`` hashes of a group; so a group may hold any
    number of parts. Groups that hold nothing but empty sketches have an empty one.
    """
    each = parts.select(by, F.explode_outer("sketch").alias("h")).groupBy(by, "h").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("h").asc_nulls_last()))
    few = each.withColumn("place", place).where(F.col("place") <= k)
    return few.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


# successors -------------------------------------------------------------------------------------------------------


def _passed(bounds: Column, n: int, reached: Callable[[Column], Column]) -> Column:
    """How many of the ``n`` sorted bounds are reached, by binary search."""
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(n.bit_length()))])
    further = lambda at, step: (at + step <= n) & reached(F.get(bounds, at + step - 1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def numbers(values: list, kind: str) -> Column:
    """A constant array, as one expression however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows(key, text, ...)`` with ``bucket``, which never falls as (key, hash of text) rises, and ``fine``, that hash where it counts."""
    parts = min(BUCKETS, max(1, rows.count() // ROWS))
    found = None
    if parts > 1:
        shares = numbers([k / parts for k in range(1, parts)], "double")
        found = rows.agg(F.percentile_approx("key", shares, F.lit(max(10_000, 8 * parts)))).first()[0]
    if not found:
        return rows.withColumn("fine", F.lit(0).cast("long")).withColumn("bucket", F.lit(0))
    n, bounds = len(found), numbers(found, "bigint")
    upper = _passed(bounds, n, lambda b: b <= F.col("key"))
    if len(set(found)) == n:
        return rows.withColumn("fine", F.lit(0).cast("long")).withColumn("bucket", upper)
    # an id at several bounds has rows for several buckets
    lower = _passed(bounds, n, lambda b: b < F.col("key"))
    rows = rows.withColumn("fine", F.xxhash64("text")).withColumn("lower", lower).withColumn("upper", upper)
    share = F.floor((F.col("fine") / float(1 << 64) + 0.5) * (F.col("upper") - F.col("lower") + 1)).cast("int")
    return rows.withColumn("bucket", F.least("upper", F.col("lower") + share)).drop("lower", "upper")


def with_next(docs: DataFrame, **also: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, text, next_text`` (null texts empty), and ``also``: columns made of a text, as ``name`` and ``next_name``.

    The next document is the one after it by ascending doc_id; after the last comes the first.
    """
    spark = docs.sparkSession
    rows = slim(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = bucketed(rows)
    firsts = sorted(rows.groupBy("bucket").agg(F.min(F.struct("key", "fine")).alias("first")).select("bucket", "first.*").collect())  # at most BUCKETS rows
    before = [r[0] for r in firsts[-1:] + firsts[:-1]]
    guests = [(b, r[1], r[2]) for b, r in zip(before, firsts, strict=True)]
    guests = spark.createDataFrame(guests, "to int, of_key long, of_fine long").groupBy("of_key", "of_fine").agg(F.collect_set("to").alias("to"))
    met = rows.join(F.broadcast(guests), (F.col("key") == F.col("of_key")) & (F.col("fine") == F.col("of_fine")), "left")
    own = F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")))
    more = F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda t: F.struct(t.alias("bucket"), F.lit(True).alias("guest")))
    dealt = met.select("doc_id", "key", "text", F.explode(F.concat(own, more)).alias("in")).select("doc_id", "key", "text", "in.*").repartition("bucket")
    made = dealt.select("*", F.xxhash64("text").alias("fine"), *[f(F.col("text")).alias(k) for k, f in also.items()])
    order = Window.partitionBy("bucket").orderBy("guest", "key", "fine", "text")
    out = made.withColumn("next", F.lead(F.struct("text", *also)).over(order)).where(~F.col("guest"))
    return out.select("doc_id", "text", *also, *[F.col(f"next.{k}").alias(f"next_{k}") for k in ("text", *also)])


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = with_next(docs, sketch=sketch)
    n = F.length("text")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        told(F.col("sketch")).alias("fingerprint"),
        told(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_share"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )
