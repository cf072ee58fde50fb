"""Packing documents into sequences of at most ``WINDOW`` tokens by non-negative least squares.

1. Documents are tokenised once (Arrow batches); a row keeps the CRC of each full window and the ids of the tail, the
   under ``WINDOW`` ids behind the last full window. Full windows are sequences of their own.
2. Tails form a histogram over ``WINDOW`` - 1 lengths (at most that many numbers go to the driver). Combinations of two
   or three lengths that fill a window exactly are enumerated, and non-negative least squares finds how often to repeat
   each so that the histogram is used up; counts are rounded down to what is there.
3. Tails are numbered within their length, and number r of length L takes the r-th slot for L of the rounded plan.
4. What the plan leaves is packed greedily end to end and cut where a window is full; the last, short window is cut at
   powers of two, which need no padding. So there is no padding at all.

One length may hold a third of all rows (copies): numbers and offsets are sums within (length, chunk) plus sums over
chunk totals. Defined results: null text is empty, one id (the end id 0); every document has at least that id; texts of any
length are packed whole; repeated rows are packed each; an empty table gives no pieces; extra columns are ignored; special
strings in texts follow the library's default.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, cut, salt, slim
from notegraph.llm.tokens import encoder, tokenizer_path

WINDOW, END = 1024, 0
#: Triples considered, those with the most mass first; all pairs are. Tails that no considered combination takes are packed end
#: to end like all residuals, so nothing is lost by the bound.
TRIPLES = 20_000


# tokens -----------------------------------------------------------------------------------------------------------


def tokenised(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """``row_id, doc_id, n, crcs, tail``: written once. Ids are little-endian unsigned 32-bit numbers."""
    path = path or tokenizer_path()
    ddl = "row_id bigint, doc_id bigint, n bigint, crcs array<bigint>, tail binary"
    schema = arrow_of(ddl)
    wide = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, crc = encoder(path).encode_to_numpy, zlib.crc32
        end = np.array([END], "<u4")
        for b in batches:
            n, crcs, tails = [], [], []
            for t in b.column(2):
                ids = memoryview(np.concatenate([encode(t.as_py() or "", allowed_special="all"), end]).astype("<u4").tobytes())
                n.append(len(ids) // 4)
                full = len(ids) // wide * wide
                crcs.append([crc(ids[k : k + wide]) for k in range(0, full, wide)])
                tails.append(bytes(ids[full:]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                names=schema.names,
            )

    rows = slim(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return cut(rows.mapInArrow(run, ddl), "tokens")


# plan -------------------------------------------------------------------------------------------------------------


def combinations(hist: np.ndarray, triples: int = TRIPLES) -> np.ndarray:
    """Length combinations that fill a window exactly, as rows (a, b, c), a <= b <= c, a = 0 for pairs.

    ``hist[l]``: tails of length l, l < window. All pairs of lengths that occur, and the ``triples`` triples whose
    scarcest length is most frequent.
    """
    w = len(hist)
    have = hist > 0
    a = np.arange(1, w // 2 + 1)
    a = a[have[a] & have[w - a]]
    pairs = np.stack([np.zeros_like(a), a, w - a], 1)
    x, y = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    x, y = x.ravel(), y.ravel()
    z = w - x - y
    ok = (x >= 1) & (x <= y) & (z >= y)
    x, y, z = x[ok], y[ok], z[ok]
    ok = have[z]
    x, y, z = x[ok], y[ok], z[ok]
    mass = np.minimum(np.minimum(hist[x], hist[y]), hist[z])
    top = np.argsort(-mass, kind="stable")[:triples]
    return np.concatenate([pairs, np.stack([x[top], y[top], z[top]], 1)])


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, A x being the lengths used; accelerated projected gradient."""
    w = len(hist)
    if not len(combos):
        return np.zeros(0)
    target = hist.astype(float)
    target[0] = 0.0
    real = (combos > 0).astype(float)

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, k], weights=x * real[:, k], minlength=w) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[combos[:, k]] * real[:, k] for k in range(3))

    # the largest eigenvalue of A'A, by power iteration
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - back(used(z) - target) / (1.05 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(hist: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, lo, hi, first sequence, offset)``: tails lo..hi-1 of a length go to consecutive sequences."""
    combos = combinations(hist)
    repeat = nnls(combos, hist)
    left = hist.astype(np.int64).copy()
    taken = np.zeros(len(hist), np.int64)
    slots, first = [], 0
    for k in np.argsort(-repeat, kind="stable"):
        lengths = [int(v) for v in combos[k] if v]
        most = min(left[v] // lengths.count(v) for v in lengths)
        n = int(min(round(repeat[k]), most))
        if n < 1:
            continue
        offset = 0
        for v in reversed(lengths):
            slots.append((v, int(taken[v]), int(taken[v]) + n, first, offset))
            taken[v] += n
            left[v] -= n
            offset += v
        first += n
    return slots


# placement --------------------------------------------------------------------------------------------------------


def _running(rows: DataFrame, keys: list[str], value, name: str) -> DataFrame:
    """``rows`` (with ``chunk``, ``row_id``) plus the sum of ``value`` over earlier rows with the same keys."""
    near = Window.partitionBy(*keys, "chunk").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "chunk").agg(F.sum(value).alias("__sum"))
    past = Window.partitionBy(*keys) if keys else Window.partitionBy()
    past = past.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "chunk", F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__base"))
    rows = rows.withColumn("__near", F.coalesce(F.sum(value).over(near), F.lit(0)))
    return rows.join(totals, [*keys, "chunk"]).withColumn(name, F.col("__base") + F.col("__near")).drop("__base", "__near")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    tokens = tokenised(docs, path, window)
    # about the root of the rows in a chunk, and as many chunks
    lens = tokens.select("row_id", "n", salt(F.col("row_id"), max(1, math.isqrt(tokens.count()))).alias("chunk"))
    lens = lens.withColumn("full", F.floor(F.col("n") / window)).withColumn("tail", F.col("n") % window)

    # full windows: numbered document after document
    wholes = _running(lens.where("full > 0"), [], F.col("full"), "sequence").select("row_id", F.col("sequence").alias("first"))
    whole = tokens.where(F.size("crcs") > 0).join(wholes, "row_id")
    whole = whole.select("doc_id", "n", "first", F.posexplode("crcs").alias("k", "crc"))
    whole = whole.select(
        "doc_id",
        (F.col("k").cast("long") * window).alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.col("first") + F.col("k")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )

    # tails in the plan
    hist = np.zeros(window, np.int64)
    base = 0
    for full_sum, tail, count in lens.groupBy("tail").agg(F.sum("full"), F.count("*")).select("sum(full)", "tail", "count(1)").collect():
        base += full_sum
        if tail:
            hist[tail] = count
    slots = plan(hist)
    numbered = _running(lens.where("tail > 0").select("row_id", "tail", "chunk"), ["tail"], F.lit(1), "rank")
    if slots:
        table = spark.createDataFrame(slots, "tail bigint, lo bigint, hi bigint, first bigint, at bigint")
        # at most 3 * (pairs + TRIPLES) rows, whatever the input
        inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")) & (numbered["tail"] == table["tail"])
        numbered = numbered.join(F.broadcast(table), inside, "left").select(
            "row_id", numbered["tail"], "chunk", (F.col("first") + F.col("rank") - F.col("lo") + base).alias("sequence_id"), F.col("at")
        )
    else:
        numbered = numbered.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("at", F.lit(None).cast("long")).drop("rank")
    settled = cut(numbered, "placed")
    base += max((first + hi - lo for _, lo, hi, first, _ in slots), default=0)

    # the rest, end to end; the last window is cut at powers of two
    rest = settled.where("sequence_id IS NULL").select("row_id", "tail", "chunk")
    total = rest.agg(F.coalesce(F.sum("tail"), F.lit(0))).first()[0]
    done, left = total // window * window, total % window
    bits = [1 << k for k in reversed(range(window.bit_length())) if left >> k & 1]
    ends = [done + sum(bits[:k]) for k in range(len(bits))]
    rest = _running(rest, [], F.col("tail"), "p").withColumn("stop", F.col("p") + F.col("tail"))
    marks = F.array((F.floor(F.col("p") / window) + 1) * window, *[F.lit(e).cast("long") for e in ends])
    marks = F.array_sort(F.array_distinct(F.filter(marks, lambda m: (m > F.col("p")) & (m < F.col("stop")))))
    rest = rest.withColumn("from", F.concat(F.array("p"), marks)).withColumn("to", F.concat(marks, F.array("stop")))
    rest = rest.select("row_id", "p", F.explode(F.arrays_zip("from", "to")).alias("x")).select("row_id", "p", "x.from", "x.to")
    low = F.floor(F.col("from") / window)
    number, begin = low, low * window
    for k, e in enumerate(ends):
        number = F.when(F.col("from") >= e, F.lit(done // window + k)).otherwise(number)
        begin = F.when(F.col("from") >= e, F.lit(e)).otherwise(begin)
    cuts = rest.select(
        "row_id",
        (F.col("from") - F.col("p")).alias("skip"),
        (F.col("to") - F.col("from")).alias("length"),
        (number + base).cast("long").alias("sequence_id"),
        (F.col("from") - begin).cast("long").alias("offset"),
    )
    wholesome = settled.where("sequence_id IS NOT NULL").select(
        "row_id", F.lit(0).cast("long").alias("skip"), F.col("tail").alias("length"), "sequence_id", F.col("at").alias("offset")
    )
    tails = tokens.where(F.octet_length("tail") > 0).select("row_id", "doc_id", "n", "tail").join(wholesome.unionByName(cuts), "row_id")
    ids = F.expr("substring(tail, cast(skip * 4 + 1 as int), cast(length * 4 as int))")
    tails = tails.select(
        "doc_id",
        (F.floor(F.col("n") / window) * window + F.col("skip")).alias("start"),
        "length",
        F.crc32(ids).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )
    return whole.unionByName(tails)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs)
