"""SimHash near-duplicates with bit-sliced comparison.

1. Each text gets a 64-bit fingerprint over its 3-word shingles (Arrow batches, one pass, nothing else leaves the task).
2. Equal fingerprints become one node, named by their smallest doc_id.
3. Two fingerprints at most ``RADIUS`` = 3 bits apart agree on at least 2 of 5 bit bands, so each goes under 10 keys of
   25 or 26 bits; keys with one member are dropped by a count. No pair is missed, at any size.
4. Members of a key are compared in blocks of 64: the block is stored as 64 bit planes, one XOR a plane updates 64
   distances in carry-save counters (ones, twos, over), and blocks whose lanes are all over the radius are abandoned.
   A key with more than ``CHUNK`` members is dealt out as pairs of chunks, so no task holds a large key.
5. A task returns for each key only member -> smallest member of its linked set; that loses no connection and its rows
   are linear in the members. Components come from label propagation with pointer jumping over written tables.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer than three words form
one shingle; a null doc_id takes no part in naming unless all ids of a component are null; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, cut, slim

RADIUS = 3
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CHUNK = 2048
SLICE = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, width: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """Bit b is 1 if it is set in over half the shingle hashes. Very long texts are counted ``step`` shingles at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        windows = zip(*(words[lo + k : hi + k] for k in range(width)), strict=True)
        h = np.fromiter((digest(join(w), seed) for w in windows), np.uint64, hi - lo)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``, fp as a signed 64-bit number. Written once."""
    schema = arrow_of("doc_id bigint, fp bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], schema=schema)

    return cut(slim(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint"), "fingerprints")


# links ------------------------------------------------------------------------------------------------------------


def band_keys(fp: Column) -> Column:
    """The keys of all pairs of bands: hash of (pair number, bits of the two bands)."""
    cut_out = lambda at, n: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))
    keys = []
    for i, a in enumerate(BANDS):
        for j in range(i + 1, len(BANDS)):
            value = F.shiftleft(cut_out(*a), 13).bitwiseOR(cut_out(*BANDS[j]))
            keys.append(value + F.lit((i * len(BANDS) + j) << 32))
    return F.array(*keys)


def _planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64 planes): bit k of plane p is bit p of the block's k-th fingerprint."""
    bits = np.unpackbits(fps.reshape(-1, 64, 1).view(np.uint8), axis=2, bitorder="little")
    turned = np.ascontiguousarray(bits.transpose(0, 2, 1))
    return np.packbits(turned, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def _lanes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A word with bits lo..hi-1 set (0 <= lo <= hi <= 64)."""
    up = np.where(hi >= 64, ALL, (np.uint64(1) << np.minimum(hi, 63).astype(np.uint64)) - np.uint64(1))
    down = np.where(lo >= 64, ALL, (np.uint64(1) << np.minimum(lo, 63).astype(np.uint64)) - np.uint64(1))
    return up & ~down


def close_pairs(fps: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (r, s) with r < s < end[r] and at most ``radius`` (3) differing bits, by bit-sliced comparison, some at a time.

    ``end``: for each row the end of its key's run; rows of a key are adjacent.
    """
    if radius != 3:
        raise ValueError("the carry-save counters hold distances up to 3")
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    planes = _planes(padded)
    first = (np.arange(n) + 1) // 64
    count = np.maximum(0, (end + 63) // 64 - first)
    total = np.cumsum(count)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + SLICE, side="right")))
        c = count[row:stop]
        r = np.repeat(np.arange(row, stop), c)
        blk = first[r] + np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
        row = stop
        lanes = _lanes(np.clip(r + 1 - blk * 64, 0, 64), np.clip(end[r] - blk * 64, 0, 64))
        on = lanes != 0
        r, blk, lanes = r[on], blk[on], lanes[on]
        q = fps[r]
        ones, twos, over = (np.zeros(len(r), np.uint64) for _ in range(3))
        for p in range(64):
            diff = planes[blk, p] ^ (np.uint64(0) - ((q >> np.uint64(p)) & np.uint64(1)))
            carry = ones & diff
            ones ^= diff
            over |= twos & carry
            twos ^= carry
            if p % 8 == 7:
                live = (lanes & ~over) != 0
                if not live.all():
                    r, blk, lanes, q, ones, twos, over = (x[live] for x in (r, blk, lanes, q, ones, twos, over))
                if not len(r):
                    break
        if len(r):
            hit = np.unpackbits((lanes & ~over).view(np.uint8), bitorder="little").reshape(-1, 64)
            at, lane = np.nonzero(hit)
            yield r[at], blk[at] * 64 + lane


def smallest_linked(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it with. Pairs come in parts and none is kept."""
    label = np.arange(n)
    for r, s in parts:
        while len(r):
            r, s = label[r], label[s]
            apart = r != s
            r, s = r[apart], s[apart]
            low = np.minimum(r, s)
            np.minimum.at(label, r, low)
            np.minimum.at(label, s, low)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
    return label


def _link_run(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if keys[0] > np.iinfo(np.int64).min else 1))
    end = np.repeat(np.append(new[1:], len(keys)), np.diff(np.append(new, len(keys))))
    label = smallest_linked(len(keys), close_pairs(fps, end))
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return ids[moved], ids[label[moved]]


def links(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` node pairs that connect exactly the nodes (node, fp) linked at 3 bits or fewer, some of the pairs only."""
    keyed = nodes.select("node", "fp", F.explode(band_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = met.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp", "node"
    )
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "fp")
    schema = arrow_of("a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))
            held = tuple(x[last:] for x in now)
            if last:
                a, c = _link_run(now[0][:last], now[1][:last].view(np.uint64), now[2][:last])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], schema=schema)
        if held is not None and len(held[0]):
            a, c = _link_run(held[0], np.ascontiguousarray(held[1]).view(np.uint64), held[2])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], schema=schema)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node with an edge; label is the smallest node reachable.

    Label propagation with pointer jumping; each round reads a written table, so rounds survive lost executors. A node
    with very many edges is a skewed join key, which Spark's adaptive skew join splits; the minimum combines map-side.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    state = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = state.join(near, state["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("new"))
        up = state.select(F.col("node").alias("new"), F.col("label").alias("top"))
        moved = step.join(up, "new").select("node", "label", F.least("new", "top").alias("next"))
        moved = cut(moved, "labels")
        state = moved.select("node", F.col("next").alias("label"))
        if moved.where("label <> next").isEmpty():
            return state


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row."""
    fps = fingerprints(docs, width)
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("any")), "nodes")
    nodes = nodes.select("fp", F.col("first"), F.coalesce("first", "any").alias("node"))
    label = components(links(nodes.select("node", "fp")))
    named = nodes.join(label, "node", "left").select("fp", F.coalesce("label", "first").alias("component_id"))
    named = named.select("fp", F.when(F.col("component_id") > -(1 << 63), F.col("component_id")).alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# similar documents ------------------------------------------------------------------------------------------------

WIDE, KEYS, LEAST = 8, 8, 0.8
#: Sets of at most ``SHORT`` shingles are compared by parities; a chunk of a group holds about ``WEIGHT`` shingles at most.
SHORT, WEIGHT = 80, 1 << 19
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``width`` lower-cased words, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64) if words else np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = len(words) - width + 1
    return np.unique(np.fromiter((digest(join(w), 42) for w in zip(*(words[k : k + n] for k in range(width)), strict=True)), np.uint64, n))


def wide_fingerprint(hashes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """``WIDE`` words of 64 majority bits, each over its own mix of the shingle hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for lo in range(0, len(hashes), step):
        part = hashes[lo : lo + step, None] * SPREAD
        part ^= part >> np.uint64(31)
        part *= SPREAD[::-1]
        part ^= part >> np.uint64(29)
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def within(fps: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Like :func:`close_pairs` for fingerprints of several words (rows of ``fps``) and any radius.

    The distances of a block's 64 lanes are a vertical binary counter; a plane is added by rippling its carry, and the
    counter is compared with the radius bit by bit, every 32 planes, to abandon blocks without a lane left.
    """
    n, wide = fps.shape
    padded = np.zeros((-(-n // 64) * 64, wide), np.uint64)
    padded[:n] = fps
    planes = np.concatenate([_planes(np.ascontiguousarray(padded[:, k])) for k in range(wide)], axis=1)
    first = (np.arange(n) + 1) // 64
    count = np.maximum(0, (end + 63) // 64 - first)
    total = np.cumsum(count)
    depth = (64 * wide).bit_length()
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + SLICE, side="right")))
        c = count[row:stop]
        r = np.repeat(np.arange(row, stop), c)
        blk = first[r] + np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
        row = stop
        lanes = _lanes(np.clip(r + 1 - blk * 64, 0, 64), np.clip(end[r] - blk * 64, 0, 64))
        on = lanes != 0
        r, blk, lanes = r[on], blk[on], lanes[on]
        bits = [np.zeros(len(r), np.uint64) for _ in range(depth)]
        for p in range(64 * wide):
            carry = planes[blk, p] ^ (np.uint64(0) - ((fps[r, p // 64] >> np.uint64(p % 64)) & np.uint64(1)))
            for k in range(min(depth, (p + 1).bit_length())):
                bits[k], carry = bits[k] ^ carry, bits[k] & carry
            if p % 32 == 31:
                over = np.zeros(len(r), np.uint64)
                same = np.full(len(r), ALL)
                for k in reversed(range(depth)):
                    if radius >> k & 1:
                        same &= bits[k]
                    else:
                        over |= same & bits[k]
                        same &= ~bits[k]
                lanes &= ~over
                live = lanes != 0
                if not live.all():
                    r, blk, lanes = r[live], blk[live], lanes[live]
                    bits = [x[live] for x in bits]
                if not len(r):
                    break
        if len(r):
            at, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8), bitorder="little").reshape(-1, 64))
            yield r[at], blk[at] * 64 + lane


def loose_bits(least: float) -> int:
    """The differing bits that next to no pair at a Jaccard similarity of ``least`` exceeds: five deviations over the mean."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(64 * WIDE * p + 5 * (64 * WIDE * p * (1 - p)) ** 0.5)


def odd_bits(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` words of parities: each shingle turns over one bit, so two sets differ in at most as many bits as shingles."""
    count = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=64 * WIDE)
    return np.packbits(count & 1, bitorder="little").view(np.uint64)


def near_sizes(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: np.ndarray, odd: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs whose numbers of shingles, and of differing parities if given, allow a similarity of ``least``."""
    for r, s in pairs:
        for lo in range(0, len(r), 1 << 17):
            a, b = r[lo : lo + (1 << 17)], s[lo : lo + (1 << 17)]
            on = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
            if odd is not None:
                on &= np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1) <= (n[a] + n[b]) * (1 - least) / (1 + least) + 1e-9
            yield a[on], b[on]


def linked_sets(values: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """For each set (``size`` of the ``values`` each) the first set that similarities of ``least`` or more connect it with."""
    kinds, codes = np.unique(values, return_inverse=True)
    start = np.append(0, np.cumsum(size))
    label, mark = np.arange(len(size)), np.zeros(len(kinds), np.int32)
    rest, open_ = np.arange(len(size)), codes
    while len(rest) > 1:
        seed = rest[0]
        queue, rest, open_ = [seed], rest[1:], open_[size[seed] :]
        while queue and len(rest):
            r = queue.pop()
            own = codes[start[r] : start[r + 1]]
            mark[own] = 1
            n = size[rest]
            shared = np.add.reduceat(mark[open_], np.cumsum(n) - n)
            mark[own] = 0
            hit = shared / (n + size[r] - shared) >= least
            if hit.any():
                label[rest[hit]] = seed
                queue.extend(rest[hit])
                rest, open_ = rest[~hit], open_[np.repeat(~hit, n)]
    return label


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns (lists as their lengths and values) in runs of whole cells; rows of a cell (column 0) are adjacent."""

    def apart(b: pa.RecordBatch) -> list[np.ndarray]:
        lists = b.column(b.num_columns - 1)
        return [b.column(k).to_numpy() for k in range(b.num_columns - 1)] + [lists.value_lengths().to_numpy(), lists.flatten().to_numpy()]

    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = apart(b)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1], side="left"))
        value = int(now[-2][:last].sum())
        held = [x[last:] for x in now[:-1]] + [now[-1][value:]]
        if last:
            yield [x[:last] for x in now[:-1]] + [now[-1][:value]]
    if held is not None and len(held[0]):
        yield held


def deal(members: DataFrame, by: str, *columns: str) -> DataFrame:
    """``(cell, columns)``: each pair of the rows with one ``by`` meets in a cell of at most two of its ``chunks``."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    dealt = dealt.select(F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *columns)
    return dealt.repartition("cell").sortWithinPartitions("cell", "node")


def similar_groups(docs: DataFrame, width: int = 5, least: float = LEAST) -> DataFrame:
    """``doc_id, component_id`` of every row: documents linked, directly or by others, at a similarity of ``least``.

    The similarity is the exact Jaccard similarity of the sets of ``width``-word shingles. Documents are compared where they
    share one of their ``KEYS`` smallest shingle hashes, which all but about (1 - least)^KEYS of such pairs do, first by
    bits: 512-bit fingerprints with a radius that next to no such pair exceeds, or for few shingles 512 parities, which
    exclude none. What that connects is read again and compared by its sets. Equal sets are one node; keys and groups with
    many members are dealt out as pairs of chunks; a task returns one link a member.
    """
    ddl = "doc_id bigint, same bigint, n bigint, keys array<bigint>, odd array<bigint>, wide array<bigint>"
    schema = arrow_of(ddl)
    array = pa.list_(pa.int64())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, n, keys, odd, wide = [], [], [], [], []
            for t in b.column(1):
                h = shingle_set(t.as_py(), width)
                same.append(xxhash.xxh64_intdigest(h.tobytes()) >> 1)
                n.append(len(h))
                keys.append(h[:KEYS].view(np.int64))
                odd.append(odd_bits(h).view(np.int64) if len(h) <= SHORT else None)
                wide.append(wide_fingerprint(h).view(np.int64) if len(h) > least * SHORT else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(same, pa.int64()), pa.array(n, pa.int64()), *[pa.array(x, array) for x in (keys, odd, wide)]],
                names=schema.names,
            )

    rows = cut(slim(docs, "doc_id", "text").mapInArrow(sketch, ddl), "sketches")
    low = F.lit(-(1 << 63))
    nodes = rows.groupBy("same", "n").agg(F.coalesce(F.min("doc_id"), low).alias("node"), *[F.first(c).alias(c) for c in ("keys", "odd", "wide")])
    nodes = cut(nodes, "similar-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.join(sizes, "key").join(nodes.select("node", "n", "odd", "wide"), "node").withColumn("chunks", F.ceil(F.col("m") / CHUNK))
    kinds = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(c).alias("fp"))) for k, c in enumerate(("odd", "wide"))]
    met = met.withColumn("as", F.explode(F.array_compact(F.array(*kinds))))
    met = met.select(F.xxhash64("key", "as.kind").alias("place"), "chunks", "node", "n", F.col("as.kind").alias("kind"), F.col("as.fp").alias("fp"))
    radius = (int(2 * SHORT * (1 - least) / (1 + least) + 1e-9), loose_bits(least))
    edges = "a bigint, b bigint"
    edge_schema = arrow_of(edges)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, ids, n, kind, _, fps in _runs(batches):
            fps = fps.reshape(-1, WIDE).view(np.uint64)
            for k in (0, 1):
                on = kind == k
                if not on.any():
                    continue
                c, i, m, f = cells[on], ids[on], n[on], np.ascontiguousarray(fps[on])
                new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                end = np.repeat(np.append(new[1:], len(c)), np.diff(np.append(new, len(c))))
                label = smallest_linked(len(c), near_sizes(within(f, end, radius[k]), m, None if k else f, least))
                moved = np.flatnonzero(label != np.arange(len(c)))
                yield pa.RecordBatch.from_arrays([pa.array(i[moved]), pa.array(i[label[moved]])], schema=edge_schema)

    loose = components(deal(met, "place", "node", "n", "kind", "fp").mapInArrow(compare, edges).distinct())
    likely = nodes.select("same", "n", "node").join(loose, "node")
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / WEIGHT))
    likely = cut(likely.join(likely.groupBy("label").agg(chunks.alias("chunks")), "label"), "likely")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column(0)]
            same = [xxhash.xxh64_intdigest(h.tobytes()) >> 1 for h in found]
            columns = [pa.array(same, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([h.view(np.int64) for h in found], array)]
            yield pa.RecordBatch.from_arrays(columns, names=["same", "n", "hashes"])

    ids = likely.select(F.when(F.col("node") > low, F.col("node")).alias("__id")).distinct()
    texts = slim(docs, "doc_id", "text").join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi").select("text")
    whole = texts.mapInArrow(sets, "same bigint, n bigint, hashes array<bigint>").join(likely, ["same", "n"]).dropDuplicates(["same", "n"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, ids, size, values in _runs(batches):
            at = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
            start = np.append(0, np.cumsum(size))
            label = np.concatenate([lo + linked_sets(values[start[lo] : start[hi]], size[lo:hi], least) for lo, hi in zip(at[:-1], at[1:], strict=True)])
            moved = np.flatnonzero(label != np.arange(len(cells)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], schema=edge_schema)

    label = components(deal(whole, "label", "node", "hashes").mapInArrow(verify, edges).distinct())
    named = nodes.select("same", "n", "node").join(label, "node", "left").select("same", "n", F.coalesce("label", "node").alias("component_id"))
    out = rows.select("doc_id", "same", "n").join(named, ["same", "n"])
    return out.select("doc_id", F.when(F.col("component_id") > low, F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, least: float = LEAST) -> DataFrame:
    """The documents with one of every group of similar ones: that with the smallest doc_id; all columns stay.

    Documents go by their id. One that stands for a group is never dropped, even if another row with that id belongs to
    a different group; rows with a null id stay.
    """
    groups = cut(similar_groups(docs, width, least), "similar")
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id"))
    lost = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    lost = cut(lost.join(kept, "__id", "left_anti"), "near-dropped")
    return docs.join(lost, docs["doc_id"] == lost["__id"], "left_anti")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
