"""Centroid clustering of integer vectors by bit planes and population counts.

A vector of 64 components becomes one 64-bit word for each binary place of its components: bit c of plane p is bit p of component c,
in two's complement, so the top plane weighs minus. The product of two vectors is then
``sum(weight[i] * weight[j] * popcount(x[i] & y[j]))``, exact, and the squared distance is ``x.x + y.y - 2 x.y``.

Planes are packed once and written (1.5 bytes a component at 12 planes); each round is one pass over that table. A batch
meets the few centroids, and gives back for each of them the number and the componentwise sums of its vectors, also
taken from planes; so what is shuffled is one row a centroid and batch, whatever share of the rows a cluster holds, and what
reaches the driver is one row a centroid.

Defined results: vectors that are null, do not have exactly 64 components, or have one that is null or not finite are left out;
equal distances go to the smaller number; fewer than 8 vectors make as many centroids; of equal start hashes (repeated ids) the
smaller vector comes first; a null vec_id hashes as an empty one; empty clusters keep their centroid; no vectors give no rows. A
component of 2^27 or more after scaling is an error, as its distances do not fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import arrow_of, cut

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Binary places, sign included, up to which every squared distance fits in a long; vectors that meet the centroids at once.
MOST, STEP = 28, 1 << 13


def whole(vectors: DataFrame) -> DataFrame:
    """``vec_id, ints``: the vectors with 64 finite components as integers."""
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return v.where((F.size("x") == SIZE) & finite).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("ints"))


def weights(places: int) -> np.ndarray:
    w = np.int64(1) << np.arange(places, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def planes_of(ints: np.ndarray, places: int) -> np.ndarray:
    """(vectors, places) words: bit c of word p is bit p of component c."""
    bits = (ints[:, None, :] >> np.arange(places)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows of x, rows of y): the products of the vectors whose planes these are."""
    wx, wy = weights(x.shape[1]), weights(y.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    for p, w in enumerate(wx):
        both = np.bitwise_count(x[:, p, None, None] & y[None])
        # at most 64 * 2^28: exact as a double
        out += w * (both.astype(np.float64) @ wy.astype(np.float64)).astype(np.int64)
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """The squared lengths, from the planes alone."""
    w = weights(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for p in range(x.shape[1]):
        for q in range(p, x.shape[1]):
            out += w[p] * w[q] * (1 + (q > p)) * np.bitwise_count(x[:, p] & x[:, q]).astype(np.int64)
    return out


def sums(x: np.ndarray) -> np.ndarray:
    """The componentwise sums of the vectors whose planes these are."""
    w = weights(x.shape[1])
    return sum(w[p] * np.unpackbits(np.ascontiguousarray(x[:, p]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for p in range(x.shape[1]))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (planes) and the squared distance to it."""
    d = norms(x)[:, None] + norms(centres)[None] - 2 * products(x, centres)
    label = d.argmin(axis=1)
    return label, d[np.arange(len(x)), label]


def _steps(b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    planes = b.column(1)
    size = len(planes[0])
    words = planes.flatten().to_numpy().view(np.uint64).reshape(-1, size)
    for lo in range(0, len(words), STEP):
        yield slice(lo, lo + STEP), words[lo : lo + STEP]


def pack(ints: DataFrame, places: int) -> DataFrame:
    """``vec_id, planes`` of ``ints(vec_id, ints)``; written once."""
    ddl = "vec_id bigint, planes array<bigint>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy().reshape(-1, SIZE)
            words = planes_of(values, places).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, words.size + 1, places, dtype=np.int32), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(schema.field(1).type)], schema=schema)

    return cut(ints.mapInArrow(run, ddl), "planes")


def gather(packed: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the vectors nearest to each centroid."""
    ddl = "cluster int, n bigint, sums array<bigint>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _steps(b):
                label, _ = nearest(x, centres)
                met = np.unique(label)
                out = [(label == c).sum() for c in met], [sums(x[label == c]) for c in met]
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], schema=schema)

    parts = packed.mapInArrow(run, ddl)
    added = [F.sum(F.get("sums", F.lit(c))).alias(f"s{c}") for c in range(SIZE)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()  # one row a centroid
    return {r["cluster"]: (r["n"], [r[f"s{c}"] for c in range(SIZE)]) for r in rows}


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every kept vector, and the centroids."""
    ints = whole(vectors)
    top = ints.agg(F.max(F.array_max(F.transform("ints", lambda c: F.when(c < 0, -c - 1).otherwise(c))))).first()[0]
    if top is None:
        return ints.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    places = int(top).bit_length() + 1
    if places > MOST:
        raise ValueError(f"components need {places} binary places; distances are exact up to {MOST}")
    packed = pack(ints, places)
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = [list(r[0]) for r in ints.orderBy(start, "ints").limit(k).select("ints").collect()]
    for _ in range(rounds):
        for c, (n, total) in gather(packed, planes_of(np.array(centres), places)).items():
            centres[c] = [s // n for s in total]
    last = planes_of(np.array(centres), places)
    ddl = "vec_id bigint, cluster int, distance bigint"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _steps(b):
                label, distance = nearest(x, last)
                yield pa.RecordBatch.from_arrays([b.column(0)[at], pa.array(label.astype(np.int32)), pa.array(distance)], schema=schema)

    return cut(packed.mapInArrow(run, ddl), "clusters"), centres


def op12(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    labels, centres = cluster(vectors)
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    names = spark.createDataFrame(list(enumerate(told)), "cluster int, centroid_sha256 string")
    each = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").alias("inertia"))
    # at most CLUSTERS rows, and one
    facts = each.join(names, "cluster").join(total)
    return labels.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x FROM v QUALIFY cluster < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT v.r, min((CAST({gap} AS BIGINT), c.cluster)) AS best FROM v CROSS JOIN c{n} c GROUP BY v.r)")
        if n < rounds:
            # floor of sum / count in whole numbers
            parts.append(f"""m{n} AS (SELECT a.best[2] AS cluster, pos, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT r, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM v) u JOIN a{n} a USING (r) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(g.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS x FROM m{n} GROUP BY cluster) g USING (cluster))""")
    last = f"""SELECT v.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, a.best[1] AS distance, CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.cluster = a.best[2]"""
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle()
