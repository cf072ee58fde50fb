"""Density clustering: mutual reachability cut at one level.

The level is an argument (or a quantile of the core distances), and everything is joins: exact nearest neighbours between blocks
of rows and cells, core distances, edges within reach, connected components, and noise for components below the least size. The
hierarchy of all levels is in ``tree``.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.session import cut

#: Cells at most; beyond that cells have more rows, and nothing is lost.
CELLS = 4096
#: Rows of a block of asking rows at most (a task holds one), at least, and rows that are compared with each other at once.
BLOCK, LEAST, TILE = 1 << 15, 1024, 1024


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + TILE)) for i in range(0, n, TILE))


@dataclasses.dataclass(frozen=True)
class Cells:
    """Pivots, and of each cell the rows and the largest distance from its pivot."""

    pivots: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray

    def floor(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """What the distance from rows (``d`` from each pivot, in cells ``home``) to any row of each cell is at least."""
        apart = _gaps(self.pivots[home], self.pivots)
        own = d[np.arange(len(d)), home][:, None]
        plane = np.divide(d * d - own * own, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        return np.maximum(d - self.radius, plane)

    def order(self) -> np.ndarray:
        """The cells so that near ones stand together: by the nearest of a few pivots, then by the distance from it."""
        d = _gaps(self.pivots, self.pivots[: math.isqrt(len(self.pivots)) or 1])
        return np.lexsort((d.min(1), d.argmin(1)))


def placed(vectors: DataFrame, cell: int) -> tuple[DataFrame, Cells | None]:
    """``id, vec, home, away`` of ``vectors(id, vec)``: the nearest pivot and the distance from it."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["id"]
    n = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(min(CELLS, max(1, -(-n // cell)))).select("vec").collect()
    if not chosen:
        return vectors, None
    pivots = spark.sparkContext.broadcast(np.array([r[0] for r in chosen], float))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in _slices(len(pdf)):
                some = pdf.iloc[at]
                d = _gaps(np.stack(some["vec"].to_numpy()).astype(float), pivots.value)
                yield some.assign(home=d.argmin(1).astype("int32"), away=d.min(1))

    rows = cut(vectors.select("id", "vec").mapInPandas(place, f"id {kind}, vec array<double>, home int, away double"), "placed")
    found = rows.groupBy("home").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas()  # at most CELLS rows
    sizes, radius = np.zeros(len(chosen), int), np.zeros(len(chosen))
    sizes[found["home"]], radius[found["home"]] = found["n"], found["radius"]
    return rows, Cells(pivots.value, sizes, radius)


def against(asking: DataFrame, there: DataFrame, cells: Cells, near: Callable, start: Callable, ddl: str) -> DataFrame:
    """What ``start`` makes of blocks of ``asking(id, vec, home, ...)`` and the rows ``there(id, vec, home, ...)`` of all cells near them.

    Asking rows are dealt into blocks of at most about ``BLOCK``, near cells together; a block is compared with the cells that
    ``near(rows, distances from the pivots, cells)`` marks for one of its rows. So a row of ``there`` is sent once a block, not
    once a row that asks. A task holds one block and takes the others as they come, by id, a tile at a time, whatever their number:
    ``start(columns)`` of a block gives a function of a slice of the block and other rows, and one that gives the result.
    """
    spark = asking.sparkSession
    counts = np.zeros(len(cells.sizes), int)
    for r in asking.groupBy("home").agg(F.count("*").alias("n")).collect():  # at most CELLS rows
        counts[r["home"]] = r["n"]
    n, order = int(counts.sum()), cells.order()
    if not n:
        return spark.createDataFrame([], ddl)
    blocks = max(-(-n // BLOCK), min(3 * spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    size = -(-n // blocks)
    before = np.zeros(len(counts), int)
    before[order] = np.cumsum(counts[order]) - counts[order]
    first = spark.createDataFrame([(int(h), int(before[h]), int(counts[h])) for h in np.flatnonzero(counts)], "home int, first bigint, many bigint")
    block = F.floor((F.col("first") + F.pmod(F.xxhash64("id"), "many")) / size).cast("int")
    left = asking.join(F.broadcast(first), "home").withColumn("block", block).drop("first", "many")
    shared = spark.sparkContext.broadcast(cells)

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that each block must be compared with, of all its rows here."""
        met: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in _slices(len(pdf)):
                some = pdf.iloc[at]
                d = _gaps(np.stack(some["vec"].to_numpy()).astype(float), shared.value.pivots)
                marked, of = near(some, d, shared.value), some["block"].to_numpy()
                for b in np.unique(of):
                    met[int(b)] = met.get(int(b), False) | marked[of == b].any(0)
        for b, cell in met.items():
            to = np.flatnonzero(cell).astype("int32")
            yield pd.DataFrame({"block": np.full(len(to), b, "int32"), "home": to})

    pairs = cut(left.mapInPandas(aim, "block int, home int").distinct(), "pairs")
    both = left.withColumn("side", F.lit(0)).unionByName(there.join(pairs, "home").withColumn("side", F.lit(1)), allowMissingColumns=True)
    both = both.drop("home").repartitionById(blocks, "block").sortWithinPartitions("block", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, work = [], None, None
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            c = {name: (x.flatten().to_numpy().reshape(len(x), -1) if name == "vec" else x.to_numpy(zero_copy_only=False)) for name, x in c.items()}
            key = c.pop("block").astype("int64") * 2 + c.pop("side")
            ends = [*(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if hi == lo:
                    continue
                some = {name: x[lo:hi] for name, x in c.items()}
                if key[lo] // 2 != now:
                    if work:
                        yield from work[1]()
                    held, now, work = [], key[lo] // 2, None
                if key[lo] % 2 == 0:
                    held.append(some)
                    continue
                if work is None:
                    held = [{name: np.concatenate([h[name] for h in held]) for name in held[0]}]
                    work = start(held[0])
                for y in _slices(hi - lo):
                    others = {name: x[y] for name, x in some.items()}
                    for x in _slices(len(held[0]["id"])):
                        work[0](x, others)
        if work:
            yield from work[1]()

    return both.mapInArrow(run, ddl)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d -= (2 * x) @ y.T
    return np.maximum(d, 0, out=d)


def neighbours(vectors: DataFrame, k: int, cell: int = 1024) -> DataFrame:
    """``a, b, dist``: the exact k nearest others of each row of ``vectors(id, vec)``, by distance, then id.

    Rows belong to the cell of their nearest pivot (about ``cell`` rows a pivot, drawn by hash of the id). A row's k nearest lie
    within a distance that the cells' sizes and radii bound, and blocks of rows are compared with those cells only that reach so
    near (see :func:`against`). Where distances hardly differ nothing can be left out, and all rows meet: exact, but with the
    square of the rows. Collapse equal vectors first.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["id"]
    ddl = f"a {kind}, b {kind}, dist double"
    rows, cells = placed(vectors, cell)
    if cells is None:
        return spark.createDataFrame([], ddl)
    rows = rows.select("id", "vec", "home")

    def near(some: pd.DataFrame, d: np.ndarray, cells: Cells) -> np.ndarray:
        far = d + cells.radius
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(cells.sizes[order], axis=1) > k).argmax(1)  # the row itself is one of them
        bound = far[np.arange(len(d)), order[np.arange(len(d)), enough]] if cells.sizes.sum() > k else np.full(len(d), math.inf)
        return (cells.floor(d, some["home"].to_numpy()) <= bound[:, None] + 1e-6) & (cells.sizes > 0)

    def start(block: dict[str, np.ndarray]):
        n, ids = len(block["id"]), block["id"]
        best, names = np.full((n, k), np.inf), np.empty((n, k), ids.dtype)

        def tile(at: slice, others: dict[str, np.ndarray]) -> None:
            d = squares(block["vec"][at], others["vec"])
            _, x, y = np.intersect1d(ids[at], others["id"], return_indices=True)
            d[x, y] = np.inf
            last = best[at, -1]
            # others come by id, so what is as far as the last found comes behind it
            some = d < last[:, None]
            if d.shape[1] > k and np.isinf(last).any():
                some &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            x, y = np.nonzero(some)
            if not len(x):
                return
            rows, row = np.unique(x, return_inverse=True)
            rows += at.start
            row = np.concatenate([np.repeat(np.arange(len(rows)), k), row])
            far = np.concatenate([best[rows].ravel(), d[some]])
            name = np.concatenate([names[rows].ravel(), others["id"][y]])
            by = np.lexsort((far, row))  # stable: equal ones stay in the order of their ids
            first = np.searchsorted(row[by], np.arange(len(rows)))
            by = by[first[:, None] + np.arange(k)]
            best[rows], names[rows] = far[by], name[by]

        def result() -> Iterator[pa.RecordBatch]:
            for at in _slices(n):
                x, y = np.nonzero(np.isfinite(best[at]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at][x]), pa.array(names[at][x, y]), pa.array(np.sqrt(best[at][x, y]))], ["a", "b", "dist"])

        return tile, result

    return against(rows, rows, cells, near, start, ddl)


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of ``edges(a, b)``: label propagation with pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("low"))
        step = state.join(near, state["id"] == near["a"]).select("id", "component", F.least("component", "low").alias("new"))
        up = state.select(F.col("id").alias("new"), F.col("component").alias("top"))
        moved = cut(step.join(up, "new").select("id", "component", F.least("new", "top").alias("next")), "labels")
        state = moved.select("id", F.col("next").alias("component"))
        if moved.where("component <> next").isEmpty():
            return state


def cores(vectors: DataFrame, k: int, more: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``vec, id, w`` (equal vectors as one row with a weight), the ``k + more`` nearest ``a, b, dist`` of each, and ``id, core, w``.

    ``core`` is the distance within which ``k`` others lie, copies counted; rows that have not so many have none.
    """
    same = cut(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("w")), "same")
    near = cut(neighbours(same.select("id", "vec"), k + more), "near")
    others = near.join(same.select(F.col("id").alias("b"), "w"), "b").select(F.col("a").alias("id"), "dist", "w")
    seen = same.select("id", F.lit(0.0).alias("dist"), (F.col("w") - 1).alias("w")).unionByName(others)
    within = F.sum("w").over(Window.partitionBy("id").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0))  # at most k + more + 1 rows
    core = seen.withColumn("within", within).where(F.col("within") >= k).groupBy("id").agg(F.min("dist").alias("core"))
    return same, near, cut(core.join(same.select("id", "w"), "id"), "core")


def density(vectors: DataFrame, min_cluster_size: int, min_samples: int | None = None, reach: float | None = None, quantile: float = 0.5) -> DataFrame:
    """``id, label``: clusters of at least ``min_cluster_size`` rows, numbered by size, then id; noise is -1.

    ``reach``: the level of mutual reachability; by default that quantile of the core distances (distance to the
    ``min_samples``-th row, the row itself counted). Edges are those of the graph of nearest neighbours. Equal vectors are
    one row with a weight until the labels are given back.
    """
    k = max(1, (min_samples or min_cluster_size) - 1)
    vectors = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    same, near, core = cores(vectors, k)
    if reach is None:
        # a weight counts as so many rows, made in two steps so that no list is long
        some = core.select("core", "w", F.explode(F.sequence(F.lit(0), F.col("w") - 1, F.lit(4096))).alias("from"))
        each = some.select("core", F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.col("w") - F.col("from")))))
        reach = each.agg(F.percentile_approx("core", F.lit(quantile), F.lit(100000))).first()[0]
    if reach is None:
        return vectors.select("id", F.lit(-1).alias("label"))
    dense = cut(core.where(F.col("core") <= reach).select("id", "w"), "dense")
    ids = dense.select("id")
    edges = near.where(F.col("dist") <= reach).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    comp = dense.join(components(edges), "id", "left").select("id", "w", F.coalesce("component", "id").alias("component"))
    sizes = comp.groupBy("component").agg(F.sum("w").alias("n")).where(F.col("n") >= min_cluster_size)
    # one row a cluster
    numbered = sizes.withColumn("label", F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1)
    kept = comp.join(numbered.select("component", "label"), "component").select("id", "label")
    kept = same.select("id", "vec").join(kept, "id").select("vec", "label")
    return vectors.join(kept, "vec", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
