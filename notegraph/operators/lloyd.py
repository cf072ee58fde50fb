"""Many k-means fits in one job: Lloyd steps keyed by (setting, group, label).

A setting is a number of dimensions, clusters and a seed; a group is a part of the rows (a parent cluster), each fitted by itself. All
settings and groups take part in each pass over the vectors: a task meets an Arrow batch once, and gives back counts and
sums per (setting, group, label), which are added in the shuffle. A grid of 24 settings so costs the passes of the
slowest one, and a parent with a third of all rows is spread over all tasks like any other rows.

Starts are k-means++ over at most ``SAMPLE`` rows of a group, those with the smallest hashes of their ids (the same rows and draws in
every run). Centroids (settings x groups x k vectors, all fixed by the caller's passes) go through the driver between passes.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from notegraph.session import cut

#: Rows of a group that starts are chosen from.
SAMPLE = 1024
Key = tuple[int, int]


@dataclasses.dataclass(frozen=True)
class Setting:
    """One fit: the first ``dims`` numbers of each vector, normalised again (None: the vector as it is), in ``k`` clusters."""

    k: int
    dims: int | None = None
    seed: int = 42


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, taken as differences: equal points are at exactly 0."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def _cut(x: np.ndarray, dims: int | None) -> np.ndarray:
    if dims is None:
        return x
    x = x[:, :dims]
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def starts(sample: np.ndarray, setting: Setting) -> np.ndarray:
    """k-means++: rows of ``sample``, each drawn in proportion to its squared distance from those before; fewer if all are covered."""
    rng = np.random.default_rng(setting.seed)
    x = _cut(sample, setting.dims)
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < setting.k and near.max() > 0:
        chosen.append(int(np.searchsorted(np.cumsum(near) / near.sum(), rng.random(), side="right").clip(0, len(x) - 1)))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].astype(float)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column(0), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)


def _members(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for g in np.unique(groups):
        yield int(g), np.flatnonzero(groups == g)


def fit(vectors: DataFrame, settings: list[Setting], least: int = 1, rounds: int = 20, tolerance: float = 1e-4) -> tuple[DataFrame, dict[Key, np.ndarray]]:
    """``id, grp, labels`` of ``vectors(id, grp, vec)``, one label a setting in the order given, and the centroids.

    Groups of fewer than ``least`` rows, and null groups, get no rows. A group of fewer different rows than clusters has as many
    clusters. Equal distances go to the smaller label; an empty cluster keeps its centroid. A fit ends where no centroid
    moves by more than ``tolerance``.
    """
    kind = dict(vectors.dtypes)["id"]
    rows = vectors.where("grp IS NOT NULL AND vec IS NOT NULL").select("id", F.col("grp").cast("int").alias("grp"), F.col("vec").cast("array<double>").alias("vec"))
    rows = cut(rows, "fit-rows")
    large = rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("grp")
    rows = rows.join(F.broadcast(large), "grp", "left_semi").select("id", "grp", "vec")  # one row a group
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("id"), "id"))
    some = rows.withColumn("r", rank).where(F.col("r") <= SAMPLE).select("grp", "r", "vec")
    start_ddl = "setting int, grp int, label int, vec array<double>"

    def begin(pdf):
        import pandas as pd

        x = np.stack(pdf.sort_values("r")["vec"].to_numpy())
        out = [(s, int(pdf["grp"].iloc[0]), j, c) for s, setting in enumerate(settings) for j, c in enumerate(starts(x, setting))]
        return pd.DataFrame(out, columns=["setting", "grp", "label", "vec"])

    centres: dict[Key, np.ndarray] = {}
    for r in some.groupBy("grp").applyInPandas(begin, start_ddl).orderBy("setting", "grp", "label").collect():
        centres.setdefault((r["setting"], r["grp"]), []).append(r["vec"])  # type: ignore[union-attr]
    centres = {k: np.array(v) for k, v in centres.items()}
    step_ddl = "setting int, grp int, label int, n bigint, sums array<double>"
    step_schema = _arrow(step_ddl)
    open_ = set(centres)
    for _ in range(rounds):
        if not open_:
            break
        shared = rows.sparkSession.sparkContext.broadcast({k: centres[k] for k in open_})

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for _, groups, x in _batches(batches):
                keys, counts, sums = [], [], []
                for g, at in _members(groups):
                    for s, setting in enumerate(settings):
                        if (s, g) in shared.value:
                            own = _cut(x[at], setting.dims)
                            label = _gaps(own, shared.value[s, g]).argmin(1)
                            for j in np.unique(label):
                                keys.append((s, g, int(j)))
                                counts.append(int((label == j).sum()))
                                sums.append(own[label == j].sum(0))
                columns = [pa.array([k[c] for k in keys], pa.int32()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], schema=step_schema)

        parts = rows.mapInArrow(gather, step_ddl).select("setting", "grp", "label", "n", F.posexplode("sums").alias("at", "x"))
        added = parts.groupBy("setting", "grp", "label", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        means = added.groupBy("setting", "grp", "label").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))).alias("c"))
        moved = {k: 0.0 for k in open_}
        for r in means.select("setting", "grp", "label", "c.x").collect():
            key = r["setting"], r["grp"]
            new = np.array(r["x"])
            moved[key] = max(moved[key], float(np.linalg.norm(new - centres[key][r["label"]])))
            centres[key][r["label"]] = new
        open_ = {k for k in open_ if moved[k] > tolerance}
        shared.unpersist()
    ends = rows.sparkSession.sparkContext.broadcast(centres)
    out_ddl = f"id {kind}, grp int, labels array<int>"
    out_schema = _arrow(out_ddl)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, groups, x in _batches(batches):
            for g, at in _members(groups):
                labels = np.stack([_gaps(_cut(x[at], s.dims), ends.value[k, g]).argmin(1) for k, s in enumerate(settings)], axis=1)
                lists = pa.array(list(labels.astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.full(len(at), g, np.int32)), lists], schema=out_schema)

    return rows.mapInArrow(assign, out_ddl), centres


def long(labels: DataFrame) -> DataFrame:
    """``id, grp, setting, label``: one row for each setting."""
    return labels.select("id", "grp", F.posexplode("labels").alias("setting", "label"))
