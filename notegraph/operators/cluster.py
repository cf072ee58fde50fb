"""Clustering passes over a vector table ``(id, vec)`` and the views of their results.

Vectors stay in the executors; what a fit returns is a table of labels. Centroids are as many as clusters, a number the
pass fixes, and only those are compared with every row.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.ids import bridge_id, cluster_id
from notegraph.functions.vectors import dot, head
from notegraph.operators import lloyd
from notegraph.operators.tree import density_tree
from notegraph.session import cut


def truncated(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.withColumn("vec", head(F.col("vec"), dims))


def mean_vectors(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """``key, vec, n``: means of the vectors that are there, combined map-side: what is shuffled is one vector a key and task."""
    rows = rows.where(F.col(vec).isNotNull())
    summary = Summarizer.metrics("mean", "count").summary(array_to_vector(F.col(vec).cast("array<double>"))).alias("s")
    return rows.groupBy(key).agg(summary).select(key, vector_to_array("s.mean").alias("vec"), F.col("s.count").alias("n"))


def doc_pool(vectors: DataFrame, segments: DataFrame, docs: DataFrame) -> DataFrame:
    """Mean vector of each document's segments, where the document exists. ``segments(id, doc)``, ``docs(doc)``."""
    return mean_vectors(vectors.join(segments, "id").join(docs, "doc", "left_semi"), "doc").select(F.col("doc").alias("id"), "vec", "n")


def kmeans(vectors: DataFrame, k: int, dims: int | None = None, seed: int = 42) -> DataFrame:
    """``id, label``; every row gets a label. The number of clusters is held below the number of rows."""
    rows = truncated(vectors, dims) if dims else vectors
    rows = cut(rows.select("id", array_to_vector("vec").alias("features")), "features")
    n = rows.count()
    if n == 0:
        return rows.select("id", F.lit(0).alias("label"))
    model = KMeans(k=max(2, min(k, n)), maxIter=20, seed=seed).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").alias("label"))


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, vec, n`` without noise (label -1); not normalised again."""
    return mean_vectors(vectors.join(labels.where("label >= 0"), "id"), "label")


def temporal(labels: DataFrame, times: DataFrame) -> DataFrame:
    """First, last and all dates (sorted) of each label's members. ``times(id, block_time)``."""
    day = F.substring("block_time", 1, 10)
    met = labels.where("label >= 0").join(times.where("block_time IS NOT NULL"), "id")
    return met.groupBy("label").agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.sort_array(F.collect_list(day)).alias("dates"))


def bridges(noise: DataFrame, means: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Noise rows near two clusters: ``id, label, similarity, place`` for the two closest, both at ``threshold`` or more.

    The means are one row a cluster; they become one array, so each noise row meets them without a join of pairs.
    """
    table = means.agg(F.collect_list(F.struct("label", "vec")).alias("m"))
    met = noise.select("id", "vec").join(F.broadcast(table)).select("id", F.transform("m", lambda c: F.struct(dot(c["vec"], F.col("vec")).alias("similarity"), (-c["label"]).alias("back"))).alias("s"))
    two = F.slice(F.sort_array("s", asc=False), 1, 2)
    met = met.select("id", two.alias("two")).where((F.size("two") == 2) & (F.get("two", F.lit(1))["similarity"] >= threshold))
    return met.select("id", F.posexplode("two").alias("place", "x")).select("id", (-F.col("x.back")).alias("label"), F.round("x.similarity", 6).alias("similarity"), (F.col("place") + 1).alias("place"))


def cluster_within(vectors: DataFrame, parents: DataFrame, k: int, least: int = 5, seed: int = 42, dims: int | None = None) -> DataFrame:
    """``id, parent_label, label``: k-means inside each parent cluster of at least ``least`` rows, all parents in one job."""
    met = vectors.join(parents.where("label >= 0").select("id", F.col("label").alias("grp")), "id")
    labels, _ = lloyd.fit(met, [lloyd.Setting(k, dims, seed)], least)
    return labels.select("id", F.col("grp").alias("parent_label"), F.get("labels", F.lit(0)).alias("label"))


def propagate(doc_labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Document labels pushed to their segments. ``segments(id, doc)``."""
    return segments.join(doc_labels.select(F.col("id").alias("doc"), "label"), "doc").select("id", "label")


def full_label(parent: str | None = None):
    own = F.col("label").cast("string")
    return own if parent is None else F.concat_ws("_", F.col(parent).cast("string"), own)


def pass_blocks(pass_id: str, labels: DataFrame, times: DataFrame, parent: str | None = None, parent_pass: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cluster blocks ``(id, title, label, members, first_date, last_date)`` and links (members, parents) of a pass."""
    rows = labels.where("label >= 0").withColumn("full", full_label(parent))
    keep = ["full", "label"] + ([parent] if parent else [])
    held = rows.join(times, "id", "left").groupBy(*keep).agg(F.count("*").alias("members"), F.min("block_time").alias("first_date"), F.max("block_time").alias("last_date"))
    ident = cluster_id(F.lit(pass_id), F.col("full"))
    blocks = held.select(ident.alias("id"), F.concat(F.lit(f"{pass_id} cluster "), "full").alias("title"), F.col("full").alias("label"), "members", "first_date", "last_date")
    links = rows.select(ident.alias("from_id"), F.col("id").cast("string").alias("to_id"), F.lit("groups").alias("kind"))
    if parent:
        up = cluster_id(F.lit(parent_pass), F.col(parent).cast("string"))
        links = links.unionByName(held.select(up.alias("from_id"), ident.alias("to_id"), F.lit("contains").alias("kind")))
    return blocks, links


def bridge_blocks(pass_id: str, found: DataFrame) -> DataFrame:
    """One block per bridge with the ids of its clusters."""
    ids = found.withColumn("cluster", cluster_id(F.lit(pass_id), F.col("label").cast("string")))
    near = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "cluster"))), lambda x: x["cluster"]), ",")
    return ids.groupBy(F.col("id").alias("block")).agg(near.alias("near")).select(bridge_id(F.lit(pass_id), F.col("block")).alias("id"), F.col("block").alias("source_block_id"), "near")


def pass_stats(labels: DataFrame) -> DataFrame:
    """One row: rows, clusters, noise share, cluster sizes least, median, most."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    real = F.col("label") >= 0
    return sizes.agg(
        F.sum("n").alias("rows"),
        F.count_if(real).alias("clusters"),
        F.round(100 * F.sum(F.when(~real, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("noise_pct"),
        F.min(F.when(real, F.col("n"))).alias("least"),
        F.percentile(F.when(real, F.col("n")), F.lit(0.5)).alias("median"),
        F.max(F.when(real, F.col("n"))).alias("most"),
    )


def pass_health(labels: DataFrame, few: int = 6, many: int = 18, noise: float = 20.0, largest: float = 40.0, least: int = 30) -> DataFrame:
    """The rubric of a finished pass: booleans from :func:`pass_stats`."""
    s = pass_stats(labels)
    return s.select(
        F.col("clusters").between(few, many).alias("count_ok"),
        (F.col("noise_pct") < noise).alias("noise_ok"),
        (100 * F.col("most") <= largest * F.col("rows")).alias("largest_ok"),
        (F.col("least") >= least).alias("smallest_ok"),
    )


def kmeans_grid(vectors: DataFrame, dims: list[int], ks: list[int], names: DataFrame | None = None, most: int = 8) -> DataFrame:
    """``dims, k, label, n, pct[, names]`` of every setting, all fitted in one job; settings with k not below the rows are left out.

    With ``names(id, name)`` the first ``most`` names (by id) of each cluster are given too.
    """
    total = vectors.count()
    tried = [lloyd.Setting(k, d) for d in dims for k in ks if k < total]
    schema = "setting int, dims int, k int"
    facts = F.broadcast(vectors.sparkSession.createDataFrame([(n, s.dims, s.k) for n, s in enumerate(tried)], schema))  # the caller's list
    labels, _ = lloyd.fit(vectors.select("id", F.lit(0).alias("grp"), "vec"), tried)
    rows = cut(lloyd.long(labels).select("id", "setting", "label"), "grid")
    out = rows.groupBy("setting", "label").agg(F.count("*").alias("n"))
    if names is not None:
        rank = F.row_number().over(Window.partitionBy("setting", "label").orderBy("id"))
        few = rows.withColumn("r", rank).where(F.col("r") <= most).join(names, "id")
        few = few.groupBy("setting", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("names"))
        out = out.join(few, ["setting", "label"], "left")
    more = ["names"] if names is not None else []
    return out.join(facts, "setting").select("dims", "k", "label", "n", F.round(100 * F.col("n") / total, 2).alias("pct"), *more)


@dataclasses.dataclass(frozen=True)
class Pass:
    """One pass of a hierarchy, over all rows or within the labels of a parent pass.

    ``k`` clusters by k-means, or clusters of at least ``min_size`` rows by density; ``least``: rows that a parent cluster
    needs to be divided.
    """

    id: str
    dims: int
    k: int | None = None
    parent: str | None = None
    min_size: int | None = None
    min_samples: int | None = None
    least: int = 5

    def __post_init__(self) -> None:
        if (self.k is None) == (self.min_size is None):
            raise ValueError(f"pass {self.id} needs either k or min_size")


def ordered(passes: list[Pass]) -> list[Pass]:
    """Parents first; unknown parents, repeated ids and circles are errors."""
    by = {p.id: p for p in passes}
    if len(by) != len(passes):
        raise ValueError("a pass id is used twice")
    out: list[Pass] = []

    def place(p: Pass, above: tuple[str, ...]) -> None:
        if p.id in above:
            raise ValueError(f"passes in a circle: {(*above, p.id)}")
        if p in out:
            return
        if p.parent is not None:
            if p.parent not in by:
                raise ValueError(f"unknown parent pass {p.parent}")
            place(by[p.parent], (*above, p.id))
        out.append(p)

    for p in passes:
        place(p, ())
    return out


def cluster_dag(vectors: DataFrame, passes: list[Pass]) -> DataFrame:
    """``pass_id, id, label, parent_label`` of all passes; -1 at the end of a label is noise, which has no children.

    A label is full: that of its parent, an underscore, its own number; so equal numbers under different parents stay apart at
    every level. All parents of a k-means pass are divided in one job; a density pass takes one after another.
    """
    done: dict[str, DataFrame] = {}
    for p in ordered(passes):
        if p.parent is None:
            everything = vectors.select("id", F.lit(0).alias("label"))
            got = cluster_within(vectors, everything, p.k, 1, dims=p.dims) if p.k else density_tree(truncated(vectors, p.dims), p.min_size, p.min_samples)
            found = got.select("id", F.col("label").cast("string").alias("label"), F.lit(None).cast("string").alias("parent_label"))
        else:
            above = done[p.parent].where(~F.col("label").rlike(r"(^|_)-1$")).select("id", F.col("label").alias("parent_label"))
            names = above.groupBy("parent_label").agg(F.count("*").alias("n")).where(F.col("n") >= max(p.least, p.min_size or 1)).orderBy("parent_label").collect()  # clusters of the parent pass
            numbers = vectors.sparkSession.createDataFrame([(n, r["parent_label"]) for n, r in enumerate(names)], "grp int, parent_label string")
            met = vectors.join(above.join(F.broadcast(numbers), "parent_label"), "id").select("id", "grp", "vec")
            if p.k:
                child = cluster_within(met.select("id", "vec"), met.select("id", F.col("grp").alias("label")), p.k, dims=p.dims)
                child = child.select("id", F.col("parent_label").alias("grp"), "label")
            else:
                parts = [density_tree(truncated(met.where(F.col("grp") == n), p.dims), p.min_size, p.min_samples).select("id", F.lit(n).alias("grp"), "label") for n in range(len(names))]
                child = reduce(DataFrame.unionByName, parts) if parts else met.select("id", "grp", F.lit(-1).alias("label")).limit(0)
            found = child.join(F.broadcast(numbers), "grp").select("id", full_label("parent_label").alias("label"), "parent_label")
        done[p.id] = cut(found, "pass")
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("pass_id"), "id", "label", "parent_label") for name, df in done.items()])


def dag_stats(labels: DataFrame) -> DataFrame:
    """A dry run's report on :func:`cluster_dag`: ``pass_id, rows, clusters, noise_pct, least, most``; nothing is stored."""
    sizes = labels.groupBy("pass_id", "label").agg(F.count("*").alias("n")).withColumn("noise", F.col("label").rlike(r"(^|_)-1$"))
    real = lambda c: F.when(~F.col("noise"), c)
    return sizes.groupBy("pass_id").agg(
        F.sum("n").alias("rows"),
        F.count_if(~F.col("noise")).alias("clusters"),
        F.round(100 * F.coalesce(F.sum(F.when(F.col("noise"), F.col("n"))), F.lit(0)) / F.sum("n"), 4).alias("noise_pct"),
        F.min(real(F.col("n"))).alias("least"),
        F.max(real(F.col("n"))).alias("most"),
    )


def samples(labels: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """``label, n, names``: count and the first names (by id) of each label. ``names(id, name)``."""
    met = labels.join(names, "id")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    few = met.withColumn("r", rank).where(F.col("r") <= most).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ",").alias("names"))
    return labels.groupBy("label").agg(F.count("*").alias("n")).join(few, "label")


def project_2d(vectors: DataFrame) -> DataFrame:
    """``id, x, y``: two principal components, each scaled to -1..1 and rounded to four places."""
    rows = vectors.select("id", array_to_vector("vec").alias("features"))
    got = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    got = got.select("id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    edge = got.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.round(F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 2 * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 1).otherwise(0.0), 4).alias(c)
    return got.join(F.broadcast(edge)).select("id", scaled("x"), scaled("y"))


def cluster_snippets(labels: DataFrame, texts: DataFrame, per: int = 5, most: int = 180, seed: int = 1) -> DataFrame:
    """A seeded sample of ``per`` member snippets of each label. ``texts(id, content)``."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256)))
    met = labels.join(texts, "id").withColumn("n", rank).where(F.col("n") <= per)
    return met.select("label", "id", F.substring("content", 1, most).alias("snippet"), "n")


def discover_passes(rows: DataFrame) -> DataFrame:
    """Distinct passes of cluster rows (pass_id, parent_pass, dims, id): roots by dims, then children by dims."""
    one = rows.groupBy("pass_id").agg(F.min_by("parent_pass", "id").alias("parent_pass"), F.min_by("dims", "id").alias("dims"), F.count("*").alias("clusters"))
    place = F.row_number().over(Window.orderBy(F.col("parent_pass").isNotNull(), "dims", "pass_id"))
    return one.withColumn("place", place)
