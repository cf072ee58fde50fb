"""Embedding quality and ideas over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.vectors import dot, unit
from notegraph.operators import lloyd
from notegraph.operators.cluster import mean_vectors, truncated
from notegraph.session import cut


def seeded_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hash of (id, seed): a sampling operator, the same on every run."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256)).limit(n)


def folds(rows: DataFrame, n: int = 3) -> DataFrame:
    """Stratified folds: rows of a label are dealt in the order of their hash."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    return rows.withColumn("fold", F.pmod(rank, F.lit(n)))


def linear_probe(vectors: DataFrame, dims: list[int], n: int = 3, iterations: int = 200) -> DataFrame:
    """``dims, accuracy``: cross-validated logistic regression on (id, vec, label). The loop is over settings."""
    spark = vectors.sparkSession
    dealt = cut(folds(vectors, n), "folds")
    out = []
    for d in dims:
        rows = truncated(dealt, d).select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"), "fold").persist()
        right = total = 0
        for k in range(n):
            model = LogisticRegression(maxIter=iterations).fit(rows.where(F.col("fold") != k))
            r, t = model.transform(rows.where(F.col("fold") == k)).agg(F.count_if(F.col("prediction") == F.col("label")), F.count("*")).first()
            right, total = right + r, total + t
        rows.unpersist()
        out.append((d, right / total if total else 0.0))
    return spark.createDataFrame(out, "dims int, accuracy double")


def similarity_gap(vectors: DataFrame) -> DataFrame:
    """Mean cosine within and between labels of unit vectors (id, vec, label), from label sums alone.

    The sum of all dots of a set of unit vectors is |S|^2 with S their sum, so no pair of rows is ever formed.
    """
    means = mean_vectors(vectors, "label").select("label", "n", F.expr("transform(vec, x -> x * n)").alias("s"))
    whole = mean_vectors(vectors.withColumn("one", F.lit(1)), "one").select(F.col("n").alias("all_n"), F.expr("transform(vec, x -> x * n)").alias("all_s"))
    per = means.agg(F.sum(dot(F.col("s"), F.col("s"))).alias("own"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    met = per.join(F.broadcast(whole.select(dot(F.col("all_s"), F.col("all_s")).alias("every"), "all_n")))
    within = (F.col("own") - F.col("n")) / F.col("pairs")
    between = (F.col("every") - F.col("own")) / (F.col("n") * (F.col("n") - 1) - F.col("pairs"))
    return met.select(F.round(within, 6).alias("within_mean"), F.round(between, 6).alias("between_mean"), F.round(within - between, 6).alias("gap"))


def cluster_quality(vectors: DataFrame) -> DataFrame:
    """One row of cosine silhouette, Davies-Bouldin and Calinski-Harabasz of (id, vec, label)."""
    rows = vectors.select(array_to_vector("vec").alias("features"), F.col("label").cast("int").alias("prediction"))
    silhouette = ClusteringEvaluator(distanceMeasure="cosine").evaluate(rows)
    return scatter(vectors).withColumn("silhouette", F.round(F.lit(silhouette), 6))


def scatter(vectors: DataFrame) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz: rows meet only their own mean; means (one a label) meet one another."""
    means = mean_vectors(vectors, "label").select("label", F.col("vec").alias("mean"), "n")
    total = mean_vectors(vectors.withColumn("one", F.lit(1)), "one").select(F.col("vec").alias("centre"), F.col("n").alias("total"))
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    d2 = vectors.join(means, "label").select("label", gap(F.col("vec").cast("array<double>"), F.col("mean")).alias("d2"))
    spread = d2.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"))
    full = means.join(spread, "label")
    others = full.select(F.col("label").alias("l2"), F.col("mean").alias("m2"), F.col("s").alias("s2"))
    ratio = (F.col("s") + F.col("s2")) / F.sqrt(gap(F.col("mean"), F.col("m2")))
    db = full.join(F.broadcast(others), F.col("label") != F.col("l2")).groupBy("label").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("db"))
    both = full.join(F.broadcast(total)).agg(F.sum("w").alias("w"), F.sum(F.col("n") * gap(F.col("mean"), F.col("centre"))).alias("b"), F.count("*").alias("k"), F.max("total").alias("t"))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("t") - F.col("k")))
    return both.join(F.broadcast(db)).select(F.round("db", 6).alias("davies_bouldin"), F.round(ch, 4).alias("calinski_harabasz"))


def adjusted_rand(pairs: DataFrame, *keys: str) -> DataFrame:
    """Adjusted Rand index of two labelings ``(la, lb)``, from the contingency counts; one row for each value of ``keys``."""
    cells = pairs.groupBy(*keys, "la", "lb").agg(F.count("*").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cell = cells.groupBy(*keys).agg(F.sum(two("n")).alias("idx"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(two("n")).alias(name))
    a, b = side("la", "sa"), side("lb", "sb")
    met = cell.join(a, list(keys)).join(b, list(keys)) if keys else cell.join(F.broadcast(a)).join(F.broadcast(b))
    expected = F.col("sa") * F.col("sb") / two("total")
    top = (F.col("sa") + F.col("sb")) / 2
    return met.select(*keys, F.round(F.when((top == expected) | expected.isNull(), 1.0).otherwise((F.col("idx") - expected) / (top - expected)), 6).alias("ari"))


def silhouettes(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, silhouette``: the mean cosine silhouette of unit vectors ``rows(*keys, label, vec)`` for each value of ``keys``.

    The mean distance of a row to a cluster is one minus its product with the cluster's mean, so rows meet means only. A row
    alone in its cluster counts 0, and so do rows of a key with one cluster.
    """
    each = F.struct(*keys, "label")
    means = mean_vectors(rows.withColumn("of", each), "of").select("of.*", F.col("vec").alias("mean"), "n")
    every = means.groupBy(*keys).agg(F.collect_list(F.struct("label", "mean", "n")).alias("means"))  # as many as clusters
    met = rows.join(every, list(keys))
    gap = F.transform("means", lambda m: F.struct(m["label"].alias("label"), m["n"].alias("n"), (1 - dot(F.col("vec"), m["mean"])).alias("d")))
    met = met.select(*keys, "label", gap.alias("gap"))
    own = F.get(F.filter("gap", lambda g: g["label"] == F.col("label")), F.lit(0))
    other = F.array_min(F.transform(F.filter("gap", lambda g: g["label"] != F.col("label")), lambda g: g["d"]))
    met = met.select(*keys, own["n"].alias("n"), own["d"].alias("d"), other.alias("b")).withColumn("a", F.col("d") * F.col("n") / F.greatest(F.lit(1), F.col("n") - 1))
    worth = F.when((F.col("n") > 1) & F.col("b").isNotNull() & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return met.groupBy(*keys).agg(F.round(F.avg(worth), 6).alias("silhouette"))


def stability_grid(vectors: DataFrame, dims: list[int], ks: list[int], runs: int = 3) -> DataFrame:
    """``grp, dims, k, n, ari, silhouette`` for each group of ``vectors(id, grp, vec)`` and each pair of settings.

    ``ari`` is the mean agreement of all pairs of ``runs`` seeded k-means runs, ``silhouette`` that of the first; both are 0 for a
    group of fewer than ``2 k`` rows. All fits of all groups are one job (``lloyd``).
    """
    grid = [(d, k) for d in dims for k in ks]
    labels, _ = lloyd.fit(vectors, [lloyd.Setting(k, d, seed) for d, k in grid for seed in range(runs)])
    labels = cut(labels, "runs")
    label = lambda c, r: F.get("labels", F.lit(c * runs + r))
    both = [F.struct(F.lit(c).alias("cfg"), F.lit(i * runs + j).alias("pair"), label(c, i).alias("la"), label(c, j).alias("lb")) for c in range(len(grid)) for i in range(runs) for j in range(i + 1, runs)]
    pairs = labels.select("grp", F.explode(F.array(*both)).alias("x")).select("grp", "x.*")
    agreed = adjusted_rand(pairs, "grp", "cfg", "pair").groupBy("grp", "cfg").agg(F.avg("ari").alias("ari"))
    first = F.array(*[F.struct(F.lit(c).alias("cfg"), F.lit(d).alias("dims"), label(c, 0).alias("label")) for c, (d, _) in enumerate(grid)])
    shown = labels.join(vectors.select("id", "vec"), "id").select("grp", F.explode(first).alias("x"), "vec")
    shown = shown.select("grp", "x.cfg", "x.label", unit(F.slice("vec", F.lit(1), F.col("x.dims"))).alias("vec"))
    facts = F.array(*[F.struct(F.lit(c).alias("cfg"), F.lit(d).alias("dims"), F.lit(k).alias("k")) for c, (d, k) in enumerate(grid)])
    sizes = labels.groupBy("grp").agg(F.count("*").alias("n"))
    out = sizes.select("grp", "n", F.explode(facts).alias("x")).select("grp", "n", "x.*").join(agreed, ["grp", "cfg"], "left").join(silhouettes(shown, "grp", "cfg"), ["grp", "cfg"], "left")
    enough = lambda c: F.round(F.when(F.col("n") < 2 * F.col("k"), 0.0).otherwise(F.coalesce(c, F.lit(0.0))), 6).alias(c)
    return out.select("grp", "dims", "k", "n", enough("ari"), enough("silhouette"))


def length_tertiles(rows: DataFrame, cuts: tuple[float, float] = (0.33, 0.67)) -> DataFrame:
    """``id, length, bucket`` (short, medium, long) by the two length percentiles, rounded down."""
    edge = rows.agg(*[F.floor(F.percentile("length", F.lit(c))).alias(f"c{k}") for k, c in enumerate(cuts)])
    bucket = F.when(F.col("length") <= F.col("c0"), "short").when(F.col("length") <= F.col("c1"), "medium").otherwise("long")
    return rows.join(F.broadcast(edge)).select("id", "length", bucket.alias("bucket"))


def tertile_samples(rows: DataFrame, most: int = 300, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each bucket of :func:`length_tertiles`, by hash of (id, seed): the same on every run."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))), 256), "id"))
    return length_tertiles(rows).withColumn("n", rank).where(F.col("n") <= most).drop("n")


def finished_labels(rows: DataFrame, review: str = "NEEDS_REVIEW") -> DataFrame:
    """The rows whose label is settled: there, not blank, and not marked for review."""
    return rows.where((F.trim("label") != "") & (F.col("label") != review))


def left_to_label(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows whose id has no settled label in ``done(id, label)`` yet."""
    return rows.join(finished_labels(done).select("id"), "id", "left_anti")


def histogram(rows: DataFrame, column: str, width: float) -> DataFrame:
    return rows.groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))


def idea_loops(rows: DataFrame, least: float, gap_days: int, part: int = 1024) -> DataFrame:
    """Pairs of one topic, ``gap_days`` (at least 1) or more apart, the earlier first, with cosine at least ``least``. ``rows(id, topic, day, vec)``.

    A topic is dealt into parts of about ``part`` rows; two parts at a time are multiplied in one task, which passes on only
    the pairs that are near enough. Rows without a topic, day or vector are in no pair.
    """
    rows = rows.select("topic", "id", F.unix_date(F.to_date("day")).alias("day"), "vec").dropna()
    parts = F.ceil(F.count("*") / part).cast("int")
    dealt = rows.join(rows.groupBy("topic").agg(parts.alias("parts")), "topic")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.select("topic", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "day", "vec")
    kinds = dict(rows.dtypes)

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        first, second = pdf[pdf["part"] == i], pdf[pdf["part"] == j]
        if first.empty or second.empty:
            return pd.DataFrame(columns=["topic", "a", "b", "gap", "similarity"])
        cosine = np.stack(first["vec"].to_numpy()).astype(float) @ np.stack(second["vec"].to_numpy()).astype(float).T
        gap = second["day"].to_numpy()[None] - first["day"].to_numpy()[:, None]
        x, y = np.nonzero((cosine >= least) & ((gap if i == j else np.abs(gap)) >= gap_days))
        later = gap[x, y] > 0
        p, q = first["id"].to_numpy()[x], second["id"].to_numpy()[y]
        found = {"a": np.where(later, p, q), "b": np.where(later, q, p), "gap": np.abs(gap[x, y]), "similarity": cosine[x, y]}
        return pd.DataFrame({"topic": pdf["topic"].iloc[0]} | found, index=range(len(x)))

    pairs = f"topic {kinds['topic']}, a {kinds['id']}, b {kinds['id']}, gap int, similarity double"
    both = met.groupBy("topic", "i", "j").applyInPandas(near, pairs)
    return both.withColumn("similarity", F.round("similarity", 6))


def trajectory_coherence(points: DataFrame) -> DataFrame:
    """Per topic the mean cosine of consecutive steps of ``points(topic, at, vec)``."""
    w = Window.partitionBy("topic").orderBy("at")
    minus = lambda a, b: F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x - y)
    steps = points.withColumn("p", F.lag("vec").over(w)).where("p IS NOT NULL").withColumn("d", minus("vec", "p"))
    steps = steps.withColumn("e", F.lag("d").over(w)).where("e IS NOT NULL")
    cosine = dot(F.col("d"), F.col("e")) / F.greatest(F.lit(1e-16), F.sqrt(dot(F.col("d"), F.col("d"))) * F.sqrt(dot(F.col("e"), F.col("e"))))
    return steps.groupBy("topic").agg(F.round(F.avg(cosine), 6).alias("coherence"), F.count("*").alias("turns"))


def best_by(grid: DataFrame, group: str, setting: str, value: str) -> DataFrame:
    """The setting with the best value in each group (smallest of equals)."""
    return grid.groupBy(group).agg(F.max_by(setting, F.struct(F.col(value), -F.col(setting))).alias(f"best_{setting}"), F.max(value).alias(f"best_{value}"))


def plateau(scores: DataFrame, small: float = 0.01, real: float = 0.005) -> DataFrame:
    """``scores(dims, accuracy)``: the first dims after which the gain is under ``small``, the last with a gain over ``real``."""
    w = Window.orderBy("dims")
    g = scores.withColumn("next_gain", F.lead("accuracy").over(w) - F.col("accuracy")).withColumn("gain", F.col("accuracy") - F.lag("accuracy").over(w))
    return g.agg(F.min(F.when(F.col("next_gain") < small, F.col("dims"))).alias("plateau"), F.max(F.when(F.col("gain") > real, F.col("dims"))).alias("sweet_spot"))


def revisits(members: DataFrame, gap: int = 60, window: int = 90) -> DataFrame:
    """Per cluster of ``members(cluster, day)``, two members at least: returns, recent, velocity, span, days since."""
    newest = members.agg(F.max("day").alias("newest"))
    w = Window.partitionBy("cluster").orderBy("day")
    rows = members.withColumn("wait", F.datediff("day", F.lag("day").over(w))).join(F.broadcast(newest))
    per = rows.groupBy("cluster").agg(
        F.count("*").alias("members"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_if(F.col("wait") > gap).alias("returns"),
        F.count_if(F.col("day") >= F.date_sub("newest", window)).alias("recent"),
        F.max("newest").alias("newest"),
    )
    per = per.where("members >= 2").withColumn("span_days", F.datediff("last_day", "first_day"))
    months = F.greatest(F.col("span_days") / 30, F.lit(1.0))
    return per.select(
        "cluster", "members", "returns", "recent", "span_days",
        F.round(F.col("members") / months, 2).alias("velocity"), F.round(F.col("recent") / 3, 2).alias("velocity_recent"),
        F.datediff("newest", "last_day").alias("days_since"),
    )


def activity(rows: DataFrame, at: Column, buckets: int = 100) -> DataFrame:
    """``bucket, n, share, seen``: counts in equal stretches of time, scaled by the largest, and running total."""
    secs = rows.select(at.cast("timestamp").cast("double").alias("t")).where("t IS NOT NULL")
    edge = secs.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    size = (F.col("hi") - F.col("lo")) / buckets
    bucket = F.when(size > 0, F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("lo")) / size).cast("int"))).otherwise(0)
    n = secs.join(F.broadcast(edge)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = Window.orderBy("bucket")  # at most ``buckets`` rows
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return n.select("bucket", "n", F.round(F.col("n") / F.max("n").over(whole), 6).alias("share"), F.sum("n").over(every).alias("seen"))
