"""Hierarchical density clustering: all levels of mutual reachability, and the clusters of largest stability.

1. Equal vectors become one node with a weight; core distances and some more nearest neighbours come from ``density``.
2. A spanning tree of smallest mutual reachability in Borůvka rounds: every component looks for its smallest outgoing edge. The
   listed neighbours give one; where a row might have a shorter edge that is not listed, it is compared with those cells only
   that come near enough and do not lie in its own component altogether. The largest component need not look.
3. Levels are read off the tree in bands of at most ``BAND`` edges, lightest first: what the lighter bands have joined is one
   piece, so a band is a forest over pieces, and each of its trees is worked through by itself. A piece of at least the least
   size is a cluster; lighter pieces fall into the cluster they meet, and clusters that meet end in a new one. Stability and
   the best choice below a cluster are known when it ends.
4. Rows take the topmost chosen cluster above them, by pointer doubling.

All merges at one distance are one step, so the result does not depend on the order of equal edges. The whole tree as a root is
not a cluster. Where distances hardly differ step 2 compares nearly all rows, with their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.operators.density import Cells, against, components, cores, placed, squares
from notegraph.session import cut

#: Edges that are worked through at once, and the distance below which levels are not told apart.
BAND, TINY = 1 << 18, 1e-9
EDGE = "a bigint, b bigint, w double"


def _outside(rows: DataFrame, state: DataFrame, asking: DataFrame, cells: Cells, largest: int) -> DataFrame:
    """``comp, a, b, w``: for each asking row's component the smallest edge out of it that is shorter than its ``bound``, by task.

    ``rows(id, vec, core, home)``, ``state(id, comp)``, ``asking(id, bound)``.
    """
    whole = rows.select("id", "home").join(state, "id").groupBy("home").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo = hi").collect()  # one row a cell
    only = np.full(len(cells.sizes), np.iinfo(np.int64).min)
    for r in whole:
        only[r["home"]] = r["lo"]
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def near(some: pd.DataFrame, d: np.ndarray, cells: Cells) -> np.ndarray:
        reached = (cells.floor(d, some["home"].to_numpy()) < some["bound"].to_numpy()[:, None]) & (cells.sizes > 0)
        return reached & (shared.value[None] != some["comp"].to_numpy()[:, None])

    def start(block: dict[str, np.ndarray]):
        comps, of = np.unique(block["comp"], return_inverse=True)
        limit, edge, found = np.full(len(comps), np.inf), np.zeros((len(comps), 2), int), np.zeros(len(comps), bool)
        limit[of] = block["bound"] ** 2  # one for all rows of a component
        core = block["core"] ** 2

        def tile(at: slice, others: dict[str, np.ndarray]) -> None:
            d = squares(block["vec"][at], others["vec"])
            np.maximum(d, others["core"][None] ** 2, out=d)
            mine = np.flatnonzero(np.isin(others["comp"], comps))
            if len(mine):
                d[:, mine] = np.where(block["comp"][at][:, None] == others["comp"][mine][None], np.inf, d[:, mine])
            to = d.argmin(1)
            w = np.maximum(d[np.arange(len(d)), to], core[at])
            better = np.flatnonzero(w < limit[of[at]])
            if not len(better):
                return
            better = better[np.argsort(w[better], kind="stable")]
            c, first = np.unique(of[at][better], return_index=True)
            better = better[first]
            limit[c], found[c] = w[better], True
            edge[c, 0], edge[c, 1] = block["id"][at][better], others["id"][to[better]]

        def result() -> Iterator[pa.RecordBatch]:
            columns = [comps[found], edge[found, 0], edge[found, 1], np.sqrt(limit[found]).round(9)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["comp", "a", "b", "w"])

        return tile, result

    there = rows.join(state, "id")
    return against(there.join(asking, "id"), there, cells, near, start, f"comp bigint, {EDGE}")


def spanning_edges(core: DataFrame, near: DataFrame, vectors: DataFrame, cell: int = 1024) -> DataFrame:
    """``a, b, w``: edges of mutual reachability that hold a smallest spanning tree of all rows (a few equal ones more at most).

    ``core(id, core)``, ``near(a, b, dist)`` (the nearest others of every row), ``vectors(id, vec)``; ids are long.
    """
    rows, cells = placed(vectors, cell)
    n = core.count()
    if n < 2 or cells is None:
        return core.sparkSession.createDataFrame([], EDGE)
    rows = cut(rows.join(core.select("id", "core"), "id").select("id", "vec", "core", "home"), "tree-rows")
    ca, cb = core.select(F.col("id").alias("a"), F.col("core").alias("core_a")), core.select(F.col("id").alias("b"), F.col("core").alias("core_b"))
    listed = near.join(ca, "a").join(cb, "b").select("a", "b", F.round(F.greatest("dist", "core_a", "core_b"), 9).alias("w"))
    live = cut(listed.unionByName(listed.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "listed")
    #: an edge that is not listed is at least so long
    reach = near.groupBy("a").agg(F.max("dist").alias("reach"), F.count("*").alias("m"))
    reach = cut(core.join(reach, core["id"] == reach["a"], "left").select("id", F.when(F.coalesce("m", F.lit(0)) < n - 1, F.coalesce("reach", F.lit(0.0))).otherwise(math.inf).alias("reach")), "reach")
    state = core.select("id", F.col("id").alias("comp"))
    found: list[DataFrame] = []
    while True:
        sizes = state.groupBy("comp").agg(F.count("*").alias("n"))
        largest, k = sizes.agg(F.max_by("comp", F.struct("n", "comp")), F.count("*")).first()
        if k == 1:
            break
        left, right = state.select(F.col("id").alias("a"), F.col("comp").alias("ca")), state.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        live = cut(live.join(left, "a").join(right, "b").where("ca <> cb").select("a", "b", "w", F.col("ca").alias("comp")), "live")
        best = live.where(F.col("comp") != largest).groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("comp", "e.*")
        best = cut(best, "best")
        bound = state.where(F.col("comp") != largest).join(best.select("comp", "w"), "comp", "left").select("id", F.coalesce("w", F.lit(math.inf)).alias("bound"))
        open_ = bound.join(reach, "id").join(core.select("id", "core"), "id").where("reach < bound AND core < bound").select("id", "bound")
        open_ = cut(open_, "open")
        if not open_.isEmpty():
            more = _outside(rows, state, open_, cells, largest)
            best = cut(best.unionByName(more.select("comp", "w", "a", "b")).groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("comp", "e.*"), "best")
        found.append(best.select("a", "b", "w"))
        hooks = best.join(right.select("b", F.col("cb").alias("other")), "b").select(F.col("comp").alias("a"), F.col("other").alias("b"))
        joined = components(hooks).select(F.col("id").alias("comp"), "component")
        state = cut(state.join(joined, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), "comps")
        live = live.drop("comp")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct()


STEP = "what string, x bigint, to bigint, size bigint, gain double, kids double, chosen boolean"


def merges(edges: pd.DataFrame, pieces: dict[int, tuple[int, float, float]], least: int) -> list[tuple]:
    """The merges of one tree of a band: rows of ``STEP``.

    ``edges(a, b, w, at)`` between pieces, ``at`` a number of each edge's own; ``pieces``: size, gain and best below, by piece;
    clusters have negative numbers. ``link``: x goes under ``to``. ``end``: cluster x ends in ``to``. ``piece``: x as it is left.
    """
    up = {p: p for p in pieces}
    out: list[tuple] = []

    def find(p: int) -> int:
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    edges = edges.sort_values(["w", "at"])
    a, b, w, at = (edges[c].to_numpy() for c in ("a", "b", "w", "at"))
    lo = 0
    while lo < len(w):
        hi = int(np.searchsorted(w, w[lo], side="right"))
        rate = 1 / max(float(w[lo]), TINY)
        near: dict[int, set[int]] = {}
        for k in range(lo, hi):
            p, q = find(int(a[k])), find(int(b[k]))
            if p != q:
                near.setdefault(p, set()).add(q)
                near.setdefault(q, set()).add(p)
        seen: set[int] = set()
        for first in sorted(near):
            if first in seen:
                continue
            group, todo = [], [first]
            seen.add(first)
            while todo:
                p = todo.pop()
                group.append(p)
                fresh = near[p] - seen
                seen |= fresh
                todo.extend(fresh)
            clusters = sorted(p for p in group if p < 0)
            small = sorted(p for p in group if p >= 0)
            size = sum(pieces[p][0] for p in group)
            if len(clusters) == 1:
                top = clusters[0]
                _, gain, kids = pieces[top]
                pieces[top] = size, gain + rate * sum(pieces[p][0] for p in small), kids
            elif clusters or size >= least:
                # the number of an edge of this step, one for each group: no other cluster has it
                inside = set(group)
                top = -2 - 2 * int(min(at[k] for k in range(lo, hi) if find(int(a[k])) in inside))
                kids = 0.0
                for c in clusters:
                    n, gain, below = pieces[c]
                    own = gain - n * rate
                    kids += max(own, below)
                    out.append(("end", c, top, n, own, below, own >= below))
                    up[c] = top
                up[top] = top
                pieces[top] = size, size * rate, kids
            else:
                top = small[0]
                pieces[top] = size, 0.0, 0.0
            for p in small:
                if p != top:
                    out.append(("link", p, top, None, None, None, None))
                    up[p] = top
        lo = hi
    roots = {find(p) for p in list(up)}
    out += [("piece", p, None, *pieces[p], None) for p in sorted(roots)]
    return out


def condensed(edges: DataFrame, nodes: DataFrame, least: int, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """The condensed tree of ``edges(a, b, w)`` over ``nodes(id, core, w)``.

    ``x, to``: what each node, or small piece named by one of its nodes, falls into; and of each cluster (a negative number)
    ``cluster, parent, size, stability, chosen``, the root of a tree with no parent and never chosen.
    """
    spark = edges.sparkSession
    edges = cut(edges.withColumn("at", F.monotonically_increasing_id()), "tree-edges")
    # a node of many copies is a cluster from its core distance on
    own = -1 - 2 * F.col("id")
    heavy = F.col("w") >= least
    rate = 1 / F.greatest("core", F.lit(TINY))
    nodes = nodes.select("id", "core", "w", F.when(heavy, own).otherwise(F.col("id")).alias("piece"))
    links = [cut(nodes.where(F.col("piece") < 0).select(F.col("id").alias("x"), F.col("piece").alias("to")), "links")]
    pieces = cut(nodes.select("piece", F.col("w").alias("size"), F.when(heavy, F.col("w") * rate).otherwise(0.0).alias("gain"), F.lit(0.0).alias("kids")), "pieces")
    place = cut(nodes.select("id", "piece"), "place")
    ends: list[DataFrame] = []
    count = edges.count()
    bands = max(1, -(-count // band))
    edges_at = [-math.inf, math.inf]
    if bands > 1:
        cuts = edges.agg(F.percentile_approx("w", [k / bands for k in range(1, bands)], 100 * bands)).first()[0]
        edges_at = [-math.inf, *sorted(set(cuts)), math.inf]
    for low, high in zip(edges_at[:-1], edges_at[1:], strict=True):
        some = edges.where((F.col("w") > low) & (F.col("w") <= high))
        pa, pb = place.select(F.col("id").alias("a"), F.col("piece").alias("pa")), place.select(F.col("id").alias("b"), F.col("piece").alias("pb"))
        some = some.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "w", "at")
        some = cut(some, "band")
        if some.isEmpty():
            continue
        if bands > 1:
            trees = components(some).select(F.col("id").alias("a"), F.col("component").alias("tree"))
            some = some.join(trees, "a")
        else:
            some = some.withColumn("tree", F.lit(0).cast("long"))
        some = cut(some, "trees")
        touched = some.select(F.col("tree").alias("of"), F.col("a").alias("piece")).unionByName(some.select(F.col("tree").alias("of"), F.col("b").alias("piece"))).distinct().join(pieces, "piece")

        def work(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            known = {int(x): (int(s), float(g), float(k)) for x, s, g, k in zip(p["piece"], p["size"], p["gain"], p["kids"], strict=True)}
            out = pd.DataFrame(merges(e, known, least), columns=["what", "x", "to", "size", "gain", "kids", "chosen"])
            return out.astype({"x": "int64", "to": "Int64", "size": "Int64", "gain": "float64", "kids": "float64", "chosen": "boolean"})

        done = cut(some.groupBy("tree").cogroup(touched.groupBy("of")).applyInPandas(work, STEP), "merges")
        links.append(done.where("what = 'link'").select("x", "to"))
        ends.append(done.where("what = 'end'").select(F.col("x").alias("cluster"), F.col("to").alias("parent"), "size", F.col("gain").alias("stability"), "chosen"))
        if high < math.inf:
            left = done.where("what = 'piece'").select(F.col("x").alias("piece"), "size", "gain", "kids")
            pieces = cut(pieces.join(touched.select("piece").distinct(), "piece", "left_anti").unionByName(left), "pieces")
            gone = done.where("what <> 'piece'").select("x", "to")
            moved = topmost(gone.select("x", "to", F.lit(None).cast("long").alias("mark")), last=True).select(F.col("x").alias("piece"), F.col("top").alias("now"))
            place = cut(place.join(moved, "piece", "left").select("id", F.coalesce("now", "piece").alias("piece")), "place")
        else:
            roots = done.where("what = 'piece' AND x < 0")
            ends.append(roots.select(F.col("x").alias("cluster"), F.lit(None).cast("long").alias("parent"), "size", F.lit(0.0).alias("stability"), F.lit(False).alias("chosen")))
    if not ends:
        return links[0], spark.createDataFrame([], "cluster bigint, parent bigint, size bigint, stability double, chosen boolean")
    down, clusters = links[0], ends[0]
    for more in links[1:]:
        down = down.unionByName(more)
    for more in ends[1:]:
        clusters = clusters.unionByName(more)
    return down, clusters


def topmost(up: DataFrame, last: bool = False) -> DataFrame:
    """``x, top``: the mark farthest up from ``x``, itself included, in a forest ``up(x, to, mark)``; with ``last`` the root instead.

    Pointers are doubled until none is left: as many rounds as the logarithm of the depth.
    """
    own = F.coalesce("to", "x") if last else F.col("mark")
    state = cut(up.select("x", "to", own.alias("top")), "pointers")
    while not state.where("to IS NOT NULL").isEmpty():
        above = state.select(F.col("x").alias("to"), F.col("to").alias("next"), F.col("top").alias("upper"))
        state = cut(state.join(above, "to", "left").select("x", F.col("next").alias("to"), F.coalesce("upper", "top").alias("top")), "pointers")
    return state.select("x", "top")


def density_tree(vectors: DataFrame, min_cluster_size: int, min_samples: int | None = None, band: int = BAND) -> DataFrame:
    """``id, label``: the clusters of largest stability, numbered by size, then smallest id; noise is -1.

    ``min_samples`` (by default the least size of a cluster) rows, itself included, lie within a row's core distance. Fewer rows
    than that, or than a cluster needs, are all noise, and so are rows without a vector.
    """
    k = max(1, (min_samples or min_cluster_size) - 1)
    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    there = rows.where("vec IS NOT NULL")
    numbered = cut(there.groupBy("vec").agg(F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "numbered")
    same, near, core = cores(there.join(numbered, "vec").select(F.col("node").alias("id"), "vec"), k, 8)
    n = same.agg(F.sum("w")).first()[0] or 0
    noise = rows.select("id", F.lit(-1).alias("label"))
    if n < max(min_cluster_size, k + 1):
        return noise
    edges = spanning_edges(core, near, same.select("id", "vec"))
    down, clusters = condensed(edges, core, min_cluster_size, band)
    clusters = cut(clusters, "clusters")
    marked = clusters.select(F.col("cluster").alias("x"), F.col("parent").alias("to"), F.when(F.col("chosen"), F.col("cluster")).alias("mark"))
    tops = topmost(down.select("x", "to", F.lit(None).cast("long").alias("mark")).unionByName(marked)).where("top IS NOT NULL")
    held = cut(numbered.select("vec", "first", F.col("node").alias("x")).join(tops, "x"), "held")
    sizes = there.join(held.select("vec", "top"), "vec").groupBy("top").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    # one row a cluster
    names = sizes.withColumn("label", F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).select("top", "label")
    named = held.select("vec", "top").join(names, "top").select("vec", "label")
    return rows.join(named, "vec", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))
