"""Fixpoints over DataFrames: the driver holds the loop, the data stays distributed.

Each step's result is checkpointed to the folder in spark.checkpoint.dir, which ends its lineage, so
a lost executor costs one step and plans don't grow with the number of steps. Loops run until the
fixpoint; where a limit is given and reached before it, they raise Unfinished.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that one task may walk by itself, about 16 MB of them; larger graphs are stepped through by joins.
LOCAL_EDGES = 1_000_000


class Unfinished(RuntimeError):
    """A limit of steps was reached before the fixpoint."""


def rounds(limit: int | None) -> Iterator[int]:
    """Numbers of steps; raises Unfinished if the loop wants one beyond the limit."""
    for n in itertools.count():
        if limit is not None and n >= limit:
            raise Unfinished(f"no fixpoint in {limit} steps")
        yield n


def settle(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder: spark.checkpoint.dir, or a temporary one where Spark runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewater-"))
    return df.checkpoint()


def union_fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_iterations: int | None = None) -> DataFrame:
    """base with step(everything so far) added, as a set, until nothing is new."""
    whole = settle(base.distinct())
    size = whole.count()
    for _ in rounds(max_iterations):
        more = settle(whole.union(step(whole).select(*whole.columns)).distinct())
        now = more.count()
        if now == size:
            return whole
        whole, size = more, now
    raise AssertionError


def delta_fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], max_iterations: int | None = None) -> DataFrame:
    """As union_fixpoint for steps that are linear: each sees only the rows that the one before added."""
    whole = front = settle(base.distinct())
    for _ in rounds(max_iterations):
        front = settle(step(front).select(*whole.columns).distinct().subtract(whole))
        if front.isEmpty():
            break
        whole = settle(whole.union(front))
    return whole


def _best_fixpoint(base: DataFrame, step, keys: list[str], best: Callable[[DataFrame], DataFrame], max_iterations: int | None) -> DataFrame:
    whole = settle(best(base))
    for _ in rounds(max_iterations):
        new = settle(best(whole.unionByName(step(whole).select(*whole.columns))))
        if new.exceptAll(whole).isEmpty():
            return whole
        whole = new
    raise AssertionError


def min_fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str, max_iterations: int | None = None) -> DataFrame:
    """Keeps for each key the least value that any step has derived."""
    best = lambda d: d.groupBy(*keys).agg(F.min(value).alias(value)).select(*base.columns)
    return _best_fixpoint(base, step, keys, best, max_iterations)


def lexmin_fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str], max_iterations: int | None = None) -> DataFrame:
    """Keeps for each key the lexicographically least tuple of values."""

    def best(d: DataFrame) -> DataFrame:
        return d.groupBy(*keys).agg(F.min(F.struct(*values)).alias("least")).select(*keys, "least.*").select(*base.columns)

    return _best_fixpoint(base, step, keys, best, max_iterations)


def count_filter(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys that at least so many rows derive."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*keys)


def do_while(state: dict[str, DataFrame], body: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], condition: Callable[[dict[str, DataFrame]], DataFrame], max_iterations: int | None = None) -> dict[str, DataFrame]:
    """Runs body once, and again as long as condition gives one row that is true."""
    for _ in rounds(max_iterations):
        state = {**state, **{k: settle(v) for k, v in body(state).items()}}
        row = condition(state).head()
        if row is None or not row[0]:
            break
    return state


def until_convergence(relations: dict[str, tuple[DataFrame, Callable[[dict[str, DataFrame]], DataFrame]]], max_iterations: int | None = None) -> dict[str, DataFrame]:
    """Relations (base, rule over all of them) as sets, stepped together until none grows."""
    now = {k: settle(base.distinct()) for k, (base, _) in relations.items()}
    size = {k: v.count() for k, v in now.items()}
    for _ in rounds(max_iterations):
        new = {k: settle(now[k].union(rule(now).select(*now[k].columns)).distinct()) for k, (_, rule) in relations.items()}
        sizes = {k: v.count() for k, v in new.items()}
        if sizes == size:
            return now
        now, size = new, sizes
    raise AssertionError


# Algorithms written with them ---------------------------------------------------------------------


def reachable(edges: DataFrame, sources: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Vertices that a path leads to from the sources' (column `id`), the sources included."""
    e = edges.select(F.col(src).alias("from_"), F.col(dst).alias("to_"))
    return delta_fixpoint(sources.select("id"), lambda front: front.join(e, front["id"] == e["from_"]).select(F.col("to_").alias("id")))


def connected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, root): the least vertex reachable over edges in either direction.

    By alternating stars: every vertex's neighbours are hung on its least one, the larger ones first, then
    the smaller ones; long paths halve at each step, so that steps grow with their logarithm.
    """
    links = settle(edges.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).distinct())
    ids = settle(links.select(F.col("hi").alias("id")).union(links.select("lo")).distinct())
    links, before = links.filter("hi <> lo"), None
    for _ in rounds(None):
        both = links.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(links.select("lo", "hi"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.filter("b > a").join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        least = hung.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = hung.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        links = settle(hung.filter("hi <> lo").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return ids.join(links.select(F.col("hi").alias("id"), "lo"), "id", "left").select("id", F.coalesce("lo", "id").alias("root"))


def shortest_paths(edges: DataFrame, sources: DataFrame, src: str = "src", dst: str = "dst", cost: str = "cost", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, cost) of the cheapest path from any source. A cycle of negative cost has no cheapest path and raises where it is walked locally.

    Graphs of up to local_edges edges are walked by one task; larger ones by joins, in which only vertices
    whose cost has just sunk go on.
    """
    e = edges.select(F.col(src).alias("from_"), F.col(dst).alias("to_"), F.col(cost).cast("double").alias("step_"))
    base = sources.select("id", F.lit(0.0).alias("cost")).distinct()
    if e.limit(local_edges + 1).count() <= local_edges:
        kind = dict(base.dtypes)["id"]
        one = F.lit(0).alias("g")
        return e.withColumn("g", one).groupBy("g").cogroup(base.withColumn("g", one).groupBy("g")).applyInPandas(_walk, f"id {kind}, cost double")
    whole = front = settle(base)
    for _ in rounds(None):
        reached = front.join(e, front["id"] == e["from_"]).groupBy(F.col("to_").alias("id")).agg(F.min(F.col("cost") + F.col("step_")).alias("cost"))
        known = whole.select("id", F.col("cost").alias("known"))
        front = settle(reached.join(known, "id", "left").filter("known is null or cost < known").select("id", "cost"))
        if front.isEmpty():
            break
        whole = settle(whole.union(front).groupBy("id").agg(F.min("cost").alias("cost")))
    return whole


def _walk(edges, sources):
    """Least costs by a queue of vertices whose cost has sunk."""
    from collections import deque

    import pandas as pd

    out: dict = {}
    for a, b, w in zip(edges["from_"], edges["to_"], edges["step_"]):
        out.setdefault(a, []).append((b, w))
    cost = dict.fromkeys(sources["id"], 0.0)
    queue, waiting, left = deque(cost), set(cost), (len(out) + 1) * (len(edges) + 1)
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        for to, w in out.get(v, ()):
            left -= 1
            if cost[v] + w < cost.get(to, float("inf")):
                cost[to] = cost[v] + w
                if to not in waiting:
                    waiting.add(to)
                    queue.append(to)
        if left < 0:
            raise ValueError("a cycle of negative cost")
    return pd.DataFrame({"id": list(cost), "cost": list(cost.values())})


def pagerank(edges: DataFrame, vertices: DataFrame, damping: float = 0.85, iterations: int = 20, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, rank) after so many steps; ranks start at 1/n, vertices without edges out keep nothing."""
    n = vertices.count()
    degree = edges.groupBy(F.col(src).alias("id")).agg(F.count(F.lit(1)).alias("out_"))
    links = settle(edges.join(degree, edges[src] == degree["id"]).select(F.col(src).alias("from_"), F.col(dst).alias("to_"), (1.0 / F.col("out_")).alias("share")))
    ranks = vertices.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(iterations):
        given = links.join(ranks, links["from_"] == ranks["id"]).groupBy(F.col("to_").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = settle(vertices.select("id").join(given, "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks


def kmeans(points: DataFrame, id_col: str, columns: list[str], k: int, max_iterations: int = 50) -> DataFrame:
    """id and cluster (0..k-1), once no centre moves or after max_iterations rounds, as is usual for this method.

    Centres start at the k points at even quantiles of the id; the centres, of bounded number, travel as literals.
    """
    rows = settle(points.select(id_col, *columns).dropna())
    at = rows.agg(F.percentile_approx(id_col, [(2 * i + 1) / (2 * k) for i in range(k)], 10_000)).first()[0] or []
    picked = [tuple(float(r[c]) for c in columns) for r in rows.filter(F.col(id_col).isin(sorted(set(at)))).orderBy(id_col, *columns).limit(k).collect()]
    cluster: Column = F.lit(0)
    for _ in range(max_iterations):
        far = F.array(*(sum(((F.col(c) - F.lit(v)) ** 2 for c, v in zip(columns, p)), F.lit(0.0)) for p in picked))
        cluster = F.array_position(far, F.array_min(far)).cast("int") - 1
        means = {r["cluster"]: tuple(r[c] for c in columns) for r in rows.withColumn("cluster", cluster).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in columns)).collect()}
        new = [means.get(i, p) for i, p in enumerate(picked)]
        if new == picked:
            break
        picked = new
    return rows.select(id_col, cluster.alias("cluster"))


def sigma_clip(values: DataFrame, column: str, sigmas: float = 2.0, max_iterations: int | None = None) -> DataFrame:
    """Rows left when those further than so many population deviations from the mean go, again and again."""
    kept, size = settle(values), None
    for _ in rounds(max_iterations):
        m, s, n = kept.agg(F.avg(column), F.stddev_pop(column), F.count(F.lit(1))).first()
        if n == size or not n:
            break
        size = n
        kept = settle(kept.filter(F.abs(F.col(column) - m) <= sigmas * s))
    return kept
