"""Class hierarchies with several parents: cores, paths, pools, boundaries and what follows from them.

Edges are (c, p, ...): child and parent. Null ends are left out, repeated edges
count once, and empty tables give empty results. Walks go level by level; each
level is written, so a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def core_by_order(edges: DataFrame, cores: DataFrame, order: str, max_depth: int = 8) -> DataFrame:
    """(node, core, depth, path): each class takes the core of its first parent, in the given order, that is core or has one already.

    Level by level: parents that got their core in an earlier level count. ``path``
    runs from the class to its core, joined by bars. ``cores`` has (node).
    """
    e = materialize(edges.where("c IS NOT NULL AND p IS NOT NULL").groupBy("c", "p").agg(F.min(order).alias("o")), "ordered")
    seen = materialize(cores.select("node").distinct().select("node", F.col("node").alias("core"), F.lit(0).cast("long").alias("depth"), F.col("node").alias("path")), "cores")
    frontier = seen
    for d in range(1, max_depth + 1):
        step = e.join(frontier.select(F.col("node").alias("p"), "core", "path"), "p").join(seen.select(F.col("node").alias("c")), "c", "left_anti")
        step = step.groupBy("c").agg(F.min(F.struct("o", "p", "core", "path")).alias("s"))
        frontier = materialize(step.select(F.col("c").alias("node"), "s.core", F.lit(d).cast("long").alias("depth"), F.concat_ws("|", "c", "s.path").alias("path")), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def by_policy(edges: DataFrame, source: str, policy: list[str]) -> DataFrame:
    """The edges of each child from the first source of the policy that has any for it; other sources do not count."""
    rank = F.array_position(F.lit(policy), F.col(source))
    e = edges.where(rank > 0).withColumn("_r", rank)
    best = e.groupBy("c").agg(F.min("_r").alias("_b"))
    return e.join(best, "c").where("_r = _b").drop("_r", "_b")


def pool_stats(members: DataFrame, edges: DataFrame, weight: DataFrame) -> DataFrame:
    """(core, nodes, internal_edges, max_weight, median_weight, sum_weight) of each pool; members (core, node), weight (node, n), absent as 0."""
    m = members.select("core", "node").distinct()
    w = m.join(weight.select("node", "n"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = w.groupBy("core").agg(F.count("*").alias("nodes"), F.max("n").alias("max_weight"), F.median("n").alias("median_weight"), F.sum("n").alias("sum_weight"))
    inner = edges.select("c", "p").distinct().join(m.select(F.col("node").alias("c"), "core"), "c").join(m.select(F.col("node").alias("p"), "core"), ["p", "core"])
    return g.join(inner.groupBy("core").agg(F.count("*").alias("internal_edges")), "core", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))


def direct_links(candidates: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, linked): whether an edge, in either direction, joins a candidate with a seed."""
    s = seeds.select("node").distinct()
    hit = edges.join(s.withColumnRenamed("node", "p"), "p", "left_semi").select(F.col("c").alias("node"))
    hit = hit.union(edges.join(s.withColumnRenamed("node", "c"), "c", "left_semi").select(F.col("p").alias("node"))).distinct().withColumn("linked", F.lit(True))
    return candidates.select("node").distinct().join(hit, "node", "left").select("node", F.coalesce("linked", F.lit(False)).alias("linked"))


def expandable(is_class: Column, relevant: Column, seed: Column, core_match: Column, hop: Column) -> Column:
    """Whether an entity is expanded: no class node; relevant, seed, or with a core class and one or two steps from a seed. Null is no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return ~yes(is_class) & (yes(relevant) | yes(seed) | (yes(core_match) & yes(hop.between(1, 2))))


def membership(core_of: DataFrame, edges: DataFrame) -> DataFrame:
    """(core, node, kind): below each core, what others descend from is a ``subclass``, what nothing descends from an ``instance``."""
    up = edges.select(F.col("p").alias("node")).distinct().withColumn("kind", F.lit("subclass"))
    return core_of.select("core", "node").distinct().join(up, "node", "left").select("core", "node", F.coalesce("kind", F.lit("instance")).alias("kind"))


def boundary(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, relevant: DataFrame) -> DataFrame:
    """(node) to put out: seeds, what is one or two undirected steps from them, and what is relevant.

    Without seeds only what is relevant; without edges everything.
    """
    from .graph import hops

    if edges.isEmpty():
        return nodes.select("node").distinct()
    keep = relevant.select("node")
    if not seeds.isEmpty():
        keep = keep.union(seeds.select("node")).union(hops(edges, "c", "p", seeds, 2).select("node"))
    return nodes.select("node").distinct().join(keep.distinct(), "node", "left_semi")


def active_classes(nodes: DataFrame, runtime: DataFrame, structural: DataFrame, core_of: DataFrame) -> DataFrame:
    """(node): classes with activity of either kind that are core or below one."""
    busy = runtime.select("node").union(structural.select("node")).distinct()
    return nodes.select("node").distinct().join(busy, "node", "left_semi").join(core_of.select("node").distinct(), "node", "left_semi")


def split_instances(instances: DataFrame, classes: DataFrame, resolved: DataFrame, fallback: DataFrame, relevant: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """(node, core, part): class nodes left out; the resolved core, else that of the path; included and excluded by rule; relevant or not, or without core.

    include (node, core) wins over all, exclude (node, core) takes a core away.
    """
    d = instances.select("node").distinct().join(classes.select("node").distinct(), "node", "left_anti")
    one = lambda df, name: df.groupBy("node").agg(F.min("core").alias(name))
    d = d.join(one(include, "i"), "node", "left").join(one(resolved, "r"), "node", "left").join(one(fallback, "f"), "node", "left")
    d = d.select("node", F.coalesce("i", "r", "f").alias("core"), F.col("i").isNotNull().alias("forced"))
    out = exclude.select("node", "core").distinct().withColumn("x", F.lit(True))
    d = d.join(out, ["node", "core"], "left").withColumn("core", F.when(F.col("forced") | F.col("x").isNull(), F.col("core")))
    d = d.join(relevant.select("node").distinct().withColumn("y", F.lit(True)), "node", "left")
    return d.select("node", "core", F.when(F.col("core").isNull(), "no_core").when(F.col("y"), "relevant").otherwise("not_relevant").alias("part"))


def lineage_diagnosis(id_: Column, parents: Column, path: Column) -> Column:
    """What is wrong with a recovered row: ``missing_id``, ``no_signal``, ``malformed_parents``, ``malformed_path``, else ``ok``."""
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    ids = r"^\s*Q[0-9]+\s*(\|\s*Q[0-9]+\s*)*$"
    return (
        F.when(empty(id_) | ~F.coalesce(F.upper(id_).rlike(r"Q[0-9]+"), F.lit(False)), "missing_id").when(empty(parents) & empty(path), "no_signal")
        .when(~empty(parents) & ~parents.rlike(ids), "malformed_parents").when(~empty(path) & ~path.rlike(ids), "malformed_path").otherwise("ok")
    )


def expand_seeds(seeds: DataFrame, links: DataFrame, cap: int, cursor: DataFrame | None = None) -> DataFrame:
    """(seed, n_new, last, stop_reason): the next page of each seed's incoming links, ordered by id, after its cursor (seed, after).

    ``cap`` rows a seed are taken; the reason tells whether more are left. Seeds
    without further links have no row. Ranks prune each seed's rows task by task.
    """
    d = links.join(seeds.select("seed").distinct(), "seed").select("seed", "id").distinct()
    if cursor is not None:
        d = d.join(cursor.select("seed", "after"), "seed", "left").where("after IS NULL OR id > after").drop("after")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("seed").orderBy("id"))).where(F.col("_r") <= cap + 1)
    g = d.groupBy("seed").agg(F.count_if(F.col("_r") <= cap).alias("n_new"), F.max(F.when(F.col("_r") <= cap, F.col("id"))).alias("last"), F.max("_r").alias("_m"))
    return g.select("seed", "n_new", "last", F.when(F.col("_m") > cap, "per_seed_cap").otherwise("exhausted").alias("stop_reason"))


def mid_level(df: DataFrame, carrier: str, value: str, mapping: DataFrame) -> DataFrame:
    """(mid, persons): each carrier counts once for a mid class, however many of its values it has; mapping (value, mid)."""
    m = mapping.select(F.col("value").alias("_v"), "mid").distinct()
    return df.select(F.col(carrier).alias("_c"), F.col(value).alias("_v")).join(m, "_v").groupBy("mid").agg(F.count_distinct("_c").alias("persons"))
