"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles.

Method: level-wise frontier joins from the roots extend paths and depths, a band
of levels at a time, until a round finds no child. A node has one parent, so it
is reached at most once. Nodes that no round reached hang on cycles; the smallest
member of each cycle is found by pointer doubling over the unreached nodes only
(log2 of their number rounds).

Defined results: rows whose id can't be read are dropped; an unreadable or blank
parent means "no parent"; rows with null times count as the oldest; of several
rows with the latest time the one with the largest parent holds; an empty table
gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def q_number(c: Column) -> Column:
    """``Q`` and digits out of any writing of an id (case, blanks, prefix, brackets, leading zeros); else null."""
    digits = F.regexp_extract(c, r"[Qq]\s*0*(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("Q"), digits))


def current_links(rows: DataFrame, node: Column, parent: Column, version: Column) -> DataFrame:
    """(node, parent): of each node's rows the one with the latest version."""
    return (
        rows.select(node.alias("node"), F.struct(version.alias("v"), parent.alias("p")).alias("s"))
        .where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.max("s").alias("s"))
        .select("node", F.col("s.p").alias("parent"))
    )


def resolve(links: DataFrame, roots: DataFrame, keep_paths: bool = True, stride_doublings: int = 4, below_cycles: bool = False) -> DataFrame:
    """(node, root, depth[, path]) for each node of ``links``.

    ``links`` has (node, parent), one row per node; ``roots`` has (node): these
    end a path whatever their own row says. Nodes on or below a cycle get depth
    -1, the smallest id of the cycle as root and a path of their own id alone.
    ``path`` runs from the root down to the node. With ``below_cycles`` the path of
    a node below a cycle begins with the member of the cycle it hangs on.

    Each frontier holds a band of ``2 ** stride_doublings`` levels: the edges are
    first joined with themselves so often that every node knows its ancestors up
    to that distance, and a band then joins on the farthest of them. A tree of
    depth d takes d / 2 ** stride_doublings rounds.
    """
    links = materialize(
        links.join(roots.select(F.col("node").alias("r")).distinct(), F.col("node") == F.col("r"), "left")
        .select("node", F.when(F.col("r").isNull(), F.col("parent")).alias("parent")),
        "links",
    )
    edges = links.where("parent IS NOT NULL")
    cols = ["node", "root", "depth"] + (["path"] if keep_paths else [])
    chain = ["chain"] if keep_paths else []
    step = edges.select("node", F.col("parent").alias("top"), F.lit(1).cast("long").alias("len"), *([F.array("parent").alias("chain")] if keep_paths else []))
    for _ in range(stride_doublings):
        far = step.select(F.col("node").alias("f_node"), F.col("top").alias("f_top"), F.col("len").alias("f_len"), *[F.col(c).alias("f_chain") for c in chain])
        step = materialize(
            step.join(far, F.col("top") == F.col("f_node"), "left").select(
                "node", F.coalesce("f_top", "top").alias("top"), (F.col("len") + F.coalesce("f_len", F.lit(0))).alias("len"),
                *[F.when(F.col("f_chain").isNull(), F.col("chain")).otherwise(F.concat("chain", "f_chain")).alias("chain") for _ in chain],
            ),
            "step",
        )
    stride = 2**stride_doublings

    def below(top_path: Column) -> list[Column]:
        return [F.concat(top_path, F.reverse("chain"), F.array("node")).alias("path")] if keep_paths else []

    def origin(df: DataFrame) -> DataFrame:
        out = df.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
        return out.withColumn("path", F.array("node")) if keep_paths else out

    own = origin(links.where("parent IS NULL"))
    ghosts = origin(edges.select(F.col("parent").alias("node")).distinct().join(links.select("node"), "node", "left_anti"))
    empty_path = F.array().cast("array<string>")
    first = step.where(F.col("len") < stride).select("node", F.col("top").alias("root"), F.col("len").alias("depth"), *below(empty_path))
    done = materialize(own.unionByName(first), "band")
    bands, frontier, pending = [done], done.unionByName(ghosts), step.where(F.col("len") == stride)
    while True:
        up = frontier.select(*[F.col(c).alias(f"u_{c}") for c in cols])
        head = F.slice("u_path", F.lit(1), F.size("u_path") - 1) if keep_paths else empty_path
        frontier = materialize(
            pending.join(up, F.col("top") == F.col("u_node")).select(
                "node", F.col("u_root").alias("root"), (F.col("u_depth") + stride).alias("depth"), *below(head)
            ),
            "band",
        )
        if frontier.isEmpty():
            break
        bands.append(frontier)
    reached = bands[0]
    for f in bands[1:]:
        reached = reached.unionByName(f)
    lost = materialize(edges.join(reached.select("node"), "node", "left_anti"), "unreached")
    cyc = cycle_roots(lost)
    hung = None
    if keep_paths and below_cycles:
        cyc = materialize(cyc, "cycles")
        # without the cycles, what hangs below them is a forest whose roots their members are
        hung = resolve(lost.join(cyc.where("on_cycle").select("node"), "node", "left_anti"), roots.limit(0), True, stride_doublings).select("node", "path")
    cyc = cyc.select("node", "root", F.lit(-1).cast("long").alias("depth"))
    if keep_paths:
        cyc = cyc.withColumn("path", F.array("node")) if hung is None else cyc.join(hung, "node", "left").withColumn("path", F.coalesce("path", F.array("node")))
    return reached.select(*cols).unionByName(cyc.select(*cols))


def cycle_roots(lost: DataFrame) -> DataFrame:
    """(node, root, on_cycle): the smallest member of the cycle each node leads to.

    ``lost`` has (node, parent) and is closed: each parent is a node of it.
    """
    n, state, k = lost.count(), lost.select("node", F.col("parent").alias("ptr"), F.col("node").alias("low")), 1
    while k < n:
        nxt = state.select(F.col("node").alias("t"), F.col("ptr").alias("tp"), F.col("low").alias("tl"))
        state = materialize(
            state.join(nxt, F.col("ptr") == F.col("t")).select("node", F.col("tp").alias("ptr"), F.least("low", "tl").alias("low")),
            "jump",
        )
        k *= 2
    goal = state.select(F.col("node").alias("g"), F.col("low").alias("root"))
    ring = state.select(F.col("ptr").alias("m")).distinct()
    return (
        state.join(goal, F.col("ptr") == F.col("g"))
        .join(ring, F.col("node") == F.col("m"), "left")
        .select("node", "root", F.col("m").isNotNull().alias("on_cycle"))
    )


def ancestor_pairs(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) out of the paths; nodes below cycles have pairs where they were resolved with ``below_cycles``."""
    return (
        resolved.where(F.size("path") > 1)
        .select(F.col("node").alias("descendant"), (F.size("path") - 1).alias("steps"), F.posexplode("path").alias("pos", "ancestor"))
        .where("pos < steps")
        .select("ancestor", "descendant", (F.col("steps") - F.col("pos")).cast("long").alias("distance"))
    )
