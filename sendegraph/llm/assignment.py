"""One-to-one assignment of the greatest total confidence, at every size.

Pairs fall into components. Those of up to ``per_task`` pairs are solved exactly,
each in one task, by shortest augmenting paths; larger ones by a distributed
auction whose prices bound the optimum from above, so its gap is known: it goes
on with smaller bids until the gap is at most ``gap`` of the total. How a component
is solved thus changes where the work is done and not what is asked for.

Defined results: an end without pairs has no row; of assignments of the same
total any one is taken, the same in each run; pairs of no confidence are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import materialize

SCHEMA = "a string, b string, side string, confidence double"


def best_matching(weight: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """The pairs of the one-to-one assignment with the greatest total weight; ends may stay alone.

    Each left end enters in turn and takes the shortest augmenting path in
    reduced costs; a path ends at a free right end, or with a left end that stays
    alone.
    """
    near: dict[str, list[tuple[str, float]]] = {}
    for (a, b), w in sorted(weight.items()):
        near.setdefault(a, []).append((b, -w))
    price: dict[str, float] = {}
    owner: dict[str, str] = {}
    taken: dict[str, str] = {}
    cost = {(a, b): -w for (a, b), w in weight.items()}
    for start in sorted(near):
        far = {start: 0.0}  # distance of left ends
        dist: dict[str, float] = {}
        came: dict[str, str] = {}
        done: dict[str, float] = {}
        heap: list[tuple[float, str]] = []
        alone, leaver, row, end = float("inf"), start, start, None
        while True:
            base = far[row] - (cost[row, taken[row]] - price.get(taken[row], 0.0) if row in taken else 0.0)
            if base < alone:
                alone, leaver = base, row
            for b, c in near[row]:
                d = base + c - price.get(b, 0.0)
                if b not in done and d < dist.get(b, float("inf")):
                    dist[b], came[b] = d, row
                    heapq.heappush(heap, (d, b))
            while heap and (heap[0][1] in done or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                goal = alone
                break
            d, b = heapq.heappop(heap)
            if b not in owner:
                goal, end = d, b
                break
            done[b] = d
            row = owner[b]
            far[row] = d
        for b, d in done.items():
            price[b] = price.get(b, 0.0) + d - goal
        if end is None and leaver != start:
            end = taken.pop(leaver)
        while end is not None:
            row = came[end]
            former = taken.get(row)
            owner[end], taken[row] = row, end
            end = former if row != start else None
    return {(a, b) for a, b in taken.items()}


def auction(pairs: DataFrame, gap: float = 1e-3) -> DataFrame:
    """The same over the cluster: (a, b, side, confidence), within ``gap`` of the greatest total.

    Every end bids for partners and for staying alone, on a graph in which each
    pair stands once in either direction, so that all ends can be served and
    prices may be kept while bids get smaller. Each round the ends without a
    partner bid for their best offer what makes it as good as their second best;
    the highest bid holds. Prices bound the optimum at any time: half the sum of
    all prices and best remaining profits. Nothing is collected but sums.
    """
    end = lambda k: F.concat_ws("\u0001", F.lit(k), "side", k)
    base = materialize(pairs.select("a", "b", "side", "confidence", end("a").alias("ea"), end("b").alias("eb")), "offers")
    ends = base.select(F.col("ea").alias("who")).union(base.select("eb")).distinct()
    none = F.lit(0.0)
    offers = base.select(F.col("ea").alias("who"), F.col("eb").alias("goal"), F.col("confidence").alias("w"))
    offers = offers.unionByName(base.select(F.col("eb").alias("who"), F.col("ea").alias("goal"), F.col("confidence").alias("w"))).unionByName(ends.select("who", F.col("who").alias("goal"), none.alias("w")))
    offers = materialize(offers, "offers")
    nobody = F.lit(None).cast("string")
    held = materialize(ends.select(F.col("who").alias("goal"), none.alias("price"), nobody.alias("holder")), "held")
    step = base.agg(F.max("confidence")).first()[0] or 0.0
    while step:
        step /= 4
        held = held.withColumn("holder", nobody)
        while True:
            free = ends.join(held.select(F.col("holder").alias("who")).where("who IS NOT NULL"), "who", "left_anti")
            profit = offers.join(free, "who").join(held.select("goal", "price"), "goal").select("who", "goal", "price", (F.col("w") - F.col("price")).alias("v"))
            top = profit.groupBy("who").agg(F.max(F.struct("v", "goal", "price")).alias("t"))
            # the second best: the best among all offers but the one just named
            second = profit.join(top.select("who", F.col("t.goal").alias("first")), "who").where("goal <> first").groupBy("who").agg(F.max("v").alias("v2"))
            bids = top.join(second, "who").select(F.col("t.goal").alias("goal"), (F.col("t.price") + F.col("t.v") - F.col("v2") + step).alias("bid"), "who")
            bids = materialize(bids.groupBy("goal").agg(F.max(F.struct("bid", "who")).alias("s")).select("goal", "s.bid", "s.who"), "bids")
            if bids.isEmpty():
                break
            held = materialize(held.join(bids, "goal", "left").select("goal", F.coalesce("bid", "price").alias("price"), F.coalesce("who", "holder").alias("holder")), "held")
        best = offers.join(held.select("goal", "price"), "goal").groupBy("who").agg(F.max(F.col("w") - F.col("price")).alias("v"))
        bound = ((best.agg(F.sum("v")).first()[0] or 0.0) + (held.agg(F.sum("price")).first()[0] or 0.0)) / 2
        ways = []
        for mine, other in (("ea", "eb"), ("eb", "ea")):
            got = base.join(held.select(F.col("goal").alias(other), F.col("holder").alias(mine)), [other, mine]).select("a", "b", "side", "confidence")
            ways.append((got.agg(F.coalesce(F.sum("confidence"), none)).first()[0], got))
        total, got = max(ways, key=lambda x: x[0])
        if bound - total <= gap * total or step < 1e-9:
            return got
    return pairs.select("a", "b", "side", "confidence").limit(0)


def assign(pairs: DataFrame, per_task: int = 20_000, gap: float = 1e-3) -> DataFrame:
    """(a, b, side, confidence): in each ``side`` the one-to-one choice among the pairs with the greatest total confidence."""
    pairs = materialize(pairs.select("a", "b", "side", "confidence").where("confidence > 0"), "scored")
    da = pairs.groupBy("side", "a").agg(F.count("*").alias("na"))
    db = pairs.groupBy("side", "b").agg(F.count("*").alias("nb"))
    deg = materialize(pairs.join(da, ["side", "a"]).join(db, ["side", "b"]), "degrees")
    lone = deg.where("na = 1 AND nb = 1").select("a", "b", "side", "confidence")
    rest = deg.where("na > 1 OR nb > 1").select("a", "b", "side", "confidence")
    end = lambda c: F.concat_ws("\u0001", "side", F.lit(c), c)
    comp = connected_components(rest.select(end("a").alias("x"), end("b").alias("y")), "x", "y")
    rest = materialize(rest.withColumn("x", end("a")).join(comp, F.col("x") == F.col("node")).select("a", "b", "side", "confidence", "component"), "tangled")
    size = rest.groupBy("component").agg(F.count("*").alias("size"))
    rest = rest.join(size, "component")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        best = best_matching({(r.a, r.b): r.confidence for r in pdf.itertuples()})
        return pdf.loc[[(r.a, r.b) in best for r in pdf.itertuples()], ["a", "b", "side", "confidence"]]

    exact = rest.where(F.col("size") <= per_task).groupBy("component").applyInPandas(solve, SCHEMA)
    out = lone.unionByName(exact)
    huge = materialize(rest.where(F.col("size") > per_task).select("a", "b", "side", "confidence"), "huge")
    return out if huge.isEmpty() else out.unionByName(auction(huge, gap))
