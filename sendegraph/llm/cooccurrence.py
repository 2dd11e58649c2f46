"""Items that appear together, and how much more often than by chance.

Method: large-basket blocking. Ordinary baskets are paired whole; a basket of
more than ``chunk`` items is split into chunks by a hash of the item, and each
pair of chunks is a block of its own, so the pairs of one huge basket are spread
over many tasks of at most ``2 * chunk`` items. Block pairs and ordinary pairs
are counted together, with a partial count before the shuffle.

Exact pruning first: in a group with N baskets an item in n of them can only be
part of a qualifying pair if ``n >= min_count`` and ``min_ratio * n <= N`` (the
common baskets are at most those of the rarer item). That drops, without losing
a pair, both the long tail and the items that are nearly everywhere.

Defined results: null and empty groups, baskets or items are left out; repeated
rows count once; the smaller item stands first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def pair_counts(
    rows: DataFrame,
    group: str,
    basket: str,
    item: str,
    min_count: int = 4,
    min_ratio: float = 3.0,
    chunk: int = 256,
) -> DataFrame:
    """(group, item_a, item_b, n_ab, n_a, n_b, n_baskets, ratio) of qualifying pairs.

    ``ratio`` is n_ab * N / (n_a * n_b): 1 is chance.
    """
    facts = materialize(
        rows.select(F.col(group).alias("g"), F.col(basket).alias("b"), F.col(item).alias("i"))
        .where(F.col("g").isNotNull() & (F.col("g") != "") & F.col("b").isNotNull() & (F.col("b") != "") & F.col("i").isNotNull() & (F.col("i") != ""))
        .distinct(),
        "baskets",
    )
    totals = facts.select("g", "b").distinct().groupBy("g").agg(F.count("*").alias("n_all"))
    items = (
        facts.groupBy("g", "i").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_count)
        .join(totals, "g")
        .where(F.lit(min_ratio) * F.col("n") <= F.col("n_all"))
    )
    kept = materialize(facts.join(items, ["g", "i"]).select("g", "b", F.struct("i", "n").alias("x"), "n_all"), "kept")
    sizes = kept.groupBy("g", "b").agg(F.count("*").alias("size"))
    small = kept.join(sizes.where((F.col("size") > 1) & (F.col("size") <= chunk)), ["g", "b"])
    pairs = _array_pairs(small.groupBy("g", "b", "n_all").agg(F.collect_list("x").alias("xs")), "xs", "xs")
    large = sizes.where(F.col("size") > chunk).withColumn("m", F.ceil(F.col("size") / chunk).cast("int"))
    blocks = (
        kept.join(large, ["g", "b"])
        .withColumn("c", F.pmod(F.xxhash64("x.i"), F.col("m")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("g", "b", "n_all", "x", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "c")
    )
    grid = blocks.groupBy("g", "b", "n_all", "lo", "hi").agg(
        F.collect_list(F.when(F.col("c") == F.col("lo"), F.col("x"))).alias("left"),
        F.collect_list(F.when(F.col("c") == F.col("hi"), F.col("x"))).alias("right"),
    )
    inner = _array_pairs(grid.where("lo = hi"), "left", "left")
    outer = _array_pairs(grid.where("lo < hi"), "left", "right", ordered=False)
    counted = (
        pairs.unionByName(inner).unionByName(outer)
        .groupBy("g", "n_all", "a", "b2")
        .agg(F.count("*").alias("n_ab"))
        .where((F.col("n_ab") >= min_count) & (F.col("n_ab") * F.col("n_all") >= F.lit(min_ratio) * F.col("a.n") * F.col("b2.n")))
    )
    return counted.select(
        F.col("g").alias(group), F.col("a.i").alias("item_a"), F.col("b2.i").alias("item_b"), "n_ab",
        F.col("a.n").alias("n_a"), F.col("b2.n").alias("n_b"), F.col("n_all").alias("n_baskets"),
        (F.col("n_ab") * F.col("n_all") / (F.col("a.n") * F.col("b2.n"))).alias("ratio"),
    )


def _array_pairs(df: DataFrame, left: str, right: str, ordered: bool = True) -> DataFrame:
    """(g, n_all, a, b2): pairs of two arrays of items, the smaller item first."""
    out = df.select("g", "n_all", F.explode(left).alias("p"), F.col(right).alias("r"))
    if ordered:
        out = out.select("g", "n_all", "p", F.explode("r").alias("q")).where(F.col("p.i") < F.col("q.i"))
        return out.select("g", "n_all", F.col("p").alias("a"), F.col("q").alias("b2"))
    out = out.select("g", "n_all", "p", F.explode("r").alias("q"))
    first = F.col("p.i") < F.col("q.i")
    return out.select("g", "n_all", F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b2"))
