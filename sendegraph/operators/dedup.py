"""Duplicates, keepers, tiered clusters and merges with priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import name_key, stable_id


def exact_duplicates(df: DataFrame) -> DataFrame:
    """(n, groups): how many distinct rows occur n times."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order; Catalyst keeps one row per key and task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def keeper_split(df: DataFrame, key: list[str], id_: str, text: str) -> DataFrame:
    """Each row with its group's keeper (has a text, longest text, least id) and what becomes of it.

    ``duplicate`` if it says the same as the keeper or one of both says nothing,
    else ``kept``.
    """
    t = F.coalesce(F.trim(text), F.lit(""))
    rank = F.struct((t == "").alias("e"), (-F.length(t)).alias("l"), F.col(id_).alias("i"), t.alias("t"))
    best = df.groupBy(*key).agg(F.min(rank).alias("k"))
    kt, ki = F.col("k.t"), F.col("k.i")
    state = F.when(F.col(id_) == ki, "keeper").when((t == kt) | (t == "") | (kt == ""), "duplicate").otherwise("kept")
    return df.join(best, key).select(*key, id_, ki.alias("keeper_id"), state.alias("state"))


def tiered_clusters(df: DataFrame, id_: str, qid: str, label: str, manual: DataFrame | None = None) -> DataFrame:
    """(id, tier, cluster_key, cluster_id, is_representative): each row in one cluster, by the strongest key it has.

    Tiers: a manual key (manual has (id, manual_key)), a shared qid, a shared name
    key, single. A key shared by no other row of its tier falls to the next tier.
    """
    d = df.select(F.col(id_).alias("id"), F.when(F.trim(qid) != "", F.col(qid)).alias("q"), F.col(label).alias("label"))
    d = d.join(manual, "id", "left") if manual is not None else d.withColumn("manual_key", F.lit(None).cast("string"))
    d = d.withColumn("nk", F.when(name_key(F.col("label")) != "", name_key(F.col("label"))))
    many = lambda frame, k: frame.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias(f"n_{k}"))
    m = d.join(many(d.where("manual_key IS NULL"), "q"), "q", "left")
    by_q = F.col("manual_key").isNull() & (F.col("n_q") > 1)
    rest = m.where(F.col("manual_key").isNull() & ~F.coalesce(F.col("n_q") > 1, F.lit(False)))
    m = m.join(many(rest, "nk"), "nk", "left")
    by_n = F.col("manual_key").isNull() & ~F.coalesce(F.col("n_q") > 1, F.lit(False)) & (F.col("n_nk") > 1)
    tier = F.when(F.col("manual_key").isNotNull(), "authoritative").when(by_q, "high").when(by_n, "medium").otherwise("low")
    key = F.when(F.col("manual_key").isNotNull(), F.concat(F.lit("m:"), "manual_key")).when(by_q, F.concat(F.lit("q:"), "q")).when(by_n, F.concat(F.lit("n:"), "nk")).otherwise(F.concat(F.lit("s:"), "id"))
    m = m.select("id", "q", tier.alias("tier"), key.alias("cluster_key"))
    rep = m.groupBy("cluster_key").agg(F.min(F.struct(F.col("q").isNull().alias("n"), "id")).alias("r"), F.count("*").alias("cluster_size"))
    return m.join(rep, "cluster_key").select(
        "id", "tier", "cluster_key", "cluster_size", stable_id("ce", F.col("r.id")).alias("cluster_id"), (F.col("id") == F.col("r.id")).alias("is_representative")
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_by_priority(key: list[str], *frames: DataFrame) -> DataFrame:
    """Rows of the first frame win over those of the next with the same key."""
    tagged = union_all(*[f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)])
    values = [c for c in tagged.columns if c not in (*key, "_p")]
    return tagged.groupBy(*key).agg(F.min(F.struct("_p", *values)).alias("_s")).select(*key, *[F.col(f"_s.{c}") for c in values])


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of both frames has."""
    only = lambda x, y, s: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(s))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def status_rank(c: Column, ranks: dict[str, int], default: int = 0) -> Column:
    """The rank of an ordered category."""
    return F.coalesce(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[c], F.lit(default))


def best_status(df: DataFrame, key: list[str], rank: Column, time: str, keep: list[str]) -> DataFrame:
    """Of each key the row with the best status, among those the latest."""
    return df.groupBy(*key).agg(F.max(F.struct(rank.alias("r"), F.col(time).alias("t"), *keep)).alias("s")).select(*key, *[F.col(f"s.{c}") for c in keep])
