"""Alignment of sources by keys, labels and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import ordinal


def unique_index(df: DataFrame, label: str, id_: str) -> DataFrame:
    """(label, id): labels that exactly one id has."""
    g = df.where(F.col(label).isNotNull() & (F.trim(label) != "")).groupBy(label).agg(F.count_distinct(id_).alias("n"), F.min(id_).alias("id"))
    return g.where("n = 1").select(F.col(label).alias("label"), "id")


def cascade(left: DataFrame, right: DataFrame, tiers: list[tuple[str, str, float]], lid: str = "lid", rid: str = "rid") -> DataFrame:
    """(lid, rid, tier, confidence): each left row takes the first tier that matches; rows of both sides without a match stay.

    A tier is (column, name, confidence); both frames have the column. Several
    right rows with the key: the least id; a right row may serve many left ones.
    """
    best, used = left.select(lid).withColumn("_s", F.lit(None).cast(f"struct<p:int,r:{dict(right.dtypes)[rid]}>")), None
    for i, (col, _, _) in enumerate(tiers):
        idx = right.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(rid).alias("_r"))
        hit = left.where(F.col(col).isNotNull()).join(idx, col).select(lid, F.struct(F.lit(i).alias("p"), F.col("_r").alias("r")).alias("_s"))
        used = hit if used is None else used.unionByName(hit)
    best = best.unionByName(used).groupBy(lid).agg(F.min("_s").alias("_s"))
    name = F.when(F.col("_s").isNull(), F.lit("unresolved"))
    conf = F.when(F.col("_s").isNull(), F.lit(0.0))
    for i, (_, n, c) in enumerate(tiers):
        name, conf = name.when(F.col("_s.p") == i, F.lit(n)), conf.when(F.col("_s.p") == i, F.lit(c))
    out = best.select(lid, F.col("_s.r").alias(rid), name.alias("tier"), conf.alias("confidence"))
    rest = right.select(rid).distinct().join(out.select(rid), rid, "left_anti")
    return out.unionByName(rest.select(F.lit(None).cast(dict(left.dtypes)[lid]).alias(lid), rid, F.lit("unresolved").alias("tier"), F.lit(0.0).alias("confidence")))


def one_to_one(left: DataFrame, right: DataFrame, label: str, lid: str, rid: str) -> DataFrame:
    """(lid, rid): the n-th left row of a label takes the n-th right row of it."""
    nth = lambda df, i: ordinal(df.where(F.col(label).isNotNull()).select(label, i), [label], [i], "_n")
    return nth(left, lid).join(nth(right, rid), [label, "_n"]).select(lid, rid)


def signature_join(mentions: DataFrame, candidates: DataFrame, scope: Column | None = None) -> DataFrame:
    """(mention, candidate): mentions whose signature is that of one of a candidate's labels, within the scope.

    mentions: (mention, signature, ...); candidates: (candidate, signatures, ...).
    """
    c = candidates.withColumn("signature", F.explode(F.array_distinct("signatures")))
    j = mentions.join(c, "signature")
    return (j.where(scope) if scope is not None else j).select("mention", "candidate").distinct()


def ranked_prefix(queries: DataFrame, labels: DataFrame, query: str = "query", label: str = "label", id_: str = "id") -> DataFrame:
    """(query, id, match): exact labels, and only where there is none those that begin with the query.

    The prefixes of the labels, at the lengths the queries have, are joined by
    equality; nothing is compared pair by pair.
    """
    lengths = queries.select(F.length(query).alias("_l")).distinct()
    p = labels.crossJoin(F.broadcast(lengths)).where(F.length(label) >= F.col("_l"))  # the lengths of labels are few
    p = p.select(F.expr(f"left({label}, _l)").alias(query), F.col(id_), (F.length(label) == F.col("_l")).alias("exact"))
    hit = queries.select(query).distinct().join(p, query)
    any_exact = hit.groupBy(query).agg(F.max("exact").alias("_e"))
    return hit.join(any_exact, query).where(F.col("exact") == F.col("_e")).select(query, id_, F.when(F.col("exact"), "exact").otherwise("prefix").alias("match")).distinct()


def stage_merge(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the first stage, and of the second those whose key the first has not."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))
