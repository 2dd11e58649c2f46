"""Typed values of entity documents, decisions and priorities over a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nested as N


def statements(entities: DataFrame) -> DataFrame:
    """(id, pid, statement_no, rank, snaktype, kind, item, time, amount, text): main values of all statements, one typed column each."""
    paths = {
        "rank": "*[].rank", "snaktype": "*[].mainsnak.snaktype", "kind": "*[].mainsnak.datavalue.type", "item": "*[].mainsnak.datavalue.value.id",
        "time": "*[].mainsnak.datavalue.value.time", "amount": "*[].mainsnak.datavalue.value.amount", "mono": "*[].mainsnak.datavalue.value.text", "plain": "*[].mainsnak.datavalue.value",
    }
    import re

    only = "|".join(re.escape(p) for p in [*paths.values(), "*[].mainsnak"])
    tr = N.triples(N.latest(entities, "id", "discovered_at_utc", "claims"), "id", "claims", N.CLAIM_KEYS, N.CLAIM_LISTS, "claims", only)
    g = tr.groupBy("id", "ord").agg(*[F.max(F.when(F.col("path") == p, F.col("value"))).alias(k) for k, p in paths.items()])
    return g.select(
        "id", F.col("ord")[0].alias("pid"), F.col("ord")[1].cast("long").alias("statement_no"), "rank", "snaktype", "kind", "item", "time",
        F.expr("try_cast(amount AS double)").alias("amount"), F.coalesce("mono", "plain").alias("text"),
    )


def entity_triples(entities: DataFrame) -> DataFrame:
    """(subject, predicate, object, rank): claims whose value is an entity."""
    return statements(entities).where("item IS NOT NULL").select(F.col("id").alias("subject"), F.col("pid").alias("predicate"), F.col("item").alias("object"), "rank").distinct()


def conflict_decision(candidates: DataFrame, node: str = "node", core: str = "core", depth: str = "depth") -> DataFrame:
    """(node, decision, chosen, margin): single, depth advantage or precedence (the smallest id) among a node's core candidates."""
    g = candidates.groupBy(node).agg(F.array_sort(F.collect_set(F.struct(F.col(depth).alias("d"), F.col(core).alias("c")))).alias("s"))  # as many as core classes
    margin = F.when(F.size("s") > 1, F.get("s", F.lit(1)).d - F.col("s")[0].d)
    how = F.when(F.size("s") == 1, "single").when(margin > 0, "depth_advantage").otherwise("precedence_tiebreak")
    return g.select(node, how.alias("decision"), F.col("s")[0].c.alias("chosen"), margin.cast("long").alias("margin"))


def rank_for_cap(df: DataFrame, node: str, scores: dict[str, int], cap: int) -> DataFrame:
    """The ``cap`` nodes with the greatest sum of scores of the flags they have; ties by id."""
    total = sum((F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0) for c, v in scores.items()), F.lit(0))
    return df.select(node, total.cast("long").alias("score")).orderBy(F.desc("score"), node).limit(cap)


def fetch_decision(triples: DataFrame, relevant: DataFrame, predicates: list[str]) -> DataFrame:
    """(entity, decision): objects of relevant subjects are ``potentially_relevant`` under one of the predicates, else ``unlikely``; the better one holds."""
    t = triples.join(relevant.select(F.col("entity").alias("subject")).distinct(), "subject", "left_semi")
    good = F.max(F.col("predicate").isin(predicates).cast("int"))
    return t.groupBy(F.col("object").alias("entity")).agg(good.alias("g")).select("entity", F.when(F.col("g") == 1, "potentially_relevant").otherwise("unlikely").alias("decision"))


def eligibility(is_class: Column, is_seed: Column, hop: Column, core: Column, most_hops: int = 2) -> Column:
    """Why an entity is or is not expanded, by the first rule that applies."""
    return (
        F.when(F.coalesce(is_class, F.lit(False)), "class_node").when(F.coalesce(is_seed, F.lit(False)), "seed")
        .when(hop.isNull(), "unreached").when(hop > most_hops, "too_far").when(core.isNotNull(), "core_match").otherwise("no_core_match")
    )


def crawl_frontier(links: DataFrame, starts: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(page, round): pages reached over links from the starts, each in the first round that reaches it; all, or those of ``max_rounds``."""
    from ..session import materialize

    e = materialize(links.select(F.col("page").alias("p"), F.col("target").alias("t")).where("t IS NOT NULL").distinct(), "links")
    seen = materialize(starts.select("page").distinct().withColumn("round", F.lit(0).cast("long")), "starts")
    new, i = seen, 0
    while max_rounds is None or i < max_rounds:
        i += 1
        step = new.join(e, F.col("page") == F.col("p")).select(F.col("t").alias("page")).distinct().join(seen.select("page"), "page", "left_anti")
        new = materialize(step.withColumn("round", F.lit(i).cast("long")), "round")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def merge_languages(old: Column, new: Column) -> Column:
    """Two maps of languages; the newer text of a language wins, missing languages stay."""
    return F.map_from_entries(F.concat(F.map_entries(new), F.filter(F.map_entries(old), lambda x: ~F.map_contains_key(new, x.key))))
