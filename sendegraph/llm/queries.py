"""Queries of problems 1, 4, 5, 7, 8 and 9, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import url_path
from ..session import table
from . import contamination, cooccurrence, matching, packing, subjects, variants


def _appearances(spark: SparkSession, sf: str) -> DataFrame:
    path = url_path(F.col("fernsehserien_de_id"))
    return table(spark, sf, "episode_appearances").select(
        F.split(path, "/")[0].alias("programme_id"), path.alias("episode"), F.col("canonical_entity_id").alias("entity")
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of persons with at least 4 common episodes of a programme, 3 times as many as by chance."""
    return cooccurrence.pair_counts(_appearances(spark, sf), "programme_id", "episode", "entity").select(
        "programme_id", F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b")
    )


def p4_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs with their counts and their ratio to chance."""
    out = cooccurrence.pair_counts(_appearances(spark, sf), "programme_id", "episode", "entity")
    return out.withColumn("ratio", F.round("ratio", 6))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Units of different sources that mean the same person or organisation."""
    return p1_matches(spark, sf).select("unit_a", "unit_b")


def p1_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs with their confidence."""
    return matching.match_units(table(spark, sf, "aligned"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of one person's name, and of one function."""
    persons = variants.person_links(
        table(spark, sf, "dedup_persons"), "canonical_entity_id", "canonical_label", variants.year_of(F.col("birthyear")), F.col("birthplace")
    )
    roles = variants.role_links(table(spark, sf, "episode_guests_normalized"), "guest_role")
    named = lambda df, f: df.select(F.lit(f).alias("field_name"), "key_a", "key_b")
    return named(persons, "canonical_label").unionByName(named(roles, "guest_role"))


def p5_persons(spark: SparkSession, sf: str) -> DataFrame:
    """Each row of dedup_persons with the class of its person and the number of rows linked with it."""
    return variants.person_classes(
        table(spark, sf, "dedup_persons"), "canonical_entity_id", "canonical_label", variants.year_of(F.col("birthyear")), F.col("birthplace")
    ).withColumnRenamed("key", "canonical_entity_id")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct guest_role with the class of function, kind, theme and town it belongs to."""
    return variants.role_classes(table(spark, sf, "episode_guests_normalized"), "guest_role")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that repeat a stretch of an evaluation item."""
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items that stand in a document wholly or nearly so, with their containment."""
    return contamination.contained(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


CAPACITY = 2048


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Each container with its documents, pieces and tokens."""
    items = packing.pieces(table(spark, sf, "documents"), "doc_id", "text", CAPACITY)
    return packing.pack(items, CAPACITY).groupBy("container").agg(
        F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "doc_id", "piece"))), " ").alias("pieces")
    )


def p7_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used and proved necessary, unused share, texts split and texts that had to be."""
    items = packing.pieces(table(spark, sf, "documents"), "doc_id", "text", CAPACITY)
    packed = packing.pack(items, CAPACITY)
    used = packed.agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count_distinct(F.when(F.col("piece") > 0, F.col("doc_id"))).alias("split_texts"))
    return used.crossJoin(packing.proof(packed, CAPACITY)).select(
        "containers", "least_containers", "split_texts", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("unused_share")
    )


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """The subject areas of each document."""
    return subjects.document_subjects(table(spark, sf, "documents"), table(spark, sf, "doc_labels")).select("doc_id", "subject_code")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each subject area: the composition of the corpus."""
    return p9_found(spark, sf).groupBy("subject_code").agg(F.count("*").alias("n_documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_persons": p5_persons,
    "p7_containers": p7_containers,
    "p7_summary": p7_summary,
    "p8_found": p8_found,
    "p8_contained": p8_contained,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_P4 = """
WITH a AS (
  SELECT trim(regexp_replace(regexp_replace(lower(trim(fernsehserien_de_id)), '[?#].*$', ''), '^([a-z][a-z0-9+.-]*:)?//[^/]*', ''), '/') AS episode,
         canonical_entity_id AS entity FROM episode_appearances),
f AS (SELECT DISTINCT split_part(episode, '/', 1) AS programme_id, episode, entity FROM a WHERE episode <> '' AND entity <> ''),
n AS (SELECT programme_id, count(DISTINCT episode) AS n_all FROM f GROUP BY 1),
i AS (SELECT programme_id, entity, count(*) AS n FROM f GROUP BY 1, 2),
p AS (
  SELECT x.programme_id, x.entity AS a, y.entity AS b, count(*) AS n_ab
  FROM f x JOIN f y ON x.programme_id = y.programme_id AND x.episode = y.episode AND x.entity < y.entity
  GROUP BY 1, 2, 3 HAVING count(*) >= 4),
r AS (
  SELECT p.programme_id, p.a, p.b, p.n_ab, ia.n AS n_a, ib.n AS n_b, n.n_all
  FROM p JOIN n USING (programme_id)
  JOIN i ia ON ia.programme_id = p.programme_id AND ia.entity = p.a
  JOIN i ib ON ib.programme_id = p.programme_id AND ib.entity = p.b
  WHERE p.n_ab * n.n_all >= 3 * ia.n * ib.n)
"""

ORACLE = {
    "p4_found": _P4 + "SELECT programme_id, a AS entity_a, b AS entity_b FROM r",
    "p4_pairs": _P4
    + """SELECT programme_id, a AS item_a, b AS item_b, n_ab, n_a, n_b, n_all AS n_baskets,
       round(n_ab * n_all / (n_a * n_b)::DOUBLE, 6) AS ratio FROM r""",
}
