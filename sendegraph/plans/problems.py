"""Queries of the general problems 2, 3 and 6, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import nested as N
from ..operators import packed as P
from ..session import materialize, table

PACKED_FIELDS = ["occupations", "occupation_qids", "party", "party_qids"]


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "class_resolution_map")
    links = H.current_links(rows, H.q_number(F.col("class_id")), H.q_number(F.col("resolved_core_class_id")), F.col("resolved_at"))
    roots = table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("node"))
    return links, roots


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of each class."""
    return H.resolve(*_links(spark, sf), keep_paths=False).select(
        F.col("node").alias("class_id"), F.col("root").alias("root_class_id"), F.col("depth").alias("node_depth")
    )


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path of each class, from the root or the member of a cycle down, with the number of its descendants."""
    return _paths(H.resolve(*_links(spark, sf), below_cycles=True))


def _paths(resolved: DataFrame) -> DataFrame:
    res = materialize(resolved, "resolved")
    below = H.ancestor_pairs(res).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return res.join(below, "node", "left").select(
        F.col("node").alias("class_id"), F.concat_ws(">", "path").alias("class_path"), F.col("depth").alias("node_depth"),
        F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"),
    )


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of each class, with their distance, also below cycles."""
    return H.ancestor_pairs(H.resolve(*_links(spark, sf), below_cycles=True))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """All snaks of all claims."""
    return N.snaks(table(spark, sf, "entity_store_jsonl"))


def _claim_table(group: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return N.claim_tables(table(spark, sf, "entity_store_jsonl"))[group]

    return query


p3_statements = _claim_table("*[]")
p3_qualifiers = _claim_table("*[].qualifiers.*[]")
p3_references = _claim_table("*[].references[]")
p3_reference_snaks = _claim_table("*[].references[].snaks.*[]")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each value in the packed fields of persons."""
    return P.split_packed(table(spark, sf, "dedup_persons"), "canonical_entity_id", PACKED_FIELDS)


QUERIES = {
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    "p3_statements": p3_statements,
    "p3_qualifiers": p3_qualifiers,
    "p3_references": p3_references,
    "p3_reference_snaks": p3_reference_snaks,
    "p6_found": p6_found,
}

_WALK = """
WITH RECURSIVE l0 AS (
  SELECT 'Q' || regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) AS node,
         nullif('Q' || regexp_extract(coalesce(resolved_core_class_id, ''), '[Qq]\\s*0*([0-9]+)', 1), 'Q') AS parent,
         resolved_at
  FROM class_resolution_map),
l1 AS (SELECT node, parent, row_number() OVER (PARTITION BY node ORDER BY resolved_at DESC NULLS LAST, parent DESC NULLS LAST) AS rn FROM l0 WHERE node <> 'Q'),
links AS (
  SELECT node, CASE WHEN node IN (SELECT 'Q' || regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) FROM core_classes) THEN NULL ELSE parent END AS parent
  FROM l1 WHERE rn = 1),
walk AS (
  SELECT node AS start, node AS cur, [node] AS seen, 0 AS steps, false AS looped FROM links
  UNION ALL
  SELECT w.start, l.parent, list_append(w.seen, l.parent), w.steps + 1, list_contains(w.seen, l.parent)
  FROM walk w JOIN links l ON l.node = w.cur WHERE l.parent IS NOT NULL AND NOT w.looped),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY steps DESC) AS k FROM walk) WHERE k = 1)
"""

_SNAKS = r"""
WITH v AS (SELECT id, claims, row_number() OVER (PARTITION BY id ORDER BY discovered_at_utc DESC NULLS LAST, claims DESC NULLS LAST) AS k FROM entity_store_jsonl WHERE id <> ''),
a AS (SELECT id, CASE WHEN json_valid(claims) THEN claims::JSON END AS j FROM v WHERE k = 1),
b AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM a WHERE j IS NOT NULL),
c AS (SELECT id, CASE WHEN json_type(j) = 'OBJECT' AND json_keys(j) = ['claims'] THEN json_extract(j, '$.claims') ELSE j END AS j FROM b),
p AS (SELECT id, pid, json_extract(j, '$."' || pid || '"') AS x FROM (SELECT id, j, unnest(json_keys(j)) AS pid FROM c WHERE json_type(j) = 'OBJECT') WHERE regexp_full_match(pid, 'P[0-9]+')),
pl AS (SELECT id, pid, CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'OBJECT' THEN [x] ELSE [] END AS l FROM p),
s AS (SELECT id, pid, unnest(l) AS st, generate_subscripts(l, 1) - 1 AS sn FROM pl),
q AS (SELECT id, pid, sn, 'qualifier' AS section, 0 AS rn, json_extract(st, '$.qualifiers') AS m FROM s
      UNION ALL SELECT id, pid, sn, 'reference', generate_subscripts(l, 1) - 1, json_extract(unnest(l), '$.snaks') FROM (
        SELECT id, pid, sn, CASE json_type(json_extract(st, '$.references')) WHEN 'ARRAY' THEN json_extract(st, '$.references[*]') WHEN 'OBJECT' THEN [json_extract(st, '$.references')] ELSE [] END AS l FROM s)),
k AS (SELECT id, pid, sn, section, rn, kp, json_extract(m, '$."' || kp || '"') AS x FROM (SELECT *, unnest(json_keys(m)) AS kp FROM q WHERE json_type(m) = 'OBJECT') WHERE regexp_full_match(kp, 'P[0-9]+')),
z AS (SELECT id, pid, sn, section, rn, kp, CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'OBJECT' THEN [x] ELSE [] END AS l FROM k)
SELECT id AS entity_id, pid, sn::BIGINT AS statement_no, section AS snak_section, rn::BIGINT AS section_no, kp AS snak_pid, (generate_subscripts(l, 1) - 1)::BIGINT AS snak_no FROM z
UNION ALL SELECT id, pid, sn::BIGINT, 'mainsnak', 0::BIGINT, pid, 0::BIGINT FROM s WHERE json_type(json_extract(st, '$.mainsnak')) = 'OBJECT'"""

ORACLE = {
    "p3_found": _SNAKS,
    "claim_coverage": f"""SELECT pid, count(DISTINCT entity_id) AS entities, count(*) FILTER (WHERE snak_section = 'mainsnak') AS statements,
       count(*) FILTER (WHERE snak_section = 'qualifier') AS qualifiers, count(*) FILTER (WHERE snak_section = 'reference') AS "references" FROM ({_SNAKS}) GROUP BY 1""",
    "property_profile": f"""SELECT entity_id, count(DISTINCT pid) AS properties, count(*) AS statements FROM ({_SNAKS}) WHERE snak_section = 'mainsnak' GROUP BY 1""",
    "p2_found": _WALK
    + """
SELECT start AS class_id,
       CASE WHEN looped THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_class_id,
       CASE WHEN looped THEN -1 ELSE steps END::BIGINT AS node_depth
FROM ends""",
    "p2_paths": _WALK
    + """
, up AS (SELECT start, looped, steps, CASE WHEN looped THEN list_slice(seen, 1, list_position(seen, cur)) ELSE seen END AS way FROM ends),
n AS (SELECT ancestor, count(*) AS n FROM (SELECT unnest(list_slice(way, 2, len(way))) AS ancestor FROM up) GROUP BY 1)
SELECT start AS class_id, array_to_string(list_reverse(way), '>') AS class_path, CASE WHEN looped THEN -1 ELSE steps END::BIGINT AS node_depth,
       coalesce(n.n, 0)::BIGINT AS n_descendants
FROM up LEFT JOIN n ON n.ancestor = up.start""",
    "p2_descendants": _WALK
    + """
, up AS (SELECT start, CASE WHEN looped THEN list_slice(seen, 1, list_position(seen, cur)) ELSE seen END AS way FROM ends)
SELECT way[i.i + 1] AS ancestor, start AS descendant, i.i::BIGINT AS distance
FROM up, LATERAL (SELECT unnest(range(1, len(way))) AS i) i""",
}
