"""Further queries: typed claims, decisions, priorities, frontiers, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import entities as E
from ..operators import graph, stats
from ..operators import hierarchy as H
from ..session import table
from . import registry as R

query = R.query


@query(None)
def claim_values(spark, sf):
    """Typed main values of all statements."""
    return E.statements(table(spark, sf, "entity_store_jsonl"))


_CANDS = R._EDGE + """
, w AS (SELECT c AS node, p AS ancestor, 1 AS depth FROM e UNION SELECT w.node, e.p, w.depth + 1 FROM w JOIN e ON e.c = w.ancestor WHERE w.depth < 8),
m AS (SELECT node, ancestor AS core, min(depth) AS depth FROM w WHERE ancestor IN (SELECT class_id FROM core_classes) GROUP BY 1, 2)
"""


def _cands(spark, sf):
    core = table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("ancestor"))
    return graph.closure(R._edges(spark, sf), "c", "p", 8).join(core, "ancestor", "left_semi").select("node", F.col("ancestor").alias("core"), "depth")


@query(_CANDS + """
, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, core) AS k, count(*) OVER (PARTITION BY node) AS n, lead(depth) OVER (PARTITION BY node ORDER BY depth, core) AS nxt FROM m)
SELECT node, CASE WHEN n = 1 THEN 'single' WHEN nxt > depth THEN 'depth_advantage' ELSE 'precedence_tiebreak' END AS decision, core AS chosen, (nxt - depth)::BIGINT AS margin FROM r WHERE k = 1""")
def conflict_decision(spark, sf):
    return E.conflict_decision(_cands(spark, sf))


@query(_CANDS + "SELECT core, count(*) AS classes, count(*) FILTER (WHERE depth = 1) AS direct, min(depth)::BIGINT AS nearest, max(depth)::BIGINT AS farthest FROM m GROUP BY 1")
def class_rollups(spark, sf):
    return _cands(spark, sf).groupBy("core").agg(F.count("*").alias("classes"), F.count_if(F.col("depth") == 1).alias("direct"), F.min("depth").alias("nearest"), F.max("depth").alias("farthest"))


@query(R._EDGE + """
, o AS (SELECT c AS node, 0 AS i FROM e UNION ALL SELECT p, 1 FROM e), n AS (SELECT node, sum(i) AS n_in FROM o GROUP BY 1),
f AS (SELECT node, (CASE WHEN node IN (SELECT class_id FROM core_classes) THEN 100 ELSE 0 END + CASE WHEN node IN (SELECT c FROM e WHERE p IN (SELECT class_id FROM core_classes)) THEN 80 ELSE 0 END + CASE WHEN n_in = 0 THEN 10 ELSE 0 END)::BIGINT AS score FROM n)
SELECT node, score FROM f ORDER BY score DESC, node LIMIT 50""")
def neighbour_rank(spark, sf):
    e = R._edges(spark, sf)
    core = table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("node"), F.lit(True).alias("is_core"))
    near = e.join(core.select(F.col("node").alias("p")), "p", "left_semi").select(F.col("c").alias("node"), F.lit(True).alias("near")).distinct()
    a = graph.adjacency(e, "c", "p").join(core, "node", "left").join(near, "node", "left").withColumn("leaf", F.col("n_in") == 0)
    return E.rank_for_cap(a, "node", {"is_core": 100, "near": 80, "leaf": 10}, 50)


@query(R._TRIPLES + """
, s AS (SELECT guest FROM per WHERE birthplace LIKE 'Ober%')
SELECT object AS entity, CASE WHEN max(CASE WHEN predicate = 'appears_in' THEN 1 ELSE 0 END) = 1 THEN 'potentially_relevant' ELSE 'unlikely' END AS decision FROM t WHERE subject IN (SELECT guest FROM s) GROUP BY 1""")
def fetch_decision(spark, sf):
    seeds = R.persons(spark, sf).where("birthplace LIKE 'Ober%'").select(F.col("guest").alias("entity"))
    return E.fetch_decision(R._triples(spark, sf), seeds, ["appears_in"])


@query(_CANDS + """
, b AS (SELECT c AS x, p AS y FROM e UNION SELECT p, c FROM e), sd AS (SELECT class_id AS node FROM core_classes),
h AS (SELECT node, 0 AS hop FROM sd UNION SELECT b.y, h.hop + 1 FROM h JOIN b ON b.x = h.node WHERE h.hop < 3),
hm AS (SELECT node, min(hop) AS hop FROM h GROUP BY 1 HAVING min(hop) > 0), al AS (SELECT c AS node FROM e UNION SELECT p FROM e), cm AS (SELECT node, min(core) AS core FROM m GROUP BY 1)
SELECT al.node, CASE WHEN al.node IN (SELECT node FROM sd) THEN 'seed' WHEN hm.hop IS NULL THEN 'unreached' WHEN hm.hop > 2 THEN 'too_far' WHEN cm.core IS NOT NULL THEN 'core_match' ELSE 'no_core_match' END AS reason
FROM al LEFT JOIN hm USING (node) LEFT JOIN cm USING (node)""")
def eligibility(spark, sf):
    e = R._edges(spark, sf)
    seeds = table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("node"))
    nodes = e.select(F.col("c").alias("node")).union(e.select("p")).distinct()
    d = nodes.join(seeds.withColumn("seed", F.lit(True)), "node", "left").join(graph.hops(e, "c", "p", seeds, 3), "node", "left")
    d = d.join(_cands(spark, sf).groupBy("node").agg(F.min("core").alias("core")), "node", "left")
    return d.select("node", E.eligibility(F.lit(False), F.col("seed"), F.col("hop"), F.col("core")).alias("reason"))


@query(R._EDGE + """
, w AS (SELECT class_id AS page, 0 AS round FROM core_classes UNION SELECT e.c, w.round + 1 FROM w JOIN e ON e.p = w.page WHERE w.round < 6)
SELECT page, min(round)::BIGINT AS round FROM w GROUP BY 1""")
def crawl_frontier(spark, sf):
    """Classes reached downward from the core classes, as pages are over links."""
    links = R._edges(spark, sf).select(F.col("p").alias("page"), F.col("c").alias("target"))
    return E.crawl_frontier(links, table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("page")), 6)


@query("""
WITH d AS (SELECT class_id AS id FROM core_classes), l AS (SELECT DISTINCT 'Q' || regexp_extract(resolved_core_class_id, '[Qq]\\s*0*([0-9]+)', 1) AS id FROM class_resolution_map WHERE regexp_extract(coalesce(resolved_core_class_id, ''), '[Qq]\\s*0*([0-9]+)', 1) <> '')
SELECT id, id IN (SELECT id FROM l) AS accepted FROM d""")
def seed_filter(spark, sf):
    used = R._edges(spark, sf).select(F.col("p").alias("id"), F.lit(True).alias("u")).distinct()
    d = table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("id")).join(used, "id", "left")
    return d.select("id", F.coalesce("u", F.lit(False)).alias("accepted"))


@query(R._SQL + "SELECT episode, row_number() OVER (ORDER BY day NULLS LAST, episode) AS rank FROM pre")
def domain_order(spark, sf):
    p = R.premieres(spark, sf).withColumn("one", F.lit(1))
    return stats.running(p, [F.asc_nulls_last("day"), F.asc("episode")], "one").select("episode", "rank")


@query("""
WITH k AS (SELECT event_id, user_id::VARCHAR AS key, event_type FROM events UNION ALL SELECT event_id, 'k' || json_extract_string(props, '$.k'), event_type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)
SELECT key, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM k GROUP BY 1""")
def multi_key_latest(spark, sf):
    """Each event is the latest record of its own key and of the key in its payload."""
    from ..operators.events import latest_per_key

    e = table(spark, sf, "events")
    keys = F.filter(F.array(F.col("user_id").cast("string"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))), lambda x: x.isNotNull())
    return latest_per_key(e.select("event_id", "event_type", F.explode(keys).alias("key")), ["key"], "event_id", ["event_id", "event_type"])


@query("""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, doc_id, lang FROM d WHERE r <= 3""")
def top_examples(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", "lang", "n_chars")
    return stats.top_per_group(d, "source", [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", "lang")


@query("""
SELECT user_id, date_trunc('day', ts) AS day, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') * 100.0e0 / count(*), 2) AS error_pct FROM events GROUP BY 1, 2""")
def daily_ratios(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.withColumn("error_pct", stats.pct(F.col("errors"), F.col("calls")))
