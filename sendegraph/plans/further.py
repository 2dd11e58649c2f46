"""Queries of class hierarchies, event logs, claims, texts and small rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import episodes as P
from ..functions import mentions as M
from ..operators import classes as K
from ..operators import entities as E
from ..operators import eventlog as L
from ..operators import events, graph, reshape, stats
from ..operators import hierarchy as H
from ..operators import nested as N
from ..session import materialize, table
from . import registry as R
from .more import _CANDS, _cands
from .problems import _SNAKS

query = R.query

# ---------------------------------------------------------------- class hierarchies

_CORES = "(SELECT class_id FROM core_classes)"
_LEVELS = R._EDGE + f"""
, b AS (SELECT class_id AS node, 0 AS d FROM core_classes UNION SELECT e.c, b.d + 1 FROM b JOIN e ON e.p = b.node WHERE b.d < 8), m AS (SELECT node, min(d) AS d FROM b GROUP BY 1),
f AS (SELECT e.c AS node, min(e.p) AS via FROM e JOIN m x ON x.node = e.c JOIN m y ON y.node = e.p WHERE y.d = x.d - 1 GROUP BY 1),
w AS (SELECT node, via, 1 AS k, node || '|' || via AS path FROM f UNION ALL SELECT w.node, f.via, k + 1, path || '|' || f.via FROM w JOIN f ON f.node = w.via),
o AS (SELECT node, via AS core, k::BIGINT AS depth, path FROM w WHERE via IN {_CORES})
"""


def _cores(spark, sf):
    return table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("node"))


def _by_order(spark, sf):
    return K.core_by_order(R._edges(spark, sf), _cores(spark, sf), "p")


@query(_LEVELS + "SELECT node, core, depth FROM o")
def core_by_parent_order(spark, sf):
    """The core of each class by its first parent that has one."""
    return _by_order(spark, sf).select("node", "core", "depth")


_REASON = "array_position(['unique_candidate', 'deterministic_conflict_resolution'], resolution_reason)"


@query(R._EDGE.split("e AS (")[0] + f"""a AS (
  SELECT 'Q' || regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) AS c, 'Q' || regexp_extract(resolved_core_class_id, '[Qq]\\s*0*([0-9]+)', 1) AS p, list_position(['unique_candidate', 'deterministic_conflict_resolution'], resolution_reason) AS r
  FROM class_resolution_map WHERE regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) <> '' AND regexp_extract(coalesce(resolved_core_class_id, ''), '[Qq]\\s*0*([0-9]+)', 1) <> ''),
e AS (SELECT DISTINCT c, p FROM (SELECT *, min(r) OVER (PARTITION BY c) AS best FROM a WHERE r > 0) WHERE r = best)
""" + _LEVELS[len(R._EDGE):] + "SELECT node, core, path FROM o")
def class_paths_by_policy(spark, sf):
    """Path of each class to its core, over the links of the first source of the policy that has any for a class."""
    d = table(spark, sf, "class_resolution_map").select(H.q_number(F.col("class_id")).alias("c"), H.q_number(F.col("resolved_core_class_id")).alias("p"), "resolution_reason").where("c IS NOT NULL AND p IS NOT NULL")
    return K.core_by_order(K.by_policy(d, "resolution_reason", ["unique_candidate", "deterministic_conflict_resolution"]), _cores(spark, sf), "p").select("node", "core", "path")


@query(_LEVELS + "SELECT core, node, CASE WHEN node IN (SELECT p FROM e) THEN 'subclass' ELSE 'instance' END AS kind FROM o")
def class_membership(spark, sf):
    return K.membership(_by_order(spark, sf), R._edges(spark, sf))


@query(_LEVELS + """
, n AS (SELECT p AS node, count(*) AS n FROM e GROUP BY 1), x AS (SELECT o.core, o.node, coalesce(n.n, 0) AS n FROM o LEFT JOIN n USING (node)),
i AS (SELECT a.core, count(*) AS k FROM e JOIN o a ON a.node = e.c JOIN o b ON b.node = e.p AND b.core = a.core GROUP BY 1)
SELECT core, count(*) AS nodes, max(n)::BIGINT AS max_weight, median(n)::DOUBLE AS median_weight, sum(n)::BIGINT AS sum_weight, coalesce(max(i.k), 0)::BIGINT AS internal_edges FROM x LEFT JOIN i USING (core) GROUP BY 1""")
def pool_stats(spark, sf):
    e = R._edges(spark, sf)
    return K.pool_stats(_by_order(spark, sf), e, e.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("n")))


@query(R._EDGE + f", n AS (SELECT c AS node FROM e UNION SELECT p FROM e) SELECT node, (node IN (SELECT c FROM e WHERE p IN {_CORES}) OR node IN (SELECT p FROM e WHERE c IN {_CORES})) AS linked FROM n")
def direct_seed_links(spark, sf):
    e = R._edges(spark, sf)
    return K.direct_links(e.select(F.col("c").alias("node")).union(e.select("p")), e, _cores(spark, sf))


_HOPS = """, u AS (SELECT c AS x, p AS y FROM e UNION SELECT p, c FROM e), sd AS (SELECT class_id AS node FROM core_classes),
h AS (SELECT node, 0 AS hop FROM sd UNION SELECT u.y, h.hop + 1 FROM h JOIN u ON u.x = h.node WHERE h.hop < 3), hm AS (SELECT node, min(hop) AS hop FROM h GROUP BY 1 HAVING min(hop) > 0),
al AS (SELECT c AS node FROM e UNION SELECT p FROM e)
"""


@query(_LEVELS + _HOPS + """
, rl AS (SELECT p AS node FROM e GROUP BY 1 HAVING count(*) >= 20)
SELECT al.node, (NOT al.node IN (SELECT node FROM rl WHERE node LIKE '%7') AND (al.node IN (SELECT node FROM rl) OR al.node IN (SELECT node FROM sd) OR (al.node IN (SELECT node FROM o) AND coalesce(hm.hop BETWEEN 1 AND 2, false)))) AS expandable FROM al LEFT JOIN hm USING (node)""")
def expandable_targets(spark, sf):
    """Expandable classes; those with many children are relevant, and some of these count as class nodes."""
    e, seeds = R._edges(spark, sf), _cores(spark, sf)
    flag = lambda df, n: df.select("node").distinct().withColumn(n, F.lit(True))
    many = e.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("k")).where("k >= 20")
    d = e.select(F.col("c").alias("node")).union(e.select("p")).distinct().join(graph.hops(e, "c", "p", seeds, 3), "node", "left")
    for df, n in ((many, "rel"), (seeds, "seed"), (_by_order(spark, sf), "match"), (many.where("node LIKE '%7'"), "cls")):
        d = d.join(flag(df, n), "node", "left")
    return d.select("node", K.expandable(F.col("cls"), F.col("rel"), F.col("seed"), F.col("match"), F.col("hop")).alias("expandable"))


@query(_LEVELS + _HOPS + ", rl AS (SELECT p AS node FROM e GROUP BY 1 HAVING count(*) >= 20) SELECT node FROM al WHERE node IN (SELECT node FROM sd) OR node IN (SELECT node FROM hm WHERE hop <= 2) OR node IN (SELECT node FROM rl)")
def output_boundary(spark, sf):
    e = R._edges(spark, sf)
    return K.boundary(e.select(F.col("c").alias("node")).union(e.select("p")), e, _cores(spark, sf), e.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("k")).where("k >= 20"))


@query(_LEVELS + f"""
SELECT node FROM (SELECT c AS node FROM e UNION SELECT p FROM e) WHERE (node IN (SELECT 'Q' || regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) FROM class_resolution_map WHERE conflict_flag) OR node IN (SELECT p FROM e)) AND (node IN (SELECT node FROM o) OR node IN {_CORES})""")
def active_classes(spark, sf):
    e, core_of = R._edges(spark, sf), _by_order(spark, sf).select("node").union(_cores(spark, sf))
    runtime = table(spark, sf, "class_resolution_map").where("conflict_flag").select(H.q_number(F.col("class_id")).alias("node"))
    return K.active_classes(e.select(F.col("c").alias("node")).union(e.select("p")), runtime, e.select(F.col("p").alias("node")), core_of)


@query(_LEVELS + f"""
, x AS (SELECT c AS node FROM e UNION SELECT p FROM e), r AS (SELECT c AS node, min(p) AS core FROM e WHERE p IN {_CORES} GROUP BY 1), v AS (SELECT p AS node FROM e GROUP BY 1 HAVING count(*) >= 20),
d AS (SELECT x.node, coalesce(r.core, o.core) AS core FROM x LEFT JOIN r USING (node) LEFT JOIN o USING (node) WHERE x.node NOT IN {_CORES}),
y AS (SELECT node, CASE WHEN NOT (node LIKE '%9' AND coalesce(core, '') = (SELECT min(class_id) FROM core_classes)) THEN core END AS core FROM d)
SELECT node, core, CASE WHEN core IS NULL THEN 'no_core' WHEN node IN (SELECT node FROM v) THEN 'relevant' ELSE 'not_relevant' END AS part FROM y""")
def core_instances(spark, sf):
    """Instances by core: resolved directly, else by path; a rule takes some out of the first core."""
    e, cores = R._edges(spark, sf), _cores(spark, sf)
    nodes = e.select(F.col("c").alias("node")).union(e.select("p")).distinct()
    direct = e.join(cores.withColumnRenamed("node", "p"), "p", "left_semi").select(F.col("c").alias("node"), F.col("p").alias("core"))
    first = cores.agg(F.min("node").alias("core"))
    out = nodes.where("node LIKE '%9'").crossJoin(F.broadcast(first))  # one row
    many = e.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("k")).where("k >= 20")
    return K.split_instances(nodes, cores, direct, _by_order(spark, sf), many, direct.limit(0), out)


@query("""
WITH d AS (SELECT DISTINCT class_id, resolved_core_class_id AS parents, candidate_core_class_ids AS path FROM class_resolution_map),
x AS (SELECT CASE WHEN NOT regexp_matches(coalesce(upper(class_id), ''), 'Q[0-9]+') THEN 'missing_id' WHEN trim(coalesce(parents, '')) = '' AND trim(coalesce(path, '')) = '' THEN 'no_signal'
  WHEN trim(coalesce(parents, '')) <> '' AND NOT regexp_matches(parents, '^\\s*Q[0-9]+\\s*(\\|\\s*Q[0-9]+\\s*)*$') THEN 'malformed_parents'
  WHEN trim(coalesce(path, '')) <> '' AND NOT regexp_matches(path, '^\\s*Q[0-9]+\\s*(\\|\\s*Q[0-9]+\\s*)*$') THEN 'malformed_path' ELSE 'ok' END AS diagnosis FROM d)
SELECT diagnosis, count(*) AS n FROM x GROUP BY 1""")
def lineage_diagnosis(spark, sf):
    d = table(spark, sf, "class_resolution_map").select("class_id", "resolved_core_class_id", "candidate_core_class_ids").distinct()
    return d.groupBy(K.lineage_diagnosis(F.col("class_id"), F.col("resolved_core_class_id"), F.col("candidate_core_class_ids")).alias("diagnosis")).agg(F.count("*").alias("n"))


@query(R._EDGE + f", x AS (SELECT p AS seed, c AS id, row_number() OVER (PARTITION BY p ORDER BY c) AS r, count(*) OVER (PARTITION BY p) AS n FROM e WHERE c > 'Q8003') SELECT seed, least(max(n), 25)::BIGINT AS n_new, max(CASE WHEN r <= 25 THEN id END) AS last, CASE WHEN max(n) > 25 THEN 'per_seed_cap' ELSE 'exhausted' END AS stop_reason FROM x GROUP BY 1")
def seed_expansion_page(spark, sf):
    """The next 25 incoming links of each class after a cursor, and why the page ends."""
    links = R._edges(spark, sf).select(F.col("p").alias("seed"), F.col("c").alias("id"))
    seeds = links.select("seed").distinct()
    return K.expand_seeds(seeds, links, 25, seeds.withColumn("after", F.lit("Q8003")))


@query(_LEVELS + f", x AS (SELECT node FROM o WHERE depth <= 2 AND node NOT IN {_CORES}) SELECT node, row_number() OVER (ORDER BY node) AS position FROM x")
def fallback_reentry(spark, sf):
    """Eligible ids that are no seeds yet, sorted, as the next seeds."""
    d = _by_order(spark, sf).where("depth <= 2").select("node").join(_cores(spark, sf), "node", "left_anti").withColumn("one", F.lit(1))
    return stats.running(d, [F.asc("node")], "one").select("node", F.col("rank").alias("position"))


@query(_CANDS + """
, n AS (SELECT node, arg_min(core, lpad(depth::VARCHAR, 3, '0') || core) AS core FROM m GROUP BY 1),
s AS (SELECT 'Q' || regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) AS node, max({'t': resolved_at, 'c': candidate_core_class_ids}).c AS stored FROM class_resolution_map WHERE regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) <> '' AND resolved_at IS NOT NULL GROUP BY 1)
SELECT node, stored, n.core AS repaired FROM n JOIN s USING (node) WHERE stored IS DISTINCT FROM n.core""")
def core_repair(spark, sf):
    """Stored cores that a replay of all links contradicts."""
    now = _cands(spark, sf).groupBy("node").agg(F.min(F.struct("depth", "core")).alias("s")).select("node", F.col("s.core").alias("repaired"))
    d = table(spark, sf, "class_resolution_map").where("resolved_at IS NOT NULL").select(H.q_number(F.col("class_id")).alias("node"), "resolved_at", F.col("candidate_core_class_ids").alias("c")).where("node IS NOT NULL")
    d = d.groupBy("node").agg(F.max(F.struct("resolved_at", "c")).alias("s")).select("node", F.col("s.c").alias("stored"))
    return now.join(d, "node").where(~F.col("stored").eqNullSafe(F.col("repaired"))).select("node", "stored", "repaired")


@query(_CANDS + f"SELECT node, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'subclass' END AS match FROM m GROUP BY 1")
def core_match(spark, sf):
    return _cands(spark, sf).groupBy("node").agg(F.when(F.min("depth") == 1, "direct").otherwise("subclass").alias("match"))


@query(R._SQL + "SELECT split_part(programme, '-', 1) AS mid, count(DISTINCT guest) AS persons FROM gu GROUP BY 1")
def mid_level(spark, sf):
    """Persons by kind of programme, each once."""
    g = R.guests(spark, sf)
    return K.mid_level(g, "guest", "programme", g.select(F.col("programme").alias("value"), F.split("programme", "-")[0].alias("mid")).distinct())


# ---------------------------------------------------------------- claims

_ST = _SNAKS.split("q AS (SELECT")[0].rstrip().rstrip(",")
_MAIN = _ST + """,
t AS (SELECT id, pid, sn::BIGINT AS statement_no, json_extract_string(st, '$.rank') AS rank, json_extract(st, '$.mainsnak') AS ms, json_extract(st, '$.qualifiers') AS q FROM s),
u AS (SELECT *, json_extract(ms, '$.datavalue.value') AS v FROM t WHERE json_type(ms) = 'OBJECT')
"""


@query(_MAIN + "SELECT DISTINCT id AS subject, pid AS predicate, json_extract_string(v, '$.id') AS object, rank FROM u WHERE json_type(v) = 'OBJECT' AND json_extract_string(v, '$.id') IS NOT NULL")
def entity_triples(spark, sf):
    """Claims whose value is an entity, as triples."""
    return E.entity_triples(table(spark, sf, "entity_store_jsonl"))


@query(_MAIN + """SELECT pid, try_cast(nullif(regexp_extract(json_extract_string(v, '$.time'), '([0-9]{4})', 1), '') AS INT) AS "year", count(*) AS statements FROM u WHERE json_type(v) = 'OBJECT' AND json_extract_string(v, '$.time') IS NOT NULL GROUP BY 1, 2""")
def claim_years(spark, sf):
    """Statements by property and year of their time value."""
    s = E.statements(table(spark, sf, "entity_store_jsonl")).where("time IS NOT NULL")
    return s.groupBy("pid", C.year_of(F.col("time")).alias("year")).agg(F.count("*").alias("statements"))


@query(_MAIN + "SELECT id, pid, string_agg(item, '|' ORDER BY item) AS items FROM (SELECT DISTINCT id, pid, json_extract_string(v, '$.id') AS item FROM u WHERE json_type(v) = 'OBJECT') WHERE item IS NOT NULL GROUP BY 1, 2")
def property_items(spark, sf):
    """The items of each property of an entity."""
    s = E.statements(table(spark, sf, "entity_store_jsonl")).where("item IS NOT NULL")
    return s.groupBy("id", "pid").agg(F.array_join(F.array_sort(F.collect_set("item")), "|").alias("items"))  # within one document


@query(_MAIN + """SELECT pid, count(*) AS statements, count(*) FILTER (WHERE json_type(q) = 'OBJECT' AND (json_exists(q, '$.P99580') OR json_exists(q, '$.P99582'))) AS temporal FROM u GROUP BY 1""")
def temporal_claims(spark, sf):
    """Statements by property, and those with a qualifier for a begin or an end."""
    ent = table(spark, sf, "entity_store_jsonl")
    s = materialize(N.snaks(ent), "snaks")
    key = ["entity_id", "pid", "statement_no"]
    timed = s.where("snak_section = 'qualifier' AND snak_pid IN ('P99580', 'P99582')").select(*key).distinct().withColumn("t", F.lit(1))
    return s.where("snak_section = 'mainsnak'").join(timed, key, "left").groupBy("pid").agg(F.count("*").alias("statements"), F.count("t").alias("temporal"))


_SIX = {"occupation": "P99106", "party": "P99031", "birth": "P99569", "sex": "P99021", "place": "P99019", "employer": "P99166"}


@query(_MAIN + "SELECT id, " + ", ".join(f"max(CASE WHEN pid = '{p}' THEN coalesce(json_extract_string(v, '$.id'), json_extract_string(v, '$.time')) END) AS {n}" for n, p in _SIX.items()) + " FROM (SELECT *, row_number() OVER (PARTITION BY id, pid ORDER BY statement_no) AS k FROM u WHERE json_type(v) = 'OBJECT' AND coalesce(rank, '') <> 'deprecated' AND coalesce(json_extract_string(v, '$.id'), json_extract_string(v, '$.time')) IS NOT NULL) WHERE k = 1 GROUP BY 1")
def guest_properties(spark, sf):
    """Six properties of an entity, the first value of each that is not deprecated."""
    s = E.statements(table(spark, sf, "entity_store_jsonl")).where("coalesce(rank, '') <> 'deprecated'").withColumn("v", F.coalesce("item", "time")).where("v IS NOT NULL")
    first = s.groupBy("id", "pid").agg(F.min(F.struct("statement_no", "v")).alias("s")).select("id", "pid", F.col("s.v").alias("v"))
    return first.groupBy("id").agg(*[F.max(F.when(F.col("pid") == p, F.col("v"))).alias(n) for n, p in _SIX.items()])


@query(_MAIN + """, g AS (SELECT id, count(DISTINCT pid) AS n_properties, count(*) AS n_statements FROM u GROUP BY 1),
l AS (SELECT id, max({'t': coalesce(discovered_at_utc, '0001-01-01'::TIMESTAMP), 'l': coalesce(labels, ''), 'd': coalesce(descriptions, '')}) AS x FROM entity_store_jsonl WHERE id <> '' GROUP BY 1)
SELECT l.id, nullif(CASE WHEN json_valid(x.l) THEN json_extract_string(x.l, '$.de.value') END, '') AS label_de, nullif(CASE WHEN json_valid(x.l) THEN json_extract_string(x.l, '$.en.value') END, '') AS label_en,
  nullif(CASE WHEN json_valid(x.d) THEN json_extract_string(x.d, '$.de.value') END, '') AS description_de, coalesce(n_properties, 0)::BIGINT AS n_properties, coalesce(n_statements, 0)::BIGINT AS n_statements FROM l LEFT JOIN g USING (id)""")
def instances_frame(spark, sf):
    """One row an entity: its texts by language and the profile of its claims, of the latest version."""
    ent = table(spark, sf, "entity_store_jsonl").where("id <> ''")
    g = N.snaks(ent).where("snak_section = 'mainsnak'").groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("pid").alias("n_properties"), F.count("*").alias("n_statements"))
    old = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    last = ent.groupBy("id").agg(F.max(F.struct(F.coalesce("discovered_at_utc", old).alias("t"), F.coalesce("labels", F.lit("")).alias("l"), F.coalesce("descriptions", F.lit("")).alias("d"))).alias("x"))
    text = lambda c, lang: F.nullif(F.when(F.try_parse_json(F.col(c)).isNotNull(), F.get_json_object(c, f"$.{lang}.value")), F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return last.join(g, "id", "left").select("id", text("x.l", "de").alias("label_de"), text("x.l", "en").alias("label_en"), text("x.d", "de").alias("description_de"), zero("n_properties"), zero("n_statements"))


# ---------------------------------------------------------------- event log


@query("WITH c AS (SELECT event_id // 500 AS chunk_id, min(event_id) AS f FROM events GROUP BY 1) SELECT chunk_id::VARCHAR AS chunk_id, row_number() OVER (ORDER BY (chunk_id % 7 = 6), chunk_id) AS position FROM c")
def chunk_order(spark, sf):
    """Chunks along their links; every seventh is linked by none and follows at the end."""
    c = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 500).cast("long").alias("n")).agg(F.min("event_id").alias("first_sequence"))
    before = F.when(F.col("n") % 7 == 0, F.col("n") - 2).otherwise(F.col("n") - 1)
    lone = F.col("n") % 7 == 6
    c = c.select(F.col("n").cast("string").alias("chunk_id"), F.when((F.col("n") > 0) & ~lone, before.cast("string")).alias("prev_chunk_id"), "first_sequence")
    return L.chunk_order(c)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= 5120")
def events_from_chunks(spark, sf):
    """Events from a number on, out of the chunks that may hold some."""
    log = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts").withColumn("chunk_id", F.floor(F.col("event_id") / 500).cast("long"))
    return L.events_from(log, events.chunk_catalog(log, "event_id", F.col("chunk_id"), "ts"), "chunk_id", "event_id", 5120).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def typed_events(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", "value")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id // 500 = 3 AND event_id = 1777")
def event_lookup(spark, sf):
    """One event by its chunk and number; both reach the scan."""
    return table(spark, sf, "events").where("event_id = 1777 AND floor(event_id / 500) = 3").select("event_id", "user_id", "event_type", "value")


@query("""SELECT event_id // 500 AS chunk, min(event_id) AS first_seq, max(event_id) AS last_seq, CASE WHEN arg_max(event_type, event_id) = 'view' THEN 'closed' ELSE 'open' END AS status, min(ts) AS opened, CASE WHEN arg_max(event_type, event_id) = 'view' THEN max(ts) END AS closed FROM events GROUP BY 1""")
def chunk_status(spark, sf):
    d = table(spark, sf, "events").withColumn("chunk_no", F.floor(F.col("event_id") / 500).cast("long"))
    return L.chunk_status(d, "chunk_no", "event_id", "ts", "event_type", "view")


@query("""
WITH r AS (SELECT class_id AS path, md5(max(resolution_reason)) AS d FROM class_resolution_map WHERE resolved_at < '2024-09-01' AND class_id IS NOT NULL AND resolution_reason IS NOT NULL GROUP BY 1), c AS (SELECT class_id AS path, md5(max(resolution_reason)) AS d FROM class_resolution_map WHERE resolved_at >= '2024-07-01' AND class_id IS NOT NULL AND resolution_reason IS NOT NULL GROUP BY 1)
SELECT path, CASE WHEN c.d IS NULL THEN 'missing' WHEN r.d IS NULL THEN 'unregistered' WHEN r.d = c.d THEN 'ok' ELSE 'changed' END AS state FROM r FULL JOIN c USING (path)""")
def checksum_validation(spark, sf):
    d = table(spark, sf, "class_resolution_map").where("class_id IS NOT NULL AND resolution_reason IS NOT NULL")
    take = lambda cond: d.where(cond).groupBy(F.col("class_id").alias("path")).agg(F.md5(F.max("resolution_reason")).alias("sha256"))
    return L.validate_checksums(take("resolved_at < timestamp_ntz'2024-09-01 00:00:00'"), take("resolved_at >= timestamp_ntz'2024-07-01 00:00:00'"))


@query("SELECT event_type AS handler, max(event_id) AS last_sequence FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def handler_progress(spark, sf):
    """The registry after a run; handlers that are not managed any more are gone."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("handler"))
    return L.progress(e.agg(F.min("event_id").alias("last_sequence")), e.agg(F.max("event_id").alias("last_sequence")), ["view", "click", "purchase"])


@query("SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 100)::BIGINT AS batch_no FROM events")
def write_batches(spark, sf):
    return L.batches(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], ["event_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def snapshot_bootstrap(spark, sf):
    """The state of each user from a snapshot and the events after it: as from the whole log."""
    e = table(spark, sf, "events")
    snap = materialize(events.latest_per_key(e.where("event_id <= 4000"), ["user_id"], "event_id", ["event_id", "event_type"]), "snapshot")
    return L.bootstrap(snap, e, ["user_id"], "event_id", ["event_id", "event_type"], 4000)


@query("SELECT guest_name AS mention, guest_url AS candidate, min(source_event_sequence) AS first_seq FROM episode_guests_normalized WHERE guest_name IS NOT NULL AND guest_url IS NOT NULL GROUP BY 1, 2")
def candidate_projection(spark, sf):
    g = table(spark, sf, "episode_guests_normalized").withColumnsRenamed({"guest_name": "mention", "guest_url": "candidate"})
    return L.candidates(g, "mention", "candidate", "source_event_sequence")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def instances_projection(spark, sf):
    """The last successful event of each key."""
    return L.last_success(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") != "error", ["event_id", "value"])


@query("""
WITH l AS (SELECT class_id AS name, max({'t': resolved_at, 'd': md5(resolved_core_class_id)}).d AS d FROM class_resolution_map WHERE resolved_at < '2024-09-01' AND resolved_core_class_id IS NOT NULL AND class_id IS NOT NULL GROUP BY 1),
n AS (SELECT class_id AS name, md5(max(resolved_core_class_id)) AS digest FROM class_resolution_map WHERE class_id IS NOT NULL AND resolved_core_class_id IS NOT NULL GROUP BY 1)
SELECT name, digest FROM n LEFT JOIN l USING (name) WHERE l.d IS NULL OR l.d <> digest""")
def config_changes(spark, sf):
    """Entries whose content is not the one last registered."""
    d = table(spark, sf, "class_resolution_map").where("class_id IS NOT NULL AND resolved_core_class_id IS NOT NULL")
    reg = d.where("resolved_at < timestamp_ntz'2024-09-01 00:00:00'").select(F.col("class_id").alias("name"), F.md5("resolved_core_class_id").alias("digest"), F.col("resolved_at").alias("sequence_num"))
    return L.config_changes(d.groupBy(F.col("class_id").alias("name")).agg(F.max("resolved_core_class_id").alias("content")), reg)


@query("""
SELECT 'latest' AS handler, 'incremental' AS mode, count(*) AS events, max(event_id) AS last_sequence FROM events WHERE event_id > 3000
UNION ALL SELECT 'counts', 'full', count(*), max(event_id) FROM events""")
def handler_runs(spark, sf):
    """Two handlers over the log, one from its last sequence on, the other for the first time; the summary."""
    e = table(spark, sf, "events")
    done = spark.range(1).select(F.lit("latest").alias("handler"), F.lit(3000).cast("long").alias("last_sequence"))
    handlers = {"latest": lambda d: events.latest_per_key(d, ["user_id"], "event_id", ["event_id"]), "counts": lambda d: d.groupBy("event_type").count()}
    return L.run_handlers(e, "event_id", handlers, done)[1]


@query(R._TRIPLES + """
SELECT (row_number() OVER (ORDER BY subject, predicate, object) - 1) AS sequence_num, 'v4' AS event_version, 'triple_discovered' AS event_type, subject AS subject_qid, predicate AS predicate_pid, object AS object_qid FROM t""")
def built_events(spark, sf):
    """Triples as events with numbers without gaps; their payload read back."""
    t = R._triples(spark, sf).toDF("subject_qid", "predicate_pid", "object_qid")
    ev = L.build_events(t, "triple_discovered", F.lit("2026-01-01T00:00:00Z"), ["subject_qid", "predicate_pid", "object_qid"])
    return ev.select("sequence_num", "event_version", "event_type", *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("subject_qid", "predicate_pid", "object_qid")])


@query("""
WITH d AS (SELECT program_name AS grp, episode_url AS u, max((normalizer_rule LIKE 'guest_block%')::INT) AS x FROM episode_guests_normalized WHERE episode_url IS NOT NULL GROUP BY 1, 2)
SELECT grp, count(*) AS known, sum(x)::BIGINT AS extracted FROM d GROUP BY 1""")
def known_urls(spark, sf):
    g = table(spark, sf, "episode_guests_normalized")
    return L.known_urls(g, F.col("program_name"), "episode_url", F.col("normalizer_rule").like("guest_block%"))


@query("""
WITH w AS (SELECT DISTINCT class_id AS key FROM class_resolution_map WHERE class_id IS NOT NULL), l AS (SELECT class_id AS key, max(resolved_at) AS t FROM class_resolution_map WHERE conflict_flag GROUP BY 1),
d AS (SELECT key, CASE WHEN date_diff('day', t, TIMESTAMP '2025-06-01') <= 300 THEN 'cache' ELSE 'fetch' END AS action FROM w LEFT JOIN l USING (key))
SELECT key, action, CASE WHEN action = 'fetch' THEN ((row_number() OVER (PARTITION BY action ORDER BY key) - 1) // 50)::BIGINT END AS batch_no FROM d""")
def fetch_plan(spark, sf):
    d = table(spark, sf, "class_resolution_map").withColumnRenamed("class_id", "key")
    return L.fetch_plan(d, d.where("conflict_flag"), "key", "resolved_at", F.to_date(F.lit("2025-06-01")), 300)


@query("SELECT count(*) AS events, count(*) FILTER (WHERE user_id < 20) AS calls, count(*) FILTER (WHERE user_id < 20 AND event_type = 'error') AS backoffs, max(event_id) AS last_seq FROM events WHERE event_id > 2500")
def log_tail(spark, sf):
    return L.tail(table(spark, sf, "events"), "event_id", 2500, F.col("user_id") < 20, F.col("event_type") == "error")


@query(None)
def incremental_inventory(spark, sf):
    """The query inventory read in two parts; the same as query_inventory."""
    from ..operators import dedup

    e, rank = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), dedup.status_rank(F.col("event_type"), R._STATUS)
    first = materialize(dedup.best_status(e.where("event_id < 3000"), ["user_id"], rank, "ts", ["event_type", "ts", "event_id"]), "inventory")
    return L.inventory_after(first, e.where("event_id >= 3000"), ["user_id"], rank, "ts", ["event_type", "event_id"])


R.ORACLE["incremental_inventory"] = R.ORACLE["query_inventory"]


@query("SELECT event_id, event_type, 'v3' AS event_version, md5(event_type || '|' || trim(regexp_replace('select  ' || user_id::VARCHAR, '[ \\t\\r\\n]+', ' ', 'g'))) AS query_hash, user_id::VARCHAR AS user_id FROM events")
def migrated_events(spark, sf):
    """Flat events as enveloped ones with the hash of their query; the payload read back."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("event_type").alias("endpoint"), F.concat(F.lit("select  "), F.col("user_id").cast("string")).alias("normalized_query"), "user_id")
    return L.migrate(e, ["event_id", "event_type"]).select("event_id", "event_type", "event_version", "query_hash", F.get_json_object("payload", "$.user_id").alias("user_id"))


@query("SELECT 'Q' || user_id::VARCHAR AS qid, event_id AS sequence_num, '{\"v\":' || event_id::VARCHAR || '}' AS document FROM events WHERE event_type = 'view'")
def entities_in_events(spark, sf):
    """Documents that events carry, taken out of their payloads."""
    doc = F.concat(F.lit('{"entities":{"Q'), F.col("user_id").cast("string"), F.lit('":{"v":'), F.col("event_id").cast("string"), F.lit("}}}"))
    e = table(spark, sf, "events").withColumn("payload", F.when(F.col("event_type") == "view", doc).otherwise(F.lit("{}")))
    return L.entities_in_events(e, "event_id", "payload")


@query("SELECT user_id, min(event_id) AS first_seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def seed_registry(spark, sf):
    return L.seed_registry(table(spark, sf, "events"), "user_id", "event_id", ["event_type"])


@query("""SELECT id, l || '.' || 'value' AS name, json_extract_string(labels, '$.' || l || '.value') AS value FROM (SELECT DISTINCT id, labels, unnest(json_keys(labels)) AS l FROM entity_store_jsonl WHERE json_valid(labels) AND json_type(labels) = 'OBJECT' AND id <> '') WHERE json_extract_string(labels, '$.' || l || '.value') IS NOT NULL""")
def dotted_keys(spark, sf):
    """The leaves of nested JSON under dotted names."""
    d = table(spark, sf, "entity_store_jsonl").where("id <> ''").select("id", "labels").distinct()
    return L.dotted(d, "id", "labels").where("name RLIKE '^[^.]+[.]value$'").select("id", "name", "value")


@query("SELECT id, (r // 1000)::BIGINT AS chunk, (r % 1000)::BIGINT AS place FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM (SELECT DISTINCT id FROM entity_store_jsonl WHERE id IS NOT NULL))")
def entity_index(spark, sf):
    return L.chunk_index(table(spark, sf, "entity_store_jsonl"), "id")


@query("""SELECT event_id, row_number() OVER (ORDER BY list_position(['error', 'click', 'view'], event_type), event_id) AS position FROM events WHERE event_type IN ('error', 'click', 'view') AND user_id <= 30""")
def work_queue(spark, sf):
    """Tasks by kind and then by arrival, none deeper than allowed."""
    return L.work_queue(table(spark, sf, "events").select("event_id", "event_type", "user_id"), "event_type", "event_id", "user_id", ["error", "click", "view"], 30).select("event_id", "position")


@query("""
WITH a AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id < 5000 OR user_id % 2 = 0 GROUP BY 1)
SELECT 'same' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) UNION ALL SELECT 'only_old', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_new', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def parity_report(spark, sf):
    e = table(spark, sf, "events")
    n = lambda d: d.groupBy("user_id").agg(F.count("*").alias("n"))
    return L.parity(n(e), n(e.where("event_id < 5000 OR user_id % 2 = 0")), ["user_id"])


# ---------------------------------------------------------------- texts and pages


def _blocks(spark, sf):
    """Text blocks of episodes as an archive prints them, from the tables' own values."""
    g = R.premieres(spark, sf).where("day IS NOT NULL").withColumn("no", F.regexp_extract("episode", r"/([0-9]+)-[^/]*$", 1))
    day = F.date_format("day", "dd.MM.yyyy")
    text = F.concat(
        F.lit("Sendetitel "), F.col("programme"), F.lit(" "), day, F.lit("\nArchivnummer "), F.year("day").cast("string"), F.lit("\nFolgenNr "), F.col("no"), F.lit("\nPublikation\n"), day,
        F.lit(" 23:15:00 75'30 12345/12345 ZDF\nSachinhalt\n"), F.col("episode"), F.lit("\n  Zeile zwei\nJugendeignung frei"),
    )
    return g.where("no <> ''").select("episode", "programme", "no", "day", text.alias("text"))


@query(R._SQL + """
SELECT episode, programme || ' ' || strftime(day, '%d.%m.%Y') AS title, strftime(day, '%d.%m.%Y') AS day, year(day)::VARCHAR AS archive_no, regexp_extract(episode, '/([0-9]+)-[^/]*$', 1) AS number, '75''30' AS length, episode || ' Zeile zwei' AS infos,
  CASE WHEN programme = (SELECT min(programme) FROM pre WHERE day IS NOT NULL AND regexp_extract(episode, '/([0-9]+)-[^/]*$', 1) <> '') THEN programme || ', Staffel ' || (year(day) - 2007)::VARCHAR ELSE '' END AS season
FROM pre WHERE day IS NOT NULL AND regexp_extract(episode, '/([0-9]+)-[^/]*$', 1) <> ''""")
def episode_blocks(spark, sf):
    """Fields of text blocks; the blocks are printed from the tables, so that they must come back."""
    b = _blocks(spark, sf)
    first = b.agg(F.min("programme")).first()[0]
    return P.episode_rows(b, "episode", "text", first or "").select("episode", "title", "day", "archive_no", "number", "length", "infos", "season")


@query(R._SQL + "SELECT episode, 1::BIGINT AS publication_index, strftime(day, '%d.%m.%Y') AS date, '23:15:00' AS time, '75''30' AS duration, 'ZDF' AS program FROM pre WHERE day IS NOT NULL AND regexp_extract(episode, '/([0-9]+)-[^/]*$', 1) <> ''")
def block_publications(spark, sf):
    return M.publication_rows(_blocks(spark, sf), "episode", "text").select("episode", "publication_index", "date", "time", "duration", "program")


_NAMED = "regexp_full_match(guest_name, '[A-ZÄÖÜ][a-zäöü]{2,} [A-ZÄÖÜ][a-zäöü]{2,}') AND regexp_full_match(guest_description, '[A-ZÄÖÜ][a-zäöü]+')"


@query(f"""
WITH d AS (SELECT DISTINCT source_event_sequence AS seq, string_split(guest_name, ' ') AS n, guest_description AS description FROM episode_guests_normalized WHERE {_NAMED})
SELECT seq, n[1] || ' ' || upper(n[2]) AS name, 'guest' AS mention_category, description, 'single_parenthetical' AS parsing_rule, 0.95e0 AS confidence FROM d""")
def mention_rows(spark, sf):
    """Persons named in announcements; these are printed from the guests' names and descriptions, which must come back."""
    g = table(spark, sf, "episode_guests_normalized").where("guest_name RLIKE '^[A-ZÄÖÜ][a-zäöü]{2,} [A-ZÄÖÜ][a-zäöü]{2,}$' AND guest_description RLIKE '^[A-ZÄÖÜ][a-zäöü]+$'")
    n = F.split("guest_name", " ")
    text = F.concat(F.lit("Mark LANZ mit "), n[0], F.lit(" "), F.upper(n[1]), F.lit(" ("), F.col("guest_description"), F.lit(")."))
    return M.mention_rows(g.select(F.col("source_event_sequence").alias("seq"), text.alias("text")).distinct(), "seq", "text").select("seq", "name", "mention_category", "description", "parsing_rule", "confidence")


@query("""
WITH d AS (SELECT DISTINCT canonical_entity_id AS k, occupations AS o FROM dedup_persons WHERE regexp_full_match(occupations, '[A-ZÄÖÜ][a-zäöü]{4,}([|][A-ZÄÖÜ][a-zäöü]{4,})*'))
SELECT DISTINCT k, unnest(string_split(o, '|')) AS topic, 'labelled_topic_list' AS parsing_rule, 0.93e0 AS confidence FROM d""")
def topic_rows(spark, sf):
    """Topics of labelled lists; these are printed from lists of words, which must come back."""
    d = table(spark, sf, "dedup_persons").where("occupations RLIKE '^[A-ZÄÖÜ][a-zäöü]{4,}([|][A-ZÄÖÜ][a-zäöü]{4,})*$'").select(F.col("canonical_entity_id").alias("k"), "occupations").distinct()
    text = F.concat(F.lit("Mark LANZ spricht. Themen: "), F.replace("occupations", F.lit("|"), F.lit(" ; ")))
    return M.topic_rows(d.select("k", text.alias("text")), "k", "text").drop("mention_id")


def _pages(spark, sf):
    """Pages of guests as a programme guide prints them, from the tables' own values."""
    d = table(spark, sf, "episode_guests_normalized").where("guest_name IS NOT NULL AND NOT guest_name RLIKE '[<>&\"]' AND guest_role RLIKE '^[A-Za-zäöüÄÖÜß]+$'").select("source_event_sequence", "guest_name", "guest_role", "guest_url").distinct()
    link = F.coalesce(F.concat(F.lit('href="'), F.col("guest_url"), F.lit('"')), F.lit(""))
    html = F.concat(
        F.lit('<h1>Folge</h1><h2 id="Cast-Crew">Cast</h2><ul class="cast-crew x"><li><a '), link, F.lit(' data-event-category="liste-cast-crew"><dl><dt itemprop="name">'), F.col("guest_name"),
        F.lit("</dt><dd><p>"), F.col("guest_role"), F.lit('<br>und mehr</p></dd></dl></a></li></ul><section><h2 id="Sendetermine">T</h2><time itemprop="startDate" datetime="2020-01-02T23:15:00+01:00"></time><span itemprop="name" content="ZDF"></span> TV-Premiere</section>'),
    )
    return d.select(F.col("source_event_sequence").alias("seq"), html.alias("html"))


@query("""
WITH d AS (SELECT DISTINCT source_event_sequence AS seq, trim(regexp_replace(guest_name, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS name, guest_role AS role, guest_url FROM episode_guests_normalized WHERE guest_name IS NOT NULL AND NOT regexp_matches(guest_name, '[<>&"]') AND regexp_full_match(guest_role, '[A-Za-zäöüÄÖÜß]+'))
SELECT seq, name, role, 'und mehr' AS description, coalesce(guest_url, '') AS url, round(least(0.55e0 + CASE WHEN name <> '' THEN 0.25e0 ELSE 0 END + 0.1e0 + CASE WHEN coalesce(guest_url, '') <> '' THEN 0.08e0 ELSE 0 END, 0.98e0), 3) AS confidence FROM d""")
def page_guests(spark, sf):
    """Guests out of pages, which are printed from the tables, so that they must come back."""
    d = P.leaf_page(_pages(spark, sf), "seq", "html").select("seq", F.explode("guests").alias("g"))
    return d.select("seq", "g.name", "g.role", "g.description", "g.url", "g.confidence")


@query("""SELECT DISTINCT guest_role AS a, episode_url AS b, coalesce(CASE WHEN x <> '' AND y <> '' THEN x <> y END, false) AS mismatch FROM (
  SELECT guest_role, episode_url, 'Staffel ' || (guest_order % 5)::VARCHAR || ',0' AS x0, (guest_order % 5)::VARCHAR AS x, (length(guest_name) % 5)::VARCHAR AS y FROM episode_guests_normalized WHERE guest_order IS NOT NULL AND guest_name IS NOT NULL)""")
def season_mismatches(spark, sf):
    """Two writings of a season compared; they are made of two numbers of a row."""
    g = table(spark, sf, "episode_guests_normalized").where("guest_order IS NOT NULL AND guest_name IS NOT NULL")
    a, b = F.concat(F.lit("Staffel "), (F.col("guest_order") % 5).cast("string"), F.lit(",0")), (F.length("guest_name") % 5).cast("string")
    return g.select(F.col("guest_role").alias("a"), F.col("episode_url").alias("b"), P.season_mismatch(a, b).alias("mismatch")).distinct()


@query("""
SELECT DISTINCT cluster_key AS raw, md5('wd|' || trim(regexp_replace(cluster_key, '[ \\t\\r\\n]+', ' ', 'g'))) AS query_hash,
  coalesce(nullif(regexp_replace(regexp_replace(lower(trim(cluster_key)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'value') AS column_name FROM dedup_persons WHERE cluster_key IS NOT NULL""")
def key_names(spark, sf):
    k = F.col("cluster_key")
    return table(spark, sf, "dedup_persons").where("cluster_key IS NOT NULL").select(k.alias("raw"), L.query_hash(F.lit("wd"), k).alias("query_hash"), P.column_name(k).alias("column_name")).distinct()


@query("""
WITH d AS (SELECT DISTINCT user_id AS n FROM events)
SELECT n, printf('rgba(%d, %d, %d, 0.5)', n * 2 % 256, n % 256, 255 - n % 256) AS rgba, CASE WHEN n % 3 = 0 THEN -1 WHEN n % 3 = 1 THEN n ELSE 0 END::INT AS budget FROM d""")
def colours_and_budgets(spark, sf):
    d = table(spark, sf, "events").select(F.col("user_id").alias("n")).distinct()
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    hexa = F.concat(F.lit("#"), two(F.col("n") * 2 % 256), two(F.col("n") % 256), two(255 - F.col("n") % 256))
    raw = F.when(F.col("n") % 3 == 0, F.lit("-1")).when(F.col("n") % 3 == 1, F.col("n").cast("string")).otherwise(F.lit("viele"))
    return d.select("n", P.rgba(hexa, 0.5).alias("rgba"), P.budget(raw).alias("budget"))


@query("""
SELECT DISTINCT id, list_sort(list_filter(json_keys(labels), lambda x: x IN ('de', 'mul')))::VARCHAR[] AS languages FROM entity_store_jsonl WHERE id <> '' AND json_valid(labels) AND json_type(labels) = 'OBJECT'""")
def language_filter(spark, sf):
    """The languages that are left of each document's labels."""
    d = table(spark, sf, "entity_store_jsonl").where("id <> ''").where(F.try_parse_json("labels").isNotNull() & F.trim("labels").startswith("{"))
    return d.select("id", F.array_sort(F.map_keys(P.only_languages(F.col("labels"), P.enabled_languages(F.lit("de, DE"))))).alias("languages")).distinct()


@query("""
SELECT DISTINCT class_id AS id, 'SELECT DISTINCT ?source WHERE { ?source wdt:P279 wd:' || class_id || ' . } ORDER BY ?source LIMIT 200 OFFSET 400' AS subclasses FROM class_resolution_map WHERE class_id IS NOT NULL""")
def query_texts(spark, sf):
    return table(spark, sf, "class_resolution_map").where("class_id IS NOT NULL").select(F.col("class_id").alias("id"), P.inlinks_query(F.col("class_id"), 200, 400, "P279").alias("subclasses")).distinct()


@query("""SELECT DISTINCT 'cgm_' || left(sha1('person|' || source_event_sequence::VARCHAR || '|' || guest_name), 12) AS mention_id, 'person' AS mention_type, guest_name AS label, episode_url AS context, source_event_sequence::VARCHAR AS source_id FROM episode_guests_normalized WHERE trim(guest_name) <> ''""")
def mention_targets(spark, sf):
    return P.mention_targets(table(spark, sf, "episode_guests_normalized"), "person", "source_event_sequence", "guest_name", "episode_url")


# ---------------------------------------------------------------- shaping


@query(R._SQL + """
, r AS (SELECT episode, guest, 'guest_' || (row_number() OVER (PARTITION BY episode ORDER BY guest) - 1) AS o FROM gu)
SELECT pre.episode AS episode, pre.day, w.* EXCLUDE (episode) FROM pre LEFT JOIN (SELECT * FROM (PIVOT r ON o USING max(guest) GROUP BY episode)) w ON w.episode = pre.episode""")
def episodes_with_guests(spark, sf):
    """Episodes with their guests in columns; columns of an earlier run are replaced."""
    base = R.premieres(spark, sf).select("episode", "day").withColumn("guest_0", F.lit("old"))
    return reshape.append_wide(base, R.wide_ordinals(spark, sf), "episode")


@query(R._SQL + """
, r AS (SELECT DISTINCT episode, role FROM app), o AS (SELECT episode, role, 'topic_' || (row_number() OVER (PARTITION BY episode ORDER BY role) - 1) AS o FROM r)
SELECT * FROM (PIVOT o ON o USING max(role) GROUP BY episode)""")
def wide_roles(spark, sf):
    """What occurs in an episode, in columns, as its topics are."""
    t = R.appearances(spark, sf).select("episode", F.col("role").alias("topic")).distinct()
    return reshape.wide(materialize(reshape.ordinal(t, ["episode"], ["topic"]), "ordinals"), "episode", "ordinal", ["topic"])


@query(R._SQL + ", g AS (SELECT programme, count(*) AS n FROM gu GROUP BY 1) SELECT programme, n, row_number() OVER (ORDER BY n DESC, programme) AS place FROM g")
def bars_descending(spark, sf):
    g = R.guests(spark, sf).groupBy("programme").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return stats.running(g, [F.desc("n"), F.asc("programme")], "one").select("programme", "n", F.col("rank").alias("place"))


@query(R._SQL + """
, o AS (SELECT class_id AS k, row_number() OVER (ORDER BY label) AS place FROM core_classes), d AS (SELECT class_id AS k FROM core_classes UNION SELECT qid FROM value_labels)
SELECT k, row_number() OVER (ORDER BY place NULLS LAST, k) AS position FROM d LEFT JOIN o USING (k)""")
def order_by_table(spark, sf):
    """Keys in the order of another table's rows, those it lacks at the end."""
    order = table(spark, sf, "core_classes").select(F.col("class_id").alias("k"), F.row_number().over(Window.orderBy("label")).alias("place"))  # ten rows
    d = table(spark, sf, "core_classes").select(F.col("class_id").alias("k")).union(table(spark, sf, "value_labels").select("qid")).distinct()
    return reshape.in_order_of(d, "k", order, "place").select("k", "position")


@query(R._SQL + ", m AS (SELECT programme, guest, count(*) AS n FROM gu GROUP BY 1, 2) SELECT programme, count(*) AS guests, sum(n)::BIGINT AS cells FROM m WHERE n >= 1 GROUP BY 1")
def show_matrices(spark, sf):
    """The occurrence matrix show by show: rows with at least one episode and filled cells."""
    m = R.guests(spark, sf).groupBy("programme", "guest").agg(F.count("*").alias("n")).where("n >= 1")
    return m.groupBy("programme").agg(F.count("*").alias("guests"), F.sum("n").alias("cells"))


@query("""SELECT DISTINCT alignment_unit_id AS unit, CASE WHEN match_tier = 'unresolved' THEN coalesce(nullif(unresolved_reason_code, ''), 'unknown') ELSE 'matched' END AS reason FROM aligned""")
def conditional_overwrite(spark, sf):
    """A column overwritten where a condition holds."""
    d = table(spark, sf, "aligned").select(F.col("alignment_unit_id").alias("unit"), "match_tier", F.lit("matched").alias("reason"), "unresolved_reason_code")
    return reshape.overwrite(d, "reason", F.col("match_tier") == "unresolved", F.coalesce(F.nullif("unresolved_reason_code", F.lit("")), F.lit("unknown"))).select("unit", "reason").distinct()


_PROPS = "SELECT qid AS pid, label, value_kind AS type, CASE WHEN length(label) > 20 THEN '0' ELSE '1' END AS enabled FROM value_labels"


@query(f"SELECT pid, label, type FROM ({_PROPS}) WHERE enabled <> '0' AND type <> 'party'")
def enabled_properties(spark, sf):
    """A catalogue's rows that are switched on and not derived."""
    d = table(spark, sf, "value_labels").select(F.col("qid").alias("pid"), "label", F.col("value_kind").alias("type"), F.when(F.length("label") > 20, "0").otherwise("1").alias("enabled"))
    return reshape.enabled(d, "enabled", "type", "party").select("pid", "label", "type")


@query("""
WITH t AS (SELECT DISTINCT source_discovered_sequence AS s FROM episode_guests_normalized WHERE episode_url LIKE '%#%')
SELECT source_event_sequence AS seq, guest_name FROM (SELECT DISTINCT source_event_sequence, guest_name, source_discovered_sequence FROM episode_guests_normalized) WHERE source_discovered_sequence IS NULL OR source_discovered_sequence NOT IN (SELECT s FROM t WHERE s IS NOT NULL)""")
def untainted_rows(spark, sf):
    """Rows without those whose source had an address with a fragment."""
    d = table(spark, sf, "episode_guests_normalized")
    bad = d.where("episode_url LIKE '%#%'").select("source_discovered_sequence").distinct()
    return d.select(F.col("source_event_sequence").alias("seq"), "guest_name", "source_discovered_sequence").distinct().join(bad, "source_discovered_sequence", "left_anti").select("seq", "guest_name")


@query("""SELECT DISTINCT qid, label, lower(trim(regexp_replace(translate(label, 'äöüÄÖÜ', 'aouAOU'), '[ \\t\\r\\n]+', ' ', 'g'))) AS label_norm FROM value_labels""")
def normal_forms(spark, sf):
    return P.with_normal_forms(table(spark, sf, "value_labels").select("qid", "label"), []).select("qid", "label", "label_norm").distinct()


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, '{c}' AS source_column, '{n}' AS canonical, '{s}' AS strategy" for t, c, n, s in (("aligned", "canonical_label", "label", "copy"), ("aligned", "episode_date", "day", "parse_date"), ("dedup_persons", "canonical_label", "label", "copy"), ("dedup_persons", "birthyear", "birth", "parse_year"), ("entity_store_jsonl", "claims.P99569", "birth", "claim_path"))))
def schema_mapping(spark, sf):
    """Which column of which source means what; columns a source lacks are left out, paths into claims stay."""
    frames = {t: table(spark, sf, t) for t in ("aligned", "dedup_persons", "entity_store_jsonl")}
    wanted = {"label": [("canonical_label", "copy")], "day": [("episode_date", "parse_date")], "birth": [("birthyear", "parse_year"), ("claims.P99569", "claim_path")]}
    return reshape.schema_mapping(spark, frames, wanted)


@query("""SELECT DISTINCT 'al_' || left(sha1('role|' || guest_role), 12) AS unit_id, guest_role AS label, 'carried_forward' AS state FROM episode_guests_normalized WHERE trim(guest_role) <> ''""")
def carried_forward(spark, sf):
    """Roles aligned with nothing: each its own unit under a stable id."""
    d = table(spark, sf, "episode_guests_normalized").where("trim(guest_role) <> ''").select(F.col("guest_role").alias("label")).distinct()
    return d.select(C.stable_id("al", F.lit("role"), F.col("label")).alias("unit_id"), "label", F.lit("carried_forward").alias("state"))


@query(R._SQL + """
, d AS (SELECT guest, birthplace, programme FROM gu LEFT JOIN per USING (guest)), l AS (SELECT guest, 'birthplace' AS field, birthplace AS v FROM d UNION ALL SELECT guest, 'programme', programme FROM d)
SELECT field, count(DISTINCT v) AS n_unique, count(v) AS appearances, count(*) - count(v) AS no_data FROM l GROUP BY 1""")
def chart_numbers(spark, sf):
    """For each property: distinct values, appearances with one, and without."""
    d = R.guests(spark, sf).join(R.persons(spark, sf).select("guest", "birthplace"), "guest", "left")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("birthplace", "programme")]))
    return d.select(both.alias("x")).select("x.*").groupBy("field").agg(F.count_distinct("v").alias("n_unique"), F.count("v").alias("appearances"), (F.count("*") - F.count("v")).alias("no_data"))


@query("SELECT entity_class, count(*) AS n FROM aligned WHERE entity_class IN ('person', 'organization') GROUP BY 1")
def allowed_types(spark, sf):
    """Rows of the mention types that are allowed; asking for an unknown type is an error."""
    types = reshape.allowed("person, Organization", ["person", "organization", "episode", "topic"])
    return table(spark, sf, "aligned").where(F.col("entity_class").isin(types)).groupBy("entity_class").agg(F.count("*").alias("n"))
