"""Queries of the core operators on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import align, dedup, events, gates, graph, reshape, stats
from ..operators import hierarchy as H
from ..operators import nested as N
from ..session import materialize, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return deco


# ---------------------------------------------------------------- shared inputs


def appearances(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (episode, programme, guest, role, day): episodes by the path of their page, rows without id left out."""
    path = C.url_path(F.col("fernsehserien_de_id"))
    return table(spark, sf, "episode_appearances").where("canonical_entity_id <> '' AND fernsehserien_de_id <> ''").select(
        path.alias("episode"), F.split(path, "/")[0].alias("programme"), F.col("canonical_entity_id").alias("guest"),
        F.coalesce(C.blank_to_null(F.col("role")), F.lit("unknown")).alias("role"),
    ).distinct()


def guests(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (guest, episode)."""
    return appearances(spark, sf).select("episode", "programme", "guest").distinct()


def persons(spark: SparkSession, sf: str) -> DataFrame:
    """One row per person."""
    return table(spark, sf, "dedup_persons").groupBy(F.col("canonical_entity_id").alias("guest")).agg(
        F.min("canonical_label").alias("label"), F.min(C.blank_to_null(F.col("birthplace"))).alias("birthplace"), F.min(C.year_of(F.col("birthyear"))).alias("birth"),
        F.min(C.blank_to_null(F.col("wikidata_id"))).alias("qid"), F.min("cluster_confidence").alias("confidence"), F.min("party").alias("party"), F.min("party_qids").alias("party_qids"),
    )


def premieres(spark: SparkSession, sf: str) -> DataFrame:
    """(episode, programme, day): the first premiere date of each episode."""
    path = C.url_path(F.col("fernsehserien_de_id"))
    d = table(spark, sf, "episode_appearances").where("fernsehserien_de_id <> ''").select(path.alias("episode"), F.split(path, "/")[0].alias("programme"), C.parse_date(F.col("premiere_date")).alias("day"))
    return d.groupBy("episode", "programme").agg(F.min("day").alias("day"))


_SQL = """
WITH a0 AS (
  SELECT trim(regexp_replace(regexp_replace(lower(trim(fernsehserien_de_id)), '[?#].*$', ''), '^([a-z][a-z0-9+.-]*:)?//[^/]*', ''), '/') AS episode,
         canonical_entity_id AS guest, coalesce(nullif(trim(role), ''), 'unknown') AS role, premiere_date
  FROM episode_appearances WHERE fernsehserien_de_id <> ''),
app AS (SELECT DISTINCT episode, split_part(episode, '/', 1) AS programme, guest, role FROM a0 WHERE guest <> ''),
gu AS (SELECT DISTINCT episode, programme, guest FROM app),
per AS (
  SELECT canonical_entity_id AS guest, min(canonical_label) AS label, min(nullif(trim(birthplace), '')) AS bp0, min(CASE WHEN trim(birthplace) <> '' THEN birthplace END) AS birthplace,
         min(try_cast(nullif(regexp_extract(birthyear, '([0-9]{4})', 1), '') AS INT)) AS birth, min(CASE WHEN trim(wikidata_id) <> '' THEN wikidata_id END) AS qid,
         min(cluster_confidence) AS confidence, min(party) AS party, min(party_qids) AS party_qids
  FROM dedup_persons GROUP BY 1),
pre AS (
  SELECT episode, split_part(episode, '/', 1) AS programme,
         min(coalesce(CASE WHEN regexp_matches(premiere_date, '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$') THEN try_strptime(premiere_date, '%d.%m.%Y') END,
                      CASE WHEN regexp_matches(premiere_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(premiere_date, '%Y-%m-%d') END))::DATE AS day
  FROM a0 GROUP BY 1, 2)
"""

# ---------------------------------------------------------------- distributions


@query(_SQL + """
, d AS (SELECT birthplace AS value, guest AS c, 1 AS n FROM gu LEFT JOIN per USING (guest)),
k AS (SELECT value, count(DISTINCT c) AS persons, sum(n) AS appearances FROM d WHERE value IS NOT NULL GROUP BY 1),
pc AS (SELECT c, count(value) AS k, sum(CASE WHEN value IS NULL THEN n END) AS blank FROM d GROUP BY 1),
u AS (SELECT 'Unknown / no data' AS value, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS persons, coalesce(sum(blank), 0) AS appearances FROM pc),
x AS (SELECT * FROM k UNION ALL SELECT * FROM u WHERE persons > 0),
t AS (SELECT count(DISTINCT c) AS tp, sum(n) AS ta FROM d)
SELECT value, persons::BIGINT AS persons, appearances::BIGINT AS appearances,
       round(persons * 100.0e0 / greatest(tp, 1), 2) AS pct_persons, round(appearances * 100.0e0 / greatest(ta, 1), 2) AS pct_appearances FROM x, t""")
def carrier_stats(spark, sf):
    d = guests(spark, sf).join(persons(spark, sf), "guest", "left").withColumn("n", F.lit(1))
    return stats.carrier_stats(d, "birthplace", "guest", "n")


@query(_SQL + """
, d AS (SELECT birthplace AS value, episode AS e, guest AS c FROM gu LEFT JOIN per USING (guest)),
t AS (SELECT count(DISTINCT e) AS te FROM d), v AS (SELECT * FROM d WHERE value IS NOT NULL),
p AS (SELECT value, e, count(*) AS n FROM v GROUP BY 1, 2),
s AS (SELECT value, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 4) AS mean_rows, round(stddev_pop(n), 4) AS std_rows, median(n)::DOUBLE AS median_rows, count(*) AS k, sum(n)::BIGINT AS total_rows FROM p GROUP BY 1),
w AS (SELECT value, count(DISTINCT c) AS persons FROM v GROUP BY 1)
SELECT value, min_rows, max_rows, mean_rows, std_rows, median_rows, round((te - k) * 100.0e0 / greatest(te, 1), 2) AS pct_without, total_rows, persons FROM s JOIN w USING (value), t""")
def episode_appearance_stats(spark, sf):
    return stats.episode_stats(guests(spark, sf).join(persons(spark, sf), "guest", "left"), "birthplace", "episode", "guest")


@query(_SQL + "SELECT frequency, count(*) AS carriers FROM (SELECT guest, count(*) AS frequency FROM gu GROUP BY 1) GROUP BY 1")
def frequency_distribution(spark, sf):
    return stats.frequency_distribution(guests(spark, sf), "guest")


@query(_SQL + """
, c AS (SELECT guest AS carrier, count(*) AS n FROM gu GROUP BY 1),
r AS (SELECT carrier, n, row_number() OVER w AS rank, (sum(n) OVER w)::BIGINT AS running FROM c WINDOW w AS (ORDER BY n DESC, carrier ROWS UNBOUNDED PRECEDING))
SELECT carrier, n, rank, running, round(running * 100.0e0 / greatest((SELECT sum(n) FROM c), 1), 2) AS cumulative_pct FROM r""")
def pareto_by_carrier(spark, sf):
    return stats.pareto(guests(spark, sf), "guest")


@query(_SQL + """
, c AS (SELECT guest, count(*) AS frequency FROM gu GROUP BY 1), b AS (SELECT frequency, count(*) AS carriers, (frequency * count(*))::BIGINT AS bucket_rows FROM c GROUP BY 1),
r AS (SELECT *, (sum(bucket_rows) OVER (ORDER BY frequency DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM b)
SELECT frequency, carriers, bucket_rows, running, round(running * 100.0e0 / greatest((SELECT sum(bucket_rows) FROM b), 1), 2) AS cumulative_pct FROM r""")
def pareto_by_bucket(spark, sf):
    return stats.pareto_buckets(guests(spark, sf), "guest")


@query(_SQL + "SELECT programme, min(day) AS first_day, max(day) AS last_day, count(*) AS episodes FROM pre WHERE day IS NOT NULL GROUP BY 1")
def season_rollup(spark, sf):
    return premieres(spark, sf).where("day IS NOT NULL").groupBy("programme").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("episodes"))


@query(_SQL + "SELECT guest, count(DISTINCT episode) AS episodes FROM gu GROUP BY 1")
def appearance_counts(spark, sf):
    return guests(spark, sf).groupBy("guest").agg(F.count_distinct("episode").alias("episodes"))


_ROLE = {"presenter": 0, "moderator": 1, "guest": 2}


@query(_SQL + "SELECT guest, arg_min(role, (CASE role WHEN 'presenter' THEN 0 WHEN 'moderator' THEN 1 WHEN 'guest' THEN 2 ELSE 9 END) || role) AS role FROM app GROUP BY 1")
def dominant_role(spark, sf):
    a = appearances(spark, sf)
    return stats.best_by(a, ["guest"], [dedup.status_rank(F.col("role"), _ROLE, 9), F.col("role")], ["role"])


@query(_SQL + """
SELECT p.birthplace, arg_min(p.qid, coalesce(p.confidence, 'zzz') || p.qid) AS qid FROM per p WHERE p.birthplace IS NOT NULL AND p.qid IS NOT NULL GROUP BY 1""")
def best_qid(spark, sf):
    p = persons(spark, sf).where("birthplace IS NOT NULL AND qid IS NOT NULL")
    return stats.best_by(p, ["birthplace"], [F.coalesce("confidence", F.lit("zzz"))], ["qid"])


@query(_SQL + """
SELECT programme, count(DISTINCT episode) AS episodes, count(*) AS appearances, count(DISTINCT guest) AS guests,
       round(count(*) * 1.0e0 / greatest(count(DISTINCT episode), 1), 4) AS per_episode FROM gu GROUP BY 1""")
def per_show_stats(spark, sf):
    g = guests(spark, sf).groupBy("programme").agg(F.count_distinct("episode").alias("episodes"), F.count("*").alias("appearances"), F.count_distinct("guest").alias("guests"))
    return g.withColumn("per_episode", F.round(F.col("appearances") / F.greatest("episodes", F.lit(1)), 4))


def _matched(spark, sf):
    return guests(spark, sf).join(persons(spark, sf).select("guest", "qid"), "guest", "left")


def _cov(by: str) -> str:
    return _SQL + f"""SELECT {by + ', ' if by else ''}count(*) AS "rows", count(qid) AS matched, round(count(qid) * 100.0e0 / greatest(count(*), 1), 1) AS pct_matched
FROM gu LEFT JOIN per USING (guest) {'GROUP BY ' + by if by else ''}"""


@query(_cov("episode"))
def coverage_by_episode(spark, sf):
    return stats.coverage(_matched(spark, sf), ["episode"], F.col("qid").isNotNull())


@query(_cov("programme"))
def coverage_by_show(spark, sf):
    return stats.coverage(_matched(spark, sf), ["programme"], F.col("qid").isNotNull())


@query(_SQL + """
, c AS (SELECT count(*) AS n, count(qid) AS m FROM gu LEFT JOIN per USING (guest))
SELECT 'rows' AS metric, n::DOUBLE AS value FROM c UNION ALL SELECT 'matched', m FROM c UNION ALL SELECT 'pct_matched', round(m * 100.0e0 / greatest(n, 1), 1) FROM c""")
def coverage_overall(spark, sf):
    c = stats.coverage(_matched(spark, sf), [], F.col("qid").isNotNull())
    names = ["rows", "matched", "pct_matched"]
    return c.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("x")).select("x.*")


_GS = _SQL + ", g AS (SELECT programme, guest, count(*) AS n FROM gu GROUP BY 1, 2)"


@query(_GS + "SELECT programme, guest, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY programme ORDER BY n DESC, guest) AS rank FROM g) WHERE rank <= 10")
def top_guests_per_show(spark, sf):
    g = guests(spark, sf).groupBy("programme", "guest").agg(F.count("*").alias("n"))
    return stats.top_per_group(g, "programme", [F.desc("n"), F.asc("guest")], 10)


@query(_SQL + "SELECT guest, n, row_number() OVER (ORDER BY n DESC, guest) AS rank FROM (SELECT guest, count(*) AS n FROM gu GROUP BY 1) ORDER BY n DESC, guest LIMIT 50")
def top_guests_combined(spark, sf):
    top = guests(spark, sf).groupBy("guest").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "guest").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "guest")).cast("long"))  # fifty rows


@query(_GS + """
, t AS (SELECT guest AS carrier, sum(n)::BIGINT AS total, arg_min(programme, lpad((100000000 - n)::VARCHAR, 9, '0') || programme) AS dominant, max(n) AS m FROM g GROUP BY 1)
SELECT carrier, dominant, total, round(m * 100.0e0 / greatest(total, 1), 2) AS share_pct FROM t WHERE total >= 5""")
def guest_specialization(spark, sf):
    return stats.specialization(guests(spark, sf), "guest", "programme", 5)


@query(_SQL + """
, l AS (SELECT guest, unnest([{'property': 'birthplace', 'value': birthplace}, {'property': 'birth', 'value': birth::VARCHAR}, {'property': 'qid', 'value': qid}]) AS x FROM per)
SELECT guest, x.property AS field, x.value AS value FROM l WHERE trim(x.value) <> ''""")
def guest_profile(spark, sf):
    return reshape.long(persons(spark, sf).select("guest", "birthplace", "birth", "qid"), "guest", ["birthplace", "birth", "qid"])


_AGE = _SQL + ", ag AS (SELECT gu.guest, year(pre.day) - per.birth AS age FROM gu JOIN pre USING (episode) JOIN per USING (guest) WHERE year(pre.day) - per.birth BETWEEN 0 AND 119)"


def _ages(spark, sf):
    g = guests(spark, sf).join(premieres(spark, sf).select("episode", "day"), "episode").join(persons(spark, sf), "guest")
    return g.select("guest", C.age_at(F.col("birth"), F.year("day")).alias("age")).where("age IS NOT NULL")


@query(_AGE + "SELECT (age // 10 * 10)::VARCHAR || '-' || (age // 10 * 10 + 9)::VARCHAR AS bin, count(*) AS appearances, count(DISTINCT guest) AS persons, round(avg(age), 4) AS mean_age FROM ag GROUP BY 1")
def age_bins(spark, sf):
    lo = (F.floor(F.col("age") / 10) * 10).cast("int")
    b = F.concat(lo.cast("string"), F.lit("-"), (lo + 9).cast("string"))
    return _ages(spark, sf).groupBy(b.alias("bin")).agg(F.count("*").alias("appearances"), F.count_distinct("guest").alias("persons"), F.round(F.avg("age"), 4).alias("mean_age"))


@query(_SQL + """
, d AS (SELECT coalesce(birthplace, '(unknown)') AS value, programme FROM gu LEFT JOIN per USING (guest))
SELECT coalesce(programme, '(all)') AS programme, value, count(*) AS n FROM d GROUP BY GROUPING SETS ((programme, value), (value))""")
def value_by_show_sets(spark, sf):
    d = guests(spark, sf).join(persons(spark, sf), "guest", "left").select(F.coalesce("birthplace", F.lit("(unknown)")).alias("value"), "programme")
    return d.groupingSets([["programme", "value"], ["value"]], "programme", "value").agg(F.count("*").alias("n")).select(F.coalesce("programme", F.lit("(all)")).alias("programme"), "value", "n")


@query(_SQL + """
, d AS (SELECT year(day) AS y, coalesce(birth // 10 * 10, -1)::INT AS decade FROM gu JOIN pre USING (episode) LEFT JOIN per USING (guest) WHERE day IS NOT NULL),
g AS (SELECT y, decade, count(*) AS n FROM d GROUP BY 1, 2)
SELECT y::INT AS "year", decade, n, round(n * 100.0e0 / sum(n) OVER (PARTITION BY y), 2) AS pct_of_year FROM g""")
def value_over_time(spark, sf):
    d = guests(spark, sf).join(premieres(spark, sf).select("episode", "day"), "episode").where("day IS NOT NULL").join(persons(spark, sf), "guest", "left")
    g = d.groupBy(F.year("day").alias("year"), F.coalesce((F.floor(F.col("birth") / 10) * 10).cast("int"), F.lit(-1)).alias("decade")).agg(F.count("*").alias("n"))
    return g.withColumn("pct_of_year", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("year")), 2))


@query(_SQL + """
, s AS (SELECT guest, list_filter(list_transform(string_split(coalesce(party, ''), '|'), lambda x: trim(x, ' ')), lambda x: x <> '') AS a,
               list_filter(list_transform(string_split(coalesce(party_qids, ''), '|'), lambda x: trim(x, ' ')), lambda x: x <> '') AS b FROM per),
z AS (SELECT guest, unnest(list_zip(a, b)) AS x FROM s)
SELECT coalesce(x[1], '') AS value, coalesce(x[2], '') AS qid, count(*) AS n, count(DISTINCT guest) AS persons FROM z GROUP BY 1, 2""")
def multi_value_distribution(spark, sf):
    z = F.arrays_zip(C.split_list(F.col("party")).alias("a"), C.split_list(F.col("party_qids")).alias("b"))
    d = persons(spark, sf).select("guest", F.explode(z).alias("x"))
    return d.groupBy(F.coalesce("x.a", F.lit("")).alias("value"), F.coalesce("x.b", F.lit("")).alias("qid")).agg(F.count("*").alias("n"), F.count_distinct("guest").alias("persons"))


@query(_SQL + """
, d AS (SELECT DISTINCT programme, guest, confidence FROM gu JOIN per USING (guest))
SELECT programme, count(DISTINCT CASE WHEN confidence = 'high' THEN guest END) AS n_high, count(DISTINCT CASE WHEN confidence = 'medium' THEN guest END) AS n_medium,
       count(DISTINCT CASE WHEN confidence = 'low' THEN guest END) AS n_low FROM d GROUP BY 1""")
def cross_tab(spark, sf):
    return reshape.crosstab(guests(spark, sf).join(persons(spark, sf), "guest"), "programme", "confidence", ["high", "medium", "low"], "guest")


@query(_SQL + """
, d AS (SELECT programme, coalesce(birthplace, '(unknown)') AS value, guest FROM gu LEFT JOIN per USING (guest))
SELECT coalesce(programme, '(all)') AS programme, coalesce(value, '(all)') AS value, count(DISTINCT guest) AS persons FROM d GROUP BY ROLLUP (programme, value)""")
def hierarchy_rollup(spark, sf):
    d = guests(spark, sf).join(persons(spark, sf), "guest", "left").select("programme", F.coalesce("birthplace", F.lit("(unknown)")).alias("value"), "guest")
    r = d.rollup("programme", "value").agg(F.count_distinct("guest").alias("persons"))
    return r.select(F.coalesce("programme", F.lit("(all)")).alias("programme"), F.coalesce("value", F.lit("(all)")).alias("value"), "persons")


@query(_SQL + """
, s AS (SELECT guest, string_agg(programme, '|' ORDER BY programme) AS combination FROM (SELECT DISTINCT guest, programme FROM gu) GROUP BY 1)
SELECT combination, count(*) AS carriers FROM s GROUP BY 1""")
def value_combinations(spark, sf):
    return stats.combinations(guests(spark, sf), "guest", "programme")


@query(_SQL + "SELECT (dayofweek(day) + 1)::INT AS weekday, count(*) AS episodes FROM pre WHERE day IS NOT NULL GROUP BY 1")
def weekday_distribution(spark, sf):
    return premieres(spark, sf).where("day IS NOT NULL").groupBy(F.dayofweek("day").alias("weekday")).agg(F.count("*").alias("episodes"))


@query(_SQL + "SELECT guests, count(*) AS episodes FROM (SELECT episode, count(*) AS guests FROM gu GROUP BY 1) GROUP BY 1")
def guests_per_episode(spark, sf):
    return guests(spark, sf).groupBy("episode").agg(F.count("*").alias("guests")).groupBy("guests").agg(F.count("*").alias("episodes"))


@query(_SQL + """
, g AS (SELECT coalesce(birthplace, 'Unknown / no data') AS value, count(*) AS n FROM gu JOIN per USING (guest) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY (value = 'Unknown / no data'), n DESC, value) AS k FROM g)
SELECT CASE WHEN value = 'Unknown / no data' THEN value WHEN k <= 10 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS n,
       min(CASE WHEN value = 'Unknown / no data' THEN 12 ELSE least(k, 11) END) AS place FROM r GROUP BY 1""")
def top_n_other(spark, sf):
    g = guests(spark, sf).join(persons(spark, sf), "guest").groupBy(F.coalesce("birthplace", F.lit(stats.UNKNOWN)).alias("value")).agg(F.count("*").alias("n"))
    return stats.top_n_other(g, "value", "n", 10)


@query(_SQL + """
, g AS (SELECT programme, count(*) AS n FROM gu GROUP BY 1) SELECT programme, ((row_number() OVER (ORDER BY n DESC, programme) - 1) % 12)::BIGINT AS colour FROM g""")
def rank_palette(spark, sf):
    g = guests(spark, sf).groupBy("programme").agg(F.count("*").alias("n"))
    return stats.running(g, [F.desc("n"), F.asc("programme")], "n").select("programme", ((F.col("rank") - 1) % 12).alias("colour"))


@query("""SELECT count(*) AS n_rows, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicated, count(*) FILTER (WHERE trim(text) = '') AS n_blank,
       quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS longest FROM documents""")
def phase1_validation(spark, sf):
    p = lambda q: F.percentile("n_chars", F.lit(q))
    return table(spark, sf, "documents").agg(
        F.count("*").alias("n_rows"), F.count_distinct("text").alias("n_unique"), (F.count("*") - F.count_distinct("text")).alias("n_duplicated"),
        F.count_if(F.trim("text") == "").alias("n_blank"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max("n_chars").alias("longest"),
    )


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value FROM events GROUP BY 1""")
def benchmark_by_mode(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean_value"), F.round(F.min(v), 4).alias("min_value"), F.round(F.max(v), 4).alias("max_value"))


@query("""
WITH g AS (SELECT floor(value)::BIGINT AS delay, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS backoffs FROM events GROUP BY 1)
SELECT delay, calls, backoffs, round(backoffs * 100.0e0 / calls, 2) AS rate_pct, (calls >= 20 AND backoffs = 0) AS safe FROM g""")
def delay_history(spark, sf):
    g = table(spark, sf, "events").groupBy(F.floor("value").alias("delay")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("backoffs"))
    return g.select("delay", "calls", "backoffs", stats.pct(F.col("backoffs"), F.col("calls")).alias("rate_pct"), ((F.col("calls") >= 20) & (F.col("backoffs") == 0)).alias("safe"))


@query("""
WITH d AS (SELECT DISTINCT * FROM dedup_persons)
SELECT cluster_strategy, cluster_confidence, count(*) AS clusters, sum(cluster_size)::BIGINT AS members, round((1 - count(*) * 1.0e0 / sum(cluster_size)) * 100, 2) AS reduction_pct FROM d GROUP BY 1, 2""")
def cluster_summary(spark, sf):
    g = table(spark, sf, "dedup_persons").distinct().groupBy("cluster_strategy", "cluster_confidence").agg(F.count("*").alias("clusters"), F.sum("cluster_size").alias("members"))
    return g.withColumn("reduction_pct", F.round((1 - F.col("clusters") / F.col("members")) * 100, 2))


@query(None)
def claim_coverage(spark, sf):
    """Per property: entities, statements, qualifiers and references."""
    s = N.snaks(table(spark, sf, "entity_store_jsonl"))
    n = lambda k: F.count_if(F.col("snak_section") == k)
    return s.groupBy("pid").agg(F.count_distinct("entity_id").alias("entities"), n("mainsnak").alias("statements"), n("qualifier").alias("qualifiers"), n("reference").alias("references"))


@query(None)
def property_profile(spark, sf):
    """Number of properties and statements of each entity."""
    s = N.snaks(table(spark, sf, "entity_store_jsonl")).where("snak_section = 'mainsnak'")
    return s.groupBy("entity_id").agg(F.count_distinct("pid").alias("properties"), F.count("*").alias("statements"))


# ---------------------------------------------------------------- matrices and reshaping


@query(_SQL + "SELECT guest AS person, episode FROM gu")
def occurrence_long(spark, sf):
    return reshape.occurrence(guests(spark, sf), "guest", "episode")


@query(_SQL + """
, top AS (SELECT guest FROM gu GROUP BY 1 ORDER BY count(*) DESC, guest LIMIT 200), o AS (SELECT guest, episode FROM gu WHERE guest IN (SELECT guest FROM top))
SELECT x.guest AS a, y.guest AS b, count(*) AS n FROM o x JOIN o y USING (episode) GROUP BY 1, 2""")
def cooccurrence_matrix(spark, sf):
    top = guests(spark, sf).groupBy("guest").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "guest").limit(200).select("guest")
    return reshape.cooccurrence(reshape.occurrence(guests(spark, sf).join(top, "guest", "left_semi"), "guest", "episode"))


@query(_SQL + """
SELECT x.guest AS a, y.guest AS b, count(*) AS n FROM gu x JOIN gu y ON x.episode = y.episode AND x.guest < y.guest GROUP BY 1, 2""")
def cooccurrence_pairs(spark, sf):
    o = reshape.occurrence(guests(spark, sf), "guest", "episode")
    x, y = o.select(F.col("person").alias("a"), "episode"), o.select(F.col("person").alias("b"), "episode")
    return x.join(y, "episode").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(_SQL + """
, r AS (SELECT episode, guest, 'guest_' || (row_number() OVER (PARTITION BY episode ORDER BY guest) - 1) AS o FROM gu)
SELECT * FROM (PIVOT r ON o USING max(guest) GROUP BY episode)""")
def wide_ordinals(spark, sf):
    """As many columns as the fullest episode has guests."""
    return reshape.wide(materialize(reshape.ordinal(guests(spark, sf), ["episode"], ["guest"]), "ordinals"), "episode", "ordinal", ["guest"])


@query("""
WITH d AS (SELECT DISTINCT alignment_unit_id AS unit, label_wikidata, label_fernsehserien_de, label_zdf FROM aligned),
l AS (SELECT unit, 'label_wikidata' AS field, label_wikidata AS value FROM d UNION ALL SELECT unit, 'label_fernsehserien_de', label_fernsehserien_de FROM d UNION ALL SELECT unit, 'label_zdf', label_zdf FROM d)
SELECT DISTINCT unit, field, value FROM l WHERE trim(value) <> ''""")
def wide_to_long(spark, sf):
    cols = ["label_wikidata", "label_fernsehserien_de", "label_zdf"]
    return reshape.long(table(spark, sf, "aligned").select(F.col("alignment_unit_id").alias("unit"), *cols).distinct(), "unit", cols).distinct()


@query("""
WITH d AS (SELECT DISTINCT guest_role FROM episode_guests_normalized WHERE trim(guest_role) <> ''),
c AS (SELECT guest_role, list_filter(list_transform(regexp_split_to_array(guest_role, '[,;|/\\\\-]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS c FROM d)
SELECT guest_role, len(c)::INT AS n_chunks, i AS chunk_no, c[i] AS chunk FROM (SELECT guest_role, c, unnest(range(1, len(c) + 1)) AS i FROM c)""")
def label_chunks(spark, sf):
    """Every chunk of a label with its number, whatever their count; wide() makes columns of them."""
    d = table(spark, sf, "episode_guests_normalized").where("trim(guest_role) <> ''").select("guest_role").distinct().withColumn("c", reshape.chunks(F.col("guest_role")))
    d = d.select("guest_role", F.size("c").alias("n_chunks"), F.posexplode("c").alias("pos", "chunk"))
    return d.select("guest_role", "n_chunks", (F.col("pos") + 1).cast("long").alias("chunk_no"), "chunk")


@query("""
WITH d AS (SELECT alignment_unit_id AS unit, unnest(string_split(alias_wikidata, '|')) AS alias FROM aligned WHERE alias_wikidata IS NOT NULL)
SELECT DISTINCT unit, trim(alias, ' ') AS alias FROM d WHERE trim(alias, ' ') <> ''""")
def alias_explode(spark, sf):
    return table(spark, sf, "aligned").select(F.col("alignment_unit_id").alias("unit"), F.explode(C.split_list(F.col("alias_wikidata"))).alias("alias")).distinct()


@query(_SQL + """
, d AS (SELECT programme, CASE WHEN birth IS NULL THEN 'unknown' WHEN birth < 1967 THEN 'left' ELSE 'right' END AS side FROM gu LEFT JOIN per USING (guest)),
g AS (SELECT programme, count(*) AS n, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r FROM d GROUP BY 1)
SELECT programme, n, round(l * 100.0e0 / n, 2) AS left_pct, round(r * 100.0e0 / n, 2) AS right_pct, round((n - l - r) * 100.0e0 / n, 2) AS unknown_pct FROM g""")
def centered_share(spark, sf):
    d = guests(spark, sf).join(persons(spark, sf), "guest", "left")
    g = d.groupBy("programme").agg(F.count("*").alias("n"), F.count_if(F.col("birth") < 1967).alias("l"), F.count_if(F.col("birth") >= 1967).alias("r"))
    p = lambda c: F.round(c * 100.0 / F.col("n"), 2)
    return g.select("programme", "n", p(F.col("l")).alias("left_pct"), p(F.col("r")).alias("right_pct"), p(F.col("n") - F.col("l") - F.col("r")).alias("unknown_pct"))


_ALIGNED = [
    "alignment_unit_id", "wikidata_id", "fernsehserien_de_id", "mention_id", "canonical_label", "open_refine_name", "entity_class", "match_confidence", "match_tier", "match_strategy",
    "evidence_summary", "unresolved_reason_code", "unresolved_reason_detail", "inference_flag", "inference_basis", "notes", "label_wikidata", "label_fernsehserien_de", "label_zdf",
    "description_wikidata", "description_fernsehserien_de", "description_zdf", "alias_wikidata", "alias_fernsehserien_de", "alias_zdf", "program_name", "episode_date", "aligned_at",
]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE trim({c}::VARCHAR) <> '') AS filled, round(count(*) FILTER (WHERE trim({c}::VARCHAR) <> '') * 1.0e0 / count(*), 4) AS share FROM aligned" for c in _ALIGNED))
def column_population(spark, sf):
    """Of all columns of the table."""
    return reshape.population(table(spark, sf, "aligned"))


# ---------------------------------------------------------------- duplicates and clusters


@query("""
WITH d AS (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY 1, 2, 3) SELECT n, count(*) AS groups FROM d GROUP BY 1""")
def exact_duplicates(spark, sf):
    return dedup.exact_duplicates(table(spark, sf, "documents").select("text", "lang", "source"))


@query("""
SELECT doc_id, text, source FROM (SELECT doc_id, text, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def distinct_first(spark, sf):
    return dedup.first_of(table(spark, sf, "documents").select("doc_id", "text", "source"), ["text"], ["doc_id"])


@query("""
WITH d AS (SELECT DISTINCT episode_url, guest_name, source_event_sequence AS id, coalesce(trim(guest_description), '') AS t FROM episode_guests_normalized WHERE episode_url IS NOT NULL AND guest_name IS NOT NULL),
k AS (SELECT *, first_value(id) OVER w AS keeper_id, first_value(t) OVER w AS kt FROM d WINDOW w AS (PARTITION BY episode_url, guest_name ORDER BY (t = ''), length(t) DESC, id, t))
SELECT episode_url, guest_name, id, keeper_id, CASE WHEN id = keeper_id THEN 'keeper' WHEN t = kt OR t = '' OR kt = '' THEN 'duplicate' ELSE 'kept' END AS state FROM k""")
def keeper_duplicates(spark, sf):
    d = table(spark, sf, "episode_guests_normalized").where("episode_url IS NOT NULL AND guest_name IS NOT NULL")
    d = d.select("episode_url", "guest_name", F.col("source_event_sequence").alias("id"), F.coalesce(F.trim("guest_description"), F.lit("")).alias("t")).distinct()
    return dedup.keeper_split(d, ["episode_url", "guest_name"], "id", "t")


_NK = "lower(list_aggregate(list_transform(list_filter(regexp_split_to_array(trim({0}, ' '), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: left(x, 1) || lower(substr(x, 2))), 'string_agg', ' '))"
_NAMEKEY = "replace(replace(replace(replace(" + _NK + ", 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"

_CLUSTER = f"""
WITH d AS (SELECT DISTINCT alignment_unit_id AS id, CASE WHEN trim(wikidata_id) <> '' THEN wikidata_id END AS q, canonical_label AS label, CASE WHEN match_tier = 'exact' THEN alignment_unit_id END AS m FROM aligned WHERE alignment_unit_id IS NOT NULL),
e AS (SELECT *, nullif({_NAMEKEY.format("label")}, '') AS nk, CASE WHEN m IS NULL AND q IS NOT NULL THEN sum(CASE WHEN m IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY q) END AS nq FROM d),
f AS (SELECT *, (m IS NULL AND coalesce(nq > 1, false)) AS byq FROM e),
g AS (SELECT *, CASE WHEN m IS NULL AND NOT byq AND nk IS NOT NULL THEN sum(CASE WHEN m IS NULL AND NOT byq THEN 1 ELSE 0 END) OVER (PARTITION BY nk) END AS nn FROM f),
h AS (SELECT id, q, CASE WHEN m IS NOT NULL THEN 'authoritative' WHEN byq THEN 'high' WHEN nn > 1 THEN 'medium' ELSE 'low' END AS tier,
             CASE WHEN m IS NOT NULL THEN 'm:' || m WHEN byq THEN 'q:' || q WHEN nn > 1 THEN 'n:' || nk ELSE 's:' || id END AS cluster_key FROM g),
i AS (SELECT *, count(*) OVER (PARTITION BY cluster_key) AS cluster_size, first_value(id) OVER (PARTITION BY cluster_key ORDER BY (q IS NULL), id) AS rep FROM h)
"""


def _clusters(spark, sf):
    d = table(spark, sf, "aligned").where("alignment_unit_id IS NOT NULL")
    d = d.select("alignment_unit_id", "wikidata_id", "canonical_label", "match_tier").distinct()
    manual = d.where("match_tier = 'exact'").select(F.col("alignment_unit_id").alias("id"), F.col("alignment_unit_id").alias("manual_key")).distinct()
    return dedup.tiered_clusters(d.drop("match_tier").distinct(), "alignment_unit_id", "wikidata_id", "canonical_label", manual)


@query(_CLUSTER + "SELECT id, tier, cluster_size, 'ce_' || left(sha1(rep), 12) AS cluster_id, id = rep AS is_representative FROM i")
def tiered_clusters(spark, sf):
    return _clusters(spark, sf).drop("cluster_key")


@query(_CLUSTER + "SELECT tier, count(*) AS members, count(DISTINCT cluster_key) AS clusters, max(cluster_size) AS largest FROM i GROUP BY 1")
def cluster_members(spark, sf):
    return _clusters(spark, sf).groupBy("tier").agg(F.count("*").alias("members"), F.count_distinct("cluster_key").alias("clusters"), F.max("cluster_size").alias("largest"))


@query("""
WITH a AS (SELECT DISTINCT canonical_entity_id AS id FROM dedup_persons), b AS (SELECT DISTINCT canonical_entity_id AS id FROM episode_appearances WHERE canonical_entity_id IS NOT NULL)
SELECT id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_diff_completeness(spark, sf):
    a = table(spark, sf, "dedup_persons").select(F.col("canonical_entity_id").alias("id"))
    b = table(spark, sf, "episode_appearances").where("canonical_entity_id IS NOT NULL").select(F.col("canonical_entity_id").alias("id"))
    return dedup.difference(a, b, "id")


@query("""
WITH a AS (SELECT DISTINCT fernsehserien_de_id AS url FROM episode_appearances), b AS (SELECT DISTINCT episode_url AS url FROM episode_guests_normalized)
SELECT url FROM a WHERE url IS NOT NULL INTERSECT SELECT url FROM b""")
def set_intersect(spark, sf):
    a = table(spark, sf, "episode_appearances").select(F.col("fernsehserien_de_id").alias("url")).where("url IS NOT NULL")
    return a.intersect(table(spark, sf, "episode_guests_normalized").select(F.col("episode_url").alias("url")))


@query(_SQL + "SELECT guest, label FROM per WHERE guest IN (SELECT guest FROM gu WHERE programme LIKE 'spiegel%')")
def semi_scope(spark, sf):
    scope = guests(spark, sf).where("programme LIKE 'spiegel%'").select("guest")
    return persons(spark, sf).select("guest", "label").join(scope, "guest", "left_semi")


@query(_SQL + "SELECT guest, label FROM per WHERE guest NOT IN (SELECT guest FROM gu)")
def anti_used(spark, sf):
    return persons(spark, sf).select("guest", "label").join(guests(spark, sf).select("guest"), "guest", "left_anti")


_STATUS = {"purchase": 4, "click": 3, "view": 2}


@query("""
SELECT user_id, arg_max(event_type, s) AS event_type, arg_max(event_id, s) AS event_id FROM (
  SELECT *, lpad((CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END)::VARCHAR, 2, '0') || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || event_type || lpad(event_id::VARCHAR, 12, '0') AS s FROM events) GROUP BY 1""")
def query_inventory(spark, sf):
    e = table(spark, sf, "events")
    return dedup.best_status(e, ["user_id"], dedup.status_rank(F.col("event_type"), _STATUS), "ts", ["event_type", "event_id"])


@query("""SELECT user_id, event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def inventory_counters(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("""
WITH a AS (SELECT qid AS id, label FROM value_labels), b AS (SELECT DISTINCT 'Q' || regexp_extract(class_id, '([0-9]+)', 1) AS id, 'class' AS label FROM class_resolution_map)
SELECT id, label FROM a UNION ALL SELECT id, label FROM b WHERE id NOT IN (SELECT id FROM a)""")
def catalogue_merge(spark, sf):
    a = table(spark, sf, "value_labels").select(F.col("qid").alias("id"), "label")
    b = table(spark, sf, "class_resolution_map").select(F.concat(F.lit("Q"), F.regexp_extract("class_id", r"([0-9]+)", 1)).alias("id"), F.lit("class").alias("label")).distinct()
    return dedup.merge_by_priority(["id"], a, b)


# ---------------------------------------------------------------- alignment


@query("""
WITH d AS (SELECT DISTINCT alignment_unit_id AS id, lower(trim(label_wikidata, ' ')) AS label FROM aligned WHERE trim(label_wikidata) <> '')
SELECT label, min(id) AS id FROM d GROUP BY 1 HAVING count(DISTINCT id) = 1""")
def unique_label_match(spark, sf):
    d = table(spark, sf, "aligned").select(F.col("alignment_unit_id").alias("id"), F.lower(F.trim("label_wikidata")).alias("label"))
    return align.unique_index(d, "label", "id")


_SIDES = """
WITH l AS (SELECT DISTINCT alignment_unit_id AS lid, lower(trim(label_fernsehserien_de, ' ')) AS label, lower(trim(program_name)) || '|' || left(lower(trim(label_fernsehserien_de, ' ')), 4) AS scene FROM aligned WHERE trim(label_fernsehserien_de) <> '' AND (label_zdf IS NULL OR label_zdf = '')),
r AS (SELECT DISTINCT alignment_unit_id AS rid, lower(trim(label_zdf, ' ')) AS label, lower(trim(program_name)) || '|' || left(lower(trim(label_zdf, ' ')), 4) AS scene FROM aligned WHERE trim(label_zdf) <> '' AND (label_fernsehserien_de IS NULL OR label_fernsehserien_de = ''))
"""


def _sides(spark, sf):
    a = table(spark, sf, "aligned")
    side = lambda mine, other, i: a.where(f"trim(label_{mine}) <> '' AND (label_{other} IS NULL OR label_{other} = '')").select(
        F.col("alignment_unit_id").alias(i), F.lower(F.trim(f"label_{mine}")).alias("label"),
        F.concat(F.lower(F.trim("program_name")), F.lit("|"), F.left(F.lower(F.trim(f"label_{mine}")), F.lit(4))).alias("scene"),
    ).distinct()
    return side("fernsehserien_de", "zdf", "lid"), side("zdf", "fernsehserien_de", "rid")


@query(_SIDES + """
, t1 AS (SELECT label, min(rid) AS rid FROM r WHERE label IS NOT NULL GROUP BY 1), t2 AS (SELECT scene, min(rid) AS rid FROM r WHERE scene IS NOT NULL GROUP BY 1),
m AS (SELECT l.lid, min(t1.rid) AS r1, min(t2.rid) AS r2 FROM l LEFT JOIN t1 USING (label) LEFT JOIN t2 USING (scene) GROUP BY 1),
o AS (SELECT lid, coalesce(r1, r2) AS rid, CASE WHEN r1 IS NOT NULL THEN 'label' WHEN r2 IS NOT NULL THEN 'scene' ELSE 'unresolved' END AS tier, CASE WHEN r1 IS NOT NULL THEN 0.95e0 WHEN r2 IS NOT NULL THEN 0.83e0 ELSE 0e0 END AS confidence FROM m)
SELECT * FROM o UNION ALL SELECT DISTINCT NULL, rid, 'unresolved', 0e0 FROM r WHERE rid NOT IN (SELECT rid FROM o WHERE rid IS NOT NULL)""")
def cascade_alignment(spark, sf):
    left, right = _sides(spark, sf)
    return align.cascade(left, right, [("label", "label", 0.95), ("scene", "scene", 0.83)])


@query(_SIDES + """
, a AS (SELECT label, lid, row_number() OVER (PARTITION BY label ORDER BY lid) AS n FROM l), b AS (SELECT label, rid, row_number() OVER (PARTITION BY label ORDER BY rid) AS n FROM r)
SELECT lid, rid FROM a JOIN b USING (label, n)""")
def greedy_one_to_one(spark, sf):
    left, right = _sides(spark, sf)
    return align.one_to_one(left, right, "label", "lid", "rid")


@query("""
WITH m AS (SELECT DISTINCT alignment_unit_id AS mention, lower(trim(label_zdf, ' ')) AS signature, entity_class AS mc FROM aligned WHERE trim(label_zdf) <> ''),
c AS (SELECT DISTINCT wikidata_id AS candidate, entity_class AS cc, unnest(string_split(lower(trim(label_wikidata, ' ')) || coalesce('|' || lower(alias_wikidata), ''), '|')) AS signature FROM aligned WHERE trim(wikidata_id) <> '' AND trim(label_wikidata) <> '')
SELECT DISTINCT mention, candidate FROM m JOIN c USING (signature) WHERE mc = cc""")
def signature_join_scoped(spark, sf):
    a = table(spark, sf, "aligned")
    m = a.where("trim(label_zdf) <> ''").select(F.col("alignment_unit_id").alias("mention"), F.lower(F.trim("label_zdf")).alias("signature"), F.col("entity_class").alias("mc")).distinct()
    c = a.where("trim(wikidata_id) <> '' AND trim(label_wikidata) <> ''").select(
        F.col("wikidata_id").alias("candidate"), F.col("entity_class").alias("cc"), F.split(F.concat_ws("|", F.lower(F.trim("label_wikidata")), F.lower("alias_wikidata")), r"\|").alias("signatures")
    )
    return align.signature_join(m, c, F.col("mc") == F.col("cc"))


@query(_SIDES + """
, f AS (SELECT lid AS mention, min(rid) AS candidate, 'graph' AS stage FROM l JOIN r USING (label) GROUP BY 1),
s AS (SELECT lid AS mention, min(rid) AS candidate, 'fallback' AS stage FROM l JOIN r USING (scene) GROUP BY 1)
SELECT * FROM f UNION ALL SELECT * FROM s WHERE (mention, candidate) NOT IN (SELECT mention, candidate FROM f)""")
def stage_merge(spark, sf):
    left, right = _sides(spark, sf)
    stage = lambda k, s: left.join(right, k).groupBy(F.col("lid").alias("mention")).agg(F.min("rid").alias("candidate")).withColumn("stage", F.lit(s))
    return align.stage_merge(stage("label", "graph"), stage("scene", "fallback"), ["mention", "candidate"])


@query("""
WITH q AS (SELECT DISTINCT split_part(lower(trim(label_wikidata, ' ')), ' ', 1) AS query FROM aligned WHERE trim(label_wikidata) <> ''),
l AS (SELECT qid AS id, lower(label) AS label FROM value_labels UNION SELECT wikidata_id, lower(trim(label_wikidata, ' ')) FROM aligned WHERE trim(wikidata_id) <> '' AND trim(label_wikidata) <> ''),
h AS (SELECT DISTINCT query, id, label = query AS exact FROM q JOIN l ON starts_with(l.label, q.query) WHERE query <> ''),
e AS (SELECT query, max(exact) AS e FROM h GROUP BY 1)
SELECT query, id, CASE WHEN exact THEN 'exact' ELSE 'prefix' END AS match FROM h JOIN e USING (query) WHERE exact = e""")
def ranked_prefix_search(spark, sf):
    a = table(spark, sf, "aligned")
    lab = F.lower(F.trim("label_wikidata"))
    q = a.where("trim(label_wikidata) <> ''").select(F.split(lab, " ")[0].alias("query")).where("query <> ''").distinct()
    own = a.where("trim(wikidata_id) <> '' AND trim(label_wikidata) <> ''").select(F.col("wikidata_id").alias("id"), lab.alias("label"))
    labels = table(spark, sf, "value_labels").select(F.col("qid").alias("id"), F.lower("label").alias("label")).union(own).distinct()
    return align.ranked_prefix(q, labels)


@query(_SQL + """
, r AS (SELECT guest, arg_min(role, (CASE role WHEN 'presenter' THEN 0 WHEN 'moderator' THEN 1 WHEN 'guest' THEN 2 ELSE 9 END) || role) AS role FROM app GROUP BY 1),
c AS (SELECT guest, count(DISTINCT episode) AS episodes FROM gu GROUP BY 1)
SELECT per.guest, per.label, per.qid, r.role, coalesce(c.episodes, 0) AS episodes FROM per LEFT JOIN r USING (guest) LEFT JOIN c USING (guest)""")
def person_catalogue(spark, sf):
    p = persons(spark, sf).select("guest", "label", "qid")
    return p.join(dominant_role(spark, sf), "guest", "left").join(appearance_counts(spark, sf), "guest", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))


@query("""
WITH g AS (SELECT DISTINCT fernsehserien_de_id AS programme, episode_url, lower(trim(guest_name, ' ')) AS name, guest_role FROM episode_guests_normalized WHERE episode_url <> '' AND trim(guest_name) <> ''),
a AS (SELECT DISTINCT fernsehserien_de_id AS episode_url, canonical_entity_id AS guest, lower(trim(canonical_label, ' ')) AS name FROM episode_appearances WHERE fernsehserien_de_id <> '' AND canonical_entity_id <> '')
SELECT a.episode_url, a.guest, g.guest_role FROM a LEFT JOIN g USING (episode_url, name)""")
def raw_role_join(spark, sf):
    g = table(spark, sf, "episode_guests_normalized").where("episode_url <> '' AND trim(guest_name) <> ''").select(F.col("fernsehserien_de_id").alias("programme"), "episode_url", F.lower(F.trim("guest_name")).alias("name"), "guest_role").distinct()
    a = table(spark, sf, "episode_appearances").where("fernsehserien_de_id <> '' AND canonical_entity_id <> ''")
    a = a.select(F.col("fernsehserien_de_id").alias("episode_url"), F.col("canonical_entity_id").alias("guest"), F.lower(F.trim("canonical_label")).alias("name")).distinct()
    return a.join(g, ["episode_url", "name"], "left").select("episode_url", "guest", "guest_role")


@query("""SELECT DISTINCT d.canonical_entity_id AS guest, d.wikidata_id AS qid, coalesce(v.label, d.canonical_label, d.wikidata_id) AS label FROM dedup_persons d LEFT JOIN value_labels v ON v.qid = d.wikidata_id""")
def label_backfill(spark, sf):
    v = table(spark, sf, "value_labels").select(F.col("qid").alias("vq"), F.col("label").alias("vl"))
    d = table(spark, sf, "dedup_persons").join(v, F.col("wikidata_id") == F.col("vq"), "left")
    return d.select(F.col("canonical_entity_id").alias("guest"), F.col("wikidata_id").alias("qid"), F.coalesce("vl", "canonical_label", "wikidata_id").alias("label")).distinct()


@query(_SQL + """
, x AS (SELECT guest, birthplace AS a FROM per WHERE birthplace IS NOT NULL), y AS (SELECT DISTINCT guest, programme AS b FROM gu)
SELECT a, b, count(DISTINCT guest) AS persons FROM x JOIN y USING (guest) GROUP BY 1, 2""")
def cooccurrence_cross_property(spark, sf):
    x = persons(spark, sf).where("birthplace IS NOT NULL").select("guest", F.col("birthplace").alias("a"))
    return x.join(guests(spark, sf).select("guest", F.col("programme").alias("b")).distinct(), "guest").groupBy("a", "b").agg(F.count_distinct("guest").alias("persons"))


# ---------------------------------------------------------------- graph

_EDGE = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'Q' || regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) AS c, 'Q' || regexp_extract(resolved_core_class_id, '[Qq]\\s*0*([0-9]+)', 1) AS p
  FROM class_resolution_map WHERE regexp_extract(class_id, '[Qq]\\s*0*([0-9]+)', 1) <> '' AND regexp_extract(coalesce(resolved_core_class_id, ''), '[Qq]\\s*0*([0-9]+)', 1) <> '')
"""


def _edges(spark, sf):
    d = table(spark, sf, "class_resolution_map").select(H.q_number(F.col("class_id")).alias("c"), H.q_number(F.col("resolved_core_class_id")).alias("p"))
    return d.where("c IS NOT NULL AND p IS NOT NULL").distinct()


@query(_EDGE + """
, w AS (SELECT c AS node, p AS ancestor, 1 AS depth FROM e UNION SELECT w.node, e.p, w.depth + 1 FROM w JOIN e ON e.c = w.ancestor WHERE w.depth < 8)
SELECT node, ancestor, min(depth)::BIGINT AS depth FROM w GROUP BY 1, 2""")
def class_closure(spark, sf):
    return graph.closure(_edges(spark, sf), "c", "p", 8)


@query(_EDGE + """
, w AS (SELECT c AS node, p AS ancestor, 1 AS depth FROM e UNION SELECT w.node, e.p, w.depth + 1 FROM w JOIN e ON e.c = w.ancestor WHERE w.depth < 8),
m AS (SELECT node, ancestor, min(depth) AS depth FROM w WHERE ancestor IN (SELECT class_id FROM core_classes) GROUP BY 1, 2)
SELECT node, arg_min(ancestor, lpad(depth::VARCHAR, 3, '0') || ancestor) AS core_class, min(depth)::BIGINT AS depth, count(*) AS candidates, count(*) > 1 AS conflict,
       string_agg(ancestor || ':' || depth, '|' ORDER BY depth, ancestor) AS candidate_paths FROM m GROUP BY 1""")
def class_resolution(spark, sf):
    core = table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("ancestor"))
    m = graph.closure(_edges(spark, sf), "c", "p", 8).join(core, "ancestor", "left_semi")
    g = m.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))).alias("s"))  # as many as there are core classes
    return g.select(
        "node", F.col("s")[0].ancestor.alias("core_class"), F.col("s")[0].depth.alias("depth"), F.size("s").cast("long").alias("candidates"), (F.size("s") > 1).alias("conflict"),
        F.array_join(F.transform("s", lambda x: F.concat(x.ancestor, F.lit(":"), x.depth.cast("string"))), "|").alias("candidate_paths"),
    )


@query(_EDGE + """
, w AS (SELECT c AS node, p AS ancestor FROM e UNION SELECT w.node, e.p FROM w JOIN e ON e.c = w.ancestor),
d AS (SELECT p AS node, count(*) AS n FROM e GROUP BY 1),
u AS (SELECT w.ancestor AS node, sum(d.n) AS below FROM w JOIN d USING (node) GROUP BY 1)
SELECT node, coalesce(d.n, 0)::BIGINT AS n_direct, (coalesce(d.n, 0) + coalesce(u.below, 0))::BIGINT AS n_total FROM d FULL JOIN u USING (node)""")
def propagated_counts(spark, sf):
    """Own count and that of all descendants, however deep."""
    e = _edges(spark, sf)
    return graph.propagated_counts(e, "c", "p", e.groupBy(F.col("p").alias("node")).agg(F.count("*").alias("n")))


@query(_EDGE + """
, b AS (SELECT c AS x, p AS y FROM e UNION SELECT p, c FROM e),
w AS (SELECT class_id AS node, 0 AS hop FROM core_classes UNION SELECT b.y, w.hop + 1 FROM w JOIN b ON b.x = w.node WHERE w.hop < 3)
SELECT node, min(hop)::BIGINT AS hop FROM w GROUP BY 1 HAVING min(hop) > 0""")
def n_hop_degree(spark, sf):
    return graph.hops(_edges(spark, sf), "c", "p", table(spark, sf, "core_classes").select(H.q_number(F.col("class_id")).alias("node")), 3)


@query(_EDGE + """
, o AS (SELECT c AS node, count(*) AS n_out, 0 AS n_in FROM e GROUP BY 1 UNION ALL SELECT p, 0, count(*) FROM e GROUP BY 1)
SELECT node, sum(n_out)::BIGINT AS n_out, sum(n_in)::BIGINT AS n_in FROM o GROUP BY 1""")
def adjacency(spark, sf):
    return graph.adjacency(_edges(spark, sf), "c", "p")


@query(_EDGE + """
, w AS (SELECT c AS node, p AS ancestor FROM e UNION SELECT w.node, e.p FROM w JOIN e ON e.c = w.ancestor)
SELECT DISTINCT node FROM w WHERE node = ancestor""")
def loop_members(spark, sf):
    """Classes on loops of any length."""
    return graph.loop_members(_edges(spark, sf), "c", "p")


@query(_EDGE + """
, n AS (SELECT c AS id FROM e UNION SELECT p FROM e), ch AS (SELECT DISTINCT p AS id FROM e), pa AS (SELECT DISTINCT c AS id FROM e)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM pa) THEN 'top' WHEN id IN (SELECT id FROM ch) THEN 'mid' ELSE 'first' END AS level FROM n""")
def class_levels(spark, sf):
    a = graph.adjacency(_edges(spark, sf), "c", "p")
    return a.select(F.col("node").alias("id"), F.when(F.col("n_out") == 0, "top").when(F.col("n_in") > 0, "mid").otherwise("first").alias("level"))


def _triples(spark, sf):
    """(subject, predicate, object) of appearances and places: guest, programme and birthplace as a small knowledge graph."""
    g = guests(spark, sf)
    seen = g.select(F.col("guest").alias("subject"), F.lit("appears_in").alias("predicate"), F.col("programme").alias("object"))
    born = persons(spark, sf).where("birthplace IS NOT NULL").select(F.col("guest").alias("subject"), F.lit("born_in").alias("predicate"), F.col("birthplace").alias("object"))
    return seen.unionByName(born).distinct()


_TRIPLES = _SQL + ", t AS (SELECT DISTINCT guest AS subject, 'appears_in' AS predicate, programme AS object FROM gu UNION SELECT guest, 'born_in', birthplace FROM per WHERE birthplace IS NOT NULL)"


@query(_TRIPLES + "SELECT subject, predicate, object FROM t")
def triples(spark, sf):
    return _triples(spark, sf)


@query(_TRIPLES + """
SELECT * FROM t WHERE NOT (predicate = 'born_in' AND object LIKE 'A%') UNION SELECT programme, 'part_of', 'broadcast' FROM gu""")
def rewired_edges(spark, sf):
    t = _triples(spark, sf)
    rules = t.where("predicate = 'born_in' AND object LIKE 'A%'").withColumn("rule", F.lit("remove"))
    rules = rules.unionByName(guests(spark, sf).select(F.col("programme").alias("subject"), F.lit("part_of").alias("predicate"), F.lit("broadcast").alias("object"), F.lit("add").alias("rule")).distinct())
    return graph.rewire(t, rules)


@query(_SQL.replace("WITH a0", "WITH RECURSIVE a0") + """
, s AS (SELECT guest FROM per WHERE birthplace LIKE 'Ober%'), x AS (SELECT DISTINCT guest, programme FROM gu),
w AS (SELECT guest AS entity, 0 AS k FROM s UNION SELECT y.b, w.k + 1 FROM w JOIN (SELECT guest AS a, programme AS b FROM x UNION ALL SELECT programme, guest FROM x) y ON y.a = w.entity WHERE w.k < 6)
SELECT entity, min(k)::BIGINT AS round FROM w GROUP BY 1""")
def relevancy_propagation(spark, sf):
    """Relevance from some guests to their shows and on to those shows' guests, until a round adds none; on these tables the third already does not."""
    seeds = persons(spark, sf).where("birthplace LIKE 'Ober%'").select(F.col("guest").alias("entity"))
    none = F.lit(None).cast("string")
    rules = spark.range(1).select(F.lit("appears_in").alias("predicate"), none.alias("subject_class"), none.alias("object_class"))
    classes = seeds.limit(0).withColumn("class", none)
    return graph.propagate_relevance(_triples(spark, sf), seeds, rules, classes, both_ways=True).select("entity", "round")


@query(_TRIPLES + """
, p AS (SELECT subject FROM t WHERE predicate = 'appears_in' GROUP BY 1), b AS (SELECT subject FROM t WHERE predicate = 'born_in' GROUP BY 1),
x AS (SELECT subject FROM t WHERE predicate = 'born_in' AND object = 'Ellerroda')
SELECT DISTINCT subject AS candidate, (subject IN (SELECT subject FROM p) AND subject IN (SELECT subject FROM b) AND subject NOT IN (SELECT subject FROM x)) AS allowed FROM t""")
def rule_groups(spark, sf):
    facts = _triples(spark, sf).withColumnRenamed("subject", "candidate")
    rules = spark.createDataFrame([("permit", 1, "appears_in", "*"), ("permit", 1, "born_in", "*"), ("exclude", 2, "born_in", "Ellerroda")], "rule_type string, group_id int, predicate string, object string")
    return graph.rule_groups(facts, rules)


@query(_SQL + """
SELECT DISTINCT p.birthplace AS subject_class, 'appears_in' AS predicate, g.programme AS object_class FROM gu g JOIN per p USING (guest) WHERE p.birthplace IS NOT NULL""")
def relation_contexts(spark, sf):
    t = _triples(spark, sf).where("predicate = 'appears_in'").join(persons(spark, sf).select(F.col("guest").alias("subject"), "birthplace"), "subject")
    return t.where("birthplace IS NOT NULL").select(F.col("birthplace").alias("subject_class"), "predicate", F.col("object").alias("object_class")).distinct()


@query("""
WITH k AS (SELECT DISTINCT id FROM entity_store_jsonl WHERE id <> ''),
r AS (SELECT DISTINCT alignment_unit_id AS owner, wikidata_id AS qid FROM aligned WHERE trim(wikidata_id) <> ''
      UNION SELECT DISTINCT class_id, 'Q' || regexp_extract(resolved_core_class_id, '[Qq]\\s*0*([0-9]+)', 1) FROM class_resolution_map WHERE regexp_extract(coalesce(resolved_core_class_id, ''), '[Qq]\\s*0*([0-9]+)', 1) <> '')
SELECT qid, count(*) AS n_refs FROM r WHERE qid NOT IN (SELECT id FROM k) GROUP BY 1""")
def hydration_gaps(spark, sf):
    """Ids that units and classes refer to but that have no document."""
    a = table(spark, sf, "aligned").where("trim(wikidata_id) <> ''").select(F.col("alignment_unit_id").alias("owner"), F.col("wikidata_id").alias("qid"))
    c = table(spark, sf, "class_resolution_map").select(F.col("class_id").alias("owner"), H.q_number(F.col("resolved_core_class_id")).alias("qid")).where("qid IS NOT NULL")
    have = table(spark, sf, "entity_store_jsonl").where("id <> ''").select(F.col("id").alias("qid")).distinct()
    return a.union(c).distinct().join(have, "qid", "left_anti").groupBy("qid").agg(F.count("*").alias("n_refs"))


@query("""
WITH d AS (SELECT DISTINCT class_id, candidate_core_class_ids AS c, conflict_flag, resolution_depth FROM class_resolution_map)
SELECT c AS candidates, count(*) AS classes, count(*) FILTER (WHERE conflict_flag) AS conflicts, median(resolution_depth)::DOUBLE AS median_depth, max(resolution_depth) AS max_depth,
       array_to_string(list_slice(list_sort(list(DISTINCT class_id)), 1, 5), '|') AS examples FROM d WHERE conflict_flag GROUP BY 1""")
def conflict_patterns(spark, sf):
    d = table(spark, sf, "class_resolution_map").select("class_id", F.col("candidate_core_class_ids").alias("candidates"), "conflict_flag", "resolution_depth").distinct().where("conflict_flag")
    first = stats.top_per_group(d.select("candidates", "class_id").distinct(), "candidates", ["class_id"], 5)
    five = first.groupBy("candidates").agg(F.array_join(F.array_sort(F.collect_list("class_id")), "|").alias("examples"))  # five at most
    g = d.groupBy("candidates").agg(F.count("*").alias("classes"), F.count_if("conflict_flag").alias("conflicts"), F.median("resolution_depth").alias("median_depth"), F.max("resolution_depth").alias("max_depth"))
    return g.join(five, g.candidates.eqNullSafe(five.candidates)).drop(five.candidates)


# ---------------------------------------------------------------- scalar functions


@query(f"""
WITH d AS (SELECT DISTINCT canonical_label AS label FROM dedup_persons WHERE canonical_label IS NOT NULL)
SELECT label, {_NAMEKEY.format("label")} AS name_key,
       list_aggregate(list_transform(list_filter(regexp_split_to_array(trim(label, ' '), '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: left(x, 1) || lower(substr(x, 2))), 'string_agg', ' ') AS mixed_case,
       'pm_' || left(sha1(label || '|x'), 12) AS id FROM d""")
def name_functions(spark, sf):
    d = table(spark, sf, "dedup_persons").where("canonical_label IS NOT NULL").select(F.col("canonical_label").alias("label")).distinct()
    return d.select("label", C.name_key(F.col("label")).alias("name_key"), C.fix_mixed_case(F.col("label")).alias("mixed_case"), C.stable_id("pm", F.col("label"), F.lit("x")).alias("id"))


@query("""
WITH d AS (SELECT DISTINCT guest_role AS x FROM episode_guests_normalized WHERE guest_role IS NOT NULL)
SELECT x, lower(regexp_replace(trim(x), '[ \\t\\r\\n]+', ' ', 'g')) AS squeezed, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       trim(regexp_replace(lower(x), '[^a-z0-9_äöüßáàâéèêíóúñç]+', ' ', 'g')) AS words FROM d""")
def text_functions(spark, sf):
    d = table(spark, sf, "episode_guests_normalized").where("guest_role IS NOT NULL").select(F.col("guest_role").alias("x")).distinct()
    return d.select("x", C.squeeze(F.col("x")).alias("squeezed"), C.slug(F.col("x")).alias("slug"), C.normalize_words(F.col("x")).alias("words"))


@query("""
WITH d AS (SELECT DISTINCT episode_date AS raw FROM aligned WHERE episode_date IS NOT NULL)
SELECT raw, coalesce(CASE WHEN regexp_matches(raw, '^[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}$') THEN try_strptime(raw, '%d.%m.%Y') END,
                     CASE WHEN regexp_matches(raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(raw, '%Y-%m-%d') END)::DATE AS day FROM d""")
def parse_dates(spark, sf):
    return table(spark, sf, "aligned").where("episode_date IS NOT NULL").select(F.col("episode_date").alias("raw"), C.parse_date(F.col("episode_date")).alias("day")).distinct()


@query("""SELECT DISTINCT birthyear AS raw, try_cast(nullif(regexp_extract(birthyear, '([0-9]{4})', 1), '') AS INT) AS birth_year FROM dedup_persons WHERE birthyear IS NOT NULL""")
def parse_years(spark, sf):
    return table(spark, sf, "dedup_persons").where("birthyear IS NOT NULL").select(F.col("birthyear").alias("raw"), C.year_of(F.col("birthyear")).alias("birth_year")).distinct()


@query("""
WITH e AS (SELECT event_id, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events),
f AS (SELECT event_id, start_ts, date_trunc('day', start_ts) + (nxt - date_trunc('day', nxt)) AS end_ts FROM e WHERE nxt IS NOT NULL)
SELECT event_id, CASE WHEN end_ts <= start_ts THEN end_ts + INTERVAL 1 DAY ELSE end_ts END AS end_ts, end_ts <= start_ts AS spans_next_day FROM f""")
def rollover_times(spark, sf):
    """An event ends at the clock time of the user's next one; where that is not later in the day, on the day after."""
    e = table(spark, sf, "events").withColumn("nxt", F.lead("ts").over(Window.partitionBy("user_id").orderBy("event_id"))).where("nxt IS NOT NULL")
    e = e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("s"), (F.date_trunc("day", "ts").cast("timestamp_ntz") + (F.col("nxt") - F.date_trunc("day", "nxt"))).cast("timestamp_ntz").alias("e"))
    return e.select("event_id", C.end_with_rollover(F.col("s"), F.col("e")).alias("end_ts"), (F.col("e") <= F.col("s")).alias("spans_next_day"))


@query("""
SELECT DISTINCT fernsehserien_de_id AS raw, regexp_replace(fernsehserien_de_id, '#.*$', '') AS canonical,
  trim(regexp_replace(regexp_replace(lower(trim(fernsehserien_de_id)), '[?#].*$', ''), '^([a-z][a-z0-9+.-]*:)?//[^/]*', ''), '/') AS path FROM episode_appearances WHERE fernsehserien_de_id IS NOT NULL""")
def canonical_urls(spark, sf):
    u = F.col("fernsehserien_de_id")
    return table(spark, sf, "episode_appearances").where(u.isNotNull()).select(u.alias("raw"), C.canonical_url(u, "https://fs.example").alias("canonical"), C.url_path(u).alias("path")).distinct()


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM documents""")
def page_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.strip_html(F.col("text")).alias("plain"))


@query("""
WITH d AS (SELECT DISTINCT fernsehserien_de_id AS url FROM episode_appearances WHERE fernsehserien_de_id IS NOT NULL)
SELECT f.url, regexp_replace(f.url, '#.*$', '') AS target, CASE WHEN c.url IS NULL THEN 'promoted' ELSE 'duplicate_removed' END AS action
FROM d f LEFT JOIN d c ON c.url = regexp_replace(f.url, '#.*$', '') WHERE f.url LIKE '%#%'""")
def fragment_manifest(spark, sf):
    d = table(spark, sf, "episode_appearances").where("fernsehserien_de_id IS NOT NULL").select(F.col("fernsehserien_de_id").alias("url")).distinct()
    f = d.where("url LIKE '%#%'").withColumn("target", F.regexp_replace("url", r"#.*$", ""))
    c = d.select(F.col("url").alias("target"), F.lit(True).alias("there"))
    return f.join(c, "target", "left").select("url", "target", F.when(F.col("there").isNull(), "promoted").otherwise("duplicate_removed").alias("action"))


# ---------------------------------------------------------------- event log


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def events_latest_per_key(spark, sf):
    return events.latest_per_key(table(spark, sf, "events"), ["user_id"], "event_id", ["event_id", "event_type"])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000")
def events_since(spark, sf):
    return events.since(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id", 5000)


@query("SELECT (event_id // 500)::BIGINT AS chunk, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS events, min(ts) AS opened, max(ts) AS closed FROM events GROUP BY 1")
def chunk_catalog(spark, sf):
    return events.chunk_catalog(table(spark, sf, "events"), "event_id", F.floor(F.col("event_id") / 500).cast("long"), "ts")


_OW = """
WITH n AS (SELECT *, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50)::BIGINT AS window_no FROM events),
w AS (SELECT event_type, window_no, count(*) AS calls, count(*) FILTER (WHERE value > 100) AS large, min(event_id) AS first_seq, max(event_id) AS last_seq FROM n GROUP BY 1, 2)
"""


def _windows(spark, sf):
    return events.ordinal_windows(table(spark, sf, "events"), ["event_type"], "event_id", 50, {"large": F.col("value") > 100})


@query(_OW + "SELECT * FROM w")
def ordinal_windows(spark, sf):
    return _windows(spark, sf)


@query(_OW + """
, b AS (SELECT event_type, window_no, large > 10 AS bad FROM w),
i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY window_no) - row_number() OVER (PARTITION BY event_type, bad ORDER BY window_no) AS island FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, bad, island ORDER BY window_no) AS run FROM i)
SELECT event_type, window_no, round(exp(sum(ln(CASE WHEN run % 3 <> 0 THEN 1e0 WHEN bad THEN 1.05e0 ELSE 0.99e0 END)) OVER (PARTITION BY event_type ORDER BY window_no)), 6) AS delay FROM k""")
def adaptive_delay(spark, sf):
    return events.adaptive_delay(_windows(spark, sf), ["event_type"], F.col("large") > 10, 3).select("event_type", "window_no", "delay")


@query("""
WITH l AS (SELECT discovered_at_utc AS t, id, length(labels) AS n, labels FROM entity_store_jsonl WHERE id <> '')
SELECT id, min(t) AS first_seen, max(t) AS last_seen, count(DISTINCT t) AS versions, max({'t': t, 'd': labels}).d AS labels FROM l WHERE t IS NOT NULL GROUP BY 1""")
def upsert_history(spark, sf):
    e = table(spark, sf, "entity_store_jsonl").where("id <> '' AND discovered_at_utc IS NOT NULL").withColumn("seq", F.col("discovered_at_utc"))
    return events.upsert_history(e, ["id"], "seq", "discovered_at_utc", "labels")


@query("""
WITH w AS (SELECT event_id AS seq, user_id FROM events WHERE event_type = 'view'), r AS (SELECT user_id, min(event_id) AS ready FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT w.seq, w.user_id, CASE WHEN ready IS NOT NULL THEN greatest(seq, ready) END AS released_at FROM w LEFT JOIN r USING (user_id)""")
def pending_ready(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    return events.pending_until_ready(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'purchase'"), "user_id")


@query("SELECT user_id, min(event_id) AS since FROM events WHERE value > 150 GROUP BY 1")
def monotone_flag(spark, sf):
    return events.monotone_flag(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 150)


@query("""SELECT DISTINCT source_discovered_sequence AS seq FROM episode_guests_normalized WHERE source_discovered_sequence IS NOT NULL AND source_discovered_sequence NOT IN (SELECT source_event_sequence FROM episode_guests_normalized WHERE source_event_sequence IS NOT NULL)""")
def emit_once(spark, sf):
    g = table(spark, sf, "episode_guests_normalized")
    a = g.where("source_discovered_sequence IS NOT NULL").select(F.col("source_discovered_sequence").alias("seq")).distinct()
    return events.emit_once(a, g.select(F.col("source_event_sequence").alias("seq")).where("seq IS NOT NULL"), "seq")


@query("""
WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type, count(*) AS n, max(ts) AS latest FROM events, m WHERE ts > t - INTERVAL 1 HOUR GROUP BY 1""")
def recent_activity(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("t"))
    return e.crossJoin(F.broadcast(newest)).where("ts > t - INTERVAL 1 HOUR").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))  # newest is one row


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2""")
def hourly_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("events"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""")
def stream_projection(spark, sf):
    """The fold of the event log by Structured Streaming, micro-batch by micro-batch."""
    import uuid

    from ..session import scratch_dir
    from ..streaming import projections as S

    src = table(spark, sf, "events")
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:10]}"
    materialized = f"{base}/log"
    src.repartition(4).write.parquet(materialized)
    stream = S.event_stream(spark, materialized, src.schema, files_per_batch=2)
    S.run_now(stream, S.fold_latest(f"{base}/table", ["user_id"], "event_id", ["event_id", "event_type"]), f"{base}/checkpoint")
    return S.newest_version(spark, f"{base}/table")


# ---------------------------------------------------------------- gates


@query("""
WITH d AS (SELECT * FROM aligned)
SELECT 'has class' AS gate, count(*) FILTER (WHERE NOT coalesce(trim(entity_class) <> '', false)) AS failures FROM d
UNION ALL SELECT 'unresolved has code', count(*) FILTER (WHERE NOT coalesce(match_tier <> 'unresolved' OR trim(unresolved_reason_code) <> '', false)) FROM d
UNION ALL SELECT 'inferred has basis', count(*) FILTER (WHERE NOT coalesce(inference_flag <> 'true' OR trim(inference_basis) <> '', false)) FROM d
UNION ALL SELECT 'unique alignment_unit_id', (SELECT count(*) FROM (SELECT alignment_unit_id FROM d GROUP BY 1 HAVING count(*) > 1))""")
def quality_gates(spark, sf):
    f = lambda c: F.trim(c) != ""
    return gates.gates(table(spark, sf, "aligned"), "alignment_unit_id", {
        "has class": f("entity_class"), "unresolved has code": (F.col("match_tier") != "unresolved") | f("unresolved_reason_code"),
        "inferred has basis": (F.col("inference_flag") != "true") | f("inference_basis"),
    })


_TABLES = [
    "aligned", "class_resolution_map", "core_classes", "customer", "dedup_persons", "doc_labels", "documents", "embeddings", "entity_store_jsonl", "episode_appearances",
    "episode_guests_normalized", "eval_items", "events", "lineitem", "nation", "orders", "part", "region", "subject_areas", "supplier", "value_labels",
]


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, (SELECT count(*) FROM {t}) AS \"rows\", count(*) AS columns, array_to_string(list_slice(list_sort(list(column_name)), 1, 8), ', ') AS first_columns FROM (DESCRIBE {t})" for t in _TABLES))
def source_inventory(spark, sf):
    """Rows, columns and first columns of every table."""
    return gates.inventory({k: table(spark, sf, k) for k in _TABLES})


@query("""
WITH c AS (SELECT class_id, resolved_core_class_id, resolution_depth, resolution_reason, conflict_flag, candidate_core_class_ids, candidate_paths_json, max_depth, resolved_at FROM class_resolution_map)
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS n_distinct, 9::BIGINT AS n_columns, true AS same_in_any_order FROM c""")
def signature_check(spark, sf):
    """The signature of a table is the same with rows and columns in another order, and another one if a row is missing."""
    d = table(spark, sf, "class_resolution_map")
    turned = d.select(*reversed(d.columns)).repartition(5)
    both = gates.signature(d).crossJoin(gates.signature(turned).toDF("rows_2", "signature_2"))  # one row each
    n = d.agg(F.count("*").alias("n_rows")).crossJoin(d.distinct().agg(F.count("*").alias("n_distinct")))
    return n.crossJoin(both).select("n_rows", "n_distinct", F.lit(len(d.columns)).cast("long").alias("n_columns"), (F.col("signature") == F.col("signature_2")).alias("same_in_any_order"))


@query(None)
def snapshot_signature(spark, sf):
    return gates.signature(table(spark, sf, "class_resolution_map"))


# ---------------------------------------------------------------- text extraction


@query("""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS sentences, s[1] AS first_sentence FROM s WHERE len(s) > 0""")
def text_blocks(spark, sf):
    s = F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", s.alias("s")).where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("sentences"), F.col("s")[0].alias("first_sentence"))


@query("""SELECT id, coalesce(nullif(CASE WHEN json_valid(labels) THEN json_extract_string(labels, '$.de.value') END, ''), nullif(CASE WHEN json_valid(labels) THEN json_extract_string(labels, '$.en.value') END, '')) AS label FROM entity_store_jsonl""")
def label_pick(spark, sf):
    g = lambda x: F.nullif(F.when(F.try_parse_json("labels").isNotNull(), F.get_json_object("labels", f"$.{x}.value")), F.lit(""))
    return table(spark, sf, "entity_store_jsonl").select("id", F.coalesce(g("de"), g("en")).alias("label"))


# ---------------------------------------------------------------- flagship


@query(_SQL + """
, s AS (SELECT programme, count(DISTINCT episode) AS episodes, count(*) AS appearances, count(DISTINCT guest) AS guests FROM gu GROUP BY 1),
g AS (SELECT programme, guest, count(*) AS n FROM gu GROUP BY 1, 2),
t AS (SELECT programme, arg_min(guest, lpad((100000000 - n)::VARCHAR, 9, '0') || guest) AS top_guest, max(n) AS top_n FROM g GROUP BY 1),
p AS (SELECT x.programme, count(*) AS pairs FROM gu x JOIN gu y ON x.episode = y.episode AND x.guest < y.guest GROUP BY 1)
SELECT s.programme, episodes, appearances, guests, top_guest, round(top_n * 100.0e0 / episodes, 2) AS top_share_pct, coalesce(pairs, 0) AS pairs FROM s JOIN t USING (programme) LEFT JOIN p USING (programme)""")
def show_overview(spark, sf):
    """Per programme: episodes, appearances, guests, its most frequent guest and how many pairs met in it."""
    g = materialize(guests(spark, sf), "guests")
    s = g.groupBy("programme").agg(F.count_distinct("episode").alias("episodes"), F.count("*").alias("appearances"), F.count_distinct("guest").alias("guests"))
    top = stats.best_by(g.groupBy("programme", "guest").agg(F.count("*").alias("n")), ["programme"], [-F.col("n"), F.col("guest")], ["guest", "n"])
    met = g.groupBy("programme", "episode").agg(F.count("*").alias("k")).groupBy("programme").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("pairs"))
    return s.join(top, "programme").join(met, "programme", "left").select(
        "programme", "episodes", "appearances", "guests", F.col("guest").alias("top_guest"), F.round(F.col("n") * 100.0 / F.col("episodes"), 2).alias("top_share_pct"), F.coalesce("pairs", F.lit(0)).alias("pairs")
    )


flagship = show_overview
