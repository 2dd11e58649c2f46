import pytest
from pyspark.sql import functions as F

from sendegraph.functions import columns as C
from sendegraph.functions import mentions as M
from sendegraph.operators import align, dedup, events, gates, graph, reshape, stats


def test_carrier_stats(spark):
    df = spark.createDataFrame([("a", "X", 1), ("a", "X", 1), ("b", "Y", 1), ("c", "", 1)], "c string, v string, n int")
    got = {r["value"]: tuple(r)[1:] for r in stats.carrier_stats(df, "v", "c", "n").collect()}
    assert got == {"X": (1, 2, 33.33, 50.0), "Y": (1, 1, 33.33, 25.0), stats.UNKNOWN: (1, 1, 33.33, 25.0)}
    assert stats.carrier_stats(df.limit(0), "v", "c", "n").count() == 0


def test_episode_stats(spark):
    df = spark.createDataFrame([("X", "e1", "a"), ("X", "e1", "b"), ("X", "e2", "a"), (None, "e3", "c")], "v string, e string, c string")
    r = stats.episode_stats(df, "v", "e", "c").first()
    assert (r["min_rows"], r["max_rows"], r["mean_rows"], r["std_rows"], r["median_rows"], r["pct_without"], r["total_rows"]) == (1, 2, 1.5, 0.5, 1.5, 33.33, 3)


def test_pareto(spark):
    df = spark.createDataFrame([(c,) for c, n in (("a", 5), ("b", 3), ("c", 2)) for _ in range(n)], "c string")
    assert [tuple(r) for r in stats.pareto(df, "c").orderBy("rank").collect()] == [("a", 5, 1, 5, 50.0), ("b", 3, 2, 8, 80.0), ("c", 2, 3, 10, 100.0)]


def test_keeper_split(spark):
    df = spark.createDataFrame([("e", "m1", ""), ("e", "m2", "Politiker"), ("e", "m3", "Autor")], "e string, id string, t string")
    assert {r["id"]: r["state"] for r in dedup.keeper_split(df, ["e"], "id", "t").collect()} == {"m1": "duplicate", "m2": "keeper", "m3": "kept"}


def test_tiered_clusters(spark):
    df = spark.createDataFrame([("1", "Q1", "A B"), ("2", "Q1", "C D"), ("3", None, "Karl Müller"), ("4", "", "karl MUELLER"), ("5", None, "E F"), ("6", "Q9", "G H")], "id string, q string, l string")
    manual = spark.createDataFrame([("6", "m"), ("7", "m")], "id string, manual_key string")
    got = {r["id"]: (r["tier"], r["cluster_size"]) for r in dedup.tiered_clusters(df, "id", "q", "l", manual).collect()}
    assert got == {"1": ("high", 2), "2": ("high", 2), "3": ("medium", 2), "4": ("medium", 2), "5": ("low", 1), "6": ("authoritative", 1)}


def test_best_status(spark):
    df = spark.createDataFrame([("h", "http_error", 1), ("h", "success", 2), ("h", "cache_hit", 3)], "h string, s string, t int")
    got = dedup.best_status(df, ["h"], dedup.status_rank(F.col("s"), {"success": 3, "cache_hit": 2, "http_error": 1}), "t", ["s"]).collect()
    assert [tuple(r) for r in got] == [("h", "success")]


def test_columns(spark):
    f = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert f(C.fix_mixed_case(F.lit("Elmar THEVEßEN"))) == "Elmar Theveßen" and f(C.fix_mixed_case(F.lit(None).cast("string"))) == ""
    assert f(C.name_key(F.lit("Elmar THEVEßEN"))) == f(C.name_key(F.lit("Elmar Thevessen"))) == "elmar thevessen"
    assert f(C.normalize_accents(F.lit("  Größe  É "))) == "große e" and f(C.normalize_words(F.lit("Markus Lanz!"))) == "markus lanz"
    assert [f(C.season_token(F.lit(x))) for x in ("Markus Lanz, Staffel 3", "3,0", "Staffel X")] == ["3", "3", "x"]
    assert [str(f(C.parse_date(F.lit(x)))) for x in ("31.02.2020", "01.02.2020", "2020-02-01")] == ["None", "2020-02-01", "2020-02-01"]
    assert [f(C.duration_minutes(F.lit(x))) for x in ("75 Min.", "31 minutes and 15 seconds", "45", "")] == [75.0, 31.25, 45.0, None]
    assert [f(C.age_at(F.lit(a), F.lit(b))) for a, b in ((1969, 2020), (1800, 2020))] == [51, None] and f(C.year_of(F.lit("+1969-03-16T00:00:00Z"))) == 1969
    assert f(C.canonical_url(F.lit("/x/folgen/1#Cast-Crew"), "https://h/")) == "https://h/x/folgen/1"
    assert f(C.url_path(F.lit("HTTPS://H.de/A/Folgen/1-x/?q=1#y"))) == "a/folgen/1-x"


def test_mentions(spark):
    got = list(M.persons("Markus LANZ mit Anna MEIER und ihre Mutter Eva MEIER (Ärztin)"))
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == [("Anna MEIER", "guest", "", "name_without_local_parenthetical", 0.55), ("Eva MEIER", "incidental", "Ärztin", "last_name_parenthetical", 0.82)]
    assert [(g[0], g[3], g[4]) for g in M.persons("Markus LANZ mit Anna MEIER (Ärztin)")] == [("Anna MEIER", "single_parenthetical", 0.95)]
    assert list(M.persons(None)) == []
    assert list(M.persons("x (" * 50_000)) == []
    text = "Publikation\n01.02.2020 23:15:00 75'30 12345/12345 ZDF\nArchivnummer 1"
    r = M.publication_rows(spark.createDataFrame([("e", text), ("f", None)], "k string, t string"), "k", "t").collect()
    assert len(r) == 1 and (r[0]["duration"], r[0]["prod_nr"], r[0]["program"], r[0]["is_primary"]) == ("75'30", "12345/12345", "ZDF", True)


def test_alignment(spark, rows):
    left = spark.createDataFrame([("l1", "a", "x"), ("l2", "b", "y"), ("l3", "c", None)], "lid string, label string, d string")
    right = spark.createDataFrame([("r1", "a", "q"), ("r2", "z", "y"), ("r3", "w", "w")], "rid string, label string, d string")
    assert rows(align.cascade(left, right, [("label", "label", 0.9), ("d", "date", 0.8)])) == sorted(
        [("l1", "r1", "label", 0.9), ("l2", "r2", "date", 0.8), ("l3", None, "unresolved", 0.0), (None, "r3", "unresolved", 0.0)], key=str)
    q = spark.createDataFrame([("an",), ("bo",)], "query string")
    lab = spark.createDataFrame([("1", "anna"), ("2", "an"), ("3", "bob"), ("4", "bo b")], "id string, label string")
    assert rows(align.ranked_prefix(q, lab)) == [("an", "2", "exact"), ("bo", "3", "prefix"), ("bo", "4", "prefix")]


def test_graph(spark, rows):
    e = spark.createDataFrame([("S", "A"), ("A", "B"), ("B", "C"), (None, "Z")], "a string, b string")
    seed = spark.createDataFrame([("S",)], "node string")
    assert rows(graph.hops(e, "a", "b", seed, 2)) == [("A", 1), ("B", 2)]
    assert rows(graph.connected_components(e.union(spark.createDataFrame([("X", "Y"), ("Y", "X")], "a string, b string")), "a", "b")) == [("A", "A"), ("B", "A"), ("C", "A"), ("S", "A"), ("X", "X"), ("Y", "X")]
    assert graph.connected_components(e.limit(0), "a", "b").count() == 0
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    assert ("a", "a", 3) in rows(graph.closure(ring, "a", "b", 9)) and graph.closure(ring, "a", "b", 9).count() == 9


def test_relevance(spark):
    t = spark.createDataFrame([("S", "P371", "A"), ("A", "P371", "B"), ("S", "P17", "C")], "subject string, predicate string, object string")
    seeds = spark.createDataFrame([("S",)], "entity string")
    rules = spark.createDataFrame([("P371", "person", None)], "predicate string, subject_class string, object_class string")
    none = spark.createDataFrame([], "entity string, class string")
    assert {r["entity"] for r in graph.propagate_relevance(t, seeds, rules, none).collect()} == {"S", "A", "B"}
    known = spark.createDataFrame([("A", "place")], "entity string, class string")
    assert {r["entity"] for r in graph.propagate_relevance(t, seeds, rules, known).collect()} == {"S", "A"}


def test_events_and_gates(spark, rows):
    e = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b"), ("v", 1, None)], "k string, seq int, d string")
    assert rows(events.latest_per_key(e, ["k"], "seq", ["seq", "d"])) == [("u", 3, "c"), ("v", 1, None)]
    w = events.ordinal_windows(e, ["k"], "seq", 2, {"c": F.col("d") == "c"})
    assert rows(w) == [("u", 0, 2, 0, 1, 2), ("u", 1, 1, 1, 3, 3), ("v", 0, 1, 0, 1, 1)]
    assert rows(gates.gates(e, "k", {"d filled": F.col("d").isNotNull()})) == [("d filled", 1), ("unique k", 1)]
    assert gates.same(e, e.select("d", "seq", "k").orderBy("d")) and not gates.same(e, e.limit(2))


def test_reshape(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, i int, v string")
    o = reshape.ordinal(df, ["k"], ["i"])
    assert rows(reshape.wide(o, "k", "ordinal", ["v"], 2)) == [("a", "y", "x"), ("b", None, None)]
    assert rows(reshape.long(df, "k", ["v"])) == [("a", "v", "x"), ("a", "v", "y")]
    assert reshape.ensure_columns(df, ["v", "z"]).columns == ["v", "z"] and reshape.top_columns(df, ["k"], 2).columns == ["k", "i"]
    assert {r["column_name"]: r["filled"] for r in reshape.population(df).collect()} == {"k": 3, "i": 3, "v": 2}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS seq", "id AS a", "id AS b").write.parquet(str(tmp_path / "e"))
    plan = events.since(spark.read.parquet(str(tmp_path / "e")).select("seq", "a"), "seq", 50)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(seq,50)" in plan and "ReadSchema: struct<seq:bigint,a:bigint>" in plan


@pytest.mark.parametrize("n", [0, 1, 7])
def test_running_over_partitions(spark, n):
    df = spark.createDataFrame([(i, i % 3) for i in range(n)], "i int, v int")
    got = [r["running"] for r in stats.running(df, [F.asc("i")], "v").orderBy("i").collect()]
    assert got == [sum(j % 3 for j in range(i + 1)) for i in range(n)]


def test_entities(spark, rows):
    from sendegraph.operators import entities as E

    m = spark.sql("SELECT map('de', 'alt', 'fr', 'x') AS o, map('de', 'neu', 'en', 'y') AS n").select(E.merge_languages(F.col("o"), F.col("n")).alias("m")).first()["m"]
    assert m == {"de": "neu", "en": "y", "fr": "x"}
    c = spark.createDataFrame([("a", "Q1", 1), ("a", "Q2", 2), ("b", "Q2", 1), ("b", "Q1", 1), ("c", "Q1", 3), ("c", "Q1", 3)], "node string, core string, depth int")
    assert rows(E.conflict_decision(c)) == [("a", "depth_advantage", "Q1", 1), ("b", "precedence_tiebreak", "Q1", 0), ("c", "single", "Q1", None)]
    links = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("x", "y"), ("q", None)], "page string, target string")
    assert rows(E.crawl_frontier(links, spark.createDataFrame([("p",)], "page string"))) == [("p", 0), ("q", 1), ("r", 2)]
    e = E.eligibility(F.lit(False), F.col("seed"), F.col("hop"), F.col("core"))
    d = spark.createDataFrame([(True, None, None), (None, 1, "Q1"), (None, 3, "Q1"), (None, 2, None), (None, None, "Q1")], "seed boolean, hop int, core string")
    assert [r[0] for r in d.select(e).collect()] == ["seed", "core_match", "too_far", "no_core_match", "unreached"]


def test_statements(spark):
    import json

    from sendegraph.operators import entities as E

    claims = {"P1": [{"rank": "normal", "mainsnak": {"snaktype": "value", "property": "P1", "datavalue": {"type": "wikibase-entityid", "value": {"id": "Q9"}}}}, {"mainsnak": {"snaktype": "value", "datavalue": {"type": "quantity", "value": {"amount": "+175"}}}}],
              "P2": {"mainsnak": {"snaktype": "novalue", "property": "P2"}}, "P3": [{"mainsnak": {"datavalue": {"type": "string", "value": "x"}}}]}
    df = spark.createDataFrame([("Q1", 1, json.dumps(claims))], "id string, discovered_at_utc int, claims string")
    got = {(r["pid"], r["statement_no"]): (r["item"], r["amount"], r["text"]) for r in E.statements(df).collect()}
    assert got == {("P1", 0): ("Q9", None, None), ("P1", 1): (None, 175.0, None), ("P2", 0): (None, None, None), ("P3", 0): (None, None, "x")}
    assert [tuple(r) for r in E.entity_triples(df).collect()] == [("Q1", "P1", "Q9", "normal")]


def test_ordinal_of_hot_null_and_empty_groups(spark):
    import random

    rnd = random.Random(3)
    rows_ = [("hot" if i % 3 else rnd.choice(["a", None, ""]), i * 7 % 601) for i in range(600)]
    df = spark.createDataFrame(rows_, "g string, v int")
    got = {(r["g"], r["v"]): r["ordinal"] for r in reshape.ordinal(df, ["g"], ["v"]).collect()}
    want = {(g, v): sum(h == g and w < v for h, w in rows_) for g, v in rows_}
    assert got == want and reshape.ordinal(df.limit(0), ["g"], ["v"]).count() == 0


def test_closure_runs_to_the_end(spark):
    """A loop of 13 is longer than either depth limit: each member reaches all, itself too."""
    e = spark.createDataFrame([(f"n{i:02d}", f"n{(i + 1) % 13:02d}") for i in range(13)], "c string, p string").coalesce(1)
    got = graph.closure(e, "c", "p").collect()
    assert len(got) == 169 and {r["depth"] for r in got if r["node"] == r["ancestor"]} == {13}


def test_wide_takes_its_width_from_the_data(spark, rows):
    d = spark.createDataFrame([("e", i, f"g{i}") for i in range(6)] + [("f", 0, "h")], "k string, o long, guest string").coalesce(1)
    assert rows(reshape.wide(d, "k", "o", ["guest"])) == [("e", *[f"g{i}" for i in range(6)]), ("f", "h", *[None] * 5)]
    assert reshape.wide(d.limit(0), "k", "o", ["guest"]).columns == ["k", "guest_0"]
