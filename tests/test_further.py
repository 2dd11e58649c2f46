import pytest
from pyspark.sql import functions as F

from sendegraph.functions import episodes as P
from sendegraph.functions import mentions as M
from sendegraph.operators import classes as K
from sendegraph.operators import eventlog as L
from sendegraph.operators import reshape

EDGES = "c string, p string, node string, core string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in pairs], EDGES)  # node and core clash with names inside


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_core_by_order_takes_the_first_parent(spark, rows):
    e = edges(spark, ("a", "z"), ("a", "core2"), ("z", "core1"), ("loop", "pool"), ("pool", "loop"), ("a", "z"), (None, "core1"), ("q", None), ("late", "a"))
    got = rows(K.core_by_order(e, ids(spark, "core1", "core2"), "p").select("node", "core", "depth", "path"))
    assert got == [("a", "core2", 1, "a|core2"), ("late", "core2", 2, "late|a|core2"), ("z", "core1", 1, "z|core1")]
    assert K.core_by_order(e.limit(0), ids(spark, "core1"), "p").count() == 0 and K.core_by_order(e, ids(spark).limit(0), "p").count() == 0


def test_policy_takes_the_first_source_that_knows_a_child(spark, rows):
    d = spark.createDataFrame([("a", "x", "s2"), ("a", "y", "s1"), ("b", "z", "s2"), ("c", "w", "other"), (None, "v", "s1")], "c string, p string, s string")
    assert rows(K.by_policy(d, "s", ["s1", "s2"]).where("c IS NOT NULL").select("c", "p")) == [("a", "y"), ("b", "z")]


def test_boundary(spark, rows):
    e, n = edges(spark, ("a", "s"), ("b", "a"), ("c", "b")), ids(spark, "s", "a", "b", "c", "r", None)
    assert rows(K.boundary(n, e, ids(spark, "s"), ids(spark, "r"))) == [("a",), ("b",), ("r",), ("s",)]
    assert rows(K.boundary(n, e, ids(spark).limit(0), ids(spark, "r"))) == [("r",)]
    assert K.boundary(n, e.limit(0), ids(spark, "s"), ids(spark, "r")).count() == 6


def test_expandable_table(spark):
    f = lambda **k: spark.range(1).select(K.expandable(*[F.lit(k.get(n)).cast("int" if n == "hop" else "boolean") for n in ("cls", "rel", "seed", "match", "hop")])).first()[0]
    assert [f(), f(cls=True, rel=True), f(rel=True), f(seed=True), f(match=True), f(match=True, hop=2), f(match=True, hop=3), f(match=False, hop=1)] == [False, False, True, True, False, True, False, False]


def test_instances_are_split(spark, rows):
    pairs = lambda *x: spark.createDataFrame(list(x) or [("-", "-")], "node string, core string")
    got = rows(K.split_instances(ids(spark, "k", "a", "b", "c", "d"), ids(spark, "k"), pairs(("a", "C1")), pairs(("a", "C2"), ("b", "C2")), ids(spark, "a"), pairs(("c", "C3")), pairs(("b", "C2"))))
    assert got == [("a", "C1", "relevant"), ("b", None, "no_core"), ("c", "C3", "not_relevant"), ("d", None, "no_core")]


def test_seed_pages_end_with_a_reason(spark, rows):
    links = spark.createDataFrame([("s", f"i{k}", 1) for k in range(5)] + [("s", "i0", 1), ("t", "i1", 1), (None, "x", 1), ("t", None, 1)], "seed string, id string, n_new int").where("id IS NOT NULL")
    seeds = spark.createDataFrame([("s",), ("t",), ("u",)], "seed string")
    assert rows(K.expand_seeds(seeds, links, 3)) == [("s", 3, "i2", "per_seed_cap"), ("t", 1, "i1", "exhausted")]
    after = spark.createDataFrame([("s", "i2")], "seed string, after string")
    assert rows(K.expand_seeds(seeds, links, 3, after)) == [("s", 2, "i4", "exhausted"), ("t", 1, "i1", "exhausted")]


def test_chunks_in_order_and_pruned(spark, rows):
    c = spark.createDataFrame([("c", "b", 20), ("a", None, 0), ("b", "a", 10), ("x", "gone", 5), ("y", None, 7)], "chunk_id string, prev_chunk_id string, first_sequence long")
    assert [r["chunk_id"] for r in L.chunk_order(c).orderBy("position").collect()] == ["a", "b", "c", "x", "y"]
    cat = spark.createDataFrame([(0, 0), (1, 10), (2, 20)], "chunk int, first_seq long")
    assert rows(L.chunks_from(cat, 10)) == [(1,), (2,)] and rows(L.chunks_from(cat, 9)) == [(0,), (1,), (2,)] and L.chunks_from(cat.limit(0), 3).count() == 0


def test_partial_tail_and_checksums(spark, rows):
    d = spark.createDataFrame([("f", 1, "{broken"), ("f", 2, '{"a":1}'), ("f", 3, '{"a":'), ("g", 1, '{"a":1}'), ("h", 1, None)], "file string, line int, value string")
    assert rows(L.drop_partial_tail(d, "file", "line", "value").select("file", "line")) == [("f", 1), ("f", 2), ("g", 1)]
    r, c = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", "x"), ("n", "9")], "path string, sha256 string")
    assert rows(L.validate_checksums(r, c)) == [("a", "ok"), ("b", "changed"), ("c", "missing"), ("n", "unregistered")]


def test_handlers_full_or_incremental(spark):
    log, done = spark.range(10).withColumnRenamed("id", "seq"), spark.createDataFrame([("a", 6)], "handler string, last_sequence long")
    out, s = L.run_handlers(log, "seq", {"a": lambda d: d, "b": lambda d: d}, done)
    assert {tuple(r) for r in s.collect()} == {("a", "incremental", 3, 9), ("b", "full", 10, 9)} and out["a"].count() == 3
    assert {r["mode"] for r in L.run_handlers(log, "seq", {"a": lambda d: d}, done, full=True)[1].collect()} == {"full"}
    assert L.run_handlers(log.limit(0), "seq", {"a": lambda d: d}, done)[1].first()["last_sequence"] == 6


def test_dotted_names_and_kinds_of_events(spark, rows):
    d = spark.createDataFrame([("k", '{"a":{"b":1,"c":[2,{"d":"x"}]}}'), ("n", None), ("e", "{}")], "key string, t string")
    assert rows(L.dotted(d, "key", "t")) == [("k", "a.b", "1"), ("k", "a.c.0", "2"), ("k", "a.c.1.d", "x")]
    ev = L.build_events(spark.createDataFrame([("Q1", None), ("Q2", "l")], "qid string, label string"), "entity_discovered", F.lit("t"), ["qid"], start=7).orderBy("sequence_num").collect()
    assert [(r["sequence_num"], r["payload"]) for r in ev] == [(7, '{"qid":"Q1","label":null}'), (8, '{"qid":"Q2","label":"l"}')]


def test_leaf_pages(spark):
    html = """<h3 class="episode-output-titel"><b><span itemprop="name">Folge &amp; 1</span></h3><div class="episode-output-inhalt-inner">Es <b>geht</b> los</div><ea-angabe-datum>1.2.2020</ea-angabe-datum>
      <h2 id="Cast-Crew">C</h2><ul class="cast-crew"><a data-event-category="liste-cast-crew" href="/u" title="A B"><dd><p>Gast<br/>aus X<br>und Y</p></dd><img data-src="i.jpg"></a><a data-event-category="liste-cast-crew"><dt itemprop="name">C D</dt></a></ul>
      <section><h2 id="Sendetermine">S</h2><time itemprop="startDate" datetime="2020-01-01T20:00"></time><time itemprop="endDate" datetime="2020-01-01T21:00"></time><time itemprop="startDate" datetime="2020-01-02T20:00"></time><i itemprop="name" content="ZDF"></i>NEU</section>"""
    got = {r["k"]: r for r in P.leaf_page(spark.createDataFrame([("a", html), ("n", None), ("e", "")], "k string, h string"), "k", "h").collect()}
    a = got["a"]
    assert (a["description"], a["premiere_date"], a["confidence"]) == ("Es geht los", "1.2.2020", 0.98)
    assert [(g["name"], g["role"], g["description"], g["url"], g["image"], g["position"], g["confidence"]) for g in a["guests"]] == [("A B", "Gast", "aus X und Y", "/u", "i.jpg", 0, 0.98), ("C D", "", "", "", "", 1, 0.8)]
    assert [(b["start"], b["end"], b["sender"], b["premiere"], b["confidence"]) for b in a["broadcasts"]] == [("2020-01-01T20:00", "2020-01-01T21:00", "", False, 0.9), ("2020-01-02T20:00", "", "ZDF", True, 0.86)]
    assert got["n"]["guests"] == [] and got["e"]["broadcasts"] == [] and got["n"]["confidence"] == 0.5


def test_topics(spark):
    texts = ["Themen: Klima; Rente", "Themen: Rente, Pflege, Klima", "Themen: Rente, Pflege; Klima", "Themen: das Geld, das fehlt; Klima", "Er spricht über die Rente; und sonst nichts", "Themen: Klima; Klima; Interview mit X", "", None, "über " + "x" * 300]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    got = {}
    for r in M.topic_rows(d, "k", "text").collect():
        got.setdefault(r["k"], {})[r["topic"]] = (r["parsing_rule"], r["confidence"])
    assert got == {
        0: {"Klima": ("labelled_topic_list", 0.93), "Rente": ("labelled_topic_list", 0.93)}, 1: {x: ("inline_label_comma_split", 0.72) for x in ("Rente", "Pflege", "Klima")},
        2: {"Rente": ("semicolon_part_comma_split", 0.76), "Pflege": ("semicolon_part_comma_split", 0.76), "Klima": ("labelled_topic_list", 0.93)},
        3: {"das Geld, das fehlt": ("labelled_topic_list_with_commas", 0.56), "Klima": ("labelled_topic_list", 0.93)}, 4: {"Rente": ("cue_based_clause", 0.72)}, 5: {"Klima": ("labelled_topic_list", 0.93)},
    }


def test_small_rules(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert [f(P.budget(F.lit(x))) for x in ("-1", "-5", " 12 ", "+3", "viel", None)] == [-1, 0, 12, 3, 0, 0]
    assert f(P.rgba(F.lit("#0aFF10"), 0.5)) == "rgba(10, 255, 16, 0.5)" and f(P.rgba(F.lit("red"), 0.5)) == "red"
    assert f(P.enabled_languages(F.lit("de, en;DE"))) == ["de", "en", "mul"] and f(P.enabled_languages(F.lit(" "))) is None
    assert f(P.column_name(F.lit(" Größe (cm) "))) == "gr_e_cm" and f(P.column_name(F.lit("--"))) == "value"
    assert [f(P.season_mismatch(F.lit(a), F.lit(b))) for a, b in (("Staffel 3,0", "3"), ("3", "4"), (None, "4"), ("", ""))] == [False, True, False, False]
    assert f(P.label_query(F.lit('a"b'), "Q5", prefix=True)).count('\\"') == 1
    assert reshape.allowed(None, ["a", "b"]) == ["a", "b"] and reshape.allowed("B", ["a", "b"]) == ["b"]
    with pytest.raises(ValueError):
        reshape.allowed("c", ["a"])


def test_fetch_plan_and_index(spark, rows):
    want = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 1), (None, 1)], "key string, action int")
    cache = spark.createDataFrame([("a", "2025-01-01"), ("b", "2020-01-01")], "key string, d string").select("key", F.to_timestamp("d").alias("t"))
    assert rows(L.fetch_plan(want, cache, "key", "t", F.to_date(F.lit("2025-06-01")))) == [("a", "cache", None), ("b", "fetch", 0), ("c", "fetch", 0)]
    assert rows(L.chunk_index(want, "key", 2)) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 0)] and L.chunk_index(want.limit(0), "key").count() == 0
