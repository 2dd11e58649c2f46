import json

from pyspark.sql import functions as F

from sendegraph.sources import readers as R
from sendegraph.sources import sinks as S
from sendegraph.streaming import projections as P


def test_csv(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2,\n')
    assert rows(R.read_csv(spark, str(tmp_path / "a.csv"), ["name", "id", "gone"], {"id": "int"})) == [("", 2, ""), ("x, y", 1, "")]
    assert R.read_csv(spark, str(tmp_path / "none.csv"), ["a", "b"]).columns == ["a", "b"]


def test_events_stop_or_skip(spark, tmp_path):
    good = lambda i: json.dumps({"sequence_num": i, "event_type": "t", "payload": {"k": i}})
    (tmp_path / "c.jsonl").write_text("\n".join([good(1), "", good(2), "{broken", good(3)]) + "\n")
    assert sorted(r["sequence_num"] for r in R.read_events(spark, str(tmp_path)).collect()) == [1, 2, 3]
    assert sorted(r["sequence_num"] for r in R.read_events(spark, str(tmp_path), stop_at_damage=True).collect()) == [1, 2]


def test_blocks_and_pages(spark, rows):
    dump = "x\n--- EPISODE 1 ---\nA\n" + "=" * 50 + "\noutside\n--- EPISODE 2 ---\n  \n--- EPISODE 3 ---\nB"
    assert rows(R.split_blocks(spark.createDataFrame([("f", dump), ("g", None)], "k string, t string"), "k", "t")) == [("f", 0, "A"), ("f", 1, "B")]
    pages = spark.createDataFrame([("d", 1, "Seite 1 von 2 a"), ("d", 2, "Seite 2 von 2 b"), ("d", 3, "Seite 1 von 1 c"), ("d", 4, "more")], "d string, p int, t string")
    assert [(r["session"], r["pages"]) for r in R.page_sessions(pages, "d", "p", "t").orderBy("session").collect()] == [(1, 2), (2, 2)]


def test_json_objects(spark, tmp_path, rows):
    (tmp_path / "core_a.json").write_text('{"Q1": {"x": 1}, "Q2": 2}')
    (tmp_path / "core_b.json").write_text('{"Q1": 9, "Q3": 3}')
    (tmp_path / "not_relevant_core_a.json").write_text('{"Q4": 4}')
    (tmp_path / "core_z.json").write_text("[1]")
    assert [(k, f) for k, _, f in rows(R.read_json_objects(spark, f"{tmp_path}/*.json"))] == [("Q1", "core_a.json"), ("Q2", "core_a.json"), ("Q3", "core_b.json")]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "t")
    for n in (3, 5):
        S.write_atomic(spark.range(n).toDF("a"), out)
        assert spark.read.parquet(out).count() == n
    d = S.number_events(spark.createDataFrame([(x,) for x in "dbca"], "k string"), ["k"], 10)
    assert [(r["k"], r["sequence_num"]) for r in d.orderBy("k").collect()] == [("a", 10), ("b", 11), ("c", 12), ("d", 13)]
    S.write_events(d, str(tmp_path / "log"), per_chunk=12)
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["chunk=0", "chunk=1"]
    good, bad = S.split_damaged(spark.createDataFrame([("{}",), ("[1]",), ("{",), (" ",)], "value string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_stream_fold_equals_batch(spark, tmp_path, rows):
    src = spark.range(200).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("k"), F.expr("cast(id * 3 % 11 AS string)").alias("d"))
    src.repartition(5).write.parquet(str(tmp_path / "log"))
    stream = P.event_stream(spark, str(tmp_path / "log"), src.schema, files_per_batch=2)
    handle = P.fold_latest(str(tmp_path / "tab"), ["k"], "seq", ["seq", "d"])
    P.run_now(stream, handle, str(tmp_path / "cp"))
    from sendegraph.operators.events import latest_per_key

    want = rows(latest_per_key(src, ["k"], "seq", ["seq", "d"]))
    assert rows(P.newest_version(spark, str(tmp_path / "tab"))) == want
    P.run_now(P.event_stream(spark, str(tmp_path / "log"), src.schema), handle, str(tmp_path / "cp"))  # nothing new: nothing changes
    assert rows(P.newest_version(spark, str(tmp_path / "tab"))) == want
