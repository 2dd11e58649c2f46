import random

from sendegraph.operators import packed as P

VALUES = ["Koch", "Ärztin", "Film-, Fernseh- und Theaterregisseur", "Rat für Handel & Gewerbe", 'Sprecher "Runder Tisch"', "Leiterin; Abteilung Hafen", "Texter/Sprecher", "Autor (Lyrik, Prosa)"]
SCHEMA = "key string, a string, b string, field string, packed string"


def test_round_trip_of_all_dialects(spark):
    rnd = random.Random(3)
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    writers = [lambda v: "|".join(v), lambda v: "；".join(v), lambda v: "\n".join(v), lambda v: "\t".join(v), lambda v: " • ".join(v), lambda v: ";".join(map(quote, v)), lambda v: ", ".join(map(quote, v)),
               lambda v: __import__("json").dumps(v), lambda v: "|".join(f" {x} " for x in v) + "| |", lambda v: ",".join(x.replace(",", "\\,") for x in v)]
    truth, data = {}, []
    for i in range(400):
        vals = rnd.sample(VALUES, rnd.randint(1, 4))
        data.append((f"k{i}", rnd.choice(writers)(vals), None, "x", "y"))
        truth[f"k{i}"] = vals
    book = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = {}
    for r in P.split_packed(spark.createDataFrame(data + data[:40], SCHEMA), "key", ["a", "b"], book).collect():
        got.setdefault(r["key"], {})[r["value_pos"]] = r["value_text"]
    right = sum([g.get(i + 1) for i in range(len(v))] == v and len(g) == len(v) for k, v in truth.items() for g in [got.get(k, {})])
    assert right >= 0.99 * len(truth)


def test_without_codebook_counts_decide(spark):
    rnd = random.Random(5)
    vals = [*VALUES, "Maler", "Geigerin", "Lotse", "Imkerin", "Bäcker", "Glaserin"]
    truth = {f"k{i}": rnd.sample(vals, rnd.randint(1, 4)) for i in range(600)}
    data = [(k, rnd.choice(["|", " & ", "; "]).join(v), None, "", "") for k, v in truth.items()]
    got = {}
    for r in P.split_packed(spark.createDataFrame(data, SCHEMA), "key", ["a"]).collect():
        got.setdefault(r["key"], {})[r["value_pos"]] = r["value_text"]
    right = sum([g.get(i + 1) for i in range(len(v))] == v for k, v in truth.items() for g in [got.get(k, {})])
    assert right >= 0.95 * len(truth)


def test_empty_null_blank_long(spark, rows):
    df = spark.createDataFrame([("a", None, "", "", ""), ("b", " ; ;", None, "", ""), (None, "x", None, "", ""), ("c", "y", "y", "", ""), ("d", "w|" * 3000, None, "", "")], SCHEMA)
    got = rows(P.split_packed(df, "key", ["a", "b"]))
    assert [g for g in got if g[0] != "d"] == [("c", "a", 1, "y"), ("c", "b", 1, "y")] and len([g for g in got if g[0] == "d"]) == 3000
    assert P.split_packed(df.limit(0), "key", ["a", "b"]).count() == 0
