import random

from sendegraph.operators import packed as P

SCHEMA = "key string, a string, b string, field string, packed string"


def test_lone_quoted_values_at_any_size(spark):
    """However often a quoted value stands alone, its quotes are none of its own; a value with quotes inside keeps them."""
    rnd = random.Random(1)
    vals = ["Koch", "Lotse", "Imkerin", 'Sprecher "Runder Tisch"', "Hafen & Handel"]
    for times in (1, 40):
        truth = {}
        for i in range(60 * times):
            v = rnd.sample(vals, rnd.randint(1, 3))
            quote = lambda x: '"' + x.replace('"', '""') + '"'
            truth[f"k{i}"] = (rnd.choice(["|".join(v), " & ".join(v), quote(v[0]), " / ".join(map(quote, v))]), v)
        data = [(k, t, None, "", "") for k, (t, _) in truth.items()]
        got = {}
        for r in P.split_packed(spark.createDataFrame(data, SCHEMA), "key", ["a"]).collect():
            got.setdefault(r["key"], {})[r["value_pos"]] = r["value_text"]
        wrong = [k for k, (t, v) in truth.items() if [got[k][i + 1] for i in range(len(got[k]))] not in (v, v[:1])]
        assert len(wrong) <= 0.02 * len(truth), (times, [truth[k] for k in wrong[:5]])


def test_values_of_many_pieces(spark):
    """A value may hold its delimiter any number of times, if it stands on its own elsewhere."""
    rnd = random.Random(2)
    long = "Amt für Wasser, Boden, Luft, Licht, Lärm, Klima"
    vals = [long, "Koch", "Lotse", "Imkerin", "Bäcker", "Maler", "Geigerin", "Glaserin"]
    data = [(f"k{i}", rnd.choice([", ", "|", "; "]).join(rnd.sample(vals, rnd.randint(1, 4))), None, "", "") for i in range(800)]
    got = P.split_packed(spark.createDataFrame(data, SCHEMA), "key", ["a"]).groupBy("value_text").count().collect()
    assert sum(r["count"] for r in got if r["value_text"] in vals) >= 0.99 * sum(r["count"] for r in got)


def test_escapes_keep_every_character():
    text = "".join(f"\\{c}" for c in "|,;\x00") + "|a"
    hidden, marks = P.hide_escapes(text)
    assert hidden.translate(marks) == "|,;\x00|a" and len(marks) == 7
