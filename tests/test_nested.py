import json

from sendegraph.operators import nested as N

SCHEMA = "id string, discovered_at_utc timestamp_ntz, claims string, path string, ord int"


def snak(p, v="x"):
    return {"snaktype": "value", "property": p, "datavalue": {"type": "string", "value": v}}


CLAIMS = {
    "P1": [
        {"mainsnak": snak("P1"), "qualifiers": {"P2": [snak("P2"), {"snaktype": "novalue", "property": "P2"}], "P3": snak("P3")}, "references": [{"snaks": {"P4": [snak("P4")]}}, {"snaks": {"P4": snak("P4"), "P5": []}}]},
        {"id": "no mainsnak", "references": {"snaks": {"P6": [snak("P6")]}}, "qualifiers": None},
    ],
    "P9": {"mainsnak": {"snaktype": "somevalue", "property": "P9"}, "rank": "normal", "qualifiers": []},
}
EXPECTED = {
    ("P1", 0, "mainsnak", 0, "P1", 0), ("P1", 0, "qualifier", 0, "P2", 0), ("P1", 0, "qualifier", 0, "P2", 1), ("P1", 0, "qualifier", 0, "P3", 0),
    ("P1", 0, "reference", 0, "P4", 0), ("P1", 0, "reference", 1, "P4", 0), ("P1", 1, "reference", 0, "P6", 0), ("P9", 0, "mainsnak", 0, "P9", 0),
}


def frame(spark, texts):
    from datetime import datetime

    return spark.createDataFrame([(i, datetime(2024, 1, d), t, "clash", 1) for i, d, t in texts], SCHEMA)


def test_shapes(spark):
    for text in (json.dumps(CLAIMS), json.dumps(CLAIMS, indent=1), json.dumps({"claims": CLAIMS}), json.dumps(json.dumps(CLAIMS))):
        got = N.snaks(frame(spark, [("Q1", 1, text), ("Q1", 1, text)])).collect()
        assert {tuple(r)[1:] for r in got} == EXPECTED and len(got) == len(EXPECTED)


def test_damage_nulls_versions_and_empty(spark):
    t = json.dumps(CLAIMS)
    df = frame(spark, [("Q1", 2, t[: len(t) // 2]), ("Q1", 1, t), ("Q2", 1, None), ("Q3", 1, ""), ("Q4", 1, "[]"), (None, 1, t), ("Q5", 1, "[" * 100_000), ("Q6", 1, t)])
    assert {r["entity_id"] for r in N.snaks(df).collect()} == {"Q6"}
    assert N.snaks(df.limit(0)).count() == 0


def test_tables_round_trip(spark):
    """Every leaf of the record is in exactly one table, under its ordinals."""
    tables = N.claim_tables(frame(spark, [("Q1", 1, json.dumps(CLAIMS))]))
    assert set(tables) == {"*[]", "*[].qualifiers.*[]", "*[].references[]", "*[].references[].snaks.*[]"}
    q = {tuple(r[f"o{i}"] for i in range(1, 5)): r["datavalue_value"] for r in tables["*[].qualifiers.*[]"].collect()}
    assert q == {("P1", "0", "P2", "0"): "x", ("P1", "0", "P2", "1"): None, ("P1", "0", "P3", "0"): "x"}
    s = {(r["o1"], r["o2"]): (r["mainsnak_property"], r["field_id"]) for r in tables["*[]"].collect()}
    assert s == {("P1", "0"): ("P1", None), ("P1", "1"): (None, "no mainsnak"), ("P9", "0"): ("P9", None)}


def test_no_shuffle_after_the_version(spark):
    plan = N.snaks(frame(spark, [("Q1", 1, "{}")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
