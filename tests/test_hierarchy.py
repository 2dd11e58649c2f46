import random

from pyspark.sql import functions as F

from sendegraph.operators import hierarchy as H

L, R = "node string, parent string", "node string"


def brute(parent, roots):
    out = {}
    for n in parent:
        seen, v = [], n
        while True:
            if v in roots or v not in parent or parent[v] is None:
                out[n] = (v, len(seen), [v, *reversed(seen)])
                break
            if v in seen:
                out[n] = (min(seen[seen.index(v):]), -1, [n])
                break
            seen.append(v)
            v = parent[v]
    return out


def test_against_brute_force(spark):
    rnd = random.Random(7)
    parent = {f"Q{i}": rnd.choice([None, *[f"Q{max(0, i - rnd.randint(1, 3))}"] * 12, f"Q{rnd.randint(0, 300)}"]) for i in range(260)}
    parent["Q5"] = "Q5"  # a class that points to itself
    roots = {"Q9", "Q400"}
    for doublings in (1, 4):
        got = H.resolve(spark.createDataFrame(list(parent.items()), L), spark.createDataFrame([(r,) for r in roots], R), stride_doublings=doublings).collect()
        assert {r["node"]: (r["root"], r["depth"], r["path"]) for r in got} == brute(parent, roots)
        assert len(got) == len(parent)


def test_deep_chain(spark):
    n = 150
    links = spark.createDataFrame([(f"n{i:04d}", f"n{i - 1:04d}" if i else None) for i in range(n)], L)
    res = H.resolve(links, spark.createDataFrame([], R))
    assert res.agg(F.max("depth"), F.min("depth")).first() == (n - 1, 0)
    assert H.ancestor_pairs(res).count() == n * (n - 1) // 2


def test_empty_null_ties_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], L)
    assert H.resolve(empty, spark.createDataFrame([], R)).count() == 0
    raw = spark.createDataFrame(
        [("q7", "Q1", 1, "x", "y"), (" Q 7", "<Q2>", 2, "x", "y"), ("wd:Q07", "Q3", 2, None, None), (None, "Q1", 5, "", ""), ("nothing", "Q1", 5, "", ""), ("Q8", "", None, "", ""), ("Q8", "", None, "", "")],
        "class_id string, up string, t int, node string, parent string",
    )
    links = H.current_links(raw, H.q_number(F.col("class_id")), H.q_number(F.col("up")), F.col("t"))
    assert rows(links) == [("Q7", "Q3"), ("Q8", None)]
    assert rows(H.resolve(links, spark.createDataFrame([], R), keep_paths=False)) == [("Q7", "Q3", 1), ("Q8", "Q8", 0)]


def test_subtrees_below_cycles(spark, rows):
    """a <-> b is a cycle; c hangs below b, d and e below c; x is a self-loop with y below it."""
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "x"), ("y", "x"), ("r", None), ("s", "r")], L)
    res = H.resolve(links, spark.createDataFrame([], R), stride_doublings=2, below_cycles=True)
    assert {r["node"]: (r["depth"], "".join(r["path"])) for r in res.collect()} == {
        "a": (-1, "a"), "b": (-1, "b"), "c": (-1, "bc"), "d": (-1, "bcd"), "e": (-1, "bcde"), "x": (-1, "x"), "y": (-1, "xy"), "r": (0, "r"), "s": (1, "rs")
    }
    assert rows(H.ancestor_pairs(res)) == [("b", "c", 1), ("b", "d", 2), ("b", "e", 3), ("c", "d", 1), ("c", "e", 2), ("d", "e", 1), ("r", "s", 1), ("x", "y", 1)]
