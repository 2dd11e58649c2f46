import random

from sendegraph.operators import graph
from sendegraph.plans import registry
from sendegraph.session import materialize

E = "c string, p string"


def brute(links):
    """What each node reaches."""
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    out = {}
    for n in up:
        seen, new = set(), [n]
        while new:
            new = [p for x in new for p in up.get(x, ()) if p not in seen and not seen.add(p)]
        out[n] = seen
    return out


def graphs():
    rnd = random.Random(5)
    yield "forest", [(f"a{i}", f"a{rnd.randrange(max(0, i - 4), i)}") for i in range(1, 90)]
    yield "loops without joints", [(f"b{i}", f"b{(i + 1) % 21}") for i in range(21)] + [(f"c{i}", f"b{i}") for i in range(9)] + [("d1", "c0"), ("d0", "d1"), ("s", "s"), ("t", "s")]
    yield "some joints", [(f"a{i}", f"a{min(79, max(0, i + rnd.choice([-3, -2, -1, 1])))}") for i in range(80) for _ in range(2 if i % 9 == 0 else 1)]
    yield "many joints", [(f"a{rnd.randrange(40)}", f"a{rnd.randrange(40)}") for _ in range(60)]
    yield "joint on its own chain", [("j", "x"), ("j", "y"), ("x", "z"), ("z", "j"), ("w", "x"), ("y", "r"), ("j", "j")]


LINKS = [(f"{name} {c}", f"{name} {p}") for name, links in graphs() for c, p in links]


def edges(spark):
    """All of them, some twice, some without an end."""
    return spark.createDataFrame([*LINKS, *LINKS[:2], (None, "q"), ("q", None)], E).coalesce(1)


def test_loops_against_brute_force(spark, rows):
    assert [r[0] for r in rows(graph.loop_members(edges(spark), "c", "p"))] == sorted(n for n, a in brute(LINKS).items() if n in a)
    assert graph.loop_members(edges(spark).limit(0), "c", "p").count() == 0


def writes(spark, monkeypatch, make):
    """How often ``make`` writes a table between."""
    n = []
    monkeypatch.setattr(graph, "materialize", lambda df, label: n.append(label) or materialize(df, label))
    return make().collect(), len(n)


def test_rounds_of_long_loops_and_chains(spark, monkeypatch):
    """A loop of 100 and a chain of 100 take as many rounds as their length has digits, not one a level."""
    monkeypatch.setattr(registry, "_edges", lambda *_: spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 100}") for i in range(100)] + [(f"m{i}", f"m{i + 1}") for i in range(100)], E).coalesce(1))
    got, n = writes(spark, monkeypatch, lambda: registry.loop_members(spark, ""))
    assert len(got) == 100 and n < 40


def test_counts_against_brute_force(spark, rows):
    n = {x: i for i, x in enumerate(sorted({x for link in LINKS for x in link})) if i % 3} | {"lone": 7}
    want = {x: [v, v] for x, v in n.items()}
    for x, above in brute(LINKS).items():
        for a in above:
            if x in n:
                want.setdefault(a, [0, 0])[1] += n[x]
    direct = spark.createDataFrame(list(n.items()), "node string, n long")
    assert rows(graph.propagated_counts(edges(spark), "c", "p", direct)) == sorted(((x, *v) for x, v in want.items()), key=str)
    assert rows(graph.propagated_counts(edges(spark).limit(0), "c", "p", direct.where("n = 7 AND node = 'lone'"))) == [("lone", 7, 7)]


def test_rounds_of_counts(spark, monkeypatch):
    monkeypatch.setattr(registry, "_edges", lambda *_: spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(100)], E).coalesce(1))
    got, n = writes(spark, monkeypatch, lambda: registry.propagated_counts(spark, ""))
    assert {(r["node"], r["n_total"]) for r in got} == {(f"n{i}", i) for i in range(1, 101)} and n < 40
