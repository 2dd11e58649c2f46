"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each component, for all nodes of the edges.

    Each round a node takes the least label among its neighbours' and then the
    label of its label; the rounds grow with the logarithm of the longest path.
    A node with very many edges costs one partial minimum per task. Null ends are
    left out; an empty edge table gives no rows.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    e = materialize(e.union(e.select("y", "x")).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = e.join(labels.select(F.col("node").alias("y"), F.col("component").alias("c")), "y").groupBy("x").agg(F.min("c").alias("c"))
        nxt = labels.join(near, labels.node == near.x).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        nxt = materialize(nxt, "hook")
        jump = nxt.select(F.col("node").alias("j"), F.col("component").alias("jc"))
        nxt = materialize(
            nxt.join(jump, F.col("component") == F.col("j")).select("node", "old", F.least("component", "jc").alias("component")), "labels"
        )
        if nxt.where("old <> component").isEmpty():
            return nxt.select("node", "component")
        labels = nxt.select("node", "component")


def closure(edges: DataFrame, child: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): least depth at which each ancestor is reached, up to ``max_depth`` if given; cycles end by themselves.

    Nodes may have several parents. Each round joins the new pairs with the edges
    and drops those already known. Without ``max_depth`` a round takes a band of
    four levels: the pairs up to that distance are joined first, and only the
    farthest of a band go on.
    """
    e = materialize(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct(), "edges")
    new, band = e.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).cast("long").alias("depth")), 1
    least = lambda df: df.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
    step = lambda a, b: a.join(b.select(F.col("node").alias("c"), F.col("ancestor").alias("p"), F.col("depth").alias("more")), F.col("ancestor") == F.col("c")).select("node", F.col("p").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
    while max_depth is None and band < 4:
        new, band = materialize(least(new.unionByName(step(new, new))), "band"), band * 2
    known, near, d = new, new, band
    while max_depth is None or d < max_depth:
        far = least(step(new.where(F.col("depth") == d), near))
        new = materialize(far.join(known.select("node", "ancestor"), ["node", "ancestor"], "left_anti"), "level")
        d += band
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def chains(edges: DataFrame, direct: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (c, p) as chains between joints: the joints' edges, and each node's pointers up its chain.

    Joints are the nodes with several parents and at least one node of each cycle
    that has none of these; a chain ends at a joint or at a node without a parent.
    Table k has (node, top, len): the node ``len`` steps up, 2 ** k of them or as
    many as there are to the end; joints and ends have themselves and 0. The last
    table has the end of every chain. With ``direct`` (node, n) the tables also have
    the own ``n`` and the sum ``below`` over the chains that come in, null for none.

    A cycle is cut where the hash of a node is the least of the run up from it; a
    run that leads to a cycle may be cut above it as well, which does no harm.
    """
    out = edges.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("k"), F.min("p").alias("p")).select("node", F.when(F.col("k") == 1, F.col("p")).alias("up"))
    t = materialize(
        edges.select(F.col("p").alias("node"), F.lit(None).alias("up")).unionByName(out).groupBy("node").agg(F.max("up").alias("up"))
        .select("node", "up", F.coalesce("up", "node").alias("top"), F.col("up").isNotNull().cast("long").alias("len"), F.xxhash64("node").alias("low")),
        "pointers",
    )
    running, k = t.where("len = 1").count(), 0
    while running:
        t = materialize(_doubled(t, k, low=lambda a, b: F.least(a, b)), "pointers")
        k, before = k + 1, running
        running = t.where(F.col("len") == 2**k).count()
        if running == before:  # whatever is still running, runs in circles
            break
    cut = (F.col("len") == 2**k) & (F.xxhash64("node") == F.col("low"))
    up = F.when(~(F.col("up").isNull() | cut), F.col("up"))
    t = t.select("node", F.coalesce(up, "node").alias("top"), up.isNotNull().cast("long").alias("len"))
    if direct is not None:
        t = t.join(direct.groupBy("node").agg(F.sum("n").alias("n")), "node", "full").select("node", F.coalesce("top", "node").alias("top"), F.coalesce("len", F.lit(0)).cast("long").alias("len"), "n", F.lit(None).cast("long").alias("below"))
    tables = [materialize(t, "chains")]
    while not tables[-1].where(F.col("len") == 2 ** (len(tables) - 1)).isEmpty():
        t, k = tables[-1], len(tables) - 1
        nxt = _doubled(t, k)
        if direct is not None:
            add = t.where(F.col("len") == 2**k).groupBy(F.col("top").alias("node")).agg(F.sum(_plus("n", "below")).alias("add"))
            nxt = nxt.join(add, "node", "left").withColumn("below", _plus("below", "add")).drop("add")
        tables.append(materialize(nxt, "chains"))
    joints = edges.join(tables[0].where("len = 0").select(F.col("node").alias("c")), "c", "left_semi")
    return materialize(joints, "joints"), tables


def _plus(a: str, b: str) -> Column:
    """The sum, where null counts as nothing."""
    return F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))


def _doubled(t: DataFrame, k: int, **merge) -> DataFrame:
    """Pointers of up to 2 ** k steps made up to twice as long; ``merge`` joins the columns that belong to a run."""
    far = t.select(F.col("node").alias("f_node"), F.col("top").alias("f_top"), F.col("len").alias("f_len"), *[F.col(c).alias(f"f_{c}") for c in merge])
    new = {"top": F.col("f_top"), "len": F.col("len") + F.col("f_len"), **{c: f(F.col(c), F.col(f"f_{c}")) for c, f in merge.items()}}
    moved = t.where(F.col("len") == 2**k).join(far, F.col("top") == F.col("f_node"))
    return t.where(F.col("len") < 2**k).unionByName(moved.select(*[new[c].alias(c) if c in new else F.col(c) for c in t.columns]))


def _up(points: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """points (…, at) and all that lies on the chains up from them, ends included."""
    for k in reversed(range(len(tables))):
        jump = tables[k].where(F.col("len") == 2**k).select(F.col("node").alias("j_node"), F.col("top").alias("j_top"))
        keep = [c for c in points.columns if c != "at"]
        points = points.join(jump, F.col("at") == F.col("j_node"), "left").select(*keep, F.explode(F.array_compact(F.array("at", "j_top"))).alias("at")).distinct()
    return points


def _reach(edges: DataFrame, child: str, parent: str, direct: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The joints' edges (c, p, end of p's chain), the pairs of joints (node, ancestor) and the tables of :func:`chains`."""
    e = materialize(edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct(), "edges")
    joints, tables = chains(e, direct)
    ends = joints.join(tables[-1].select(F.col("node").alias("p"), F.col("top").alias("end")), "p")
    ends = materialize(ends.join(joints.select(F.col("c").alias("end"), F.lit(True).alias("joint")).distinct(), "end", "left").select("c", "p", F.when(F.col("joint"), F.col("end")).alias("end")), "ends")
    return ends, closure(ends, "c", "end").select("node", "ancestor"), tables


def loop_members(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node): the nodes on loops of any length, a node that points to itself too.

    Which joints reach which is found by :func:`closure`; between them the nodes of
    a chain are on a loop where its ends reach each other. The work grows with the
    pairs of joints, not with those of all nodes.
    """
    ends, pairs, tables = _reach(edges, child, parent)
    back = pairs.select(F.col("node").alias("end"), F.col("ancestor").alias("c"))
    inside = ends.where("c = end").select("p").unionByName(ends.join(back, ["end", "c"], "left_semi").select("p"))
    return _up(inside.select(F.col("p").alias("at")).distinct(), tables).select(F.col("at").alias("node"))


def rewire(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges (subject, predicate, object) with those of the rules (…, rule ``add`` or ``remove``) added and removed."""
    cols = ["subject", "predicate", "object"]
    out = edges.select(*cols).join(rules.where("rule = 'remove'").select(*cols), cols, "left_anti")
    return out.unionByName(rules.where("rule = 'add'").select(*cols)).distinct()


def hops(edges: DataFrame, a: str, b: str, seeds: DataFrame, k: int) -> DataFrame:
    """(node, hop): least number of undirected steps from any seed, 1 to k; seeds (node) left out."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    e = materialize(e.union(e.select("y", "x")).distinct(), "both_ways")
    seen = materialize(seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long")), "seeds")
    frontier = seen
    for h in range(1, k + 1):
        nxt = frontier.join(e, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct()
        frontier = materialize(nxt.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h).cast("long")), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hop > 0")


def propagate_relevance(triples: DataFrame, seeds: DataFrame, rules: DataFrame, classes: DataFrame, max_rounds: int | None = None, both_ways: bool = False) -> DataFrame:
    """(entity, seed, parent, predicate, round): entities made relevant by inheritable predicates, with where it came from.

    triples (subject, predicate, object); seeds (entity); rules (predicate,
    subject_class, object_class; null matches any); classes (entity, class): an
    entity of unknown class contradicts no rule. Of several ways in the same round
    the smallest (parent, predicate) counts. Once relevant, always relevant. Rounds
    go on until none adds an entity, unless ``max_rounds`` is given.
    """
    t = triples.select("subject", "predicate", "object").where("subject IS NOT NULL AND object IS NOT NULL")
    cls = classes.groupBy("entity").agg(F.min("class").alias("class"))
    t = t.join(cls.select(F.col("entity").alias("subject"), F.col("class").alias("sc")), "subject", "left").join(cls.select(F.col("entity").alias("object"), F.col("class").alias("oc")), "object", "left")
    fits = lambda known, wanted: F.col(known).isNull() | F.col(wanted).isNull() | (F.col(known) == F.col(wanted))
    r = rules.select(F.col("predicate"), "subject_class", "object_class").distinct()
    ok = t.join(r, "predicate").where(fits("sc", "subject_class") & fits("oc", "object_class")).select("subject", "predicate", "object").distinct()
    if both_ways:
        ok = ok.unionByName(ok.select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"))).distinct()
    ok = materialize(ok, "inheritable")
    none = F.lit(None).cast("string")
    done = materialize(seeds.select("entity").distinct().select("entity", F.col("entity").alias("seed"), none.alias("parent"), none.alias("predicate"), F.lit(0).cast("long").alias("round")), "seeds")
    frontier, i = done, 0
    while max_rounds is None or i < max_rounds:
        i += 1
        step = frontier.select(F.col("entity").alias("subject"), "seed").join(ok, "subject")
        step = step.groupBy(F.col("object").alias("entity")).agg(F.min(F.struct(F.col("subject").alias("parent"), "predicate", "seed")).alias("s"))
        step = step.join(done.select("entity"), "entity", "left_anti").select("entity", "s.seed", "s.parent", "s.predicate", F.lit(i).cast("long").alias("round"))
        frontier = materialize(step, "round")
        if frontier.isEmpty():
            break
        done = done.unionByName(frontier)
    return done


def rule_groups(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """(candidate, allowed): permit and exclude groups; in a group all rules must hold, an exclude group vetoes, any permit group allows.

    candidates (candidate, predicate, object) facts; rules (rule_type, group_id,
    predicate, object), ``*`` standing for any object. The rules are few.
    """
    facts = candidates.select("candidate", "predicate", "object").distinct()
    need = rules.groupBy("rule_type", "group_id").agg(F.count("*").alias("need"))
    r = rules.withColumn("rid", F.monotonically_increasing_id())
    hit = facts.join(r.select("rule_type", "group_id", "rid", F.col("predicate").alias("rp"), F.col("object").alias("ro")), (F.col("predicate") == F.col("rp")) & ((F.col("ro") == "*") | (F.col("object") == F.col("ro"))))
    full = hit.groupBy("candidate", "rule_type", "group_id").agg(F.count_distinct("rid").alias("got")).join(need, ["rule_type", "group_id"]).where("got = need")
    per = full.groupBy("candidate").agg(F.max(F.col("rule_type") == "permit").alias("p"), F.max(F.col("rule_type") == "exclude").alias("x"))
    return facts.select("candidate").distinct().join(per, "candidate", "left").select("candidate", (F.coalesce("p", F.lit(False)) & ~F.coalesce("x", F.lit(False))).alias("allowed"))


def adjacency(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, n_out, n_in): the number of distinct neighbours in both directions."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct()
    o = e.groupBy(F.col("x").alias("node")).agg(F.count("*").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    i = e.groupBy(F.col("y").alias("node")).agg(F.lit(0).cast("long").alias("n_out"), F.count("*").alias("n_in"))
    return o.unionByName(i).groupBy("node").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))


def propagated_counts(edges: DataFrame, child: str, parent: str, direct: DataFrame) -> DataFrame:
    """(node, n_direct, n_total): own count and that of all descendants, each once; a node on a loop is its own descendant.

    direct (node, n); nodes that neither have a row there nor a descendant with one
    are left out. Counts are summed up the chains; pairs are made only of joints
    (:func:`chains`) and what they reach, each with the sum of the joint's chains.
    What is on a loop is reached by the joint at the end of its own chain, and so
    are all that come in on it; elsewhere none is.
    """
    ends, pairs, tables = _reach(edges, child, parent, direct)
    first = ends.select(F.col("c").alias("joint"), F.col("p").alias("at"))
    further = pairs.join(ends.select(F.col("c").alias("ancestor"), F.col("p").alias("at")), "ancestor").select(F.col("node").alias("joint"), "at")
    reached = _up(first.unionByName(further).distinct(), tables)
    sums = tables[-1].select(F.col("node").alias("joint"), _plus("n", "below").alias("w"))
    reached = reached.join(sums, "joint").join(tables[-1].select(F.col("node").alias("at"), "top"), "at")
    above = reached.groupBy(F.col("at").alias("node")).agg(F.sum("w").alias("far"), F.max(F.col("joint") == F.col("top")).alias("loop"))
    both = tables[-1].join(above, "node", "left").withColumn("near", F.when(F.coalesce("loop", F.lit(False)), None).otherwise(F.col("below"))).withColumn("all", _plus("near", "far"))
    nought = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.where("n IS NOT NULL OR all IS NOT NULL").select("node", nought("n").alias("n_direct"), (nought("n") + nought("all")).alias("n_total"))
