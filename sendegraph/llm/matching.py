"""Matching entities across sources that share no identifier.

Method: sorted neighbourhood. Every unit gets several composite sort keys; all
keys are sorted at once over the cluster, and each unit is compared with its
neighbours in a sliding window. Comparison weighs the agreement of names,
occupation, birth year, town and scene, that is show and day (bodies: kind, theme
and town); known attributes that differ rule a pair out. What one source says
twice is first made one entity of that source; among the entities of two sources
a one-to-one assignment of the greatest total confidence is taken, and all units
of two assigned entities are pairs. The first source, which tells most of its
entities, is assigned first. What it says of the entities of the other two is
evidence on their pairs: a common partner adds its confidence to that of the pair
as an independent witness (1 - (1 - c)(1 - d)), different partners rule it out.

The window slides over blocks of the sorted order, cut at global positions: a
block of many equal keys is no larger than any other, so a key that a third of
the units share is spread like the rest, and within it the later parts of the key
bring like with like.

Bodies are read as kind, theme and town where they are named so; of any other
name the tokens without legal forms, in order of the alphabet, are its theme.

Occupations are grouped into classes by the rows that were matched by hand: the
words that describe one person in two sources mean the same.

Defined results: of several rows of a unit the latest counts; units with labels
in none or several of the sources are left out; a unit without a description
matches on its name alone if it agrees in full; null attributes agree with any.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.graph import connected_components
from ..session import materialize
from . import names as N
from .assignment import assign
from .variants import READINGS, given_lexicon, known_of, with_known

SOURCES = ["wikidata", "fernsehserien_de", "zdf"]

_YEAR = re.compile(r"(?:\*|geb\.|geboren|Jahrgang)\s*(\d{4})")
_AGE = re.compile(r"\((\d{1,3})\)|\b(\d{1,3})\s+Jahre")
_TOWN = re.compile(r"\b(?:aus|in)\s+([A-ZÄÖÜ][\w-]+)")


def describe(text: str | None, date: str | None) -> tuple[str | None, int | None, int | None, str | None]:
    """(occupation, earliest birth year, latest birth year, town) out of a free description; age counts at the date."""
    s = (text or "").strip()
    if not s:
        return None, None, None, None
    lo = hi = town = None
    m = _YEAR.search(s)
    if m:
        lo = hi = int(m.group(1))
    else:
        a, y = _AGE.search(s), re.search(r"\d{4}", date or "")
        if a and y:
            hi = int(y.group()) - int(a.group(1) or a.group(2))
            lo = hi - 1
    t = _TOWN.search(s)
    if t:
        town = t.group(1)
    else:
        seg = [x.strip() for x in re.sub(r"\([^)]*\)", "", s).split(",")]
        for x in seg[1:3]:
            if re.fullmatch(r"[A-ZÄÖÜ][\w-]+", x) and not x[0].isdigit():
                town = x
                break
            if not re.search(r"\d", x):
                break
    occ = re.split(r",| \(| aus (?=[A-ZÄÖÜ])", s)[0].strip()
    return occ or None, lo, hi, (N.skeleton(town) if town else None)


def seat(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(kind, theme, town) out of the description of a body."""
    s = (text or "").strip()
    m = re.search(r"(?:\bin|\bSitz)\s+([A-ZÄÖÜ][\w-]+)|\(([A-ZÄÖÜ][\w-]+)\)", s)
    town = N.skeleton(m.group(1) or m.group(2)) if m else None
    k = re.match(r"(\S+)\s+mit\s+Sitz", s)
    t = re.match(r"(\S+),\s+Sitz", s)
    return (N.kind_of(k.group(1)) if k else None), (N.skeleton(t.group(1)) if t else None), town


def features_udf():
    """(label, aliases, description, date, person?, known given names) to the attributes that are compared."""

    @pandas_udf(f"r {READINGS}, occ string, ylo int, yhi int, town string, kind string, theme string")
    def run(label: pd.Series, alias: pd.Series, desc: pd.Series, date: pd.Series, person: pd.Series, known: pd.Series) -> pd.DataFrame:
        out = []
        for lab, al, de, da, pe, lexicon in zip(label, alias, desc, date, person, map(frozenset, known)):
            if pe:
                occ, lo, hi, town = describe(de, da)
                rs = N.readings(lab, lexicon)
                for a in (al or "").split("|"):
                    rs += [r for r in N.readings(a, lexicon) if r not in rs]
                out.append(([{"given": g, "family": list(f), "known": g in lexicon} for g, f in rs], occ, lo, hi, town, None, None))
            else:
                b, (kind, theme, town) = N.body(lab), seat(de)
                for a in (al or "").split("|"):
                    if not b["theme"] and a:
                        b = {**N.body(a), "town": b["town"]}
                if not b["theme"] and not b["acronym"] and not theme:
                    b = {**b, "town": "", "kind": "", "theme": N.residual(lab)}
                out.append(([], None, None, None, town or b["town"] or None, b["kind"] or kind, b["theme"] or theme or None))
        return pd.DataFrame(out, columns=["r", "occ", "ylo", "yhi", "town", "kind", "theme"])

    return run


def keys_udf():
    """The composite sort keys of a unit, each with the number of its pass."""

    @pandas_udf("array<struct<pass:int,key:string>>")
    def run(r: pd.Series, occ: pd.Series, ylo: pd.Series, town: pd.Series, day: pd.Series, kind: pd.Series, theme: pd.Series) -> pd.Series:
        out = []
        for rs, o, y, t, dd, k, th in zip(r, occ, ylo, town, day, kind, theme):
            o, t, k, th = o or "", t or "", k or "", th or ""
            y = "" if pd.isna(y) else str(int(y))
            got = set()
            if th:
                got.add((10, f"{t} {k} {th}"))
                got.add((11, f"{th} {k} {t}"))
                got.add((12, f"{th[::-1]} {t}"))
            for x in rs:
                g = min(N.given_forms(x["given"]), key=lambda s: (-len(s), s)) if x["given"] else ""
                for f in x["family"]:
                    got.add((0, f"{f} {g[:1]} {o} {y}"))
                    got.add((8, f"{f} {g} {t} {y}"))
                    got.add((1, f"{f[::-1]} {g[:1]} {o} {y}"))
                    got.add((2, f"{''.join(sorted(f))} {g[:1]} {o}"))
                    if o and (y or t):
                        got.add((3, f"{o} {g[:1]} {y} {f}"))
                        got.add((4, f"{o} {t} {g[:1]} {f}"))
                    if t:
                        got.add((5, f"{t} {g} {f}"))
                    if not pd.isna(dd):
                        got.add((7, f"{int(dd):06d} {g[:1]} {f}"))
                    if y:
                        got.add((6, f"{y} {g} {f[-5:]}"))
            out.append([{"pass": p, "key": s} for p, s in sorted(got)])
        return pd.Series(out, dtype=object)

    return run


def sorted_neighbours(keyed: DataFrame, unit: str, carry: list[str], window: int, block: int = 0) -> DataFrame:
    """Pairs (a, b) of structs ``unit, carry...`` that lie within ``window`` places in the order of (pass, key).

    The sort is by range over the cluster. Global places come from the sizes of
    the sorted partitions; each block of places also gets the ``window`` places
    after it, so that no pair is lost at a border.
    """
    block = block or 8 * window
    n = keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = keyed.repartitionByRange(int(n), "pass", "key", unit).sortWithinPartitions("pass", "key", unit)
    order = materialize(order.withColumn("m", F.monotonically_increasing_id()), "sorted")
    order = order.withColumn("part", F.shiftright("m", 33)).withColumn("place", F.col("m").bitwiseAND((1 << 33) - 1))
    sizes = order.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    order = order.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("place"))  # as many rows as partitions
    home = F.floor(F.col("at") / block)
    blocks = F.when(F.col("at") % block < window, F.array(home, home - 1)).otherwise(F.array(home))
    order = order.select("pass", unit, *carry, "at", home.alias("home"), F.explode(blocks).alias("block"))
    w = Window.partitionBy("block").orderBy("at").rowsBetween(1, window)
    cols = ["pass", unit, *carry]
    near = order.select("block", "home", F.struct(*cols).alias("a"), F.collect_list(F.struct(*cols)).over(w).alias("bs"))
    return near.where("home = block").select("a", F.explode("bs").alias("b")).where("a.pass = b.pass")


def occupation_classes(rows: DataFrame) -> DataFrame:
    """(occ, occ_class) out of rows whose sources were matched by hand: words used of one person mean the same.

    A pair of words counts if it makes up a twentieth of the pairs of one of
    them, so that a wrong match among many joins nothing.
    """

    @pandas_udf("array<string>")
    def occs(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([sorted({o for o in (describe(x, None)[0] for x in t) if o}) for t in zip(a, b, c)], dtype=object)

    got = rows.select(F.monotonically_increasing_id().alias("i"), occs(*[F.col(f"description_{s}") for s in SOURCES]).alias("o")).where(F.size("o") > 1)
    p = got.select(F.explode("o").alias("x"), "o").select("x", F.explode("o").alias("y")).where("x <> y").groupBy("x", "y").agg(F.count("*").alias("n"))
    total = p.groupBy("x").agg(F.sum("n").alias("t"))
    p = p.join(total, "x").join(total.select(F.col("x").alias("y"), F.col("t").alias("u")), "y")
    edges = p.where((F.col("x") < F.col("y")) & (20 * F.col("n") >= F.least("t", "u"))).select("x", "y")
    return connected_components(edges, "x", "y").select(F.col("node").alias("occ"), F.col("component").alias("occ_class"))


def confidence_udf():
    """The confidence of a pair: agreement of the names, weighted up by each attribute that agrees."""

    @pandas_udf("double")
    def run(ra: pd.Series, rb: pd.Series, ka: pd.Series, kb: pd.Series, ta: pd.Series, tb: pd.Series, occ: pd.Series, year: pd.Series, town: pd.Series, scene: pd.Series) -> pd.Series:
        out = []
        for xa, xb, k1, k2, t1, t2, o, y, t, e in zip(ra, rb, ka, kb, ta, tb, occ, year, town, scene):
            if k1 or t1 or k2 or t2:
                free = bool(t1 and t2) and t1[:1] == t2[:1] == N.RESIDUAL
                if not (t1 and t2) or (k1 and k2 and k1 != k2) or not (t > 0 or free):
                    out.append(0.0)
                    continue
                d = N.edits(t1, t2, 2)
                m = 1.0 if d == 0 else 0.9 if d == 1 and min(len(t1), len(t2)) > 4 else 0.8 if d == 2 and min(len(t1), len(t2)) > 8 else 0.0
                out.append(m * (1.0 if k1 and k2 else 0.8) * (1.0 if t > 0 else 0.8))
                continue
            a = [(r["given"], tuple(r["family"])) for r in xa]
            b = [(r["given"], tuple(r["family"])) for r in xb]
            m = N.name_match(a, b, known_of(xa, xb))
            agree = int(o > 0) + int(y > 0) + int(t > 0) + int(e > 0)
            if m < 0.52 or (agree == 0 and m < 0.9):
                out.append(0.0)
            else:
                out.append(m * min(1.0, 0.55 + 0.15 * agree))
        return pd.Series(out, dtype="float64")

    return run


def filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def match_units(rows: DataFrame, window: int = 20) -> DataFrame:
    """(unit_a, unit_b, confidence): pairs of units of different sources that mean the same entity."""
    used = ["entity_class", "match_tier", "program_name", "episode_date", *[f"{k}_{s}" for k in ("label", "description", "alias") for s in SOURCES]]
    latest = rows.where(filled("alignment_unit_id")).groupBy("alignment_unit_id").agg(F.max(F.struct("aligned_at", *used)).alias("s"))
    latest = latest.select("alignment_unit_id", *[F.col(f"s.{c}") for c in used])
    count = sum(F.when(filled(f"label_{s}"), 1).otherwise(0) for s in SOURCES)
    latest = materialize(latest.withColumn("n_sources", count), "units")
    lone = latest.where("n_sources = 1")
    source = F.coalesce(*[F.when(filled(f"label_{s}"), F.lit(s)) for s in SOURCES])
    pick = lambda c: F.coalesce(*[F.when(filled(f"label_{s}"), F.col(f"{c}_{s}")) for s in SOURCES])
    date = F.coalesce(F.try_to_date("episode_date", "yyyy-MM-dd"), F.try_to_date("episode_date", "dd.MM.yyyy"))
    base = lone.select(
        F.col("alignment_unit_id").alias("id"), source.alias("source"), (F.col("entity_class") == "person").alias("person"), F.col("entity_class").alias("cls"),
        pick("label").alias("label"), pick("alias").alias("alias"), pick("description").alias("desc"), F.col("episode_date").alias("date"),
        F.unix_date(date).alias("day"), F.when(filled("program_name"), F.lower(F.trim("program_name"))).alias("show"),
    )
    lexicon = given_lexicon(base.where("person"), "label")
    hand = occupation_classes(latest.where("n_sources > 1 AND entity_class = 'person'"))
    units = with_known(base, "id", ["label", "alias"], lexicon).withColumn("f", features_udf()("label", "alias", "desc", "date", "person", "known")).select("id", "source", "cls", "day", "show", "f.*")
    units = materialize(units.join(hand, "occ", "left").withColumn("occ", F.coalesce("occ_class", "occ")).drop("occ_class"), "features")
    attrs = ["source", "cls", "occ", "ylo", "yhi", "town", "day", "show"]
    keyed = units.withColumn("k", F.explode(keys_udf()("r", "occ", "ylo", "town", "day", "kind", "theme"))).select("id", *attrs, "k.pass", "k.key")
    near = sorted_neighbours(keyed, "id", attrs, window)
    swap = F.col("a.id") > F.col("b.id")
    near = near.where("a.id <> b.id AND a.cls = b.cls").select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")
    )
    cands = near.select(
        F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), _same("a.occ", "b.occ").alias("occ"), _years("a.ylo", "a.yhi", "b.ylo", "b.yhi").alias("year"),
        _same("a.town", "b.town").alias("town"),
        F.coalesce(((F.abs(F.col("a.day") - F.col("b.day")) <= 1) & F.coalesce(F.col("a.show") == F.col("b.show"), F.lit(True))).cast("int"), F.lit(0)).alias("scene"),
    )
    cands = materialize(cands.where("occ >= 0 AND year >= 0 AND town >= 0").distinct(), "neighbours")
    side = lambda x: units.select(F.col("id").alias(f"id_{x}"), F.col("source").alias(f"s_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("r", "kind", "theme")])
    scored = materialize(
        cands.join(side("a"), "id_a").join(side("b"), "id_b")
        .withColumn("confidence", confidence_udf()("r_a", "r_b", "kind_a", "kind_b", "theme_a", "theme_b", "occ", "year", "town", "scene"))
        .where("confidence > 0")
        .select("id_a", "id_b", "s_a", "s_b", "confidence", (F.col("occ") + F.col("year") + F.col("town") + F.col("scene")).alias("agree"), F.col("theme_a").isNotNull().alias("body")),
        "scored",
    )

    # what one source says twice is one entity of that source
    twice = scored.where("s_a = s_b AND (confidence >= 0.59 AND agree >= 2 OR confidence >= 0.7 AND body)")
    groups = connected_components(twice, "id_a", "id_b").select(F.col("node").alias("id"), F.col("component"))
    member = materialize(units.join(groups, "id", "left").withColumn("g", F.coalesce("component", "id")).select("id", "g", "source", "occ", "ylo", "yhi", "town"), "members")
    entity = member.groupBy("g").agg(F.max("ylo").alias("ylo"), F.min("yhi").alias("yhi"), F.max("town").alias("town"), F.min("town").alias("town2"), F.max("occ").alias("occ"))
    of = member.select("id", "g")
    pairs = (
        scored.where("s_a <> s_b")
        .join(of.select(F.col("id").alias("id_a"), F.col("g").alias("g_a")), "id_a").join(of.select(F.col("id").alias("id_b"), F.col("g").alias("g_b")), "id_b")
        .groupBy("g_a", "g_b", "s_a", "s_b").agg(F.max("confidence").alias("confidence"))
    )
    ea = entity.select(*[F.col(c).alias(f"{c}_a") for c in entity.columns])
    eb = entity.select(*[F.col(c).alias(f"{c}_b") for c in entity.columns])
    fit = (_same("occ_a", "occ_b") >= 0) & (_years("ylo_a", "yhi_a", "ylo_b", "yhi_b") >= 0) & ((_same("town_a", "town_b") >= 0) | (F.col("town_a") == F.col("town2_b")) | (F.col("town2_a") == F.col("town_b")))
    pairs = pairs.join(ea, "g_a").join(eb, "g_b").where(fit)
    first = F.col("s_a") < F.col("s_b")
    pairs = pairs.select(
        F.when(first, F.col("g_a")).otherwise(F.col("g_b")).alias("a"), F.when(first, F.col("g_b")).otherwise(F.col("g_a")).alias("b"),
        F.concat_ws("-", F.least("s_a", "s_b"), F.greatest("s_a", "s_b")).alias("side"), "confidence",
    )
    pairs = materialize(pairs.groupBy("a", "b", "side").agg(F.max("confidence").alias("confidence")), "pairs")

    # the first source describes its entities most fully: it is assigned first, and what both others have with it decides between them
    hubbed = F.col("side").contains(SOURCES[0])
    done = materialize(assign(pairs.where(hubbed)), "hubs")
    left = F.col("side").startswith(SOURCES[0])
    hub = done.select(F.when(left, F.col("b")).otherwise(F.col("a")).alias("m"), F.when(left, F.col("a")).otherwise(F.col("b")).alias("hub"), "confidence")
    low, high = sorted(SOURCES[1:])
    placed = hub.join(member.select(F.col("g").alias("m"), "source").distinct(), "m")
    one = placed.where(F.col("source") == low).select("hub", F.col("m").alias("a"), F.col("confidence").alias("ca"))
    two = placed.where(F.col("source") == high).select("hub", F.col("m").alias("b"), F.col("confidence").alias("cb"))
    together = one.join(two, "hub").select("a", "b", F.lit(f"{low}-{high}").alias("side"), F.least("ca", "cb").alias("confidence"))
    ha, hb = hub.select(F.col("m").alias("a"), F.col("hub").alias("hub_a")), hub.select(F.col("m").alias("b"), F.col("hub").alias("hub_b"))
    rest = pairs.where(~hubbed).join(ha, "a", "left").join(hb, "b", "left").where("hub_a IS NULL OR hub_b IS NULL")
    rest = rest.join(entity.select(F.col("g").alias("x"), *[F.col(c).alias(f"{c}_a") for c in ("ylo", "yhi", "town", "town2", "occ")]), F.coalesce("hub_a", "a") == F.col("x")).drop("x")
    rest = rest.join(entity.select(F.col("g").alias("x"), *[F.col(c).alias(f"{c}_b") for c in ("ylo", "yhi", "town", "town2", "occ")]), F.coalesce("hub_b", "b") == F.col("x")).drop("x")
    rest = rest.where(fit).select("a", "b", "side", "confidence")
    both = together.unionByName(rest).unionByName(pairs.where(~hubbed).join(together.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "side", "confidence"))
    both = both.groupBy("a", "b", "side").agg((1 - F.product(1 - F.col("confidence"))).alias("confidence"))
    done = done.unionByName(assign(both))
    out = done.join(of.select(F.col("g").alias("a"), F.col("id").alias("ia")), "a").join(of.select(F.col("g").alias("b"), F.col("id").alias("ib")), "b")
    return out.select(F.least("ia", "ib").alias("unit_a"), F.greatest("ia", "ib").alias("unit_b"), F.round("confidence", 6).alias("confidence"))


def _same(a: str, b: str) -> Column:
    """1 equal, 0 unknown, -1 different."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), 0).when(F.col(a) == F.col(b), 1).otherwise(-1)


def _years(alo: str, ahi: str, blo: str, bhi: str) -> Column:
    """1 the ranges of years meet, 0 unknown, -1 they do not."""
    return F.when(F.col(alo).isNull() | F.col(blo).isNull(), 0).when((F.col(alo) <= F.col(bhi)) & (F.col(blo) <= F.col(ahi)), 1).otherwise(-1)
