"""Variant spellings of names typed by people.

Method: every name is rewritten in all canonical ways - titles, brackets and
legal forms off, pet forms and initials to formal names, abbreviations to the
words they shorten, acronyms of bodies, tokens in either order, one letter
dropped for slips of typing. The forms are exploded and equi-joined; what meets
in a form is compared in full, and the rarer the form, the surer the link: the
agreement of two names is weighed against the partners that the form would give
by accident.

Persons meet in (form of a family part, letter of the given name, birth year or
place), so hot family names are split by all three. Functions in bodies are
settled part by part: function, kind, theme and town each have a small stock of
spellings, a rare spelling one slip from a common one becomes that one, and the
parts together are the class.

Defined results: null and empty names have no links; repeated rows count once;
unknown years and places agree with any, but one known agreement is needed;
names that agree in no family part are never linked. No pair is dropped for
being one of many.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.graph import connected_components
from ..session import materialize
from . import names as N

READINGS = "array<struct<given:string,family:array<string>,known:boolean>>"


def year_of(c: Column) -> Column:
    """The four-digit year in any writing, or null."""
    y = F.regexp_extract(c, r"([0-9]{4})", 1)
    return F.when(y != "", y.cast("int"))


def given_lexicon(labels: DataFrame, label: str, far: int = 5) -> DataFrame:
    """(t): tokens that stand at the given end of names: given names.

    Of the different names a token is used in, more than half must have it at the
    given end, beyond chance (lower end of Wilson's 95 % interval); how large the
    table is makes no difference. A token one slip from another with ``far``
    times its partners is a misspelling and not known, however often it occurs. A
    token that is missing only leaves the order open, and both readings of its
    names are then used.
    """

    @pandas_udf("array<string>")
    def ends(col: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            s = N.bare(x)
            if "," in s:
                a, _, b = s.partition(",")
                s = f"{b} {a}"
            ts = [N.skeleton(t.split("-")[0]) for t in s.split() if t.lower().rstrip(".") not in N.PARTICLES]
            ts = [t for t in ts if len(t) > 1]
            return [ts[0], ts[-1]] if len(ts) > 1 else []

        return pd.Series([one(x) for x in col], dtype=object)

    @pandas_udf("array<string>")
    def dels(col: pd.Series) -> pd.Series:
        return pd.Series([N.deletions(x, 3) for x in col], dtype=object)

    @pandas_udf("boolean")
    def slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([N.edits(x, y, 1) <= 1 or x.replace("rn", "m") == y.replace("rn", "m") for x, y in zip(a, b)], dtype="bool")

    e = labels.select(ends(F.col(label)).alias("e")).where(F.size("e") == 2).select(F.col("e")[0].alias("g"), F.col("e")[1].alias("f")).distinct()
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = e.select(F.col("g").alias("t"), one.alias("given")).union(e.select("f", no))
    uses = materialize(both.groupBy("t").agg(F.count("*").alias("n"), F.sum("given").alias("given")), "ends")
    share, z = F.col("given") / F.col("n"), 3.84
    low = (share + z / (2 * F.col("n")) - F.sqrt(z * (share * (1 - share) + z / (4 * F.col("n"))) / F.col("n"))) / (1 + z / F.col("n"))
    known = materialize(uses.where(low > 0.5), "given_ends")
    least = known.agg(F.min("n").alias("least"))
    common = uses.crossJoin(F.broadcast(least)).where(F.col("n") >= far * F.col("least"))  # one row
    rare = known.select("t", "n", F.explode(dels("t")).alias("form"))
    often = common.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.explode(dels("t")).alias("form"))
    slips = rare.join(often, "form").where(F.col("n2") >= far * F.col("n")).select("t", "t2").distinct().where(slip("t", "t2"))
    return materialize(known.select("t").join(slips.select("t"), "t", "left_anti"), "given_names")


def with_known(df: DataFrame, key: str, labels: list[str], lexicon: DataFrame) -> DataFrame:
    """``df`` with ``known``: which tokens of the labels are given names. Labels may hold several names between bars.

    ``key`` tells the labels; nothing comes to the driver.
    """

    @pandas_udf("array<string>")
    def tokens(col: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            ss = [N.bare(y) for y in (x or "").split("|")] if x else []
            return sorted({N.skeleton(p) for s in ss for v in (s, s.replace(",", " ")) for t in v.split() for p in t.split("-")} - {""})

        return pd.Series([one(x) for x in col], dtype=object)

    t = df.select(key, F.concat_ws("|", *labels).alias("x")).distinct().select(key, F.explode(tokens("x")).alias("t"))
    got = t.join(lexicon, "t").groupBy(key).agg(F.collect_set("t").alias("known"))
    return df.join(got, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def known_of(*sides) -> frozenset[str]:
    """The known given names among readings."""
    return frozenset(r["given"] for rs in sides for r in rs if r["known"])


def readings_udf():
    @pandas_udf(READINGS)
    def run(col: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([[{"given": g, "family": list(f), "known": g in k} for g, f in N.readings(x, k)] for x, k in zip(col, map(frozenset, known))], dtype=object)

    return run


def match_udf():
    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def rd(x) -> list:
            return [(r["given"], tuple(r["family"])) for r in x]

        return pd.Series([N.name_match(rd(x), rd(y), known_of(x, y)) for x, y in zip(a, b)], dtype="float64")

    return run


def given_udf():
    """True unless every reading has two known given names that differ."""

    @pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def ok(x, y) -> bool:
            return any(N.given_match(p["given"], q["given"], True, True) > 0 or not (p["known"] and q["known"]) for p in x for q in y)

        return pd.Series([ok(x, y) for x, y in zip(a, b)], dtype="bool")

    return run


def forms_udf():
    """Readings to (form, letter): a family part with at most one letter dropped, and the first letters of the given name."""

    @pandas_udf("array<struct<form:string,letter:string>>")
    def run(col: pd.Series) -> pd.Series:
        out = []
        for rs in col:
            got = set()
            for r in rs:
                letters = N.given_letters(r["given"]) or {""}
                for part in r["family"]:
                    got.update((d, c) for d in N.deletions(part, 4) for c in letters)
            out.append([{"form": d, "letter": c} for d, c in sorted(got)])
        return pd.Series(out, dtype=object)

    return run


def distinct_persons(rows: DataFrame, key: str, label: str, year: Column, place: Column) -> tuple[DataFrame, DataFrame]:
    """(people, members): each different (label, year, place) once, under its least key, and all keys that have it.

    A third of all rows may be copies under other keys: they are one row of
    ``people`` and meet nothing twice.
    """
    place = F.lower(F.trim(place))
    base = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), year.alias("year"), F.when(place != "", place).alias("place"))
    base = base.where("key IS NOT NULL AND label IS NOT NULL AND label <> ''").distinct()
    what = ["label", "year", "place"]
    rep = base.groupBy(*what).agg(F.min("key").alias("id"))
    same = F.lit(True)
    for c in what:
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}"))
    members = materialize(base.alias("b").join(rep.alias("r"), same).select("key", F.col("r.id").alias("id"), *[F.col(f"b.{c}").alias(c) for c in what]), "copies")
    lexicon = given_lexicon(base, "label")
    people = with_known(members.select("id", *what).distinct(), "label", ["label"], lexicon).withColumn("r", readings_udf()("label", "known")).drop("known")
    people = people.where(F.size("r") > 0).withColumn("id", F.concat_ws("\u0001", "id", "label"))
    members = members.withColumn("id", F.concat_ws("\u0001", "id", "label"))
    return materialize(people, "people"), members


def meetings(people: DataFrame) -> DataFrame:
    """(id_a, id_b, chance): those who share a form, the first letters of the given name, and a year or place, and differ in neither.

    ``chance`` is how many others would share as much with one by accident: of the
    forms and marks in which the two meet, the rarest pair counts.
    """
    forms = materialize(people.select("id", "year", "place", F.explode(forms_udf()("r")).alias("f")).select("id", "year", "place", "f.form", "f.letter"), "forms")
    n = people.count() or 1
    common = forms.groupBy("form", "letter").agg(F.count_distinct("id").alias("df"))
    marks = F.filter(F.array(F.concat(F.lit("y"), F.col("year").cast("string")), F.concat(F.lit("p"), F.col("place"))), lambda x: x.isNotNull())
    often = people.select("id", F.explode(marks).alias("mark")).groupBy("mark").agg(F.count_distinct("id").alias("dm"))
    keyed = forms.join(common.where("df > 1"), ["form", "letter"]).select("form", "letter", "df", F.explode(marks).alias("mark"), "id", "year", "place")
    a = keyed.select("form", "letter", "mark", "df", *[F.col(c).alias(f"{c}_a") for c in ("id", "year", "place")])
    b = keyed.select("form", "letter", "mark", *[F.col(c).alias(f"{c}_b") for c in ("id", "year", "place")])
    agree = (F.coalesce(F.col("year_a") == F.col("year_b"), F.lit(True))) & (F.coalesce(F.col("place_a") == F.col("place_b"), F.lit(True)))
    met = a.join(b, ["form", "letter", "mark"]).where((F.col("id_a") < F.col("id_b")) & agree).join(often, "mark")
    return materialize(met.groupBy("id_a", "id_b").agg((F.min(F.col("df") * F.col("dm")) / F.lit(float(n))).alias("chance")), "met")


def class_links(people: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(id_a, id_b, confidence): different spellings of one person.

    The agreement m of two names is weighed against the number of accidental
    partners that their rarest common rewriting would have: m / (m + (1 - m) *
    chance). Two spellings that share no form may each be linked with a third one:
    their confidence is the product of both links, if nothing known of them differs.
    """
    met = meetings(people)
    names = materialize(people.groupBy("id").agg(F.flatten(F.collect_list("r")).alias("r"), F.first("year").alias("year"), F.first("place").alias("place")), "names")
    side = lambda x: names.select(F.col("id").alias(f"id_{x}"), F.col("r").alias(f"r_{x}"), F.col("year").alias(f"year_{x}"), F.col("place").alias(f"place_{x}"))
    m = F.col("m")
    links = materialize(
        met.join(side("a").select("id_a", "r_a"), "id_a").join(side("b").select("id_b", "r_b"), "id_b")
        .withColumn("m", match_udf()("r_a", "r_b"))
        .select("id_a", "id_b", (m / (m + (1 - m) * F.col("chance"))).alias("confidence"))
        .where(F.col("confidence") > min_confidence),
        "links",
    )
    both = materialize(links.unionByName(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "confidence")), "both_ways")
    via = both.select(F.col("id_a").alias("mid"), F.col("id_b").alias("id_a"), F.col("confidence").alias("c1")).join(both.select(F.col("id_a").alias("mid"), "id_b", F.col("confidence").alias("c2")), "mid")
    via = via.where("id_a < id_b").groupBy("id_a", "id_b").agg(F.max(F.col("c1") * F.col("c2")).alias("confidence")).where(F.col("confidence") > min_confidence)
    known = (F.col("year_a") == F.col("year_b")) | (F.col("place_a") == F.col("place_b"))
    differ = (F.col("year_a") != F.col("year_b")) | (F.col("place_a") != F.col("place_b"))
    far = via.join(links.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti").join(side("a"), "id_a").join(side("b"), "id_b")
    far = far.where(F.coalesce(known, F.lit(False)) & ~F.coalesce(differ, F.lit(False))).where(given_udf()("r_a", "r_b")).select("id_a", "id_b", "confidence")
    return materialize(links.unionByName(far), "spellings")


def person_links(rows: DataFrame, key: str, label: str, year: Column, place: Column) -> DataFrame:
    """(key_a, key_b, confidence): rows of one person, under different spellings or, with a year or place, the same."""
    people, members = distinct_persons(rows, key, label, year, place)
    links, of = class_links(people), members.select("key", "id").distinct()
    across = links.join(of.select(F.col("key").alias("k1"), F.col("id").alias("id_a")), "id_a").join(of.select(F.col("key").alias("k2"), F.col("id").alias("id_b")), "id_b")
    sure = members.where("year IS NOT NULL OR place IS NOT NULL").join(people.select("id").distinct(), "id", "left_semi").select("key", "id")
    within = sure.select("id", F.col("key").alias("k1")).join(sure.select("id", F.col("key").alias("k2")), "id").where("k1 < k2").select("k1", "k2", F.lit(1.0).alias("confidence"))
    out = across.where("k1 <> k2").select(F.least("k1", "k2").alias("key_a"), F.greatest("k1", "k2").alias("key_b"), "confidence").unionByName(within.toDF("key_a", "key_b", "confidence"))
    return out.groupBy("key_a", "key_b").agg(F.round(F.max("confidence"), 6).alias("confidence"))


def person_classes(rows: DataFrame, key: str, label: str, year: Column, place: Column) -> DataFrame:
    """(key, class_key, n_links): each row with the least key of its person, and the number of other rows linked with it.

    No pairs of copies are made: a class of k copies is k rows.
    """
    people, members = distinct_persons(rows, key, label, year, place)
    links = class_links(people)
    comp = connected_components(links, "id_a", "id_b")
    size = members.groupBy("id").agg(F.count_distinct("key").alias("copies"), F.min("key").alias("least"), F.max(F.col("year").isNotNull() | F.col("place").isNotNull()).alias("sure"))
    near = links.select("id_a", "id_b").union(links.select("id_b", "id_a")).join(size.select(F.col("id").alias("id_b"), "copies"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.sum("copies").alias("others"))
    placed = size.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = placed.groupBy("component").agg(F.min("least").alias("class_key"))
    done = placed.join(low, "component").join(near, "id", "left").select("id", F.when(F.col("sure"), F.col("class_key")).alias("class_key"), (F.when(F.col("sure"), F.col("copies") - 1).otherwise(0) + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.select("key", "id").distinct().join(done, "id").groupBy("key").agg(F.min(F.coalesce("class_key", "key")).alias("class_key"), F.max("n_links").alias("n_links"))


def settle(tokens: DataFrame) -> DataFrame:
    """(part, token, settled): a rare spelling one slip from a common one becomes that one.

    ``tokens`` has (part, token, uses, rows): how many different texts and how many
    rows hold the token. A spelling is rare beside another that has three times
    its uses, or five times its rows if it has one use; ties go to the most used,
    then the smallest.
    """

    @pandas_udf("array<string>")
    def dels(col: pd.Series) -> pd.Series:
        return pd.Series([N.deletions(x, 3) for x in col], dtype=object)

    f = tokens.select("part", "token", "uses", "rows", F.explode(dels("token")).alias("form"))
    g = f.select("part", "form", F.col("token").alias("t2"), F.col("uses").alias("u2"), F.col("rows").alias("r2"))
    lev = F.levenshtein("token", "t2")
    letters = lambda c: F.concat_ws("", F.array_sort(F.split(c, "")))
    slip = (lev == 1) | ((lev == 2) & (letters(F.col("token")) == letters(F.col("t2"))))
    best = (
        f.join(g, ["part", "form"])
        .where(((F.col("u2") >= 3 * F.col("uses")) | ((F.col("uses") == 1) & (F.col("r2") >= 5 * F.col("rows")))) & (F.length("token") >= 3) & slip)
        .groupBy("part", "token")
        .agg(F.min(F.struct((-F.col("u2")).alias("o"), (-F.col("r2")).alias("q"), "t2")).alias("s"))
        .select("part", "token", F.col("s.t2").alias("settled"))
    )
    return tokens.select("part", "token").join(best, ["part", "token"], "left").select("part", "token", F.coalesce("settled", "token").alias("settled"))


def body_udf():
    @pandas_udf("function string, kind string, theme string, town string, acronym string, short boolean")
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([N.body(x) for x in col], columns=["function", "kind", "theme", "town", "acronym", "short"])

    return run


def _with_settled(df: DataFrame, settled: DataFrame, part: str) -> DataFrame:
    m = settled.where(F.col("part") == part).select(F.col("token").alias(part), F.col("settled").alias(f"s_{part}"))
    return df.join(m, part, "left").withColumn(part, F.coalesce(f"s_{part}", part)).drop(f"s_{part}")


def role_classes(rows: DataFrame, role: str) -> DataFrame:
    """(role, class_key): each distinct text with the function, kind, theme and town it means."""
    texts = rows.select(F.col(role).alias("role")).where(F.trim("role") != "").groupBy("role").agg(F.count("*").alias("n"))
    parsed = materialize(texts.withColumn("b", body_udf()("role")).select("role", "n", "b.*"), "bodies")
    tokens = parsed.select("role", "n", "short", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("token")) for p in ("theme", "town", "function")])).alias("x"))
    tokens = tokens.where((F.col("x.token") != "") & ~((F.col("x.part") == "function") & F.col("short"))).groupBy("x.part", "x.token").agg(F.count_distinct("role").alias("uses"), F.sum("n").alias("rows"))
    settled = materialize(settle(tokens), "settled")
    for p in ("theme", "town", "function"):
        parsed = _with_settled(parsed, settled, p)
    parsed = materialize(parsed, "parts")

    # abbreviated functions: any function that begins so, by its parts in order; the most used one
    stock = parsed.where(~F.col("short") & (F.col("function") != "")).groupBy("function").agg(F.sum("n").alias("uses"))
    stems = stock.select(F.col("function").alias("full"), "uses", F.explode(F.transform(F.sequence(F.lit(1), F.length("function")), lambda i: F.substring("function", F.lit(1), i))).alias("head"))
    short = parsed.where(F.col("short")).select("function").distinct()
    pattern = F.concat(F.lit("^"), F.replace(F.col("function"), F.lit("-"), F.lit(".*")), F.lit(".*"))
    long = (
        short.withColumn("head", F.split("function", "-")[0]).join(stems, "head")
        .where(F.rlike("full", pattern))
        .groupBy("function").agg(F.max(F.struct("uses", "full")).alias("s"))
        .select("function", F.col("s.full").alias("full"))
    )
    parsed = parsed.join(long, "function", "left").withColumn("function", F.when(F.col("short"), F.coalesce("full", "function")).otherwise(F.col("function"))).drop("full")

    # acronyms: all that a known body may have, by the place where its theme's second part begins
    bodies = parsed.where("kind <> '' AND theme <> '' AND town <> ''").groupBy("kind", "theme", "town").agg(F.count("*").alias("seen"))
    bodies = bodies.withColumn("k", F.explode(F.sequence(F.lit(3), F.greatest(F.length("theme") - 1, F.lit(3)))))
    bodies = bodies.withColumn("tail", F.expr("substring(theme, k)"))
    support = bodies.groupBy("tail").agg(F.count_distinct("theme").alias("support"))
    letters = [F.substring("theme", 1, 1), F.substring("tail", 1, 1), F.substring("town", 1, 1)]
    bodies = bodies.join(support, "tail").withColumn(
        "acronym", F.explode(F.array(F.concat(F.substring("kind", 1, 1), F.lit("f"), *letters), F.concat(F.substring("kind", 1, 1), *letters)))
    )
    best = bodies.groupBy("acronym", "town").agg(F.max(F.struct("support", "seen", "kind", "theme")).alias("s"))
    best = best.select("acronym", "town", F.col("s.kind").alias("a_kind"), F.col("s.theme").alias("a_theme"))
    done = parsed.join(best, ["acronym", "town"], "left")
    part = lambda c: F.coalesce(f"a_{c}", c)
    rest = F.when(F.col("a_kind").isNull(), F.col("acronym")).otherwise(F.lit(""))
    return done.select("role", F.concat_ws("|", "function", part("kind"), part("theme"), "town", rest).alias("class_key"))


def role_links(rows: DataFrame, role: str) -> DataFrame:
    """(key_a, key_b): texts that mean the same function; the stock of texts hardly grows with the rows."""
    c = materialize(role_classes(rows, role), "roles")
    a, b = c.select(F.col("role").alias("key_a"), "class_key"), c.select(F.col("role").alias("key_b"), "class_key")
    return a.join(b, "class_key").where("key_a < key_b").select("key_a", "key_b")
