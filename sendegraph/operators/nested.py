"""Deeply nested records to flat related tables.

Method: each record is parsed once into path-value-ordinal triples; paths are
grouped by their repeated ancestor; each group is pivoted into one table whose
rows keep the ordinals of all ancestors as keys.

A path names the steps from the top: field names joined by ``.``, ``*`` for a
key that is data (its text becomes an ordinal) and ``[]`` for a place in a list
(its number becomes an ordinal). ``*[].references[].snaks.*[]`` is thus the group
of snaks in references, with five ordinals.

The parse is a vectorised function inside the projection, so rows stay where the
version selection has put them (hashed by id) and the pivots shuffle nothing.

Defined results: a null, blank or damaged text gives no triples; a text that is a
string holding the record is read as often as it was packed; a wrapper ``{"<wrapper>": record}``
is opened; where a list is expected a lone value is a list of one; empty lists
and objects and nulls give no rows; of a key that occurs twice the last holds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialize

TRIPLES = "array<struct<path:string,ord:array<string>,value:string>>"


def load_record(text: str | None, wrapper: str | None = None):
    """The record in ``text``, or None where it can't be read in full."""
    if text is None:
        return None
    try:
        while isinstance(text, str):  # each reading is shorter than the text it was in
            text = json.loads(text.strip().lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    if wrapper and isinstance(text, dict) and set(text) == {wrapper}:
        text = text[wrapper]
    return text


def walk(rec, data_keys: re.Pattern, listed: frozenset[str]) -> Iterator[tuple[str, tuple, str | None]]:
    """Triples of a record: (path, ordinals, value); an object yields itself with the value None."""
    stack = [("", (), rec)]
    while stack:
        path, ordinals, v = stack.pop()
        if v is None:
            continue
        if not isinstance(v, list) and path in listed:
            v = [v]
        if isinstance(v, dict):
            if v and path:
                yield path, ordinals, None
            for k, x in v.items():
                if data_keys.fullmatch(k):
                    stack.append((f"{path}.*" if path else "*", (*ordinals, k), x))
                else:
                    stack.append((f"{path}.{k}" if path else k, ordinals, x))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                stack.append((f"{path}[]", (*ordinals, str(i)), x))
        else:
            yield path, ordinals, v if isinstance(v, str) else json.dumps(v)


def triples_udf(data_keys: str, listed: list[str], wrapper: str | None = None, only: str | None = None):
    """A vectorised function from text to the array of triples; ``only`` keeps paths that match it in full."""

    @pandas_udf(TRIPLES)
    def parse(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, lists = re.compile(data_keys), frozenset(listed)
        keep = re.compile(only) if only else None
        for texts in it:
            yield pd.Series(
                [
                    [
                        {"path": p, "ord": list(o), "value": v}
                        for p, o, v in walk(load_record(t, wrapper), keys, lists)
                        if keep is None or keep.fullmatch(p)
                    ]
                    for t in texts
                ],
                dtype=object,
            )

    return parse


def latest(rows: DataFrame, key: str, version: str, payload: str) -> DataFrame:
    """(key, payload): of each key's rows the one with the latest version; ties take the largest payload.

    A partial maximum per task comes first, so a key with a third of all rows
    sends one row per task through the shuffle.
    """
    return (
        rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key)
        .agg(F.max(F.struct(F.col(version).alias("v"), F.col(payload).alias("p"))).alias("s"))
        .select(key, F.col("s.p").alias(payload))
    )


def triples(records: DataFrame, key: str, text: str, data_keys: str, listed: list[str], wrapper: str | None = None, only: str | None = None) -> DataFrame:
    """(key, path, ord, value): all triples of all records."""
    return (
        records.select(key, F.explode(triples_udf(data_keys, listed, wrapper, only)(F.col(text))).alias("t"))
        .select(key, "t.path", "t.ord", "t.value")
    )


def group_of(path: Column) -> Column:
    """The repeated ancestor of a path: all up to its last ``[]``; '' at the top."""
    return F.regexp_extract(path, r"^(.*\[\])", 1)


def path_groups(tr: DataFrame) -> dict[str, list[str]]:
    """Group -> its paths. The number of paths is that of the schema's fields, not of the data's rows."""
    out: dict[str, list[str]] = {}
    for r in tr.select(group_of(F.col("path")).alias("g"), "path").distinct().collect():
        out.setdefault(r["g"], []).append(r["path"])
    return {g: sorted(p) for g, p in sorted(out.items())}


def pivot_group(tr: DataFrame, key: str, group: str, paths: list[str]) -> DataFrame:
    """One flat table: key, ``o1..on`` (ordinals: all but the last are the parent's key), one column for each path.

    A field whose name is taken by a key column gets the prefix ``field_``.
    """
    n = group.count("*") + group.count("[]")
    own = tr.where(F.col("path").isin(paths))
    taken = {key, "ord", *(f"o{i + 1}" for i in range(n))}
    names = [re.sub(r"\W+", "_", p[len(group):].strip(".")) or "self" for p in paths]
    names = [f"field_{x}" if x in taken else x for x in names]
    cols = [F.max(F.when(F.col("path") == p, F.coalesce("value", F.lit("{}")))).alias(x) for p, x in zip(paths, names)]
    return own.groupBy(key, "ord").agg(*cols).select(key, *[F.col("ord")[i].alias(f"o{i + 1}") for i in range(n)], *names)


CLAIM_KEYS = r"P\d+"
CLAIM_LISTS = ["*", "*[].references", "*[].qualifiers.*", "*[].references[].snaks.*"]
SNAK_GROUPS = {
    "mainsnak": ("*[]", "*[].mainsnak"),
    "qualifier": ("*[].qualifiers.*[]", "*[].qualifiers.*[]"),
    "reference": ("*[].references[].snaks.*[]", "*[].references[].snaks.*[]"),
}


def pivoted_udf(data_keys: str, listed: list[str], wrapper: str | None, groups: dict[str, list[str]]):
    """Text to the rows of all its groups: the triples of a record, pivoted as they come, (group, ord, one value a path of the group).

    All triples of a row lie in one record, so no shuffle is needed to bring them together.
    """
    place = {p: (g, i) for g, ps in groups.items() for i, p in enumerate(ps)}

    @pandas_udf("array<struct<group:string,ord:array<string>,vals:array<string>>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys, lists = re.compile(data_keys), frozenset(listed)

        def rows(text: str | None) -> list[dict]:
            out: dict[tuple, list] = {}
            for path, ordinals, value in walk(load_record(text, wrapper), keys, lists):
                at = place.get(path)
                if at is not None:
                    vals = out.get((at[0], ordinals))
                    if vals is None:
                        vals = out[at[0], ordinals] = [None] * len(groups[at[0]])
                    vals[at[1]] = "{}" if value is None else value
            return [{"group": g, "ord": list(o), "vals": v} for (g, o), v in out.items()]

        for texts in it:
            yield pd.Series([rows(t) for t in texts], dtype=object)

    return run


def claim_triples(entities: DataFrame, key: str = "id", version: str = "discovered_at_utc", text: str = "claims", only: str | None = None) -> DataFrame:
    """Triples of the claims of each entity's latest version."""
    return triples(latest(entities, key, version, text), key, text, CLAIM_KEYS, CLAIM_LISTS, "claims", only)


def claim_tables(entities: DataFrame, key: str = "id", version: str = "discovered_at_utc", text: str = "claims") -> dict[str, DataFrame]:
    """Flat tables of all claims: statements, qualifiers, references, reference_snaks, and orders of lists; every record is parsed once."""
    tr = materialize(claim_triples(entities, key, version, text), "triples")
    return {g: pivot_group(tr, key, g, p) for g, p in path_groups(tr).items() if g}


def snaks(entities: DataFrame, key: str = "id", version: str = "discovered_at_utc", text: str = "claims") -> DataFrame:
    """All snaks of all claims with their entity, property, statement and place.

    The three groups whose rows hold a snak are pivoted together, record by
    record; the only column asked of each is the snak itself.
    """
    parse = pivoted_udf(CLAIM_KEYS, CLAIM_LISTS, "claims", {g: [p] for g, p in SNAK_GROUPS.values()})
    rows = latest(entities, key, version, text).select(key, F.explode(parse(F.col(text))).alias("r")).select(key, "r.group", "r.ord")
    o, num = F.col("ord"), lambda c: c.cast("long")
    section = F.create_map(*[x for k, (g, _) in SNAK_GROUPS.items() for x in (F.lit(g), F.lit(k))])[F.col("group")]
    main, ref = F.col("snak_section") == "mainsnak", F.col("snak_section") == "reference"
    zero = F.lit(0).cast("long")
    return rows.withColumn("snak_section", section).select(
        F.col(key).alias("entity_id"),
        o[0].alias("pid"),
        num(o[1]).alias("statement_no"),
        "snak_section",
        F.when(ref, num(F.get(o, F.lit(2)))).otherwise(zero).alias("section_no"),
        F.when(main, o[0]).when(ref, F.get(o, F.lit(3))).otherwise(F.get(o, F.lit(2))).alias("snak_pid"),
        F.when(main, zero).when(ref, num(F.get(o, F.lit(4)))).otherwise(num(F.get(o, F.lit(3)))).alias("snak_no"),
    )
