"""Several values packed in one field, by minimum description length.

A dialect is a way to read a packed field: a delimiter, alone or with a word
before the last value, or a JSON list, and a mode: plain, with quotes, with
escapes, or both. Each field is parsed by every dialect that applies to it; a
parse costs the bits of its values plus those of the dialect, and the cheapest is
taken. A value may itself hold the delimiter: within a dialect neighbouring
pieces may be one value where that value also stands as a piece of its own in a
reading of another field (or in the codebook), and the cheapest segmentation
counts. How many pieces may be glued is thus found in the table.

The bits of a value come from counts over all fields of the table: a value that
is used c times out of C costs log2(C / c), plus its spelling (``CHAR_BITS`` for
each character) shared among its c uses. The bits of a dialect are those of its
delimiter and those of its mode among the modes that read the field differently:
fields without a quote tell nothing about quoting. First the single pieces of all
parses of a field count in equal parts, then only the chosen values, until the
description of the table gets no shorter.

Work is done once for each distinct packed text, so copies - also one text that
fills a third of the table - cost nothing further.

Defined results: null and blank fields and those without a letter or digit give no rows; positions
count from 1 and skip empty places; a value that occurs twice in a field keeps
both positions; ties go to the parse with fewer values, then to the dialect
named first below.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialize

# Delimiters and the words that may stand before the last value.
DELIMITERS = ["|", ";", "；", "\n", "\t", "•", ",", "/", "&"]
LAST_WORDS = ["und", "sowie", "u.", "oder", "and"]
CHAR_BITS = 6.0
PRIVATE_USE = [(0xE000, 0xF900), (0xF0000, 0xFFFFE), (0x100000, 0x10FFFE)]  # code points of no character, by the standard
BLANKS = " \t\r\n ​‌﻿"


def split_quoted(text: str, delimiter: str) -> list[str]:
    """Split at a delimiter; a value that opens with a quote ends at its closing quote, doubled or escaped ones inside."""
    out, i, n = [], 0, len(text)
    while True:
        j = i
        while j < n and text[j] in BLANKS and text[j] != delimiter:
            j += 1
        if j < n and text[j] == '"':
            k, buf = j + 1, []
            while k < n:
                if text[k] == "\\" and k + 1 < n:
                    buf.append(text[k + 1])
                    k += 2
                elif text[k] == '"' and k + 1 < n and text[k + 1] == '"':
                    buf.append('"')
                    k += 2
                elif text[k] == '"':
                    break
                else:
                    buf.append(text[k])
                    k += 1
            e = k + 1
            while e < n and text[e] in BLANKS and text[e] != delimiter:
                e += 1
            if k < n and (e >= n or text[e] == delimiter):
                out.append("".join(buf))
                if e >= n:
                    return out
                i = e + 1
                continue
        e = text.find(delimiter, i)
        if e < 0:
            out.append(text[i:])
            return out
        out.append(text[i:e])
        i = e + 1


def runs(pieces: list[str], delimiter: str | None, fixed: list[bool] | None = None, glue: int = 1) -> list[tuple[int, int, str]]:
    """(from, to, value): each piece, and each run of up to ``glue`` neighbouring pieces joined by the delimiter; blank pieces left out."""
    out, clean, n = [], [p.strip(BLANKS) for p in pieces], 0
    for i, v in enumerate(clean):
        if not v:
            continue
        out.append((n, n + 1, v))
        if delimiter is not None and not (fixed and fixed[i]):
            for j in range(i + 2, min(i + glue, len(pieces)) + 1):
                if not clean[j - 1] or (fixed and fixed[j - 1]):
                    break
                out.append((n, n + j - i, delimiter.join(pieces[i:j]).strip(BLANKS)))
        n += 1
    return out


def hide_escapes(text: str) -> tuple[str, dict[int, str]]:
    """The text with each escaped character as a private one that the text does not hold, and what the private ones stand for."""
    taken, marks = set(text), {}
    free = (chr(x) for lo, hi in PRIVATE_USE for x in range(lo, hi) if chr(x) not in taken)

    def hide(m: re.Match) -> str:
        c = m.group(1)
        if c not in marks:
            marks[c] = next(free)
        return marks[c]

    return re.sub(r"\\(.)", hide, text, flags=re.S), {ord(v): k for k, v in marks.items()}


def parses(text: str | None, glue: dict[str, int] | None = None) -> list[tuple[str, str, list[tuple[int, int, str]]]]:
    """The distinct parses of a packed text: (delimiter, mode, runs), in order; ``glue`` is how many pieces may be one value, by delimiter."""
    if text is None or not any(c.isalnum() for c in text):
        return []
    glue = glue or {}
    found: list[tuple[str, str, list[tuple[int, int, str]]]] = []
    seen = set()

    def add(name: str, mode: str, got: list[tuple[int, int, str]]) -> None:
        key = tuple(got)
        if got and key not in seen:
            seen.add(key)
            found.append((name, mode, got))

    if text.lstrip(BLANKS).startswith("["):
        try:
            got = json.loads(text)
            if isinstance(got, list):
                add("json", "plain", runs([x for x in got if isinstance(x, str)], None))
        except ValueError:
            pass

    def read(t: str, escaped: bool, hidden: dict[int, str]) -> None:
        quotes = '"' in t
        plain, quoted = ("escaped", "quoted escaped") if escaped else ("plain", "quoted")
        put = lambda name, mode, got: add(name, mode, [(i, j, v.translate(hidden)) for i, j, v in got] if hidden else got)
        put("single", plain, runs([t], None))
        if quotes:
            put("single", quoted, runs(split_quoted(t, "\0"), None))
        for d in DELIMITERS:
            if d in t:
                cut = t.split(d)
                put(d, plain, runs(cut, d, None, glue.get(d, 1)))
                if quotes:
                    pieces, bare = split_quoted(t, d), set(cut)
                    put(d, quoted, runs(pieces, d, [p not in bare for p in pieces], glue.get(d, 1)))
        for w in LAST_WORDS:
            if w not in t:
                continue
            parts = re.split(rf"\s{re.escape(w)}\s", t)
            if len(parts) == 1:
                continue
            put(w, plain, runs(parts, f" {w} ", None, glue.get(w, 1)))
            if quotes:
                put(w, quoted, runs([x for p in parts for x in split_quoted(p, "\0")], None))
            for k in range(1, len(parts)):
                front, tail = f" {w} ".join(parts[:k]), f" {w} ".join(parts[k:])
                both = [(plain, front.split(","), [tail])] + ([(quoted, split_quoted(front, ","), split_quoted(tail, "\0"))] if quotes else [])
                for mode, pieces, last in both:
                    got = runs(pieces, ",", None, glue.get(",", 1))
                    n = max((j for _, j, _ in got), default=0)
                    put(f", {w}", mode, got + [(n + i, n + j, v) for i, j, v in runs(last, None)])

    read(text, False, {})
    if "\\" in text:
        read(*(lambda t, h: (t, True, h))(*hide_escapes(text)))
    return found


def parses_udf(glue: dict[str, int] | None = None):
    """The vectorised :func:`parses`; ``modes`` are those that read the text differently."""

    @pandas_udf("array<struct<dialect:string,mode:string,modes:string,runs:array<struct<i:int,j:int,v:string>>>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> list[dict]:
            got = parses(t, glue)
            modes = " or ".join(sorted({m for _, m, _ in got}))
            return [{"dialect": d, "mode": m, "modes": modes, "runs": [{"i": i, "j": j, "v": v} for i, j, v in r]} for d, m, r in got]

        for texts in it:
            yield pd.Series([one(t) for t in texts], dtype=object)

    return run


def segment_udf():
    """The cheapest segmentation of the runs of one parse: its bits and its values; ties take fewer values."""

    @pandas_udf("struct<bits:double,vals:array<string>>")
    def run(col: pd.Series) -> pd.DataFrame:
        bits, vals = [], []
        for rs in col:
            end = max(r["j"] for r in rs)
            best: list = [(0.0, 0, ())] + [None] * end
            for r in sorted(rs, key=lambda r: (r["j"], r["i"])):
                b = best[r["i"]]
                c = (round(b[0] + r["bits"], 9), b[1] + 1, (*b[2], r["v"]))
                if best[r["j"]] is None or c < best[r["j"]]:
                    best[r["j"]] = c
            bits.append(best[end][0])
            vals.append(list(best[end][2]))
        return pd.DataFrame({"bits": bits, "vals": vals})

    return run


def _chosen(cands: DataFrame, codes: DataFrame, dialects: DataFrame, modes: DataFrame) -> DataFrame:
    """(text, dialect, mode, modes, vals, n, bits): the cheapest parse of each packed text. Dialects and modes are a few rows."""
    cut = (
        cands.select("text", "k", F.explode("runs").alias("r")).select("text", "k", "r.i", "r.j", "r.v").join(codes, "v")
        .groupBy("text", "k").agg(F.collect_list(F.struct("i", "j", "v", "bits")).alias("rs")).select("text", "k", segment_udf()("rs").alias("s"))
    )
    full = F.round(F.col("s.bits") + F.col("dialect_bits") + F.col("mode_bits"), 6)
    return (
        cut.join(cands.select("text", "k", "n", "dialect", "mode", "modes"), ["text", "k"])
        .join(dialects, "dialect")
        .join(modes, ["modes", "mode"])
        .groupBy("text")
        .agg(F.min(F.struct(full.alias("bits"), F.size("s.vals").alias("l"), "k", "dialect", "mode", "modes", "s.vals", "n")).alias("s"))
        .select("text", "s.dialect", "s.mode", "s.modes", "s.vals", "s.n", "s.bits")
    )


def _codes(weighted: DataFrame, values: DataFrame, codebook: DataFrame | None, codebook_weight: float) -> DataFrame:
    """(v, bits) of all candidate values; ``weighted`` has (v, w): their uses."""
    w = values.select("v", F.lit(0.0).alias("w")).unionByName(weighted)
    if codebook is not None:
        w = w.unionByName(codebook.select(F.col("v"), F.lit(codebook_weight).alias("w")))
    w = w.groupBy("v").agg(F.sum("w").alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    c = F.col("w") + F.lit(0.01)
    spelling = F.length("v") * F.lit(CHAR_BITS)
    return w.crossJoin(F.broadcast(total)).select("v", (F.log2((F.col("total") + 1) / c) + spelling / F.greatest(c, F.lit(1.0))).alias("bits"))


def _choice_bits(cands: DataFrame, uses: DataFrame, given: list[str], choice: str, name: str) -> DataFrame:
    """(*given, choice, name): the bits of a choice by its share of the uses; a few rows."""
    d = cands.select(*given, choice).distinct().join(uses.groupBy(*given, choice).agg(F.sum("w").alias("w")), [*given, choice], "left")
    total = Window.partitionBy(*given) if given else Window.partitionBy(F.lit(0))
    return d.select(*given, choice, (-F.log2((F.coalesce("w", F.lit(0.0)) + 0.5) / (F.sum(F.coalesce("w", F.lit(0.0))).over(total) + 0.5))).alias(name))


def _glue(pieces: DataFrame, codebook: DataFrame | None) -> dict[str, int]:
    """How many pieces the longest value holds that stands on its own in two fields or more, by delimiter; one row comes to the driver."""
    own = pieces.where("seen_low <> seen_high").select("v")
    own = own if codebook is None else own.unionByName(codebook.select("v"))
    marks = [*DELIMITERS, *LAST_WORDS]
    text = lambda m: m if m in DELIMITERS else f" {m} "
    most = own.agg(*[F.max((F.length("v") - F.length(F.replace("v", F.lit(text(m)), F.lit("")))) / len(text(m))).alias(f"m{i}") for i, m in enumerate(marks)]).first()
    return {m: int(most[i] or 0) + 1 for i, m in enumerate(marks)}


def split_packed(rows: DataFrame, key: str, fields: list[str], codebook: DataFrame | None = None, codebook_weight: float = 5.0) -> DataFrame:
    """(key, field_name, value_pos, value_text): one row for each value of each field of each key.

    ``codebook`` has (v). The crossJoins are with totals of one row.
    """
    long = rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("packed")) for f in fields])).alias("x")).select("key", "x.field", "x.packed")
    long = long.where(F.col("key").isNotNull() & F.col("packed").isNotNull()).distinct()
    texts = materialize(long.groupBy("field", "packed").agg(F.count("*").alias("n")).withColumn("text", F.monotonically_increasing_id()), "packed")

    def read(glue: dict[str, int] | None) -> DataFrame:
        return (
            texts.withColumn("p", parses_udf(glue)("packed")).withColumn("parts", F.size("p"))
            .select("text", "n", "parts", F.posexplode("p").alias("k", "c"))
            .select("text", "n", "parts", "k", "c.dialect", "c.mode", "c.modes", "c.runs")
        )

    cands = materialize(read(None), "parses")
    uses = cands.select("text", "dialect", "mode", "modes", F.col("runs.v").alias("vals"), (F.col("n") / F.col("parts")).alias("w"))
    pieces = uses.select(F.explode("vals").alias("v"), "w", "text").groupBy("v").agg(F.sum("w").alias("w"), F.min("text").alias("seen_low"), F.max("text").alias("seen_high"))
    pieces = materialize(pieces, "pieces")
    glue = _glue(pieces, codebook)
    if max(glue.values()) > 1:
        cands = materialize(read(glue), "parses")
    weighted, best, before = pieces.select("v", "w"), None, None
    while True:
        codes = _codes(weighted, pieces.select("v"), codebook, codebook_weight)
        now = materialize(_chosen(cands, codes, _choice_bits(cands, uses, [], "dialect", "dialect_bits"), _choice_bits(cands, uses, ["modes"], "mode", "mode_bits")), "chosen")
        bits = now.agg(F.coalesce(F.sum(F.col("bits") * F.col("n")), F.lit(0.0))).first()[0]
        if before is not None and bits >= 0.999 * before:
            best = now if bits < before else best
            break
        best, before = now, bits
        uses = best.select("dialect", "mode", "modes", "vals", F.col("n").cast("double").alias("w"))
        weighted = uses.select(F.explode("vals").alias("v"), "w").groupBy("v").agg(F.sum("w").alias("w"))
    return (
        long.join(texts.join(best.select("text", "vals"), "text").select("field", "packed", "vals"), ["field", "packed"])
        .select(F.col("key").alias(key), F.col("field").alias("field_name"), F.posexplode("vals").alias("pos", "value_text"))
        .select(key, "field_name", (F.col("pos") + 1).cast("long").alias("value_pos"), "value_text")
    )
