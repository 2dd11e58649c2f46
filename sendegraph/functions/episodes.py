"""Fields of broadcast texts and pages, and small rules on labels, colours, languages and budgets. All are Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import blank_to_null, parse_date, season_token, stable_id, strip_html

# Labels of the fields in a text block, and the patterns of what follows them.
FIELDS = {
    "title": r"(?i)Sendetitel[ \t]*\n?[ \t]*([^\n]+)",
    "archive_no": r"(?i)Archivnummer\s*(\d+)",
    "production_no": r"(?i)Prod-Nr\s+Beitrag\s*([0-9]{5}/[0-9]{5})",
    "tc_start": r"(?i)Zeit\s+TC\s+(\d{2}:\d{2}:\d{2})\s*-\s*\d{2}:\d{2}:\d{2}",
    "tc_end": r"(?i)Zeit\s+TC\s+\d{2}:\d{2}:\d{2}\s*-\s*(\d{2}:\d{2}:\d{2})",
    "length": r"\b(\d{2,3}'\d{2})\b",
    "season_no": r"(?i)\bStaffel\s+(\d+)\b",
    "episode_no": r"(?i)\bFolge\s+(\d+)\b",
    "number": r"(?i)\bFolgenNr\s+(\d+)\b",
}
INFO = r"(?is)Sachinhalt(.*?)(?:Jugendeignung|Bearbeiter|Autor/|Kategorie|Schlagwörter|$)"
FIRST_YEAR = 2007


def block_field(text: Column, name: str) -> Column:
    """One field of a text block; blank if it is not there."""
    return F.coalesce(F.trim(F.regexp_extract(text, FIELDS[name], 1)), F.lit(""))


def info_block(text: Column) -> Column:
    """What a broadcast is about: the part between its label and the next one, in one line."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, INFO, 1), r"\s+", " "))


def block_date(text: Column) -> Column:
    """The first date after the label of publications, else the first of the text; blank if there is none."""
    day = r"(\d{2}\.\d{2}\.\d{4})"
    after = F.regexp_extract(text, r"(?s)Publikation.*?" + day, 1)
    return F.coalesce(F.when(after != "", after), F.regexp_extract(text, day, 1))


def season_label(show: str, season: Column, title: Column, day: Column) -> Column:
    """``<show>, Staffel n``: the given number, else, where the title is the show and a date, the year less the first one; else blank."""
    year = F.year(F.try_to_date(day, "dd.MM.yyyy")) - FIRST_YEAR
    dated = title.rlike(rf"^{re.escape(show)} \d{{2}}\.\d{{2}}\.\d{{4}}$")
    given = F.when(season != "", season).when(dated, year.cast("string"))
    return F.coalesce(F.concat(F.lit(f"{show}, Staffel "), given), F.lit(""))


def episode_rows(df: DataFrame, key: str, text: str, show: str) -> DataFrame:
    """One row for each text block: its fields, season and a stable id; blank blocks have no row."""
    t = F.col(text)
    d = df.where(F.trim(t) != "").select(F.col(key), *[block_field(t, n).alias(n) for n in FIELDS], block_date(t).alias("day"), info_block(t).alias("infos"))
    d = d.withColumn("season", season_label(show, F.col("season_no"), F.col("title"), F.col("day")))
    return d.withColumn("episode_id", stable_id("ep", F.col("title"), F.col("day"), F.col("number")))


def season_mismatch(a: Column, b: Column) -> Column:
    """Whether two writings of a season mean different ones; blank ones agree with any."""
    x, y = blank_to_null(a), blank_to_null(b)
    return F.coalesce(season_token(x) != season_token(y), F.lit(False))


# Where the pages keep what they tell.
PAGE = {
    "title": r"(?is)<h3[^>]*episode-output-titel.*?itemprop=.name.[^>]*>(.*?)</span>",
    "heading": r"(?is)<h1[^>]*>(.*?)</h1>",
    "subheading": r"(?is)<h2[^>]*>(.*?)</h2>",
    "duration": r"(?is)episoden-zeile-1000[^>]*>\s*<div[^>]*>(.*?)</div>",
    "description": r"(?is)episode-output-inhalt-inner[^>]*>(.*?)</div>",
    "description_source": r"(?is)text-quelle[^>]*>\s*\((.*?)\)\s*</span>",
    "premiere_date": r"(?is)<ea-angabe-datum>(.*?)</ea-angabe-datum>",
    "premiere_sender": r"(?is)<ea-angabe-sender>(.*?)</ea-angabe-sender>",
    "cast": r"(?is)<h2[^>]*Cast-Crew.*?</h2>.*?<ul[^>]*cast-crew[^>]*>(.*?)</ul>",
    "dates": r"(?is)<h2[^>]*Sendetermine.*?</h2>(.*?)</section>",
}
ANCHOR = r"(?is)(<a[^>]*liste-cast-crew[^>]*>.*?</a>)"
GUEST = {
    "name": r"(?is)<dt[^>]*itemprop=.name.[^>]*>(.*?)</dt>", "title": r"(?is)^<a[^>]*?title=[\"']([^\"'>]+)", "text": r"(?is)<dd[^>]*>\s*<p>(.*?)</p>",
    "url": r"(?is)^<a[^>]*?href=[\"']([^\"'>]+)", "image": r"(?is)<meta[^>]*itemprop=.image.[^>]*content=[\"']([^\"'>]+)", "lazy": r"(?is)data-src=[\"']([^\"'>]+)",
}
BROADCAST = {
    "start": r"(?is)startDate[^>]*?datetime=[\"']([^\"'>]+)", "end": r"(?is)endDate[^>]*?datetime=[\"']([^\"'>]+)", "sender": r"(?is)itemprop=.name.[^>]*?content=[\"']([^\"'>]+)",
}


def first_group(html: Column, pattern: str) -> Column:
    """The text of the first match without markup; blank if there is none."""
    return F.coalesce(strip_html(F.regexp_extract(html, pattern, 1)), F.lit(""))


def leaf_page(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, description, description_source, duration, premiere_date, premiere_sender, guests, broadcasts, confidence) of an episode's page.

    guests: array of (name, role, description, url, image, position, confidence);
    broadcasts: array of (start, end, sender, premiere, position, confidence).
    Confidences add up over what is found, to at most 0.98. Null pages have blank
    fields and empty lists.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    score = lambda base, *parts: F.round(F.least(F.lit(0.98), sum((F.when(c, v).otherwise(0.0) for c, v in parts), F.lit(base))), 3)
    either = lambda a, b: F.when(a != "", a).otherwise(b)

    def guest(a: Column, i: Column) -> Column:
        g = {k: F.trim(F.regexp_extract(a, x, 1)) for k, x in GUEST.items()}
        name = either(strip_html(g["name"]), g["title"])
        lines = F.filter(F.transform(F.split(g["text"], r"(?i)<br\s*/?>"), strip_html), lambda x: x != "")
        role, rest = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), " ")
        conf = score(0.55, (name != "", 0.25), (role != "", 0.10), (g["url"] != "", 0.08))
        return F.struct(name.alias("name"), role.alias("role"), rest.alias("description"), g["url"].alias("url"), either(g["image"], g["lazy"]).alias("image"), i.cast("long").alias("position"), conf.alias("confidence"))

    def broadcast(b: Column, i: Column) -> Column:
        g = {k: F.trim(F.regexp_extract(b, x, 1)) for k, x in BROADCAST.items()}
        conf = score(0.50, (g["start"] != "", 0.28), (g["end"] != "", 0.12), (g["sender"] != "", 0.08))
        return F.struct(*[g[k].alias(k) for k in BROADCAST], (b.contains("TV-Premiere") | b.contains("NEU")).alias("premiere"), i.cast("long").alias("position"), conf.alias("confidence"))

    anchors = F.regexp_extract_all(F.regexp_extract(h, PAGE["cast"], 1), F.lit(ANCHOR), 1)
    cuts = F.split(F.regexp_extract(h, PAGE["dates"], 1), r"(?i)(?=startDate)")
    d = df.select(
        key, either(first_group(h, PAGE["title"]), first_group(h, PAGE["heading"])).alias("title"), either(first_group(h, PAGE["description"]), first_group(h, PAGE["subheading"])).alias("description"),
        *[first_group(h, PAGE[k]).alias(k) for k in ("description_source", "duration", "premiere_date", "premiere_sender")],
        F.transform(anchors, guest).alias("guests"), F.transform(F.slice(cuts, F.lit(2), F.size(cuts)), broadcast).alias("broadcasts"),
    )
    aired = (F.col("premiere_date") != "") | (F.col("premiere_sender") != "")
    return d.withColumn("confidence", score(0.5, (F.col("title") != "", 0.2), (F.col("description") != "", 0.2), (aired, 0.08)))


def column_name(c: Column) -> Column:
    """A name for a column: letters, digits and underscores, none at the ends, in lower case; a blank one is ``value``."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(n, F.lit("")), F.lit("value"))


def rgba(colour: Column, alpha: float) -> Column:
    """``#rrggbb`` as ``rgba(r, g, b, a)``; anything else stays."""
    part = lambda i: F.conv(F.substring(F.trim(colour), i, 2), 16, 10)
    ok = F.trim(colour).rlike(r"^#[0-9a-fA-F]{6}$")
    return F.when(ok, F.concat(F.lit("rgba("), part(2), F.lit(", "), part(4), F.lit(", "), part(6), F.lit(f", {alpha})"))).otherwise(colour)


def budget(c: Column) -> Column:
    """A number of queries: -1 is no limit, other negatives and what is no number are 0."""
    text = F.trim(c.cast("string"))
    n = F.when(text.rlike(r"^[+-]?\d{1,9}$"), F.regexp_replace(text, r"^\+", "")).cast("int")
    return F.when(n == -1, -1).when(n >= 0, n).otherwise(0)


def enabled_languages(spec: Column, last: str = "mul") -> Column:
    """The languages of a list, each once, in order, with the bucket for all of them at the end; a list of none is an error of the caller and null here."""
    got = F.array_distinct(F.filter(F.transform(F.split(F.lower(spec), r"[,;\s]+"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(got) > 0, F.concat(F.filter(got, lambda x: x != last), F.array(F.lit(last))))


def only_languages(texts: Column, languages: Column) -> Column:
    """A JSON object of languages with those of the list only."""
    m = F.from_json(texts, "map<string,string>")
    return F.map_filter(m, lambda k, _: F.array_contains(languages, k))


def inlinks_query(target: Column, limit: int, offset: int, predicate: str | None = None) -> Column:
    """The text of a query for what points at an item, page by page in order of the ids."""
    edge = f"wdt:{predicate}" if predicate else "?p"
    return F.concat(F.lit(f"SELECT DISTINCT ?source WHERE {{ ?source {edge} wd:"), target, F.lit(f" . }} ORDER BY ?source LIMIT {limit} OFFSET {offset}"))


def label_query(label: Column, cls: str, language: str = "de", prefix: bool = False) -> Column:
    """The text of a query for items of a class or its subclasses with a label, or one that begins so."""
    safe = F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    head = F.lit(f"SELECT ?item ?label WHERE {{ ?item wdt:P31/wdt:P279* wd:{cls} . ?item rdfs:label ?label . ")
    test = F.concat(F.lit('FILTER(STRSTARTS(LCASE(?label), LCASE("'), safe, F.lit('")))')) if prefix else F.concat(F.lit('FILTER(LCASE(?label) = LCASE("'), safe, F.lit('"))'))
    return F.concat(head, test, F.lit(f' FILTER(LANG(?label) = "{language}") }} ORDER BY ?item'))


def mention_targets(df: DataFrame, kind: str, key: str, label: str, context: str) -> DataFrame:
    """(mention_id, mention_type, label, context, source_id): rows of any table of mentions as targets for a search; blank labels are none."""
    d = df.select(F.col(key).cast("string").alias("source_id"), blank_to_null(F.col(label)).alias("label"), F.col(context).cast("string").alias("context")).where("label IS NOT NULL")
    return d.select(stable_id("cgm", F.lit(kind), F.col("source_id"), F.col("label")).alias("mention_id"), F.lit(kind).alias("mention_type"), "label", "context", "source_id").distinct()


def with_normal_forms(df: DataFrame, dates: list[str]) -> DataFrame:
    """All columns with ``<column>_norm``, and ``<column>_date`` for those named."""
    from .columns import normalize_accents

    plus = [normalize_accents(F.col(c).cast("string")).alias(f"{c}_norm") for c in df.columns] + [parse_date(F.col(c)).alias(f"{c}_date") for c in dates]
    return df.select("*", *plus)
