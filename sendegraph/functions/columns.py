"""Scalar functions as Column expressions; all stay in generated code, all map null to null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and their base letters.
ACCENTS = ("äöüÄÖÜáàâãåéèêëíìîïóòôõúùûñçýÁÀÂÃÅÉÈÊËÍÌÎÏÓÒÔÕÚÙÛÑÇÝ", "aouAOUaaaaaeeeeiiiioooouuuncyAAAAAEEEEIIIIOOOOUUUNCY")


def blank_to_null(c: Column) -> Column:
    """Blank strings are missing values."""
    return F.when(F.trim(c) != "", c)


def null_to_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def normalize_accents(c: Column) -> Column:
    """Trimmed, lower case, accents dropped, blanks collapsed; the sharp s stays."""
    return F.regexp_replace(F.trim(F.lower(F.translate(c, *ACCENTS))), r"[ \t\r\n]+", " ")


def normalize_words(c: Column) -> Column:
    """Lower case; what is neither letter, digit nor underscore is one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_äöüßáàâéèêíóúñç]+", " "))


def fix_mixed_case(c: Column) -> Column:
    """Each word keeps its first letter and has the rest in lower case; null is blank."""
    w = F.filter(F.split(F.trim(null_to_blank(c)), r"\s+"), lambda x: x != "")
    return F.array_join(F.transform(w, lambda x: F.concat(F.left(x, F.lit(1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), " ")


def name_key(c: Column) -> Column:
    """A name without case and umlauts."""
    k = F.lower(fix_mixed_case(c))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        k = F.replace(k, F.lit(a), F.lit(b))
    return k


def squeeze(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.regexp_replace(F.trim(c), r"[ \t\r\n]+", " "))


def season_token(c: Column) -> Column:
    """``Staffel 3,0`` to ``3``; other texts to their last word in lower case."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^.*staffel +", "")
    n = F.try_to_number(F.regexp_extract(t, r"^([0-9]+)(?:[.,]0+)?$", 1), F.lit("9999"))
    return F.coalesce(n.cast("int").cast("string"), t)


def stable_id(prefix: str, *cols: Column) -> Column:
    """The prefix and twelve hex digits of the parts."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha1(F.concat_ws("|", *[null_to_blank(c) for c in cols])), F.lit(12)))


def parse_date(c: Column) -> Column:
    """``dd.MM.yyyy`` or ``yyyy-MM-dd``; what is no date is null."""
    de = F.when(c.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), F.try_to_date(c, "dd.MM.yyyy"))
    return F.coalesce(de, F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd")))


def duration_minutes(c: Column) -> Column:
    """``75 Min.``, ``31 minutes and 15 seconds``, ``45'30`` or a bare number, in minutes."""
    g = lambda p: F.regexp_extract(F.lower(c), p, 1)
    num = lambda x: F.when(x != "", x.cast("double"))
    m, s = num(g(r"([0-9]+) *(?:min|')")), num(F.coalesce(F.nullif(g(r"([0-9]+) *sec"), F.lit("")), g(r"'([0-9]{1,2})")))
    return F.coalesce(m + F.coalesce(s, F.lit(0.0)) / 60, num(F.regexp_extract(F.trim(c), r"^([0-9]+(?:\.[0-9]+)?)$", 1)))


def end_with_rollover(start: Column, end: Column) -> Column:
    """The end of a broadcast: a day later where it is not after the start."""
    return F.when(end <= start, end + F.expr("interval 1 day")).otherwise(end)


def year_of(c: Column) -> Column:
    """The first four digits in a row, as a year; also of ``+1969-03-16T00:00:00Z``."""
    y = F.regexp_extract(c, r"([0-9]{4})", 1)
    return F.when(y != "", y.cast("int"))


def age_at(birth: Column, event: Column) -> Column:
    """Whole years between two years, where they are 0 to 119."""
    a = event - birth
    return F.when(a.between(0, 119), a)


def url_path(url: Column) -> Column:
    """The path of an address in lower case, without scheme, host, query, fragment and closing slashes."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/]*", ""), r"^/+|/+$", "")


def canonical_url(url: Column, base: str) -> Column:
    """Without fragment, and relative to ``base``."""
    u = F.regexp_replace(url, r"#.*$", "")
    return F.when(u.startswith("/"), F.concat(F.lit(base.rstrip("/")), u)).otherwise(u)


def strip_html(c: Column) -> Column:
    """Tags are blanks, blanks are single."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"[ \t\r\n]+", " "))


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def parse_flag(c: Column) -> Column:
    """True for the usual words of assent; null and anything else is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "ja", "y"), F.lit(False))


def split_list(c: Column, sep: str = r"\|") -> Column:
    """The filled parts of a packed list, trimmed; null gives an empty list."""
    return F.filter(F.transform(F.split(null_to_blank(c), sep), lambda x: F.trim(x)), lambda x: x != "")


def pick_label(labels: Column, *languages: str) -> Column:
    """The first filled label of a JSON object of languages."""
    got = [F.get_json_object(labels, f"$.{x}.value") for x in languages] + [F.get_json_object(labels, f"$.{x}") for x in languages]
    return F.coalesce(*[F.when(~g.startswith("{"), blank_to_null(g)) for g in got])
