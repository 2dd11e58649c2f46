"""Rules on names of persons and bodies that the matching operators share.

A *skeleton* is a folded token in which doubled letters count once and umlauts,
however spelt, are their base letter; most slips of typing vanish or become one
edit in it. All functions are total: null and empty names have no readings.
"""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions.pytext import plain

# Titles and forms of address, particles, and pet forms with the
# formal names they stand for.
TITLES = {"dr", "prof", "med", "phil", "jur", "rer", "nat", "ing", "dipl", "habil", "mag", "frau", "herr", "hr", "fr"}
PARTICLES = {"von", "v", "van", "zu", "zur", "vom", "zum", "de", "der", "den", "di"}
PET_NAMES = {
    "heidi": ["adelheid"], "christa": ["christiane"], "conny": ["konrad", "cornelia"], "babs": ["barbara"],
    "rike": ["friederike", "henrike", "ulrike"], "siggi": ["siegfried"], "franzi": ["franziska"], "kathi": ["katharina"],
    "lena": ["magdalena", "helena"], "max": ["maximilian"], "grete": ["margarethe"], "andi": ["andreas"],
    "sandra": ["alexandra"], "hanna": ["johanna"], "lisa": ["elisabeth"], "hans": ["johannes"], "jochen": ["joachim"],
    "bob": ["robert"], "tom": ["thomas"], "alex": ["alexander", "alexandra"], "susi": ["susanne"], "vroni": ["veronika"],
    "flip": ["philipp"], "wolf": ["wolfgang"], "heiner": ["heinrich"], "resi": ["theresa"], "thilde": ["mathilde"],
    "sam": ["samuel"], "willi": ["wilhelm"], "inge": ["ingeborg"], "basti": ["sebastian"], "geli": ["angelika"],
    "matze": ["matthias"], "klaus": ["nikolaus"], "uli": ["ulrich", "ulrike"], "michi": ["michael"], "poldi": ["leopold"],
    "theo": ["theodor"], "lutz": ["ludwig"], "reini": ["reinhold"], "fritz": ["friedrich"], "ferdi": ["ferdinand"],
    "steffi": ["stefanie"], "gabi": ["gabriele"], "moni": ["monika"], "heinz": ["heinrich"], "kalle": ["karl"],
    "toni": ["anton", "antonia"], "ben": ["benedikt", "benjamin"], "nick": ["niklas", "nikolaus"], "kati": ["katharina"],
    "manni": ["manfred"], "rudi": ["rudolf"], "seppl": ["josef"], "sepp": ["josef"], "gitti": ["brigitte"], "vera": ["veronika"],
    "greta": ["margarethe"], "betti": ["elisabeth"], "jule": ["julia"], "dani": ["daniel", "daniela"], "chris": ["christian", "christiane"],
}

# Kinds of bodies with their abbreviations.
KINDS = {
    "bund": ["bd"], "verband": ["vbd", "vb"], "verein": ["v", "ver"], "akademie": ["akad", "ak"], "archiv": ["arch"],
    "gesellschaft": ["ges", "gesell"], "institut": ["inst"], "kammer": ["k", "kam"], "museum": ["mus"],
    "stiftung": ["stift", "stiftg"], "werkstatt": ["werkst", "ws"], "zentrum": ["zentr", "ztr"],
}
FOR = {"fur", "fuer", "f", "fuir"}
LEGAL_FORMS = {"e", "ev", "gmbh", "ag", "mbh", "ggmbh", "eg", "kg"}

_RUN = re.compile(r"(.)\1+")
_TOKEN = re.compile(r"[a-z]+\.*")


@lru_cache(200_000)
def skeleton(token: str) -> str:
    """See above."""
    t = token.lower()
    for a, b in (("ä", "a"), ("ö", "o"), ("ü", "u"), ("ß", "s"), ("ae", "a"), ("oe", "o"), ("ue", "u")):
        t = t.replace(a, b)
    return _RUN.sub(r"\1", re.sub(r"[^a-z0-9]", "", t))


@lru_cache(1)
def formal_names() -> dict[str, tuple[str, ...]]:
    return {skeleton(k): tuple(skeleton(x) for x in v) for k, v in PET_NAMES.items()}


@lru_cache(1)
def pet_names() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for k, v in formal_names().items():
        for x in v:
            out[x] = (*out.get(x, ()), k)
    return out


def given_forms(token: str) -> tuple[str, ...]:
    """A given name with the formal names it may stand for, as skeletons; an initial is one letter."""
    s = skeleton(token)
    return (s, *formal_names().get(s, ()))


def given_letters(token: str) -> set[str]:
    """The first two letters of a given name and of all it may stand for or be called."""
    s = skeleton(token)
    return {c for x in (s, *formal_names().get(s, ()), *pet_names().get(s, ())) for c in x[:2]}


def bare(label: str | None) -> str:
    """A name without brackets, titles, addresses and stray marks; hyphens without blanks."""
    s = plain(label)
    s = re.sub(r"\([^()]*\)?|\[[^\[\]]*\]?", " ", s)
    s = re.sub(r"[‐-―−]", "-", s)
    s = re.sub(r"(?i)\bfrau\s*/\s*herr\b|\bherr\s*/\s*frau\b", " ", s)
    s = re.sub(r"\s+-\s+(?=\w)", "-", s)
    s = re.sub(r"[\"'„“”*]", " ", s)
    out = [t for t in s.split() if t.lower().rstrip(".,") not in TITLES and t.strip("-,.")]
    comma = any(t.endswith(",") and t.lower().rstrip(".,") in TITLES for t in s.split())
    return " ".join(out).strip(" -;" if comma else " -;")


def readings(label: str | None, given_lexicon: frozenset[str] = frozenset()) -> list[tuple[str, tuple[str, ...]]]:
    """(given, family parts) of a name, in each order it may have been typed.

    A comma settles the order; so does an initial, or that exactly one end is a
    known given name. Further given names are left out of the family parts where
    the lexicon knows them.
    """
    s = bare(label)
    if not s:
        return []

    def parts(tokens: list[str]) -> tuple[str, ...]:
        got = [skeleton(p) for t in tokens if t.lower().rstrip(".") not in PARTICLES for p in t.split("-")]
        got = [p for p in got if len(p) > 1]
        rest = [p for p in got if p not in given_lexicon]
        return tuple(dict.fromkeys(rest or got))

    def given(token: str) -> str:
        return skeleton(token.split("-")[0])

    if "," in s:
        fam, _, giv = s.partition(",")
        g = [t for t in giv.replace(",", " ").split() if len(t.rstrip(".")) == 1 or t.lower().rstrip(".") not in PARTICLES]
        f = parts(fam.split())
        if f:
            return [(given(g[0]) if g else "", f)]
        s = giv
    ts = [t for t in s.split() if t.strip(".,-")]
    while len(ts) > 1 and len(ts[0].rstrip(".")) > 1 and ts[0].lower().rstrip(".") in PARTICLES:
        ts = ts[1:]
    if len(ts) == 1:
        f = parts(ts)
        return [("", f)] if f else []
    a, z = given(ts[0]), given(ts[-1])
    straight, turned = (a, parts(ts[1:])), (z, parts(ts[:-1]))
    if len(a) == 1:
        out = [straight]
    elif len(z) == 1:
        out = [turned]
    elif (a in given_lexicon) != (z in given_lexicon):
        out = [straight if a in given_lexicon else turned]
    else:
        out = [straight, turned]
    return [r for r in out if r[1]]


def deletions(s: str, least: int = 5) -> list[str]:
    """A token and all it becomes by dropping one letter; short tokens only themselves. Two tokens one edit apart share a form.

    ``rn`` is also read as ``m``, since the two are taken for each other in print.
    """
    out = [s] if len(s) < least else [s, *(s[:i] + s[i + 1 :] for i in range(len(s)))]
    if "rn" in s:
        out.append(s.replace("rn", "m"))
    return list(dict.fromkeys(out))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most + 1`` where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            c = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, prev2[j - 2] + 1)
            cur.append(c)
        if min(cur) > most:
            return most + 1
        prev2, prev = prev, cur
    return min(prev[-1], most + 1)


@lru_cache(500_000)
def given_match(a: str, b: str, known_a: bool = False, known_b: bool = False) -> float:
    """1 same or pet form, 0.9 one slip, 0.7 initial, 0.5 unknown, 0 different."""
    if not a or not b:
        return 0.5
    fa, fb = given_forms(a), given_forms(b)
    if len(a) == 1 or len(b) == 1:
        return 0.7 if {x[0] for x in fa} & {x[0] for x in fb} else 0.0
    if set(fa) & set(fb):
        return 1.0
    if known_a and known_b:
        return 0.0
    near = [(skeleton(a), y) for y in (*fb, *pet_names().get(skeleton(b), ()))] + [(skeleton(b), x) for x in (*fa, *pet_names().get(skeleton(a), ()))]
    if any(min(len(x), len(y)) >= 3 and (edits(x, y, 1) <= 1 or x.replace("rn", "m") == y.replace("rn", "m")) for x, y in near):
        return 0.9
    if any(min(len(x), len(y)) >= 6 and edits(x, y, 2) <= 2 for x, y in near):
        return 0.75
    return 0.0


def _part(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = min(len(a), len(b))
    if n >= 4 and (edits(a, b, 1) <= 1 or a.replace("rn", "m") == b.replace("rn", "m")):
        return 0.9
    if n >= 8 and edits(a, b, 2) <= 2:
        return 0.75
    return 0.0


def family_match(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How well two lists of family parts agree: all parts of the shorter one must; a part left out costs a little."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    total = 1.0
    for x in a:
        best = max(_part(x, y) for y in b)
        if best == 0.0 and len(a) > 1:
            joined = _part("".join(a), "".join(b))
            return joined
        total = min(total, best)
    if len(a) < len(b):
        total = max(total * 0.85, _part("".join(a), "".join(b)))
    return total


def name_match(ra: list[tuple[str, tuple[str, ...]]], rb: list[tuple[str, tuple[str, ...]]], lexicon: frozenset[str] = frozenset()) -> float:
    """The best agreement of two names over their readings: given times family."""
    best = 0.0
    for ga, fa in ra:
        for gb, fb in rb:
            f = family_match(fa, fb)
            if f > best:
                best = max(best, f * given_match(ga, gb, ga in lexicon, gb in lexicon))
    return best


@lru_cache(1)
def kind_forms() -> dict[str, str]:
    out = {skeleton(k): skeleton(k) for k in KINDS}
    out.update({a: skeleton(k) for k, v in KINDS.items() for a in v})
    return out


@lru_cache(100_000)
def kind_of(token: str) -> str | None:
    """The kind of body a token names, in full, abbreviated or with one slip; else None."""
    s = skeleton(token)
    forms = kind_forms()
    full = [k for k in map(skeleton, KINDS)]
    if s in full or (token.endswith(".") and s in forms):
        return forms[s]
    if len(s) >= 4:
        for k in full:
            if edits(s, k, 1) <= 1:
                return k
    return None


RESIDUAL = "="  # no skeleton holds it


def residual(label: str | None) -> str:
    """The tokens of any name of a body, without legal forms, in order of the alphabet; marked, as no theme begins so."""
    s = re.sub(r"(?i)\be\s*\.\s*v\s*\.?(?=$|[\s,)])", " ", plain(label))
    got = sorted({t for t in (skeleton(x) for x in re.split(r"[^\w.&]+", s)) if t and t not in LEGAL_FORMS})
    return f"{RESIDUAL} {' '.join(got)}" if got else ""


_ACRONYM = re.compile(r"^[A-ZÄÖÜ][a-z]?[A-ZÄÖÜ]{2,5}$")


def body(label: str | None) -> dict:
    """function, kind, theme, town and acronym (skeletons, '' where absent) out of any writing of a body or of a function in it.

    Writings: *kind* für *theme* *town*; *town*: *kind* für *theme*; *theme*-*kind*
    *town*; abbreviated kinds; a legal form at the end; an acronym with or without
    the town; with a function before, after or around it, or a function alone.
    """
    out = {"function": "", "kind": "", "theme": "", "town": "", "acronym": "", "short": False}
    s = plain(label)
    s = re.sub(r"[‐-―−]", "-", s)
    s = re.sub(r"(?i)\bdes\s*/\s*der\b", " ", s)
    s = re.sub(r"(?i)\be\s*\.\s*v\s*\.?(?=$|[\s,)])", " ", s)
    s = re.sub(r"(?i)\bf\.(?=\s)", "für", s)
    s = re.sub(r"[(),;]", " ", s)
    ts = [t for t in s.split() if re.search(r"\w", t) and not (skeleton(t) in LEGAL_FORMS and len(t) > 1)]
    town = [t for t in ts if t.endswith(":")]
    used = set(town[:1])
    if town:
        out["town"] = skeleton(town[0])
    rest = [t for t in ts if t not in used]
    f = next((i for i, t in enumerate(rest) if skeleton(t) in FOR and 0 < i < len(rest) - 1), None)
    taken: set[int] = set()
    if f is not None:
        k = kind_of(rest[f - 1]) or skeleton(rest[f - 1])
        out["kind"], out["theme"] = k, skeleton(rest[f + 1])
        taken = {f - 1, f, f + 1}
        nxt = f + 2
    else:
        k = next((i for i, t in enumerate(rest) if i + 1 < len(rest) and "-" not in t.strip("-") and kind_of(t)), None)
        h = next((i for i, t in enumerate(rest) if "-" in t.strip("-") and kind_of(t.rsplit("-", 1)[1])), None)
        if h is not None:
            theme, kind = rest[h].rsplit("-", 1)
            out["kind"], out["theme"], taken, nxt = kind_of(kind), skeleton(theme), {h}, h + 1
        elif k is not None:
            out["kind"], out["theme"], taken, nxt = kind_of(rest[k]), skeleton(rest[k + 1]), {k, k + 1}, k + 2
        else:
            a = next((i for i, t in enumerate(rest) if _ACRONYM.match(t) and not (t.isupper() and all(x.isupper() for x in rest))), None)
            if a is None:
                a = next((i for i, t in enumerate(rest) if _ACRONYM.match(t) and len(rest) > 1 and len(t) <= 6), None)
            nxt = None
            if a is not None:
                out["acronym"], taken, nxt = rest[a].lower().translate(str.maketrans("äöü", "aou")), {a}, a + 1
    if nxt is not None and not town and nxt < len(rest):
        out["town"] = skeleton(rest[nxt])
        taken.add(nxt)
    func = [t for i, t in enumerate(rest) if i not in taken]
    out["short"] = any(t.endswith(".") for t in func)
    out["function"] = "-".join(skeleton(p) for t in func for p in re.split(r"[-.]", t) if skeleton(p)) if out["short"] else " ".join(skeleton(t) for t in func)
    return out
