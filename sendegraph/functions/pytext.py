"""Plain Python text functions that vectorised operators share.

Each is total: null and empty texts give empty results, and nothing is cut off.
"""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_SOFT = re.compile("[­​‌‍⁠﻿]")
_WORD = re.compile(r"[a-z0-9]+")
_BROKEN = re.compile("[ÂÃÄÅâ][\u0080-¿‘-›ŒœŠšŸŽžƒˆ˜€™]+")

# Spellings of umlauts that count as one.
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa"}
_FOLD = str.maketrans(UMLAUTS)


def _mend(m: re.Match) -> str:
    s = m.group()
    for enc in ("cp1252", "latin-1"):
        try:
            return s.encode(enc).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    try:  # a mixture of both, as browsers make it
        raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in s)
        return raw.decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return s


def mend_encoding(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, put right run by run."""
    for _ in range(2):
        if not _BROKEN.search(text):
            break
        text = _BROKEN.sub(_mend, text)
    return text


def plain(text: str | None) -> str:
    """Text without markup, entities, soft hyphens and damaged encoding; case and punctuation kept."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if re.match(r"</?(?:b|i|em|strong|span|a|u)\b", m.group(), re.I) else " ", text)
    if "&" in text:
        text = html.unescape(text)
    text = mend_encoding(text)
    return _SOFT.sub("", unicodedata.normalize("NFKC", text))


def fold(text: str) -> str:
    """Lower case, umlauts as digraphs, other accents dropped."""
    text = text.lower().translate(_FOLD)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text


def words(text: str | None) -> list[str]:
    """The words of a text with all that TESTDATA calls indifferent removed."""
    return _WORD.findall(fold(plain(text)))
