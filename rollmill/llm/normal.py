"""Text as words, with case, markup, escapes and damaged encodings taken out."""

from __future__ import annotations

import html
import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_NEEDS_CARE = re.compile(r"[&\\<]")
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL_ESCAPE = re.compile(r"\\[nrt](?![a-z])")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|<\|[^<>|]{0,40}\|>")
_UNSEEN = re.compile("[­​-‏⁠﻿]")
_MOJIBAKE = re.compile("[ÂÃÄÅâ][\u0080-¿Œ-˜–-™]{1,2}")
#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("асеорхуіѕјһԁԛԝαοεικνρτυχ", "aceopxyisjhdqwaoeikvptux")


def _mend(match: re.Match[str]) -> str:
    try:
        return match[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return match[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return match[0]


def plain(text: str) -> str:
    """Lower-case text without markup, escapes, accents, invisible or look-alike characters; characters mangled by a wrong decoding are mended."""
    simple = text.isascii()
    if _NEEDS_CARE.search(text):
        text = _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = _CONTROL_ESCAPE.sub(" ", text)
        text = html.unescape(text)
        text = _TAG.sub(" ", text)
        simple = simple and text.isascii()
    if simple:
        return text.lower()
    text = _MOJIBAKE.sub(_mend, _UNSEEN.sub("", text))
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return text.translate(LOOKALIKES)


def words(text: str) -> list[str]:
    """The runs of letters or digits of the plain text."""
    return _WORD.findall(plain(text))
