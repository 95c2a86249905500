"""Sentences by rules: where a full stop ends one, and where it belongs to an abbreviation, a number or a name."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words whose full stop ends nothing, name endings, endings of web addresses, words that begin a sentence after an abbreviation.
TITLES = ("Mr", "St", "Mrs", "Ms", "Dr")
ENDINGS = ("Inc", "Ltd", "Jr", "Sr", "Co")
DOMAINS = ("com", "net", "org", "io", "gov", "edu", "me")
STARTERS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Capt", "Cpt", "Lt", "He ", "She ", "It ", "They ", "Their ", "Our ", "We ", "But ", "However ", "That ", "This ", "Wherever")

_MARK = re.compile(r"\.{2,}|[.?!]")
_STARTS = re.compile("(?:" + "|".join(re.escape(s.strip()) + (r"\s" if s.endswith(" ") else "") for s in STARTERS) + ")")
_TITLE = re.compile(r"(?:" + "|".join(TITLES) + r")$")
_ENDING = re.compile(r"\s(?:" + "|".join(ENDINGS) + r")$")
_LETTER = re.compile(r"\s[A-Za-z]$")
_INITIALS = re.compile(r"[A-Za-z](?:\.[A-Za-z])+$")
_IN_INITIALS = re.compile(r"[A-Za-z]\.")
_DOMAIN = re.compile("(?:" + "|".join(DOMAINS) + ")")


def ends_sentence(text: str, at: int) -> bool:
    """Whether the single full stop at this place ends a sentence."""
    before, after = text[max(0, at - 40) : at], text[at + 1 : at + 20]
    if _TITLE.search(before) or _DOMAIN.match(after) or before.endswith("Ph") and after.startswith("D.") or before.endswith("Ph.D"):
        return False
    if before[-1:].isdigit() and after[:1].isdigit():
        return False
    if before[-1:].isalpha() and not before[-2:-1].isalpha() and _IN_INITIALS.match(after):
        return False  # inside of initials
    starts = bool(after[:1].isspace() and _STARTS.match(after[1:]))
    if _INITIALS.search(before):
        return starts and before[-1:].isupper()
    if _ENDING.search(before):
        return starts
    return not _LETTER.search(before)


def split_sentences(text: str) -> list[str]:
    """The sentences of a text, stripped; a rest without a closing mark is one, too.

    Full stops of titles, initials, numbers, web addresses and name endings don't end one (after initials and name endings they do if a
    usual first word follows); runs of full stops do, and so does every question or exclamation mark. Closing quotation marks stay with
    the sentence before.
    """
    text = " " + text.replace("\n", " ") + "  "
    out, start = [], 0
    for mark in _MARK.finditer(text):
        if mark[0] == "." and not ends_sentence(text, mark.start()):
            continue
        end = mark.end()
        if end < len(text) and (text[end] == '"' or (text[end] == "”" and mark[0] == ".")):
            end += 1
        if end > start:
            out.append(text[start:end].strip())
        start = end
    rest = text[start:].strip()
    return out + [rest] if rest else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences_of(x: pd.Series) -> pd.Series:
    """:func:`split_sentences`; whether a full stop ends a sentence hangs on what stands around it, which no split pattern of bounded size tells."""
    return x.map(split_sentences, na_action="ignore")
