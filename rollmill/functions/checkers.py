"""Instruction checkers: each tells whether a text follows one verifiable instruction. Arguments may be Columns or values.

A missing argument gives NULL. Sentences and capital words are told by documented patterns, languages by function words and scripts
(or by a detector of the caller's). Further checkers join by :func:`register`.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.functions.arrays import let
from rollmill.functions.languages import is_language
from rollmill.functions.text import WORD, n_words, quoted, strip

#: Answers of which a constrained response contains one.
CONSTRAINED = ("My answer is yes.", "My answer is no.", "My answer is maybe.")
#: Words for the two comparisons.
LESS = ("less than", "小于")
MORE = ("at least", "至少", "大于等于")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def compared(count: Column, relation, threshold) -> Column:
    """count < threshold or count >= threshold, by the relation's name; NULL for other names."""
    r = _c(relation)
    return F.when(r.isin(*LESS), count < _c(threshold)).when(r.isin(*MORE), count >= _c(threshold))


def keywords_exist(x: Column, keywords: Column) -> Column:
    return F.forall(keywords, lambda k: F.contains(F.lower(x), F.lower(k)))


def keyword_frequency(x: Column, keyword, relation, n) -> Column:
    return compared(F.regexp_count(x, F.concat(F.lit("(?iu)"), quoted(_c(keyword)))), relation, n)


def no_forbidden_words(x: Column, banned: Column) -> Column:
    edge = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    return ~F.exists(F.array_distinct(banned), lambda w: F.regexp_like(x, F.concat(F.lit("(?iu)" + edge[0]), quoted(w), F.lit(edge[1]))))


def letter_frequency(x: Column, letter, relation, n) -> Column:
    return compared(F.regexp_count(F.lower(x), quoted(_c(letter))), relation, n)


def n_sentences(x: Column) -> Column:
    """Runs of text closed by . ! or ? before white space or the end; an unclosed rest counts too."""
    return F.regexp_count(strip(x), F.lit(r"(?s)\S.*?(?:[.!?]+[\"'”’)\]]*(?=\s|$)|$)"))


def sentences(x: Column, relation, n) -> Column:
    return compared(n_sentences(x), relation, n)


def paragraphs(x: Column, n) -> Column:
    """Parts between *** dividers: blank ones at the ends don't count, one in the middle fails."""
    parts = F.transform(F.split(x, r"(?U)\s?\*\*\*\s?", -1), lambda p: strip(p) != "")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.forall(inner, lambda full: full) & (F.size(F.filter(parts, lambda full: full)) == _c(n))


def word_count(x: Column, relation, n) -> Column:
    return compared(n_words(x), relation, n)


def nth_paragraph_first_word(x: Column, nth, first_word, n) -> Column:
    parts = F.split(x, "\n\n", -1)
    full = F.size(F.filter(parts, lambda p: strip(p) != ""))
    word = F.regexp_extract(strip(F.get(parts, _c(nth).cast("int") - 1)), r"(?U)^(\S+)", 1)
    bare = F.regexp_extract(F.regexp_replace(F.regexp_replace(word, "^'+", ""), '^"+', ""), "^([^.,?!'\"]*)", 1)
    return (full == _c(n)) & (_c(nth) <= full) & (word != "") & (F.lower(bare) == _c(first_word))


def placeholders(x: Column, n) -> Column:
    return F.regexp_count(x, F.lit(r"\[.*?\]")) >= _c(n)


def postscript(x: Column, marker) -> Column:
    m = _c(marker)
    pattern = F.when(m == "P.P.S", F.lit(r"p\.\s?p\.\s?s")).when(m == "P.S.", F.lit(r"p\.\s?s\.")).otherwise(F.lower(m))
    return F.regexp_like(F.lower(x), pattern)


def bullets(x: Column, n) -> Column:
    return F.regexp_count(x, F.lit(r"(?m)^\s*\*[^\*].*$")) + F.regexp_count(x, F.lit(r"(?m)^\s*-.*$")) == _c(n)


def constrained_response(x: Column) -> Column:
    out = F.lit(False)
    for option in CONSTRAINED:
        out = out | x.contains(option)
    return out


def constrained_start(x: Column, starter) -> Column:
    return F.regexp_like(x, F.concat(F.lit(r"(?m)^\s*"), _c(starter), F.lit(".*$")))


def highlights(x: Column, n) -> Column:
    one = F.filter(F.regexp_extract_all(x, F.lit(r"(\*[^\n\*]*\*)"), F.lit(1)), lambda h: strip(F.replace(h, F.lit("*"), F.lit(""))) != "")
    two = F.filter(F.regexp_extract_all(x, F.lit(r"(\*\*[^\n\*]*\*\*)"), F.lit(1)), lambda h: strip(F.replace(h, F.lit("*"), F.lit(""))) != "")
    return F.size(one) + F.size(two) >= _c(n)


def sections(x: Column, splitter, n) -> Column:
    return F.regexp_count(x, F.concat(F.lit(r"\s?"), _c(splitter), F.lit(r"\s?\d+\s?"))) >= _c(n)


def title(x: Column) -> Column:
    return F.exists(F.regexp_extract_all(x, F.lit(r"(<<[^\n]+>>)"), F.lit(1)), lambda t: strip(F.regexp_replace(F.regexp_replace(t, "^<+", ""), ">+$", "")) != "")


def two_responses(x: Column) -> Column:
    parts = F.transform(F.split(x, r"\*\*\*\*\*\*", -1), strip)
    full = F.filter(parts, lambda p: p != "")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.forall(inner, lambda p: p != "") & (F.size(full) == 2) & (F.get(full, F.lit(0)) != F.get(full, F.lit(1)))


def repeats_prompt(x: Column, prompt) -> Column:
    text, start = F.lower(strip(x)), F.lower(strip(_c(prompt)))
    return F.startswith(text, start) | F.startswith(text, F.concat(F.lit("'"), start)) | F.startswith(text, F.concat(F.lit('"'), start))


def ends_with(x: Column, phrase) -> Column:
    text = F.lower(F.regexp_replace(F.regexp_replace(strip(x), '^"+', ""), '"+$', ""))
    return F.endswith(text, F.lower(strip(_c(phrase))))


def n_capital_words(x: Column) -> Column:
    """Words (hyphens inside) that have a cased letter and no lower-case one."""
    return F.regexp_count(x, F.lit(r"(?<![\p{L}\p{N}_-])(?=[\p{N}_-]*\p{Lu})[\p{Lu}\p{N}_]+(?:-[\p{Lu}\p{N}_]+)*(?![\p{L}\p{N}_-])"))


def capital_words(x: Column, relation, n) -> Column:
    return compared(n_capital_words(x), relation, n)


def all_capitals(x: Column) -> Column:
    """In capitals, and English as far as can be told."""
    return (x == F.upper(x)) & (x != F.lower(x)) & is_language(x, "en")


def all_lower(x: Column) -> Column:
    """In lower case, and English as far as can be told."""
    return (x == F.lower(x)) & (x != F.upper(x)) & is_language(x, "en")


def response_language(x: Column, code) -> Column:
    return F.when(_c(code).isNotNull(), is_language(x, _c(code)))


_CHANGES = r"\*.*\*"


def rephrased(x: Column, original) -> Column:
    """Whether text and original differ only between asterisks; NULL unless both have such a part."""
    o = _c(original)
    bare = lambda t: F.regexp_replace(t, _CHANGES, "")
    return F.when(F.regexp_like(x, F.lit(_CHANGES)) & F.regexp_like(o, F.lit(_CHANGES)), bare(x) == bare(o))


def key_sentences(found: Column, wanted: Column, n) -> Column:
    """Whether exactly ``n`` of the wanted sentences are among those found (``rollmill.functions.sentences.sentences_of`` of the text)."""
    return F.size(F.array_intersect(wanted, found)) == _c(n)


def shared_words(x: Column, original) -> Column:
    """How many words (runs of word characters, in lower case) text and original share, the smaller of both counts of each word."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(f"({WORD}+)"), F.lit(1))

    def of(both: Column) -> Column:
        count = lambda own, w: F.size(F.filter(own, lambda v: v == w))
        return F.aggregate(F.array_intersect(both["a"], both["b"]), F.lit(0), lambda n, w: n + F.least(count(both["a"], w), count(both["b"], w)))

    return let(F.struct(words(x).alias("a"), words(_c(original)).alias("b")), of)


def rephrased_paragraph(x: Column, original, low, high) -> Column:
    return shared_words(x, original).between(_c(low), _c(high))


def no_comma(x: Column) -> Column:
    return ~x.contains(",")


def in_quotes(x: Column) -> Column:
    s = strip(x)
    return (F.length(s) > 1) & s.startswith('"') & s.endswith('"')


def _unfenced(x: str, word: str) -> str:
    """Without a fence at both ends. Every *character* of the opening fence goes from the front, as often as it stands there: a quirk that
    results depend on, kept on purpose."""
    for chars in ("```" + word, "```" + word.capitalize(), "```" + word.upper(), "```"):
        x = x.lstrip(chars) if chars != "```" + word else x.strip().lstrip(chars)
    return x.rstrip("`").strip()


@F.pandas_udf(T.BooleanType())
def json_valid(x: pd.Series) -> pd.Series:
    """Valid JSON after fence characters are taken off (no built-in parser treats duplicates, NaN and trailing text alike)."""

    def one(t):
        if t is None:
            return None
        try:
            json.loads(_unfenced(t, "json"))
        except (ValueError, RecursionError):
            return False
        return True

    return x.map(one)


_LOOSE_XML = re.compile(r"(<\?xml\s.*\?>)?.*<.*>.*</.*>", re.S)


@F.pandas_udf(T.BooleanType())
def xml_valid(x: pd.Series) -> pd.Series:
    """Well-formed XML, or text with an opening and later a closing tag. Texts that declare a document type are refused."""

    def one(t):
        if t is None:
            return None
        t = _unfenced(t, "xml")
        if "<!DOCTYPE" in t or "<!ENTITY" in t:
            return False  # entities of an untrusted text could grow without bound
        try:
            ElementTree.fromstring(t)
            return True
        except (ElementTree.ParseError, ValueError):
            return bool(_LOOSE_XML.match(t))

    return x.map(one)


#: Checkers by instruction id. Each takes the text and a map<string,string> of arguments (lists as JSON arrays).
REGISTRY = {
    "keywords:existence": lambda x, k: keywords_exist(x, F.from_json(k["keywords"], "array<string>")),
    "keywords:frequency": lambda x, k: keyword_frequency(x, k["keyword"], k["relation"], k["frequency"].cast("int")),
    "keywords:forbidden_words": lambda x, k: no_forbidden_words(x, F.from_json(k["forbidden_words"], "array<string>")),
    "keywords:letter_frequency": lambda x, k: letter_frequency(x, k["letter"], k["let_relation"], k["let_frequency"].cast("int")),
    "length_constraints:number_sentences": lambda x, k: sentences(x, k["relation"], k["num_sentences"].cast("int")),
    "length_constraints:number_paragraphs": lambda x, k: paragraphs(x, k["num_paragraphs"].cast("int")),
    "length_constraints:number_words": lambda x, k: word_count(x, k["relation"], k["num_words"].cast("int")),
    "length_constraints:nth_paragraph_first_word": lambda x, k: nth_paragraph_first_word(x, k["nth_paragraph"].cast("int"), k["first_word"], k["num_paragraphs"].cast("int")),
    "detectable_content:number_placeholders": lambda x, k: placeholders(x, k["num_placeholders"].cast("int")),
    "detectable_content:postscript": lambda x, k: postscript(x, k["postscript_marker"]),
    "detectable_format:number_bullet_lists": lambda x, k: bullets(x, k["num_bullets"].cast("int")),
    "detectable_format:constrained_response": lambda x, k: constrained_response(x),
    "detectable_format:number_highlighted_sections": lambda x, k: highlights(x, k["num_highlights"].cast("int")),
    "detectable_format:multiple_sections": lambda x, k: sections(x, k["section_spliter"], k["num_sections"].cast("int")),
    "detectable_format:json_format": lambda x, k: json_valid(x),
    "detectable_format:xml_format": lambda x, k: xml_valid(x),
    "detectable_format:title": lambda x, k: title(x),
    "combination:two_responses": lambda x, k: two_responses(x),
    "combination:repeat_prompt": lambda x, k: repeats_prompt(x, k["prompt_to_repeat"]),
    "startend:end_checker": lambda x, k: ends_with(x, k["end_phrase"]),
    "change_case:capital_word_frequency": lambda x, k: capital_words(x, k["capital_relation"], k["capital_frequency"].cast("int")),
    "change_case:english_capital": lambda x, k: all_capitals(x),
    "change_case:english_lowercase": lambda x, k: all_lower(x),
    "punctuation:no_comma": lambda x, k: no_comma(x),
    "startend:quotation": lambda x, k: in_quotes(x),
    "multi-turn:constrained_start": lambda x, k: constrained_start(x, k["starter"]),
    "language:response_language": lambda x, k: response_language(x, k["language"]),
    "detectable_format:rephrase": lambda x, k: rephrased(x, k["original_message"]),
    "detectable_content:rephrase_paragraph": lambda x, k: rephrased_paragraph(x, k["original_paragraph"], k["low"].cast("int"), k["high"].cast("int")),
}
#: Checkers that can't be expressions: they are worked out once a text, before the instructions of a row are gone through.
BY_TEXT = {"detectable_format:json_format": json_valid, "detectable_format:xml_format": xml_valid}


def register(id: str, checker) -> None:
    """Adds a checker: ``checker(text, arguments)`` gives a boolean Column, ``arguments`` being a map<string,string>. Known ids raise."""
    if id in REGISTRY:
        raise ValueError(f"checker {id!r} is registered already")
    REGISTRY[id] = checker


def conflicts() -> list[tuple[str, str]]:
    """Pairs of registered instructions that can't hold together, closed under swapping; every instruction conflicts with itself.

    Fixed values: what each id conflicts with, or (``but``) all ids but those.
    """
    no_text = {"keywords:forbidden_words", "keywords:existence", "keywords:frequency"}
    only = {
        "language:response_language": {"detectable_format:multiple_sections", "keywords:existence", "keywords:frequency", "keywords:forbidden_words", "startend:end_checker", "change_case:english_capital", "change_case:english_lowercase"},
        "length_constraints:number_paragraphs": {"length_constraints:nth_paragraph_first_word", "length_constraints:number_sentences"},
        "length_constraints:nth_paragraph_first_word": {"length_constraints:number_paragraphs"},
        "detectable_format:multiple_sections": {"language:response_language", "detectable_format:number_highlighted_sections", "length_constraints:number_paragraphs"},
        "change_case:capital_word_frequency": {"change_case:english_lowercase", "change_case:english_capital"},
        "change_case:english_lowercase": {"change_case:english_capital"},
        "startend:quotation": {"detectable_format:title"},
    }
    but = {
        "detectable_format:constrained_response": set(),
        "detectable_format:json_format": no_text,
        "detectable_format:xml_format": no_text,
        "combination:two_responses": {"keywords:forbidden_words", "keywords:existence", "language:response_language", "detectable_format:title", "punctuation:no_comma", "startend:quotation"},
        "combination:repeat_prompt": {"keywords:existence", "detectable_format:title", "punctuation:no_comma"},
    }
    ids = [i for i in REGISTRY if i not in ("multi-turn:constrained_start", "detectable_format:rephrase", "detectable_content:rephrase_paragraph")]
    pairs = {(i, i) for i in ids} | {(i, j) for i, js in only.items() for j in js} | {(i, j) for i, left in but.items() for j in ids if j not in left}
    return sorted(pairs | {(j, i) for i, j in pairs})


def check(text: Column, id: Column, arguments: Column, only: tuple[str, ...] | None = None, known: dict[str, Column] | None = None) -> Column:
    """The checker of the row's instruction id; NULL for unknown ids and missing arguments. ``only`` keeps the dispatch short, ``known``
    holds results of checkers that were worked out before."""
    out = F.lit(None).cast("boolean")
    for name in only or REGISTRY:
        out = F.when(id == name, known[name] if known and name in known else REGISTRY[name](text, arguments)).otherwise(out)
    return out


def followed(text: Column, ids: Column, arguments: Column, only: tuple[str, ...] | None = None, known: dict[str, Column] | None = None) -> Column:
    """For every instruction of the row whether the text follows it, within the row; a blank text, an unknown id or a missing argument is false."""
    full = strip(text) != ""
    one = lambda i: F.coalesce(full & check(text, i["ids"], i["arguments"], only, known), F.lit(False))
    return F.transform(F.arrays_zip(ids.alias("ids"), arguments.alias("arguments")), one)


def followed_loosely(text: Column, ids: Column, arguments: Column, only: tuple[str, ...] | None = None) -> Column:
    """As :func:`followed`, but any of the loose variants of the text will do. Nothing is exploded or shuffled."""

    def of(variants: Column) -> Column:
        one = lambda i: F.exists(variants, lambda v: F.coalesce((strip(v) != "") & check(v, i["ids"], i["arguments"], only), F.lit(False)))
        return F.transform(F.arrays_zip(ids.alias("ids"), arguments.alias("arguments")), one)

    return let(loose_variants(text), of)


def loose_variants(x: Column) -> Column:
    """The text without its first line, last line or both, each also without asterisks."""
    lines = F.split(x, "\n", -1)
    cut = lambda a, b: strip(F.array_join(F.slice(lines, a + 1, F.greatest(F.size(lines) - a - b, F.lit(0))), "\n"))
    four = [x, cut(1, 0), cut(0, 1), cut(1, 1)]
    return F.array(*four, *[F.replace(v, F.lit("*"), F.lit("")) for v in four])


def combined_score(followed: Column, total: Column) -> Column:
    """2 if all instructions are followed, -2 if none is, else their share."""
    return F.when(followed == total, F.lit(2.0)).when(followed == 0, F.lit(-2.0)).otherwise(followed / total)
