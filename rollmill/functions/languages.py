"""The language of a text, by function words and scripts. A trained detector may be plugged in wherever a language column is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.arrays import let

# Function words by language, none of them in more than two of the lists.
FUNCTION_WORDS = {
    "en": "the of and to is that it for with as was on are this by be from or have which you not but they their has were been would there what when who will more about into than them can only other its these could then our after also how should because".split(),
    "de": "der die das und ist nicht ein eine den dem des mit von für auf im zu zur zum sich auch als wird werden sind war wie oder aber bei aus nach über nur noch durch wenn dass hat haben einen einer eines kann wir ihr ihre sein diese dieser".split(),
    "fr": "le les des est et une dans que qui pour pas sur avec plus par ne ce cette sont au aux mais ou elle il nous vous leur leurs être avoir été comme tout tous ses ces deux même aussi sans peut entre donc encore".split(),
    "es": "el los las del que y en una por con para es se su al lo como más pero sus le ya este esta sí porque cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso".split(),
    "it": "il di che è per non con sono una della nel dei gli lo alla delle più anche si come ma nella ha questo questa essere dal sul da ho suo sua loro tra quando perché molto".split(),
    "pt": "o os uma que não do da dos das em para com por mais ao como mas foi ele ela são seu sua você também já está muito nos quando pelo pela isso entre depois sem mesmo aos ser tem".split(),
    "nl": "de het een van en is dat op te zijn voor met niet aan er om ook als dan maar bij uit nog naar heeft hebben wordt door over deze dit ze kan geen meer veel tot wat waar".split(),
}
# Languages told by their script alone, as regular expressions name it.
SCRIPTS = {"ja": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "zh": r"\p{IsHan}", "ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}", "he": r"\p{IsHebrew}", "el": r"\p{IsGreek}", "hi": r"\p{IsDevanagari}", "th": r"\p{IsThai}",
    "bn": r"\p{IsBengali}", "ta": r"\p{IsTamil}", "te": r"\p{IsTelugu}", "kn": r"\p{IsKannada}", "gu": r"\p{IsGujarati}", "pa": r"\p{IsGurmukhi}", "ml": r"\p{IsMalayalam}"}
# Codes whose script stands for them; languages that share one aren't told apart.
SAME_SCRIPT = {"zh-cn": "zh", "zh-tw": "zh", "uk": "ru", "bg": "ru", "fa": "ar", "ur": "ar", "ne": "hi", "mr": "hi"}
# Names of the languages by code.
NAMES = {
    "en": "English", "es": "Spanish", "pt": "Portuguese", "ar": "Arabic", "hi": "Hindi", "fr": "French", "ru": "Russian", "de": "German", "ja": "Japanese", "it": "Italian", "bn": "Bengali", "uk": "Ukrainian", "th": "Thai",
    "ur": "Urdu", "ta": "Tamil", "te": "Telugu", "bg": "Bulgarian", "ko": "Korean", "pl": "Polish", "he": "Hebrew", "fa": "Persian", "vi": "Vietnamese", "ne": "Nepali", "sw": "Swahili", "kn": "Kannada", "mr": "Marathi",
    "gu": "Gujarati", "pa": "Punjabi", "ml": "Malayalam", "fi": "Finnish", "zh-cn": "Chinese", "zh-tw": "Traditional Chinese",
}
#: Share of the letters that a script must have.
MOST_LETTERS = 0.3


def language(x: Column) -> Column:
    """The language code: that of a script with ``MOST_LETTERS`` of the letters (kana before Han), else that of the most function words,
    the first in the order above on ties; NULL for a text with neither."""
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    out = F.lit(None).cast("string")
    for code, pattern in reversed(SCRIPTS.items()):
        share = 0.05 if code == "ja" else MOST_LETTERS
        out = F.when((letters > 0) & (F.regexp_count(x, F.lit(pattern)) > share * letters), F.lit(code)).otherwise(out)

    def voted(found: Column) -> Column:
        count = lambda words: F.size(F.filter(found, lambda w: w.isin(*words)))
        votes = F.array(*[F.struct(count(words).alias("n"), F.lit(-k).alias("order"), F.lit(code).alias("code")) for k, (code, words) in enumerate(FUNCTION_WORDS.items())])
        return let(F.array_max(votes), lambda best: F.when(best["n"] > 0, best["code"]))

    return F.coalesce(out, let(F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+)"), F.lit(1)), voted))


def name_of(code: Column) -> Column:
    """The name of a language code; NULL for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in NAMES.items() for v in pair]), code)


def is_language(x: Column, code: Column | str, detected: Column | None = None) -> Column:
    """Whether a text is in the language; true where none can be told, and for a code without words or script if the text's letters are
    Latin. ``detected`` replaces the language by that of another detector."""
    wanted = F.lit(code) if isinstance(code, str) else code
    if detected is not None:
        return F.when(x.isNotNull(), F.coalesce(detected == wanted, F.lit(True)))
    for other, script in SAME_SCRIPT.items():
        wanted = F.when(wanted == other, F.lit(script)).otherwise(wanted)
    same = lambda own: F.coalesce((own == wanted) | (~wanted.isin(*FUNCTION_WORDS, *SCRIPTS) & own.isin(*FUNCTION_WORDS)), F.lit(True))
    return F.when(x.isNotNull(), let(language(x), same))
