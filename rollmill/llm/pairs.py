"""Broken prompt and response pairs: ordered rules, each of which names one defect."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.plans.store import written

#: In the order of the rules.
DEFECTS = ("empty", "copied", "truncated", "refusal", "language")
#: A word met so often tells by its endings whether a text may stop after it; a rarer one may be the beginning of a word met so many times as often.
KNOWN, MUCH_MORE = 20, 20
#: Shares of a word's occurrences that end a sentence: below the first a text doesn't stop there, above the second it does.
SELDOM_LAST, MOSTLY_LAST = 0.02, 0.8
#: So many words from a capital letter on are a sentence, which may end without its full stop in a number only.
SENTENCE_WORDS = 8
#: A letter of a script without an alphabet says as much as so many letters.
IDEOGRAM = 3

# Words for "no value".
NO_VALUE = frozenset("null none nil nan na n/a n/d undefined empty blank missing nichts leer keine keiner k.a. nada ninguno ninguna vacío vacio rien aucun aucune vide".split()) | {"no value", "no answer", "not available", "keine antwort", "sin respuesta", "pas de réponse"}

# Function words of the languages that are told apart.
FUNCTION_WORDS = {
    "en": "the a an of and to in is it that for with on as was were be been has have had this these those from by at or not are but which whose what when where while than then there their they he she his her its will would should can could may might must do does did about into over after before between through without within more most every no nobody so such only also we you your our once even least enough how why if any some",
    "de": "der die das den dem des ein eine einen einem einer eines und ist sind war wird werden wurde nicht mit von für auf im in zu zum zur als auch sich wer was wie wenn dass doch aber oder nach bei aus um an am vor ohne über unter zwischen so sehr nur noch man er sie es ich wir ihr mein sein haben hat hatte kann kommt gilt etwa eines viele dabei jedenfalls obwohl damit denn trotzdem seit beim ins weil keine kein niemand immer warum sollte wissen",
    "fr": "le la les un une des du de et est sont a à au aux en dans par pour avec sur qui que qu quoi dont ne pas plus moins ce cet cette ces se s il elle ils elles on nous vous je tu son sa ses leur leurs mais ou où donc car si comme quand sans sous entre depuis pendant lors après avant selon celui même tout toute tous être été fait doit devrait savoir peut faut reste beaucoup presque personne aussi assez près environ comment pourquoi quel quelle",
    "es": "el la los las un una unos unas de del al a y e o u es son era fue en con por para que se su sus lo le les no sí más menos muy como cómo cuando cuándo donde quien quién qué cuál entre sin sobre hasta desde durante según antes después pero aunque porque si ya hay ha han ser está están este esta estos estas ese esa eso aquí todo toda todos casi nadie otra otro mismo así cuenta hacen debe debería saber pues también al tras ni",
}
# Function words of further languages in the same script.
MORE_FUNCTION_WORDS = {
    "it": "il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla in nel nella nei con su sul sulla per tra fra e ed o ma se che chi cui non più è sono era essere stato ha hanno avere questo questa questi queste quello quella come quando dove perché anche si ci ne mi ti suo sua loro molto tutto ogni dopo prima senza può possono così già ancora",
    "pt": "o a os as um uma uns umas de do da dos das em no na nos nas por pelo pela para com sem sob sobre entre e ou mas se que quem qual não mais é são era foi ser estar está ter tem há isto isso este esta esse essa aquele como quando onde porque também já ainda muito todo toda seu sua lhe nós eles elas você até depois antes pode podem assim ao à aos às",
    "nl": "de het een en van in is dat op te zijn voor met die niet aan er om ook als dan maar bij of uit nog naar heeft hebben had was waren werd worden wordt door over deze dit ze zij hij wij je u kan kunnen zou zal wel geen meer veel tot hun wat waar wie hoe waarom onder tussen zonder na omdat",
}
_SETS = {k: frozenset(v.split()) for k, v in {**FUNCTION_WORDS, **MORE_FUNCTION_WORDS}.items()}
_ANY_FUNCTION = frozenset().union(*(_SETS[k] for k in FUNCTION_WORDS))
_LANGUAGES_OF: dict[str, tuple[str, ...]] = {w: tuple(k for k, s in _SETS.items() if w in s) for w in frozenset().union(*_SETS.values())}

# Names of the languages in each of them.
LANGUAGE_NAMES = {
    "english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "ingles": "en", "inglese": "en", "inglês": "en",
    "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "aleman": "de", "tedesco": "de", "alemão": "de",
    "french": "fr", "französisch": "fr", "franzoesisch": "fr", "français": "fr", "francais": "fr", "francés": "fr", "frances": "fr", "francese": "fr", "francês": "fr",
    "spanish": "es", "spanisch": "es", "espagnol": "es", "español": "es", "espanol": "es", "castellano": "es", "spagnolo": "es", "espanhol": "es",
    "italian": "it", "italienisch": "it", "italien": "it", "italiano": "it",
    "portuguese": "pt", "portugiesisch": "pt", "portugais": "pt", "portugués": "pt", "portoghese": "pt", "português": "pt",
    "dutch": "nl", "niederländisch": "nl", "néerlandais": "nl", "neerlandés": "nl", "olandese": "nl",
    "russian": "ru", "russisch": "ru", "russe": "ru", "ruso": "ru", "russo": "ru", "chinese": "zh", "chinesisch": "zh", "chinois": "zh", "chino": "zh", "cinese": "zh",
    "japanese": "ja", "japanisch": "ja", "japonais": "ja", "japonés": "ja", "giapponese": "ja", "korean": "ko", "koreanisch": "ko", "coréen": "ko", "coreano": "ko",
    "arabic": "ar", "arabisch": "ar", "arabe": "ar", "árabe": "ar", "arabo": "ar", "greek": "el", "griechisch": "el", "grec": "el", "griego": "el",
    "hebrew": "he", "hebräisch": "he", "hindi": "hi", "thai": "th", "ukrainian": "uk", "ukrainisch": "uk",
}
#: Scripts of the languages that aren't written in Latin letters, as Unicode names its letters.
SCRIPT_OF = {"ru": "CYRILLIC", "uk": "CYRILLIC", "zh": "CJK", "ja": "KANA", "ko": "HANGUL", "ar": "ARABIC", "el": "GREEK", "he": "HEBREW", "hi": "DEVANAGARI", "th": "THAI"}
_ASKS = re.compile(
    r"\b(?:reply|answer|respond|write|say|translat\w*|antwort\w*|schreib\w*|übersetz\w*|répon\w*|repon\w*|écri\w*|rédige\w*|tradui\w*|respond\w*|respuesta|contest\w*|escrib\w*|traduc\w*|traduz\w*|rispond\w*|scriv\w*|escrev\w*)\b"
    r"[^.!?\n]{0,40}?\b(?:in|into|to|auf|ins|en|al|em)\s+(" + "|".join(LANGUAGE_NAMES) + r")\b"
)

# Phrases by which an answer declines, in the four languages.
REFUSALS = (
    r"\b(?:can'?t|cannot|can not|couldn'?t|could not|won'?t|will not|am unable to|'m unable to|am not able to|'m not able to|would rather not|'d rather not|must not|may not) (?:help|assist|answer|do|discuss|write|provide|give|take part|comply|fulfil|support|respond|continue|talk|share)",
    r"\b(?:isn'?t|is not|it'?s not) possible for me\b", r"\b(?:have|need|going) to (?:decline|refuse)\b", r"\bi (?:must )?(?:decline|refuse)\b",
    r"\bno (?:reply|answer|response)\b.{0,30}\bfrom me\b", r"\b(?:beyond|outside|not) (?:what )?i(?:'m| am) allowed\b", r"\b(?:not|n't) (?:allowed|permitted) to\b", r"\bsomething i (?:won'?t|will not|can'?t|cannot)\b", r"\bagainst (?:the|my) (?:rules|guidelines|policy|policies)\b",
    r"\bkann (?:ich )?(?:\w+ )?(?:nicht|leider) (?:\w+ )?(?:helfen|beantworten|antworten|weiterhelfen)", r"\bich (?:leider )?(?:nicht|keine) (?:\w+ )?(?:helfen|beantworten|auskunft)", r"\bnicht in der lage\b", r"\bmuss ich (?:leider )?(?:ablehnen|verweigern)", r"\b(?:diese )?(?:anfrage|frage|bitte) (?:\w+ )?(?:muss|möchte) ich ablehnen", r"\bdarf ich (?:leider )?(?:keine|nicht)\b", r"\bich darf\b.{0,40}\b(?:nicht|keine)\b", r"\bgegen meine (?:regeln|richtlinien)\b", r"\bkeine auskunft\b",
    r"\bne (?:peux|puis) (?:malheureusement )?pas (?:vous )?(?:aider|répondre|traiter|faire|écrire|en parler)", r"\bdois (?:malheureusement )?(?:refuser|décliner)", r"\bn'ai pas le droit\b", r"\bm'est impossible\b", r"\bne suis pas (?:en mesure|autorisée?|capable)\b", r"\bcontre mes (?:règles|principes)\b", r"\bpréfère ne pas\b",
    r"\bno puedo (?:ayudar|responder|contestar|hacer|escribir|hablar|atender)", r"\bno soy capaz\b", r"\bdebo (?:rechazar|declinar|negarme)", r"\btengo que (?:rechazar|declinar)", r"\bno me está permitido\b", r"\bno (?:me es|es) posible\b", r"\bcontra mis (?:normas|reglas)\b", r"\bprefiero no\b",
    r"\bnon (?:posso|sono in grado di|mi è possibile) (?:\w+ )?(?:aiutart?i|aiutar\w*|rispond\w*|assist\w*|fornir\w*|scriver\w*|parlar\w*|farlo)", r"\bdevo (?:purtroppo )?(?:rifiutare|declinare)", r"\bnon mi è (?:permesso|consentito|possibile)\b", r"\bpreferisco non\b",
    r"\bnão (?:posso|consigo) (?:\w+ )?(?:ajudar|responder|atender|escrever|falar|fazer)", r"\b(?:devo|tenho de|preciso) recusar", r"\bnão me é (?:permitido|possível)\b", r"\bprefiro não\b",
    r"\bkan (?:ik )?(?:\w+ )?(?:niet|helaas) (?:\w+ )*(?:helpen|beantwoorden|antwoorden)", r"\bmoet (?:ik )?(?:\w+ )*weigeren\b", r"\bmag ik niet\b", r"\bniet in staat\b",
)
# The same in other scripts.
REFUSALS_IN_OTHER_SCRIPTS = (
    r"\bне (?:могу|можу|смогу|в состоянии|имею права)\b", r"\bвынужден\w* отказа", r"\bотказываюсь\b",
    r"(?:お答え|お手伝い|お応え|回答|対応|支援|提供)(?:すること)?(?:は|が)?(?:でき|いたしかね|致しかね|しかね)", r"できません", r"お断り", r"控えさせて",
    r"(?:无法|不能|没办法|沒辦法|無法)[^。！？]{0,12}(?:帮助|帮忙|幫助|幫忙|回答|提供|协助|協助|满足|继续|讨论)", r"(?:拒绝|拒絕)(?:回答|提供|这个|這個|该)", r"不(?:便|方便|允许)[^。！？]{0,6}(?:回答|提供)",
    r"(?:도와|답변|대답|제공)[^.]{0,12}(?:수 없|어렵|못)",
)
_REFUSAL = re.compile("|".join(REFUSALS))
#: Looked for only in texts with such letters: few of these patterns begin at a word, so each place of a text is tried.
_REFUSAL_THERE = re.compile("|".join(REFUSALS_IN_OTHER_SCRIPTS))
_OTHER_SCRIPT = re.compile("[\u0370-\u1cff\u3040-\ud7ff]")
# Sentences that may stand beside a refusal without being an answer.
FILLERS = (
    r"^(?:hm+|well|sorry|apologies|unfortunately|thanks|thank you|oh|ah|ok|okay|leider|danke|entschuldigung|tut mir leid|désolée?|malheureusement|merci|hélas|lo siento|gracias|perdón|por desgracia)\b[^a-z]{0,3}$",
    r"^(?:i(?:'m| am) (?:very |so )?sorry|es tut mir leid|je suis désolée?|lo siento(?: mucho)?)[^a-z]*$",
    r"\bhope you understand\b", r"\b(?:something|anything) else (?:you need|i can)", r"\bask a specialist\b", r"\bunderstand(?:ing)?\.?$", r"\bwould like to hear\b", r"\byou (?:want|would like) to know\b", r"\bplease (?:ask|contact|consult|try)\b",
    r"\bmöchtest\b.{0,30}\b(?:hören|wissen)\b", r"\bverständnis\b", r"\bhoffe\b.{0,30}\b(?:verstehst|verstehen|verständlich)\b", r"\b(?:frag|fragen|wende|wenden)\b.{0,40}\b(?:fach\w*|expert\w*|person|stelle)\b", r"\b(?:sonst|noch) (?:etwas|was)\b",
    r"\bvoulez en savoir\b", r"\bj'espère que\b", r"\b(?:demandez|adressez|consultez)\b.{0,60}\b(?:spécialiste|expert\w*|professionnel\w*|personne)\b", r"\bautre chose\b", r"\bcompréhension\b",
    r"\bquieres saber\b", r"\bespero que\b", r"\bconsulta\b.{0,40}\b(?:experta|experto|especialista|profesional|persona)\b", r"\b(?:algo|alguna cosa) más\b", r"\bcomprensión\b", r"\botra cosa\b",
    r"\bmi (?:di)?spiace\b", r"\bcomprensione\b", r"\bspero che\b", r"\baltro\b.{0,20}\b(?:aiutar|posso)", r"\b(?:desculpe|sinto muito|lamento)\b", r"\bcompreensão\b", r"\bespero que\b", r"\bhet spijt me\b", r"\bbegrip\b",
)
# The same in other scripts.
FILLERS_IN_OTHER_SCRIPTS = (
    r"\b(?:извини|прости|сожалени|понимани)\w*", r"(?:申し訳|すみません|ごめん|ご了承|ご理解)", r"(?:抱歉|对不起|對不起|谅解|諒解|理解)", r"(?:죄송|미안|양해)",
)
_FILLER = re.compile("|".join(FILLERS))
_FILLER_THERE = re.compile("|".join(FILLERS_IN_OTHER_SCRIPTS))

_THINK = re.compile(r"<think(?:ing)?>.*?</think(?:ing)?>", re.S | re.I)
_END_MARK = re.compile(r"<\|[^<>|]{0,40}\|>|</?s>|\[/?INST\]|<(?:eos|bos|pad)>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+(?:[.!?](?=[\s\"”»<)]|$))?")
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"”»]+|(?<=[。！？])|\n+")
_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|[a-z][.)])\s+\S")
_CODE = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r'(?<!\w)"[^"\n]*"(?!\w)')
#: Brackets that open nothing: the marks of list items, and sad faces.
_NO_BRACKET = re.compile(r"^\s*(?:\d{1,3}|[A-Za-z]|[ivx]{1,4})\)(?=\s)|(?<!\S)[:;=]-?[(\[](?!\S)", re.M)
_BRACKET = re.compile(r"[()\[\]{}]")
#: An operator that lacks what should follow it. Attached, "+" and "/" may end a name, a grade or a path.
_OPERATOR = re.compile(r"[^\W_]\)*\s*(?:[=×÷·&≤≥≠≈→∈∧∨]|[-=]>|[<>]=)$|[^\W_][)\]}]*\s+[-–—+/<>*]{1,2}$|[)\]}]\s*[-–—+/=^×÷·]$|[^\W_]\^$|\S=\S*[^\W_]\+$|(?<!\S)\d+/$")
_PADDED = re.compile(r"(?<!\S)[A-Za-z0-9+/]{8,}={1,2}$")
_SIGNED = re.compile(r"(?:^|\s)[—–]{1,2}\s?\w[\w.'-]*(?: \w[\w.'-]*){0,3}$")
_LAST_TURN = re.compile(r"(?:^|\n)\s*(?:user|human|q|question|nutzer|utilisateur|usuario)\s*:\s*|<\|im_start\|>\s*user\s*|<\|user\|>|\[INST\]|###\s*(?:request|user|instruction)\s*:?\s*", re.I)
_OTHER_TURN = re.compile(r"\n\s*(?:assistant|bot|ai)\s*:|<\|im_end\|>|<\|assistant\|>|<\|im_start\|>|\[/INST\]|###\s*(?:reply|assistant|response)", re.I)
_OTHER_LETTER = re.compile(r"[^\W\d_\x00-\x7f]")
_LATIN_LETTER = re.compile(r"[A-Za-z]")
#: Lines of code, which need no full stop: an assignment, a call, a keyword, or a mark of block or statement.
_CODE_LINE = re.compile(
    r"^\s*(?:def|class|return|import|from|for|while|if|elif|else|print|var|let|const|function|public|private|select|insert|update|echo|#include)\b(?!\s+\w+\s+\w+\s+\w+)"
    r"|^\s*[\w.\[\]]+\s*(?:[-+*/]?=|:=|->|=>)\s*\S|[;{}]\s*$|^\s{2,}\S.*[=()\[\]]|^\s*[\w.]+\([^()]*\)\s*$"
)
#: A sentence that ended before.
_ENDED = re.compile(r"[^\W_][\"'”»)\]]*[.!?…][\"'”»)\]]*\s")
_LABEL = re.compile(r"^\s*(?:>\s*|(?:q|question|prompt|frage|pregunta|task|request|aufgabe|user)\s*:\s*)+", re.I)


def last_turn(prompt: str) -> str:
    """The last request of a rendered conversation, or the whole prompt."""
    parts = _LAST_TURN.split(prompt)
    turn = _OTHER_TURN.split(parts[-1])[0] if len(parts) > 1 else prompt
    return turn if turn.strip() else prompt


def language(text: str) -> str | None:
    """The language with clearly the most function words, or None."""
    votes: Counter[str] = Counter()
    count = Counter(_WORD.findall(text.lower()))
    for w in _LANGUAGES_OF.keys() & count.keys():
        for k in _LANGUAGES_OF[w]:
            votes[k] += count[w]
    if not votes:
        return None
    best = max(votes, key=votes.__getitem__)
    n = votes.pop(best)
    return best if n >= 2 and n > 1.25 * max(votes.values(), default=0) else None


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> str:
    """The first word of the letter's Unicode name, which names its script."""
    name = unicodedata.name(letter, "").split(" ")[0].split("-")[0]
    return "KANA" if name in ("HIRAGANA", "KATAKANA") else name


def script(text: str) -> str | None:
    """The script that more than half of the letters belong to. Ideograms beside kana are Japanese."""
    others = _OTHER_LETTER.findall(text) if not text.isascii() and _OTHER_SCRIPT.search(text) else ()
    if not others:
        return "LATIN" if _LATIN_LETTER.search(text) or _OTHER_LETTER.search(text) else None
    count = Counter(map(_script, others))
    count["LATIN"] += len(_LATIN_LETTER.findall(text))
    for name in ("CJK", "KANA", "HANGUL"):
        count[name] *= IDEOGRAM
    if 10 * count["KANA"] >= count["CJK"]:
        count["KANA"] += count.pop("CJK")
    best, n = count.most_common(1)[0]
    return best if best and 2 * n > count.total() else None


def asked_language(prompt: str) -> str | None:
    low = prompt.lower()
    if LANGUAGE_NAMES.keys().isdisjoint(_WORD.findall(low)):
        return None
    found = _ASKS.findall(low)
    return LANGUAGE_NAMES[found[-1]] if found else None


def _visible(answer: str) -> str:
    """The answer without thinking, end marks and tags."""
    text = answer
    if "<" in text or "[" in text:
        text = _THINK.sub(" ", text)
        if "</think>" in text:
            text = text.rsplit("</think>", 1)[1]
        text = _TAG.sub(" ", _END_MARK.sub(" ", text))
    return text


def is_empty(answer: str, visible: str) -> bool:
    opened = answer.lower().rfind("<think>")
    if opened >= 0 and "</think>" not in answer[opened:].lower():
        return False
    text = visible.strip()
    if not _WORD.search(text):
        return True
    return len(text) < 40 and text.lower().strip(" \t\n\r\"'`*_.,;:()[]{}<>|-") in NO_VALUE


def left_open(text: str) -> bool:
    """Whether a bracket or a straight quotation is open at the end, code aside. Half-open intervals count as closed.

    A single straight quote can't be told from an apostrophe and counts for nothing.
    """
    if "`" in text:
        text = _CODE.sub(" ", _FENCE.sub(" ", text))
    if '"' in text:
        if text.count('"') % 2:
            k = text.rfind('"')
            if (k == 0 or text[k - 1].isspace() or text[k - 1] in "([{") and text[k + 1 : k + 2].strip():
                return True
        text = _QUOTED.sub(" ", text)
    if "(" not in text and "[" not in text and "{" not in text:
        return False
    depth = 0
    for c in _BRACKET.findall(_NO_BRACKET.sub(" ", text)):
        depth = depth + 1 if c in "([{" else max(0, depth - 1)
    return depth > 0


def is_truncated(answer: str, visible: str) -> bool | tuple[str, str]:
    """Whether the answer stops before its end, or (rule, word) if that hangs on the endings of its last word (in lower case).

    The rules: "cut" if texts don't stop after the word, "open" if they don't nearly always.
    """
    low = answer.lower()
    opened = low.rfind("<think>")
    if opened >= 0 and "</think>" not in low[opened:]:
        return True
    if low.rfind("<answer>") > low.rfind("</answer>"):
        return True
    text = visible.rstrip()
    if text.count("```") % 2 or text.count("\\boxed{") > len(re.findall(r"\\boxed\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", text)):
        return True
    if text.count("“") > text.count("”") + text.count("„") or text.count("«") > text.count("»") or text.count("$$") % 2:
        return True
    if left_open(text):
        return True
    if "</answer>" in low or _END_MARK.search(answer[-40:]):
        return False  # closed by its own mark
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    last = lines[-1].rstrip()
    bare = last.rstrip("*_​ ")
    if not bare:
        return False
    end = bare[-1]
    if end in ",;:" or (end in "-–—" and len(bare) > 1 and bare[-2].isalnum()):
        return True
    if not end.isalnum() or last.endswith(" *"):
        tail = last[-80:] if last.endswith(" *") and last.count("*") % 2 and not _ITEM.match(last) else bare[-80:]
        if _OPERATOR.search(tail) and not _PADDED.search(tail):
            return True
    if not end.isalnum() or _SIGNED.search(bare):
        return False
    found = _WORD.findall(bare)
    if len(lines) > 1 and len(found) <= 4 and len(lines[-2].split()) <= 4 and lines[-2].rstrip()[-1] not in ".!?:" and all(not w[0].islower() for w in found):
        return False  # a closing line and a name
    word = found[-1]
    if _ITEM.match(lines[-1]):
        return ("cut", word.lower()) if word[0].islower() else False
    if _CODE_LINE.search(lines[-1]):
        return False
    if len(_WORD.findall(text)) <= 3:
        return ("cut", word.lower()) if word.lower() in _ANY_FUNCTION else False
    # A missing full stop alone tells nothing: earlier sentences have theirs, or a full sentence began, or the word itself is one that goes on.
    begun = len(_WORD.findall(text)) >= SENTENCE_WORDS and text.lstrip(" \n*_#>\"“«")[:1].isupper() and not end.isdigit()
    return ("open" if begun or _ENDED.search(text) else "cut", word.lower())


def is_refusal(visible: str) -> bool:
    text = visible.replace("’", "'").lower().strip(" \n\"'*_")
    declines, fills = (_REFUSAL,), (_FILLER,)
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        declines, fills = (_REFUSAL, _REFUSAL_THERE), (_FILLER, _FILLER_THERE)
    if not any(p.search(text) for p in declines):
        return False
    for sentence in _SENTENCE.split(text):
        s = sentence.strip()
        if _WORD.search(s) and not any(p.search(s) for p in (*declines, *fills)):
            return False
        if len(s.split()) > 40 or re.search(r"[\"”»],? (?:and|said|dijo|sagte|a dit|says)|^[\"“«„]", s):
            return False
    return True


@lru_cache(maxsize=16)
def _sources(prompt: str, turn: str) -> list[tuple[list[str], frozenset[str]]]:
    """The words of the last turn and, if that is another, of the whole prompt."""
    found = [_WORD.findall(_END_MARK.sub(" ", source).lower()) for source in ((turn, prompt) if turn != prompt else (prompt,))]
    return [(words, frozenset(words)) for words in found]


def is_copied(prompt: str, turn: str, visible: str) -> bool:
    got = _WORD.findall(_LABEL.sub("", visible.strip()).lower())
    if not got:
        return False
    for words, known in _sources(prompt, turn):
        if not words or len(got) < 0.5 * len(words):
            continue
        if sum(map(known.__contains__, got)) < 0.75 * len(got):
            continue
        bag, pairs = Counter(words), Counter(zip(words, words[1:]))
        own, own_pairs = Counter(got), Counter(zip(got, got[1:]))
        times = max(1, round(len(got) / len(words)))  # given back more than once
        shared = sum(min(n, times * bag[w]) for w, n in own.items())
        linked = sum(min(n, times * pairs[w]) for w, n in own_pairs.items())
        if shared >= 0.75 * len(got) and linked >= 0.5 * max(1, len(got) - 1):
            return True
    return False


@lru_cache(maxsize=16)
def _wanted(prompt: str) -> tuple[str, str | None, str | None]:
    """The last turn of a prompt, and the script and language that it wants. The answers of a pair come one after the other."""
    turn, asked = last_turn(prompt), asked_language(prompt)
    return turn, SCRIPT_OF.get(asked, "LATIN") if asked else script(turn), asked or language(turn)


def is_foreign(prompt: str, visible: str) -> bool:
    _, written, wanted = _wanted(prompt)
    prose = _FENCE.sub(" ", visible) if "```" in visible else visible
    given = script(prose)
    if written and given and written != given:
        return True
    if given != "LATIN" or not wanted:
        return False
    given = language(prose)
    return bool(given and wanted != given)


def defects(prompt: str | None, answer: str | None) -> tuple[list[str], tuple[str, str] | None]:
    """Every defect of the answer in the order of the rules, and the rule and word on which "truncated" hangs, if it does.

    A null answer is empty, and an empty one has no other defect.
    """
    if answer is None:
        return ["empty"], None
    visible = _visible(answer)
    if is_empty(answer, visible):
        return ["empty"], None
    asked = prompt is not None and bool(prompt.strip())
    turn = _wanted(prompt)[0] if asked else ""
    out, hangs = [], None
    if asked and is_copied(prompt, turn, visible):  # before "truncated": a copy may lack its full stop
        out.append("copied")
    if cut := is_truncated(answer, visible):
        out.append("truncated")
        hangs = cut if cut is not True else None
    if is_refusal(visible):
        out.append("refusal")
    if asked and is_foreign(prompt, visible):
        out.append("language")
    return out, hangs


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            count.update(_TOKEN.findall(text.lower()))
    words: dict[str, list[int]] = {}
    for token, n in count.items():
        ends = token[-1] in ".!?"
        got = words.setdefault(token[:-1] if ends else token, [0, 0])
        got[0] += n
        got[1] += n if ends else 0
    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([v[0] for v in words.values()], pa.int64()), pa.array([v[1] for v in words.values()], pa.int64())], names=["w", "n", "f"])


def _endings(answers: DataFrame, words: DataFrame) -> DataFrame:
    """For every word of ``words``: whether texts don't stop after it (``cut``), and whether they nearly always do (``whole``).

    Counted over all answers, whatever the number of different words: counts and prefixes are joined by word, none is broadcast.
    """
    counts = answers.mapInArrow(_count_words, "w string, n bigint, f bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    counts = written(counts, "words")
    beginnings = F.transform(F.sequence(F.lit(2), F.length("w") - 1), lambda k: F.substring(F.col("w"), F.lit(1), k))
    longer = counts.where((F.col("n") >= 2 * MUCH_MORE) & (F.length("w") > 2)).select(F.explode(beginnings).alias("word"), "n")
    longer = longer.groupBy("word").agg(F.max("n").alias("longer"))
    n, f = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0))
    seldom = (F.col("word").isin(*sorted(_ANY_FUNCTION)) & (f <= SELDOM_LAST * n)) | ((n >= KNOWN) & (f < SELDOM_LAST * n))
    begun = (n < KNOWN) & (f == 0) & (F.coalesce("longer", F.lit(0)) >= MUCH_MORE * F.greatest(n, F.lit(2)))
    found = words.join(counts.withColumnRenamed("w", "word"), "word", "left").join(longer, "word", "left")
    return found.select("word", (seldom | begun).alias("cut"), ((n >= KNOWN) & (f > MOSTLY_LAST * n)).alias("whole"))


def flag_pairs(df: DataFrame, keys: list[str], prompt: str, answer: str) -> DataFrame:
    """``keys`` with ``defect`` and ``place`` (1 for the first rule that applied): one row for every defect of every row of ``df``.

    Rules, in this order: *empty* (null, or nothing but blanks, tags, marks or a word for "no value"; finished thinking without an
    answer), *copied* (the prompt or its last turn, perhaps slightly changed), *truncated* (thinking, tag, code fence, bracket or
    quotation left open, or an abrupt end), *refusal* (phrases in eleven languages, and nothing else in the answer) and *language* (the
    answer's script isn't that of the language asked for, or of the prompt; among languages in Latin letters function words vote). Where
    the prompt is null or blank, *copied* and *language* never apply. Repeated rows count each; an empty table gives an empty result;
    other columns aren't read; texts are read whole.

    Whether an unpunctuated end is abrupt hangs on how often its last word ends a sentence in all answers (and never on a missing full
    stop alone). Answers with a possible defect are written; the words on which some of them hang are joined with the counts of all
    words, and the verdicts joined back.
    """
    fields = [f for f in df.schema.fields if f.name in keys]
    names = [f.name for f in fields]
    found = "_defects array<string>, _rule string, _word string"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists, rules, words = [], [], [], []
            for k, (p, a) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())):
                out, hangs = defects(p, a)
                if out:
                    at.append(k)
                    lists.append(out)
                    rules.append(hangs[0] if hangs else None)
                    words.append(hangs[1] if hangs else None)
            kept = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array(lists, pa.list_(pa.string())), pa.array(rules, pa.string()), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(names)], *columns], names=[*names, "_defects", "_rule", "_word"])

    answers = df.where(F.col(answer).isNotNull()).select(answer)
    flagged = written(df.select(*names, F.col(prompt).alias("prompt"), F.col(answer).alias("answer")).mapInArrow(run, schema), "flags")
    hanging = flagged.where(F.col("_word").isNotNull())
    verdicts = _endings(answers, hanging.select(F.col("_word").alias("word")).distinct()).toDF("_word", "_cut", "_whole")
    cut = F.when(F.col("_rule") == "cut", F.col("_cut")).otherwise(~F.col("_whole"))
    decided = hanging.join(verdicts, "_word").select(*names, F.filter("_defects", lambda d: (d != "truncated") | cut).alias("_defects"))
    every = flagged.where(F.col("_word").isNull()).select(*names, "_defects").unionByName(decided)
    return every.select(*names, F.posexplode("_defects").alias("_at", "defect")).select(*names, "defect", (F.col("_at") + 1).alias("place"))


def pair_fields(sft: DataFrame, preferences: DataFrame) -> DataFrame:
    """All answers of both tables as rows (tab, seq, field, prompt, answer)."""
    one = sft.select(F.lit("sft_pairs").alias("tab"), "seq", F.lit("response").alias("field"), "prompt", F.col("response").alias("answer"))
    two = preferences.select(
        F.lit("preference_pairs").alias("tab"), "seq", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("answer")) for c in ("chosen", "rejected")])).alias("x"), "prompt"
    ).select("tab", "seq", "x.field", "prompt", "x.answer")
    return one.unionByName(two)
