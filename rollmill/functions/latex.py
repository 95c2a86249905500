"""Canonical forms of LaTeX answers: a scanner over tokens, with tables of what is dropped, renamed and unwrapped.

A text becomes a list of tokens (commands, numbers, spaces, single characters); one walk over them drops and renames, completes
arguments of fractions and roots, and writes the rest out again. Two profiles differ in their tables: SHORT for plain answers,
LONG for answers of many benchmarks (units, words, intervals, matrices).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"\\[dt]?frac|\\sqrt|\\[A-Za-z]+|\\.|\s+|[^\\]|\\", re.S)
#: Numbers in words.
ONES = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
# Words for units, counted things and leftovers of word problems, which stand beside a number and aren't part of it.
UNITS = tuple(
    "acre|apple|by|cc|cm|coin|cube|cubic|cu cm|day|decrease|deg|degree|dm|east|excess|feet|ft|gain|gal|gallon|gm|hectare|hour|hr|inch|inches|increase|kg|km|kmh|kmph|lb|less|liter|litre|loss|man|mark|men|"
    "meter|metre|mile|min|minute|mm|month|monkey|more|mph|mt|mtr|no change|noon|number|ohm|per|percent|pie|prime|profit|pure|ratio|rise|rounds|rs|rupee|sec|second|soldier|sq|sq inch|sq m|square|tile|toy|unit|"
    "way|west|woman|women|yard|year|yr".split("|")
)
_UNIT = re.compile(r"(?<!\w)(?:" + "|".join(sorted((u + s for u in UNITS for s in ("", "s")), key=len, reverse=True)) + r")(?!\w)")


@dataclass(frozen=True)
class Profile:
    """What a walk over the tokens does: commands that vanish, that are renamed, whose argument vanishes or takes their place."""

    dropped: frozenset[str]
    renamed: dict[str, str]
    unwrapped: frozenset[str] = frozenset()
    voided: frozenset[str] = frozenset()
    units: bool = False
    whole_root: bool = False


_SAME = {"\\tfrac": "\\frac", "\\dfrac": "\\frac"}
SHORT = Profile(frozenset({"\\!", "\\left", "\\right", "\\$", "\\%"}), _SAME)
LONG = Profile(
    frozenset({"\\!", "\\left", "\\right", "\\$", "$", "\\%", "%", "\\(", "\\)", "\\mathbf"}),
    {**_SAME, "\\neq": "\\ne", "\\leq": "\\le", "\\geq": "\\ge", "\\{": "{", "\\}": "}"},
    frozenset({"\\text"}),
    frozenset({"\\mbox"}),
    units=True,
    whole_root=True,
)
MINIMAL = Profile(LONG.dropped, LONG.renamed, LONG.unwrapped, LONG.voided, units=False, whole_root=True)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def group_end(parts: list[str], at: int) -> int:
    """The place after the group that opens at ``at``; the end of the list if it never closes."""
    depth = 0
    for k in range(at, len(parts)):
        depth += (parts[k] == "{") - (parts[k] == "}")
        if depth == 0:
            return k + 1
    return len(parts)


class Writer:
    """One walk over the tokens by a profile."""

    def __init__(self, parts: list[str], profile: Profile):
        self.parts, self.profile, self.at = parts, profile, 0

    def argument(self, letters: bool = False) -> str | None:
        """The next argument in braces: a group as it is, a bare token wrapped (a run of word characters if ``letters``)."""
        if self.at >= len(self.parts):
            return None
        if self.parts[self.at] == "{":
            end = group_end(self.parts, self.at)
            inner = Writer(self.parts[self.at : end], self.profile).run()
            self.at = end
            return inner
        end = self.at + 1
        while letters and end < len(self.parts) and re.fullmatch(r"\w", self.parts[end]):
            end += 1
        bare = "".join(self.parts[self.at : end])
        self.at = end
        return "{" + bare + "}"

    def degrees(self) -> bool:
        """Skips a degree sign: a raised circle, with or without braces."""
        after = "".join(self.parts[self.at : self.at + 4])
        for form, size in (("^{\\circ}", 4), ("^\\circ", 2)):
            if after.startswith(form):
                self.at += size
                return True
        return False

    def run(self) -> str:
        out: list[str] = []
        own = self.profile
        while self.at < len(self.parts):
            if self.degrees():
                continue
            token = self.parts[self.at]
            self.at += 1
            token = own.renamed.get(token, token)
            if token in own.dropped:
                continue
            if token in own.unwrapped or token in own.voided:
                inner = self.argument() if self.at < len(self.parts) and self.parts[self.at] == "{" else None
                out.append("" if inner is None or token in own.voided else inner[1:-1])
            elif token == "\\frac":
                self.skip_space()
                first = self.argument()
                self.skip_space()
                second = self.argument() if first is not None else None
                out.append(token + (first or "") + (second or ""))
            elif token == "\\sqrt":
                following = self.parts[self.at] if self.at < len(self.parts) else ""
                if following == "[" or not following or (own.whole_root and not re.fullmatch(r"\w|\{", following)):
                    out.append(token)
                else:
                    out.append(token + (self.argument(own.whole_root) or ""))
            else:
                out.append(token)
        return "".join(out)

    def skip_space(self) -> None:
        while self.at < len(self.parts) and self.parts[self.at].isspace():
            self.at += 1


def number_of_words(text: str) -> int | None:
    """The whole number that words name ("forty-two thousand and one"); None for other text."""
    found = text.lower().replace("-", " ").split()
    total = part = 0
    seen = False
    for w in found:
        if w in ONES:
            part += ONES[w]
        elif w in TENS:
            part += TENS[w]
        elif w == "hundred":
            part = max(1, part) * 100
        elif w in SCALES:
            total, part = total + max(1, part) * SCALES[w], 0
        elif w == "and" and seen:
            continue
        else:
            return None
        seen = True
    return total + part if seen else None


def _leading_zeros(text: str) -> str:
    text = re.sub(r"(?<=[ {])\.(?=\d)", "0.", text)
    return "0" + text if text[:1] == "." else text


def _right_side(text: str) -> str:
    """The right side of an equation whose left side is a name of at most two characters."""
    sides = text.split("=")
    return sides[1] if len(sides) == 2 and len(sides[0]) <= 2 else text


_RATIO = re.compile(r"(-?\d+)/(-?\d+)")
_ROOT_RATIO = re.compile(r"(-?\d+|[^/]*sqrt[^/]*)/(-?\d+|[^/]*sqrt[^/]*)")


def _plain_ratio(text: str, roots: bool = False) -> str:
    m = (_ROOT_RATIO if roots else _RATIO).fullmatch(text)
    if not m:
        return text
    a, b = (str(int(x)) if re.fullmatch(r"-?\d+", x) else x for x in m.groups())
    return f"\\frac{{{a}}}{{{b}}}" if f"{a}/{b}" == text else text


def short_form(text: str) -> str:
    """Canonical form of a plain answer.

    Line breaks, sizing, degrees, escaped dollars and percent signs go; what follows a unit in ``\\text{ ...}`` goes with it; thousands
    commas, one pair of outer parentheses, a short left side and spaces go; fractions and roots get their braces; a/b of whole numbers
    and 0.5 become fractions. An empty text stays empty.
    """
    s = text.replace("\n", "").replace("\\!", "").replace("\\\\", "\\").replace("\\$", "")
    s = s.split("\\text{ ")[0] if "\\text{ " in s else s
    s = Writer(tokens(s), SHORT).run()
    s = _leading_zeros(s)
    if s.replace(",", "").isdigit():
        s = s.replace(",", "")
    if s.startswith("(") and s.endswith(")") and len(s) > 1:
        s = s[1:-1]
    s = _right_side(_leading_zeros(s)).replace(" ", "")
    return "\\frac{1}{2}" if s == "0.5" else _plain_ratio(s)


#: Names that an answer is assigned to, or tends to, and that aren't part of it.
_ASSIGNED = re.compile(r"[xyz](?:=|\\in(?![A-Za-z])|\\to(?![A-Za-z]))")
_ARRAY = re.compile(r"\\begin\{array\}\{[^{}]*\}")


def long_form(text: str, keep_units: bool = False) -> str:
    """Canonical form of an answer of any benchmark.

    Beside what :func:`short_form` does: closing full stops, dollar signs, words for units (unless ``keep_units``), a closing ``\\text{}``
    and the word "and" go; arrays and square-bracket matrices become round ones; text is unwrapped, numbers in words become digits,
    assigned names go, the whole line of reals, infinity, the empty set and the imaginary unit get one spelling, and zeros after a
    decimal point go. Percent signs go without dividing. Parentheses stay.
    """
    s = text.strip().replace("\n", "").rstrip(".")
    s = _ARRAY.sub(lambda m: "\\begin{pmatrix}", s).replace("\\end{array}", "\\end{pmatrix}").replace("bmatrix", "pmatrix")
    bare = re.sub(r"\\text\{[^{}]*\}$", "", s).strip()
    s = bare if bare else s
    if not keep_units:
        for _ in range(2):
            bare = _UNIT.sub("", s)
            s = bare if bare.strip() else s
    s = Writer(tokens(s), MINIMAL if keep_units else LONG).run()
    named = number_of_words(s.strip())
    s = str(named) if named is not None else s
    s = _ASSIGNED.sub("", s).replace("\\emptyset", "{}").replace("(-\\infty,\\infty)", "\\mathbb{R}")
    s = _leading_zeros(s)
    s = s.replace("infinity", "\\infty")
    s = s if "\\infty" in s else s.replace("inf", "\\infty")
    s = re.sub(r"(?<![A-Za-z])and(?![A-Za-z])", "", s)
    s = s.replace("j", "i") if "j" in s and "i" not in s else s
    s = re.sub(r"(\d)\.0*(?=\D|$)", r"\1", s)
    s = _right_side(_leading_zeros(s.strip())).replace(" ", "")
    return _plain_ratio(s, roots=True)


# ---- expressions ----

#: Functions and constants of expressions.
FUNCTIONS = ("sin", "cos", "tan", "sec", "csc", "cot", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "ln", "log", "exp", "sqrt")
_LEX = re.compile(r"\\(?:d|t)?frac|\\sqrt|\\(?:cdot|times|div|pi|left|right|,|;|!| )|\\[A-Za-z]+|\d+(?:\.\d+)?|\.\d+|\*\*|[A-Za-z]|[-+*/^(){}\[\]|,!=]|\S")


class Unparsed(ValueError):
    """The text isn't an expression that the parser knows."""


class Expression:
    """A formula read by recursive descent and evaluated with numbers for its letters. No code is ever executed from text.

    Sums, products (also implied), quotients, powers, roots, fractions, absolute values, common functions, pi, e and i; depth is bounded.
    """

    def __init__(self, text: str, deepest: int = 60):
        self.items = [t for t in _LEX.findall(text) if t not in ("\\left", "\\right", "\\,", r"\;", "\\!", "\\ ")]
        if len(self.items) > 2000:
            raise Unparsed("too long")
        self.at, self.depth, self.deepest, self.letters = 0, 0, deepest, set()
        self.tree = self.sum()
        if self.at < len(self.items):
            raise Unparsed(self.items[self.at])

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise Unparsed(wanted or "end")
        self.at += 1
        return token

    def sum(self):
        self.depth += 1
        if self.depth > self.deepest:
            raise Unparsed("too deep")
        left = ("neg", self.product()) if self.peek() == "-" and self.take() else self.product()
        while self.peek() in ("+", "-"):
            op = self.take()
            left = (op, left, self.product())
        self.depth -= 1
        return left

    def product(self):
        if self.peek() == "+":
            self.take()
        left = self.power()
        while True:
            token = self.peek()
            if token in ("*", "\\cdot", "\\times"):
                self.take()
                left = ("*", left, self.signed())
            elif token in ("/", "\\div"):
                self.take()
                left = ("/", left, self.signed())
            elif token and token not in ("+", "-", ")", "}", "]", "|", ",", "=", "!", "^", "**"):
                left = ("*", left, self.power())
            else:
                return left

    def signed(self):
        if self.peek() == "-":
            self.take()
            return ("neg", self.power())
        return self.power()

    def power(self):
        base = self.atom()
        if self.peek() in ("^", "**"):
            self.take()
            base = ("^", base, self.signed() if self.peek() != "{" else self.braced())
        return base

    def braced(self):
        self.take("{")
        inner = self.sum()
        self.take("}")
        return inner

    def argument(self):
        if self.peek() == "{":
            return self.braced()
        token = self.peek()
        if re.fullmatch(r"\d+", token) and len(token) > 1:  # \frac12 has two arguments of a digit each
            self.items[self.at : self.at + 1] = list(token)
        return self.atom()

    def atom(self):
        token = self.take()
        if re.fullmatch(r"\d+(?:\.\d+)?|\.\d+", token):
            return ("number", float(token))
        if token in ("(", "{", "[", "|"):
            inner = self.sum()
            self.take({"(": ")", "{": "}", "[": "]", "|": "|"}[token])
            return ("abs", inner) if token == "|" else inner
        if token.endswith("frac") and token.startswith("\\"):
            return ("/", self.argument(), self.argument())
        name = token.lstrip("\\")
        if token == "\\sqrt":
            if self.peek() == "[":
                self.take()
                degree = self.sum()
                self.take("]")
                return ("^", self.argument(), ("/", ("number", 1.0), degree))
            return ("sqrt", self.argument())
        if token.startswith("\\") and name in FUNCTIONS:
            raised = None
            if self.peek() == "^":
                self.take()
                raised = self.argument()
            inner = (name, self.argument() if self.peek() in ("{", "(") else self.power())
            return ("^", inner, raised) if raised else inner
        if name in ("pi", "π"):
            return ("number", 3.141592653589793)
        if len(token) == 1 and token.isalpha():
            if token == "e":
                return ("number", 2.718281828459045)
            if token == "i":
                return ("number", 1j)
            self.letters.add(token)
            return ("letter", token)
        if token.startswith("\\") and name.isalpha() and len(name) > 1:  # Greek letters and the like are names, too
            self.letters.add(token)
            return ("letter", token)
        raise Unparsed(token)

    def value(self, given: dict[str, float]) -> complex:
        return _evaluate(self.tree, given)


def _evaluate(node, given: dict[str, float]) -> complex:
    import cmath

    kind = node[0]
    if kind == "number":
        return node[1]
    if kind == "letter":
        return given[node[1]]
    first = _evaluate(node[1], given)
    if kind == "neg":
        return -first
    if kind == "abs":
        return abs(first)
    if len(node) == 3:
        second = _evaluate(node[2], given)
        if kind == "+":
            return first + second
        if kind == "-":
            return first - second
        if kind == "*":
            return first * second
        if kind == "/":
            return first / second
        if abs(second) > 200:
            raise Unparsed("power")
        return complex(first) ** second
    if kind in ("sec", "csc", "cot"):
        return 1 / {"sec": cmath.cos, "csc": cmath.sin, "cot": cmath.tan}[kind](first)
    if kind in ("arcsin", "arccos", "arctan"):
        return getattr(cmath, "a" + kind[3:])(first)
    return {"ln": cmath.log}.get(kind, getattr(cmath, kind, None))(first)


#: Fixed points at which formulas are compared, before they are spread over the letters.
_POINTS = (0.7310585, 1.2345679, 2.6180340, 0.3183099, 1.7320508)


def same_value(a: str, b: str, tolerance: float = 1e-6, factors: tuple[float, ...] = (1.0,)) -> bool:
    """Whether two formulas have equal values at fixed points, or values of a constant ratio out of ``factors``; False if one can't be read.

    Numbers without letters may differ by a ten-thousandth. Points at which a formula has no value don't count; one must be left.
    """
    try:
        x, y = Expression(a), Expression(b)
    except (Unparsed, RecursionError):
        return False
    letters = sorted(x.letters | y.letters)
    tolerance = tolerance if letters else 1e-4
    for factor in factors:
        met = 0
        for turn in range(len(_POINTS)):
            given = {name: _POINTS[(turn + k) % len(_POINTS)] + 0.1 * k for k, name in enumerate(letters)}
            try:
                p, q = complex(x.value(given)), complex(y.value(given)) * factor
            except (Unparsed, ArithmeticError, ValueError, TypeError, RecursionError):
                continue
            if not abs(p - q) <= tolerance * max(abs(p), abs(q), 1e-9):
                break
            met += 1
        else:
            if met:
                return True
    return False
