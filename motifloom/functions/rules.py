"""The rule language: parsing, costs, regular expressions and matching.

``parse`` reads any rule text by a grammar of token alternatives. ``rule_regex`` and ``rule_costs`` work on a Column of rules as the engine
writes them, tokens joined by `-`, or on plain words, and stay on the JVM side.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifloom.functions.alphabet import BY_NAME, CLASSES

MIN_LITERALS, MAX_WILDCARD, MAX_WILDCARDS, MAX_TIER3, MAX_COMPLEXITY = 3, 4, 6, 1, 12.0


class Token(NamedTuple):
    kind: str  # literal, class, optional, optional_class, gap (the underscore), fixed, range
    value: str = ""
    least: int = 1
    most: int = 1


# The alternatives of a token, tried in this order. A stretch begins with an x that follows no letter; between brackets or parentheses a dash is a
# character like any other.
_GRAMMAR = re.compile(
    r"""(?P<between>-)
      | (?P<gap>_)
      | \[ (?P<class>[^\]]*) \]
      | (?<![^-\])_]) x\( (?P<stretch>[^)[][^)]*) \)
      | \( \[ (?P<optional_class>[^\]]*) \] \)
      | \( (?P<optional_gap>_) \)
      | \( (?P<optional>[^)]*) \)
      | (?P<stray>[][()])
      | (?P<literal>.)""",
    re.X | re.S,
)
_NOTHING = Token("optional", "\0")  # what a closing parenthesis adds when no letter stands before it
_GAP = Token("gap", "", 1, 4)
_MEANING = {
    "between": lambda t: [],
    "stray": lambda t: [],
    "gap": lambda t: [_GAP],
    "class": lambda t: [Token("class", t)],
    "stretch": lambda t: [_stretch(*map(_number, t.split(",", 1)))],
    "optional_class": lambda t: [Token("optional_class", t), _NOTHING],
    "optional_gap": lambda t: [_GAP, _NOTHING],
    "optional": lambda t: [Token("optional", t[0]) if t else _NOTHING],
    "literal": lambda t: [Token("literal", t)],
}


def _number(text: str) -> int:
    m = re.match(r"\s*[+-]?\d+", text)
    if not m:
        raise ValueError(f"no number in a wildcard: {text!r}")
    return int(m[0])


def _stretch(low: int, high: int | None = None) -> Token:
    if high is not None:
        return Token("range", "", low, high)
    return Token("fixed", "", low, low) if low else _NOTHING._replace(least=0, most=0)


def parse(rule: str) -> list[Token]:
    """The tokens of a rule text; raises ValueError for a wildcard without a number.

    A parenthesis counts its first letter only, and adds an optional NUL behind a class or `_`, which stays needed; x(0) is an optional NUL;
    `[ABC]` names a class that isn't known and matches nothing; letters may stand without dashes; a bracket without its partner is no token.
    """
    return [t for m in _GRAMMAR.finditer(rule) for t in _MEANING[m.lastgroup](m[m.lastgroup])]


def token_text(t: Token) -> str:
    """The token as it is written in a rule."""
    texts = {"class": f"[{t.value}]", "optional": f"({t.value})", "optional_class": f"([{t.value}])", "gap": "_", "fixed": f"x({t.least})", "range": f"x({t.least},{t.most})"}
    return texts.get(t.kind, t.value)


_PARSED = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n in ("kind", "value", "text") else T.IntegerType()) for n in (*Token._fields, "text")]))


@F.pandas_udf(_PARSED)
def parsed_rule(rule: pd.Series) -> pd.Series:
    """The tokens of any rule text; null for a null or a wildcard without a number."""

    def one(r):
        try:
            return None if r is None else [dict(t._asdict(), text=token_text(t)) for t in parse(r)]
        except ValueError:
            return None

    return rule.map(one, na_action=None)


def _one_of(name: str) -> str:
    return "[" + BY_NAME[name].residues + "]" if name in BY_NAME else r"[^\x00-\U0010ffff]"


def token_regex(t: Token) -> str:
    if t.kind == "literal":
        return re.escape(t.value)
    if t.kind == "optional":
        return f"(?:{re.escape(t.value)})?"
    if t.kind == "class":
        return _one_of(t.value)
    if t.kind == "optional_class":
        return f"(?:{_one_of(t.value)})?"
    return ".{%d,%d}" % (t.least, t.most)


def to_regex(rule: str) -> str:
    return "".join(map(token_regex, parse(rule)))


def covers(rule: str, word: str) -> bool:
    """Whether the whole word matches the rule."""
    return re.fullmatch(to_regex(rule), word, re.S) is not None


class Costs(NamedTuple):
    literals: int
    tier3: int
    max_wildcard: int
    sum_wildcard: int
    complexity: float


def costs(tokens: list[Token]) -> Costs:
    price = {"literal": 1.0, "class": 1.5, "optional": 2.0, "optional_class": 2.5, "gap": 2.0}
    wild = [t.most for t in tokens if t.kind in ("gap", "fixed", "range")]
    total = sum(price[t.kind] if t.kind in price else 1 + 0.5 * (t.most if t.kind == "fixed" else t.most - t.least) for t in tokens)
    tier3 = sum(t.kind in ("class", "optional_class") and t.value in BY_NAME and BY_NAME[t.value].tier == 3 for t in tokens)
    return Costs(sum(t.kind == "literal" for t in tokens), tier3, max(wild, default=0), sum(wild), float(total))


def allowed(c: Costs) -> bool:
    """The constraints on a rule for a pair of words."""
    few = c.max_wildcard <= MAX_WILDCARD and c.sum_wildcard <= MAX_WILDCARDS and c.tier3 <= MAX_TIER3
    return c.literals >= MIN_LITERALS and few and c.complexity <= MAX_COMPLEXITY


# ---- the same on Columns --------------------------------------------------------------------------------------------------------


def rule_tokens(rule: Column) -> Column:
    """Array of token texts: split at dashes; a text without any token sign is a plain word, a token a character."""
    plain = rule.rlike(r"^[A-Z_]*$")
    return F.when(plain, F.filter(F.split(rule, ""), lambda t: t != "")).otherwise(F.split(rule, "-"))


def _wild(t: Column) -> tuple[Column, Column]:
    low = F.regexp_extract(t, r"^x\((\d+)", 1).cast("int")
    return low, F.coalesce(F.nullif(F.regexp_extract(t, r"^x\(\d+,(\d+)\)", 1), F.lit("")).cast("int"), low)


def _is(t: Column) -> dict[str, Column]:
    return {
        "gap": t == "_", "wild": t.rlike(r"^x\(\d+(,\d+)?\)$"), "class": t.rlike(r"^\[\w+\]$"), "optional": t.rlike(r"^\([A-Z]\)$"),
        "optional_gap": t == "(_)", "optional_class": t.rlike(r"^\(\[\w+\]\)$"),
    }


def _class_map(value) -> Column:
    return F.create_map(*[F.lit(x) for c in CLASSES for x in (c.name, value(c))])


def rule_regex(rule: Column, nothing: str = "(?!)") -> Column:
    """Regular expression of an engine-written rule, to be used with ``rule_matches``."""
    name = lambda t: F.regexp_extract(t, r"(\w+)", 1)
    group = lambda t: F.coalesce(_class_map(lambda c: f"[{c.residues}]")[name(t)], F.lit(nothing))

    def one(t: Column) -> Column:
        k = _is(t)
        low, high = _wild(t)
        return (
            F.when(k["gap"], F.lit(".{1,4}"))
            .when(k["wild"], F.concat(F.lit(".{"), low.cast("string"), F.lit(","), high.cast("string"), F.lit("}")))
            .when(k["class"], group(t))
            .when(k["optional"], F.concat(t, F.lit("?")))
            .when(k["optional_gap"], F.lit(r".{1,4}\x00?"))
            .when(k["optional_class"], F.concat(F.lit("(?:"), group(t), F.lit(r")?\x00?")))
            .otherwise(F.regexp_replace(t, "([^A-Za-z0-9])", r"\\$1"))
        )

    return F.array_join(F.transform(rule_tokens(rule), one), "")


def rule_matches(word: Column, regex: Column) -> Column:
    """Whether the whole word matches; a final line break isn't overlooked."""
    return F.regexp_like(word, F.concat(F.lit(r"(?s)\A(?:"), regex, F.lit(r")\z")))


def rule_costs(rule: Column) -> Column:
    """Struct of literals, tier3, max_wildcard, sum_wildcard, complexity of an engine-written rule."""

    def price(t: Column) -> Column:
        k, (low, high) = _is(t), _wild(t)
        ranged = t.contains(",")
        return (
            F.when(k["gap"] | k["optional"], F.lit(2.0))
            .when(k["optional_gap"], F.lit(4.0))
            .when(k["optional_class"], F.lit(4.5))
            .when(k["class"], F.lit(1.5))
            .when(k["wild"], F.when(ranged, (high - low) * 0.5 + 1).otherwise(low * 0.5 + 1))
            .otherwise(F.lit(1.0))
        )

    def width(t: Column) -> Column:
        k = _is(t)
        return F.when(k["gap"] | k["optional_gap"], F.lit(4)).when(k["wild"], _wild(t)[1]).otherwise(F.lit(0))

    tokens = rule_tokens(rule)
    third = F.array(*[F.lit(c.name) for c in CLASSES if c.tier == 3])
    tier3 = F.filter(tokens, lambda t: t.contains("[") & F.array_contains(third, F.regexp_extract(t, r"(\w+)", 1)))
    widths = F.transform(tokens, width)
    return F.struct(
        F.size(F.filter(tokens, lambda t: (F.length(t) == 1) & (t != "_"))).alias("literals"),
        F.size(tier3).alias("tier3"),
        F.coalesce(F.array_max(widths), F.lit(0)).alias("max_wildcard"),
        F.aggregate(widths, F.lit(0), lambda a, x: a + x).alias("sum_wildcard"),
        F.aggregate(F.transform(tokens, price), F.lit(0.0), lambda a, x: a + x).alias("complexity"),
    )


def rule_lengths(rule: Column) -> Column:
    """Struct of the least and most characters that a word needs to match an engine-written rule."""

    def span(t: Column, end: str) -> Column:
        k, (low, high) = _is(t), _wild(t)
        some = {"least": (1, low, 0, 1, 0), "most": (4, high, 1, 5, 2)}[end]
        out = F.when(k["gap"], F.lit(some[0])).when(k["wild"], some[1])
        for name, n in zip(("optional", "optional_gap", "optional_class"), some[2:]):
            out = out.when(k[name], F.lit(n))
        return out.otherwise(F.lit(1))

    total = lambda end: F.aggregate(F.transform(rule_tokens(rule), lambda t: span(t, end)), F.lit(0), lambda a, x: a + x)
    return F.struct(total("least").alias("least"), total("most").alias("most"))


def rule_allowed(c: Column) -> Column:
    few = (c["max_wildcard"] <= MAX_WILDCARD) & (c["sum_wildcard"] <= MAX_WILDCARDS) & (c["tier3"] <= MAX_TIER3)
    return (c["literals"] >= MIN_LITERALS) & few & (c["complexity"] <= MAX_COMPLEXITY)


@F.pandas_udf(T.BooleanType())
def rule_covers_word(rule: pd.Series, word: pd.Series) -> pd.Series:
    """Any rule text against any word; null for a null or a rule whose wildcard has no number."""
    compiled: dict[str, re.Pattern | None] = {}

    def one(r, w):
        if r is None or w is None:
            return None
        if r not in compiled:
            try:
                compiled[r] = re.compile(to_regex(r), re.S)
            except ValueError:
                compiled[r] = None
        return None if compiled[r] is None else compiled[r].fullmatch(w) is not None

    return pd.Series([one(r, w) for r, w in zip(rule, word)], dtype=object)


_PIECE = re.compile(
    r"""\.\{(?P<least>\d+),(?P<most>\d+)\}
      | (?P<class>\[[^]\\]*\])
      | \( (?: \?: )? (?: [A-Z] | \[[^]\\]*\] ) \)\? (?P<maybe>)
      | \\x00\? (?P<nul>)
      | (?P<letter>[A-Za-z0-9])
      | \\ (?P<sign>[^A-Za-z0-9])""",
    re.X,
)
_LONG = 1 << 40


def _letters(text: str) -> int:
    """The set of the capital letters in text."""
    mask = 0
    for c in set(text):
        if "A" <= c <= "Z":
            mask |= 1 << (ord(c) - 65)
    return mask


def _asks(pattern: str) -> tuple[int, int, int]:
    """(set of letters, least, most characters) that a word needs to match an expression of ``rule_regex``; of any other expression nothing is told."""
    at, letters, least, most = 0, "", 0, 0
    for m in _PIECE.finditer(pattern):
        if m.start() != at:
            break
        at, kind = m.end(), m.lastgroup
        low, high = (int(m["least"]), int(m["most"])) if kind == "most" else (int(kind in ("class", "letter", "sign")), 1)
        letters += m["letter"] or ""
        least, most = least + low, most + high
    return (_letters(letters), least, most) if at == len(pattern) else (0, 0, _LONG)


_STEP = re.compile(r"\[([A-Za-z ]+)\]|\(([A-Za-z])\)\?|\.\{(\d+),(\d+)\}|([A-Za-z])")
_PLACES = 30  # places of a word that are held as bits


@lru_cache(maxsize=1 << 14)
def _steps(pattern: str) -> list[tuple] | None:
    """What a pattern of letters, classes, optional letters and bounded stretches takes, step by step, as (letters or None, may be left out, least, most); None for another pattern."""
    out, at = [], 0
    for m in _STEP.finditer(pattern):
        if m.start() != at:
            return None
        at = m.end()
        group, optional, least, most, letter = m.groups()
        out.append((None, False, int(least), int(most)) if least else (group or optional or letter, bool(optional), 1, 1))
    return out if at == len(pattern) else None


class _Places:
    """By letter or letters: the places of words where one of them is, as bits; each is found once."""

    def __init__(self, words: list[str]):
        text = np.array(words, dtype=f"U{_PLACES}")
        self.codes = text.view(np.uint32).reshape(len(words), _PLACES) if len(words) else np.zeros((0, _PLACES), np.uint32)
        self.held: dict[str, np.ndarray] = {}

    def of(self, letters: str) -> np.ndarray:
        if letters not in self.held:
            some = np.isin(self.codes, [ord(c) for c in letters])
            self.held[letters] = (some.astype(np.uint32) << np.arange(_PLACES, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
        return self.held[letters]

    def match(self, steps: list[tuple], tried: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of the words ``tried``, of sizes ``size``, the steps match as a whole: all places that they may have come to are held as bits."""
        state = np.ones(len(tried), dtype=np.uint32)
        for letters, optional, least, most in steps:
            if letters is None:
                last, state = state, state << np.uint32(least) if least <= _PLACES else np.zeros_like(state)
                for k in range(least + 1, min(most, _PLACES) + 1):
                    state = state | last << np.uint32(k)
            else:
                taken = (state & self.of(letters)[tried]) << np.uint32(1)
                state = state | taken if optional else taken
        return tried[(state >> size.astype(np.uint32)) & 1 == 1]


def hits(patterns: list[str], words: list[str]) -> list[np.ndarray]:
    """For every pattern the places of the words that it matches as a whole. Only words with all its letters and a length that it can have are tried, all at
    once if the pattern has plain steps; another pattern that tells neither is scanned for in the joined words."""
    joined = "\n".join(w.replace("\n", "?") for w in words)
    broken = np.array([k for k, w in enumerate(words) if "\n" in w], dtype=np.int64)  # words with a line break are tried one by one
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
    sets, size = np.array([_letters(w) for w in words], dtype=np.int32), np.diff(starts) - 1
    places = _Places(words) if size.max(initial=0) <= _PLACES else None
    by_size = np.argsort(size, kind="stable")
    upto, sorted_sets = np.searchsorted(size[by_size], np.arange(_PLACES + 2)), sets[by_size]  # where the words of each size begin
    out = []
    for p in patterns:
        if places is not None and (steps := _steps(p)) is not None:
            letters = _letters("".join(s for s, optional, _, _ in steps if s and len(s) == 1 and not optional))
            least = sum(low for _, optional, low, _ in steps if not optional)
            first, last = upto[min(least, _PLACES + 1)], upto[min(sum(most for *_, most in steps), _PLACES) + 1]
            tried = np.sort(by_size[first:last][(sorted_sets[first:last] & letters) == letters])
            out.append(places.match(steps, tried, size[tried]))
            continue
        letters, least, most = _asks(p)
        tried = np.flatnonzero(((sets & letters) == letters) & (size >= least) & (size <= most))
        if len(tried) * 8 <= len(words):
            match = re.compile(p, re.S).fullmatch if len(tried) else None
            out.append(np.array([k for k in tried.tolist() if match(words[k])], dtype=np.int64))
            continue
        p = p.replace("(?!)", "[^\\x00-\\U0010ffff]")
        found = np.searchsorted(starts, [m.start() for m in re.finditer("(?m)^(?:%s)$" % p.replace(".{", "[^\\n]{"), joined)])
        if len(broken):
            own = [k for k in broken if re.fullmatch(p, words[k], re.S)]
            found = np.sort(np.concatenate([found[~np.isin(found, broken)], np.array(own, np.int64)]))
        out.append(found)
    return out
