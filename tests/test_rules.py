import random
import re

import pytest

from motifloom.functions import rules as R


@pytest.mark.parametrize(
    "rule, word, expected",
    [
        ("x(0,2)-I-V-I-I-x(0,3)", "G_I_VII", False),
        ("G_I_VII", "GAIAVII", True),
        ("[ABC]-K", "AK", False),
        ("[basic]-Y-R", "KYR", True),
        ("[bulky]-K", " K", True),
        ("([basic])-A", "KA", True),
        ("([basic])-A", "A", True),
        ("x-A", "xA", True),
        ("(ABC)-K", "AK", True),
        ("(_)-K", "GGK", True),
        ("(_)-K", "K", False),
        ("", "", True),
        ("", "A", False),
        ("A-C", "AC\n", False),
        ("YRGx(1,3)", "YRGx", True),
    ],
)
def test_covers(rule, word, expected):
    assert R.covers(rule, word) is expected


def test_parser_quirks():
    assert [t.kind for t in R.parse("([basic])")] == ["optional_class", "optional"]
    assert [t.kind for t in R.parse("(_)")] == ["gap", "optional"]
    assert R.parse("x(0)") == [R.Token("optional", "\0", 0, 0)]
    assert [t.kind for t in R.parse("A-[B")] == ["literal", "literal"] and R.parse("()") == [R.Token("optional", "\0")]
    assert R.parse("-x(2)-x( 1,3)_x(1,1)") == [R.Token("fixed", "", 2, 2), R.Token("range", "", 1, 3), R.Token("gap", "", 1, 4), R.Token("range", "", 1, 1)]
    with pytest.raises(ValueError):
        R.parse("x(a)")


def test_words_with_line_breaks_keep_their_places():
    assert [h.tolist() for h in R.hits(["A.{1,1}C", "C"], ["A\nC", "ABC", "C", "A\n"])] == [[0, 1], [2]]


def test_costs():
    assert R.costs(R.parse("[basic]-Y-R-G-S-D-C")).complexity == 7.5
    c = R.costs(R.parse("x(0,3)-Y-R-G-S-D-C-x(0,3)"))
    assert c.complexity == 11.0 and c.sum_wildcard == 6 and R.allowed(c)
    assert R.costs(R.parse("[basic]-Y-R-(G)-G-S-D-C")).complexity == 9.5


def test_columns_equal_the_parser(spark):
    texts = ["N-_-[hydroxyl]-_-[basic]-F", "(T)-x(0,2)-E-K", "AC_DE", "([basic])-A-x(3)", "[small]-[polar]-x(2,2)-(_)-K", "[nothing]-A", "K"]
    words = ["NASLKF", "TEK", "EK", "ACQQDE", "KAAAA", "AAAAAAK", "K", "", "A"]
    df = spark.createDataFrame([(r, w) for r in texts for w in words], "r string, w string")
    df = df.select("r", "w", R.rule_matches(df.w, R.rule_regex(df.r)).alias("m"), R.rule_costs(df.r).alias("c"), R.rule_covers_word("r", "w").alias("u"))
    for r in df.collect():
        assert r.m == r.u == R.covers(r.r, r.w), (r.r, r.w)
        assert tuple(r.c) == tuple(R.costs(R.parse(r.r)))
    assert [list(h) for h in R.hits([R.to_regex("A-x(1,2)"), R.to_regex("K")], ["AC", "K", "ACD", "K"])] == [[0, 2], [1, 3]]


def test_only_likely_words_are_tried(monkeypatch):
    """a rule with letters isn't scanned for in all words; what its letters and lengths leave out never matches."""
    random.seed(2)
    ws = ["".join(random.choice("ACDEFGHIKLMNPQRSTVWY_") for _ in range(random.randint(1, 12))) for _ in range(600)] + ["", "AC\nDE", "AXC", "A\x00C", "ac"]
    ps = ["AC.{1,4}D", "(A)?C[DE]D", r"A.{1,4}\x00?C", r"A(?:[STNQYCDERKHR])?\x00?G.{2,2}", "(?!)A", r"\_A.{0,3}", "A.{1,1}C", "ac", "[AVLI].{0,2}(K)?"]
    want = [[k for k, w in enumerate(ws) if re.fullmatch(p, w, re.S)] for p in ps]
    assert [f.tolist() for f in R.hits(ps, ws)] == want and sum(map(len, want)) > 20
    assert R._asks("AC.{1,4}D(K)?") == (0b1101, 4, 8) and R._asks("(?!)A")[0] == 0 and R._asks("a|b") == (0, 0, R._LONG)
    monkeypatch.setattr(R.re, "finditer", None)
    assert [f.tolist() for f in R.hits(ps[:1], ws)] == want[:1]


def test_plain_patterns_are_tried_on_all_words_at_once(monkeypatch):
    """F8: a pattern of letters, classes and bounded stretches needs no regular expression, which was compiled for each rule and tried word by word."""
    random.seed(8)
    ws = ["".join(random.choice("ACDE_") for _ in range(random.randint(0, 9))) for _ in range(500)] + ["", "A\nC", "A\x00", "É", "A" * 30]
    ps = ["AC.{1,4}D", "(A)?C[DE](C)?A", ".{0,3}A[AC].{2,2}", ".{1,4}A(C)?(D)?", ".{0,40}", ".{31,40}", "(A)?", "A", "", "A.{1,1}C", "A.{0,30}"]
    want = [[k for k, w in enumerate(ws) if re.fullmatch(p, w, re.S)] for p in ps]
    monkeypatch.setattr(R.re, "compile", None)
    monkeypatch.setattr(R.re, "finditer", None)
    assert [f.tolist() for f in R.hits(ps, ws)] == want and sum(map(len, want)) > 500
