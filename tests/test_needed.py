"""Literals read off patterns: sound against the patterns themselves."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultmill.rules import fixed_values as fv
from faultmill.rules.needed import fold, required


@pytest.mark.parametrize(("pattern", "want"), [
    ("disk full", {"disk full"}), ("Disk (full|empty)", {"disk full", "disk empty"}), (r"disk \d+ full", {"disk ", " full"}),
    ("(abc|x)", None), ("a?bcd", {"bcd"}), ("(ab){2}", {"abab"}), ("(abc)+x", {"abc"}), ("(abc)*", None),
    ("foo.*barbaz", {"barbaz"}), ("[ab]cd", {"acd", "bcd"}), ("[^a]xyz", {"xyz"}), ("(?=abc)de", {"de"}), ("(open", set()),
    (r"^\s+$", None), ("(?:one|two|(?:three|four)x)", {"one", "two", "threex", "fourx"}), ("", None), ("(a)(?(1)bcd|efg)", {"abcd", "aefg"}),
    ("KK", None), ("日本", {"日本"}), ("x{2,3}", {"xx"})])
def test_examples(pattern, want):
    got = required(pattern)
    if pattern == r"disk \d+ full":
        assert got in ({"disk "}, {" full"})
    else:
        assert got == (None if want is None else frozenset(want))


def test_case():
    assert required("AKIA[A-Z]+", False) == {"AKIA"}
    assert required("(?i)AKIA", False) is None and required("x(?i:AKIA)", False) is None
    assert required("(a(b|(?i:cd))){2}", False) is None


def test_built_in_patterns_have_needs():
    for rule in fv.TRIAGE_RULES:
        assert required(rule[4]), rule
    for _, _, pattern, _ in fv.CURATED_KB:
        assert required(pattern), pattern


pieces = st.sampled_from(["a", "b", "K", "s", "I", "é", "7", ".", r"\d", r"\w", "[ab]", "[^a]", "[a-c]", "(?:", "(", ")", "|", "*",
                          "+", "?", "{2}", "{1,3}", "^", "$", r"\b", "(?=b)", "(?!a)", "(?i:", "\\1", " "])


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=9).map("".join),
       st.lists(st.text("abAkKsSiIİıſKéÉ7 \n", max_size=9), min_size=1, max_size=6), st.booleans())
def test_sound(pattern, texts, blind):
    needs = required(pattern, blind)
    try:
        compiled = re.compile(pattern, (re.I if blind else 0) | re.S)
    except re.error:
        assert needs == frozenset()
        return
    for text in texts:
        if needs is not None and compiled.search(text):
            assert any(n in (fold(text) if blind else text) for n in needs)
