"""Display orders against worked examples, and properties of the algorithm."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from warraq.functions import bidi

ALEF, BEH = "ا", "ب"


def test_pure_text_reverses_in_either_direction():
    text = ALEF + BEH + " " + BEH
    assert bidi.visual(text, "rtl") == bidi.visual(text, "ltr") == text[::-1]


def test_latin_stays():
    assert bidi.visual("abc 12", "ltr") == "abc 12"


def test_numbers_keep_their_order_in_arabic():
    assert bidi.visual(f"{ALEF} 12", "rtl") == f"12 {ALEF}"


def test_words_change_sides_with_the_base():
    text = f"{ALEF} abc {BEH}"
    assert bidi.visual(text, "rtl") == f"{BEH} abc {ALEF}"
    assert bidi.visual(text, "ltr") == f"{ALEF} abc {BEH}"


def test_brackets_follow_the_text_inside():
    text = f"{ALEF}(abc)"
    assert bidi.visual(text, "rtl") == f")abc({ALEF}"


def test_override_shows_characters_backwards():
    assert bidi.imposed("ab1", "rtl") == "1ba"
    assert bidi.imposed("ab1", "ltr") == "ab1"


def test_first_strong_skips_isolates():
    assert bidi.auto_direction("⁨abc⁩ " + ALEF) == "rtl"
    assert bidi.auto_direction("12 abc") == "ltr"
    assert bidi.auto_direction("") == "ltr"


def test_only_the_first_paragraph_counts():
    assert bidi.visual(f"ab\n{ALEF}", "ltr") == "ab\n"
    assert bidi.auto_direction(f"12\n{ALEF}") == "ltr"


def test_isolating_needs_whole_characters():
    assert bidi.visual_isolating(ALEF, "rtl", 1, 1) is None
    assert bidi.visual_isolating(ALEF, "rtl", 0, 9) is None
    assert bidi.visual_isolating(f"{ALEF} ab 1", "rtl", 3, 2) is not None


def test_isolation_moves_a_trailing_number():
    text = f"{ALEF}: abc 12"
    start = text.encode().index(b"abc")
    assert bidi.visual_isolating(text, "rtl", start, 3) != bidi.visual(text, "rtl")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 .,(" + ")[]+-%" + "ابت٠َ" + "‎‏‪‫‬‭‮⁦⁧⁨⁩\t", max_size=24), st.sampled_from(["rtl", "ltr"]))
def test_order_is_a_permutation(text, base):
    assert sorted(bidi.visual(text, base)) == sorted(bidi.first_paragraph(text))
