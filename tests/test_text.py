"""Native functions against plain Python."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from warraq.functions import attributes as a
from warraq.functions import text as t
from warraq.functions import unicode as u
from warraq.operators import windows
from warraq.plans.units import PHRASES

TEXTS = [*PHRASES, "", "ـ", "بـــ", "ـــب", "ب ـــ ب", "بـب", "بــَ", "بَــب", "ݐا", "ﻻﻻ ﷺ", "x" * 50]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS)], "unit_id int, text string")


def column(rows, c):
    return [r[0] for r in rows.orderBy("unit_id").select(c).collect()]


def test_normalised_forms(rows):
    want = ["".join(u.PRESENTATION.get(c, c) for c in x) for x in TEXTS]
    assert column(rows, t.normalize_presentation_forms(F.col("text"))) == want


def test_presentation_table_is_compatibility_of_single_characters():
    assert u.PRESENTATION["ﻻ"] == "لا"
    assert "ﷺ" not in u.PRESENTATION and "﴾" not in u.PRESENTATION and "﻿" not in u.PRESENTATION
    assert all(unicodedata.normalize("NFKC", k) == v for k, v in u.PRESENTATION.items())


def test_normalising_twice_changes_nothing(rows):
    once = t.normalize_presentation_forms(F.col("text"))
    assert column(rows, once) == column(rows, t.normalize_presentation_forms(once))


def python_types(text):
    table = u.joining_table()
    unstated = [(0x700, 0x74F), (0x750, 0x77F), (0x860, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]
    return "".join(table.get(c) or ("C" if c == "‍" else "X" if any(lo <= ord(c) <= hi for lo, hi in unstated) else "U") for c in text)


def test_joining_types(rows):
    assert column(rows, t.joining_types(F.col("text"))) == [python_types(x) for x in TEXTS]


def python_runs(text):
    types, out, i = python_types(text), [], 0
    while i < len(text):
        if types[i] != "K":
            i += 1
            continue
        j = i
        while j < len(text) and types[j] == "K":
            j += 1
        before = next((k for k in reversed(types[:i]) if k != "T"), "")
        after = types[j : j + 1]
        n, gives, takes = j - i, before != "" and before in "DLCK", after != "" and after in "DRCK"
        verdict = "carrier" if after == "T" else ("stretched" if gives or takes else "standalone") if n >= 2 else "wedged" if gives and takes else "displayed"
        out.append((len(text[:i].encode()), n, verdict))
        i = j
    return out


def test_tatweel_runs_as_columns_and_as_windows(rows):
    want = [python_runs(x) for x in TEXTS]
    assert [[tuple(r) for r in x] for x in column(rows, t.tatweel_runs(F.col("text")))] == want
    found = windows.tatweel_runs(windows.characters(rows)).collect()
    assert sorted((r.unit_id, r.offset, r.length, r.verdict) for r in found) == sorted((k, *r) for k, x in enumerate(want) for r in x)


def test_forms_as_columns_and_as_windows(rows):
    columns = {(k, r["offset"], r["ch"], r["form"]) for k, x in enumerate(column(rows, t.joining_forms(F.col("text")))) for r in x}
    assert columns == {(r.unit_id, r.offset, r.ch, r.form) for r in windows.joining_forms(windows.characters(rows)).collect()}
    by = {r["ch"]: r["form"] for r in column(rows.where("unit_id = 0"), t.joining_forms(F.lit("بيت")))[0]}
    assert by == {"ب": "initial", "ي": "medial", "ت": "final"}


def test_runs_split_no_join(rows):
    columns = {(k, r["offset"], r["run"]) for k, x in enumerate(column(rows, t.arabic_runs(F.col("text")))) for r in x}
    assert columns == {(r.unit_id, r.offset, r.run) for r in windows.arabic_runs(windows.characters(rows)).collect()}


def test_controls_are_listed_and_stripped(rows):
    got = column(rows, t.controls(F.col("text")))
    for x, hits in zip(TEXTS, got, strict=True):
        assert [h["name"] for h in hits] == [u.CONTROL_NAMES[c] for c in x if c in u.CONTROL_NAMES]
        assert all(x.encode()[h["offset"] :].decode()[0] in u.CONTROL_NAMES for h in hits)
    assert column(rows, t.strip_controls(F.col("text"))) == ["".join(c for c in x if c not in u.CONTROL_NAMES) for x in TEXTS]
    assert "‌" not in u.CONTROL_NAMES and "‍" not in u.CONTROL_NAMES


def test_deleting_offsets(rows):
    offsets = F.transform(t.controls(F.col("text")), lambda h: h["offset"])
    assert column(rows, t.delete_at(F.col("text"), offsets)) == column(rows, t.strip_controls(F.col("text")))


@pytest.mark.parametrize("tag,arabic", [("ar", True), ("AR", True), ("ar-Arab-EG", True), ("ar-", True), ("arn", False), ("ar_SA", False), ("en-US", False), (None, False)])
def test_arabic_tags(spark, tag, arabic):
    assert spark.range(1).select(t.is_arabic_tag(F.lit(tag).cast("string"))).first()[0] is arabic


@pytest.mark.parametrize("text,marker", [("• x", "•"), ("  ▪ x", "▪"), ("•x", None), ("•", None), ("x • y", None), (" • x", "•")])
def test_markers(spark, text, marker):
    assert spark.range(1).select(t.leading_marker(F.lit(text))).first()[0] == marker


@pytest.mark.parametrize("text,offset,length,part", [("اب", 0, 2, "ا"), ("اب", 1, 2, None), ("اب", 0, 3, None), ("ab", 1, 1, "b"), ("ab", 1, 5, None), ("ab", 2, 0, "")])
def test_span_text(spark, text, offset, length, part):
    assert spark.range(1).select(t.span_text(F.lit(text), F.lit(offset), F.lit(length))).first()[0] == part


@pytest.mark.parametrize("reference,column_no", [("A1", 0), ("Z9", 25), ("AA1", 26), ("ab3", 27), ("12", None), ("", None)])
def test_column_of(spark, reference, column_no):
    assert spark.range(1).select(t.column_of(F.lit(reference))).first()[0] == column_no


def test_attributes(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(a.inset(F.lit("12px"), F.lit("0"), F.lit(None), F.lit("3em"))) == "left"
    assert value(a.inset(F.lit("1"), F.lit("2"), F.lit("1"), F.lit("0"))) == "start"
    assert value(a.column_count(F.lit(None), F.lit("12em 3"))) == 3
    assert value(a.first_family(F.lit("'Amiri', serif"))) == "Amiri"
    assert value(a.theme_reference(F.lit("+mn-cs"))).asDict() == {"font": "minor", "script": "cs"}
    assert value(a.rels_part(F.lit("word/document.xml"))) == "word/_rels/document.xml.rels"
    assert value(a.rels_source(F.lit("word/_rels/document.xml.rels"))) == "word/document.xml"
