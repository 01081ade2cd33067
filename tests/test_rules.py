"""Each rule on a situation and its silent twin, the report, and repairs as fixed points."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from warraq.operators import fonts, repair, report, rules
from warraq.operators.rules import RepairOptions
from warraq.plans.schema import UNITS

ARABIC, MIXED, LATIN = "مرحبا بالعالم", "إيرادات 2024 بلغت 15 مليون USD", "quarterly report"
UNSET = {"state": "unset", "value": None, "origin": None}
ALL = RepairOptions(complex_font="Amiri", convert_bullets=True, strip_tatweel=True, align=True)


def said(value):
    return {"state": "explicit", "value": value, "origin": None}


def given(value, part="styles", prop="p@x"):
    return {"state": "inherited", "value": value, "origin": {"part": part, "property": prop}}


def unit(text, kind="paragraph", spans=(), **props):
    clean = {"direction": UNSET, "alignment": UNSET, "inset": UNSET, "language": UNSET, "complex_font": UNSET, "latin_font": UNSET, "bullet": "none", "reversed": None}
    return {"doc_id": "d", "format": "pptx", "ord": 0, "unit_id": "u", "kind": kind, "text": text, "props": clean | props, "spans": list(spans), "location": {"part": "d", "paragraph": 1, "container": None}}


def span(text, run, bidi, direction=None):
    return {"offset": text.encode().index(run.encode()), "len": len(run.encode()), "bidi": bidi, "direction": direction, "origin": {"part": "d", "property": "span@"}}


def frame(spark, *units):
    return spark.createDataFrame([u | {"ord": k, "unit_id": f"u{k}"} for k, u in enumerate(units)], UNITS)


CLEAN = {"direction": said("rtl"), "alignment": said("start"), "language": said("ar-SA")}
LABEL = "الاسم: Ahmed Ali 12"
CASES = [
    ("bidi-control", [("error", unit("نص‏"))], [unit("نص‌ نص"), unit(LATIN)]),
    ("presentation-forms", [("error", unit("ﻣﺮﺣﺒﺎ")), ("warning", unit("ﷺ"))], [unit(ARABIC), unit("﻿﴾")]),
    ("tatweel-padding", [("warning", unit("كتـــاب")), ("warning", unit("كتـاب"))], [unit("هـ"), unit("هـَ"), unit("ـــ")]),
    ("bidi-override", [("error", unit(MIXED, spans=[span(MIXED, "15 مليون", "imposed", "rtl")])), ("warning", unit(ARABIC, spans=[span(ARABIC, "مرحبا", "imposed", "rtl")]))], [unit(MIXED, spans=[span(MIXED, "15 مليون", "isolated")]), unit(MIXED, spans=[span(MIXED, "15", "imposed", "rtl") | {"len": 999}])]),
    ("isolation-missing", [("warning", unit(LABEL, spans=[span(LABEL, "Ahmed Ali", "plain")], direction=said("rtl")))], [unit(LABEL, spans=[span(LABEL, "Ahmed Ali", "isolated")], direction=said("rtl")), unit(LABEL, spans=[span(LABEL, "12", "plain")], direction=said("rtl"))]),
    ("direction-mismatch", [("error", unit(MIXED, direction=said("ltr"))), ("error", unit("PPTX ملف العرض 3")), ("warning", unit(ARABIC, direction=said("ltr")))], [unit(MIXED, direction=said("rtl")), unit(ARABIC), unit(LATIN, direction=said("rtl"))]),
    ("direction-unset", [("warning", unit(ARABIC)), ("warning", unit(ARABIC, direction=given("ltr")))], [unit(ARABIC, direction=given("rtl")), unit(ARABIC, direction=said("ltr")), unit("PPTX ملف العرض 3")]),
    ("alignment-incoherent", [("warning", unit(ARABIC, alignment=said("left")))], [unit(ARABIC, alignment=said("right")), unit(ARABIC, alignment=given("left")), unit(LATIN, alignment=said("left"))]),
    ("inset-physical", [("warning", unit(ARABIC, inset=said("left"))), ("warning", unit(ARABIC, inset=given("left")))], [unit(ARABIC, inset=said("start")), unit(ARABIC), unit(LATIN, inset=said("left"))]),
    ("alignment-unset", [("note", unit(ARABIC)), ("note", unit(ARABIC, alignment=given("left")))], [unit(ARABIC, alignment=given("right")), unit(ARABIC, alignment=said("left"))]),
    ("container-direction", [("warning", unit(ARABIC, "table")), ("warning", unit(ARABIC, "columns", direction=said("ltr"))), ("warning", unit(LATIN + " و", "table", direction=said("rtl")))], [unit(ARABIC, "table", direction=said("rtl")), unit(LATIN + " و", "table"), unit(ARABIC), unit(LATIN, "table")]),
    ("order-reversed", [("warning", unit(ARABIC, "columns", reversed={"part": "d", "property": "x"}))], [unit(ARABIC, "columns"), unit(LATIN, "columns", reversed={"part": "d", "property": "x"})]),
    ("language-missing", [("warning", unit(ARABIC)), ("warning", unit(ARABIC, language=said("arn")))], [unit(ARABIC, language=said("AR")), unit(ARABIC, language=given("ar-EG")), unit(LATIN)]),
    ("complex-font-missing", [("warning", unit(ARABIC, latin_font=said("Calibri")))], [unit(ARABIC, latin_font=said("Calibri"), complex_font=given("Amiri")), unit(ARABIC)]),
    ("literal-bullet", [("warning", unit("• بند")), ("warning", unit("• item"))], [unit("•بند"), unit("• بند", bullet="native")]),
]


@pytest.mark.parametrize("rule,loud,silent", CASES, ids=[c[0] for c in CASES])
def test_rule(spark, rule, loud, silent):
    units = frame(spark, *(u for _, u in loud), *silent)
    found = rules.diagnostics(units, rules=[rule]).collect()
    assert sorted((r.ord, r.severity) for r in found) == [(k, s) for k, (s, _) in enumerate(loud)]


def test_one_pass_gives_what_single_rules_give(spark):
    units = frame(spark, *(u for _, loud, silent in CASES for u in [*(x for _, x in loud), *silent]))
    every = rules.diagnostics(units)
    single = None
    for r in [c[0] for c in CASES]:
        one = rules.diagnostics(units, rules=[r])
        single = one if single is None else single.unionByName(one)
    key = ["ord", "rule", "severity", "message", "fixable"]
    assert sorted(map(tuple, every.select(key).collect())) == sorted(map(tuple, single.select(key).collect()))


def test_clean_and_null_texts_are_silent(spark):
    assert rules.diagnostics(frame(spark, unit(ARABIC, **CLEAN), unit(None), unit(""), unit(LATIN))).collect() == []


def test_options_change_fixes_not_findings(spark):
    units = frame(spark, *(u for _, loud, _ in CASES for _, u in loud))
    key = ["ord", "rule", "severity", "message"]
    assert sorted(map(tuple, rules.diagnostics(units).select(key).collect())) == sorted(map(tuple, rules.diagnostics(units, ALL).select(key).collect()))


def test_report_counts_and_verdict(spark):
    units = frame(spark, unit(ARABIC), unit(MIXED, **CLEAN), unit(LATIN), unit("كتـــاب", "table", direction=said("rtl")))
    found = rules.diagnostics(units)
    r = report.report(units, found, strict=False).first()
    assert (r.units_scanned, r.arabic_units, r.mixed_units) == (4, 3, 1) and r.errors == 0 and not r.blocking
    assert report.report(units, found, strict=True).first().blocking
    order = [(x.severity_rank, x.rule) for x in report.ordered(found).collect()]
    assert order == sorted(order, key=lambda x: (-x[0], x[1]))
    body = json.loads(report.as_json(report.report(units, found), found).first().json)
    assert body["summary"]["units_scanned"] == 4 and len(body["diagnostics"]) == found.count() and body["fonts"] == {"checked": False}
    assert report.as_text(report.report(units, found), found).first().text.endswith("PASS")
    assert report.golden('{"b": 1, "a": 2}') == '{\n  "a": 2,\n  "b": 1\n}\n'


def test_repairs_are_fixed_points(spark):
    units = frame(spark, *(u for _, loud, silent in CASES for u in [*(x for _, x in loud), *silent])).cache()
    once = repair.apply(units, repair.plan(units, ALL)).cache()
    left = {r.rule for r in rules.diagnostics(once, ALL).where("fixable").collect()}
    again = repair.apply(once, repair.plan(once, ALL))
    # a changed text may newly need a direction; the second round settles all
    assert left <= {"direction-mismatch", "direction-unset", "language-missing", "alignment-unset"}
    assert rules.diagnostics(again, ALL).where("fixable").count() == 0
    assert sorted(r.text for r in again.collect()) == sorted(r.text for r in repair.apply(again, repair.plan(again, ALL)).collect())


def test_capabilities_split_a_plan(spark):
    units = frame(spark, unit("• بند"), unit(ARABIC)).withColumn("format", F.lit("xlsx"))
    plan = repair.plan(units, ALL)
    able, unable = repair.partition(plan, units, repair.capabilities(spark))
    assert able.count() + unable.count() == plan.count()
    assert {r.fix.kind for r in unable.collect()} == {"ConvertLiteralBullet", "SetLanguage"}


def faces(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, face int, families array<string>, subfamily string, regular boolean, covered array<string>, shapes array<struct<ch:string,feature:string>>, readable boolean")


def test_font_rules(spark):
    letters = "".join(sorted(set(ARABIC.replace(" ", ""))))
    shapes = [(c, f) for c in letters for f in ("init", "medi", "fina")]
    f = faces(spark, ("full", 0, ["Full"], "Regular", True, list(letters), shapes, True), ("part", 0, ["Part"], "Regular", True, list(letters[1:]), shapes, True), ("flat", 0, ["Flat"], "Regular", True, list(letters), [], True), ("odd", 0, ["Odd"], "Regular", True, list(letters), [], False), ("none", 0, ["None"], "Regular", True, ["x"], [], True))
    units = frame(spark, *(unit(ARABIC, complex_font=said(n)) for n in (" full ", "Part", "Flat", "Odd", "None", "Missing")), unit(LATIN, complex_font=said("None")))
    got = sorted((r.ord, r.rule, r.severity) for r in fonts.diagnostics(units, f).collect())
    assert got == [(1, "font-coverage", "warning"), (2, "shaping-broken", "error"), (4, "font-coverage", "error")]
    counts = {r.unit_id: (r.required, r.observable, r.produced) for r in fonts.shaping_counts(units, f).collect()}
    assert counts["u0"][0] == counts["u0"][2] and counts["u2"][2] == 0 and "u5" not in counts


def test_rule_listing(spark):
    assert rules.listing(spark).count() == 17
