"""Verbs and exit codes."""

from __future__ import annotations

import json

import pytest

from warraq.__main__ import main
from warraq.engine import Engine
from warraq.plans import packages as pk

ARABIC = "إيرادات 2024 بلغت 15 مليون USD"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "bad.docx").write_bytes(pk.docx(pk.word_paragraph(ARABIC, "ltr")))
    (tmp_path / "clean.html").write_text(f'<html lang="ar" dir="rtl"><body><p dir="rtl" style="text-align:start">{ARABIC}', encoding="utf-8")
    (tmp_path / "broken.xlsx").write_bytes(b"?")
    return tmp_path


def test_audit(spark, folder, capsys):
    assert main(["audit", str(folder / "bad.docx"), "--format", "json"]) == 1
    body = json.loads(capsys.readouterr().out)
    assert body["summary"]["errors"] == 1 and body["blocking"] and body["diagnostics"][0]["rule"] == "direction-mismatch"
    assert main(["audit", str(folder / "clean.html")]) == 0 and capsys.readouterr().out.strip().endswith("PASS")
    assert main(["audit", str(folder / "broken.xlsx")]) == 3
    assert main(["audit", str(folder / "missing.docx")]) == 3
    assert main(["audit", str(folder / "x.odt")]) == 2
    assert main([]) == 2


def test_repair(spark, folder, capsys):
    source, target = str(folder / "bad.docx"), str(folder / "good.docx")
    assert main(["repair", source, target, "--align", "--font", "Amiri", "--format", "json"]) == 0
    body = json.loads(capsys.readouterr().out)
    assert body["before"]["errors"] == 1 and body["after"]["errors"] == body["after"]["warnings"] == 0 and body["repairs"]["applied"]
    assert main(["repair", source, target]) == 2
    assert main(["repair", source, target, "--force", "--align"]) == 0
    assert main(["repair", source, source, "--force"]) == 2
    assert main(["repair", source, str(folder / "x.pptx")]) == 2
    assert main(["repair", source, str(folder / "y.docx"), "--lang", "en"]) == 2


def test_explain_and_rules(spark, capsys):
    assert main(["explain", ARABIC, "--format", "json"]) == 0
    body = json.loads(capsys.readouterr().out)
    assert body["dominant_direction"] == body["auto_direction"] == "rtl" and body["order_differs"]
    assert main(["explain", "abc"]) == 0 and "changes nothing" in capsys.readouterr().out
    assert main(["rules", "--format", "json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 17


def test_engine_choices(spark):
    assert len(Engine().rules) == 17 and Engine().from_rules("bidi-control").rules == ("bidi-control",)
    with pytest.raises(ValueError):
        Engine().from_rules("nothing")
