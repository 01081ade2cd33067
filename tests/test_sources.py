"""Readers and writers on files made here."""

from __future__ import annotations

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from warraq.operators import repair, rules
from warraq.operators.rules import RepairOptions
from warraq.plans import packages as pk
from warraq.sources import css, documents, fonts, html, ooxml, pdf, rewrite

ARABIC, MIXED = "مرحبا بالعالم", "إيرادات 2024 بلغت 15 مليون USD"


def values(u):
    return {k: (v["value"], v["state"]) for k, v in u["props"].items() if isinstance(v, dict) and v.get("value")}


# ---- web pages ----


def page(source, **linked):
    return html.Page("page.html", source, linked)


def test_page_paragraphs_and_inheritance():
    p = page("<html lang=ar dir=rtl><title>T</title><body><p>a  b<br>c</p><div style='text-align:left'>x<p>y</div><script>no</script>")
    assert [(u["text"], u["location"]["container"]) for u in p.units] == [("T", "title"), ("a b c", "p"), ("x", "div"), ("y", "p")]
    assert values(p.units[1])["direction"] == ("rtl", "inherited") and values(p.units[2])["alignment"] == ("left", "explicit")
    assert values(p.units[3])["alignment"] == ("left", "inherited") and p.units[3]["props"]["alignment"]["origin"]["property"] == "div@"


def test_author_sheets_are_inherited_and_cited():
    p = page("<style>@media print{p{direction:ltr}} .a>p, p.b{direction:rtl;margin-left:2px} p{direction:ltr!important}</style><div class=a><p>x</div><p class=b>y")
    assert [values(u).get("direction") for u in p.units] == [("ltr", "inherited")] * 2
    assert p.units[0]["props"]["direction"]["origin"]["property"] == "p{direction}"
    assert p.units[0]["props"]["inset"]["origin"]["property"] == ".a>p{margin-left}"


def test_tables_columns_and_reversal():
    p = page("<table dir=ltr><tr><td>a<td>b<tr><td><p>c</table><div style='display:flex;flex-flow:row-reverse'><p>1<p>2</div><div style='columns:2'>z</div>")
    kinds = [(u["kind"], u["text"]) for u in p.units]
    assert ("table", "a\nb\nc") in kinds and ("columns", "1\n2") in kinds and ("columns", "z") in kinds
    assert [u["location"]["container"] for u in p.units][:3] == ["table 1 row 1 cell 1", "table 1 row 1 cell 2", "table 1 row 2 cell 1"]
    assert next(u for u in p.units if u["text"] == "1\n2")["props"]["reversed"] == {"part": "page.html", "property": "div@"}


def test_spans_are_byte_ranges():
    p = page(f"<p>{ARABIC} <bdi>ab</bdi> <bdo dir=rtl>é1</bdo> <b>z</b>")
    u = p.units[0]
    cut = [(u["text"].encode()[s["offset"] : s["offset"] + s["len"]].decode(), s["bidi"], s["direction"]) for s in u["spans"]]
    assert cut == [("ab", "isolated", None), ("é1", "imposed", "rtl"), ("z", "plain", None)]


def test_preformatted_text_keeps_its_space():
    u = page("<pre>\n  a <i>b</i>\n\n</pre>").units[0]
    assert u["text"] == "  a b" and u["spans"][0]["offset"] == 4


def test_auto_direction_resets():
    assert "direction" not in values(page("<body dir=rtl><p dir=auto>x").units[0])


def test_sheets_that_are_not_read():
    p = page("<link rel=stylesheet href='https://x/a.css'><link rel='alternate stylesheet' href='/b.css'><link rel=stylesheet href='c.css?v=1'><link rel=stylesheet href='d.css'><p>x", **{"c.css": "p{direction:rtl}"})
    assert p.unread == ["https://x/a.css", "/b.css", "d.css"] and values(p.units[0])["direction"] == ("rtl", "inherited")


def test_lists():
    p = page("<ul><li>a<li style='list-style:none'>b</ul>")
    assert [u["props"]["bullet"] for u in p.units] == ["native", "suppressed"]


@pytest.mark.parametrize("text,ok", [("p", True), ("*", True), ("a#b.c[d][e='f']", True), (":root > body p", True), ("p:hover", False), ("a + b", False), ("a ~ b", False), ("p::before", False), ("", False), ("> p", False)])
def test_selectors(text, ok):
    assert (css.selector(text) is not None) == ok


def test_a_bad_selector_drops_alone():
    rules_ = css.sheet("a:hover, p { color: red; /* x:y; */ margin : 0 !important } @import 'x'; b{c:d}")
    assert [[s.text for s in chosen] for chosen, _ in rules_] == [["p"], ["b"]]
    assert rules_[0][1] == [("color", "red", False), ("margin", "0", True)]


# ---- office files ----

STYLES = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:cs="Base"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:pPr><w:jc w:val="left"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/><w:pPr><w:bidi/></w:pPr></w:style>'
BULLETS = '<w:abstractNum w:abstractNumId="1"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="2"><w:lvl><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="7"><w:abstractNumId w:val="2"/></w:num>'


def test_word_styles_and_revisions():
    body = f'<w:p><w:pPr><w:pStyle w:val="A"/><w:pPrChange><w:pPr><w:bidi w:val="0"/></w:pPr></w:pPrChange></w:pPr><w:r><w:t>{ARABIC}</w:t></w:r></w:p><w:p/><w:tbl><w:tblPr><w:bidiVisual/></w:tblPr><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl><w:sectPr><w:bidi/></w:sectPr>'
    units, _ = ooxml.read(pk.docx(body, STYLES), "docx")
    assert [(u["unit_id"].split("#")[1], u["text"]) for u in units] == [("p1", ARABIC), ("p3", "x"), ("p4", "y"), ("tbl2", "y"), ("tbl1", "x\ny")]
    assert values(units[0]) == {"direction": ("rtl", "inherited"), "complex_font": ("Base", "inherited")}
    assert values(units[1])["alignment"] == ("start", "inherited") and values(units[4])["direction"] == ("rtl", "explicit")


def test_slides():
    units, _ = ooxml.read(pk.pptx([pk.slide_body([(ARABIC, "rtl"), (" ", None), ("x", None)], ' numCol="2" rtlCol="1"')]), "pptx")
    assert [(u["unit_id"].split("#")[1], u["kind"]) for u in units] == [("p1", "paragraph"), ("p3", "paragraph"), ("cols1", "columns")]
    assert values(units[1])["direction"] == ("rtl", "inherited") and units[2]["text"] == f"{ARABIC}\nx"


def test_charts():
    c = "http://schemas.openxmlformats.org/drawingml/2006/chart"
    cache = lambda *v: "<c:strRef><c:strCache>" + "".join(f'<c:pt idx="{k}"><c:v>{x}</c:v></c:pt>' for k, x in enumerate(v)) + "</c:strCache></c:strRef>"
    xml = f'<c:chartSpace xmlns:c="{c}" xmlns:a="{pk.DRAWING}"><c:chart><c:plotArea><c:barChart><c:ser><c:tx>{cache("مبيعات")}</c:tx><c:cat>{cache("أ", "ب", "أ")}</c:cat></c:ser><c:dLbls><c:showCatName val="0"/><c:showSerName val="1"/></c:dLbls><c:axId val="1"/></c:barChart><c:catAx><c:axId val="1"/></c:catAx></c:plotArea><c:legend/></c:chart></c:chartSpace>'
    units, _ = ooxml.read(pk.pptx([], {"ppt/charts/chart1.xml": xml}), "pptx")
    assert {u["unit_id"].split("#")[1]: u["text"] for u in units} == {"catax1": "أ\nب", "legend1": "مبيعات", "dlbls1": "مبيعات"}


def test_sheets():
    styles = '<fonts><font><name val="Calibri"/></font></fonts><cellStyleXfs><xf fontId="0"/></cellStyleXfs><cellXfs><xf xfId="0"/></cellXfs>'
    units, unread = ooxml.read(pk.xlsx([[ARABIC, "b"], ["c", "b"]], True, styles), "xlsx")
    assert [(u["unit_id"].split("#")[1], u["text"]) for u in units] == [("c1", ARABIC), ("c2", "b"), ("c3", "c"), ("c4", "b"), ("grid1", f"{ARABIC}\nb\nc\nb")]
    assert values(units[0]) == {"complex_font": ("Calibri", "inherited"), "latin_font": ("Calibri", "inherited")} and values(units[4])["direction"] == ("rtl", "explicit") and unread == []


@pytest.mark.parametrize("data", [b"", b"no zip", pk.container({})[:40]])
def test_what_is_no_package(data):
    with pytest.raises(ooxml.FormatError):
        ooxml.read(data, "docx")


FULL = RepairOptions(complex_font="Amiri", convert_bullets=True, strip_tatweel=True, align=True)


@pytest.mark.parametrize("fmt,data", [
    ("docx", pk.docx(pk.word_paragraph("• كتـــاب ﻻ‏ " + MIXED, "ltr") + pk.word_paragraph(ARABIC), STYLES, BULLETS)),
    ("pptx", pk.pptx([pk.slide_body([("• كتـــاب ﻻ‏ " + MIXED, "ltr"), (ARABIC, None)], ' numCol="2"')])),
    ("xlsx", pk.xlsx([["كتـــاب ﻻ‏ " + MIXED, "b"], [ARABIC, "c"]])),
])
def test_repairing_files(spark, fmt, data):
    found = spark.createDataFrame([("f", fmt, bytearray(data))], "path string, format string, content binary")
    units = documents.units(documents.scan(found)).cache()
    plan = repair.partition(repair.plan(units, FULL), units, repair.capabilities(spark))[0].cache()
    assert plan.count() > 3
    out = rewrite.rewrite_all(found, units, plan).cache()
    row = out.first()
    assert row.refused is None and row.applied == plan.count()
    new = documents.units(documents.scan(out)).cache()
    left = {r.rule for r in repair.partition(rules.diagnostics(new, FULL).where("fix is not null").select("doc_id", "unit_id", "fix", "rule"), new, repair.capabilities(spark))[0].collect()}
    assert not left & {"bidi-control", "presentation-forms", "tatweel-padding", "literal-bullet", "container-direction"}
    before, after = zipfile.ZipFile(io.BytesIO(data)), zipfile.ZipFile(io.BytesIO(row.content))
    assert before.namelist() == after.namelist()
    assert all(before.read(n) == after.read(n) for n in before.namelist() if not n.endswith(("document.xml", "slide1.xml", "sheet1.xml", "styles.xml", "sharedStrings.xml")))


def test_refusals(spark):
    fix = {"kind": "SetDirection", "value": "rtl", "offsets": None}
    with pytest.raises(rewrite.Refused):
        rewrite.rewrite(pk.docx(""), "docx", [{"unit_id": "word/none.xml#p1", "fix": fix}])
    with pytest.raises(rewrite.Refused):
        rewrite.rewrite(pk.docx(""), "docx", [{"unit_id": "word/document.xml#p9", "fix": fix}])
    for args in (("a.docx", "a.docx", False), ("a.docx", "b.pptx", False), ("a.html", "b.html", False), ("a.docx", "b.docx", True)):
        with pytest.raises(rewrite.Refused):
            rewrite.guard(*args)
    rewrite.guard("a.docx", "b.docx", True, force=True)


def test_scanning_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.DOCX").write_bytes(pk.docx(pk.word_paragraph(ARABIC)))
    (tmp_path / "b.htm").write_text(pk.html(ARABIC), encoding="utf-8")
    (tmp_path / "bad.html").write_bytes(b"\xff\xfe")
    (tmp_path / "bad.xlsx").write_bytes(b"?")
    (tmp_path / "skip.odt").write_bytes(b"?")
    scanned = documents.scan(documents.files(spark, str(tmp_path))).cache()
    assert documents.units(scanned).count() == 2
    assert {r.doc_id.rsplit("/", 1)[-1] for r in documents.errors(scanned).collect()} == {"bad.html", "bad.xlsx"}


# ---- fonts and PDF ----


def test_fonts(spark, tmp_path):
    (tmp_path / "a.ttf").write_bytes(pk.font("Alpha", "ابت", {"init": "ب", "fina": "بت"}))
    (tmp_path / "b.otf").write_bytes(b"nothing")
    r = fonts.scan(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].families == ["Alpha"] and r[0].regular and sorted(r[0].covered) == sorted("ابت") and r[0].readable
    assert {(s.ch, s.feature) for s in r[0].shapes} == {("ب", "init"), ("ب", "fina"), ("ت", "fina")}


GOOD = pk.pdf([b"BT (one) Tj ET", b"two"])


def test_pdf_pages():
    p = pdf.Pdf(GOOD)
    assert [p.content(x) for x in p.pages()] == [b"BT (one) Tj ET", b"two"] and p.pages()[0]["MediaBox"] == [0, 0, 100, 100]
    assert p.version == "1.7" and p.reconstructed is None and p.unread == []


def test_pdf_recovery_and_refusals():
    damaged = pdf.Pdf(GOOD.replace(b"startxref", b"startxxxx"))
    assert damaged.reconstructed and [damaged.content(x) for x in damaged.pages()] == [b"BT (one) Tj ET", b"two"]
    with pytest.raises(pdf.Encrypted):
        pdf.Pdf(GOOD.replace(b"/Size", b"/Encrypt<</V 5>>/Size"))
    for bad in (b"", b"nothing", b"%PDF-1.4 nothing"):
        with pytest.raises(pdf.BadPdf):
            pdf.Pdf(bad)


def test_pdf_object_streams():
    inner = b"1 0 2 30 <</Type/Catalog/Pages 2 0 R>>   <</Type/Pages/Kids[]/Count 0>>"
    first = inner.index(b"<<")
    body = inner[:first] + inner[first:].ljust(60)
    offsets = [0, inner.index(b"<</Type/Pages") - first]
    head = f"1 {offsets[0]} 2 {offsets[1]} ".encode()
    raw = zlib.compress(head + inner[first:])
    del body
    out = b"%PDF-1.5\n"
    at3 = len(out)
    out += b"3 0 obj\n<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(head), len(raw)) + raw + b"\nendstream\nendobj\n"
    at4 = len(out)
    rows = b"".join(bytes(r) for r in ([0, 0, 0, 0], [2, 0, 3, 0], [2, 0, 3, 1], [1, at3 >> 8, at3 & 255, 0], [1, at4 >> 8, at4 & 255, 0]))
    out += b"4 0 obj\n<</Type/XRef/Size 5/W[1 2 1]/Root 1 0 R/Length %d>>\nstream\n" % len(rows) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at4
    p = pdf.Pdf(out)
    assert p.reconstructed is None and p.resolve(pdf.Ref(1))["Type"] == pdf.Name("Catalog") and p.resolve(pdf.Ref(2))["Count"] == 0


@pytest.mark.parametrize("name,data,want", [
    ("FlateDecode", zlib.compress(b"abc"), b"abc"), ("Fl", zlib.compress(b"abc")[2:-4], b"abc"), ("ASCIIHexDecode", b"61 62 6>", b"ab`"), ("ASCII85Decode", b'87cURD]i,"Ebo80~>', b"Hello World!"),
    ("RunLengthDecode", bytes([2, 97, 98, 99, 254, 100, 128]), b"abcddd"), ("LZWDecode", bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), b"-----A---B"), ("Identity", b"x", b"x"),
])
def test_filters(name, data, want):
    assert pdf.decoded(pdf.Stream({"Filter": pdf.Name(name)}, data)) == want


def test_filters_that_stop():
    for name in ("DCTDecode", "Crypt", "Unknown"):
        with pytest.raises(pdf.Stopped):
            pdf.decoded(pdf.Stream({"Filter": [pdf.Name(name)]}, b""))


def test_predictors():
    rows = bytes([1, 1, 1, 1, 2, 1, 1, 1])
    d = {"Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 3}}
    assert pdf.decoded(pdf.Stream(d, zlib.compress(rows))) == bytes([1, 2, 3, 2, 3, 4])


def test_lexer():
    v = pdf.Lexer(b"<</A#42 [1 -2.5 (a\\(b\\051\\n(c)) <4a4> true null 3 0 R]%x\n/C/D>>").value()
    assert v == {"AB": [1, -2.5, b"a(b)\n(c)", b"J@", True, None, pdf.Ref(3, 0)], "C": pdf.Name("D")}


def test_streaming_audit(spark, tmp_path):
    from warraq.plans.units import units_from_text
    from warraq.streaming import audit

    spark.createDataFrame([("1", "نص‏"), ("2", "plain")], "id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in"))
    q = audit.audit_stream(units_from_text(stream, "id", "text"), rule_ids=["bidi-control"]).select("doc_id", "rule").writeStream.format("memory").queryName("found").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("found").collect()] == [("1", "bidi-control")]
    events = spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:40:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k")
    assert sorted(r.events for r in audit.tumbling_counts(events, "ts", "k", "1 hour", None).collect()) == [1, 2]
    assert sorted(r.events for r in audit.session_counts(events, "ts", "k", "30 minutes", None).collect()) == [1, 2]
