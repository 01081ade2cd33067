"""Small office, PDF and font files made from rows, as inputs for queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"
SLIDES = "http://schemas.openxmlformats.org/presentationml/2006/main"
SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def container(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in {"[Content_Types].xml": "<Types/>", **parts}.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def relations(*rows: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="{i}" Type="{RELATIONS}/{kind}" Target="{target}"/>' for i, kind, target in rows) + "</Relationships>"


def docx(body: str, styles: str = "", numbering: str = "") -> bytes:
    parts = {"_rels/.rels": relations(("r1", "officeDocument", "word/document.xml")), "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'}
    rels = []
    if styles:
        parts["word/styles.xml"] = f'<w:styles xmlns:w="{WORD}">{styles}</w:styles>'
        rels.append(("r1", "styles", "styles.xml"))
    if numbering:
        parts["word/numbering.xml"] = f'<w:numbering xmlns:w="{WORD}">{numbering}</w:numbering>'
        rels.append(("r2", "numbering", "numbering.xml"))
    return container(parts | {"word/_rels/document.xml.rels": relations(*rels)})


def word_paragraph(text: str, direction: str | None = None) -> str:
    bidi = "" if direction is None else f'<w:pPr><w:bidi w:val="{int(direction == "rtl")}"/></w:pPr>'
    return f'<w:p>{bidi}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def pptx(slides: list[str], more: dict[str, str] | None = None) -> bytes:
    parts = {"_rels/.rels": relations(("r1", "officeDocument", "ppt/presentation.xml")), "ppt/presentation.xml": f'<p:presentation xmlns:p="{SLIDES}"/>'}
    for k, body in enumerate(slides, start=1):
        parts[f"ppt/slides/slide{k}.xml"] = f'<p:sld xmlns:p="{SLIDES}" xmlns:a="{DRAWING}">{body}</p:sld>'
    return container(parts | (more or {}))


def slide_body(paragraphs: list[tuple[str, str | None]], body: str = "") -> str:
    inner = "".join("<a:p>" + ("" if d is None else f'<a:pPr rtl="{int(d == "rtl")}"/>') + f"<a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t, d in paragraphs)
    return f"<p:sp><p:txBody><a:bodyPr{body}/>{inner}</p:txBody></p:sp>"


def xlsx(rows: list[list[str]], rtl: bool | None = None, styles: str = "") -> bytes:
    strings = list(dict.fromkeys(t for r in rows for t in r))
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + c)}{n}" t="s"><v>{strings.index(t)}</v></c>' for c, t in enumerate(r)) + "</row>" for n, r in enumerate(rows, start=1))
    view = "" if rtl is None else f' rightToLeft="{int(rtl)}"'
    styles = styles or "<cellXfs><xf/></cellXfs>"
    return container({
        "_rels/.rels": relations(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "sharedStrings", "sharedStrings.xml"), ("r3", "styles", "styles.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{SHEETS}" xmlns:r="{RELATIONS}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEETS}" count="{len(strings)}" uniqueCount="{len(strings)}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in strings) + "</sst>",
        "xl/styles.xml": f'<styleSheet xmlns="{SHEETS}">{styles}</styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEETS}"><sheetViews><sheetView{view}/></sheetViews><sheetData>{cells}</sheetData></worksheet>',
    })


def html(text: str, direction: str | None = None) -> str:
    attribute = "" if direction is None else f" dir={quoteattr(direction)}"
    return f'<!DOCTYPE html><html lang="ar"><body><p{attribute}>{escape(text)}</p></body></html>'


def pdf(contents: list[bytes]) -> bytes:
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(contents)))
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: f"<</Type/Pages/Kids[{kids}]/Count {len(contents)}/MediaBox[0 0 100 100]>>".encode(), 3: b"null"}
    for k, c in enumerate(contents):
        raw = zlib.compress(c)
        objects[4 + 2 * k] = f"<</Type/Page/Parent 2 0 R/Contents {5 + 2 * k} 0 R>>".encode()
        objects[5 + 2 * k] = f"<</Length {len(raw)}/Filter/FlateDecode>>\nstream\n".encode() + raw + b"\nendstream"
    out, at = b"%PDF-1.7\n", {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"".join(b"%010d 00000 n \n" % at[n] for n in sorted(at))
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + table + b"trailer\n<</Root 1 0 R/Size %d>>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, len(out))


def font(family: str, letters: str, features: dict[str, str] | None = None, subfamily: str = "Regular") -> bytes:
    """A font file with names, a character map, and joining features that replace the named letters singly."""
    glyph = {c: k for k, c in enumerate(sorted(letters), start=1)}
    text = [(1, family), (2, subfamily)]
    raw = [s.encode("utf-16-be") for _, s in text]
    name = struct.pack(">3H", 0, len(text), 6 + 12 * len(text)) + b"".join(struct.pack(">6H", 3, 1, 0x409, i, len(r), sum(map(len, raw[:k]))) for k, ((i, _), r) in enumerate(zip(text, raw, strict=True))) + b"".join(raw)
    groups = b"".join(struct.pack(">3I", ord(c), ord(c), g) for c, g in glyph.items())
    cmap = struct.pack(">2H", 0, 1) + struct.pack(">2HI", 3, 10, 12) + struct.pack(">2H3I", 12, 0, 16 + len(groups), 0, len(glyph)) + groups
    tables = {b"cmap": cmap, b"name": name}
    if features:
        lookups, records, heads = [], [], []
        for k, (f, own) in enumerate(features.items()):
            gids = sorted(glyph[c] for c in own)
            coverage = struct.pack(">2H", 1, len(gids)) + b"".join(struct.pack(">H", g) for g in gids)
            lookups.append(struct.pack(">4H", 1, 0, 1, 8) + struct.pack(">2Hh", 1, 6, 500) + coverage)
            records.append(f.encode())
            heads.append(struct.pack(">3H", 0, 1, k))
        n = len(records)
        feature_list, at = struct.pack(">H", n), 2 + 6 * n
        for r, h in zip(records, heads, strict=True):
            feature_list += r + struct.pack(">H", at)
            at += len(h)
        feature_list += b"".join(heads)
        lookup_list, at = struct.pack(">H", n), 2 + 2 * n
        for x in lookups:
            lookup_list += struct.pack(">H", at)
            at += len(x)
        lookup_list += b"".join(lookups)
        tables[b"GSUB"] = struct.pack(">2H3H", 1, 0, 10, 10, 10 + len(feature_list)) + feature_list + lookup_list
    out, at = struct.pack(">4s4H", b"\0\1\0\0", len(tables), 0, 0, 0), 12 + 16 * len(tables)
    body = b""
    for t, data in sorted(tables.items()):
        out += struct.pack(">4s3I", t, 0, at + len(body), len(data))
        body += data
    return out + body
