"""Office packages to text units: word-processing, presentation and spreadsheet files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

from ..functions.attributes import ALIGNMENT

# Namespaces, transitional and strict, by the prefix used here.
NAMESPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w", "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a", "http://purl.oclc.org/ooxml/drawingml/main": "a",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p", "http://purl.oclc.org/ooxml/presentationml/main": "p",
    "http://schemas.openxmlformats.org/spreadsheetml/2006/main": "x", "http://purl.oclc.org/ooxml/spreadsheetml/main": "x",
    "http://schemas.openxmlformats.org/drawingml/2006/chart": "c", "http://purl.oclc.org/ooxml/drawingml/chart": "c",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r", "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/package/2006/relationships": "rel", "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "http://purl.org/dc/elements/1.1/": "dc",
}
REVISIONS = frozenset("w:pPrChange w:rPrChange w:sectPrChange w:tblPrChange w:tblPrExChange w:tcPrChange w:trPrChange".split())
ON = ("1", "true", "on")
UNSET = {"state": "unset", "value": None, "origin": None}
NAMES = ("direction", "alignment", "inset", "language", "complex_font", "latin_font")
ARABIC = re.compile("[\u0620-\u064a\u066e-\u06d3\u06d5\u06e5\u06e6\u06ee\u06ef\u06fa-\u06fc\u06ff\u0750-\u077f\u08a0-\u08bd]")


class FormatError(ValueError):
    """The file isn't what its name says."""


def name_of(tag: str) -> str:
    uri, _, local = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    return f"{NAMESPACES[uri]}:{local}" if uri in NAMESPACES else local if not uri else f"?:{local}"


def attr(e, name: str) -> str | None:
    """An attribute by prefixed or bare name."""
    for k, v in e.attrib.items():
        if name_of(k) == name:
            return v
    return None


def first(e, *path: str):
    """The first descendant along child names."""
    for step in path:
        e = next((c for c in e if name_of(c.tag) == step), None) if e is not None else None
    return e


def explicit(value: str | None) -> dict:
    return UNSET if value is None else {"state": "explicit", "value": value, "origin": None}


def inherited(value: str | None, part: str, prop: str) -> dict:
    return UNSET if value is None else {"state": "inherited", "value": value, "origin": {"part": part, "property": prop}}


def on_off(e) -> bool:
    """A toggle element: on without a value."""
    value = attr(e, "w:val")
    return value is None or value in ON


def unit(part: str, unit_id: str, kind: str, text: str, props: dict, paragraph: int | None, container: str | None) -> dict:
    blank = dict.fromkeys(NAMES, UNSET) | {"bullet": "none", "reversed": None}
    return {"unit_id": f"{part}#{unit_id}", "kind": kind, "text": text, "props": blank | props, "spans": [], "location": {"part": part, "paragraph": paragraph, "container": container}}


class Package:
    """A ZIP container with a content-type list."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise FormatError("not a package") from e
        self.names = [i.filename for i in self.zip.infolist() if not i.is_dir()]
        if "[Content_Types].xml" not in self.names:
            raise FormatError("no content types")
        self.rels: dict[str, dict[str, tuple[str, str | None]]] = {}

    def xml(self, part: str):
        try:
            return ElementTree.fromstring(self.zip.read(part))
        except (KeyError, ElementTree.ParseError) as e:
            raise FormatError(f"{part}: {e}") from e

    def parts(self, prefix: str) -> list[str]:
        return sorted(n for n in self.names if n.startswith(prefix) and n.endswith(".xml") and "/_rels/" not in n)

    def relations(self, part: str) -> dict[str, tuple[str, str | None]]:
        """Relationship id to (kind, target part); external targets have no part."""
        if part not in self.rels:
            folder, _, file = part.rpartition("/")
            where = f"{folder}/_rels/{file}.rels".lstrip("/")
            found = {}
            if where in self.names:
                for e in self.xml(where):
                    target = e.get("Target", "")
                    path = None
                    if e.get("TargetMode") != "External":
                        path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
                        path = path if path in self.names else next((n for n in self.names if unquote(n) == unquote(path)), None)
                    found[e.get("Id", "")] = (e.get("Type", "").rsplit("/", 1)[-1], path)
            self.rels[part] = found
        return self.rels[part]

    def related(self, part: str, kind: str) -> str | None:
        return next((p for k, p in self.relations(part).values() if k == kind and p), None)

    def main(self) -> str | None:
        return self.related("", "officeDocument")


def theme_fonts(package: Package, part: str | None) -> dict[tuple[str, str], tuple[str, str]]:
    """(major or minor, script) to (typeface, theme part)."""
    theme = package.related(part, "theme") if part else None
    if not theme:
        return {}
    out = {}
    for e in package.xml(theme).iter():
        font = {"a:majorFont": "major", "a:minorFont": "minor"}.get(name_of(e.tag))
        if font:
            for c in e:
                script = {"a:latin": "latin", "a:ea": "ea", "a:cs": "cs"}.get(name_of(c.tag))
                if script and c.get("typeface"):
                    out[font, script] = (c.get("typeface"), theme)
    return out


# ---- word processing ----


class WordStyles:
    def __init__(self, package: Package) -> None:
        main = package.main()
        self.part = package.related(main, "styles") if main else None
        self.theme = theme_fonts(package, main)
        self.styles: dict[str, dict] = {}
        self.defaults: dict = {}
        self.default_of: dict[str, str] = {}
        if not self.part:
            return
        root = package.xml(self.part)
        doc = first(root, "w:docDefaults")
        if doc is not None:
            self.defaults = self._formatting(first(doc, "w:pPrDefault", "w:pPr"), first(doc, "w:rPrDefault", "w:rPr"), None)
        for e in root:
            if name_of(e.tag) == "w:style" and attr(e, "w:styleId"):
                based = first(e, "w:basedOn")
                self.styles[attr(e, "w:styleId")] = {"based": attr(based, "w:val") if based is not None else None, **self._formatting(first(e, "w:pPr"), first(e, "w:rPr"), first(e, "w:tblPr"))}
                if attr(e, "w:default") in ON:
                    self.default_of.setdefault(attr(e, "w:type"), attr(e, "w:styleId"))

    def _formatting(self, p, r, t) -> dict:
        out: dict = {}
        if p is not None:
            if (e := first(p, "w:bidi")) is not None:
                out["direction"] = ("rtl" if on_off(e) else "ltr", "pPr@bidi")
            if (e := first(p, "w:jc")) is not None and attr(e, "w:val") in ALIGNMENT["docx"]:
                out["alignment"] = (ALIGNMENT["docx"][attr(e, "w:val")], "pPr@jc")
            if (e := first(p, "w:numPr")) is not None:
                n = first(e, "w:numId")
                out["bullet"] = "suppressed" if n is not None and (attr(n, "w:val") or "").strip() == "0" else "native"
        if r is not None and (e := first(r, "w:rFonts")) is not None:
            if found := self.themed(attr(e, "w:cstheme")):
                out["font"] = found
            elif attr(e, "w:cs"):
                out["font"] = (attr(e, "w:cs"), None)
        if t is not None and (e := first(t, "w:bidiVisual")) is not None:
            out["table"] = "rtl" if on_off(e) else "ltr"
        return out

    def themed(self, reference: str | None) -> tuple[str, str] | None:
        """A theme name such as minorBidi to (typeface, theme part)."""
        m = re.fullmatch(r"(major|minor)(Bidi|EastAsia|HAnsi|Ascii)", reference or "")
        return self.theme.get((m[1], {"Bidi": "cs", "EastAsia": "ea"}.get(m[2], "latin"))) if m else None

    def chain(self, style: str | None) -> Iterator[tuple[str, dict]]:
        seen: set[str] = set()
        while style in self.styles and style not in seen and len(seen) < 64:
            seen.add(style)
            yield style, self.styles[style]
            style = self.styles[style]["based"]

    def resolve(self, props: dict, style: str | None, run_style: str | None, table: tuple | None) -> None:
        sources = [*self.chain(style or self.default_of.get("paragraph")), *self.chain(run_style)]
        if table is not None:
            sources += self.chain(table[0] or self.default_of.get("table"))
        for name, s in [*((f"style[{i}]", s) for i, s in sources), ("docDefaults", self.defaults)]:
            for key in ("direction", "alignment"):
                if props[key] is UNSET and key in s:
                    value, where = s[key]
                    props[key] = inherited(value, self.part, f"{name}/pPrDefault/{where}" if name == "docDefaults" else f"{name}/{where}")
            if props["bullet"] == "none" and "bullet" in s:
                props["bullet"] = s["bullet"]
            if props["complex_font"] is UNSET and "font" in s:
                value, theme = s["font"]
                where = "rPrDefault/rPr" if name == "docDefaults" else "rPr"
                props["complex_font"] = inherited(value, theme or self.part, "fontScheme" if theme else f"{name}/{where}/rFonts@cs")

    def table_direction(self, style: str | None) -> dict:
        for name, s in self.chain(style or self.default_of.get("table")):
            if "table" in s:
                return inherited(s["table"], self.part, f"style[{name}]/tblPr@bidiVisual")
        return UNSET


class WordPart:
    """Units of one part, in the order in which paragraphs and tables end."""

    def __init__(self, part: str, root, styles: WordStyles) -> None:
        self.part, self.styles, self.units = part, styles, []
        self.seen = self.tables_seen = 0
        self.open: list[dict] = []
        self.tables: list[dict] = []
        self.walk(root, False)

    def walk(self, e, in_section: bool) -> None:
        name = name_of(e.tag)
        if name == "mc:Fallback" or name in REVISIONS:
            return
        p, t = self.open[-1] if self.open else None, self.tables[-1] if self.tables else None
        if name == "w:p":
            self.seen += 1
            cell = f"table {t['index']} row {t['row']} cell {t['cell']}" if t and t["row"] and t["cell"] else None
            self.open.append({"index": self.seen, "text": [], "cell": cell, "style": None, "run_style": None, "theme": None, "cs": None, "props": dict.fromkeys(NAMES, UNSET) | {"bullet": "none", "reversed": None}})
        elif name == "w:tbl":
            self.tables_seen += 1
            self.tables.append({"index": self.tables_seen, "row": 0, "cell": 0, "lines": [], "direction": UNSET, "style": None})
        elif name == "w:tr" and t:
            t["row"], t["cell"] = t["row"] + 1, 0
        elif name == "w:tc" and t:
            t["cell"] += 1
        elif name == "w:bidiVisual" and t:
            t["direction"] = explicit("rtl" if on_off(e) else "ltr")
        elif name == "w:tblStyle" and t:
            t["style"] = t["style"] or attr(e, "w:val")
        elif p:
            self._paragraph_property(name, e, p, in_section)
        for c in e:
            self.walk(c, in_section or name == "w:sectPr")
        if name == "w:p":
            self._close_paragraph()
        elif name == "w:tbl":
            self._close_table()

    def _paragraph_property(self, name: str, e, p: dict, in_section: bool) -> None:
        if name == "w:t":
            p["text"].append(e.text or "")
        elif name == "w:lang" and attr(e, "w:bidi") and p["props"]["language"] is UNSET:
            p["props"]["language"] = explicit(attr(e, "w:bidi"))
        elif name == "w:rFonts":
            p["theme"] = p["theme"] or self.styles.themed(attr(e, "w:cstheme"))
            p["cs"] = p["cs"] or attr(e, "w:cs")
            if attr(e, "w:ascii") and p["props"]["latin_font"] is UNSET:
                p["props"]["latin_font"] = explicit(attr(e, "w:ascii"))
        elif in_section:
            return
        elif name == "w:bidi":
            p["props"]["direction"] = explicit("rtl" if on_off(e) else "ltr")
        elif name == "w:jc" and attr(e, "w:val") in ALIGNMENT["docx"]:
            p["props"]["alignment"] = explicit(ALIGNMENT["docx"][attr(e, "w:val")])
        elif name == "w:numPr":
            p["props"]["bullet"] = "native"
        elif name == "w:numId" and (attr(e, "w:val") or "").strip() == "0":
            p["props"]["bullet"] = "suppressed"
        elif name == "w:pStyle":
            p["style"] = p["style"] or attr(e, "w:val")
        elif name == "w:rStyle":
            p["run_style"] = p["run_style"] or attr(e, "w:val")

    def _close_paragraph(self) -> None:
        p = self.open.pop()
        text = "".join(p["text"])
        for t in self.tables:
            t["lines"].append(text)
        if not text.strip():
            return
        if p["theme"]:
            p["props"]["complex_font"] = inherited(p["theme"][0], p["theme"][1], "fontScheme")
        elif p["cs"]:
            p["props"]["complex_font"] = explicit(p["cs"])
        self.styles.resolve(p["props"], p["style"], p["run_style"], (self.tables[-1]["style"],) if self.tables else None)
        self.units.append(unit(self.part, f"p{p['index']}", "paragraph", text, p["props"], p["index"], p["cell"]))

    def _close_table(self) -> None:
        t = self.tables.pop()
        text = ""
        for line in t["lines"]:
            text += ("\n" if text else "") + line
        if text.strip():
            direction = t["direction"] if t["direction"] is not UNSET else self.styles.table_direction(t["style"])
            self.units.append(unit(self.part, f"tbl{t['index']}", "table", text, {"direction": direction}, None, None))


def docx(package: Package) -> tuple[list[dict], list[str]]:
    styles = WordStyles(package)
    return [u for part in package.parts("word/") for u in WordPart(part, package.xml(part), styles).units], []


# ---- presentations ----


class SlideStyles:
    """Paragraph levels that a part's placeholders inherit along slide, layout and master."""

    STYLE = {"title": "title", "ctrTitle": "title", "body": "body", "subTitle": "body", "obj": "body"}

    def __init__(self, package: Package) -> None:
        self.package, self.known = package, {}

    def chain(self, part: str) -> list[str]:
        out, kinds = [part], ("slideLayout", "slideMaster", "notesMaster")
        while len(out) < 4:
            up = next((p for k in kinds if (p := self.package.related(out[-1], k)) and p not in out), None)
            if not up:
                break
            out.append(up)
        return out

    def sources(self, part: str) -> dict:
        """Of one part: list styles by placeholder key and the master's text styles by name."""
        if part not in self.known:
            root, out = self.package.xml(part), {}
            for sp in root.iter():
                if name_of(sp.tag) == "p:sp" and (key := self.key(sp)) and (body := first(sp, "p:txBody")) is not None and (ls := first(body, "a:lstStyle")) is not None:
                    out.setdefault(key, (ls, "lstStyle"))
            styles = first(root, "p:txStyles")
            for name, of in (("p:titleStyle", "title"), ("p:bodyStyle", "body"), ("p:otherStyle", "other")):
                if styles is not None and (ls := first(styles, name)) is not None:
                    out[of] = (ls, name[2:])
            self.known[part] = out
        return self.known[part]

    def key(self, sp) -> tuple[int, str] | None:
        ph = next((c for c in sp.iter() if name_of(c.tag) == "p:ph"), None)
        return None if ph is None else (int(ph.get("idx") or 0), self.STYLE.get(ph.get("type", "body"), "other"))

    def resolve(self, part: str, sp, level: int, props: dict) -> None:
        key = self.key(sp) if sp is not None else None
        chain = self.chain(part)
        theme = theme_fonts(self.package, chain[-1])
        candidates = []
        if key:
            candidates += [(p, self.sources(p).get(key)) for p in chain[1:]]
        candidates.append((chain[-1], self.sources(chain[-1]).get(key[1] if key else "other")))
        for where, found in candidates:
            e = first(found[0], f"a:lvl{level + 1}pPr") if found else None
            if e is None:
                continue
            prefix = f"{found[1]}/lvl{level + 1}pPr"
            if props["direction"] is UNSET and e.get("rtl") is not None:
                props["direction"] = inherited("rtl" if e.get("rtl") in ON else "ltr", where, f"{prefix}@rtl")
            if props["alignment"] is UNSET and e.get("algn") in ALIGNMENT["pptx"]:
                props["alignment"] = inherited(ALIGNMENT["pptx"][e.get("algn")], where, f"{prefix}@algn")
            cs = first(e, "a:defRPr", "a:cs")
            if props["complex_font"] is UNSET and cs is not None and cs.get("typeface"):
                face, source = self.face(cs.get("typeface"), theme)
                props["complex_font"] = inherited(face, source or where, "fontScheme" if source else f"{prefix}/defRPr/cs")

    @staticmethod
    def face(typeface: str, theme: dict) -> tuple[str | None, str | None]:
        m = re.fullmatch(r"\+(m[jn])-(lt|ea|cs)", typeface)
        if not m:
            return typeface, None
        return theme.get(({"mj": "major", "mn": "minor"}[m[1]], {"lt": "latin", "ea": "ea", "cs": "cs"}[m[2]]), (None, None))


class SlidePart:
    def __init__(self, part: str, root, styles: SlideStyles) -> None:
        self.part, self.styles, self.units = part, styles, []
        self.count = {"p": 0, "tbl": 0, "cols": 0}
        self.tables: list[dict] = []
        self.bodies: list[dict] = []
        self.shapes: list = []
        self.walk(root)

    def walk(self, e) -> None:
        name = name_of(e.tag)
        if name == "mc:Fallback":
            return
        if name == "a:p":
            self._paragraph(e)
            return
        if name == "p:sp":
            self.shapes.append(e)
        if name == "a:tbl":
            self.count["tbl"] += 1
            pr = first(e, "a:tblPr")
            self.tables.append({"index": self.count["tbl"], "lines": [], "row": 0, "cell": 0, "rtl": pr.get("rtl") if pr is not None else None})
        if name == "a:tr" and self.tables:
            self.tables[-1]["row"], self.tables[-1]["cell"] = self.tables[-1]["row"] + 1, 0
        if name == "a:tc" and self.tables:
            self.tables[-1]["cell"] += 1
        body = None
        if name.endswith(":txBody"):
            pr = first(e, "a:bodyPr")
            columns = int(pr.get("numCol") or 0) if pr is not None and (pr.get("numCol") or "0").isdecimal() else 0
            body = {"columns": columns, "rtl": pr.get("rtlCol") if pr is not None else None, "lines": []}
            self.bodies.append(body)
        for c in e:
            self.walk(c)
        if body:
            self.bodies.pop()
            if body["columns"] >= 2:
                self.count["cols"] += 1
                self._container(body, "columns", f"cols{self.count['cols']}")
        if name == "a:tbl":
            t = self.tables.pop()
            self._container(t, "table", f"tbl{t['index']}")
        if name == "p:sp":
            self.shapes.pop()

    def _container(self, c: dict, kind: str, unit_id: str) -> None:
        text = "\n".join(x for x in c["lines"] if x.strip())
        if text:
            direction = explicit(None if c["rtl"] is None else "rtl" if c["rtl"] in ON else "ltr")
            self.units.append(unit(self.part, unit_id, kind, text, {"direction": direction}, None, None))

    def _paragraph(self, e) -> None:
        self.count["p"] += 1
        n, text, props, level = self.count["p"], [], dict.fromkeys(NAMES, UNSET) | {"bullet": "none", "reversed": None}, 0
        pr = first(e, "a:pPr")
        if pr is not None:
            level = min(8, max(0, int(pr.get("lvl") or 0)))
            if pr.get("rtl") is not None:
                props["direction"] = explicit("rtl" if pr.get("rtl") in ON else "ltr")
            if pr.get("algn") in ALIGNMENT["pptx"]:
                props["alignment"] = explicit(ALIGNMENT["pptx"][pr.get("algn")])
            for c in pr:
                props["bullet"] = {"a:buChar": "native", "a:buAutoNum": "native", "a:buBlip": "native", "a:buNone": "suppressed"}.get(name_of(c.tag), props["bullet"])
        for r in e:
            kind = name_of(r.tag)
            if kind == "a:br":
                text.append("\n")
            if kind in ("a:r", "a:fld"):
                t = first(r, "a:t")
                text.append((t.text or "") if t is not None else "")
            rp = r if kind == "a:endParaRPr" else first(r, "a:rPr") if kind in ("a:r", "a:fld") else None
            if rp is not None and kind != "a:endParaRPr":
                if rp.get("lang") and props["language"] is UNSET:
                    props["language"] = explicit(rp.get("lang"))
                for tag, key in (("a:latin", "latin_font"), ("a:cs", "complex_font")):
                    f = first(rp, tag)
                    if f is not None and f.get("typeface") and props[key] is UNSET:
                        face, source = SlideStyles.face(f.get("typeface"), theme_fonts(self.styles.package, self.styles.chain(self.part)[-1]))
                        props[key] = inherited(face, source, "fontScheme") if source else explicit(face)
        whole = "".join(text)
        for c in [*self.tables, *self.bodies]:
            c["lines"].append(whole)
        if not whole.strip():
            return
        if self.bodies and props["direction"] is UNSET and self.bodies[-1]["rtl"] in ON:
            props["direction"] = inherited("rtl", self.part, "bodyPr@rtlCol")
        self.styles.resolve(self.part, self.shapes[-1] if self.shapes else None, level, props)
        t = self.tables[-1] if self.tables else None
        self.units.append(unit(self.part, f"p{n}", "paragraph", whole, props, n, f"table {t['index']} row {t['row']} cell {t['cell']}" if t and t["row"] and t["cell"] else None))


PIE = ("c:pieChart", "c:pie3DChart", "c:doughnutChart", "c:ofPieChart")


def chart(part: str, root) -> list[dict]:
    """Units of a chart: category axes, the legend and data labels, from cached strings."""
    cached = lambda e: [v.text or "" for p in (e.iter() if e is not None else ()) if name_of(p.tag) == "c:strCache" for q in p if name_of(q.tag) == "c:pt" for v in q if name_of(v.tag) == "c:v"]
    groups = [e for e in root.iter() if re.fullmatch(r"c:\w*Chart", name_of(e.tag)) and name_of(e.tag) != "c:userShapes"]
    values = lambda e, tag: [c.get("val") for c in e if name_of(c.tag) == tag]
    distinct = lambda xs: list(dict.fromkeys(x for x in xs if x.strip()))
    series = lambda g: [s for s in g if name_of(s.tag) == "c:ser"]
    names = lambda g: [n for s in series(g) for n in cached(first(s, "c:tx"))]
    categories = lambda g: [n for s in series(g) for n in cached(first(s, "c:cat"))]
    out: list[dict] = []
    counts = {"catax": 0, "legend": 0, "dlbls": 0}

    def emit(kind: str, e, lines: list[str]) -> None:
        counts[kind] += 1
        rtl = next((p.get("rtl") for p in e.iter() if name_of(p.tag) == "a:pPr" and p.get("rtl") is not None), None)
        if lines:
            out.append(unit(part, f"{kind}{counts[kind]}", "chart_text", "\n".join(lines), {"direction": explicit(None if rtl is None else "rtl" if rtl in ON else "ltr")}, None, None))

    for e in root.iter():
        tag = name_of(e.tag)
        if tag == "c:catAx":
            own = values(e, "c:axId")[:1]
            group = next((g for g in groups if own and own[0] in values(g, "c:axId")), None)
            emit("catax", e, distinct(categories(group)) if group is not None else [])
        elif tag == "c:legend":
            emit("legend", e, distinct(x for g in groups for x in (categories(g) if name_of(g.tag) in PIE else names(g))))
        elif tag == "c:dLbls":
            group = next((g for g in groups if any(d is e for d in g.iter())), None)
            shown = []
            if group is not None:
                shown += categories(group) if "1" in values(e, "c:showCatName") else []
                shown += names(group) if "1" in values(e, "c:showSerName") else []
            emit("dlbls", e, distinct(shown))
    return out


def pptx(package: Package) -> tuple[list[dict], list[str]]:
    styles, out = SlideStyles(package), []
    for part in package.parts("ppt/"):
        root = package.xml(part)
        out += chart(part, root) if name_of(root.tag) == "c:chartSpace" else SlidePart(part, root, styles).units
    return out, []


# ---- spreadsheets ----


def column_number(reference: str) -> int | None:
    m = re.match(r"[A-Za-z]+", reference)
    n = 0
    for c in m[0].upper() if m else "":
        n = n * 26 + ord(c) - 64
    return n - 1 if m else None


def rich_text(e) -> str:
    """Text of a string item without its phonetic runs."""
    return "".join("" if name_of(c.tag) == "x:rPh" else (c.text or "") if name_of(c.tag) == "x:t" else rich_text(c) for c in e)


class Workbook:
    def __init__(self, package: Package) -> None:
        self.package, main = package, package.main()
        if not main:
            raise FormatError("no workbook")
        root, rels = package.xml(main), package.relations(main)
        self.sheets = [rels[i][1] for s in root.iter() if name_of(s.tag) == "x:sheet" and (i := attr(s, "r:id")) in rels and rels[i][1]]
        strings = package.related(main, "sharedStrings")
        self.strings = [rich_text(si) for si in package.xml(strings) if name_of(si.tag) == "x:si"] if strings else []
        self.styles_part = package.related(main, "styles")
        self.fonts, self.xfs, self.bases = [], [], []
        if self.styles_part:
            for e in package.xml(self.styles_part):
                tag = name_of(e.tag)
                if tag == "x:fonts":
                    self.fonts = [f.get("val") if (f := first(x, "x:name")) is not None else None for x in e]
                elif tag == "x:cellXfs":
                    self.xfs = list(e)
                elif tag == "x:cellStyleXfs":
                    self.bases = list(e)
        core = package.related("", "core-properties")
        tag = next((e.text.strip() for e in package.xml(core).iter() if name_of(e.tag) == "dc:language" and e.text and e.text.strip()), None) if core else None
        self.language = inherited(tag, core, "dc:language") if tag else UNSET

    def props(self, s: str | None) -> dict:
        k = int(s or 0)
        xf = self.xfs[k] if k < len(self.xfs) else None
        if xf is None:
            return {"language": self.language}
        base_id = int(xf.get("xfId") or 0)
        base = self.bases[base_id] if base_id < len(self.bases) else None
        out = {"language": self.language}
        for key, name, table, apply in (("alignment", "horizontal", ALIGNMENT["xlsx"], "applyAlignment"), ("direction", "readingOrder", {"1": "ltr", "2": "rtl"}, "applyAlignment")):
            for e, make in ((xf, explicit), (base, lambda v, n=name: inherited(v, self.styles_part, f"cellStyleXfs[{base_id}]@{n}"))):
                a = first(e, "x:alignment") if e is not None and e.get(apply) not in ("0", "false") else None
                if a is not None and a.get(name) in table:
                    out[key] = make(table[a.get(name)])
                    break
        for e, make in ((xf, explicit), (base, lambda v: inherited(v, self.styles_part, f"cellStyleXfs[{base_id}]@fontId"))):
            if e is not None and e.get("applyFont") not in ("0", "false") and e.get("fontId") is not None and int(e.get("fontId")) < len(self.fonts) and self.fonts[int(e.get("fontId"))]:
                out["complex_font"] = out["latin_font"] = make(self.fonts[int(e.get("fontId"))])
                break
        return out


def xlsx(package: Package) -> tuple[list[dict], list[str]]:
    book, out, unread = Workbook(package), [], []
    for part in book.sheets:
        root, n, rows = package.xml(part), 0, {}
        for row in (e for e in root.iter() if name_of(e.tag) == "x:row"):
            for cell in row:
                n += 1
                kind, v, inline = cell.get("t"), first(cell, "x:v"), first(cell, "x:is")
                text = None
                if kind == "s" and v is not None and (v.text or "").isdecimal() and int(v.text) < len(book.strings):
                    text = book.strings[int(v.text)]
                elif kind == "inlineStr" and inline is not None:
                    text = rich_text(inline)
                elif kind == "str" and v is not None:
                    text = v.text or ""
                if not text:
                    continue
                ref = cell.get("r", "")
                if first(cell, "x:f") is not None:
                    if ARABIC.search(text):
                        unread.append(f"{part} {ref} (formula)")
                    continue
                rows.setdefault(id(row), []).append((column_number(ref), text))
                out.append(unit(part, f"c{n}", "paragraph", text, book.props(cell.get("s")), n, f"cell {ref}" if ref else None))
        columns = {c for cells in rows.values() for c, _ in cells if c is not None}
        if len(columns) >= 2:
            view = next((e for e in root.iter() if name_of(e.tag) == "x:sheetView"), None)
            rtl = view.get("rightToLeft") if view is not None else None
            text = "\n".join(t for cells in rows.values() for _, t in cells)
            out.append(unit(part, "grid1", "table", text, {"direction": explicit(None if rtl is None else "rtl" if rtl in ON else "ltr")}, None, None))
    return out, unread


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx}


def read(data: bytes, fmt: str) -> tuple[list[dict], list[str]]:
    """The units of a package, with ``ord``, and the names of sources that weren't read."""
    units, unread = READERS[fmt](Package(data))
    return [{"ord": k, **u} for k, u in enumerate(units)], unread
