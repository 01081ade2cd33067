"""Repairs written into office packages; parts without repairs keep their bytes."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import unicode as u
from ..functions.arrow import batched, rows
from ..scratch import small_batches
from .ooxml import NAMESPACES, REVISIONS, FormatError, Package, attr, first, name_of

URI = {}
for _uri, _prefix in NAMESPACES.items():
    URI.setdefault(_prefix, _uri)
MARKER = re.compile("^\\s*[•◦▪‣⁃]\\s+")
ALIGN_PPTX = {"left": "l", "right": "r", "center": "ctr", "justify": "just", "distributed": "dist"}
ALIGN_DOCX = {"start": "start", "end": "end", "center": "center", "justify": "both", "distributed": "distribute"}
# Children of paragraph and run properties in the order that the schemas ask for, as far as they are written here.
ORDER = {
    "w:pPr": "w:pStyle w:keepNext w:keepLines w:pageBreakBefore w:framePr w:widowControl w:numPr w:suppressLineNumbers w:pBdr w:shd w:tabs w:suppressAutoHyphens w:kinsoku w:wordWrap w:overflowPunct w:topLinePunct w:autoSpaceDE w:autoSpaceDN w:bidi w:adjustRightInd w:snapToGrid w:spacing w:ind w:contextualSpacing w:mirrorIndents w:suppressOverlap w:jc w:textDirection w:textAlignment w:textboxTightWrap w:outlineLvl w:divId w:cnfStyle w:rPr w:sectPr w:pPrChange".split(),
    "w:rPr": "w:rStyle w:rFonts w:b w:bCs w:i w:iCs w:caps w:smallCaps w:strike w:dstrike w:outline w:shadow w:emboss w:imprint w:noProof w:snapToGrid w:vanish w:webHidden w:color w:spacing w:w w:kern w:position w:sz w:szCs w:highlight w:u w:effect w:bdr w:shd w:fitText w:vertAlign w:rtl w:cs w:em w:lang w:eastAsianLayout w:specVanish w:oMath".split(),
    "w:tblPr": "w:tblStyle w:tblpPr w:tblOverlap w:bidiVisual w:tblStyleRowBandSize w:tblStyleColBandSize w:tblW w:jc w:tblCellSpacing w:tblInd w:tblBorders w:shd w:tblLayout w:tblCellMar w:tblLook".split(),
    "a:pPr": "a:lnSpc a:spcBef a:spcAft a:buClrTx a:buClr a:buSzTx a:buSzPct a:buSzPts a:buFontTx a:buFont a:buNone a:buAutoNum a:buChar a:buBlip a:tabLst a:defRPr a:extLst".split(),
    "a:rPr": "a:ln a:noFill a:solidFill a:gradFill a:blipFill a:pattFill a:grpFill a:effectLst a:effectDag a:highlight a:uLnTx a:uLn a:uFillTx a:uFill a:latin a:ea a:cs a:sym a:hlinkClick a:hlinkMouseOver a:rtl a:extLst".split(),
}


class Refused(ValueError):
    """A repair that this format or document can't take."""


def tag(like, name: str) -> str:
    """A qualified name in the namespace that ``like`` uses for the prefix, transitional or strict."""
    prefix, _, local = name.partition(":")
    own = like.tag[1:].partition("}")[0] if like.tag.startswith("{") else ""
    uri = own if NAMESPACES.get(own) == prefix else URI[prefix]
    return f"{{{uri}}}{local}"


def child(parent, name: str, create: bool = True):
    """The child of that name, made at its place in the schema's order if it isn't there."""
    found = first(parent, name)
    if found is None and create:
        found = ElementTree.Element(tag(parent, name))
        order = ORDER.get(name_of(parent.tag), [])
        rank = order.index(name) if name in order else len(order)
        at = next((k for k, c in enumerate(parent) if name_of(c.tag) in order and order.index(name_of(c.tag)) > rank), len(parent))
        parent.insert(0 if name.endswith(":pPr") or name.endswith(":rPr") and name_of(parent.tag) != "w:pPr" else at, found)
    return found


def put(e, name: str, value: str) -> None:
    """Set an attribute; a prefixed one in the element's own namespace."""
    old = next((k for k in e.attrib if name_of(k) == name), None)
    e.set(old or (tag(e, name) if ":" in name else name), value)


def edited(texts: list[str], fixes: list[dict]) -> list[str]:
    """The texts of a unit's runs after its text repairs: deletions, then logical letters, then the marker."""
    kinds = {f["kind"] for f in fixes}
    gone = {o for f in fixes if f["kind"] in ("RemoveControls", "RemoveTatweel") for o in f["offsets"] or ()}
    out, at = [], 0
    for text in texts:
        kept = []
        for c in text:
            if at not in gone:
                kept.append(u.PRESENTATION.get(c, c) if "NormalizePresentationForms" in kinds else c)
            at += len(c.encode())
        out.append("".join(kept))
    m = MARKER.match("".join(out)) if "ConvertLiteralBullet" in kinds else None
    drop = m.end() if m else 0
    for k, text in enumerate(out):
        cut = min(drop, len(text))
        out[k], drop = text[cut:], drop - cut
    return out


def _set_texts(elements: list, fixes: list[dict]) -> None:
    for e, new in zip(elements, edited([e.text or "" for e in elements], fixes), strict=True):
        if e.text != new:
            e.text = new
            if name_of(e.tag) == "w:t" and new != new.strip():
                e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def _value(fixes: list[dict], kind: str) -> str | None:
    return next((f["value"] for f in fixes if f["kind"] == kind), None)


# ---- word processing ----


def _word_targets(root) -> dict[str, object]:
    found, count = {}, {"w:p": 0, "w:tbl": 0}

    def walk(e) -> None:
        name = name_of(e.tag)
        if name == "mc:Fallback" or name in REVISIONS:
            return
        if name in count:
            count[name] += 1
            found[f"{'p' if name == 'w:p' else 'tbl'}{count[name]}"] = e
        for c in e:
            walk(c)

    walk(root)
    return found


def _own(e, name: str, stop: tuple[str, ...]) -> list:
    """Descendants of that name outside nested paragraphs and fallbacks."""
    out = []
    for c in e:
        n = name_of(c.tag)
        if n == name:
            out.append(c)
        elif n not in stop:
            out += _own(c, name, stop)
    return out


def bullet_list(package: Package, marker: str) -> str | None:
    """The first numbering that is a bullet list, one with this very marker first."""
    main = package.main()
    part = package.related(main, "numbering") if main else None
    if not part:
        return None
    root, kinds = package.xml(part), {}
    for e in root:
        if name_of(e.tag) == "w:abstractNum":
            level = first(e, "w:lvl")
            fmt, text = (first(level, "w:numFmt"), first(level, "w:lvlText")) if level is not None else (None, None)
            if fmt is not None and attr(fmt, "w:val") == "bullet":
                kinds[attr(e, "w:abstractNumId")] = attr(text, "w:val") if text is not None else None
    nums = [(attr(e, "w:numId"), attr(a, "w:val")) for e in root if name_of(e.tag) == "w:num" and (a := first(e, "w:abstractNumId")) is not None]
    bullets = [(n, kinds[a]) for n, a in nums if a in kinds]
    return next((n for n, m in bullets if m == marker), bullets[0][0] if bullets else None)


def _docx(package: Package, root, plan: dict[str, list[dict]]) -> None:
    targets = _word_targets(root)
    for key, fixes in plan.items():
        e = targets.get(key)
        if e is None:
            raise Refused(f"no unit {key}")
        direction = _value(fixes, "SetDirection")
        if key.startswith("tbl"):
            if direction:
                put(child(child(e, "w:tblPr"), "w:bidiVisual"), "w:val", "1" if direction == "rtl" else "0")
            continue
        stop = ("w:p", "mc:Fallback", "w:txbxContent", *REVISIONS)
        _set_texts(_own(e, "w:t", stop), fixes)
        if direction:
            put(child(child(e, "w:pPr"), "w:bidi"), "w:val", "1" if direction == "rtl" else "0")
        if a := _value(fixes, "SetAlignment"):
            if a not in ALIGN_DOCX:
                raise Refused(f"alignment {a} isn't written")
            put(child(child(e, "w:pPr"), "w:jc"), "w:val", ALIGN_DOCX[a])
        if m := _value(fixes, "ConvertLiteralBullet"):
            number = bullet_list(package, m)
            if number is None:
                raise Refused("the document has no bullet list")
            pr = child(child(e, "w:pPr"), "w:numPr")
            for name, value in (("w:ilvl", "0"), ("w:numId", number)):
                put(child(pr, name), "w:val", value)
        for r in _own(e, "w:r", stop):
            if lang := _value(fixes, "SetLanguage"):
                put(child(child(r, "w:rPr"), "w:lang"), "w:bidi", lang)
            if font := _value(fixes, "SetComplexFont"):
                fonts = child(child(r, "w:rPr"), "w:rFonts")
                put(fonts, "w:cs", font)
                for k in [k for k in fonts.attrib if name_of(k) == "w:cstheme"]:
                    del fonts.attrib[k]


# ---- presentations ----


def _slide_targets(root) -> dict[str, object]:
    found, count = {}, {"p": 0, "tbl": 0, "cols": 0}

    def walk(e) -> None:
        name = name_of(e.tag)
        if name == "mc:Fallback":
            return
        if name in ("a:p", "a:tbl"):
            count[name[2:]] += 1
            found[f"{name[2:]}{count[name[2:]]}"] = e
        if name == "a:p":
            return
        for c in e:
            walk(c)
        pr = first(e, "a:bodyPr") if name.endswith(":txBody") else None
        if pr is not None and (pr.get("numCol") or "0").isdecimal() and int(pr.get("numCol") or 0) >= 2:
            count["cols"] += 1
            found[f"cols{count['cols']}"] = pr

    walk(root)
    return found


def _pptx(package: Package, root, plan: dict[str, list[dict]], rtl: dict[str, bool]) -> None:
    targets = _slide_targets(root)
    for key, fixes in plan.items():
        e = targets.get(key)
        if e is None:
            raise Refused(f"no unit {key}")
        direction = _value(fixes, "SetDirection")
        flag = None if direction is None else "1" if direction == "rtl" else "0"
        if key.startswith(("tbl", "cols")):
            if flag:
                put(child(e, "a:tblPr") if key.startswith("tbl") else e, "rtl" if key.startswith("tbl") else "rtlCol", flag)
            continue
        texts = [t for r in e if name_of(r.tag) in ("a:r", "a:fld") and (t := first(r, "a:t")) is not None]
        _set_texts_with_breaks(e, texts, fixes)
        if flag:
            put(child(e, "a:pPr"), "rtl", flag)
        if a := _value(fixes, "SetAlignment"):
            right = direction == "rtl" if direction else rtl.get(key, False)
            edge = {"start": "right" if right else "left", "end": "left" if right else "right"}.get(a, a)
            put(child(e, "a:pPr"), "algn", ALIGN_PPTX[edge])
        if m := _value(fixes, "ConvertLiteralBullet"):
            pr = child(e, "a:pPr")
            for c in [c for c in pr if name_of(c.tag) in ("a:buNone", "a:buAutoNum", "a:buChar", "a:buBlip")]:
                pr.remove(c)
            put(child(pr, "a:buChar"), "char", m)
            put(pr, "marR" if direction == "rtl" or rtl.get(key) else "marL", "342900")
            put(pr, "indent", "-342900")
        for r in e:
            if name_of(r.tag) in ("a:r", "a:fld", "a:endParaRPr"):
                rp = r if name_of(r.tag) == "a:endParaRPr" else child(r, "a:rPr")
                if lang := _value(fixes, "SetLanguage"):
                    put(rp, "lang", lang)
                if font := _value(fixes, "SetComplexFont"):
                    put(child(rp, "a:cs"), "typeface", font)


def _set_texts_with_breaks(p, texts: list, fixes: list[dict]) -> None:
    """A line break counts as one byte of the unit's text."""
    pieces, elements = [], []
    for r in p:
        if name_of(r.tag) == "a:br":
            pieces.append("\n")
            elements.append(None)
        elif (t := first(r, "a:t")) is not None and t in texts:
            pieces.append(t.text or "")
            elements.append(t)
    for t, new in zip(elements, edited(pieces, fixes), strict=True):
        if t is not None:
            t.text = new


# ---- spreadsheets ----


def _xlsx(package: Package, plans: dict[str, dict[str, list[dict]]], rtl: dict[str, dict[str, bool]]) -> dict[str, object]:
    """Repaired cells get formats and strings of their own, appended; one format for equal requests."""
    main = package.main()
    styles_part, strings_part = package.related(main, "styles"), package.related(main, "sharedStrings")
    styles = package.xml(styles_part) if styles_part else None
    strings = package.xml(strings_part) if strings_part else None
    xfs = next((e for e in styles if name_of(e.tag) == "x:cellXfs"), None) if styles is not None else None
    derived: dict[tuple, int] = {}
    new_strings: dict[tuple, int] = {}
    out: dict[str, object] = {}
    for part, plan in plans.items():
        root, n = package.xml(part), 0
        cells = {}
        for row in (e for e in root.iter() if name_of(e.tag) == "x:row"):
            for cell in row:
                n += 1
                cells[f"c{n}"] = cell
        for key, fixes in plan.items():
            direction = _value(fixes, "SetDirection")
            if key.startswith("grid"):
                view = next((e for e in root.iter() if name_of(e.tag) == "x:sheetView"), None)
                if view is None:
                    raise Refused("the sheet has no view")
                put(view, "rightToLeft", "1" if direction == "rtl" else "0")
                continue
            if any(f["kind"] in ("SetLanguage", "SetComplexFont", "ConvertLiteralBullet") for f in fixes):
                raise Refused("a sheet has no language, second font or list")
            cell = cells.get(key)
            if cell is None:
                raise Refused(f"no unit {key}")
            alignment = _value(fixes, "SetAlignment")
            if direction or alignment:
                if xfs is None:
                    raise Refused("the workbook has no formats")
                base = int(cell.get("s") or 0)
                right = direction == "rtl" if direction else rtl.get(part, {}).get(key, False)
                edge = {"start": "right" if right else "left", "end": "left" if right else "right"}.get(alignment, alignment)
                request = (base, edge, direction)
                if request not in derived:
                    copy = ElementTree.fromstring(ElementTree.tostring(xfs[base])) if base < len(xfs) else ElementTree.Element(tag(xfs, "x:xf"))
                    a = child(copy, "x:alignment")
                    if edge:
                        put(a, "horizontal", edge)
                    if direction:
                        put(a, "readingOrder", "2" if direction == "rtl" else "1")
                    copy.set("applyAlignment", "1")
                    xfs.append(copy)
                    xfs.set("count", str(len(xfs)))
                    derived[request] = len(xfs) - 1
                cell.set("s", str(derived[request]))
            if any(f["kind"] in ("RemoveControls", "RemoveTatweel", "NormalizePresentationForms") for f in fixes):
                if cell.get("t") == "s":
                    v = first(cell, "x:v")
                    request = (v.text, repr([(f["kind"], f["offsets"]) for f in fixes]))
                    if request not in new_strings:
                        item = ElementTree.fromstring(ElementTree.tostring([e for e in strings if name_of(e.tag) == "x:si"][int(v.text)]))
                        _set_texts(_own(item, "x:t", ("x:rPh",)), fixes)
                        strings.append(item)
                        total = sum(name_of(e.tag) == "x:si" for e in strings)
                        for k in ("count", "uniqueCount"):
                            if strings.get(k) is not None:
                                strings.set(k, str(int(strings.get(k)) + (k == "uniqueCount")))
                        new_strings[request] = total - 1
                    v.text = str(new_strings[request])
                elif (inline := first(cell, "x:is")) is not None:
                    _set_texts(_own(inline, "x:t", ("x:rPh",)), fixes)
        out[part] = root
    if derived:
        out[styles_part] = styles
    if new_strings:
        out[strings_part] = strings
    return out


def serialised(root, original: bytes) -> bytes:
    """XML with the prefixes that the part used."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(original), events=["start-ns"]):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    body = ElementTree.tostring(root, encoding="unicode")
    return ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body).encode()


def rewrite(data: bytes, fmt: str, repairs: list[dict], rtl: dict[str, bool] | None = None) -> bytes:
    """A package with its repairs (unit_id, fix) made.

    ``rtl`` has the inherited direction by unit_id, against which a start edge
    is lowered. Entries without repairs keep their content, their order and
    their dates. A repair of a part that isn't there, or one that the format
    can't take, is refused and nothing is written.
    """
    package = Package(data)
    plans: dict[str, dict[str, list[dict]]] = {}
    for r in repairs:
        part, _, key = r["unit_id"].rpartition("#")
        if part not in package.names:
            raise Refused(f"{part}: no such part")
        plans.setdefault(part, {}).setdefault(key, []).append(r["fix"])
    facing: dict[str, dict[str, bool]] = {}
    for unit_id, right in (rtl or {}).items():
        part, _, key = unit_id.rpartition("#")
        facing.setdefault(part, {})[key] = right
    if fmt == "xlsx":
        edits = _xlsx(package, plans, facing)
    elif fmt in ("docx", "pptx"):
        edits = {}
        for part, plan in plans.items():
            root = package.xml(part)
            if fmt == "docx":
                _docx(package, root, plan)
            else:
                _pptx(package, root, plan, facing.get(part, {}))
            edits[part] = root
    else:
        raise Refused(f"{fmt} isn't written")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for info in package.zip.infolist():
            content = package.zip.read(info.filename)
            z.writestr(info, serialised(edits[info.filename], content) if info.filename in edits else content, compress_type=info.compress_type)
    return out.getvalue()


REWRITTEN = "path string, format string, content binary, applied int, refused string"


def rewrite_all(found: DataFrame, units: DataFrame, repairs: DataFrame) -> DataFrame:
    """Rows (path, format, content) with their repairs made: content is null and ``refused`` says why where they can't be.

    Repairs of a document meet by its path; documents without any keep their content.
    """
    facing = units.select(F.col("doc_id").alias("path"), "unit_id", F.coalesce((F.col("props.direction.value") == "rtl") & (F.col("props.direction.state") != "unset"), F.lit(False)).alias("rtl"))
    per = repairs.select(F.col("doc_id").alias("path"), "unit_id", "fix").join(facing, ["path", "unit_id"], "left").groupBy("path").agg(F.collect_list(F.struct("unit_id", "fix", "rtl")).alias("repairs"))
    small_batches(found.sparkSession)
    return found.join(per, "path", "left").select("path", "format", "content", "repairs").mapInArrow(_rewrite_batches, REWRITTEN)


def _rewrite_batches(batches):
    kind = pa.schema([("path", pa.string()), ("format", pa.string()), ("content", pa.binary()), ("applied", pa.int32()), ("refused", pa.string())])

    def written():
        for row in rows(batches):
            todo, content, refused = row["repairs"] or [], row["content"], None
            try:
                if todo:
                    content = rewrite(content, row["format"], todo, {r["unit_id"]: bool(r["rtl"]) for r in todo})
            except (Refused, FormatError) as e:
                content, refused = None, str(e)
            yield {"path": row["path"], "format": row["format"], "content": content, "applied": 0 if refused else len(todo), "refused": refused}

    yield from batched(written(), kind)


def guard(source: str, target: str, exists: bool, force: bool = False) -> None:
    """Refuse to write over the source, into another format, or over a file without ``force``."""
    import posixpath

    if posixpath.normpath(source) == posixpath.normpath(target):
        raise Refused("the output is the input")
    extension = lambda p: p.rsplit(".", 1)[-1].lower()
    if extension(source) != extension(target):
        raise Refused("the output has another format")
    if extension(source) not in ("pptx", "docx", "xlsx"):
        raise Refused(f"{extension(source)} is only read")
    if exists and not force:
        raise Refused("the output exists")
