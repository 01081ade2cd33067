"""Web pages to text units, in an Arrow table function over a column of pages."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batched, rows
from ..plans.schema import UNITS
from ..scratch import small_batches
from . import css

# Elements that begin a line of their own, elements without content, and elements that aren't prose.
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOT_PROSE = frozenset("script style noscript".split())
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCK - {"body", "caption", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "dd", "dt", "li"} | {"li", "dd", "dt"}
#: Starting the key ends the nearest open element of the values, looked for up to the fence.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}),
}
HEAD_ONLY = frozenset("title base link meta style script noscript template".split())
ALIGN = {"left": "left", "right": "right", "center": "center", "centre": "center", "justify": "justify", "justify-all": "justify", "start": "start", "end": "end"}


@dataclass(eq=False)
class Element:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Element | None = None
    children: list = field(default_factory=list)

    @property
    def block(self) -> bool:
        return self.name in BLOCK


class Tree(HTMLParser):
    """A page's elements with implied html, head, body and end tags.

    It doesn't move misplaced table content in front of its table.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.head, self.body = Element("head", parent=self.root), None
        self.root.children.append(self.head)
        self.open: list[Element] = [self.root, self.head]

    def _into_body(self) -> None:
        if self.body is None:
            self.body = Element("body", parent=self.root)
            self.root.children.append(self.body)
            self.open = [self.root, self.body]

    def handle_starttag(self, tag: str, attrs) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "head", "body"):
            if tag == "body":
                self._into_body()
            target = {"html": self.root, "head": self.head, "body": self.body}[tag]
            target.attrs |= {k: v for k, v in given.items() if k not in target.attrs}
            return
        if self.body is None and tag not in HEAD_ONLY:
            self._into_body()
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "button"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "tr" and self.open[-1].name == "table":
            self._push(Element("tbody"))
        e = Element(tag, given)
        self._push(e)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def _push(self, e: Element) -> None:
        e.parent = self.open[-1]
        e.parent.children.append(e)
        self.open.append(e)

    def _end(self, names: set[str], fence: set[str]) -> None:
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in fence:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.body is None:
            self._into_body()
            return
        if tag in ("html", "body", "head"):
            return
        if tag == "p" and not any(e.name == "p" for e in self.open):
            self.handle_starttag("p", [])
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return
            if self.open[k].name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        if self.body is None and self.open[-1] is self.head:
            if not data.strip():
                return
            self._into_body()
        self.open[-1].children.append(data)


@dataclass(frozen=True)
class Value:
    """A property's value; ``origin`` is None where the element itself states it."""

    value: str | None = None
    origin: tuple[str, str] | None = None

    def below(self, here: tuple[str, str]) -> Value:
        return Value(self.value, self.origin or here)

    def row(self) -> dict:
        if self.value is None:
            return {"state": "unset", "value": None, "origin": None}
        origin = None if self.origin is None else {"part": self.origin[0], "property": self.origin[1]}
        return {"state": "inherited" if origin else "explicit", "value": self.value, "origin": origin}


@dataclass(frozen=True)
class State:
    direction: Value = Value()
    alignment: Value = Value()
    language: Value = Value()
    font: Value = Value()
    inset: Value = Value()
    no_marker: bool = False
    pre: bool = False

    def below(self, here: tuple[str, str]) -> State:
        return replace(self, direction=self.direction.below(here), alignment=self.alignment.below(here), language=self.language.below(here), font=self.font.below(here), inset=Value())


UNSET = Value().row()


def direction_of(value: str | None) -> str | None:
    value = (value or "").strip().lower()
    return value if value in ("rtl", "ltr") else None


def described(e: Element) -> str:
    if e.attrs.get("id", "").strip():
        return f"{e.name}#{e.attrs['id'].strip()}"
    classes = e.attrs.get("class", "").split()
    return f"{e.name}.{classes[0]}" if classes else e.name


def presentational(e: Element) -> list[tuple[str, str]]:
    """Declarations that markup stands for."""
    out = []
    if e.name == "bdo":
        out.append(("unicode-bidi", "isolate-override"))
    elif e.name == "bdi" or "dir" in e.attrs:
        out.append(("unicode-bidi", "isolate"))
    if d := direction_of(e.attrs.get("dir")):
        out.append(("direction", d))
    if (align := e.attrs.get("align", "").strip().lower()) in ALIGN:
        out.append(("text-align", align))
    return out


def inset_of(computed: dict[str, css.Won]) -> tuple[str, css.Won] | None:
    """The one side that a margin or padding insets; physical sides come first."""

    def edge(side: str) -> css.Won | None:
        for box in ("margin", "padding"):
            won = computed.get(f"{box}-{side}")
            m = re.match(r"[+-]?(\d+\.?\d*|\.\d+)", won.value.strip()) if won else None
            if m and float(m[0]):
                return won
        return None

    for one, other, names in (("left", "right", ("left", "right")), ("inline-start", "inline-end", ("start", "end"))):
        a, b = edge(one), edge(other)
        if bool(a) != bool(b):
            return (names[0], a) if a else (names[1], b)
    return None


def columns_of(computed: dict[str, css.Won]) -> int | None:
    if (won := computed.get("column-count")) and won.value.strip().isdecimal():
        return int(won.value)
    won = computed.get("columns")
    return next((int(x) for x in won.value.split() if x.isdecimal()), None) if won else None


class Runs:
    """A line of text as it is collected, with spans in bytes."""

    def __init__(self, pre: bool) -> None:
        self.pre, self.parts, self.size, self.gap, self.spans = pre, [], 0, False, []

    def push(self, text: str) -> None:
        if self.pre:
            self._add(text)
            return
        for word in re.split(r"(\s+)", text):
            if not word:
                continue
            if word.isspace():
                self.gap = self.size > 0
            else:
                self._add(" " + word if self.gap else word)
                self.gap = False

    def _add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text.encode())

    def done(self) -> tuple[str, list[dict]]:
        text = "".join(self.parts)
        if not self.pre:
            return text, self.spans
        low = len(text) - len(text.lstrip("\n"))
        cut = text.strip("\n")
        high, kept = low + len(cut.encode()), []
        for s in self.spans:
            a, b = max(s["offset"], low), min(s["offset"] + s["len"], high)
            if a < b:
                kept.append(s | {"offset": a - low, "len": b - a})
        return cut, kept


class Page:
    """The units of one page, in document order."""

    def __init__(self, part: str, source: str, linked: dict[str, str] | None = None) -> None:
        self.part, self.units, self.unread = part, [], []
        tree = Tree()
        tree.feed(source)
        tree.close()
        self.sheets, self.linked = [], linked or {}
        self._style_sheets(tree.root)
        self.computed: dict[Element, dict[str, css.Won]] = {}
        self.count = {"p": 0, "tbl": 0, "cols": 0}
        self.tables: list[list[int]] = []
        self._walk(tree.root, State())

    def _style_sheets(self, e: Element) -> None:
        if e.name == "style":
            self.sheets.append(css.sheet("".join(x for x in e.children if isinstance(x, str))))
        if e.name == "link" and "stylesheet" in e.attrs.get("rel", "").lower().split() and "href" in e.attrs:
            found = self._local(e.attrs["href"])
            if found is None:
                self.unread.append(e.attrs["href"])
            else:
                self.sheets.append(css.sheet(found))
        for c in e.children:
            if isinstance(c, Element):
                self._style_sheets(c)

    def _local(self, href: str) -> str | None:
        """A sheet beside the page; nothing is fetched and no absolute path is read."""
        path = re.split(r"[?#]", href)[0].strip()
        if not path or path.startswith("/") or re.match(r"[A-Za-z0-9+]*:", path):
            return None
        return self.linked.get(posixpath.normpath(posixpath.join(posixpath.dirname(self.part), path)))

    def _style(self, e: Element) -> dict[str, css.Won]:
        if e not in self.computed:
            self.computed[e] = css.cascade(e, self.sheets, presentational(e))
        return self.computed[e]

    def _value(self, value: str, won: css.Won) -> Value:
        return Value(value, (self.part, won.cite) if won.origin == css.AUTHOR else None)

    def _state(self, e: Element, state: State) -> State:
        style, new = self._style(e), {"pre": state.pre or e.name == "pre"}
        won = style.get("direction")
        if won and direction_of(won.value):
            new["direction"] = self._value(direction_of(won.value), won)
        elif e.attrs.get("dir", "").strip().lower() == "auto":
            new["direction"] = Value()
        if (won := style.get("text-align")) and (a := ALIGN.get(won.value.strip().lower())):
            new["alignment"] = self._value(a, won)
        if (won := style.get("font-family")) and (f := won.value.split(",")[0].strip().strip("\"'").strip()):
            new["font"] = self._value(f, won)
        if found := inset_of(style):
            new["inset"] = self._value(*found)
        tag = e.attrs.get("lang", e.attrs.get("xml:lang", "")).strip()
        if tag:
            new["language"] = Value(tag)
        if won := style.get("list-style-type") or style.get("list-style"):
            new["no_marker"] = "none" in won.value.split()
        return replace(state, **new)

    def _walk(self, e: Element, above: State) -> None:
        if e.name in NOT_PROSE:
            return
        if e.name == "head":
            for c in e.children:
                if isinstance(c, Element) and c.name == "title":
                    self._walk(c, above)
            return
        state, style, here = self._state(e, above), self._style(e), (self.part, f"{described(e)}@")
        if e.name == "table":
            self.count["tbl"] += 1
            self.tables.append([self.count["tbl"], 0, 0])
        if self.tables and e.name == "tr":
            self.tables[-1][1:] = [self.tables[-1][1] + 1, 0]
        if self.tables and e.name in ("td", "th"):
            self.tables[-1][2] += 1
        if e.block:
            self._paragraph(e, state)
        below = state.below(here)
        for c in e.children:
            if isinstance(c, Element):
                self._walk(c, below)
        if e.name == "table":
            self._container(e, state, "table", f"tbl{self.tables.pop()[0]}")
        turned = self._reversed(e, style)
        if turned or (columns_of(style) or 0) >= 2:
            if self._container(e, state, "columns", f"cols{self.count['cols'] + 1}", turned):
                self.count["cols"] += 1

    def _reversed(self, e: Element, style: dict[str, css.Won]) -> tuple[str, str] | None:
        flow = style.get("flex-direction") or style.get("flex-flow")
        if "display" not in style or style["display"].value.strip() not in ("flex", "inline-flex") or not flow or not {"row-reverse", "column-reverse"} & set(flow.value.split()):
            return None
        return (self.part, flow.cite if flow.origin == css.AUTHOR else f"{described(e)}@")

    def _collect(self, e: Element, out: Runs, spans: bool) -> None:
        for c in e.children:
            if isinstance(c, str):
                out.push(c)
            elif c.name in NOT_PROSE or c.block:
                continue
            elif c.name == "br":
                out.push(" ")
            elif not spans:
                self._collect(c, out, False)
            else:
                start = out.size + out.gap
                self._collect(c, out, True)
                if out.size > start:
                    out.spans.append({"offset": start, "len": out.size - start, **self._treatment(c)})

    def _treatment(self, e: Element) -> dict:
        style = self._style(e)
        won, origin = style.get("unicode-bidi"), (self.part, f"{described(e)}@")
        bidi, direction = "plain", None
        if won:
            value = won.value.strip().lower()
            if value in ("bidi-override", "isolate-override"):
                bidi, direction = "imposed", (direction_of(style["direction"].value) if "direction" in style else None) or "ltr"
            elif value in ("isolate", "plaintext"):
                bidi = "isolated"
            if won.origin == css.AUTHOR:
                origin = (self.part, won.cite)
        return {"bidi": bidi, "direction": direction, "origin": {"part": origin[0], "property": origin[1]}}

    def _unit(self, unit_id: str, kind: str, text: str, props: dict, spans: list, paragraph: int | None, container: str | None) -> None:
        blank = {n: UNSET for n in ("direction", "alignment", "inset", "language", "complex_font", "latin_font")} | {"bullet": "none", "reversed": None}
        self.units.append({"ord": len(self.units), "unit_id": f"{self.part}#{unit_id}", "kind": kind, "text": text, "props": blank | props, "spans": spans, "location": {"part": self.part, "paragraph": paragraph, "container": container}})

    def _paragraph(self, e: Element, state: State) -> None:
        runs = Runs(state.pre)
        self._collect(e, runs, True)
        text, spans = runs.done()
        if not text:
            return
        self.count["p"] += 1
        n, font = self.count["p"], state.font.row()
        bullet = ("suppressed" if state.no_marker else "native") if e.name == "li" else "none"
        props = {"direction": state.direction.row(), "alignment": state.alignment.row(), "inset": state.inset.row(), "language": state.language.row(), "complex_font": font, "latin_font": font, "bullet": bullet}
        where = "table {} row {} cell {}".format(*self.tables[-1]) if self.tables and all(self.tables[-1][1:]) else described(e)
        self._unit(f"p{n}", "paragraph", text, props, spans, n, where)

    def _container(self, e: Element, state: State, kind: str, unit_id: str, turned=None) -> bool:
        lines: list[str] = []
        self._boxes(e, state.pre, lines)
        if lines:
            origin = {"part": turned[0], "property": turned[1]} if turned else None
            self._unit(unit_id, kind, "\n".join(lines), {"direction": state.direction.row(), "reversed": origin}, [], None, None)
        return bool(lines)

    def _boxes(self, e: Element, pre: bool, lines: list[str]) -> None:
        runs = Runs(pre)
        self._collect(e, runs, False)
        if own := runs.done()[0]:
            lines.append(own)
        for c in e.children:
            if isinstance(c, Element) and c.block and c.name not in NOT_PROSE:
                self._boxes(c, pre, lines)


def units(pages: DataFrame, id_column: str, html_column: str, linked: dict[str, str] | None = None) -> DataFrame:
    """Units of a column of pages. A null page gives none; nothing else is read.

    ``linked`` has the text of local style sheets by path, relative to pages.
    """
    return _table(pages, id_column, html_column, linked, UNITS, _unit_rows)


def unread(pages: DataFrame, id_column: str, html_column: str, linked: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, ord, name) of style sheets that weren't read."""
    return _table(pages, id_column, html_column, linked, "doc_id string, ord bigint, name string", _unread_rows)


def _unit_rows(doc: str, page: Page) -> list[dict]:
    return [{"doc_id": doc, "format": "html", **u} for u in page.units]


def _unread_rows(doc: str, page: Page) -> list[dict]:
    return [{"doc_id": doc, "ord": k, "name": n} for k, n in enumerate(page.unread)]


def _table(pages, id_column, html_column, linked, schema, rows_of) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        read = (r for r in rows(batches) if r["html"] is not None)
        yield from batched((found for r in read for found in rows_of(r["doc_id"], Page("page.html", r["html"], linked))), kind)

    small_batches(pages.sparkSession)
    return pages.select(F.col(id_column).cast("string").alias("doc_id"), F.col(html_column).alias("html")).mapInArrow(run, schema)


def decoded(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows (path, content) as (path, html, error): UTF-8 or an error, never a guess."""
    ok = F.is_valid_utf8("content")
    return files.select("path", F.when(ok, F.decode("content", "UTF-8")).alias("html"), F.when(~ok, F.lit("not UTF-8")).alias("error"))
