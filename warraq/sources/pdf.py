"""The object layer of PDF files: objects, cross-references, pages and decoded streams."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACE, DELIMITER = b"\0\t\n\f\r ", b"()<>[]{}/%"
#: Cycle guards: hops of a reference, levels of the page tree, sections of the cross-reference chain.
MAX_HOPS, MAX_DEPTH, MAX_SECTIONS = 32, 64, 4096
IMAGES = frozenset(["DCTDecode", "DCT", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF"])
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")


class BadPdf(ValueError):
    pass


class Encrypted(BadPdf):
    pass


class Stopped(BadPdf):
    """A stream whose filter isn't decoded."""


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes


@dataclass
class Lexer:
    data: bytes
    at: int = 0

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in SPACE:
                self.at += 1
            elif d[self.at] == 0x25:
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def word(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in SPACE and self.data[self.at] not in DELIMITER:
            self.at += 1
        return self.data[start : self.at]

    def keyword(self, text: bytes) -> bool:
        self.skip()
        if self.data.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def value(self, depth: int = 0):
        self.skip()
        d = self.data
        if self.at >= len(d) or depth > 256:
            raise BadPdf("an object is missing")
        c = d[self.at : self.at + 1]
        if d.startswith(b"<<", self.at):
            return self._dict(depth)
        if c == b"/":
            self.at += 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self.word()).decode("utf-8", "replace"))
        if c == b"(":
            return self._literal()
        if c == b"<":
            end = d.find(b">", self.at)
            if end < 0:
                raise BadPdf("a string isn't closed")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while not self.keyword(b"]"):
                out.append(self.value(depth + 1))
            return out
        start, word = self.at, self.word()
        if re.fullmatch(rb"\d+", word):
            mark = self.at
            self.skip()
            generation = self.word()
            if re.fullmatch(rb"\d+", generation):
                self.skip()
                if self.word() == b"R":
                    return Ref(int(word), int(generation))
            self.at = mark
            return int(word)
        if re.fullmatch(rb"[+-]?\d+", word):
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            return float(word)
        if word in (b"true", b"false", b"null"):
            return {b"true": True, b"false": False, b"null": None}[word]
        self.at = start
        raise BadPdf(f"no object at {start}")

    def _dict(self, depth: int) -> dict:
        self.at += 2
        out = {}
        while not self.keyword(b">>"):
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                raise BadPdf("a key is no name")
            out[key.text] = self.value(depth + 1)
        return out

    def _literal(self) -> bytes:
        self.at += 1
        out, level, d = bytearray(), 1, self.data
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C:
                m = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                    continue
                e = d[self.at : self.at + 1]
                self.at += 1
                if e in b"\r\n":
                    self.at += e == b"\r" and d[self.at : self.at + 1] == b"\n"
                else:
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
                continue
            level += {0x28: 1, 0x29: -1}.get(c, 0)
            if not level:
                return bytes(out)
            out.append(c)
        raise BadPdf("a string isn't closed")

    def indirect(self, length_of=None) -> tuple[Ref, object]:
        self.skip()
        m = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj").match(self.data, self.at)
        if not m:
            raise BadPdf(f"no object at {self.at}")
        self.at = m.end()
        value = self.value()
        if isinstance(value, dict) and self.keyword(b"stream"):
            self.at += 2 if self.data[self.at : self.at + 2] == b"\r\n" else self.data[self.at : self.at + 1] in (b"\n", b"\r")
            length = value.get("Length")
            length = length_of(length) if isinstance(length, Ref) and length_of else length
            end = self.at + length if isinstance(length, int) else -1
            if end < self.at or not re.match(rb"\s*endstream", self.data[end : end + 20]):
                end = self.data.find(b"endstream", self.at)
                if end < 0:
                    raise BadPdf("a stream isn't closed")
                end -= self.data[end - 2 : end] == b"\r\n" and 2 or self.data[end - 1 : end] in (b"\n", b"\r")
            value = Stream(value, self.data[self.at : end])
            self.at = end
        return Ref(int(m[1]), int(m[2])), value


# ---- filters ----


def inflate(data: bytes) -> bytes:
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        try:
            return d.decompress(data) + d.flush()
        except zlib.error:
            continue
    d, out = zlib.decompressobj(15), b""
    try:
        for k in range(len(data)):  # what a damaged stream still gives
            out += d.decompress(data[k : k + 1])
    except zlib.error:
        pass
    if not out:
        raise BadPdf("a stream doesn't inflate")
    return out


def lzw(data: bytes, early: int = 1) -> bytes:
    out, table, width, bits, held, previous = bytearray(), [bytes([k]) for k in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            bits -= width
            code = (held >> bits) & ((1 << width) - 1)
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, previous = table[:258], 9, b""
                continue
            entry = table[code] if code < len(table) else previous + previous[:1] if code == len(table) and previous else None
            if entry is None:
                raise BadPdf("a code is out of range")
            out += entry
            if previous and len(table) < 4096:
                table.append(previous + entry[:1])
            previous = entry
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data.split(b"~>")[0]:
        if c in SPACE:
            continue
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - k) for k, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
        else:
            raise BadPdf("not base 85")
    if len(group) > 1:
        full = group + [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - k) for k, v in enumerate(full)) & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def predicted(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, depth, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data), width + (kind >= 10)):
        tag = data[at] if kind >= 10 else None
        row = bytearray(data[at + (kind >= 10) : at + (kind >= 10) + width])
        for k in range(len(row)):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            if kind == 2:
                row[k] = (row[k] + a) & 255 if depth == 8 else row[k]
            elif tag == 4:
                p = a + b - c
                row[k] = (row[k] + min((a, b, c), key=lambda x: (abs(p - x), (a, b, c).index(x)))) & 255
            else:
                row[k] = (row[k] + (0, a, b, (a + b) // 2)[tag if tag in (0, 1, 2, 3) else 0]) & 255
        above = bytes(row) + bytes(width - len(row))
        out += row
    return bytes(out)


def decoded(stream: Stream, resolve=lambda x: x) -> bytes:
    """The stream through all its filters; image codecs, Crypt and unknown filters stop it."""
    as_list = lambda v: v if isinstance(v, list) else [] if v is None else [v]
    filters = [resolve(f) for f in as_list(resolve(stream.dict.get("Filter", stream.dict.get("F"))))]
    parms = [resolve(p) or {} for p in as_list(resolve(stream.dict.get("DecodeParms", stream.dict.get("DP"))))]
    data = stream.raw
    for k, f in enumerate(filters):
        p = parms[k] if k < len(parms) else {}
        name = f.text if isinstance(f, Name) else str(f)
        if name in ("FlateDecode", "Fl"):
            data = predicted(inflate(data), p)
        elif name in ("LZWDecode", "LZW"):
            data = predicted(lzw(data, p.get("EarlyChange", 1)), p)
        elif name in ("ASCIIHexDecode", "AHx"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
            data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif name in ("ASCII85Decode", "A85"):
            data = ascii85(data)
        elif name in ("RunLengthDecode", "RL"):
            data = run_length(data)
        elif name != "Identity":
            raise Stopped(name)
    return data


# ---- documents ----


@dataclass
class Pdf:
    """A file's objects. ``reconstructed`` says why the cross-references weren't used."""

    data: bytes
    trailer: dict = field(default_factory=dict)
    objects: dict = field(default_factory=dict)
    generations: dict = field(default_factory=dict)
    slots: dict = field(default_factory=dict)
    reconstructed: str | None = None
    unread: list = field(default_factory=list)

    def __post_init__(self) -> None:
        m = re.search(rb"%PDF-(\d\.\d)", self.data[:1024])
        if not m:
            raise BadPdf("no PDF header")
        self.version, self.shift = m[1].decode(), m.start()
        try:
            self._chain()
            if not isinstance(self.trailer.get("Root"), Ref):
                raise BadPdf("no catalog")
        except (BadPdf, ValueError, IndexError) as e:
            self._recover(str(e))
        if "Encrypt" in self.trailer:
            raise Encrypted(self.described(self.resolve(self.trailer["Encrypt"])))
        for number in sorted(self.slots):
            self.load(number)
        if not isinstance(self.resolve(self.trailer.get("Root")), dict) and not self.reconstructed:
            self._recover("the catalog is missing")
            for number in sorted(self.slots):
                self.load(number)
        self.unread = sorted(set(self.unread))

    @staticmethod
    def described(e) -> str:
        """A sentence on the encryption of a file."""
        e = e if isinstance(e, dict) else {}
        v, length = e.get("V", 0), e.get("Length", 40)
        how = {1: "RC4, 40 bits", 2: f"RC4, {length} bits", 4: "crypt filters", 5: "AES, 256 bits"}.get(v, f"unknown algorithm {v}")
        return f"encrypted: {how}"

    def _chain(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        if at < 0:
            raise BadPdf("no startxref")
        m = re.match(rb"startxref\s+(\d+)", self.data[at : at + 40])
        todo, seen = [int(m[1])] if m else [], set()
        while todo and len(seen) < MAX_SECTIONS:
            where = todo.pop(0)
            if where in seen:
                continue
            seen.add(where)
            trailer = self._section(where + self.shift)
            self.trailer = {**trailer, **self.trailer}
            todo += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _section(self, at: int) -> dict:
        lexer = Lexer(self.data, at)
        if not lexer.keyword(b"xref"):
            _, value = lexer.indirect()
            if not isinstance(value, Stream):
                raise BadPdf("no cross-reference section")
            body, w = decoded(value), value.dict["W"]
            index = value.dict.get("Index", [0, value.dict.get("Size", 0)])
            at, size = 0, sum(w)
            for first_number, n in zip(index[::2], index[1::2], strict=True):
                for number in range(first_number, first_number + n):
                    row = body[at : at + size]
                    at += size
                    if len(row) < size:
                        break
                    cuts = [int.from_bytes(row[sum(w[:k]) : sum(w[: k + 1])], "big") for k in range(3)]
                    kind = cuts[0] if w[0] else 1
                    if kind == 1:
                        self.slots.setdefault(number, ("at", cuts[1], cuts[2]))
                    elif kind == 2:
                        self.slots.setdefault(number, ("in", cuts[1], cuts[2]))
                    else:
                        self.slots.setdefault(number, ("free", 0, 0))
            return value.dict
        while not lexer.keyword(b"trailer"):
            lexer.skip()
            m = re.compile(rb"(\d+)\s+(\d+)").match(self.data, lexer.at)
            if not m:
                raise BadPdf("no trailer")
            lexer.at = m.end()
            for number in range(int(m[1]), int(m[1]) + int(m[2])):
                lexer.skip()
                e = re.compile(rb"(\d{1,10})\s+(\d{1,5})\s+([nf])").match(self.data, lexer.at)
                if not e:
                    raise BadPdf("a damaged entry")
                lexer.at = e.end()
                self.slots.setdefault(number, ("at", int(e[1]), int(e[2])) if e[3] == b"n" else ("free", 0, 0))
        return lexer.value()

    def _recover(self, why: str) -> None:
        """Find objects by scanning for their headers; the last of a number wins."""
        self.reconstructed, self.slots, self.objects = why, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", self.data):
            self.slots[int(m[1])] = ("at", m.start() - self.shift, int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                found = Lexer(self.data, m.end()).value()
                self.trailer = {**self.trailer, **found} if isinstance(found, dict) else self.trailer
            except BadPdf:
                continue
        for number in sorted(self.slots):
            value = self.load(number)
            if isinstance(value, Stream) and value.dict.get("Type") == Name("XRef"):
                self.trailer = {**value.dict, **self.trailer}
            if isinstance(value, Stream) and value.dict.get("Type") == Name("ObjStm"):
                for k, inner in enumerate(self._inner_numbers(value)):
                    self.slots.setdefault(inner, ("in", number, k))
            if isinstance(value, dict) and value.get("Type") == Name("Catalog") and not isinstance(self.trailer.get("Root"), Ref):
                self.trailer["Root"] = Ref(number)
        if not isinstance(self.trailer.get("Root"), Ref) and not any(isinstance(v, dict) for v in self.objects.values()):
            raise BadPdf(why)

    def load(self, number: int):
        if number in self.objects:
            return self.objects[number]
        kind, where, extra = self.slots.get(number, ("free", 0, 0))
        self.objects[number] = None
        try:
            if kind == "at":
                ref, value = Lexer(self.data, where + self.shift).indirect(lambda r: self.resolve(r))
                if ref.number == number:
                    self.objects[number], self.generations[number] = value, ref.generation
                else:
                    raise BadPdf("another object")
            elif kind == "in":
                holder = self.load(where)
                if isinstance(holder, Stream):
                    numbers, body = self._inner_numbers(holder), decoded(holder, self.resolve)
                    if number in numbers:
                        offsets = [int(x) for x in body[: holder.dict["First"]].split()][1::2]
                        self.objects[number] = Lexer(body, holder.dict["First"] + offsets[numbers.index(number)]).value()
        except (BadPdf, KeyError, IndexError, ValueError) as e:
            self.unread.append(f"object {number}: {e}")
        return self.objects[number]

    def _inner_numbers(self, holder: Stream) -> list[int]:
        try:
            return [int(x) for x in decoded(holder, self.resolve)[: holder.dict["First"]].split()][::2]
        except (BadPdf, KeyError, ValueError):
            return []

    def resolve(self, value):
        for _ in range(MAX_HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.load(value.number)
        return None

    def pages(self) -> list[dict]:
        """Page dictionaries with their inherited attributes; without a tree, every page object by number."""
        out, seen = [], set()

        def walk(node, given: dict, depth: int) -> None:
            d = self.resolve(node)
            key = node.number if isinstance(node, Ref) else id(node)
            if not isinstance(d, dict) or key in seen or depth > MAX_DEPTH:
                return
            seen.add(key)
            given = given | {k: d[k] for k in INHERITED if k in d}
            if d.get("Type") == Name("Page") or "Kids" not in d:
                out.append(given | d)
                return
            for kid in self.resolve(d["Kids"]) or []:
                walk(kid, given, depth + 1)

        root = self.resolve(self.trailer.get("Root"))
        if isinstance(root, dict) and "Pages" in root:
            walk(root["Pages"], {}, 0)
        return out or [v for _, v in sorted(self.objects.items()) if isinstance(v, dict) and v.get("Type") == Name("Page")]

    def content(self, page: dict) -> bytes:
        """The page's content streams, decoded and joined by line ends."""
        given = self.resolve(page.get("Contents"))
        parts = [self.resolve(x) for x in given] if isinstance(given, list) else [given]
        out = []
        for p in parts:
            if isinstance(p, Stream):
                try:
                    out.append(decoded(p, self.resolve))
                except Stopped as e:
                    self.unread.append(f"content: {e}")
        return b"\n".join(out)


PAGES = "path string, version string, page int, content binary, objects int, reconstructed string, unread array<string>, error string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A row per page of all PDF files under a path; a file that can't be read gives one row with its error."""
    kind = pa.schema([("path", pa.string()), ("version", pa.string()), ("page", pa.int32()), ("content", pa.binary()), ("objects", pa.int32()), ("reconstructed", pa.string()), ("unread", pa.list_(pa.string())), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                name = b.column("path")[k].as_py()
                try:
                    pdf = Pdf(b.column("content")[k].as_py())
                    pages = [{"path": name, "version": pdf.version, "page": n, "content": pdf.content(p), "objects": sum(v is not None for v in pdf.objects.values()), "reconstructed": pdf.reconstructed} for n, p in enumerate(pdf.pages(), start=1)]
                    rows = [r | {"unread": sorted(set(pdf.unread))} for r in pages] or [{"path": name, "version": pdf.version, "unread": pdf.unread}]
                except BadPdf as e:
                    rows = [{"path": name, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    return files.select("path", "content").mapInArrow(run, PAGES)
