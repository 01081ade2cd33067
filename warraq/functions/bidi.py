"""The bidirectional algorithm (UAX #9) and functions over Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .unicode import bracket_pairs

RTL, LTR = "rtl", "ltr"
MAX_DEPTH = 125
#: A byte for each class, so that a rule is an operation on bytes.
CODES = {"L": b"L", "R": b"R", "AL": b"a", "EN": b"E", "AN": b"N", "ES": b"s", "CS": b"c", "ET": b"t", "NSM": b"M", "WS": b"w", "ON": b"O", "B": b"B", "S": b"S", "BN": b"b", "LRE": b"1", "RLE": b"2", "LRO": b"3", "RLO": b"4", "PDF": b"5", "LRI": b"6", "RLI": b"7", "FSI": b"8", "PDI": b"9"}
_WEAK = bytes.maketrans(b"stc", b"OOO")
_NEUTRAL = bytes.maketrans(b"BSwO6789", b"nnnnnnnn")
BRACKETS = bracket_pairs()
CLOSING = {v: k for k, v in BRACKETS.items()}
FSI, PDI = "⁨", "⁩"


def bidi_class(c: str) -> str:
    return unicodedata.bidirectional(c) or ("AL" if "؀" <= c <= "޿" or "ࢠ" <= c <= "ࣿ" else "R" if "֐" <= c <= "ࣿ" else "L")


_BRACKET = re.compile("[" + re.escape("".join(BRACKETS) + "".join(CLOSING)) + "]")
_codes = np.zeros(0x110000, np.uint8)


def classes_of(text: str) -> bytes:
    """A byte of ``CODES`` for each character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = _codes[points]
    if not out.all():
        for p in np.unique(points[out == 0]):
            _codes[p] = CODES[bidi_class(chr(p))][0]
        out = _codes[points]
    return out.tobytes()


def _paragraph(text: str) -> tuple[str, bytes]:
    """Up to and with the first paragraph separator, and the classes of that."""
    classes = classes_of(text)
    at = classes.find(b"B")
    if at >= 0:
        # a carriage return and a line feed are one separator
        at += 2 if text[at : at + 2] == "\r\n" else 1
        text, classes = text[:at], classes[:at]
    return text, classes


def first_paragraph(text: str) -> str:
    return _paragraph(text)[0]


def _matching(classes: bytes) -> dict[int, int]:
    """Isolate initiators to their terminators."""
    stack, out = [], {}
    for m in re.finditer(rb"[6-9]", classes):
        if m[0] != b"9":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _first_strong(classes: bytes, start: int, end: int, match: dict[int, int]) -> str | None:
    """The first strong class outside isolates (rules P2 and P3)."""
    strong = re.compile(rb"[LRa678]")
    while m := strong.search(classes, start, end):
        if m[0] in b"LRa":
            return LTR if m[0] == b"L" else RTL
        start = match.get(m.start(), end)
    return None


def _auto(classes: bytes) -> str:
    return _first_strong(classes, 0, len(classes), _matching(classes)) or LTR


def auto_direction(text: str) -> str:
    return _auto(_paragraph(text)[1])


def levels(text: str, base: str) -> list[int]:
    """The embedding level of each character of one paragraph."""
    return list(_levels(text, classes_of(text), base))


def _levels(text: str, original: bytes, base: str) -> bytearray:
    n, para = len(text), 1 if base == RTL else 0
    out = bytearray([para]) * n
    classes, match = original, {}
    if re.search(rb"[1-9]", original):
        match = _matching(original)
        classes = _explicit(original, out, para, match)
    embedded = bytes(out)
    # X10: level runs, joined through isolates, without what X9 removes
    runs = _level_runs(original, embedded)
    closers, starts = set(match.values()), {r[0][0]: k for k, r in enumerate(runs)} if match else {}
    for k, r in enumerate(runs):
        if r[0][0] in closers:
            continue
        sequence, last = list(r), k
        while (end := sequence[-1][1] - 1) in match and match[end] in starts:
            last = starts[match[end]]
            sequence += runs[last]
        low = embedded[runs[k - 1][-1][1] - 1] if k else para
        unmatched = original[end : end + 1] in (b"6", b"7", b"8") and end not in match
        high = embedded[runs[last + 1][0][0]] if last + 1 < len(runs) and not unmatched else para
        _resolve(text, sequence, classes, original, out, embedded[r[0][0]], low, high)
    # L1
    reset, done = bytearray(n), 0
    for at in [*(m.start() for m in re.finditer(rb"[BS]", original)), n]:
        k, stop = at, min(at + 1, n)
        while k > done and original[k - 1] in b"bw123456789":
            k -= 1
        out[k:stop], reset[k:stop] = bytes([para]) * (stop - k), b"\1" * (stop - k)
        done = stop
    # what X9 removes takes the level before it, so that it moves with its neighbours
    for m in re.finditer(rb"[b1-5]+", original):
        a, b = m.span()
        if not reset[a]:
            out[a:b] = bytes([out[a - 1] if a else para]) * (b - a)
    return out


def _explicit(original: bytes, out: bytearray, para: int, match: dict[int, int]) -> bytes:
    """Rules X1 to X8: writes the levels, returns the classes under overrides."""
    classes, n = bytearray(original), len(original)
    stack: list[tuple[int, bytes | None, bool]] = [(para, None, False)]
    over_isolates = over_embeddings = valid_isolates = at = 0

    def fill(a: int, b: int) -> None:
        level, override, _ = stack[-1]
        out[a:b] = bytes([level]) * (b - a)
        if override:
            classes[a:b] = override * (b - a)

    for m in re.finditer(rb"[1-9]", original):
        k, c = m.start(), m[0]
        fill(at, k)
        at = k + 1
        if c in b"1234":
            out[k] = level = stack[-1][0]
            new = (level + 1) | 1 if c in b"24" else (level + 2) & ~1
            if new <= MAX_DEPTH and not over_isolates and not over_embeddings:
                stack.append((new, {b"3": b"L", b"4": b"R"}.get(c), False))
            elif not over_isolates:
                over_embeddings += 1
        elif c in b"678":
            fill(k, k + 1)
            level = stack[-1][0]
            rtl = c == b"7" or c == b"8" and _first_strong(original, k + 1, match.get(k, n), match) == RTL
            new = (level + 1) | 1 if rtl else (level + 2) & ~1
            if new <= MAX_DEPTH and not over_isolates and not over_embeddings:
                valid_isolates += 1
                stack.append((new, None, True))
            else:
                over_isolates += 1
        elif c == b"9":
            if over_isolates:
                over_isolates -= 1
            elif valid_isolates:
                over_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid_isolates -= 1
            fill(k, k + 1)
        else:
            out[k] = stack[-1][0]
            if not over_isolates:
                if over_embeddings:
                    over_embeddings -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
    fill(at, n)
    for m in re.finditer(rb"[Bb]", original):
        k = m.start()
        classes[k] = original[k]
        if m[0] == b"B":
            out[k] = para
    return bytes(classes)


def _level_runs(original: bytes, embedded: bytes) -> list[list[tuple[int, int]]]:
    """Runs of one level as lists of (start, end), which leave out what X9 removes."""
    runs: list[list[tuple[int, int]]] = []
    for kept in re.finditer(rb"[^b1-5]+", original):
        a, b = kept.span()
        while a < b:
            level = embedded[a : a + 1]
            end = a + len(embedded[a:b]) - len(embedded[a:b].lstrip(level))
            if runs and embedded[runs[-1][-1][1] - 1] == level[0]:
                runs[-1].append((a, end))
            else:
                runs.append([(a, end)])
            a = end
    return runs


@lru_cache(maxsize=2 * MAX_DEPTH)
def _implicit(level: int) -> bytes:
    """Rules I1 and I2: classes to levels."""
    up = {b"L": 1, b"R": 0, b"E": 1, b"N": 1} if level % 2 else {b"L": 0, b"R": 1, b"E": 2, b"N": 2}
    return bytes.maketrans(b"".join(up), bytes(level + k for k in up.values()))


def _resolve(text: str, seq, classes: bytes, original: bytes, out: bytearray, level: int, low: int, high: int) -> None:
    """Rules W1 to W7, N0 to N2, I1 and I2 on one isolating run sequence. The classes stand between those of its edges."""
    sos, eos, embedding = (b"R" if x % 2 else b"L" for x in (max(level, low), max(level, high), level))
    t = sos + b"".join(classes[a:b] for a, b in seq) + eos
    if b"M" in t:  # W1
        t = re.sub(rb"([^M])(M+)", lambda m: m[1] + (b"O" if m[1] in b"6789" else m[1]) * len(m[2]), t)
    if b"a" in t:  # W2 and W3
        t = re.sub(rb"a[^RL]*", lambda m: m[0].replace(b"E", b"N"), t).replace(b"a", b"R")
    t = re.sub(rb"(?<=N)c(?=N)", b"N", re.sub(rb"(?<=E)[sc](?=E)", b"E", t))  # W4
    if b"t" in t and b"E" in t:  # W5
        t = re.sub(rb"t+", lambda m: b"E" * len(m[0]) if b"E" in (t[m.start() - 1 : m.start()], t[m.end() : m.end() + 1]) else m[0], t)
    t = t.translate(_WEAK)  # W6
    if b"E" in t:  # W7
        t = re.sub(rb"L[^R]*", lambda m: m[0].replace(b"E", b"L"), t)
    chars = "".join(text[a:b] for a, b in seq)
    if _BRACKET.search(chars):
        t = _brackets(chars, t, b"".join(original[a:b] for a, b in seq), embedding)
    t = t.translate(_NEUTRAL)
    for x in (b"L", b"R"):  # N1, the most frequent cases at once
        for k in (1, 2):
            for _ in range(2):
                t = t.replace(x + b"n" * k + x, x * (k + 2))
    if b"n" in t:  # N1 and N2
        strong = lambda k: b"L" if t[k : k + 1] == b"L" else b"R"
        t = re.sub(rb"n+", lambda m: (left if (left := strong(m.start() - 1)) == strong(m.end()) else embedding) * len(m[0]), t)
    at, t = 0, t[1:-1].translate(_implicit(level))
    for a, b in seq:
        out[a:b] = t[at : at + b - a]
        at += b - a


def _brackets(chars: str, edged: bytes, original: bytes, embedding: bytes) -> bytes:
    """Rule N0."""
    t, stack, pairs = bytearray(edged), [], []
    for m in _BRACKET.finditer(chars):
        i, c = m.start(), m[0]
        if edged[i + 1 : i + 2] != b"O":
            continue
        if c in BRACKETS:
            if len(stack) == 63:
                break
            stack.append((BRACKETS[c], i))
        else:
            for j in range(len(stack) - 1, -1, -1):
                if unicodedata.normalize("NFC", stack[j][0]) == unicodedata.normalize("NFC", c):
                    pairs.append((stack[j][1], i))
                    del stack[j:]
                    break
    other = b"L" if embedding == b"R" else b"R"
    has = lambda strong, a, b: any(t.find(x, a, b) >= 0 for x in ((b"L",) if strong == b"L" else (b"R", b"E", b"N")))
    for a, b in sorted(pairs):
        if has(embedding, a + 2, b + 1):
            new = embedding
        elif has(other, a + 2, b + 1):
            before = max(t.rfind(x, 0, a + 1) for x in (b"L", b"R", b"E", b"N"))
            new = b"L" if t[before : before + 1] == b"L" else b"R"
        else:
            continue
        for x in (a, b):
            end = x + 1
            while original[end : end + 1] == b"M":
                end += 1
            t[x + 1 : end + 1] = new * (end - x)
    return bytes(t)


def visual(text: str, base: str) -> str:
    """The first paragraph in display order under a base direction (rule L2). Brackets aren't mirrored, and controls stay."""
    return _visual(*_paragraph(text), base)


def _visual(para: str, classes: bytes, base: str) -> str:
    lv = np.frombuffer(bytes(_levels(para, classes, base)), np.uint8)
    odd = lv[lv % 2 == 1]
    if not len(odd):
        return para
    cuts = [0, *(np.flatnonzero(np.diff(lv)) + 1).tolist(), len(para)]
    runs = [(int(lv[a]), para[a:b]) for a, b in zip(cuts, cuts[1:])]
    runs = [(level, part[::-1] if level % 2 else part) for level, part in runs]
    for level in range(int(lv.max()), int(odd.min()) - 1, -1):
        k = 0
        while k < len(runs):
            j = k
            while j < len(runs) and runs[j][0] >= level:
                j += 1
            runs[k:j] = runs[k:j][::-1]
            k = j + 1
    return "".join(part for _, part in runs)


def order_differs(text: str, a: str, b: str) -> bool:
    return a != b and visual(text, a) != visual(text, b)


def imposed(text: str, direction: str) -> str:
    return text[::-1] if direction == RTL else text


def visual_isolating(text: str, base: str, offset: int, length: int) -> str | None:
    """As if the bytes from ``offset`` stood in an isolate; None where they don't begin and end at characters."""
    data = text.encode()
    if offset < 0 or length < 0 or offset + length > len(data):
        return None
    try:
        a, b, c = data[:offset].decode(), data[offset : offset + length].decode(), data[offset + length :].decode()
    except UnicodeDecodeError:
        return None
    return visual(a + FSI + b + PDI + c, base).replace(FSI, "").replace(PDI, "")


#: Texts that a worker holds as Python objects at once.
SLICE = 256


def _by_slices(each, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``each`` of every row, a slice at a time, so that a batch of long texts is never there as objects."""
    out = [pa.array([each(*row) for row in zip(*(c.slice(k, SLICE).to_pylist() for c in columns), strict=True)], kind) for k in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


ORDERS = pa.struct([("auto", pa.string()), ("rtl", pa.string()), ("ltr", pa.string())])


def _order(text: str | None) -> dict | None:
    if text is None:
        return None
    para, classes = _paragraph(text)
    return {"auto": _auto(classes), "rtl": _visual(para, classes, RTL), "ltr": _visual(para, classes, LTR)}


@F.arrow_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("auto", "rtl", "ltr")]))
def _orders(texts: pa.Array) -> pa.Array:
    return _by_slices(_order, ORDERS, texts)


def orders(text: Column) -> Column:
    """A struct of the first-strong direction and both display orders; null for null. Pass null where no order is needed."""
    return _orders(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _isolated(texts: pa.Array, bases: pa.Array, spans: pa.Array) -> pa.Array:
    each = lambda t, b, s: None if t is None or s is None else [None if x is None else visual_isolating(t, b, x["offset"], x["len"]) for x in s]
    return _by_slices(each, pa.list_(pa.string()), texts, bases, spans)


def isolated_orders(text: Column, base: Column, spans: Column) -> Column:
    """For each span (offset, len in bytes) the display order of the whole text with that span isolated."""
    return _isolated(text, base, spans)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _each(texts: pa.Array, bases: pa.Array) -> pa.Array:
    each = lambda t, b: None if t is None else [None if x is None else visual(x, d) for x, d in zip(t, b, strict=True)]
    return _by_slices(each, pa.list_(pa.string()), texts, bases)


def each_order(texts: Column, bases: Column) -> Column:
    """The display order of each text of an array under the direction beside it."""
    return _each(texts, bases)
