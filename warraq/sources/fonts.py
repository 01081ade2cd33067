"""Font files: names, covered characters and single substitutions of the joining features."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import unicode as u

#: A name table beyond this is not a name table.
MAX_NAMES = 1 << 20
JOINING_FEATURES = ("init", "medi", "fina", "isol")
REGULAR = ("regular", "normal", "book", "roman", "")
FACES = "path string, face int, families array<string>, subfamily string, regular boolean, covered array<string>, shapes array<struct<ch:string,feature:string>>, readable boolean"


class BadFont(ValueError):
    pass


def _u16(data: bytes, at: int) -> int:
    try:
        return struct.unpack_from(">H", data, at)[0]
    except struct.error as e:
        raise BadFont("cut off") from e


def _u32(data: bytes, at: int) -> int:
    try:
        return struct.unpack_from(">I", data, at)[0]
    except struct.error as e:
        raise BadFont("cut off") from e


def directories(data: bytes) -> list[dict[str, tuple[int, int]]]:
    """The table directory of each face: tag to (offset, length)."""
    starts = [_u32(data, 12 + 4 * k) for k in range(_u32(data, 8))] if data[:4] == b"ttcf" else [0]
    out = []
    for s in starts:
        if data[s : s + 4] not in (b"\0\1\0\0", b"OTTO", b"true"):
            raise BadFont("no font")
        out.append({data[at : at + 4].decode("latin-1"): (_u32(data, at + 8), _u32(data, at + 12)) for at in range(s + 12, s + 12 + 16 * _u16(data, s + 4), 16)})
    return out


def names(table: bytes) -> tuple[list[str], str]:
    """Family names in all languages, typographic ones too, and the subfamily."""
    families, sub = [], ""
    base = _u16(table, 4)
    for k in range(_u16(table, 2)):
        platform, encoding, _, name_id, length, offset = struct.unpack_from(">6H", table, 6 + 12 * k)
        raw = table[base + offset : base + offset + length]
        if platform in (0, 3):
            text = raw.decode("utf-16-be", "replace")
        elif platform == 1 and encoding == 0:
            text = raw.decode("mac-roman", "replace")
        else:
            continue
        if name_id in (1, 16) and text and text not in families:
            families.append(text)
        if name_id in (2, 17) and text and not sub:
            sub = text
    return families, sub


def cmap(data: bytes) -> dict[int, int]:
    """Codepoint to glyph, from subtables of formats 4 and 12."""
    best: dict[int, int] = {}
    for k in range(_u16(data, 2)):
        platform, encoding, at = _u16(data, 4 + 8 * k), _u16(data, 6 + 8 * k), _u32(data, 8 + 8 * k)
        if platform not in (0, 3) or platform == 3 and encoding not in (1, 10):
            continue
        if _u16(data, at) == 4:
            n = _u16(data, at + 6) // 2
            for s in range(n):
                end, start = _u16(data, at + 14 + 2 * s), _u16(data, at + 16 + 2 * n + 2 * s)
                delta, where = _u16(data, at + 16 + 4 * n + 2 * s), at + 16 + 6 * n + 2 * s
                offset = _u16(data, where)
                for c in range(start, min(end, 0xFFFE) + 1):
                    g = (c + delta) & 0xFFFF if not offset else _u16(data, where + offset + 2 * (c - start))
                    if offset and g:
                        g = (g + delta) & 0xFFFF
                    if g:
                        best.setdefault(c, g)
        elif _u16(data, at) == 12:
            for s in range(_u32(data, at + 12)):
                start, end, g = (_u32(data, at + 16 + 12 * s + 4 * x) for x in range(3))
                for c in range(start, min(end, 0x10FFFF) + 1):
                    if g + c - start:
                        best.setdefault(c, g + c - start)
    return best


def substitutions(gsub: bytes) -> tuple[dict[str, set[int]], bool]:
    """Glyphs that each joining feature replaces singly, and whether nothing more complex stands behind the features."""
    out: dict[str, set[int]] = {f: set() for f in JOINING_FEATURES}
    simple = True
    features, lookups = _u16(gsub, 6), _u16(gsub, 8)
    for k in range(_u16(gsub, features)):
        at = features + 2 + 6 * k
        feature, where = gsub[at : at + 4].decode("latin-1"), features + _u16(gsub, at + 4)
        if feature not in out:
            continue
        for i in range(_u16(gsub, where + 2)):
            look = lookups + _u16(gsub, lookups + 2 + 2 * _u16(gsub, where + 4 + 2 * i))
            kind = _u16(gsub, look)
            for s in range(_u16(gsub, look + 4)):
                sub, real = look + _u16(gsub, look + 6 + 2 * s), kind
                if kind == 7:
                    real, sub = _u16(gsub, sub + 2), sub + _u32(gsub, sub + 4)
                if real == 1:
                    out[feature] |= _covered(gsub, sub + _u16(gsub, sub + 2))
                else:
                    simple = False
    return out, simple


def _covered(data: bytes, at: int) -> set[int]:
    if _u16(data, at) == 1:
        return {_u16(data, at + 4 + 2 * k) for k in range(_u16(data, at + 2))}
    return {g for k in range(_u16(data, at + 2)) for g in range(_u16(data, at + 4 + 6 * k), _u16(data, at + 6 + 6 * k) + 1)}


def faces(path: str, data: bytes) -> list[dict]:
    """A row per face. Covered characters are those of the Arabic blocks and ASCII; ``readable`` tells whether the joining features could be read."""
    out = []
    for k, tables in enumerate(directories(data)):
        cut = lambda t, tables=tables: data[tables[t][0] : tables[t][0] + tables[t][1]] if t in tables else b""
        table = cut("name")
        families, sub = names(table) if 6 <= len(table) <= MAX_NAMES else ([], "")
        glyphs = cmap(cut("cmap")) if "cmap" in tables else {}
        subs, simple = substitutions(cut("GSUB")) if "GSUB" in tables else ({}, True)
        arabic = [c for low, high in u.ARABIC_BLOCKS for c in range(low, high + 1) if c in glyphs]
        shapes = [{"ch": chr(c), "feature": f} for c in arabic for f, own in subs.items() if glyphs[c] in own]
        out.append({"path": path, "face": k, "families": families, "subfamily": sub, "regular": sub.strip().lower() in REGULAR, "covered": [chr(c) for c in arabic], "shapes": shapes, "readable": simple})
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Faces of all font files under a directory; files that aren't fonts give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(FACES))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                try:
                    rows = faces(b.column("path")[k].as_py(), b.column("content")[k].as_py())
                except BadFont:
                    continue
                yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ttf,otf,ttc,otc,TTF,OTF,TTC,OTC}").load(path)
    return files.select("path", "content").mapInArrow(run, FACES)
