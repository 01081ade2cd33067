"""Attribute values of the document formats, to the shared vocabulary and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alignment words of each format.
ALIGNMENT = {
    "pptx": {"l": "left", "r": "right", "ctr": "center", "just": "justify", "justLow": "justify", "dist": "distributed", "thaiDist": "distributed"},
    "docx": {"start": "start", "left": "start", "numTab": "start", "end": "end", "right": "end", "center": "center", "both": "justify", "lowKashida": "justify", "mediumKashida": "justify", "highKashida": "justify", "distribute": "distributed", "thaiDistribute": "distributed"},
    "xlsx": {"left": "left", "right": "right", "center": "center", "justify": "justify", "distributed": "distributed"},
    "html": {"left": "left", "right": "right", "center": "center", "centre": "center", "justify": "justify", "justify-all": "justify", "start": "start", "end": "end"},
}
READING_ORDER = {"1": "ltr", "2": "rtl"}


def lookup(table: dict[str, str], key: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def alignment(fmt: str, value: Column) -> Column:
    return lookup(ALIGNMENT[fmt], F.lower(F.trim(value)) if fmt == "html" else value)


def lowered_alignment(fmt: str, value: Column, rtl: Column) -> Column:
    """The word that a format writes for an alignment; start and end turn with the direction where a format has edges only. Null: it has none."""
    edge = F.when(value == "start", F.when(rtl, "right").otherwise("left")).when(value == "end", F.when(rtl, "left").otherwise("right")).otherwise(value)
    if fmt == "pptx":
        return lookup({"left": "l", "right": "r", "center": "ctr", "justify": "just", "distributed": "dist"}, edge)
    if fmt == "docx":
        return lookup({"start": "start", "end": "end", "center": "center", "justify": "both", "distributed": "distribute"}, value)
    if fmt == "xlsx":
        return lookup({x: x for x in ("left", "right", "center", "justify", "distributed")}, edge)
    raise ValueError(f"{fmt} isn't written")


def reading_order(value: Column) -> Column:
    return lookup(READING_ORDER, value)


def direction(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).isin("rtl", "ltr"), F.lower(F.trim(value)))


def first_family(stack: Column) -> Column:
    """The first family of a font stack, without quotes; null if there is none."""
    return F.nullif(F.trim(F.translate(F.trim(F.split(stack, ",")[0]), "\"'", "")), F.lit(""))


def column_count(count: Column, columns: Column) -> Column:
    """``column-count``, else a whole number in ``columns``."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"(?:^|\s)(\d+)(?:\s|$)", 1), F.lit("")).cast("int")
    return F.coalesce(number(count), number(columns))


def inset(left: Column, right: Column, start: Column, end: Column) -> Column:
    """The one side on which a box is inset; null where none or both are."""
    some = lambda c: F.coalesce(F.regexp_extract(c, r"^\s*(-?[0-9.]+)", 1).try_cast("double") != 0, F.lit(False))
    return F.when(some(left) & ~some(right), "left").when(some(right) & ~some(left), "right").when(some(start) & ~some(end), "start").when(some(end) & ~some(start), "end")


def describe(name: Column, id_: Column, classes: Column) -> Column:
    """name#id, name.class or name."""
    one = F.split(F.trim(classes), r"\s+")[0]
    return F.concat(name, F.when(F.coalesce(id_, F.lit("")) != "", F.concat(F.lit("#"), id_)).when(F.coalesce(one, F.lit("")) != "", F.concat(F.lit("."), one)).otherwise(""))


def outline_level(value: Column) -> Column:
    """A paragraph level from 0 to 8."""
    return F.least(F.greatest(F.coalesce(value.try_cast("int"), F.lit(0)), F.lit(0)), F.lit(8))


def theme_reference(typeface: Column) -> Column:
    """A struct (font, script) of a reference such as +mn-cs; null for a plain typeface."""
    font = lookup({"mj": "major", "mn": "minor"}, F.regexp_extract(typeface, r"^\+(m[jn])-(lt|ea|cs)$", 1))
    script = lookup({"lt": "latin", "ea": "ea", "cs": "cs"}, F.regexp_extract(typeface, r"^\+(m[jn])-(lt|ea|cs)$", 2))
    return F.when(font.isNotNull(), F.struct(font.alias("font"), script.alias("script")))


def fold_family(name: Column) -> Column:
    return F.lower(F.trim(name))


def collapse_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def unit_id_parts(unit_id: Column) -> Column:
    """A struct (part, kind, number) of an id such as slide1.xml#p3; null for a foreign id or a number below 1."""
    pattern = r"^(.+)#(p|tbl|cols|catax|legend|dlbls|c|grid)([0-9]+)$"
    number = F.regexp_extract(unit_id, pattern, 3).try_cast("int")
    return F.when(unit_id.rlike(pattern) & (number >= 1), F.struct(F.regexp_extract(unit_id, pattern, 1).alias("part"), F.regexp_extract(unit_id, pattern, 2).alias("kind"), number.alias("number")))


def rels_part(part: Column) -> Column:
    """The relationships part of a part."""
    return F.regexp_replace(part, r"^(.*/)?([^/]+)$", "$1_rels/$2.rels")


def rels_source(part: Column) -> Column:
    """The part whose relationships a .rels part has; null for any other part."""
    return F.when(part.rlike(r"(^|/)_rels/[^/]*\.rels$"), F.regexp_replace(part, r"^(.*/)?_rels/([^/]*)\.rels$", "$1$2"))


def location_text(location: Column) -> Column:
    """part:paragraph-N:container, without what is absent."""
    return F.concat_ws(":", location["part"], F.concat(F.lit("paragraph-"), location["paragraph"].cast("string")), location["container"])


def origin_text(origin: Column) -> Column:
    return F.concat_ws(" ", origin["part"], origin["property"])
