"""Text functions as native columns. Offsets are in UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode as u

_JOINING = u.joining_table()
_SINGLE = {k: v for k, v in u.PRESENTATION.items() if len(v) == 1}
_MULTI = {k: v for k, v in u.PRESENTATION.items() if len(v) > 1}
_MULTI_CLASS = u.char_class(_MULTI)


def chars(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def has_arabic(t: Column) -> Column:
    return t.rlike(u.ARABIC_LETTER)


def has_ltr_or_digits(t: Column) -> Column:
    return t.rlike(u.LTR_OR_DIGIT)


def has_arabic_indic_digit(t: Column) -> Column:
    return t.rlike(u.ARABIC_INDIC_DIGIT)


def has_arabic_mark(t: Column) -> Column:
    return t.rlike(u.ARABIC_MARK)


def count_of(t: Column, pattern: str) -> Column:
    """Characters of a class: the length of what is left when stretches of all others are gone.

    Spark writes the loop over matches into the code of the whole stage, which
    is too long to be compiled; in a lambda it is a compiled function.
    """
    return let(t, lambda x: F.length(F.regexp_replace(x, f"[^{pattern[1:-1]}]+", "")))


def high(t: Column) -> Column:
    """The characters of a text that a class of the Arabic script, its controls or its forms can have; few in other texts."""
    return let(t, lambda x: F.regexp_replace(x, f"{u.BELOW}+", ""))


def dominant_direction(t: Column) -> Column:
    """rtl if Arabic letters outnumber ASCII letters, else ltr."""
    return F.when(count_of(high(t), u.ARABIC_LETTER) > count_of(t, "[A-Za-z]"), "rtl").otherwise("ltr")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though ``body`` names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hits(t: Column, pattern: str) -> Column:
    """Characters of a class: byte offset and character. Texts without one aren't cut at all, others only around the hits."""

    def found(parts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).rlike(f"^{pattern}$"))
        return F.transform(at, lambda i: F.struct(F.octet_length(F.array_join(F.slice(parts, F.lit(1), i), "")).alias("offset"), F.get(parts, i).alias("ch")))

    cut = F.filter(F.split(t, f"(?<={pattern})|(?={pattern})"), lambda x: x != "")
    return F.when(t.rlike(pattern), let(cut, found)).otherwise(F.array().cast("array<struct<offset:int,ch:string>>"))


def byte_offset(t: Column, i: Column) -> Column:
    """Where the character at position ``i`` begins."""
    return F.octet_length(F.substring(t, F.lit(1), i - 1))


def controls(t: Column) -> Column:
    """Direction controls: offset, codepoint, name."""
    names = F.create_map(*(F.lit(x) for kv in u.CONTROL_NAMES.items() for x in kv))
    return F.transform(hits(t, u.CONTROL), lambda h: F.struct(h["offset"].alias("offset"), codepoint(h["ch"]).alias("codepoint"), names[h["ch"]].alias("name")))


def codepoint(c: Column) -> Column:
    """U+XXXX of a character."""
    return F.concat(F.lit("U+"), F.format_string("%04X", ordinal(c)))


def ordinal(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")


def strip_controls(t: Column) -> Column:
    return F.translate(t, "".join(u.CONTROL_NAMES), "")


def presentation_forms(t: Column) -> Column:
    return count_of(high(t), u.PRESENTATION_FORM)


def word_ligatures(t: Column) -> Column:
    return count_of(high(t), u.WORD_LIGATURE)


def normalize_presentation_forms(t: Column) -> Column:
    """Each presentation form as its logical characters; all else stays.

    Forms of one character are one pass of ``translate``; those of several are
    looked up only in texts that have any.
    """
    single = F.translate(t, "".join(_SINGLE), "".join(_SINGLE.values()))
    table = F.create_map(*(F.lit(x) for kv in _MULTI.items() for x in kv))
    multi = F.array_join(F.transform(chars(single), lambda c: F.when(c.rlike(_MULTI_CLASS), table[c]).otherwise(c)), "")
    return F.when(~t.rlike(u.PRESENTATION_FORM), t).when(single.rlike(_MULTI_CLASS), multi).otherwise(single)


def offending_codepoints(t: Column, pattern: str) -> Column:
    """Distinct characters of a class as U+XXXX, sorted."""
    return F.array_sort(F.transform(F.array_distinct(F.transform(hits(t, pattern), lambda h: h["ch"])), codepoint))


def joining_types(t: Column) -> Column:
    """One letter per character: D, R, T, C (zero-width joiner), K (tatweel), X (not stated) or U (non-joining)."""
    known = F.regexp_replace(t, u.UNSTATED, "\x01")
    known = F.regexp_replace(known, r"[^\x{0600}-\x{06FF}\x{200D}\x01]", "U")
    return F.translate(known, "".join(_JOINING) + "‍\x01", "".join(_JOINING.values()) + "CX")


def stretches(t: Column) -> Column:
    """A text cut at both ends of each stretch that joining can cross, and in others at will. What joins, and what a verdict or a form depends on, never leaves a stretch."""
    return F.regexp_extract_all(t, F.lit(f"{u.BELOW}+|{u.JOINED}+|{u.UNJOINED}+"), F.lit(0))


def tatweel_runs(t: Column) -> Column:
    """Maximal runs of tatweel: offset, length, verdict (carrier, stretched, standalone, wedged, displayed)."""

    def of_stretch(parts: Column, n: Column) -> Column:
        at = F.octet_length(F.array_join(F.slice(parts, F.lit(1), n), ""))
        return let(F.struct(at.alias("at"), F.get(parts, n).alias("text")), lambda s: F.transform(_tatweel_runs(s["text"]), lambda r: r.withField("offset", r["offset"] + s["at"])))

    def found(parts: Column) -> Column:
        some = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.get(parts, n).contains(u.TATWEEL))
        return F.flatten(F.transform(some, lambda n: of_stretch(parts, n)))

    return F.when(t.contains(u.TATWEEL), let(stretches(t), found)).otherwise(F.array().cast("array<struct<offset:int,length:int,verdict:string>>"))


def _tatweel_runs(t: Column) -> Column:
    def found(parts: Column) -> Column:
        """``parts``: the joining types, cut at both ends of each run."""

        def run(i: Column) -> Column:
            ahead = F.array_join(F.slice(parts, F.lit(1), i), "")
            length = F.length(F.get(parts, i))
            before, after = F.regexp_extract(ahead, "([^T])T*$", 1), F.substring(F.get(parts, i + 1), F.lit(1), F.lit(1))
            return F.struct(F.octet_length(F.substring(t, F.lit(1), F.length(ahead))).alias("offset"), length.alias("length"), verdict(length, before, after).alias("verdict"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).startswith("K")), run)

    return let(F.filter(F.split(joining_types(t), "(?<=K)(?!K)|(?<!K)(?=K)"), lambda x: x != ""), found)


def verdict(length: Column, before: Column, after: Column) -> Column:
    """What a run of tatweel is, from the types before and behind it ('' or null at an edge)."""
    gives, takes = F.coalesce(before.isin("D", "L", "C", "K"), F.lit(False)), F.coalesce(after.isin("D", "R", "C", "K"), F.lit(False))
    return (
        F.when(F.coalesce(after == "T", F.lit(False)), "carrier")
        .when((length >= 2) & (gives | takes), "stretched")
        .when(length >= 2, "standalone")
        .when(gives & takes, "wedged")
        .otherwise("displayed")
    )


def is_padding(verdict: Column) -> Column:
    return verdict.isin("stretched", "wedged")


def padding_offsets(runs: Column) -> Column:
    """The byte offset of each tatweel in a padding run; a tatweel has two bytes."""
    return F.flatten(F.transform(F.filter(runs, lambda r: is_padding(r["verdict"])), lambda r: F.transform(F.sequence(F.lit(0), r["length"] - 1), lambda k: r["offset"] + 2 * k)))


def joining_forms(t: Column) -> Column:
    """Letters that take a form: offset, ch, form (initial, medial, final, isolated). None next to a character whose type isn't stated."""

    def found(seen: Column) -> Column:
        """``seen``: characters that joining can see, with their types."""

        def letter(e: Column, n: Column) -> Column:
            before, after = F.get(seen, n - 1)["k"], F.get(seen, n + 1)["k"]
            stated = ~F.coalesce(before == "X", F.lit(False)) & ~F.coalesce(after == "X", F.lit(False))
            return F.when(e["k"].isin("D", "R") & e["ch"].rlike(u.ARABIC_LETTER) & stated, F.struct(byte_offset(t, e["i"]).alias("offset"), e["ch"].alias("ch"), form_of(e["k"], before, after).alias("form")))

        return F.array_compact(F.transform(seen, letter))

    pairs = F.arrays_zip(chars(t).alias("ch"), chars(joining_types(t)).alias("k"))
    each = F.transform(pairs, lambda e, n: F.struct((n + 1).alias("i"), e["ch"].alias("ch"), e["k"].alias("k")))
    return F.when(has_arabic(t), let(F.filter(each, lambda e: e["k"] != "T"), found)).otherwise(F.array().cast("array<struct<offset:int,ch:string,form:string>>"))


def form_of(kind: Column, before: Column, after: Column) -> Column:
    back = kind.isin("D", "R") & F.coalesce(before.isin("D", "L", "C", "K"), F.lit(False))
    on = kind.isin("D", "L") & F.coalesce(after.isin("D", "R", "C", "K"), F.lit(False))
    return F.when(back & on, "medial").when(back, "final").when(on, "initial").otherwise("isolated")


def form_feature(form: Column) -> Column:
    """The OpenType feature of a joining form."""
    return F.when(form == "initial", "init").when(form == "medial", "medi").when(form == "final", "fina").otherwise("isol")


def arabic_runs(t: Column) -> Column:
    """Maximal stretches that joining can cross. Texts are cut at the ends of stretches only."""

    def found(parts: Column) -> Column:
        def run(i: Column) -> Column:
            ahead = F.length(F.array_join(F.slice(parts, F.lit(1), i), ""))
            return F.struct(byte_offset(t, ahead + 1).alias("offset"), F.substring(t, ahead + 1, F.length(F.get(parts, i))).alias("run"))

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: ~F.get(parts, i).startswith("U")), run)

    types = joining_types(t)
    cut = F.filter(F.split(types, "(?<=U)(?!U)|(?<!U)(?=U)"), lambda x: x != "")
    return F.when(types.rlike("[^U]"), let(cut, found)).otherwise(F.array().cast("array<struct<offset:int,run:string>>"))


def char_name(c: Column) -> Column:
    """The Unicode name of a character of the Arabic blocks, else null."""
    table = F.create_map(*(F.lit(x) for kv in u.NAMES.items() for x in kv))
    return F.when(c.rlike(u.char_class(u.NAMES)), table[c])


def is_format(c: Column) -> Column:
    return c.rlike(u.char_class(map(chr, u.FORMAT_CHARS)))


def judges(c: Column) -> Column:
    """Whether coverage judges a character: it has a name here and is no format character."""
    return c.rlike(u.char_class(u.NAMES)) & ~is_format(c)


def is_arabic_tag(tag: Column) -> Column:
    return F.coalesce(tag.rlike(u.ARABIC_TAG), F.lit(False))


def leading_marker(t: Column) -> Column:
    """The bullet sign that a text begins with, if white space follows it; else null."""
    return F.nullif(F.regexp_extract(t, u.LEADING_MARKER, 1), F.lit(""))


def strip_marker(t: Column) -> Column:
    return F.regexp_replace(t, u.LEADING_MARKER + r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]*", "")


def carries_strong(t: Column, direction: Column) -> Column:
    return F.when(direction == "rtl", t.rlike(u.ARABIC_LETTER)).otherwise(t.rlike("[A-Za-z]"))


def span_text(t: Column, offset: Column, length: Column) -> Column:
    """The bytes of a span as text; null if they run over the end or don't begin and end at characters."""
    data = F.encode(t, "UTF-8")
    part = F.substring(data, offset + 1, length)
    inside = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(t))
    whole = F.is_valid_utf8(part) & ((offset + length >= F.octet_length(t)) | F.is_valid_utf8(F.substring(data, offset + length + 1, F.octet_length(t)))) & ((offset == 0) | F.is_valid_utf8(F.substring(data, F.lit(1), offset)))
    return F.when(inside & whole, F.decode(part, "UTF-8"))


def imposed(t: Column, direction: Column) -> Column:
    return F.when(direction == "rtl", F.reverse(t)).otherwise(t)


def escape(t: Column) -> Column:
    """All but printable ASCII as \\u{XXXX}. Texts are cut around the other characters only."""
    one = lambda c: F.when(c.rlike("^[ -~]"), c).otherwise(F.concat(F.lit("\\u{"), F.format_string("%04X", ordinal(c)), F.lit("}")))
    cut = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit("[ -~]+|[^ -~]"), F.lit(0)), one), "")
    return F.when(t.rlike("[^ -~]"), let(t, cut)).otherwise(t)


def column_of(reference: Column) -> Column:
    """The zero-based column of a cell reference; null without letters."""
    letters = F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1))
    value = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(letters != "", value - 1)


def is_true(value: Column) -> Column:
    """An on/off attribute; null is off."""
    return F.coalesce(value.isin("1", "true", "on"), F.lit(False))


def delete_at(t: Column, offsets: Column) -> Column:
    """A text without the characters that begin at these byte offsets; it is cut there alone."""
    data = F.encode(t, "UTF-8")

    def lead(d: Column, at: Column) -> Column:
        return F.conv(F.hex(F.substring(d, at + 1, F.lit(1))), 16, 10).cast("int")

    def without(each: Column) -> Column:
        d, at = each["d"], each["at"]
        size = lambda o: F.when(lead(d, o) < 0x80, 1).when(lead(d, o) < 0xE0, 2).when(lead(d, o) < 0xF0, 3).otherwise(4)
        starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda o: o + size(o)))
        ends = F.concat(at, F.array(F.octet_length(d)))
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(d, a + 1, b - a), "UTF-8")), "")

    def sound(each: Column) -> Column:
        d = each["d"]
        at = F.filter(each["at"], lambda o: (o >= 0) & (o < F.octet_length(d)) & ~F.coalesce(lead(d, o).between(0x80, 0xBF), F.lit(True)))
        return let(F.struct(d.alias("d"), F.array_sort(F.array_distinct(at)).alias("at")), without)

    given = F.struct(data.alias("d"), offsets.cast("array<int>").alias("at"))
    return F.when((F.size(offsets) > 0) & (F.length(t) > 0), let(given, sound)).otherwise(t)
