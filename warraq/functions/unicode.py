"""Character classes and tables that the text functions share.

Ranges under "fixed values" are facts of the Unicode standard or of the
definitions that results must match. Larger tables are built by rule from
``unicodedata``.
"""

from __future__ import annotations

import unicodedata

# Character classes, as regular expressions that Spark and other engines read alike.
ARABIC_LETTER = r"[\x{0620}-\x{064A}\x{066E}-\x{06D3}\x{06D5}\x{06E5}-\x{06E6}\x{06EE}-\x{06EF}\x{06FA}-\x{06FC}\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08BD}]"
LTR_OR_DIGIT = r"[0-9A-Za-z\x{00C0}-\x{024F}]"
ARABIC_INDIC_DIGIT = r"[\x{0660}-\x{0669}\x{06F0}-\x{06F9}]"
ARABIC_MARK = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}]"
WORD_LIGATURE = r"[\x{FDF0}-\x{FDFF}]"
CONTROL = r"[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
LEADING_MARKER = r"^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]*([\x{2022}\x{25E6}\x{25AA}\x{2023}\x{2043}])[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
ARABIC_TAG = r"(?i)^ar(-|$)"
TATWEEL = "ـ"
#: All characters below the first that joins or that any class of Arabic letters, marks, controls or forms has.
BELOW = r"[\x{0000}-\x{060F}]"

# Names of the twelve direction controls.
CONTROL_NAMES = {
    "؜": "ALM", "‎": "LRM", "‏": "RLM", "‪": "LRE", "‫": "RLE", "‬": "PDF",
    "‭": "LRO", "‮": "RLO", "⁦": "LRI", "⁧": "RLI", "⁨": "FSI", "⁩": "PDI",
}

# Joining types of U+0600 to U+06FF by inclusive ranges; what no range names is U, non-joining.
JOINING = {
    "D": "0620 0626 0628 062A-062E 0633-063F 0641-0647 0649-064A 0678-0687 069A-06BF 06C1-06C2 06CC 06CE 06D0-06D1 06FA-06FC 06FF",
    "R": "0622-0625 0627 0629 062F-0632 0648 0671-0673 0675-0677 0688-0699 06C0 06C3-06CB 06CD 06CF 06D2-06D3 06D5 06EE-06EF",
    "T": "0610-061A 061C 064B-065F 0670 06D6-06DC 06DF-06E4 06E7-06E8 06EA-06ED",
    "K": "0640",
}
#: Arabic-script blocks whose joining types the functions don't state.
UNSTATED = r"[\x{0700}-\x{074F}\x{0750}-\x{077F}\x{0860}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10D00}-\x{10D3F}\x{1EE00}-\x{1EEFF}]"
#: Blocks whose characters have a name to be reported by, and the format characters among them.
ARABIC_BLOCKS = [(0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)]
FORMAT_CHARS = [*range(0x0600, 0x0606), 0x061C, 0x06DD, 0x0890, 0x0891, 0x08E2]


def joining_table() -> dict[str, str]:
    """Joining type of each character of the Arabic block; K is the tatweel, which joins like C."""
    table = {chr(c): "U" for c in range(0x0600, 0x0700)}
    for kind, ranges in JOINING.items():
        for r in ranges.split():
            low, _, high = r.partition("-")
            table |= {chr(c): kind for c in range(int(low, 16), int(high or low, 16) + 1)}
    # 066E and 066F are letters that the ranges above don't name and the standard calls dual; they stay U here
    return table


def char_class(chars) -> str:
    """A regular-expression class of characters, by ranges."""
    points, out = sorted(map(ord, chars)), []
    start = previous = None
    for p in [*points, None]:
        if start is not None and p != previous + 1:
            out.append(f"\\x{{{start:04X}}}" + (f"-\\x{{{previous:04X}}}" if previous > start else ""))
            start = None
        if start is None:
            start = p
        previous = p
    return f"[{''.join(out)}]"


#: Characters whose joining type isn't U, and all others.
_JOINED = char_class([*(c for c, k in joining_table().items() if k != "U"), "\u200d"])[1:-1] + UNSTATED[1:-1]
JOINED, UNJOINED = f"[{_JOINED}]", f"[^{_JOINED}]"


def logical_form(c: str) -> str | None:
    """The compatibility form of a presentation form; None for anything else, word ligatures too."""
    o = ord(c)
    if not (0xFB50 <= o <= 0xFDFF or 0xFE70 <= o <= 0xFEFF) or 0xFDF0 <= o <= 0xFDFF:
        return None
    form = unicodedata.normalize("NFKC", c)
    return form if form != c else None


PRESENTATION = {chr(c): f for c in [*range(0xFB50, 0xFE00), *range(0xFE70, 0xFF00)] if (f := logical_form(chr(c)))}


PRESENTATION_FORM = char_class(PRESENTATION)
NAMES = {chr(c): unicodedata.name(chr(c)) for low, high in ARABIC_BLOCKS for c in range(low, high + 1) if unicodedata.name(chr(c), "")}


def bracket_pairs() -> dict[str, str]:
    """Opening to closing brackets: mirrored opening punctuation whose pair is next to it, or next but one in ASCII."""
    out = {"(": ")", "[": "]", "{": "}"}
    for c in range(0x2000, 0x10000):
        o, n = chr(c), chr(c + 1)
        if unicodedata.category(o) == "Ps" and unicodedata.mirrored(o) and unicodedata.category(n) == "Pe" and unicodedata.mirrored(n):
            out[o] = n
    return out
