"""The bidirectional algorithm character by character, to compare with."""

from __future__ import annotations

import unicodedata

from warraq.functions.unicode import bracket_pairs

RTL, LTR = "rtl", "ltr"
MAX_DEPTH = 125
ISOLATES = {"LRI", "RLI", "FSI"}
EMBEDDINGS = {"LRE", "RLE", "LRO", "RLO"}
REMOVED = EMBEDDINGS | {"PDF", "BN"}
NEUTRAL = {"B", "S", "WS", "ON", "FSI", "LRI", "RLI", "PDI"}
BRACKETS = bracket_pairs()
CLOSING = {v: k for k, v in BRACKETS.items()}
FSI, PDI = "⁨", "⁩"


def bidi_class(c: str) -> str:
    return unicodedata.bidirectional(c) or ("AL" if "؀" <= c <= "޿" or "ࢠ" <= c <= "ࣿ" else "R" if "֐" <= c <= "ࣿ" else "L")


def first_paragraph(text: str) -> str:
    """Up to and with the first paragraph separator."""
    for k, c in enumerate(text):
        if bidi_class(c) == "B":
            # a carriage return and a line feed are one separator
            return text[: k + 2] if text[k : k + 2] == "\r\n" else text[: k + 1]
    return text


def _matching(classes: list[str]) -> dict[int, int]:
    """Isolate initiators to their terminators."""
    stack, out = [], {}
    for k, c in enumerate(classes):
        if c in ISOLATES:
            stack.append(k)
        elif c == "PDI" and stack:
            out[stack.pop()] = k
    return out


def first_strong(classes: list[str], start: int = 0, end: int | None = None, match: dict[int, int] | None = None) -> str | None:
    """The first strong class outside isolates (rules P2 and P3)."""
    match = _matching(classes) if match is None else match
    k, end = start, len(classes) if end is None else end
    while k < end:
        c = classes[k]
        if c in ("L", "R", "AL"):
            return LTR if c == "L" else RTL
        k = match.get(k, end) if c in ISOLATES else k + 1
    return None


def auto_direction(text: str) -> str:
    return first_strong([bidi_class(c) for c in first_paragraph(text)]) or LTR


def levels(text: str, base: str) -> list[int]:
    """The embedding level of each character of one paragraph."""
    classes = [bidi_class(c) for c in text]
    original = list(classes)
    match = _matching(classes)
    closers = {v: k for k, v in match.items()}
    para = 1 if base == RTL else 0
    out = [para] * len(text)
    # X1 to X8
    stack: list[tuple[int, str | None, bool]] = [(para, None, False)]
    over_isolates = over_embeddings = valid_isolates = 0
    for k, c in enumerate(original):
        level, override, _ = stack[-1]
        if c in EMBEDDINGS:
            out[k] = level
            rtl = c in ("RLE", "RLO")
            new = (level + 1) | 1 if rtl else (level + 2) & ~1
            if new <= MAX_DEPTH and not over_isolates and not over_embeddings:
                stack.append((new, {"LRO": "L", "RLO": "R"}.get(c), False))
            elif not over_isolates:
                over_embeddings += 1
        elif c in ISOLATES:
            out[k] = level
            if override:
                classes[k] = override
            rtl = c == "RLI" or c == "FSI" and first_strong(original, k + 1, match.get(k, len(text)), match) == RTL
            new = (level + 1) | 1 if rtl else (level + 2) & ~1
            if new <= MAX_DEPTH and not over_isolates and not over_embeddings:
                valid_isolates += 1
                stack.append((new, None, True))
            else:
                over_isolates += 1
        elif c == "PDI":
            if over_isolates:
                over_isolates -= 1
            elif valid_isolates:
                over_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid_isolates -= 1
            level, override, _ = stack[-1]
            out[k] = level
            if override:
                classes[k] = override
        elif c == "PDF":
            out[k] = level
            if not over_isolates:
                if over_embeddings:
                    over_embeddings -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
        elif c == "B":
            out[k] = para
        elif c == "BN":
            out[k] = level
        else:
            out[k] = level
            if override:
                classes[k] = override
    # X10: level runs, joined through isolates, without what X9 removes
    kept = [k for k, c in enumerate(original) if c not in REMOVED]
    runs: list[list[int]] = []
    for k in kept:
        if runs and out[runs[-1][-1]] == out[k]:
            runs[-1].append(k)
        else:
            runs.append([k])
    first_of, embedded = {r[0]: r for r in runs}, list(out)
    for r in runs:
        if r[0] in closers and original[r[0]] == "PDI":
            continue
        sequence = list(r)
        while sequence[-1] in match and original[sequence[-1]] in ISOLATES and match[sequence[-1]] in first_of:
            sequence += first_of[match[sequence[-1]]]
        _resolve(text, sequence, classes, original, out, embedded, para, kept, match)
    # L1
    reset = True
    for k in range(len(text) - 1, -1, -1):
        c = original[k]
        if c in ("B", "S"):
            out[k], reset = para, True
        elif c in REMOVED or c == "WS" or c in ISOLATES or c == "PDI":
            if reset:
                out[k] = para
        else:
            reset = False
    # what X9 removes takes the level before it, so that it moves with its neighbours
    for k, c in enumerate(original):
        if c in REMOVED and not (out[k] == para and _trailing(original, k)):
            out[k] = out[k - 1] if k else para
    return out


def _trailing(original: list[str], k: int) -> bool:
    for c in original[k:]:
        if c in ("B", "S"):
            return True
        if not (c in REMOVED or c == "WS" or c in ISOLATES or c == "PDI"):
            return False
    return True


def _resolve(text, seq, classes, original, out, embedded, para, kept, match) -> None:
    """Rules W1 to W7, N0 to N2, I1 and I2 on one isolating run sequence."""
    level = out[seq[0]]
    place = {k: n for n, k in enumerate(kept)}
    before = place[seq[0]] - 1
    after = place[seq[-1]] + 1
    low = embedded[kept[before]] if before >= 0 else para
    high = embedded[kept[after]] if after < len(kept) and not (original[seq[-1]] in ISOLATES and seq[-1] not in match) else para
    sos = "R" if max(level, low) % 2 else "L"
    eos = "R" if max(level, high) % 2 else "L"
    t = [classes[k] for k in seq]
    n = len(t)
    previous = sos
    for i in range(n):  # W1
        if t[i] == "NSM":
            t[i] = "ON" if previous in ISOLATES or previous == "PDI" else previous
        previous = t[i]
    strong = sos
    for i in range(n):  # W2
        if t[i] in ("R", "L", "AL"):
            strong = t[i]
        elif t[i] == "EN" and strong == "AL":
            t[i] = "AN"
    t = ["R" if x == "AL" else x for x in t]  # W3
    for i in range(1, n - 1):  # W4
        if t[i] == "ES" and t[i - 1] == t[i + 1] == "EN":
            t[i] = "EN"
        elif t[i] == "CS" and t[i - 1] == t[i + 1] and t[i - 1] in ("EN", "AN"):
            t[i] = t[i - 1]
    i = 0
    while i < n:  # W5
        if t[i] == "ET":
            j = i
            while j < n and t[j] == "ET":
                j += 1
            if i and t[i - 1] == "EN" or j < n and t[j] == "EN":
                t[i:j] = ["EN"] * (j - i)
            i = j
        else:
            i += 1
    t = ["ON" if x in ("ES", "ET", "CS") else x for x in t]  # W6
    strong = sos
    for i in range(n):  # W7
        if t[i] in ("R", "L"):
            strong = t[i]
        elif t[i] == "EN" and strong == "L":
            t[i] = "L"
    embedding = "R" if level % 2 else "L"
    as_strong = lambda x: "R" if x in ("R", "EN", "AN") else "L" if x == "L" else None
    stack, pairs = [], []
    for i, k in enumerate(seq):  # N0
        c = text[k]
        if t[i] != "ON":
            continue
        if c in BRACKETS:
            if len(stack) == 63:
                break
            stack.append((BRACKETS[c], i))
        elif c in CLOSING:
            for j in range(len(stack) - 1, -1, -1):
                if unicodedata.normalize("NFC", stack[j][0]) == unicodedata.normalize("NFC", c):
                    pairs.append((stack[j][1], i))
                    del stack[j:]
                    break
    for a, b in sorted(pairs):
        inside = {as_strong(x) for x in t[a + 1 : b]} - {None}
        if embedding in inside:
            new = embedding
        elif inside:
            context = next((as_strong(x) for x in reversed(t[:a]) if as_strong(x)), sos)
            new = context if context != embedding else embedding
        else:
            continue
        for x in (a, b):
            t[x] = new
            j = x + 1
            while j < n and original[seq[j]] == "NSM":
                t[j] = new
                j += 1
    i = 0
    while i < n:  # N1 and N2
        if t[i] in NEUTRAL:
            j = i
            while j < n and t[j] in NEUTRAL:
                j += 1
            left = as_strong(t[i - 1]) if i else sos
            right = as_strong(t[j]) if j < n else eos
            t[i:j] = [left if left == right else embedding] * (j - i)
            i = j
        else:
            i += 1
    for i, k in enumerate(seq):  # I1 and I2
        if level % 2 == 0:
            out[k] = level + (1 if t[i] == "R" else 2 if t[i] in ("AN", "EN") else 0)
        else:
            out[k] = level + (1 if t[i] in ("L", "EN", "AN") else 0)


def visual(text: str, base: str) -> str:
    """The first paragraph in display order under a base direction (rule L2). Brackets aren't mirrored, and controls stay."""
    para = first_paragraph(text)
    lv, order = levels(para, base), list(range(len(para)))
    if lv:
        for level in range(max(lv), min((x for x in lv if x % 2), default=max(lv) + 1) - 1, -1):
            k = 0
            while k < len(order):
                if lv[order[k]] >= level:
                    j = k
                    while j < len(order) and lv[order[j]] >= level:
                        j += 1
                    order[k:j] = order[k:j][::-1]
                    k = j
                else:
                    k += 1
    return "".join(para[k] for k in order)
