"""Style sheets: rules, selectors and the cascade for one element at a time."""

from __future__ import annotations

import re
from dataclasses import dataclass

UA, AUTHOR, INLINE = 0, 1, 2
COMMENT = re.compile(r"/\*.*?(\*/|\Z)", re.DOTALL)
NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\-\u0080-\U0010ffff]*"
SIMPLE = re.compile(rf"(?P<all>\*)|(?P<type>{NAME})|\#(?P<id>[\w\-\u0080-\U0010ffff]+)|\.(?P<cls>{NAME})|\[\s*(?P<attr>{NAME})\s*(?:=\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:(?P<root>root)(?![\w\-(])")


@dataclass(frozen=True)
class Won:
    """A declaration that applies, and where it comes from."""

    value: str
    origin: int
    cite: str


@dataclass(frozen=True)
class Selector:
    text: str
    parts: tuple  # (combinator to the left, tests)
    weight: tuple[int, int, int]


def declarations(css: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a declaration list."""
    out = []
    for d in _split(COMMENT.sub(" ", css), ";"):
        name, colon, value = d.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not name or not value:
            continue
        bare = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.IGNORECASE)
        out.append((name, bare.strip(), bare != value))
    return out


def _split(text: str, at: str) -> list[str]:
    """Split outside quotes and brackets."""
    out, start, depth, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == at and not depth:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


def selector(text: str) -> Selector | None:
    """A selector of types, ids, classes, attributes and :root with child and descendant steps; None for any other."""
    text = " ".join(text.split())
    parts, at, combinator, weight = [], 0, " ", [0, 0, 0]
    rest = re.sub(r"\s*>\s*", ">", text)
    while at < len(rest):
        tests = []
        while at < len(rest) and rest[at] not in " >":
            m = SIMPLE.match(rest, at)
            if not m or m["type"] and tests or m["all"] and tests:
                return None
            if m["type"]:
                tests.append(("type", m["type"].lower(), None))
                weight[2] += 1
            elif m["id"]:
                tests.append(("id", m["id"], None))
                weight[0] += 1
            elif m["cls"]:
                tests.append(("class", m["cls"], None))
                weight[1] += 1
            elif m["attr"]:
                tests.append(("attr", m["attr"].lower(), None if m["val"] is None else m["val"].strip("\"'")))
                weight[1] += 1
            elif m["root"]:
                tests.append(("root", None, None))
                weight[1] += 1
            else:
                tests.append(("all", None, None))
            at = m.end()
        if not tests:
            return None
        parts.append((combinator, tuple(tests)))
        if at < len(rest):
            combinator = rest[at]
            at += 1
            if at >= len(rest):
                return None
    return Selector(text, tuple(parts), tuple(weight)) if parts else None


def sheet(css: str) -> list[tuple[list[Selector], list[tuple[str, str, bool]]]]:
    """Rules of a sheet in order. At-rules are skipped with their blocks, and selectors that aren't understood drop alone."""
    css, at, rules = COMMENT.sub(" ", css), 0, []
    while at < len(css):
        if css[at].isspace() or css[at] == "}":
            at += 1
            continue
        brace, semicolon = css.find("{", at), css.find(";", at)
        if css[at] == "@" and 0 <= semicolon and (brace < 0 or semicolon < brace):
            at = semicolon + 1
            continue
        if brace < 0:
            break
        end, depth = brace + 1, 1
        while end < len(css) and depth:
            depth += {"{": 1, "}": -1}.get(css[end], 0)
            end += 1
        if css[at] != "@":
            chosen = [s for s in map(selector, _split(css[at:brace], ",")) if s]
            if chosen:
                rules.append((chosen, declarations(css[brace + 1 : end - (depth == 0)])))
        at = end
    return rules


def _tests(element, tests) -> bool:
    for kind, name, value in tests:
        if kind == "type" and element.name != name:
            return False
        if kind == "id" and element.attrs.get("id") != name:
            return False
        if kind == "class" and name not in element.attrs.get("class", "").split():
            return False
        if kind == "attr" and (name not in element.attrs or value is not None and element.attrs[name] != value):
            return False
        if kind == "root" and element.name != "html":
            return False
    return True


def matches(element, s: Selector, k: int = -1) -> bool:
    combinator, tests = s.parts[k]
    if not _tests(element, tests):
        return False
    if -k == len(s.parts):
        return True
    up = element.parent
    while up is not None:
        if matches(up, s, k - 1):
            return True
        if combinator == ">":
            return False
        up = up.parent
    return False


def cascade(element, sheets: list, presentational: list[tuple[str, str]]) -> dict[str, Won]:
    """What wins for each property of one element: by importance, origin, specificity, then order."""
    best: dict[str, tuple] = {}
    order = 0

    def offer(name: str, value: str, important: bool, origin: int, weight: tuple, cite: str) -> None:
        nonlocal order
        order += 1
        rank = (important, origin, weight, order)
        if name not in best or rank > best[name][0]:
            best[name] = (rank, Won(value, origin, cite))

    for name, value in presentational:
        offer(name, value, False, UA, (0, 0, 0), "")
    for rules in sheets:
        for selectors, found in rules:
            hit = [s for s in selectors if matches(element, s)]
            if hit:
                top = max(hit, key=lambda s: s.weight)
                for name, value, important in found:
                    offer(name, value, important, AUTHOR, top.weight, f"{top.text}{{{name}}}")
    for name, value, important in declarations(element.attrs.get("style", "")):
        offer(name, value, important, INLINE, (0, 0, 0), "style")
    return {name: won for name, (_, won) in best.items()}
