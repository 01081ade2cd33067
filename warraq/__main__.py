"""Audit, repair, explain and list rules from a shell.

Exit codes: 0 nothing blocks, 1 findings block, 2 a wrong or refused request,
3 a file that can't be read.
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile

OK, FINDINGS, USAGE, UNREADABLE = 0, 1, 2, 3


def arabic_tag(value: str) -> str:
    if not re.match(r"(?i)^ar(-|$)", value):
        raise argparse.ArgumentTypeError("the tag must be Arabic")
    return value


def non_empty(value: str) -> str:
    if not value.strip():
        raise argparse.ArgumentTypeError("a typeface needs a name")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="warraq", description="Audit and repair Arabic text in documents.")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("audit", "repair", "explain", "rules"):
        v = verbs.add_parser(name)
        v.add_argument("--format", choices=("text", "json"), default="text")
        if name == "explain":
            v.add_argument("text")
        if name in ("audit", "repair"):
            v.add_argument("file")
            v.add_argument("--strict", action="store_true")
            v.add_argument("--font-dir")
        if name == "repair":
            v.add_argument("output")
            v.add_argument("--lang", type=arabic_tag, default="ar-SA")
            v.add_argument("--font", type=non_empty)
            for flag in ("--convert-bullets", "--strip-tatweel", "--align", "--force"):
                v.add_argument(flag, action="store_true")
    return p


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[2]")).appName("warraq").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    if args.verb == "explain":
        return explain(args.text, args.format == "json")
    from .sources import rewrite

    try:
        if args.verb == "repair":
            rewrite.guard(args.file, args.output, os.path.exists(args.output), args.force)
        if args.verb == "rules":
            return listing(session(), args.format == "json")
        return document(session(), args)
    except rewrite.Refused as e:
        print(e, file=sys.stderr)
        return USAGE


def explain(text: str, as_json: bool) -> int:
    from .functions import bidi
    from .functions import unicode as u

    arabic, latin = len(re.findall(_python_class(u.ARABIC_LETTER), text)), len(re.findall("[A-Za-z]", text))
    rtl, ltr = bidi.visual(text, "rtl"), bidi.visual(text, "ltr")
    body = {"logical": text, "dominant_direction": "rtl" if arabic > latin else "ltr", "auto_direction": bidi.auto_direction(text), "order_differs": rtl != ltr, "visual": {"rtl": rtl, "ltr": ltr}}
    if as_json:
        print(json.dumps(body, ensure_ascii=False, indent=2))
        return OK
    escaped = lambda s: "".join(c if " " <= c <= "~" else f"\\u{{{ord(c):04X}}}" for c in s)
    lines = [f"logical: {text}", f"dominant: {body['dominant_direction']}", f"auto-detected: {body['auto_direction']}", "the base direction " + ("changes the order" if rtl != ltr else "changes nothing")]
    if rtl != ltr:
        lines += [f"as rtl: {escaped(rtl)}", f"as ltr: {escaped(ltr)}"]
    print("\n".join(lines))
    return OK


def _python_class(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


def listing(spark, as_json: bool) -> int:
    from .operators import rules

    rows = [(r.rule, r.description) for r in rules.listing(spark).orderBy("rule_ord").collect()]
    print(json.dumps([{"id": i, "description": d} for i, d in rows], indent=2) if as_json else "\n".join(f"{i:<22} {d}" for i, d in rows))
    return OK


def document(spark, args) -> int:
    from .engine import Engine
    from .operators import repair, report
    from .operators.rules import RepairOptions
    from .sources import documents, fonts, rewrite
    from .sources.dispatch import READABLE

    if args.file.rsplit(".", 1)[-1].lower() not in READABLE:
        raise rewrite.Refused(f"readable formats are {', '.join(READABLE)}")
    if not os.path.isfile(args.file):
        print(f"{args.file}: no such file", file=sys.stderr)
        return UNREADABLE
    options = RepairOptions(args.lang, args.font, args.convert_bullets, args.strip_tatweel, args.align) if args.verb == "repair" else RepairOptions()
    engine = Engine(options)
    if args.font_dir:
        engine = engine.with_fonts(fonts.scan(spark, args.font_dir))

    def audited(found):
        scanned = documents.scan(found).cache()
        failed = documents.errors(scanned).first()
        if failed:
            raise ValueError(failed.error)
        units = documents.units(scanned)
        rows, diagnostics = engine.audit(units, args.strict, documents.unread(scanned))
        return units, rows, diagnostics

    found = documents.files(spark, args.file).cache()
    try:
        units, before, diagnostics = audited(found)
    except ValueError as e:
        print(f"{args.file}: {e}", file=sys.stderr)
        return UNREADABLE
    first = before.first()
    if args.verb == "audit":
        if first is None:
            print(json.dumps({"file": args.file, "blocking": False, "summary": {"units_scanned": 0}}) if args.format == "json" else f"{args.file}\nunits 0\nPASS")
            return OK
        made = report.as_json(before, diagnostics, args.strict).first().json if args.format == "json" else report.as_text(before, diagnostics).first().text
        print(made)
        return FINDINGS if first.blocking else OK
    able, unable = repair.partition(engine.plan(units), units, repair.capabilities(spark))
    able = able.cache()
    row = rewrite.rewrite_all(found, units, able).first()
    if row.refused:
        raise rewrite.Refused(row.refused)
    folder = os.path.dirname(os.path.abspath(args.output))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "wb") as f:
        f.write(row.content)
    os.replace(temporary, args.output)
    _, after, _ = audited(documents.files(spark, args.output))
    last = after.first()
    counts = lambda r: {k: r[k] for k in ("units_scanned", "arabic_units", "mixed_units", "errors", "warnings", "notes")} if r else {}
    fixes = lambda d: [{"unit": r.unit_id, "fix": r.fix.asDict()} for r in d.orderBy("ord", "rule_ord").collect()]
    body = {"options": options.__dict__, "repairs": {"applied": fixes(able), "skipped": fixes(unable)}, "before": counts(first), "after": counts(last)}
    if args.format == "json":
        print(json.dumps(body, ensure_ascii=False, indent=2))
    else:
        print(f"applied {len(body['repairs']['applied'])}, skipped {len(body['repairs']['skipped'])}\nbefore {body['before']}\nafter {body['after']}")
    return FINDINGS if last is not None and last.blocking else OK


if __name__ == "__main__":
    sys.exit(main())
