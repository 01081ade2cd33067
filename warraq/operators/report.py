"""Reports: counts, verdicts and order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.attributes import location_text



def unit_counts(units: DataFrame) -> DataFrame:
    """units_scanned, arabic_units and mixed_units by doc_id, over units of every kind."""
    arabic = F.coalesce(t.has_arabic(F.col("text")), F.lit(False))
    mixed = arabic & t.has_ltr_or_digits(F.col("text"))
    return units.groupBy("doc_id").agg(F.count("*").alias("units_scanned"), F.count_if(arabic).alias("arabic_units"), F.count_if(mixed).alias("mixed_units"))


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "note")))


def blocking(errors: Column, warnings: Column, strict: bool = False) -> Column:
    return (errors > 0) | (F.lit(strict) & (warnings > 0))


def report(units: DataFrame, diagnostics: DataFrame, strict: bool = False, unread: DataFrame | None = None, fonts_checked: bool = False) -> DataFrame:
    """One row per document: unit counts, findings by severity, blocking, whether fonts were checked, and what wasn't read."""
    out = unit_counts(units).join(severity_counts(diagnostics), "doc_id", "left").fillna(0, ["errors", "warnings", "notes"])
    if unread is not None:
        names = unread.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("unread"))
        out = out.join(names, "doc_id", "left").withColumn("unread", F.coalesce("unread", F.array().cast("array<string>")))
    return out.withColumn("blocking", blocking(F.col("errors"), F.col("warnings"), strict)).withColumn("fonts_checked", F.lit(fonts_checked))


def ordered(diagnostics: DataFrame) -> DataFrame:
    """Severity from high to low, then rule; document order, rule order and hit order break ties."""
    return diagnostics.orderBy(F.desc("severity_rank"), "rule", "doc_id", "ord", "rule_ord", "hit_ord")


def rollup(units: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Findings by format, rule and severity with subtotals (an extension)."""
    return diagnostics.join(units.select("doc_id", "ord", "format"), ["doc_id", "ord"]).rollup("format", "rule", "severity").agg(F.count("*").alias("findings"))


def as_json(report_rows: DataFrame, diagnostics: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, json): file, strict, blocking, fonts, sources, summary, diagnostics."""
    item = F.struct(-F.col("severity_rank"), "rule", "ord", "rule_ord", "hit_ord", F.struct("rule", "severity", F.col("unit_id").alias("unit"), "location", "message", "evidence", "fixable").alias("body"))
    found = diagnostics.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["body"]).alias("diagnostics"))
    joined = report_rows.join(found, "doc_id", "left")
    unread = F.col("unread") if "unread" in report_rows.columns else F.array().cast("array<string>")
    body = F.struct(
        F.col("doc_id").alias("file"), F.lit(strict).alias("strict"), "blocking", F.struct(F.col("fonts_checked").alias("checked")).alias("fonts"), F.struct(unread.alias("unread")).alias("sources"),
        F.struct("units_scanned", "arabic_units", "mixed_units", "errors", "warnings", "notes").alias("summary"), F.coalesce("diagnostics", F.array()).alias("diagnostics"),
    )
    return joined.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def as_text(report_rows: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(doc_id, text): a header, the counts, the findings and PASS or FAIL."""
    line = F.concat(F.lit("  "), F.col("severity"), F.lit(" "), F.col("rule"), F.lit(" "), location_text(F.col("location")), F.lit(": "), F.col("message"))
    lines = diagnostics.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("severity_rank"), "rule", "ord", "rule_ord", "hit_ord", line.alias("line")))), lambda s: s["line"]).alias("lines"))
    joined = report_rows.join(lines, "doc_id", "left")
    counts = F.concat(F.lit("units "), F.col("units_scanned"), F.lit(" | arabic "), F.col("arabic_units"), F.lit(" | mixed "), F.col("mixed_units"))
    fonts = F.when(F.col("fonts_checked"), "fonts: checked").otherwise("fonts: not checked")
    end = F.when(F.col("blocking"), "FAIL").otherwise("PASS")
    return joined.select("doc_id", F.array_join(F.concat(F.array(F.col("doc_id"), counts, fonts), F.coalesce("lines", F.array().cast("array<string>")), F.array(end)), "\n").alias("text"))


def golden(report_json: str) -> str:
    """Canonical JSON: sorted keys, two spaces, a line end."""
    return json.dumps(json.loads(report_json), ensure_ascii=False, indent=2, sort_keys=True) + "\n"
