"""Repairs: planned from findings, applied to units as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .rules import RepairOptions, diagnostics

#: Fixes that each format's writer can make; formats without an entry aren't written.
SUPPORTED = {
    "pptx": ("SetDirection", "SetAlignment", "SetLanguage", "SetComplexFont", "RemoveControls", "RemoveTatweel", "ConvertLiteralBullet", "NormalizePresentationForms"),
    "docx": ("SetDirection", "SetAlignment", "SetLanguage", "SetComplexFont", "RemoveControls", "RemoveTatweel", "ConvertLiteralBullet", "NormalizePresentationForms"),
    "xlsx": ("SetDirection", "SetAlignment", "RemoveControls", "RemoveTatweel", "NormalizePresentationForms"),
}


def capabilities(spark) -> DataFrame:
    """(format, kind) of what writers can do."""
    return spark.createDataFrame([(f, k) for f, kinds in SUPPORTED.items() for k in kinds], "format string, kind string")


def plan(units: DataFrame, options: RepairOptions | None = None) -> DataFrame:
    """One fix per unit and rule with findings that offer one: doc_id, ord, rule_ord, unit_id, fix, in that order."""
    found = diagnostics(units, options).where("fix is not null")
    first = found.groupBy("doc_id", "ord", "unit_id", "rule_ord").agg(F.min_by("fix", "hit_ord").alias("fix"))
    return first.orderBy("doc_id", "ord", "rule_ord")


def partition(repairs: DataFrame, units: DataFrame, what: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs that the unit's format can make, and those it can't."""
    named = repairs.join(units.select("doc_id", "unit_id", "format"), ["doc_id", "unit_id"], "left").withColumn("kind", F.col("fix.kind"))
    able = F.broadcast(what)  # a fixed table of a few rows
    return named.join(able, ["format", "kind"], "left_semi").drop("kind"), named.join(able, ["format", "kind"], "left_anti").drop("kind")


def apply(units: DataFrame, repairs: DataFrame) -> DataFrame:
    """Units with their repairs made: deletions from one list, then normalised letters, then the marker, then properties.

    Repairs of a unit meet in one aggregation, whose size is bounded by the
    number of rules. Spans are dropped where the text changed, for their
    offsets no longer hold.
    """
    of = repairs.groupBy("doc_id", "unit_id").agg(F.collect_list("fix").alias("fixes"))
    both = units.join(of, ["doc_id", "unit_id"], "left").withColumn("fixes", F.coalesce("fixes", F.array().cast("array<struct<kind:string,value:string,offsets:array<int>>>")))
    offsets = F.flatten(F.transform(F.filter("fixes", lambda f: f["kind"].isin("RemoveControls", "RemoveTatweel")), lambda f: f["offsets"]))
    deleted = t.delete_at(F.col("text"), offsets)
    logical = F.when(_has("NormalizePresentationForms"), t.normalize_presentation_forms(deleted)).otherwise(deleted)
    text = F.when(_has("ConvertLiteralBullet"), t.strip_marker(logical)).otherwise(logical)
    props = F.col("props")
    for kind, name in (("SetDirection", "direction"), ("SetAlignment", "alignment"), ("SetLanguage", "language"), ("SetComplexFont", "complex_font")):
        value = F.get(F.filter("fixes", _of(kind)), 0)["value"]
        explicit = F.struct(F.lit("explicit").alias("state"), value.alias("value"), F.lit(None).cast("struct<part:string,property:string>").alias("origin"))
        props = props.withField(name, F.when(value.isNotNull(), explicit).otherwise(F.col(f"props.{name}")))
    props = props.withField("bullet", F.when(_has("ConvertLiteralBullet"), "native").otherwise(F.col("props.bullet")))
    out = both.withColumn("new_text", text).withColumn("props", props).withColumn("spans", F.when(F.col("new_text").eqNullSafe(F.col("text")), F.col("spans")).otherwise(F.slice("spans", 1, 0)))
    return out.withColumn("text", F.col("new_text")).select(units.columns)


def _of(kind: str):
    return lambda f: f["kind"] == kind


def _has(kind: str) -> Column:
    return F.exists("fixes", _of(kind))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings by rule and unit before and after: kept, fixed or new."""
    keys = ["doc_id", "unit_id", "rule"]
    a = before.groupBy(*keys).agg(F.count("*").alias("before"))
    b = after.groupBy(*keys).agg(F.count("*").alias("after"))
    out = a.join(b, keys, "full_outer").fillna(0, ["before", "after"])
    return out.withColumn("change", F.when(F.col("after") == 0, "fixed").when(F.col("before") == 0, "new").otherwise("kept"))


def repaired(units: DataFrame, options: RepairOptions | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply what the plan offers: the new units, the plan, and the comparison of both audits."""
    repairs = plan(units, options)
    new = apply(units, repairs)
    return new, repairs, compare(diagnostics(units, options), diagnostics(new, options))
