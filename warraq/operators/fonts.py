"""Font rules: whether the named font has the letters of a text, and joins them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.attributes import fold_family
from . import rules
from .rules import REGISTRY, Rule, finding, only

#: Joins that must be seen before their absence says anything.
MIN_OBSERVABLE_JOINS = 4

for _id, _text in (("font-coverage", "The named font lacks letters of the text"), ("shaping-broken", "The named font doesn't join letters")):
    REGISTRY.setdefault(_id, Rule(_id, _text, lambda o: F.array().cast(f"array<{rules.DIAGNOSTIC}>")))


def families(faces: DataFrame) -> DataFrame:
    """One face per folded family name: the first regular one by path and face, else the first."""
    each = faces.select(F.explode("families").alias("family"), "path", "face", "regular", "covered", "shapes", "readable").withColumn("folded", fold_family(F.col("family")))
    rank = F.struct((~F.col("regular")).alias("r"), "path", "face")
    return each.groupBy("folded").agg(F.min_by(F.struct("path", "covered", "shapes", "readable"), rank).alias("font"))


def with_fonts(units: DataFrame, faces: DataFrame) -> DataFrame:
    """Units beside the font of their complex-script family; null where no family of that name is installed."""
    key = fold_family(rules.effective("complex_font"))
    return units.withColumn("_folded", key).join(families(faces).withColumnRenamed("folded", "_folded"), "_folded", "left").drop("_folded")


def diagnostics(units: DataFrame, faces: DataFrame) -> DataFrame:
    """Findings of the two font rules. A family that isn't installed is silence, not a finding.

    Coverage judges distinct named characters. Shaping looks at letters that
    the font has and that must take a joined form; where the font's features
    can't be read the rule isn't run.
    """
    d = with_fonts(units.where((F.col("kind") == "paragraph") & t.has_arabic(F.col("text"))), faces).where("font is not null")
    judged = F.array_distinct(F.filter(t.chars(F.col("text")), t.judges))
    d = d.withColumn("_judged", judged).withColumn("_missing", F.array_except("_judged", "font.covered"))
    letters = F.filter(t.joining_forms(F.col("text")), lambda e: F.array_contains("font.covered", e["ch"]) & (e["form"] != "isolated"))
    d = d.withColumn("_seen", letters)
    made = F.filter("_seen", lambda e: F.array_contains("font.shapes", F.struct(e["ch"].alias("ch"), t.form_feature(e["form"]).alias("feature"))))
    d = d.withColumn("_made", made)
    name = lambda c: F.concat(t.codepoint(c), F.lit(" "), F.coalesce(t.char_name(c), F.lit("")))
    none = F.size("_missing") == F.size("_judged")
    coverage = finding("font-coverage", F.when(none, "error").otherwise("warning"), F.concat(F.size("_missing").cast("string"), F.lit(" of "), F.size("_judged").cast("string"), F.lit(" characters aren't in "), rules.effective("complex_font")), logical=F.col("text"), offenders=F.transform("_missing", name), source=rules.inherited("complex_font"))
    shaping = finding("shaping-broken", "error", F.concat(F.size("_seen").cast("string"), F.lit(" letters must join and none does in "), rules.effective("complex_font")), logical=F.col("text"), offenders=F.transform(F.array_distinct(F.transform("_seen", lambda e: e["ch"])), name))
    found = F.concat(only(F.size("_missing") > 0, coverage), only(F.col("font.readable") & (F.size("_seen") >= MIN_OBSERVABLE_JOINS) & (F.size("_made") == 0), shaping))
    return d.select("doc_id", "ord", "unit_id", "location", F.explode(found).alias("d")).select("doc_id", "ord", "unit_id", "location", "d.*")


def shaping_counts(units: DataFrame, faces: DataFrame) -> DataFrame:
    """Per unit with a font: joins required, observable (the font has the letter) and produced."""
    d = with_fonts(units, faces).where("font is not null").withColumn("_forms", F.filter(t.joining_forms(F.col("text")), lambda e: e["form"] != "isolated"))
    seen = F.filter("_forms", lambda e: F.array_contains("font.covered", e["ch"]))
    made = F.filter(seen, lambda e: F.array_contains("font.shapes", F.struct(e["ch"].alias("ch"), t.form_feature(e["form"]).alias("feature"))))
    return d.select("doc_id", "unit_id", F.size("_forms").alias("required"), F.size(seen).alias("observable"), F.size(made).alias("produced"))
