"""Aggregations of document lowering and font checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def ordered_text(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Texts of a container in order, one per line."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda r: r["t"]), "\n").alias("text"))


def ordered_distinct(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Distinct values of a key in the order of their first appearance."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("v")))), lambda r: r["v"]).alias("distinct_values"))


def role_of_part(incoming: DataFrame) -> DataFrame:
    """The lowest role rank among a part's incoming relationships (doc_id, part, role_rank)."""
    return incoming.groupBy("doc_id", "part").agg(F.min("role_rank").alias("role_rank"))


def cascade_winner(declarations: DataFrame, keys: list[str]) -> DataFrame:
    """Of declarations of a property the winner by (important, origin, specificity a, b, c, order)."""
    rank = F.struct("important", "origin_rank", "a", "b", "c", "ord")
    return declarations.groupBy(*keys).agg(F.max_by("value", rank).alias("value"))


def family_winner(faces: DataFrame) -> DataFrame:
    """The face that answers for a family (folded): the first regular one, else the first, by directory then file order."""
    rank = F.struct((~F.col("regular")).alias("r"), "dir_ord", "file_ord")
    return faces.groupBy("folded").agg(F.min_by("path", rank).alias("path"))


def coverage(units: DataFrame, covered: DataFrame) -> DataFrame:
    """Judged characters of texts that a font lacks: unit_id, char, first_offset, occurrences.

    ``units`` (unit_id, text, font), ``covered`` (font, char). Texts of fonts
    that ``covered`` doesn't have aren't checked.
    """
    each = units.select("unit_id", "font", F.posexplode(t.chars(F.col("text"))).alias("i", "char"), "text").where(t.judges(F.col("char")))
    counted = each.groupBy("unit_id", "font", "char").agg(F.min("i").alias("i"), F.count("*").alias("occurrences"), F.first("text").alias("text"))
    known = covered.select("font").distinct()
    missing = counted.join(known, "font", "left_semi").join(covered, ["font", "char"], "left_anti")
    return missing.select("unit_id", "char", t.byte_offset(F.col("text"), F.col("i") + 1).alias("first_offset"), "occurrences")


def derived_formats(requests: DataFrame, existing: int) -> DataFrame:
    """New format indexes: one per distinct (base, alignment, reading_order), numbered from ``existing`` by first request."""
    key = ["doc_id", "base", "alignment", "reading_order"]
    first = requests.groupBy(*key).agg(F.min("ord").alias("first"))
    return first.withColumn("new_index", F.lit(existing) + F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")) - 1).drop("first")


def unread_list(names: DataFrame) -> DataFrame:
    """Distinct names of unread sources by document, sorted."""
    return names.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("unread"))


def grids(cells: DataFrame) -> DataFrame:
    """Sheets with text in two columns or more: doc_id, part, text_columns."""
    out = cells.withColumn("column", t.column_of(F.col("reference"))).where(F.col("text") != "")
    return out.groupBy("doc_id", "part").agg(F.countDistinct("column").alias("text_columns")).where("text_columns >= 2")
