"""Join-shaped operators of document lowering. Inputs are keyed tables with a doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.attributes import fold_family
from ..scratch import written


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells (doc_id, cell, idx) with their shared string (doc_id, idx, text); a missing string drops the cell."""
    return cells.join(strings, ["doc_id", "idx"], "inner")


def cell_formats(cells: DataFrame, xfs: DataFrame, style_xfs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Cells (doc_id, cell, s) through their format and its style to alignment, reading order and font.

    ``xfs`` (doc_id, s, style, font, horizontal, reading_order, apply_font,
    apply_alignment), ``style_xfs`` alike by ``style``. A flag that is absent
    applies; an explicit false doesn't.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(True))
    own = xfs.select("doc_id", "s", "style", F.when(on("apply_font"), F.col("font")).alias("f1"), F.when(on("apply_alignment"), F.col("horizontal")).alias("h1"), F.when(on("apply_alignment"), F.col("reading_order")).alias("r1"))
    base = style_xfs.select("doc_id", "style", F.when(on("apply_font"), F.col("font")).alias("f2"), F.when(on("apply_alignment"), F.col("horizontal")).alias("h2"), F.when(on("apply_alignment"), F.col("reading_order")).alias("r2"))
    out = cells.join(own, ["doc_id", "s"], "left").join(base, ["doc_id", "style"], "left")
    out = out.withColumn("font", F.coalesce("f1", "f2")).join(fonts.select("doc_id", F.col("font"), F.col("name").alias("font_name")), ["doc_id", "font"], "left")
    return out.select("doc_id", "cell", F.coalesce("h1", "h2").alias("horizontal"), F.coalesce("r1", "r2").alias("reading_order"), "font_name", F.when(F.col("h1").isNotNull(), "explicit").when(F.col("h2").isNotNull(), "inherited").otherwise("unset").alias("alignment_state"))


def sheet_parts(sheets: DataFrame, rels: DataFrame) -> DataFrame:
    """Sheets (doc_id, name, rel_id) to their part through relationships (doc_id, rel_id, target, external); sheets without one drop."""
    return sheets.join(rels.where(~F.col("external")).select("doc_id", "rel_id", F.col("target").alias("part")), ["doc_id", "rel_id"], "inner")


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each left row with the first value of its key on the right, by ``order``."""
    return left.join(right.groupBy(*keys).agg(F.min_by(value, order).alias(value)), keys, "inner")


def installed_family(units: DataFrame, families: DataFrame) -> DataFrame:
    """Units (font) with the file of the family of that name, folded; no family leaves null."""
    of = families.select(fold_family(F.col("family")).alias("folded"), "path").groupBy("folded").agg(F.min("path").alias("path"))
    return units.withColumn("folded", fold_family(F.col("font"))).join(of, "folded", "left").drop("folded")


def placeholder_match(shapes: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Shapes to placeholders of the same index (absent is 0) and text style."""
    idx = lambda df: df.withColumn("idx", F.coalesce("idx", F.lit(0)))
    return idx(shapes).join(idx(placeholders), ["doc_id", "idx", "text_style"], "left")


def ancestors(spark: SparkSession, edges: DataFrame, limit: int = 64) -> DataFrame:
    """All (child, ancestor, hop) along parent edges (child, parent), hop 0 being the child itself.

    At most ``limit`` hops; a chain that returns to a node stops there. Each
    hop puts an edge below the chains that begin at its parent, so rows meet
    by a node's own chains and never by an ancestor that all of them share.
    The chains of a hop are a table on disk; there is no limit to their rows.
    """
    steps = edges.where("parent is not null and child <> parent").select("child", "parent")
    found = edges.select("child").distinct().select("child", F.col("child").alias("ancestor"), F.lit(0).alias("hop"))
    chains = steps.select("child", F.col("parent").alias("ancestor"), F.array("child", "parent").alias("seen"))
    for hop in range(1, limit + 1):
        chains = written(chains, "chains")
        if chains.isEmpty():
            break
        found = found.unionByName(chains.select("child", "ancestor", F.lit(hop).alias("hop")))
        above = chains.withColumnRenamed("child", "parent")
        chains = steps.join(above, "parent").where(~F.array_contains("seen", F.col("child"))).select("child", "ancestor", F.concat(F.array("child"), "seen").alias("seen"))
    return found


def nearest_stated(chain: DataFrame, stated: DataFrame, values: list[str]) -> DataFrame:
    """For each child and value the nearest ancestor's that isn't null: chain (child, ancestor, hop), stated (ancestor, values)."""
    both = chain.join(stated, "ancestor", "left")
    return both.groupBy("child").agg(*(F.min_by(v, F.when(F.col(v).isNotNull(), F.col("hop"))).alias(v) for v in values))


def theme_typeface(runs: DataFrame, theme: DataFrame) -> DataFrame:
    """Theme references (doc_id, font, script) to typefaces; an empty typeface is a miss."""
    return runs.join(theme.select("doc_id", "font", "script", F.nullif(F.col("typeface"), F.lit("")).alias("typeface")), ["doc_id", "font", "script"], "left")


def repair_locations(repairs: DataFrame, units: DataFrame) -> DataFrame:
    """Repairs with the location of their unit, else its id."""
    return repairs.join(units.select("doc_id", "unit_id", "place"), ["doc_id", "unit_id"], "left").withColumn("place", F.coalesce("place", "unit_id"))


def unknown_parts(edits: DataFrame, parts: DataFrame) -> DataFrame:
    """Edits of parts that the package doesn't have; a write needs this to be empty."""
    return edits.join(parts, ["doc_id", "part"], "left_anti")


def newest_first(entries: DataFrame, keys: list[str], age: str) -> DataFrame:
    """One row per key, that of the newest section (the smallest age)."""
    w = Window.partitionBy(*keys).orderBy(age)
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def within_span(positions: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Positions (keys, pos) inside spans (keys, offset, len): a range condition beside an equi-join."""
    return positions.join(spans, keys).where((F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + F.col("len")))


def state(value: Column, base: Column) -> Column:
    return F.when(value.isNotNull(), "explicit").when(base.isNotNull(), "inherited").otherwise("unset")
