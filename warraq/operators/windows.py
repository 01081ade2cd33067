"""Window forms of the run and neighbour functions, for texts already exploded to characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import unicode as u


def characters(units: DataFrame, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(key, pos, ch, offset, joining): one row per character; each text is cut once, and offsets are running sums."""
    both = F.arrays_zip(t.chars(F.col(text)).alias("ch"), t.chars(t.joining_types(F.col(text))).alias("joining"))
    each = units.select(key, F.posexplode(both).alias("pos", "e")).select(key, "pos", "e.ch", "e.joining")
    ahead = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(key, "pos", "ch", F.coalesce(F.sum(F.octet_length("ch")).over(ahead), F.lit(0)).cast("int").alias("offset"), "joining")


def joined_characters(units: DataFrame, key: str = "unit_id", text: str = "text") -> DataFrame:
    """``characters`` for the functions below, of which none looks beyond a stretch that joining can cross.

    Each stretch gives a row per character. What stands between stretches is
    a row with its first character, non-joining: offsets count all of it,
    ``pos`` counts rows. Texts without a stretch give none.
    """

    def rows(part):
        row = lambda c, octets, k: F.struct(c.alias("ch"), octets.alias("octets"), k.alias("joining"))
        each = F.zip_with(t.chars(part), t.chars(t.joining_types(part)), lambda c, k: row(c, F.octet_length(c), k))
        return F.when(part.rlike(f"^{u.JOINED}"), each).otherwise(F.array(row(F.substring(part, 1, 1), F.octet_length(part), F.lit("U"))))

    cut = t.let(F.col(text), lambda x: F.flatten(F.transform(t.stretches(x), rows)))
    each = units.where(t.high(F.col(text)).rlike(u.JOINED)).select(key, F.posexplode(cut).alias("pos", "e")).select(key, "pos", "e.*")
    ahead = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(key, "pos", "ch", F.coalesce(F.sum("octets").over(ahead), F.lit(0)).cast("int").alias("offset"), "joining")


def tatweel_runs(chars: DataFrame, key: str = "unit_id") -> DataFrame:
    """Runs of tatweel by gaps and islands: key, offset, length, verdict.

    ``before`` is the last type ahead of the run that isn't transparent,
    ``after`` the type of the next character as it is.
    """
    by = Window.partitionBy(key).orderBy("pos")
    seen = F.last(F.when(~F.col("joining").isin("T", "K"), F.col("joining")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    last_k = F.last(F.when(F.col("joining") == "K", F.col("pos")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    last_seen = F.last(F.when(~F.col("joining").isin("T", "K"), F.col("pos")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    before = F.when(F.coalesce(last_k, F.lit(-1)) > F.coalesce(last_seen, F.lit(-1)), "K").otherwise(seen)
    marked = chars.withColumn("before", before).withColumn("after", F.lead("joining").over(by)).withColumn("previous", F.lag("joining").over(by))
    only = marked.where("joining = 'K'").withColumn("island", F.col("pos") - F.row_number().over(by))
    runs = only.groupBy(key, "island").agg(F.min("offset").alias("offset"), F.count("*").cast("int").alias("length"), F.min_by("before", "pos").alias("before"), F.max_by("after", "pos").alias("after"))
    return runs.select(key, "offset", "length", t.verdict(F.col("length"), F.col("before"), F.col("after")).alias("verdict"))


def joining_forms(chars: DataFrame, key: str = "unit_id") -> DataFrame:
    """Forms of letters by lag and lead over visible characters: key, offset, ch, form."""
    by = Window.partitionBy(key).orderBy("pos")
    seen = chars.where("joining <> 'T'").withColumn("before", F.lag("joining").over(by)).withColumn("after", F.lead("joining").over(by))
    stated = ~F.coalesce(F.col("before") == "X", F.lit(False)) & ~F.coalesce(F.col("after") == "X", F.lit(False))
    letters = seen.where(F.col("joining").isin("D", "R") & F.col("ch").rlike(u.ARABIC_LETTER) & stated)
    return letters.select(key, "offset", "ch", t.form_of(F.col("joining"), F.col("before"), F.col("after")).alias("form"))


def arabic_runs(chars: DataFrame, key: str = "unit_id") -> DataFrame:
    """Maximal stretches that joining can cross: key, offset, run."""
    by = Window.partitionBy(key).orderBy("pos")
    part = chars.where("joining <> 'U'").withColumn("island", F.col("pos") - F.row_number().over(by))
    rows = part.groupBy(key, "island").agg(F.min("offset").alias("offset"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda r: r["ch"]), "").alias("run"))
    return rows.drop("island")


def ordinals(rows: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    """1, 2, 3 ... within each key, counting every row."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def cell_cursor(cells: DataFrame, table: list[str], row: str, order: str) -> DataFrame:
    """The row number in its table and the cell number in its row, both from 1."""
    rows = F.dense_rank().over(Window.partitionBy(*table).orderBy(row))
    cell = F.row_number().over(Window.partitionBy(*table, row).orderBy(order))
    return cells.withColumn("row_no", rows).withColumn("cell_no", cell)


def carried(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last stated value before or at each row along an ancestor path."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
