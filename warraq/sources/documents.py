"""Files of any readable format to units, from ``binaryFile`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import batched, rows
from ..plans.schema import UNITS
from ..scratch import small_batches
from .dispatch import READABLE, format_of

SCANNED = f"{UNITS}, unread array<string>, error string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Readable files under a path: path, format, content. The pattern is applied before any content is read."""
    pattern = "*.{" + ",".join(e for x in READABLE for e in (x, x.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", format_of(F.col("path")).alias("format"), "content")


def scan(found: DataFrame) -> DataFrame:
    """Rows (path, format, content) to units, beside which each file has a row for what wasn't read or for its error.

    Those rows have no unit_id. A file that can't be read doesn't stop others.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(SCANNED))

    def run(batches):
        def read():
            for f in rows(batches):
                doc, fmt = f["path"], f["format"]
                each, unread, error = _read(doc, fmt, f["content"])
                yield from ({"doc_id": doc, "format": fmt, **r} for r in each)
                yield {"doc_id": doc, "format": fmt, "unread": unread, "error": error}

        yield from batched(read(), kind)

    small_batches(found.sparkSession)
    return found.select("path", "format", "content").mapInArrow(run, SCANNED)


def _read(doc: str, fmt: str | None, data: bytes | None):
    from . import html, ooxml

    try:
        if data is None or fmt is None:
            return [], [], "nothing to read"
        if fmt == "html":
            page = html.Page(doc.rsplit("/", 1)[-1], data.decode("utf-8"))
            return page.units, page.unread, None
        units, unread = ooxml.read(data, fmt)
        return units, unread, None
    except (ooxml.FormatError, UnicodeDecodeError) as e:
        return [], [], str(e)


def units(scanned: DataFrame) -> DataFrame:
    return scanned.where("unit_id is not null").drop("unread", "error")


def unread(scanned: DataFrame) -> DataFrame:
    """(doc_id, ord, name)."""
    return scanned.where("unit_id is null").select("doc_id", F.posexplode("unread").alias("ord", "name")).withColumn("ord", F.col("ord").cast("bigint"))


def errors(scanned: DataFrame) -> DataFrame:
    return scanned.where("unit_id is null and error is not null").select("doc_id", "format", "error")
