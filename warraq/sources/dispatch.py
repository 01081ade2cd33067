"""Which reader a path needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READABLE = ("pptx", "docx", "xlsx", "html", "htm")


def format_of(path: Column) -> Column:
    """pptx, docx, xlsx or html by the extension; null for a format that isn't read."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(extension == "htm", "html").when(extension.isin(*READABLE), extension)
