"""Units from tables of texts, and the deterministic Arabic that the synthetic tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import PROPS, SPANS

#: Phrases, each with something for a rule to find or to leave alone.
PHRASES = [
    "مرحبا بالعالم العربي",
    "إيرادات 2024 بلغت 15 مليون USD في الربع",
    "PPTX ملف العرض التقديمي الرئيسي",
    "The quarterly report for مصر and partners abroad",
    "نص مع علامة‏ خفية",
    "نص ‫مضمن‬ هنا",
    "نص‌ مع فاصل صفري",
    "ﻣﺮﺣﺒﺎ ﺑﻜﻢ",
    "قال ﷺ كلاما",
    "ﷲ أكبر ﻻ إله",
    "كتـــــاب جميل",
    "كتـاب صغير",
    "هـَ علامة على الحامل",
    "هـ اختصار هجري",
    "فاصل ــــــ مرسوم",
    "• بند أول في القائمة",
    "•بند بلا مسافة",
    "▪ English item",
    "Plain English text only",
    "0123 456 789",
    "٠١٢٣ أرقام هندية",
    "السعر (50 USD) شامل الضريبة",
    "تقرير Q3: نمو 12%",
    "سورة يٰس والقرءان",
    "ݐ حرف ملحق ݐب",
    "لا إله إلا الله",
    "شركة ABC للتجارة - فرع 7",
    "عربي English عربي English",
]


def _case(key: str, values, quote: bool = True) -> str:
    q = "'" if quote else ""
    whens = " ".join(f"when {k} then {q}{v}{q}" for k, v in enumerate(values) if v is not None)
    return f"case {key} {whens} end"


def _resolved(name: str, state: str, value: str) -> dict[str, str]:
    return {f"{name}_state": state, f"{name}_value": f"case when {state} = 'unset' then null else {value} end"}


def _third(expr: str, order=("explicit", "inherited", "unset")) -> str:
    return _case(f"{expr} % 3", order)


#: Characters of a document that stand before its phrase.
_CUT = "cast(case doc_id % 3 when 0 then 0 when 1 then floor(length(coalesce(text, '')) / 2) else length(coalesce(text, '')) end as int)"
_GAP = "case when {} then ' ' else '' end"
#: Columns of a unit as expressions over ``documents`` that Spark and DuckDB read alike.
FLAT = {
    "doc_id": "cast(doc_id as varchar(20))",
    "ord": "doc_id",
    "kind": _case("doc_id % 8", ["paragraph"] * 5 + ["table", "columns", "chart_text"]),
    # the whole text of every document, with a phrase before, behind or in the middle of it
    "text": f"concat(substr(coalesce(text, ''), 1, {_CUT}), {_GAP.format('doc_id % 3 > 0')}, {_case(f'doc_id % {len(PHRASES)}', PHRASES)}, {_GAP.format('doc_id % 3 < 2')}, substr(coalesce(text, ''), 1 + {_CUT}))",
    **_resolved("direction", _third("doc_id"), "case when floor(doc_id / 3) % 2 = 0 then 'rtl' else 'ltr' end"),
    **_resolved("alignment", _third("cast(floor(doc_id / 2) as bigint)", ("unset", "explicit", "inherited")), _case("cast(floor(doc_id / 3) as bigint) % 4", ["left", "start", "right", "center"])),
    **_resolved("inset", _third("cast(floor(doc_id / 5) as bigint)", ("inherited", "unset", "explicit")), _case("cast(floor(doc_id / 7) as bigint) % 4", ["left", "start", "end", "right"])),
    **_resolved("language", _third("cast(floor(doc_id / 11) as bigint)", ("explicit", "unset", "inherited")), _case("cast(floor(doc_id / 13) as bigint) % 6", ["ar", "ar-Arab-EG", "en-US", "arn", "ar_SA", "AR"])),
    **_resolved("complex_font", _third("cast(floor(doc_id / 3) as bigint)", ("unset", "explicit", "inherited")), "'Amiri'"),
    **_resolved("latin_font", _case("doc_id % 2", ["explicit", "unset"]), "'Calibri'"),
    "bullet": _case("cast(floor(doc_id / 4) as bigint) % 3", ["none", "native", "suppressed"]),
    "reversed": "case when doc_id % 6 = 0 then 'div.row@flex-direction' end",
    "span_bidi": _case("cast(floor(doc_id / 2) as bigint) % 3", ["plain", "isolated", "imposed"]),
    "span_chars": "4 + doc_id % 9",
}
PROPERTIES = ("direction", "alignment", "inset", "language", "complex_font", "latin_font")


def flat_sql(table: str = "documents") -> str:
    """The flat units as a query that both engines run."""
    return "select " + ", ".join(f"{e} as {n}" for n, e in FLAT.items()) + f" from {table}"


def units_from_documents(documents: DataFrame) -> DataFrame:
    """One unit per document: its whole text with injected Arabic; needs doc_id and text."""
    flat = documents.select(*(F.expr(e).alias(n) for n, e in FLAT.items()))
    origin = lambda name: F.when(F.col(f"{name}_state") == "inherited", F.struct(F.lit("styles").alias("part"), F.lit(name).alias("property")))
    resolved = [F.struct(F.col(f"{n}_state").alias("state"), F.col(f"{n}_value").alias("value"), origin(n).alias("origin")).alias(n) for n in PROPERTIES]
    reversed_ = F.when(F.col("reversed").isNotNull(), F.struct(F.lit("page.html").alias("part"), F.col("reversed").alias("property"))).alias("reversed")
    length = F.octet_length(F.substring(F.col("text"), F.lit(1), F.col("span_chars").cast("int")))
    span = F.struct(F.lit(0).alias("offset"), length.alias("len"), F.col("span_bidi").alias("bidi"), F.when(F.col("span_bidi") == "imposed", F.when(F.col("ord") % 2 == 0, "rtl").otherwise("ltr")).alias("direction"), F.struct(F.lit("page.html").alias("part"), F.lit("span@unicode-bidi").alias("property")).alias("origin"))
    return flat.select(
        "doc_id", F.lit("table").alias("format"), F.col("ord").cast("bigint").alias("ord"), F.concat(F.lit("documents#p"), F.col("ord") + 1).alias("unit_id"), "kind", "text",
        F.struct(*resolved, F.col("bullet").alias("bullet"), reversed_).cast(PROPS).alias("props"), F.array(span).cast(SPANS).alias("spans"),
        F.struct(F.lit("documents").alias("part"), (F.col("ord") + 1).cast("int").alias("paragraph"), F.lit(None).cast("string").alias("container")).alias("location"),
    )


def units_from_text(frame: DataFrame, id_column: str, text_column: str, part: str = "text") -> DataFrame:
    """Plain texts as paragraphs of which nothing is known but the text."""
    unset = F.struct(F.lit("unset").alias("state"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("struct<part:string,property:string>").alias("origin"))
    props = F.struct(*(unset.alias(n) for n in PROPERTIES), F.lit("none").alias("bullet"), F.lit(None).cast("struct<part:string,property:string>").alias("reversed")).cast(PROPS)
    return frame.select(
        F.col(id_column).cast("string").alias("doc_id"), F.lit("text").alias("format"), F.lit(0).cast("bigint").alias("ord"), F.concat(F.lit(f"{part}#p"), F.lit(1)).alias("unit_id"), F.lit("paragraph").alias("kind"),
        F.col(text_column).alias("text"), props.alias("props"), F.array().cast(SPANS).alias("spans"), F.struct(F.lit(part).alias("part"), F.lit(1).alias("paragraph"), F.lit(None).cast("string").alias("container")).alias("location"),
    )


def container_units(turns: DataFrame) -> DataFrame:
    """A table unit per conversation, its turns' texts in order on lines of their own; blank texts don't count.

    Needs conv_id, turn and text.
    """
    joined = turns.where(F.trim("text") != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    texts = joined.select(F.col("conv_id").cast("string").alias("id"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))
    out = units_from_text(texts, "id", "text", "conversation")
    return out.withColumn("kind", F.lit("table")).withColumn("unit_id", F.lit("conversation#tbl1"))
