"""Queries over the synthetic tables for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as a
from ..functions import bidi
from ..functions import text as t
from ..functions import unicode as u
from ..operators import aggregates, joins, repair, report, rules, windows
from ..scratch import small_batches
from . import units as un

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Deal rows to all cores where the input has fewer files than there are cores; larger inputs aren't shuffled."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if len(frame.inputFiles()) < cores else frame


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.units_from_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.expr(un.FLAT["ord"]).alias("ord"), F.expr(un.FLAT["text"]).alias("text"))



# ---- functions ----


@query
def f01_05_script_classes(spark, sf_dir):
    c = F.col("text")
    return texts(spark, sf_dir).select("ord", t.count_of(c, u.ARABIC_LETTER).alias("arabic_letters"), t.has_arabic(c).alias("arabic"), t.has_ltr_or_digits(c).alias("ltr_or_digits"), t.has_arabic_indic_digit(c).alias("indic_digit"), t.has_arabic_mark(c).alias("mark"))


@query
def f06_09_presentation_forms(spark, sf_dir):
    c = F.col("text")
    return texts(spark, sf_dir).select("ord", t.presentation_forms(c).alias("forms"), t.word_ligatures(c).alias("ligatures"), t.normalize_presentation_forms(c).alias("logical"))


@query
def f10_12_controls(spark, sf_dir):
    c = F.col("text")
    hit = lambda n: F.array_join(F.transform(t.controls(c), lambda h: h[n].cast("string")), ",")
    return texts(spark, sf_dir).select("ord", hit("offset").alias("offsets"), hit("codepoint").alias("codepoints"), hit("name").alias("names"), t.strip_controls(c).alias("stripped"))


@query
def f13_dominant_direction(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", t.dominant_direction(F.col("text")).alias("dominant"))


@query
def f14_auto_direction(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", bidi.orders(F.col("text"))["auto"].alias("auto"))


@query
def f15_16_resolved_orders(spark, sf_dir):
    d = texts(spark, sf_dir).withColumn("o", bidi.orders(F.when(t.has_arabic(F.col("text")), F.col("text"))))
    return d.select("ord", "o.rtl", "o.ltr", (F.col("o.rtl") != F.col("o.ltr")).alias("differs"))


@query
def f17_imposed(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", t.imposed(F.col("text"), F.lit("rtl")).alias("rtl"), t.imposed(F.col("text"), F.lit("ltr")).alias("ltr"))


@query
def f18_19_isolated_orders(spark, sf_dir):
    d = units(spark, sf_dir).where(t.has_arabic(F.col("text")))
    span = F.transform("spans", lambda s: F.struct(s["offset"].alias("offset"), s["len"].alias("len")))
    d = d.withColumn("apart", F.get(bidi.isolated_orders(F.col("text"), F.lit("rtl"), span), 0)).withColumn("now", bidi.orders(F.col("text"))["rtl"])
    return d.select("ord", "apart", (F.col("apart") != F.col("now")).alias("changes"))


@query
def f20_joining_types(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", t.joining_types(F.col("text")).alias("types"))


def _listed(array, *names):
    return F.array_join(F.transform(array, lambda e: F.concat_ws(":", *(e[n].cast("string") for n in names))), " ")


@query
def f21_22_joining_forms(spark, sf_dir):
    forms = F.transform(t.joining_forms(F.col("text")), lambda e: F.struct(e["offset"].alias("offset"), t.form_feature(e["form"]).alias("feature")))
    return texts(spark, sf_dir).select("ord", _listed(forms, "offset", "feature").alias("forms"))


@query
def f23_arabic_runs(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", _listed(t.arabic_runs(F.col("text")), "offset", "run").alias("runs"))


@query
def f24_27_tatweel(spark, sf_dir):
    d = texts(spark, sf_dir).withColumn("runs", t.tatweel_runs(F.col("text")))
    return d.select("ord", _listed(F.col("runs"), "offset", "length", "verdict").alias("runs"), F.array_join(t.padding_offsets(F.col("runs")).cast("array<string>"), ",").alias("padding"))


@query
def f28_30_character_names(spark, sf_dir):
    c = F.col("ch")
    d = texts(spark, sf_dir).select(F.explode(t.chars(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return d.select("ch", "n", t.char_name(c).alias("name"), t.is_format(c).alias("format"), t.judges(c).alias("judged"))


@query
def f31_arabic_tag(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(un.FLAT["language_value"]).alias("tag"))
    return d.select("doc_id", t.is_arabic_tag(F.col("tag")).alias("arabic"))


@query
def f32_leading_marker(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", t.leading_marker(F.col("text")).alias("marker"), t.strip_marker(F.col("text")).alias("stripped"))


@query
def f33_carries_strong(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", t.carries_strong(F.col("text"), F.lit("rtl")).alias("rtl"), t.carries_strong(F.col("text"), F.lit("ltr")).alias("ltr"))


@query
def f34_offending_codepoints(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", F.array_join(t.offending_codepoints(F.col("text"), u.PRESENTATION_FORM), " ").alias("offenders"))


@query
def f35_span_text(spark, sf_dir):
    k = (F.col("ord") % 7).cast("int")
    return texts(spark, sf_dir).select("ord", t.span_text(F.col("text"), k, F.lit(6)).alias("part"))


@query
def f36_37_resolved_values(spark, sf_dir):
    d = units(spark, sf_dir)
    return d.select("ord", rules.effective("alignment").alias("effective"), (rules.effective("alignment") != "left").alias("coherent"), rules.inherited("alignment").alias("origin"), rules.stated("alignment").alias("explicit"))


@query
def f38_escape(spark, sf_dir):
    return texts(spark, sf_dir).select("ord", t.escape(F.col("text")).alias("escaped"))


@query
def f39_column_of(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "A").when(F.col("p_partkey") % 3 == 1, "ab").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "Z").otherwise(""), F.col("p_partkey").cast("string")).alias("reference"))
    return d.select("p_partkey", "reference", t.column_of(F.col("reference")).alias("column_no"))


@query
def f40_43_attributes(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr(ATTRIBUTES["word"]).alias("word"), F.expr(ATTRIBUTES["flag"]).alias("flag"))
    w = F.col("word")
    return d.select(
        "p_partkey", t.is_true(F.col("flag")).alias("is_on"), a.alignment("pptx", w).alias("pptx"), a.alignment("docx", w).alias("docx"), a.alignment("xlsx", w).alias("xlsx"), a.alignment("html", w).alias("html"),
        a.lowered_alignment("pptx", a.alignment("html", w), F.col("p_partkey") % 2 == 0).alias("lowered_pptx"), a.lowered_alignment("docx", a.alignment("docx", w), F.lit(True)).alias("lowered_docx"),
        a.lowered_alignment("xlsx", a.alignment("html", w), F.col("p_partkey") % 2 == 0).alias("lowered_xlsx"), a.reading_order(F.col("flag")).alias("reading_order"), a.direction(w).alias("direction"),
    )


ATTRIBUTES = {
    "word": un._case("p_partkey % 14", ["l", "ctr", "just", "start", "left", "end", "both", "lowKashida", " Center ", "justify-all", "RTL", "ltr ", "distribute", "thaiDist"]),
    "flag": un._case("p_partkey % 6", ["1", "true", "on", "0", "2", None]),
    "stack": un._case("p_partkey % 4", ['"Amiri", serif', "Arial", " Noto Naskh , x", ""]),
    "margin": un._case("p_partkey % 5", ["0", "12px", "-3.5em", "auto", "0.0"]),
    "columns": un._case("p_partkey % 4", ["2", "auto 3", "12em", None]),
    "face": un._case("p_partkey % 5", ["+mn-cs", "+mj-lt", "Calibri", "+mn-ea", "+xx-cs"]),
    "part": un._case("p_partkey % 4", ["ppt/slides/slide1.xml", "word/document.xml", "a.xml", "xl/_rels/workbook.xml.rels"]),
    "id": un._case("p_partkey % 6", ["slide1.xml#p3", "doc#tbl0", "x#cols12", "foreign", "s#c7", "a#b#p2"]),
}


@query
def f45_50_styles(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(ATTRIBUTES[n]).alias(n) for n in ("stack", "margin", "columns", "face")))
    ref = a.theme_reference(F.col("face"))
    return d.select(
        "p_partkey", a.first_family(F.col("stack")).alias("family"), a.inset(F.col("margin"), F.lit("0"), F.lit(None), F.lit(None)).alias("inset"), a.column_count(F.lit(None), F.col("columns")).alias("columns"),
        a.describe(F.lit("div"), F.when(F.col("p_partkey") % 3 == 0, "main").otherwise(""), F.lit("row wide")).alias("described"), a.outline_level((F.col("p_partkey") % 12 - 1).cast("string")).alias("level"), ref["font"].alias("font"), ref["script"].alias("script"),
    )


@query
def f48_collapse_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(a.collapse_space(F.col("text")), 256).alias("collapsed_sha256"))


@query
def f52_54_names_and_ids(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr(ATTRIBUTES["part"]).alias("part"), F.expr(ATTRIBUTES["id"]).alias("id"))
    ids = a.unit_id_parts(F.col("id"))
    loc = F.struct(F.col("part").alias("part"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("paragraph"), F.when(F.col("p_partkey") % 3 == 0, "table 1").alias("container"))
    return d.select("p_partkey", a.fold_family(F.concat(F.lit(" "), F.upper("part"))).alias("folded"), a.rels_part(F.col("part")).alias("rels"), a.rels_source(F.col("part")).alias("source"), ids["part"].alias("id_part"), ids["kind"].alias("id_kind"), ids["number"].alias("id_number"), a.location_text(loc).alias("location"))


# ---- rules ----


def _rule_query(name: str, id_: str):
    def run(spark, sf_dir):
        found = rules.diagnostics(units(spark, sf_dir), rules=[id_])
        return found.select("ord", "severity", F.concat_ws("|", "evidence.offenders").alias("offenders"), F.col("evidence.inherited_from").alias("inherited_from"), "fixable")

    run.__name__ = name
    QUERIES[name] = run


#: The rules that need no font files.
FONTLESS = [r for r in rules.REGISTRY if r not in ("font-coverage", "shaping-broken")]
for _n, _id in enumerate(FONTLESS, start=1):
    _rule_query(f"r{_n:02d}_{_id.replace('-', '_')}", _id)


@query
def x01_audit(spark, sf_dir):
    found = rules.diagnostics(units(spark, sf_dir))
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.count_if("fixable").alias("fixable"))


NATIVE = [r for r in FONTLESS if not rules.REGISTRY[r].needs]


@query
def x01_audit_native(spark, sf_dir):
    found = rules.diagnostics(units(spark, sf_dir), rules=NATIVE)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("findings"))


@query
def a01_report(spark, sf_dir):
    d = units(spark, sf_dir)
    out = report.report(d, rules.diagnostics(d, rules=NATIVE), strict=True)
    return out.select("doc_id", "units_scanned", "arabic_units", "mixed_units", "errors", "warnings", "notes", "blocking")


@query
def a02_rollup(spark, sf_dir):
    d = units(spark, sf_dir)
    return report.rollup(d, rules.diagnostics(d, rules=["bidi-control", "presentation-forms", "tatweel-padding"]))


@query
def a04_coverage(spark, sf_dir):
    d = texts(spark, sf_dir).select(F.col("ord").alias("unit_id"), "text", F.lit("f").alias("font"))
    covered = spark.createDataFrame([("f", c) for c in COVERED], "font string, char string")
    return aggregates.coverage(d, covered)


COVERED = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"


@query
def a07_08_control_names(spark, sf_dir):
    d = texts(spark, sf_dir).select(F.explode(t.controls(F.col("text"))).alias("h"))
    return d.groupBy("h.name").agg(F.count("*").alias("hits"))


@query
def a09_container_text(spark, sf_dir):
    d = aggregates.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return d.select("conv_id", F.sha2("text", 256).alias("text_sha256"))


@query
def a10_ordered_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return aggregates.ordered_distinct(d, ["user_id"], "event_id", "event_type").select("user_id", F.array_join("distinct_values", ",").alias("types"))


@query
def a11_role_of_part(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 9).alias("role_rank"))
    return aggregates.role_of_part(d)


@query
def a12_cascade_argmax(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 997).alias("element"), (F.col("l_linenumber") % 3).alias("property"), (F.col("l_quantity") > 45).alias("important"), (F.col("l_suppkey") % 3).alias("origin_rank"), (F.col("l_partkey") % 2).alias("a"), (F.col("l_partkey") % 5).alias("b"), F.lit(0).alias("c"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").cast("string").alias("value"))
    return aggregates.cascade_winner(d, ["element", "property"])


@query
def a13_family_winner(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(a.fold_family(F.col("p_brand")).alias("folded"), (F.col("p_size") % 2 == 0).alias("regular"), (F.col("p_size") % 7).alias("dir_ord"), F.col("p_partkey").alias("file_ord"), F.col("p_partkey").cast("string").alias("path"))
    return aggregates.family_winner(d)


@query
def a15_derived_formats(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("doc_id"), (F.col("l_partkey") % 4).alias("base"), F.col("l_returnflag").alias("alignment"), F.col("l_linestatus").alias("reading_order"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return aggregates.derived_formats(d, 10)


@query
def a16_unread_list(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("string").alias("doc_id"), F.col("event_type").alias("name"))
    return aggregates.unread_list(d).select("doc_id", F.array_join("unread", ",").alias("unread"))


# ---- joins ----


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("doc_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cell"), F.col("l_partkey").alias("idx"), (F.col("l_partkey") % 12).alias("s"))


@query
def j01_shared_strings(spark, sf_dir):
    strings = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("doc_id"), (F.col("p_partkey") + 50).alias("idx"), F.col("p_name").alias("text"))
    return joins.shared_strings(_cells(spark, sf_dir), strings).select("doc_id", "cell", "text")


def _xfs(spark):
    return spark.range(120).select((F.col("id") % 10).alias("doc_id"), F.floor(F.col("id") / 10).alias("s"), (F.floor(F.col("id") / 10) % 3).alias("style"), F.when(F.col("id") % 4 != 0, F.col("id") % 5).alias("font"), F.when(F.col("id") % 3 == 0, "right").alias("horizontal"), F.when(F.col("id") % 7 == 0, "2").alias("reading_order"), F.when(F.col("id") % 6 == 0, False).alias("apply_font"), F.when(F.col("id") % 9 == 0, False).alias("apply_alignment"))


def _style_xfs(spark):
    return spark.range(30).select((F.col("id") % 10).alias("doc_id"), F.floor(F.col("id") / 10).alias("style"), (F.col("id") % 5).alias("font"), F.when(F.col("id") % 2 == 0, "center").alias("horizontal"), F.lit("1").alias("reading_order"), F.lit(None).cast("boolean").alias("apply_font"), F.when(F.col("id") % 5 == 0, False).alias("apply_alignment"))


@query
def j02_cell_formats(spark, sf_dir):
    fonts = spark.range(40).select((F.col("id") % 10).alias("doc_id"), F.floor(F.col("id") / 10).alias("font"), F.concat(F.lit("Font "), F.col("id")).alias("name"))
    return joins.cell_formats(_cells(spark, sf_dir), _xfs(spark), _style_xfs(spark), fonts)


@query
def j03_sheet_parts(spark, sf_dir):
    sheets = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("doc_id"), F.col("o_orderkey").alias("name"), F.concat(F.lit("rId"), F.col("o_custkey") % 7).alias("rel_id"))
    rels = spark.range(500).select((F.col("id") % 100).alias("doc_id"), F.concat(F.lit("rId"), F.floor(F.col("id") / 100)).alias("rel_id"), F.concat(F.lit("xl/sheet"), F.col("id")).alias("target"), (F.col("id") % 11 == 0).alias("external"))
    return joins.sheet_parts(sheets, rels)


@query
def j04_axis_group(spark, sf_dir):
    axes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("axis"), (F.col("o_custkey") % 90).alias("ax_id"))
    groups = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 80).alias("ax_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("group_name"))
    return joins.first_match(axes, groups, ["ax_id"], "ord", "group_name")


@query
def j05_installed_family(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" brand#"), F.col("doc_id") % 60).alias("font"))
    families = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_brand").alias("path"))
    return joins.installed_family(d, families).select("doc_id", "path")


@query
def j06_placeholder_match(spark, sf_dir):
    shapes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 30).alias("doc_id"), F.col("o_orderkey").alias("shape"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 4).alias("idx"), F.when(F.col("o_custkey") % 2 == 0, "title").otherwise("body").alias("text_style"))
    placeholders = spark.range(120).select((F.col("id") % 30).alias("doc_id"), F.nullif(F.floor(F.col("id") / 30), F.lit(0)).alias("idx"), F.when(F.col("id") % 3 == 0, "title").otherwise("body").alias("text_style"), F.col("id").alias("placeholder"))
    return joins.placeholder_match(shapes, placeholders).select("shape", "placeholder")


def _parents(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.when(F.col("c_custkey") % 50 == 7, F.col("c_custkey") + 3).when(F.col("c_custkey") > 4, F.floor(F.col("c_custkey") / 3)).alias("parent"))


@query
def j07_08_ancestors(spark, sf_dir):
    return joins.ancestors(spark, _parents(spark, sf_dir)).select("child", "ancestor", F.col("hop").cast("int").alias("hop"))


@query
def j09_nearest_stated(spark, sf_dir):
    chain = joins.ancestors(spark, _parents(spark, sf_dir))
    stated = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ancestor"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("direction"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("font"))
    return joins.nearest_stated(chain, stated, ["direction", "font"])


@query
def j10_theme_typeface(spark, sf_dir):
    runs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), (F.col("p_size") % 5).alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, "major").otherwise("minor").alias("font"), F.when(F.col("p_partkey") % 3 == 0, "cs").otherwise("latin").alias("script"))
    theme = spark.range(20).select((F.col("id") % 5).alias("doc_id"), F.when(F.floor(F.col("id") / 5) % 2 == 0, "major").otherwise("minor").alias("font"), F.when(F.floor(F.col("id") / 10) == 0, "cs").otherwise("latin").alias("script"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("Face"), F.col("id"))).alias("typeface"))
    return joins.theme_typeface(runs, theme).select("run", "typeface")


@query
def j11_repair_locations(spark, sf_dir):
    repairs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).cast("string").alias("doc_id"), F.col("o_custkey").cast("string").alias("unit_id"), F.col("o_orderkey").alias("repair"))
    places = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 9).cast("string").alias("doc_id"), (F.col("c_custkey") + 25).cast("string").alias("unit_id"), F.col("c_name").alias("place"))
    return joins.repair_locations(repairs, places).select("repair", "place")


@query
def j12_unknown_parts(spark, sf_dir):
    edits = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("doc_id"), F.col("l_partkey").alias("part")).distinct()
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("doc_id"), (F.col("p_partkey") + 30).alias("part"))
    return joins.unknown_parts(edits, parts)


def _planned(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("unit_id"), F.expr(un._case("doc_id % 4", ["pptx", "docx", "xlsx", "html"])).alias("format"), F.expr(un._case("cast(floor(doc_id / 4) as bigint) % 8", KINDS)).alias("kind"))
    return d.select("doc_id", "unit_id", F.struct("kind").alias("fix")), d.select("doc_id", "unit_id", "format")


KINDS = list(repair.SUPPORTED["pptx"])


@query
def j13_supported_semi(spark, sf_dir):
    p, of = _planned(spark, sf_dir)
    return repair.partition(p, of, repair.capabilities(spark))[0].select("doc_id", "fix.kind")


@query
def j13_unsupported_anti(spark, sf_dir):
    p, of = _planned(spark, sf_dir)
    return repair.partition(p, of, repair.capabilities(spark))[1].select("doc_id", "fix.kind")


@query
def j14_before_after(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 100).alias("doc_id"), F.lit("u").alias("unit_id"), F.col("event_type").alias("rule"), "event_id")
    # all events before and after; some users and rules are others afterwards
    after = e.withColumn("doc_id", F.col("doc_id") + 40).withColumn("rule", F.when(F.col("event_id") % 5 == 0, F.concat("rule", F.lit("!"))).otherwise(F.col("rule")))
    return repair.compare(e, after)


@query
def j15_span_containment(spark, sf_dir):
    pos = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") % 500).alias("pos"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("hit"))
    spans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") * 11).alias("offset"), F.lit(40).alias("len"))
    return joins.within_span(pos, spans, ["k"]).select("k", "hit", "pos")


@query
def j18_newest_entry(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("object"), F.col("event_id").alias("section"), "event_type")
    return joins.newest_first(d, ["object"], "section")


# ---- order, sets, windows ----


@query
def o1_report_order(spark, sf_dir):
    d = rules.diagnostics(units(spark, sf_dir), rules=["bidi-control", "presentation-forms", "tatweel-padding", "language-missing"])
    return report.ordered(d).select("severity_rank", "rule", "ord", "hit_ord")


@query
def o4_deletions(spark, sf_dir):
    d = texts(spark, sf_dir)
    offsets = F.concat(F.transform(t.controls(F.col("text")), lambda h: h["offset"]), t.padding_offsets(t.tatweel_runs(F.col("text"))))
    return d.select("ord", t.delete_at(F.col("text"), offsets).alias("text"))


@query
def p04_grids(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3000).alias("doc_id"), F.lit("sheet1").alias("part"), F.concat(F.when(F.col("l_partkey") % 4 == 0, "B").otherwise("A"), F.col("l_linenumber")).alias("reference"), F.when(F.col("l_partkey") % 6 == 0, "").otherwise("x").alias("text"))
    return aggregates.grids(d)


@query
def s02_format_dispatch(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/file"), F.col("page_id"), F.expr(un._case("page_id % 6", [".PPTX", ".docx", ".xlsx", ".htm", ".html", ".odt"]))).alias("path"))
    from ..sources.dispatch import format_of

    return d.select("page_id", format_of(F.col("path")).alias("format"))


@query
def u01_union_of_rules(spark, sf_dir):
    d = units(spark, sf_dir)
    out = rules.diagnostics(d, rules=["bidi-control"]).select("ord", "rule").unionByName(rules.diagnostics(d, rules=["tatweel-padding"]).select("ord", "rule"))
    return out


@query
def u03_missing_parts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return c.exceptAll(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct())


def _characters(spark, sf_dir):
    return windows.joined_characters(texts(spark, sf_dir), "ord", "text")


@query
def w1_tatweel_runs(spark, sf_dir):
    return windows.tatweel_runs(_characters(spark, sf_dir), "ord")


@query
def w2_joining_forms(spark, sf_dir):
    return windows.joining_forms(_characters(spark, sf_dir), "ord")


@query
def w3_arabic_runs(spark, sf_dir):
    return windows.arabic_runs(_characters(spark, sf_dir), "ord")


@query
def w4_ordinals(spark, sf_dir):
    return windows.ordinals(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query
def w5_cell_cursor(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey")).alias("tbl"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return windows.cell_cursor(d, ["tbl"], "line", "k")


@query
def w7_carried(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("stated"))
    return windows.carried(d, ["user_id"], "event_id", "stated")


# ---- repairs and sinks ----

ALL = rules.RepairOptions(complex_font="Amiri", convert_bullets=True, strip_tatweel=True, align=True)


@query
def x02_plan(spark, sf_dir):
    return repair.plan(units(spark, sf_dir), ALL).select("ord", "rule_ord", "fix.kind", "fix.value")


@query
def x04_apply_text(spark, sf_dir):
    d = units(spark, sf_dir)
    return repair.apply(d, repair.plan(d, ALL)).select("ord", "text")


@query
def x10_repair_and_audit(spark, sf_dir):
    changes = repair.repaired(units(spark, sf_dir), ALL)[2]
    return changes.groupBy("rule", "change").agg(F.count("*").alias("units"))


@query
def k02_json_report(spark, sf_dir):
    d = units(spark, sf_dir)
    found = rules.diagnostics(d, rules=NATIVE)
    return report.as_json(report.report(d, found), found)


@query
def k01_text_report(spark, sf_dir):
    d = units(spark, sf_dir)
    found = rules.diagnostics(d, rules=NATIVE)
    return report.as_text(report.report(d, found), found)


@query
def k04_rules_listing(spark, sf_dir):
    return rules.listing(spark)


@query
def k05_explain(spark, sf_dir):
    c = F.col("text")
    d = texts(spark, sf_dir).withColumn("o", bidi.orders(c))
    return d.select("ord", t.escape(c).alias("logical"), t.dominant_direction(c).alias("dominant"), F.col("o.auto").alias("auto"), (F.col("o.rtl") != F.col("o.ltr")).alias("order_differs"), t.escape(F.col("o.rtl")).alias("visual_rtl"), t.escape(F.col("o.ltr")).alias("visual_ltr"))


# ---- files made from rows, read back ----


def _built(spark, sf_dir, build, fmt: str):
    """(path, format, content): a file per document, built from its injected text and direction."""
    import pyarrow as pa

    from ..functions.arrow import batched
    from ..functions.arrow import rows as rows_of

    kind = pa.schema([("path", pa.string()), ("format", pa.string()), ("content", pa.binary())])
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.expr(un.FLAT["ord"]).alias("ord"), F.expr(un.FLAT["text"]).alias("text"), F.expr(un.FLAT["direction_state"]).alias("state"), F.expr(un.FLAT["direction_value"]).alias("direction"))

    def run(batches):
        def files():
            for r in rows_of(batches):
                content = build(r["text"], r["direction"] if r["state"] == "explicit" else None)
                yield {"path": str(r["ord"]), "format": fmt, "content": content if isinstance(content, bytes) else content.encode()}

        yield from batched(files(), kind)

    return rows.mapInArrow(run, "path string, format string, content binary")


def _shown(found):
    d = found.where("unit_id is not null")
    return d.select(F.col("doc_id").cast("bigint").alias("ord"), "kind", "text", F.col("props.direction.state").alias("state"), F.col("props.direction.value").alias("direction"))


@query
def s05_pptx_units(spark, sf_dir):
    from ..sources import documents
    from . import packages as pk

    return _shown(documents.scan(_built(spark, sf_dir, lambda x, d: pk.pptx([pk.slide_body([(x, d)])]), "pptx")))


@query
def s07_docx_units(spark, sf_dir):
    from ..sources import documents
    from . import packages as pk

    return _shown(documents.scan(_built(spark, sf_dir, lambda x, d: pk.docx(pk.word_paragraph(x, d)), "docx")))


@query
def s08_xlsx_units(spark, sf_dir):
    from ..sources import documents
    from . import packages as pk

    return _shown(documents.scan(_built(spark, sf_dir, lambda x, d: pk.xlsx([[x, "b"]], d and d == "rtl"), "xlsx")))


@query
def s13_html_units(spark, sf_dir):
    from ..sources import documents
    from . import packages as pk

    return _shown(documents.scan(_built(spark, sf_dir, pk.html, "html")))


@query
def s13_pages(spark, sf_dir):
    from ..sources import html

    d = html.units(spread(table(spark, sf_dir, "pages").select("page_id", "html")), "page_id", "html")
    return d.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("characters"))


@query
def s16_unread_sheets(spark, sf_dir):
    from ..sources import html

    linked = table(spark, sf_dir, "pages").select("page_id", F.expr("concat('<link rel=\"stylesheet\" href=\"', case page_id % 4 when 0 then 'https://cdn.test/a.css' when 1 then '/root.css' when 2 then 'own.css' else 'gone.css' end, '\"><p>x</p>')").alias("html"))
    return html.unread(linked, "page_id", "html", {"own.css": "p{direction:rtl}"}).select("doc_id", "name")


@query
def s19_pdf_pages(spark, sf_dir):
    from ..sources.pdf import Pdf
    from . import packages as pk

    def build(x, d):
        pdf = Pdf(pk.pdf([x.encode(), b"second"]))
        return b"|".join(pdf.content(p) for p in pdf.pages())

    return _built(spark, sf_dir, build, "pdf").select(F.col("path").cast("bigint").alias("ord"), F.decode("content", "UTF-8").alias("content"))


@query
def x06_docx_rewrite(spark, sf_dir):
    """Controls are taken out of packages, which are then read again."""
    from ..sources import documents, rewrite
    from . import packages as pk

    found = _built(spark, sf_dir, lambda x, d: pk.docx(pk.word_paragraph(x, d)), "docx")
    units_ = documents.units(documents.scan(found))
    plan = rules.diagnostics(units_, rules=["bidi-control"]).where("fix is not null").select("doc_id", "unit_id", "fix")
    return _shown(documents.scan(rewrite.rewrite_all(found, units_, plan)))


def _faces(spark):
    rows = [("a.ttf", 0, ["Amiri"], "Regular", True, list(COVERED), [(c, f) for c in COVERED[:3] for f in ("init", "medi", "fina")], True), ("b.ttf", 0, ["amiri "], "Bold", False, list(COVERED), [], True)]
    return spark.createDataFrame(rows, "path string, face int, families array<string>, subfamily string, regular boolean, covered array<string>, shapes array<struct<ch:string,feature:string>>, readable boolean")


@query
def r16_17_font_rules(spark, sf_dir):
    from ..operators import fonts

    return fonts.diagnostics(units(spark, sf_dir), _faces(spark)).select("ord", "rule", "severity", F.size("evidence.offenders").alias("offenders"))


@query
def a06_shaping_counts(spark, sf_dir):
    from ..operators import fonts

    return fonts.shaping_counts(units(spark, sf_dir), _faces(spark)).select(F.col("doc_id").cast("bigint").alias("ord"), "required", "observable", "produced")


@query
def st1_tumbling_counts(spark, sf_dir):
    from ..streaming import audit

    return audit.tumbling_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", None)
