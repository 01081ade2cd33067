"""The rules: one pass over units gives all their diagnostics.

Each rule is a Column of zero or more diagnostics of a unit. They share the
features computed once by ``features``; the one Python step is fed null for
texts without Arabic letters. No rule shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bidi
from ..functions import text as t
from ..functions import unicode as u
from ..functions.attributes import origin_text
from ..plans.schema import DIAGNOSTIC, FIX, SEVERITIES
from ..scratch import small_batches


@dataclass(frozen=True)
class RepairOptions:
    """What a repair may do. What is reported never depends on it, only what is fixable."""

    language: str = "ar-SA"
    complex_font: str | None = None
    convert_bullets: bool = False
    strip_tatweel: bool = False
    align: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    check: Callable[[RepairOptions], Column]
    containers: bool = False
    needs: frozenset = field(default_factory=frozenset)


REGISTRY: dict[str, Rule] = {}
NONE = F.lit


def rule(id_: str, description: str, containers: bool = False, needs: Iterable[str] = ()):
    def add(f):
        REGISTRY[id_] = Rule(id_, description, f, containers, frozenset(needs))
        return f

    return add


def effective(name: str) -> Column:
    return F.when(F.col(f"props.{name}.state") != "unset", F.col(f"props.{name}.value"))


def stated(name: str) -> Column:
    return F.when(F.col(f"props.{name}.state") == "explicit", F.col(f"props.{name}.value"))


def inherited(name: str) -> Column:
    return F.when(F.col(f"props.{name}.state") == "inherited", origin_text(F.col(f"props.{name}.origin")))


def features(units: DataFrame, needs: Iterable[str] = ("orders", "spans")) -> DataFrame:
    """The columns that rules share. ``needs`` names the Python steps to run."""
    small_batches(units.sparkSession)
    out = units.withColumn("high", t.high(F.col("text"))).withColumn("ar_count", t.count_of(F.col("high"), u.ARABIC_LETTER)).withColumn("la_count", t.count_of(F.col("text"), "[A-Za-z]"))
    out = out.withColumn("has_arabic", F.coalesce(F.col("ar_count") > 0, F.lit(False))).withColumn("dominant", F.when(F.col("ar_count") > F.col("la_count"), "rtl").otherwise("ltr"))
    out = out.withColumn("runs", _runs(_gateway()))
    paragraph = F.col("has_arabic") & (F.col("kind") == "paragraph")
    if "orders" in needs:
        out = out.withColumn("orders", bidi.orders(F.when(paragraph, F.col("text"))))
        out = out.withColumn("judged", F.coalesce(stated("direction"), F.col("orders.auto")))
        out = out.withColumn("moved", F.coalesce((F.col("judged") != F.col("dominant")) & (F.col("orders.rtl") != F.col("orders.ltr")), F.lit(False)))
    if "spans" in needs:
        some = paragraph & (F.size("spans") > 0)
        cut = F.transform("spans", lambda s: t.span_text(F.col("text"), s["offset"], s["len"]))
        out = out.withColumn("span_text", F.when(some, cut))
        plain = F.transform("spans", lambda s: F.when(s["bidi"] == "plain", F.struct(s["offset"].alias("offset"), s["len"].alias("len"))))
        imposed = F.exists("spans", lambda s: s["bidi"] == "imposed")
        out = out.withColumn("isolated", bidi.isolated_orders(F.when(some, F.col("text")), F.col("judged"), F.when(some & F.exists("spans", lambda s: s["bidi"] == "plain"), plain)))
        out = out.withColumn("declared", bidi.each_order(F.when(some & imposed, F.col("span_text")), F.transform("spans", lambda s: F.coalesce(s["direction"], F.lit("ltr")))))
    return out


def order(direction: Column) -> Column:
    return F.when(direction == "rtl", F.col("orders.rtl")).otherwise(F.col("orders.ltr"))


def fix(kind: str, value=None, offsets=None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (none if value is None else value).cast("string").alias("value"), (none if offsets is None else offsets).cast("array<int>").alias("offsets")).cast(FIX)


def finding(id_: str, severity, message, *, logical=None, declared=None, expected=None, offenders=None, source=None, fixable=False, repair=None, hit=0) -> Column:
    none, as_col = F.lit(None), lambda x: x if isinstance(x, Column) else F.lit(x)
    severity = as_col(severity)
    rank = F.when(severity == "error", SEVERITIES["error"]).when(severity == "warning", SEVERITIES["warning"]).otherwise(SEVERITIES["note"])
    evidence = F.struct(*(as_col(x).cast("string").alias(n) for n, x in (("logical", logical), ("visual_declared", declared), ("visual_expected", expected))), (F.array().cast("array<string>") if offenders is None else offenders).alias("offenders"), as_col(source).cast("string").alias("inherited_from"))
    return F.struct(
        F.lit(id_).alias("rule"), F.lit(list(REGISTRY).index(id_)).alias("rule_ord"), as_col(hit).cast("int").alias("hit_ord"), severity.alias("severity"), rank.alias("severity_rank"),
        as_col(message).alias("message"), evidence.alias("evidence"), as_col(fixable).alias("fixable"), (none if repair is None else repair).cast(FIX).alias("fix"),
    ).cast(DIAGNOSTIC)


def only(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found)).otherwise(F.array().cast(f"array<{DIAGNOSTIC}>"))


def _span_finding(id_: str, s: Column, k: Column, severity, message, logical, declared, expected) -> Column:
    offender = F.concat(s["origin"]["property"], F.lit(" ×"), s["len"].cast("string"), F.lit(" @"), s["offset"].cast("string"))
    return finding(id_, severity, message, logical=logical, declared=declared, expected=expected, offenders=F.array(offender), source=origin_text(s["origin"]), hit=k)


def _spans(each: Callable[[Column, Column], Column]) -> Column:
    found = F.array_compact(F.transform(F.coalesce("spans", F.array().cast("array<struct<offset:int,len:int,bidi:string,direction:string,origin:struct<part:string,property:string>>>")), each))
    return F.when(F.col("has_arabic") & (F.size("spans") > 0), found).otherwise(F.array().cast(f"array<{DIAGNOSTIC}>"))


@rule("bidi-control", "A text holds invisible direction controls")
def bidi_control(o: RepairOptions) -> Column:
    hits = t.controls(F.col("text"))
    names = F.array_sort(F.array_distinct(F.transform(t.controls(F.col("high")), lambda h: h["name"])))
    message = F.concat(t.count_of(F.col("high"), u.CONTROL).cast("string"), F.lit(" direction control(s) in the text: "), F.array_join(names, ", "))
    return only(F.col("high").rlike(u.CONTROL), finding("bidi-control", "error", message, logical=F.col("text"), offenders=names, fixable=True, repair=fix("RemoveControls", offsets=F.transform(hits, lambda h: h["offset"]))))


@rule("presentation-forms", "A text holds letters in a fixed shape instead of letters")
def presentation_forms(o: RepairOptions) -> Column:
    forms, ligatures = t.count_of(F.col("high"), u.PRESENTATION_FORM), t.count_of(F.col("high"), u.WORD_LIGATURE)
    a = finding("presentation-forms", "error", F.concat(forms.cast("string"), F.lit(" character(s) with a fixed shape; search and joining fail on them")), logical=F.col("text"), offenders=t.offending_codepoints(F.col("high"), u.PRESENTATION_FORM), fixable=True, repair=fix("NormalizePresentationForms"))
    b = finding("presentation-forms", "warning", F.concat(ligatures.cast("string"), F.lit(" word ligature(s); no spelling is the same in all fonts")), logical=F.col("text"), offenders=t.offending_codepoints(F.col("high"), u.WORD_LIGATURE), hit=1)
    return F.concat(only(forms > 0, a), only(ligatures > 0, b))


@rule("tatweel-padding", "Words are stretched by typed tatweel")
def tatweel_padding(o: RepairOptions) -> Column:
    padding = F.filter("runs", lambda r: t.is_padding(r["verdict"]))
    total = F.aggregate(padding, F.lit(0), lambda a, r: a + r["length"])
    offenders = F.transform(padding, lambda r: F.concat(F.lit("U+0640 ARABIC TATWEEL ×"), r["length"].cast("string"), F.lit(" @"), r["offset"].cast("string")))
    return only(F.size(padding) > 0, finding("tatweel-padding", "warning", F.concat(total.cast("string"), F.lit(" tatweel stretch the text")), logical=F.col("text"), offenders=offenders, fixable=True, repair=fix("RemoveTatweel", offsets=t.padding_offsets(F.col("runs"))) if o.strip_tatweel else None))


@rule("bidi-override", "The order of a run is imposed", needs=("orders", "spans"))
def bidi_override(o: RepairOptions) -> Column:
    def each(s: Column, k: Column) -> Column:
        run = F.get("span_text", k)
        shown, resolved = t.imposed(run, s["direction"]), F.get("declared", k)
        moved = shown != resolved
        message = F.concat(F.lit("a run has its order imposed "), s["direction"], F.when(moved, ", which isn't the order it reads in").otherwise("; nothing moves today, but the algorithm is off"))
        return F.when((s["bidi"] == "imposed") & (F.coalesce(run, F.lit("")) != ""), _span_finding("bidi-override", s, k, F.when(moved, "error").otherwise("warning"), message, run, shown, resolved))

    return _spans(each)


@rule("isolation-missing", "A run of the other direction decides the order around it", needs=("orders", "spans"))
def isolation_missing(o: RepairOptions) -> Column:
    def each(s: Column, k: Column) -> Column:
        other = F.when(F.col("judged") == "rtl", "ltr").otherwise("rtl")
        apart, now = F.get("isolated", k), order(F.col("judged"))
        hit = (s["bidi"] == "plain") & t.carries_strong(F.get("span_text", k), other) & (apart != now)
        message = F.concat(F.lit("a run that reads "), other, F.lit(" isn't isolated from the "), F.col("judged"), F.lit(" text around it"))
        return F.when(hit, _span_finding("isolation-missing", s, k, "warning", message, F.col("text"), now, apart))

    return _spans(each)


@rule("direction-mismatch", "The direction isn't the one the text reads in", needs=("orders",))
def direction_mismatch(o: RepairOptions) -> Column:
    explicit = F.coalesce(stated("direction") != F.col("dominant"), F.lit(False))
    message = F.when(F.col("moved"), F.concat(F.lit("renders "), F.col("judged"), F.lit(" but reads "), F.col("dominant"), F.lit("; the visual order differs"))).otherwise(F.concat(F.lit("declared "), F.col("judged"), F.lit(" but reads "), F.col("dominant"), F.lit("; edges follow the declared direction")))
    found = finding("direction-mismatch", F.when(F.col("moved"), "error").otherwise("warning"), message, logical=F.col("text"), declared=order(F.col("judged")), expected=order(F.col("dominant")), fixable=True, repair=fix("SetDirection", F.col("dominant")))
    return only(F.col("has_arabic") & (F.col("moved") | explicit), found)


@rule("direction-unset", "No direction of its own, and none inherited that fits", needs=("orders",))
def direction_unset(o: RepairOptions) -> Column:
    off = (F.col("props.direction.state") != "explicit") & ~F.coalesce(effective("direction") == F.col("dominant"), F.lit(False)) & ~F.col("moved")
    message = F.when(effective("direction").isNotNull(), F.concat(F.lit("inherits "), effective("direction"), F.lit(" but reads "), F.col("dominant"))).otherwise("no direction; right today by auto-detection only")
    return only(F.col("has_arabic") & off, finding("direction-unset", "warning", message, source=inherited("direction"), fixable=True, repair=fix("SetDirection", F.col("dominant"))))


def _rtl() -> Column:
    return F.col("has_arabic") & (F.col("dominant") == "rtl")


@rule("alignment-incoherent", "Right-to-left text is aligned left")
def alignment_incoherent(o: RepairOptions) -> Column:
    return only(_rtl() & F.coalesce(stated("alignment") == "left", F.lit(False)), finding("alignment-incoherent", "warning", "right-to-left text is aligned left", fixable=True, repair=fix("SetAlignment", F.lit("start"))))


@rule("inset-physical", "Right-to-left text is inset on its left")
def inset_physical(o: RepairOptions) -> Column:
    return only(_rtl() & F.coalesce(effective("inset") == "left", F.lit(False)), finding("inset-physical", "warning", "the inset is on the left, the end of this text", logical=F.col("text"), source=inherited("inset")))


@rule("alignment-unset", "Right-to-left text has no alignment of its own")
def alignment_unset(o: RepairOptions) -> Column:
    off = (F.col("props.alignment.state") != "explicit") & F.coalesce(effective("alignment") == "left", F.lit(True))
    message = F.when(effective("alignment").isNotNull(), "inherits left, but reads right to left").otherwise("no alignment; it follows the direction only where the format does")
    return only(_rtl() & off, finding("alignment-unset", "note", message, logical=F.col("text"), source=inherited("alignment"), fixable=o.align, repair=fix("SetAlignment", F.lit("start")) if o.align else None))


@rule("container-direction", "A container's direction isn't the one its text reads in", containers=True)
def container_direction(o: RepairOptions) -> Column:
    explicit = F.col("props.direction.state") == "explicit"
    agree = F.coalesce(effective("direction") == F.col("dominant"), F.lit(False))
    message = F.when(explicit, F.concat(F.lit("declared "), effective("direction"), F.lit(" but its text reads "), F.col("dominant"))).otherwise(F.concat(F.lit("no direction of its own, and its text reads "), F.col("dominant")))
    hit = F.col("has_arabic") & ~agree & (explicit | (F.col("dominant") == "rtl"))
    return only(hit, finding("container-direction", "warning", message, logical=F.col("text"), source=inherited("direction"), fixable=True, repair=fix("SetDirection", F.col("dominant"))))


@rule("order-reversed", "Boxes are laid out against the reading order", containers=True)
def order_reversed(o: RepairOptions) -> Column:
    message = F.when(F.coalesce(effective("direction") == "rtl", F.lit(False)), "reversed and right-to-left: the two undo each other").otherwise("reversed instead of declared right-to-left")
    return only(_rtl() & F.col("props.reversed").isNotNull(), finding("order-reversed", "warning", message, logical=F.col("text"), source=origin_text(F.col("props.reversed"))))


@rule("language-missing", "Arabic text isn't tagged as Arabic")
def language_missing(o: RepairOptions) -> Column:
    tag = effective("language")
    return only(F.col("has_arabic") & ~t.is_arabic_tag(tag), finding("language-missing", "warning", F.concat(F.lit("Arabic text has the language "), F.coalesce(tag, F.lit("none"))), fixable=True, repair=fix("SetLanguage", F.lit(o.language))))


@rule("complex-font-missing", "A Latin font is named but none for Arabic")
def complex_font_missing(o: RepairOptions) -> Column:
    hit = F.col("has_arabic") & effective("latin_font").isNotNull() & effective("complex_font").isNull()
    return only(hit, finding("complex-font-missing", "warning", F.concat(F.lit("the Latin font is "), effective("latin_font"), F.lit(" and the complex-script font is left to chance")), fixable=o.complex_font is not None, repair=fix("SetComplexFont", F.lit(o.complex_font)) if o.complex_font else None))


@rule("literal-bullet", "A list marker is typed as text")
def literal_bullet(o: RepairOptions) -> Column:
    marker = t.leading_marker(F.col("text"))
    hit = (F.coalesce(F.col("props.bullet"), F.lit("none")) != "native") & marker.isNotNull()
    return only(hit, finding("literal-bullet", "warning", F.concat(F.lit("the text begins with the typed marker "), t.codepoint(marker)), fixable=True, repair=fix("ConvertLiteralBullet", marker) if o.convert_bullets else None))


@lru_cache(maxsize=512)
def _part(id_: str, options: RepairOptions, gateway: int) -> Column:
    """A rule's findings, guarded by its unit kind. Building an expression costs many calls into the JVM, so it is kept while that JVM lives."""
    r = REGISTRY[id_]
    kind = F.col("kind") != "paragraph" if r.containers else F.col("kind") == "paragraph"
    return F.when(kind & F.col("text").isNotNull(), r.check(options)).otherwise(F.array().cast(f"array<{DIAGNOSTIC}>"))


@lru_cache(maxsize=8)
def _runs(gateway: int) -> Column:
    return t.tatweel_runs(F.col("text"))


def _gateway() -> int:
    return id(SparkContext._gateway)


def diagnostics(units: DataFrame, options: RepairOptions | None = None, rules: Iterable[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """All findings of the chosen rules (default: all): the unit's keys beside each diagnostic.

    ``extra`` adds arrays of diagnostics that other steps made, such as the
    font rules. A null text has no findings.
    """
    options = options or RepairOptions()
    chosen = [REGISTRY[r] for r in (rules if rules is not None else REGISTRY)]
    needs = set().union(*(r.needs for r in chosen)) if chosen else set()
    if "spans" in needs:
        needs.add("orders")
    # a text without any of these has no finding of any rule, so it never reaches the features
    some = "".join(c[1:-1] for c in (u.ARABIC_LETTER, u.CONTROL, u.PRESENTATION_FORM, u.WORD_LIGATURE))
    trigger = t.high(F.col("text")).rlike(f"[{some}]") | F.col("text").rlike(u.LEADING_MARKER)
    with_features = features(units.where(trigger), needs)
    parts = [_part(r.id, options, _gateway()) for r in chosen]
    found = F.concat(*parts, *(extra or {}).values())
    return with_features.select("doc_id", "ord", "unit_id", "location", F.explode(found).alias("d")).select("doc_id", "ord", "unit_id", "location", "d.*")


def listing(spark) -> DataFrame:
    """The rules with their descriptions, in order."""
    from . import fonts  # noqa: F401 - it registers the two font rules

    return spark.createDataFrame([(k, r.id, r.description) for k, r in enumerate(REGISTRY.values())], "rule_ord int, rule string, description string")
