"""What long texts and large tables ask for: bounded batches, whole results by fewer rows, algorithms as the plain ones."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import plain_bidi
from warraq.functions import arrow, bidi
from warraq.functions import text as t
from warraq.functions import unicode as u
from warraq.operators import rules, windows
from warraq.plans import queries
from warraq.plans.units import PHRASES, units_from_text

ODD = "abC AבجدبـــَٰݐﻻﷺāE1 2٣٤+-,.:/$%٪é́  ()[]{}〈〉⟨’…\t\r\n&‌‍­‎‪‫‬‭‮⁦⁧⁨⁩؀ؐ؜ٮ𞸀😀"


def texts(n: int, seed: int = 5) -> list[str]:
    r = random.Random(seed)
    return [*PHRASES, "", "ـ", "بـــ", "ب ـــ ب", "ؐ", "؀ب", "𞸀ب", "x" * 300 + "بـب" + "y" * 300, *("".join(r.choice(ODD) for _ in range(r.choice((1, 4, 9, 30)))) for _ in range(n))]


def test_levels_and_orders_are_those_of_the_plain_algorithm():
    for x in texts(3000):
        assert bidi.auto_direction(x) == plain_bidi.auto_direction(x) and bidi.first_paragraph(x) == plain_bidi.first_paragraph(x)
        for base in ("rtl", "ltr"):
            assert bidi.levels(x, base) == plain_bidi.levels(x, base)
            assert bidi.visual(x, base) == plain_bidi.visual(x, base)


def test_an_embedding_begins_at_the_level_around_it():
    # the number before the embedding resolves to level 2, but what counts is the level it is embedded at
    assert bidi.levels("٣‫!‬", "ltr") == [2, 2, 1, 0]


def test_no_text_is_kept():
    assert not hasattr(bidi.visual, "cache_info")


def test_many_brackets_and_isolates_take_linear_time():
    for part in ("(ب)", "⁦ب⁩ ", "‫a‬", "% ", "  "):
        x = part * 20_000
        assert len(bidi.visual(x, "rtl")) == len(x)


def test_rows_leave_in_bounded_batches():
    kind = pa.schema([("content", pa.binary())])
    made = []

    def files():
        for k in range(100):
            made.append(k)
            yield {"content": bytes(1 << 20)}

    sizes = [(b.num_rows, len(made)) for b in arrow.batched(files(), kind)]
    assert [n for n, _ in sizes] == [4] * 25 and sizes[0][1] == 4
    assert [b.num_rows for b in arrow.batched(({"content": b""} for _ in range(600)), kind)] == [256, 256, 88]


@pytest.mark.parametrize("name", ["s08_xlsx_units", "x01_audit"])
def test_queries_ask_for_small_arrow_batches(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10_000)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) <= 2000


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts(400, 9))), "unit_id int, text string")


def test_only_characters_that_join_are_dealt_out(rows):
    few, all_ = windows.joined_characters(rows), windows.characters(rows)
    for f in (windows.tatweel_runs, windows.joining_forms, windows.arabic_runs):
        assert sorted(map(tuple, f(few).collect())) == sorted(map(tuple, f(all_).collect()))
    long = "a" * 5000
    one = rows.limit(1).select("unit_id", F.lit(f"{long} بـب {long}").alias("text"))
    assert windows.joined_characters(one).count() == 5


def test_runs_of_tatweel_as_in_windows(rows):
    found = rows.select("unit_id", F.explode(t.tatweel_runs(F.col("text"))).alias("r")).select("unit_id", "r.*")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, windows.tatweel_runs(windows.characters(rows)).collect()))


def test_counts_and_escapes(rows):
    for pattern in (u.ARABIC_LETTER, "[A-Za-z]", u.CONTROL, u.PRESENTATION_FORM, u.WORD_LIGATURE):
        got = rows.select(t.count_of(F.col("text"), pattern).alias("a"), F.regexp_count("text", F.lit(pattern)).alias("b"), t.count_of(F.lit(None).cast("string"), pattern).alias("c")).collect()
        assert all(r.a == r.b and r.c is None for r in got)
    for r in rows.select("text", t.escape(F.col("text")).alias("e")).collect():
        assert r.e == "".join(c if " " <= c <= "~" else f"\\u{{{ord(c):04X}}}" for c in r.text)


def test_letters_are_not_counted_by_a_list_of_matches(rows):
    """A list of all letters, made in code that is too long to be compiled, took most of the time of every rule."""
    d = rules.diagnostics(units_from_text(rows, "unit_id", "text"), rules=["container-direction"])
    assert "regexp_extract_all" not in d._jdf.queryExecution().optimizedPlan().toString()
