"""The registered queries against their SQL, and the entry without the pipeline folders."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tests import oracle
from warraq.plans import oracles, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the synthetic tables aren't here")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, duck, name):
    assert oracle.same(queries.QUERIES[name](spark, oracle.DATA), duck, oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_runs(spark, name):
    d = queries.QUERIES[name](spark, oracle.DATA)
    assert d.columns and d.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_pipeline():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
