import pytest

import __spark_entry__ as entry
from oracle import same
from tokensift.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_against_sql(spark, name):
    same(core.QUERIES[name](spark, FOLDER), core.ORACLE[name], FOLDER)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
