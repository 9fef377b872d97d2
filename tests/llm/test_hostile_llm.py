"""The training-data problems on empty tables, rows of nulls, repeated rows and extra columns with clashing names."""

import functools
import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUERIES = entry.queries()
NAMES = sorted(n for n in QUERIES if re.match(r"p(3|8|9|10)_", n))
REPEATABLE = ["p3_found", "p10_found"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, variants, name):
    assert QUERIES[name](spark, f"{variants}/empty").count() == 0 or not name.endswith(("_found", "_packed", "_choice"))


@pytest.fixture(scope="module")
def plain(spark, rows):
    """Rows of a query on the plain tables, computed once."""
    return functools.cache(lambda name: rows(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_nulls_and_extra_columns(spark, variants, rows, plain, name):
    got = QUERIES[name](spark, f"{variants}/odd")
    if name.endswith("_found"):
        assert rows(got) == plain(name)
    else:
        assert got.count() > 0


@pytest.mark.parametrize("name", REPEATABLE)
def test_repeated_rows_change_nothing(spark, variants, rows, plain, name):
    assert rows(QUERIES[name](spark, f"{variants}/twice")) == plain(name)
