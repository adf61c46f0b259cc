"""The eight problems' queries on empty tables and on tables of nulls, repeated rows and clashing columns."""

import os

import pytest
from edges import DATA, empty_dir, null_dir

from quirel.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return empty_dir(tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    return null_dir(tmp_path_factory.mktemp("nulls"))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nulls(spark, nulls, name):
    rows = queries.queries()[name](spark, nulls).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
