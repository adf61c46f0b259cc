"""Every query runs on empty tables and on tables of nulls, repeated rows and clashing columns."""

import os

import pytest
from edges import DATA, empty_dir, null_dir

from quirel.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LITERAL = {"cell_checks", "supported_formats", "url_parts", "text_quality", "ordinals", "font_kind", "ocr_response", "cell_labels", "scripts", "numerals", "page_numbers_dropped"}


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return empty_dir(tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    return null_dir(tmp_path_factory.mktemp("nulls"))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_empty(spark, empty, name):
    rows = catalogue.queries()[name](spark, empty).collect()
    assert rows == [] or name in LITERAL


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_nulls(spark, nulls, name):
    catalogue.queries()[name](spark, nulls).collect()
