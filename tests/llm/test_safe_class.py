"""The prefilter of problem 3 lets no character through that the form changes."""

import re

from quirel.llm import unicode_form


def test_no_mapped_character_is_safe():
    safe = re.compile(f"[{unicode_form.SAFE_CLASS}]")
    assert [hex(r[0]) for r in unicode_form.mapping_rows() if safe.match(chr(r[0]))] == []


def test_digraphs_are_found(spark):
    df = spark.createDataFrame([(1, "de \u0133zeren brug"), (2, "de ijzeren brug")], "id int, t string")
    assert [r["id"] for r in unicode_form.form_cases(df, ["id"], "t").collect()] == [1]
    assert len({r["text_form"] for r in unicode_form.normalize_forms(df, ["id"], "t").collect()}) == 1
