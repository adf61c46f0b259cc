"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import convert_queries, flow_queries, label_queries, layout_queries, line_queries, pdf_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [text_queries, layout_queries, label_queries, line_queries, convert_queries, pdf_queries, flow_queries]


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
