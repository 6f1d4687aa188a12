"""A sample of registered queries against their SQL; ``tools_check.py`` runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, norm

SF = "/root/testdata/sf0.001"
NAMES = [
    "severity_summary", "classify_rows", "HANDLE_DUPLICATE_IN_FILE", "SKU_DUPLICATE_IN_FILE", "DUPLICATE_IDENTICAL_ROWS", "ROW_ORDER_WARNING", "catalog_compare",
    "fix_handles", "clean_document", "cross_doc_lines", "coverage", "top_stories", "related_stories", "story_usage", "digest_quality", "unsupported_numbers", "quote_verify",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    a = norm(entry.queries()[name](spark, SF).toPandas())
    b = norm(con.sql(entry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and a.values.tolist() == b.values.tolist()


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 250


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["file_id", "critical", "warning", "info", "status"] and df.count() > 0
