"""Registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registry
from check import TABLES, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
# The other queries are compared by check.py; these cover every kind of operator.
NAMES = [
    "sector_counts", "dedup_listings", "load_snapshots", "add_snapshots", "clean_listings", "rows_removed_per_rule",
    "missing_report_share", "column_profile", "trim_by_colonia", "trim_global", "corr_matrix",
    "encode_colonia", "feature_vector", "exact_split", "ridge_search", "baseline_report",
    "segment_vs_general", "dbscan_geo",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, db.sql(registry.oracle_sql()[name]).df()) is None


def test_entry_and_names(spark):
    assert registry.entry(spark).columns == ["tipo_oferta", "sector_inmo", "n"]
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "predio.llm", "corpus_pipeline"])
def test_registry_without_an_optional_package(missing):
    """A package that cannot be imported costs only the queries that need it."""
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as r\n"
        "assert 'clean_listings' in r.queries() and set(r.oracle_sql()) <= set(r.queries())\n"
        "assert 'pipeline' not in r.queries()\n"
        "assert not any(name.startswith('op') for name in r.queries()) or r.llm"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
