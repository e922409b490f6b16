"""The registered queries next to their checking SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from checks import catalog, compare, oracles

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")

# Every module once; `python -m checks.compare <folder>` runs all of them.
SOME = (
    "clean_strings",
    "invalid_reason_counts",
    "prepare_stats",
    "dq_report",
    "analysis_window",
    "dataset_totals",
    "weekly_kpi",
    "category_share",
    "business_totals",
    "trend_change",
    "rfm_segments",
    "top_customers_share",
    "cohort_activity",
    "loyalty_flags",
    "churn_groups",
    "household_department",
    "demographic_crosstab",
    "promo_product_week",
    "promo_flags",
    "products_left_out",
)


@pytest.fixture(scope="module")
def database():
    return compare.database(FOLDER)


@pytest.fixture(scope="module")
def statements():
    return oracles.build()


def test_every_query_has_a_statement(statements):
    assert set(statements) == set(catalog.QUERIES)
    text = set(entry_module.text_queries()[0])  # tests/llm names those of them without SQL
    assert set(entry_module.queries()) - text == set(entry_module.oracle_sql()) - text
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, database, statements, name):
    # The window of the smallest tables ends early, as it should.
    outcome, _, _ = compare.compare(
        spark, database, FOLDER, catalog.QUERIES[name], statements[name]
    )
    assert outcome == "ok"


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
