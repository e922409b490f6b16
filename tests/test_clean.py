from __future__ import annotations

import pytest

from basketry.functions.columns import money_sum, snake_case, trim_strings
from basketry.operators import clean

SCHEMA = "household_key INT, basket_id INT, quantity INT, sales_value DOUBLE"
ROWS = [
    (1, 1, 1, 5.0),
    (1, 1, 1, 5.0),
    (None, 2, 1, 5.0),
    (None, 2, 1, 5.0),
    (1, 3, 0, 0.0),
    (1, 4, 2, 0.0),
    (1, 5, 2, -1.0),
    (1, 6, -2, 3.0),
    (1, 7, None, 3.0),
    (1, 8, 0, None),
    (1, 9, 3, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_duplicates_with_nulls(raw):
    assert clean.drop_duplicate_rows(raw).count() == 9
    copies = {row["basket_id"]: row["copies"] for row in clean.distinct_rows(raw).collect()}
    assert (copies[1], copies[2], copies[3]) == (2, 2, 1)


def test_reasons_in_order(raw):
    got = {row["reason"]: row["rows_removed"] for row in clean.invalid_reason_counts(raw).collect()}
    assert got == {"zero_quantity": 2, "non_positive_sales": 2, "null_value": 2}


def test_negative_quantities_stay(raw):
    kept = clean.drop_invalid_transactions(clean.drop_duplicate_rows(raw))
    assert sorted(row["basket_id"] for row in kept.collect()) == [1, 2, 6]


def test_stats(raw, spark):
    products = spark.createDataFrame([(1,), (1,), (2,)], "product_id INT")
    stats = clean.prepare_stats({"transaction_data": raw, "product": products}).collect()
    lines, product = sorted(stats, key=lambda row: row["table_name"], reverse=True)
    assert (lines["rows_raw"], lines["duplicates_removed"], lines["rows_clean"]) == (11, 2, 3)
    assert lines["removed_share_of_distinct"] == pytest.approx(4 / 9)
    assert lines["removed_share_of_raw"] == pytest.approx(4 / 11)
    assert (product["rows_raw"], product["duplicates_removed"]) == (3, 1)
    assert product["zero_quantity_removed"] is None


def test_strings(spark):
    frame = spark.createDataFrame([(1, "  "), (2, " A B "), (3, "")], "id INT, name STRING")
    assert [tuple(row) for row in trim_strings(frame).collect()] == [
        (1, None),
        (2, "A B"),
        (3, None),
    ]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("BASKET_ID", "basket_id"),
        ("householdKey", "household_key"),
        ("classification_1", "classification_1"),
        (" CURR_SIZE_OF_PRODUCT ", "curr_size_of_product"),
        ("Sales Value", "sales_value"),
        ("day", "day"),
    ],
)
def test_snake_case(name, expected):
    assert snake_case(name) == expected


def test_money_does_not_depend_on_order(spark):
    frame = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "v DOUBLE")
    assert frame.agg(money_sum("v")).first()[0] == 0.6
