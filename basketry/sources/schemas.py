"""Schemas of the raw CSV tables; every field is nullable."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _schema(columns: str) -> StructType:
    """``name type`` pairs; ``StructType.fromDDL`` would need a running session."""
    schema = StructType()
    for column in columns.split(","):
        schema.add(*column.split())
    return schema


# Column names, order and types of the raw files.
RAW_SCHEMAS: dict[str, StructType] = {
    "transaction_data": _schema(
        "household_key integer, BASKET_ID long, DAY integer, PRODUCT_ID integer, "
        "QUANTITY integer, SALES_VALUE double, STORE_ID integer, RETAIL_DISC double, "
        "TRANS_TIME integer, WEEK_NO integer, "
        "COUPON_DISC double, COUPON_MATCH_DISC double"
    ),
    "product": _schema(
        "PRODUCT_ID integer, MANUFACTURER integer, DEPARTMENT string, BRAND string, "
        "COMMODITY_DESC string, SUB_COMMODITY_DESC string, CURR_SIZE_OF_PRODUCT string"
    ),
    "hh_demographic": _schema(
        "classification_1 string, classification_2 string, classification_3 string, "
        "HOMEOWNER_DESC string, classification_5 string, classification_4 string, "
        "KID_CATEGORY_DESC string, household_key integer"
    ),
    "causal_data": _schema(
        "PRODUCT_ID integer, STORE_ID integer, WEEK_NO integer, display string, mailer string"
    ),
}

# Tables of the processed folder; the last one is derived.
PROCESSED_TABLES = (
    "transaction_data",
    "product",
    "hh_demographic",
    "causal_data",
    "promo_product_week",
)

# The two fact tables are laid out by week, so that a week range prunes folders.
PARTITION_COLUMN = {
    "transaction_data": "week_no",
    "causal_data": "week_no",
    "promo_product_week": None,
    "product": None,
    "hh_demographic": None,
}
