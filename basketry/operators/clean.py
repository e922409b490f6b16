"""Removal of duplicated and invalid rows, with exact counts of what was removed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import ratio

ZERO_QUANTITY = "zero_quantity"
NON_POSITIVE_SALES = "non_positive_sales"
NULL_VALUE = "null_value"


def removal_reason() -> Column:
    """Why a purchase line is dropped, in the order the reasons are applied; NULL if kept.

    Negative quantities are kept. A missing quantity or sales value can satisfy neither rule
    nor its opposite, so such lines are dropped under a reason of their own.
    """
    quantity, sales = F.col("quantity"), F.col("sales_value")
    return (
        F.when(quantity == 0, ZERO_QUANTITY)
        .when((quantity != 0) & (sales <= 0), NON_POSITIVE_SALES)
        .when(quantity.isNull() | sales.isNull(), NULL_VALUE)
    )


def distinct_rows(frame: DataFrame, copies: str = "copies") -> DataFrame:
    """Distinct rows with the number of copies (NULL equals NULL).

    Copies collapse on the map side, so a row repeated a billion times shuffles a few rows.
    """
    return frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias(copies))


def drop_duplicate_rows(frame: DataFrame) -> DataFrame:
    return frame.dropDuplicates()


def drop_invalid_transactions(transactions: DataFrame) -> DataFrame:
    return transactions.where(removal_reason().isNull())


def invalid_reason_counts(transactions: DataFrame) -> DataFrame:
    """Lines removed per reason, after duplicates are gone."""
    return (
        transactions.dropDuplicates()
        .select(removal_reason().alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows_removed"))
    )


def count_columns(is_transactions: bool) -> list[Column]:
    """Aggregates over ``distinct_rows`` (plus a ``reason`` column) of one table."""
    counts = [
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_raw"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
    ]
    for reason in (ZERO_QUANTITY, NON_POSITIVE_SALES, NULL_VALUE):
        removed = F.count_if(F.col("reason") == reason) if is_transactions else F.max(F.lit(None))
        counts.append(removed.cast("bigint").alias(f"{reason}_removed"))
    return [*counts, F.count_if(F.col("reason").isNull()).alias("rows_clean")]


def with_reason(distinct: DataFrame, table: str) -> DataFrame:
    no_reason = F.lit(None).cast("string")
    reason = removal_reason() if table == "transaction_data" else no_reason
    return distinct.withColumn("reason", reason)


def add_removed_shares(counts: DataFrame) -> DataFrame:
    """Share of invalid lines, once of the rows after deduplication and once of the raw rows."""
    removed = F.col("zero_quantity_removed") + F.col("non_positive_sales_removed")
    return counts.withColumns(
        {
            "removed_share_of_distinct": ratio(
                removed, F.col("rows_raw") - F.col("duplicates_removed")
            ),
            "removed_share_of_raw": ratio(removed, "rows_raw"),
        }
    )


def prepare_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of the preparation, one row per raw table and one pass over each."""
    rows = None
    for name, frame in tables.items():
        one = (
            with_reason(distinct_rows(frame), name)
            .agg(*count_columns(name == "transaction_data"))
            .select(F.lit(name).alias("table_name"), "*")
        )
        rows = one if rows is None else rows.unionByName(one)
    return add_removed_shares(rows)
