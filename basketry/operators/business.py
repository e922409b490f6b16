"""Weekly KPIs, category shares, window totals and the revenue trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.columns import money_sum, money_units, ratio, units_money
from basketry.operators import distinct
from basketry.params import Window
from basketry.sources.storage import stage


def in_window(window: Window) -> Column:
    return F.col("week_no").between(window.start_week, window.end_week)


def baskets(transactions: DataFrame) -> DataFrame:
    """Purchases summed per household, basket and week, with the last day.

    Operators that need no product take this table in place of the lines.
    """
    return transactions.groupBy("household_key", "basket_id", "week_no").agg(
        F.max("day").alias("day"), money_sum("sales_value").alias("sales_value")
    )


#: Ids that are counted per week, and the names of their counts.
ACTIVE = {"basket_id": "baskets", "household_key": "active_households"}


def weekly_sets(transactions: DataFrame, window: Window) -> DataFrame:
    """Baskets and households of every week as sets, with the week's money, from one scan.

    ``weekly_kpi`` and ``business_totals`` both follow from it; who calls both should stage it.
    """
    return distinct.id_sets(
        transactions.where(in_window(window)),
        list(ACTIVE),
        ["week_no"],
        {"units": money_units("sales_value")},
    )


def weekly_kpi(
    transactions: DataFrame, window: Window, sets: DataFrame | None = None
) -> DataFrame:
    """Revenue, baskets, active households, average basket and change to the week before.

    The change is against the previous week that has purchases. ``sets`` is a ready
    ``weekly_sets``.
    """
    sets = weekly_sets(transactions, window) if sets is None else sets
    weekly = distinct.counts(sets, ACTIVE, ["week_no"], units_money(F.sum("units")).alias("revenue"))
    # One row per week: the window function sorts a calendar, not the purchases.
    before = F.lag("revenue").over(W.orderBy("week_no"))
    return weekly.select(
        "week_no",
        "revenue",
        *ACTIVE.values(),
        ratio("revenue", "baskets").alias("avg_basket_value"),
        (ratio("revenue", before) - 1).alias("revenue_wow_change"),
    )


def category_revenue(transactions: DataFrame, products: DataFrame, window: Window) -> DataFrame:
    """Revenue per department and per commodity, both from one pass.

    Lines are summed per product before the join, so a best-seller is one row in it.
    """
    sold = (
        transactions.where(in_window(window))
        .groupBy("product_id")
        .agg(money_sum("sales_value").alias("revenue"))
    )
    named = sold.join(products.select("product_id", "department", "commodity_desc"), "product_id")
    levels = named.groupingSets(
        [["department"], ["commodity_desc"]], "department", "commodity_desc"
    ).agg(money_sum("revenue").alias("revenue"), F.grouping_id().alias("level"))
    is_department = F.col("level") == 1
    return levels.select(
        F.when(is_department, "department").otherwise("commodity").alias("category_level"),
        F.when(is_department, F.col("department"))
        .otherwise(F.col("commodity_desc"))
        .alias("category"),
        "revenue",
    )


def category_share(
    transactions: DataFrame, products: DataFrame, window: Window, top_n: int
) -> DataFrame:
    """Top ``top_n`` categories per level; shares are of all categories of the level."""
    revenue = category_revenue(transactions, products, window)
    # Both levels hold the same lines, so one total serves as denominator of both.
    total = revenue.where(F.col("category_level") == "department").agg(money_sum("revenue")).scalar()
    order = W.partitionBy("category_level").orderBy(
        F.desc("revenue"), F.asc_nulls_last("category")
    )
    return (
        revenue.withColumn("revenue_rank", F.row_number().over(order))
        .where(F.col("revenue_rank") <= top_n)
        .select(
            "category_level",
            "category",
            "revenue",
            ratio("revenue", total).alias("revenue_share"),
            "revenue_rank",
        )
    )


def top3_department_share(shares: DataFrame) -> DataFrame:
    """Revenue share of the three largest departments, from ``category_share``."""
    first = (F.col("category_level") == "department") & (F.col("revenue_rank") <= 3)
    return shares.where(first).agg(F.sum("revenue_share").alias("top3_department_share"))


def business_totals(
    transactions: DataFrame,
    window: Window,
    weekly: DataFrame | None = None,
    sets: DataFrame | None = None,
) -> DataFrame:
    """Totals of the window and averages per week, one row.

    The sets of all weeks are merged into those of the window, so the lines are read once for
    both. ``weekly`` is a ready ``weekly_kpi`` and ``sets`` a ready ``weekly_sets``.
    """
    if sets is None:
        sets = stage(weekly_sets(transactions, window), "weekly-sets")
    revenue = sets.agg(units_money(F.sum("units"))).scalar()
    named = {"basket_id": "total_baskets", "household_key": "active_households"}
    totals = distinct.counts(distinct.merged(sets), named).withColumn("total_revenue", revenue)
    weekly = weekly_kpi(transactions, window, sets) if weekly is None else weekly
    averages = weekly.agg(
        F.struct(
            F.avg("revenue").alias("revenue"),
            F.avg("baskets").alias("baskets"),
            F.avg("active_households").alias("households"),
        )
    )
    return totals.withColumn("weekly", averages.scalar()).select(
        "total_revenue",
        "total_baskets",
        "active_households",
        F.col("weekly.revenue").alias("avg_weekly_revenue"),
        F.col("weekly.baskets").alias("avg_weekly_baskets"),
        F.col("weekly.households").alias("avg_weekly_active_households"),
        ratio("total_revenue", "total_baskets").alias("avg_basket_value"),
    )


def trend_change(weekly: DataFrame, weeks: int) -> DataFrame:
    """Mean of the last ``weeks`` weeks over the mean of the first ones, minus one.

    The two ends overlap if there are fewer than ``2 * weeks`` weeks. The basket-value change
    follows from the revenue and basket changes.
    """
    # Again one row per week.
    numbered = weekly.select(
        "revenue",
        "baskets",
        "active_households",
        (F.row_number().over(W.orderBy("week_no")) <= weeks).alias("first"),
        (F.row_number().over(W.orderBy(F.desc("week_no"))) <= weeks).alias("last"),
    )

    def change(name: str) -> Column:
        last = F.avg(F.when(F.col("last"), F.col(name)))
        return ratio(last, F.avg(F.when(F.col("first"), F.col(name)))) - 1

    return numbered.agg(
        change("revenue").alias("revenue_change"),
        change("baskets").alias("baskets_change"),
        change("active_households").alias("active_households_change"),
    ).withColumn(
        "basket_value_change",
        ratio(F.col("revenue_change") + 1, F.col("baskets_change") + 1) - 1,
    )
