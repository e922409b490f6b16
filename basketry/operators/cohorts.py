"""Retention of households by the period of their first purchase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.columns import ratio


def last_full_period(end_week: int, period_weeks: int) -> int:
    """Index of the last period that ends by ``end_week``; period 0 starts in week 1."""
    return end_week // period_weeks - 1


#: Periods in one word of a household's mask.
MASK_BITS = 64


def cohort_activity(transactions: DataFrame, end_week: int, period_weeks: int) -> DataFrame:
    """Active households per cohort and number of periods since the first purchase.

    A household is one row: its active periods are bits of as many words as the calendar needs,
    merged on the map side. The cohort is the lowest bit. Only complete periods are kept. Weeks
    start with 1; an earlier one raises.
    """
    last = last_full_period(end_week, period_weeks)
    period = F.expr(f"(week_no - 1) div {int(period_weeks)}").cast("int")
    checked = F.when(
        F.col("week_no") < 1, F.raise_error(F.lit("week_no starts with 1")).cast("int")
    ).otherwise(period)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("period") % MASK_BITS)
    words = range(max(0, last) // MASK_BITS + 1)
    masks = (
        transactions.where((F.col("week_no") <= end_week) & F.col("household_key").isNotNull())
        .select("household_key", checked.alias("period"))
        .where(F.col("period") <= last)
        .groupBy("household_key")
        .agg(
            *(
                F.bit_or(F.when(F.expr(f"period div {MASK_BITS}") == word, bit)).alias(f"_{word}")
                for word in words
            )
        )
    )
    def set_bits(word: int) -> Column:
        first = word * MASK_BITS
        numbers = F.sequence(F.lit(first), F.lit(first + MASK_BITS - 1))
        mask = F.coalesce(f"_{word}", F.lit(0).cast("bigint"))
        return F.filter(numbers, lambda p: F.getbit(mask, p % MASK_BITS) == 1)

    periods = F.flatten(F.array(*(set_bits(word) for word in words)))
    active = masks.select(periods.alias("active")).select(
        F.get("active", F.lit(0)).alias("cohort_period"), F.explode("active").alias("period")
    )
    return active.groupBy(
        "cohort_period", (F.col("period") - F.col("cohort_period")).alias("periods_since_first")
    ).agg(F.count(F.lit(1)).alias("active_households"))


def cohort_sizes(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("periods_since_first") == 0).select(
        "cohort_period", F.col("active_households").alias("households")
    )


def retention_matrix(
    activity: DataFrame, min_cohort_size: int, last_period: int, period_weeks: int
) -> DataFrame:
    """Long retention matrix: cohort, offset, share of the cohort active in that period.

    0 is an observed period without purchases, NULL a period after the last complete one.
    Cohorts and offsets are periods of the calendar, so a cohort's cells fit in one map.
    """
    cells = activity.groupBy("cohort_period").agg(
        F.map_from_entries(
            F.collect_list(F.struct("periods_since_first", "active_households"))
        ).alias("active")
    )
    size = F.element_at("active", F.lit(0))
    kept = cells.select("cohort_period", "active", size.alias("households")).where(
        F.col("households") >= min_cohort_size
    )
    longest = F.lit(last_period) - F.min("cohort_period").over(W.partitionBy())
    offset = F.explode(F.sequence(F.lit(0), F.greatest("longest", F.lit(0))))
    first_week = F.col("cohort_period") * period_weeks + 1
    observed = F.col("cohort_period") + F.col("periods_since_first") <= last_period
    active = F.coalesce(F.element_at("active", F.col("periods_since_first")), F.lit(0))
    return (
        kept.withColumn("longest", longest)
        .withColumn("periods_since_first", offset)
        .withColumn("active_households", F.when(observed, active))
        .select(
            "cohort_period",
            # Fixed value: the label format.
            F.format_string("нед. %d-%d", first_week, first_week + (period_weeks - 1)).alias(
                "cohort_label"
            ),
            "periods_since_first",
            "households",
            "active_households",
            ratio("active_households", "households").alias("retention"),
        )
    )


def average_retention(matrix: DataFrame) -> DataFrame:
    """Retention by offset, weighted by cohort size over the observed cells."""
    observed = F.col("active_households").isNotNull()
    return matrix.groupBy("periods_since_first").agg(
        ratio(
            F.sum("active_households"), F.sum(F.when(observed, F.col("households")))
        ).alias("avg_retention")
    )


def retention_plateau(average: DataFrame) -> DataFrame:
    """Smallest and largest average retention after the first period."""
    return average.where(F.col("periods_since_first") >= 1).agg(
        F.min("avg_retention").alias("retention_plateau_min"),
        F.max("avg_retention").alias("retention_plateau_max"),
    )


def cohort_headline(
    activity: DataFrame, matrix: DataFrame, min_cohort_size: int, report_periods: Sequence[int]
) -> DataFrame:
    """Cohorts and households kept and dropped, and retention at the reported periods."""
    big = F.col("households") >= min_cohort_size
    sizes = cohort_sizes(activity).agg(
        F.count_if(big).alias("cohorts_kept"),
        F.coalesce(F.sum(F.when(big, F.col("households"))), F.lit(0)).alias(
            "households_in_kept_cohorts"
        ),
        F.coalesce(F.sum(F.when(~big, F.col("households"))), F.lit(0)).alias(
            "households_in_dropped_cohorts"
        ),
    )
    at = average_retention(matrix).agg(
        F.struct(
            *(
                F.max(
                    F.when(F.col("periods_since_first") == period, F.col("avg_retention"))
                ).alias(f"retention_period_{period}")
                for period in report_periods
            )
        )
    )
    return sizes.withColumn("at", at.scalar()).select("*", "at.*").drop("at")
