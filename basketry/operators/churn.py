"""Loyal households that are leaving, and how they differ from the ones that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.columns import money_sum, ratio
from basketry.operators import group_tests
from basketry.operators.business import in_window
from basketry.operators.ranks import group_medians, number, top_share_cutoff, with_cume_dist
from basketry.params import DEMOGRAPHIC_COLUMNS, ChurnParams, Window
from basketry.sources.storage import stage

# Names of the household groups.
CHURNING = "churning_loyal"
STABLE = "stable_loyal"
OTHER = "other"


def is_loyal_group() -> Column:
    return F.col("household_group").isin(CHURNING, STABLE)


def last_baseline_week(window: Window, params: ChurnParams) -> int:
    return window.end_week - params.recent_weeks


def household_activity(
    transactions: DataFrame, window: Window, params: ChurnParams
) -> DataFrame:
    """Revenue and baskets of every household, before and in the recent weeks.

    Baseline baskets are scaled to a block of ``recent_weeks`` weeks. Lines are first summed per
    basket with a flag for each period it touches, so the three distinct basket counts become
    plain counts. First-half revenue is NULL for a household without purchases in that half.
    """
    limit = last_baseline_week(window, params)
    sales = F.col("sales_value")
    baseline, recent = F.col("week_no") <= limit, F.col("week_no") > limit
    per_basket = (
        transactions.where(in_window(window))
        .groupBy("household_key", "basket_id")
        .agg(
            money_sum(sales).alias("revenue"),
            money_sum(F.when(F.col("week_no") <= window.mid_week, sales)).alias("first_half"),
            money_sum(F.when(baseline, sales)).alias("baseline"),
            money_sum(F.when(recent, sales)).alias("recent"),
            F.bool_or(baseline).alias("in_baseline"),
            F.bool_or(recent).alias("in_recent"),
        )
    )
    known = F.col("basket_id").isNotNull()
    blocks = limit - window.start_week + 1
    return per_basket.groupBy("household_key").agg(
        money_sum("first_half").alias("first_half_revenue"),
        money_sum("revenue").alias("revenue"),
        F.coalesce(money_sum("baseline"), F.lit(0.0)).alias("baseline_revenue"),
        F.coalesce(money_sum("recent"), F.lit(0.0)).alias("recent_revenue"),
        F.count("basket_id").alias("baskets"),
        ratio(
            F.count_if(known & F.col("in_baseline")) * params.recent_weeks, F.lit(blocks)
        ).alias("baseline_baskets"),
        F.count_if(known & F.col("in_recent")).alias("recent_baskets"),
    )


def loyalty_flags(activity: DataFrame, params: ChurnParams) -> DataFrame:
    """First-half buyers with ``is_loyal``: CUME_DIST of revenue within the top share."""
    buyers = activity.where(F.col("first_half_revenue").isNotNull()).select(
        "household_key", "first_half_revenue"
    )
    buyers = stage(buyers, "first-half-buyers")
    cutoff = top_share_cutoff(buyers, "first_half_revenue", params.loyal_top_share)
    loyal = F.coalesce(F.col("first_half_revenue") >= cutoff, F.lit(False))
    return buyers.withColumn("is_loyal", loyal)


def first_half_cume_dist(activity: DataFrame) -> DataFrame:
    """CUME_DIST of every first-half buyer, for looking at the tail around the cut-off."""
    buyers = activity.where(F.col("first_half_revenue").isNotNull()).select(
        "household_key", "first_half_revenue"
    )
    return with_cume_dist(buyers, "first_half_revenue", "household_key", "cume_dist")


def household_groups(
    transactions: DataFrame, window: Window, params: ChurnParams
) -> DataFrame:
    """One row per active household with its group.

    The activity is staged because the loyalty cut-off is a rank over all of it. The cut-off
    is one value, so no join brings the flag back.
    """
    activity = stage(household_activity(transactions, window, params), "household-activity")
    cutoff = top_share_cutoff(activity, "first_half_revenue", params.loyal_top_share)
    loyal = F.col("first_half_revenue") >= cutoff
    kept = 1 - params.activity_drop
    fewer = F.col("recent_baskets") < F.lit(kept) * F.col("baseline_baskets")
    return activity.select(
        "household_key",
        F.when(loyal & fewer, CHURNING)
        .when(loyal, STABLE)
        .otherwise(OTHER)
        .alias("household_group"),
        F.coalesce("first_half_revenue", F.lit(0.0)).alias("first_half_revenue"),
        "revenue",
        "baseline_revenue",
        "recent_revenue",
        "baskets",
        "baseline_baskets",
        "recent_baskets",
        ratio("revenue", "baskets").alias("avg_basket_value"),
    )


def churn_households(groups: DataFrame, demographics: DataFrame) -> DataFrame:
    """Household table: activity, group and the demographic attributes where known."""
    attributes = demographics.select("household_key", *DEMOGRAPHIC_COLUMNS)
    return groups.join(attributes, "household_key", "left")


def household_department(
    transactions: DataFrame, products: DataFrame, window: Window, params: ChurnParams
) -> DataFrame:
    """Baseline revenue per household and department.

    Summed per household and product before the join, so a product that everybody buys has one
    row per household. Spark broadcasts the products if their measured size allows it, and splits
    a partition of a sort-merge join that such a product makes too large.
    """
    baseline = Window(window.start_week, last_baseline_week(window, params))
    bought = (
        transactions.where(in_window(baseline))
        .groupBy("household_key", "product_id")
        .agg(money_sum("sales_value").alias("revenue"))
    )
    named = bought.join(products.select("product_id", "department"), "product_id")
    return named.groupBy("household_key", "department").agg(
        money_sum("revenue").alias("department_revenue")
    )


def churn_rows(households: DataFrame, departments: DataFrame) -> DataFrame:
    """Household table repeated for each department bought in the baseline weeks."""
    return households.join(departments, "household_key", "left")


def group_summary(households: DataFrame) -> DataFrame:
    """Size, revenue, activity and shares of the three household groups."""
    groups = households.groupBy("household_group").agg(
        F.count("household_key").alias("households"),
        *(
            money_sum(name).alias(name)
            for name in ("revenue", "baseline_revenue", "recent_revenue")
        ),
        F.sum("baskets").alias("baskets"),
        F.avg("baseline_baskets").alias("baseline_baskets"),
        F.avg("recent_baskets").alias("recent_baskets"),
    )
    # Three rows.
    total = W.partitionBy()

    def share(name: str) -> Column:
        return ratio(F.col(name), F.sum(name).over(total))

    return groups.select(
        "household_group",
        "households",
        "revenue",
        "baseline_revenue",
        "recent_revenue",
        "baseline_baskets",
        "recent_baskets",
        share("households").alias("household_share"),
        share("revenue").alias("revenue_share"),
        share("baseline_revenue").alias("baseline_revenue_share"),
        share("recent_revenue").alias("recent_revenue_share"),
        ratio("revenue", "baskets").alias("avg_basket_value"),
    )


def basket_value_test(households: DataFrame) -> DataFrame:
    """Median basket value of both loyal groups and their rank-sum test, one row.

    Both come from one numbering of the loyal households by basket value.
    """
    loyal = households.where(is_loyal_group() & F.col("avg_basket_value").isNotNull()).select(
        F.lit("avg_basket_value").alias("test"),
        "household_key",
        "household_group",
        "avg_basket_value",
    )
    order = [F.asc("test"), F.asc("avg_basket_value"), F.asc("household_key")]
    numbered = number(loyal, order)
    medians = group_medians(numbered, "household_group", "avg_basket_value").agg(
        *(
            F.max(F.when(F.col("household_group") == group, F.col("median"))).alias(name)
            for group, name in ((CHURNING, "churning_median"), (STABLE, "stable_median"))
        )
    )
    sums = group_tests.rank_sums_of(
        numbered, "test", "avg_basket_value", F.col("household_group") == CHURNING
    )
    tested = sums.withColumn("medians", medians.select(F.struct("*")).scalar()).select(
        "test", "medians.*", "n1", "n2", "u", "tie_term", "z"
    )
    return group_tests.add_rank_sum_p_values(tested)


def department_shares(
    households: DataFrame, departments: DataFrame, top_n: int
) -> DataFrame:
    """Share of each top department in every loyal household's baseline revenue.

    The denominator holds all departments. Households without baseline revenue drop out; a top
    department a household never bought from counts as 0. One aggregate per household carries a
    conditional sum for each of the ``top_n`` departments, then unfolds.
    """
    loyal = households.where(is_loyal_group()).select("household_key", "household_group")
    bought = departments.where(F.col("department").isNotNull()).join(loyal, "household_key")
    top = (
        bought.groupBy("department")
        .agg(money_sum("department_revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), F.asc("department"))
        .limit(top_n)
    )
    # At most top_n names reach the driver: a parameter, not the data, bounds them.
    names = [row["department"] for row in top.collect()]
    if not names:
        return bought.select(
            "household_key", "household_group", "department", F.lit(0.0).alias("share")
        ).limit(0)
    revenue = F.col("department_revenue")
    per_household = bought.groupBy("household_key", "household_group").agg(
        money_sum(revenue).alias("_all"),
        *(
            F.coalesce(money_sum(F.when(F.col("department") == name, revenue)), F.lit(0.0)).alias(
                f"_d{number}"
            )
            for number, name in enumerate(names)
        ),
    )
    cells = F.array(
        *(
            F.struct(
                F.lit(name).alias("department"), ratio(f"_d{number}", "_all").alias("share")
            )
            for number, name in enumerate(names)
        )
    )
    return per_household.select("household_key", "household_group", F.inline(cells))


def department_mix(households: DataFrame, departments: DataFrame, top_n: int) -> DataFrame:
    """Mean department shares of both loyal groups and the rank-sum statistics."""
    shares = stage(department_shares(households, departments, top_n), "department-shares")
    churning = F.col("household_group") == CHURNING
    means = shares.groupBy("department").agg(
        F.avg(F.when(churning, F.col("share"))).alias("churning_share"),
        F.avg(F.when(~churning, F.col("share"))).alias("stable_share"),
    )
    sums = group_tests.rank_sums(shares, "department", "share", "household_key", churning)
    return means.join(sums, "department").select(
        "department",
        "churning_share",
        "stable_share",
        (100 * (F.col("churning_share") - F.col("stable_share"))).alias("difference_pp"),
        "n1",
        "n2",
        "u",
        "tie_term",
        "z",
    )


def department_mix_tests(mix: DataFrame, top_n: int, alpha: float) -> DataFrame:
    """``department_mix`` with p-values and the Bonferroni flag ``p < alpha / top_n``."""
    return group_tests.add_rank_sum_p_values(mix).withColumn(
        "significant", F.coalesce(F.col("p_value") < alpha / top_n, F.lit(False))
    )


def department_mix_headline(tests: DataFrame) -> DataFrame:
    """The significant department with the largest difference; NULLs if there is none."""
    size = F.abs("difference_pp")
    significant = F.col("significant")
    return tests.agg(
        F.count_if(significant).alias("significant_departments"),
        F.max_by("department", F.when(significant, size)).alias("department"),
        F.max_by("difference_pp", F.when(significant, size)).alias("difference_pp"),
    )


def demographic_households(households: DataFrame) -> DataFrame:
    """Loyal households with demographic data."""
    return households.where(is_loyal_group() & F.col(DEMOGRAPHIC_COLUMNS[0]).isNotNull())


def demographic_crosstab(households: DataFrame) -> DataFrame:
    return group_tests.crosstab(
        demographic_households(households), DEMOGRAPHIC_COLUMNS, "household_group"
    )


def demographic_statistics(households: DataFrame, min_expected_count: float) -> DataFrame:
    """Chi-square statistic per attribute and whether its approximation is reliable."""
    tests = group_tests.chi_square(
        demographic_crosstab(households), "household_group", CHURNING, STABLE
    )
    return tests.withColumnsRenamed(
        {"n1": "churning_with_demographics", "n2": "stable_with_demographics"}
    ).withColumn("reliable", F.col("min_expected_count") >= min_expected_count)


def demographic_tests(statistics: DataFrame, alpha: float) -> DataFrame:
    """``demographic_statistics`` with p-values and the Bonferroni flag over all attributes."""
    level = alpha / len(DEMOGRAPHIC_COLUMNS)
    return group_tests.add_chi_square_p_values(statistics).withColumn(
        "significant", F.coalesce(F.col("reliable") & (F.col("p_value") < level), F.lit(False))
    )


def churn_headline(summary: DataFrame) -> DataFrame:
    """Churning and loyal households, revenue shares and the drop in baskets."""
    churning = F.col("household_group") == CHURNING

    def of_churning(name: str) -> Column:
        return F.max(F.when(churning, F.col(name)))

    return summary.agg(
        of_churning("households").alias("churning_households"),
        F.sum(F.when(is_loyal_group(), F.col("households"))).alias("loyal_households"),
        of_churning("baseline_revenue_share").alias("churning_baseline_revenue_share"),
        of_churning("recent_revenue_share").alias("churning_recent_revenue_share"),
        of_churning("revenue_share").alias("churning_window_revenue_share"),
        (1 - ratio(of_churning("recent_baskets"), of_churning("baseline_baskets"))).alias(
            "churning_basket_drop"
        ),
    )
