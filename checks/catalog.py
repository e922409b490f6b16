"""Every operator as a query over the driver's tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.columns import round_doubles, snake_case, trim_strings
from basketry.operators import (
    business,
    churn,
    clean,
    cohorts,
    group_tests,
    inference,
    promo,
    quality,
    rfm,
)
from basketry.params import ChurnParams, JobParams, PromoParams, QualityParams, Window
from basketry.plans import analyze, quality_gate, report
from basketry.plans.prepare import write_clean
from basketry.sources import driver_tables as source
from basketry.sources.schemas import RAW_SCHEMAS
from basketry.sources.storage import new_folder, stage
from basketry.sources.tables import read_raw, register_views, run_sql_file, write_table

Query = Callable[[SparkSession, str], DataFrame]

# The test panel is longer and sparser than a supermarket's, hence its own parameters.
WINDOW = Window(1, source.LAST_FULL_WEEK)
PARAMS = JobParams(
    quality=QualityParams(max_week=source.LAST_FULL_WEEK, stable_activity_ratio=0.5),
    churn=ChurnParams(recent_weeks=52),
    promo=PromoParams(excluded_departments=("cold",)),
)
LAST_PERIOD = cohorts.last_full_period(WINDOW.end_week, PARAMS.cohorts.period_weeks)

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return round_doubles(build(spark, folder))

    QUERIES[build.__name__] = run
    return build


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "transaction_data": source.raw_transactions(spark, folder),
        "product": source.raw_products(spark, folder),
    }


def checked_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Cleaned tables that still have what the quality checks look for."""
    lines = clean.drop_duplicate_rows(source.raw_transactions(spark, folder))
    return {
        "transaction_data": clean.drop_invalid_transactions(lines),
        "product": trim_strings(source.raw_products(spark, folder)),
        "hh_demographic": source.demographics(spark, folder),
        "causal_data": source.promo_causal(spark, folder),
    }


def retail_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Lines are staged: who takes all tables reads them several times, and each reading joins."""
    return {
        "transaction_data": stage(source.transactions(spark, folder), "lines"),
        "product": source.products(spark, folder),
        "hh_demographic": source.demographics(spark, folder),
    }


def product_weeks(
    spark: SparkSession, folder: str, lines: DataFrame | None = None
) -> DataFrame:
    """``lines`` are ready ``source.transactions``."""
    return promo.promo_product_week(
        source.promo_causal(spark, folder),
        source.promo_transactions(spark, folder, lines),
        source.promo_products(spark, folder),
        PARAMS.codes,
    )


def kept_product_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Staged, because the calendar of the table and its rows are both read."""
    kept = promo.keep_departments(product_weeks(spark, folder), PARAMS.promo)
    return stage(kept, "product-weeks")


def flags(spark: SparkSession, folder: str) -> DataFrame:
    """Staged too: group flags and members both read them."""
    marked = promo.informative(kept_product_weeks(spark, folder), PARAMS.promo, WINDOW)
    return stage(marked, "promo-flags")


# --- sources and sinks ------------------------------------------------------------------------


def written_csv(frame: DataFrame, table: str) -> str:
    """``frame`` as the raw CSV of ``table``, in the column order and names of the raw files."""
    target = new_folder(frame.sparkSession, "raw")
    columns = {snake_case(field.name): field for field in RAW_SCHEMAS[table].fields}
    ordered = frame.select(
        *(
            (F.col(name) if name in frame.columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for name, field in columns.items()
        )
    )
    plain = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.write.csv(f"{target}/{table}.csv", **plain)
    return target


@query
def csv_transactions(spark, folder):
    target = written_csv(source.raw_transactions(spark, folder), "transaction_data")
    return read_raw(spark, target, "transaction_data")


@query
def csv_products(spark, folder):
    target = written_csv(source.raw_products(spark, folder), "product")
    return read_raw(spark, target, "product")


@query
def parquet_by_week(spark, folder):
    """Written in one folder per week; a week range reads back only its folders."""
    target = new_folder(spark, "by-week")
    write_table(source.transactions(spark, folder), target, "week_no")
    return spark.read.parquet(target).where(F.col("week_no").between(100, 200))


@query
def sql_file(spark, folder):
    register_views({"transaction_data": source.transactions(spark, folder)})
    sql_dir = os.path.join(os.path.dirname(os.path.abspath(__file__)), "sql")
    return run_sql_file(spark, sql_dir, "store_revenue", {"first_week": 100, "last_week": 200})


@query
def write_clean_counts(spark, folder):
    """Counts observed while the clean table is written."""
    target = new_folder(spark, "clean")
    counts = write_clean(source.raw_transactions(spark, folder), "transaction_data", target)
    return spark.createDataFrame([tuple(counts.values())], [*counts]).withColumn(
        "rows_written", spark.read.parquet(f"{target}/transaction_data").agg(F.count("*")).scalar()
    )


# --- cleaning ---------------------------------------------------------------------------------


@query
def clean_strings(spark, folder):
    return trim_strings(source.raw_products(spark, folder))


@query
def dedup_rows(spark, folder):
    return clean.drop_duplicate_rows(source.raw_transactions(spark, folder))


@query
def invalid_reason_counts(spark, folder):
    return clean.invalid_reason_counts(source.raw_transactions(spark, folder))


@query
def clean_transactions(spark, folder):
    return checked_tables(spark, folder)["transaction_data"]


@query
def prepare_stats(spark, folder):
    return clean.prepare_stats(raw_tables(spark, folder))


# --- quality ----------------------------------------------------------------------------------


@query
def dq_null_counts(spark, folder):
    return quality.null_counts(
        checked_tables(spark, folder)["transaction_data"],
        "transaction_data",
        PARAMS.quality.key_columns["transaction_data"],
    )


@query
def dq_orphan_products(spark, folder):
    tables = checked_tables(spark, folder)
    return quality.orphan_products(tables["transaction_data"], tables["product"])


@query
def dq_hierarchy_sold(spark, folder):
    tables = checked_tables(spark, folder)
    return quality.products_without_hierarchy(
        tables["product"], PARAMS.quality.hierarchy_columns, tables["transaction_data"]
    )


@query
def dq_hierarchy_reference(spark, folder):
    return quality.products_without_hierarchy(
        checked_tables(spark, folder)["product"], PARAMS.quality.hierarchy_columns
    )


@query
def dq_week_range(spark, folder):
    tables = checked_tables(spark, folder)
    return quality.week_range(tables["transaction_data"], "transaction_data").unionByName(
        quality.week_range(tables["causal_data"], "causal_data")
    )


@query
def dq_report(spark, folder):
    """The checks read the lines several times, as they would read a written table.
    """
    tables = checked_tables(spark, folder)
    tables["transaction_data"] = stage(tables["transaction_data"], "clean-lines")
    return quality.run_checks(tables, PARAMS.quality)


@query
def weekly_activity(spark, folder):
    return quality.weekly_activity(source.transactions(spark, folder))


@query
def analysis_window(spark, folder):
    return quality.analysis_window(
        quality.weekly_activity(source.transactions(spark, folder)),
        PARAMS.quality.stable_activity_ratio,
        PARAMS.quality.full_week_days,
    )


@query
def dataset_totals(spark, folder):
    return quality.dataset_totals(source.transactions(spark, folder))


# --- business ---------------------------------------------------------------------------------


@query
def weekly_kpi(spark, folder):
    return business.weekly_kpi(source.transactions(spark, folder), WINDOW)


@query
def category_share(spark, folder):
    return business.category_share(
        source.transactions(spark, folder),
        source.products(spark, folder),
        WINDOW,
        PARAMS.business.top_categories,
    )


@query
def top3_department_share(spark, folder):
    return business.top3_department_share(category_share(spark, folder))


@query
def business_totals(spark, folder):
    return business.business_totals(source.transactions(spark, folder), WINDOW)


@query
def trend_change(spark, folder):
    return business.trend_change(weekly_kpi(spark, folder), PARAMS.business.trend_weeks)


# --- RFM --------------------------------------------------------------------------------------


def rfm_metrics(spark, folder):
    return rfm.rfm_metrics(source.transactions(spark, folder), WINDOW)


@query
def rfm_scores(spark, folder):
    return rfm.rfm_scores(rfm_metrics(spark, folder), PARAMS.rfm.score_buckets)


@query
def rfm_segmented(spark, folder):
    return rfm.assign_segments(rfm_scores(spark, folder), PARAMS.rfm.segments)


@query
def rfm_segments(spark, folder):
    return rfm.segment_summary(rfm_segmented(spark, folder), PARAMS.rfm.segments)


@query
def rfm_segments_long(spark, folder):
    return report.segments_long(rfm_segments(spark, folder))


@query
def top_customers_share(spark, folder):
    return rfm.top_customers_share(rfm_metrics(spark, folder), PARAMS.rfm.top_customers_share)


@query
def rfm_headline(spark, folder):
    return rfm.rfm_headline(rfm_metrics(spark, folder))


# --- cohorts ----------------------------------------------------------------------------------


@query
def cohort_activity(spark, folder):
    return cohorts.cohort_activity(
        source.transactions(spark, folder), WINDOW.end_week, PARAMS.cohorts.period_weeks
    )


@query
def cohort_sizes(spark, folder):
    return cohorts.cohort_sizes(cohort_activity(spark, folder))


@query
def retention_matrix(spark, folder):
    return cohorts.retention_matrix(
        cohort_activity(spark, folder),
        PARAMS.cohorts.min_cohort_size,
        LAST_PERIOD,
        PARAMS.cohorts.period_weeks,
    )


@query
def average_retention(spark, folder):
    return cohorts.average_retention(retention_matrix(spark, folder))


@query
def retention_plateau(spark, folder):
    return cohorts.retention_plateau(average_retention(spark, folder))


@query
def cohort_headline(spark, folder):
    tables = {"transaction_data": source.transactions(spark, folder)}
    return analyze.cohort_section(tables, WINDOW, PARAMS)["cohort_headline"]


# --- churning loyal households ----------------------------------------------------------------


@query
def household_activity(spark, folder):
    lines = source.transactions(spark, folder)
    return churn.household_activity(lines, WINDOW, PARAMS.churn)


@query
def loyalty_flags(spark, folder):
    return churn.loyalty_flags(household_activity(spark, folder), PARAMS.churn)


@query
def first_half_cume_dist(spark, folder):
    return churn.first_half_cume_dist(household_activity(spark, folder))


def household_groups(spark, folder):
    return churn.household_groups(source.transactions(spark, folder), WINDOW, PARAMS.churn)


@query
def churn_households(spark, folder):
    return churn.churn_households(
        household_groups(spark, folder), source.demographics(spark, folder)
    )


@query
def household_department(spark, folder):
    return churn.household_department(
        source.transactions(spark, folder), source.products(spark, folder), WINDOW, PARAMS.churn
    )


@query
def churn_rows(spark, folder):
    return churn.churn_rows(churn_households(spark, folder), household_department(spark, folder))


@query
def churn_groups(spark, folder):
    return churn.group_summary(household_groups(spark, folder))


@query
def churn_groups_long(spark, folder):
    return report.groups_long(churn_groups(spark, folder))


@query
def basket_value_test(spark, folder):
    return churn.basket_value_test(household_groups(spark, folder))


def churn_tables(spark, folder):
    return analyze.churn_tables(retail_tables(spark, folder), WINDOW, PARAMS)


@query
def department_mix(spark, folder):
    households, departments = churn_tables(spark, folder)
    settings = PARAMS.churn
    mix = churn.department_mix(households, departments, settings.top_departments)
    return churn.department_mix_tests(mix, settings.top_departments, settings.alpha)


@query
def department_mix_headline(spark, folder):
    return churn.department_mix_headline(department_mix(spark, folder))


@query
def demographic_crosstab(spark, folder):
    return churn.demographic_crosstab(churn_households(spark, folder))


@query
def demographic_tests(spark, folder):
    statistics = churn.demographic_statistics(
        churn_households(spark, folder), PARAMS.churn.min_expected_count
    )
    return churn.demographic_tests(statistics, PARAMS.churn.alpha)


@query
def churn_headline(spark, folder):
    return churn.churn_headline(churn_groups(spark, folder))


# --- promotions -------------------------------------------------------------------------------


@query
def promo_product_week(spark, folder):
    return product_weeks(spark, folder)


@query
def promo_product_week_filtered(spark, folder):
    return promo.keep_departments(product_weeks(spark, folder), PARAMS.promo)


@query
def promo_spine(spark, folder):
    return promo.promo_spine(kept_product_weeks(spark, folder))


@query
def promo_weeks(spark, folder):
    return promo.promo_weeks(kept_product_weeks(spark, folder), PARAMS.promo, WINDOW)


@query
def promo_flags(spark, folder):
    kept = kept_product_weeks(spark, folder)
    return promo.promo_flags(kept, PARAMS.promo, WINDOW).drop("history")


def members(spark, folder):
    return analyze.promo_members(product_weeks(spark, folder), WINDOW, PARAMS.promo)


@query
def promo_events(spark, folder):
    return promo.promo_events(flags(spark, folder)).select(*promo.EVENT_COLUMNS)


@query
def cannibalization_events(spark, folder):
    return promo.cannibalization_events(flags(spark, folder)).select(*promo.EVENT_COLUMNS)


@query
def promo_panel(spark, folder):
    return promo.expand_to_panel(promo.promo_events(flags(spark, folder)))


@query
def promo_group_means(spark, folder):
    return promo.group_means(promo_panel(spark, folder), "units")


@query
def display_share(spark, folder):
    return promo.display_share(promo_panel(spark, folder))


@query
def did_units(spark, folder):
    events, cannibal = members(spark, folder)
    return (
        inference.did_units(events)
        .select(F.lit("promo").alias("design"), "*")
        .unionByName(
            inference.did_units(cannibal).select(F.lit("cannibalization").alias("design"), "*")
        )
    )


@query
def demeaned_panel(spark, folder):
    panel = promo_panel(spark, folder).withColumn("y", F.log1p("units"))
    return inference.two_way_demean(panel, ["y", "display_share"], PARAMS.promo.pre_weeks)


@query
def did_estimates(spark, folder):
    return analyze.did_estimates(*members(spark, folder), PARAMS.promo)


def _study(events):
    settings = PARAMS.promo
    return inference.estimate_event_study(
        events, "units", settings.confidence_level, settings.pre_weeks
    )


@query
def event_study(spark, folder):
    return _study(members(spark, folder)[0])


@query
def cannibalization_event_study(spark, folder):
    return _study(members(spark, folder)[1])


@query
def promo_headline(spark, folder):
    return inference.largest_pre_gap(event_study(spark, folder))


@query
def promo_effects(spark, folder):
    return report.effects_table(did_estimates(spark, folder))


# --- documents --------------------------------------------------------------------------------


@query
def products_left_out(spark, folder):
    """Every fifth part name loses its sub-commodity here, every other third one its commodity."""
    number, kept = F.col("product_id"), kept_product_weeks(spark, folder)
    return promo.products_left_out(
        kept.withColumns(
            {
                "sub_commodity_desc": F.when(number % 5 != 0, F.col("sub_commodity_desc")),
                "commodity_desc": F.when(number % 3 != 0, F.col("commodity_desc")),
            }
        )
    )


@query
def quality_gate_failures(spark, folder):
    """The gate writes its report, then raises: the written checks that its error names."""
    target = new_folder(spark, "gate")
    try:
        quality_gate.run_gate(checked_tables(spark, folder), PARAMS.quality, target)
    except quality.DataQualityError as error:
        named = str(error)
    else:
        named = ""
    listed = F.concat(F.col("name"), F.lit(": "), F.col("details"))
    checks = quality_gate.read_report(spark, target)["checks"]
    return checks.where(F.lit(named).contains(listed)).select("name", "critical", "status", "details")


@query
def data_summary(spark, folder):
    checked = checked_tables(spark, folder)
    gate = quality_gate.quality_report(
        {**checked, "transaction_data": source.transactions(spark, folder)}, PARAMS.quality
    )
    gate["prepare_stats"] = clean.prepare_stats(raw_tables(spark, folder))
    lines = {"transaction_data": source.transactions(spark, folder)}
    return analyze.data_section(lines, gate)["data_summary"]


@query
def results_metrics(spark, folder):
    tables = retail_tables(spark, folder)
    tables["promo_product_week"] = product_weeks(spark, folder, tables["transaction_data"])
    return analyze.analyze(tables, WINDOW, PARAMS)["results_metrics"]


# --- exact rank test --------------------------------------------------------------------------


@query
def rank_sum_exact(spark, folder):
    """Account balances of a region's nations against all others: small groups, no ties."""
    customers, nations, regions = (
        spark.read.parquet(f"{folder}/{name}.parquet") for name in ("customer", "nation", "region")
    )
    balances = (
        customers.groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.sum(F.rint(F.col("c_acctbal") * 100).cast("bigint")).cast("double").alias("balance"))
        .join(nations, "n_nationkey")
    )
    every = regions.agg(F.sort_array(F.collect_set("r_regionkey"))).scalar()  # five regions
    rows = balances.withColumn("test", F.explode(every))
    sums = group_tests.rank_sums(
        rows, "test", "balance", "n_nationkey", F.col("n_regionkey") == F.col("test")
    )
    tested = group_tests.add_rank_sum_p_values(sums, "exact")
    return tested.select("test", "n1", "n2", "u", "p_value", "method")
