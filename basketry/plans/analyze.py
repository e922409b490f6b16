"""Every analysis section over the processed tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators import business, churn, cohorts, inference, promo, quality, rfm
from basketry.operators.inference import Model
from basketry.params import JobParams, PromoParams, Window
from basketry.plans import report
from basketry.sources.storage import stage

Tables = Mapping[str, DataFrame]


def basket_table(tables: Tables) -> DataFrame:
    """The shared basket table where ``analyze`` has made one, else the lines themselves."""
    return tables.get("baskets", tables["transaction_data"])


def data_section(tables: Tables, data: Tables) -> dict[str, DataFrame]:
    """What the numbers rest on, from the preparation's counts and the gate's report."""
    totals = stage(quality.dataset_totals(tables["transaction_data"]), "dataset-totals")
    weekly, window = data["weekly_activity"], data["analysis_window"]
    return {
        "dataset_totals": totals,
        "excluded_weeks": report.excluded_weeks(weekly, window),
        "data_summary": report.data_summary(
            data["prepare_stats"], data["checks"], window, weekly, totals
        ),
    }


def business_section(tables: Tables, window: Window, params: JobParams) -> dict[str, DataFrame]:
    baskets = basket_table(tables)
    sets = stage(business.weekly_sets(baskets, window), "weekly-sets")
    weekly = stage(business.weekly_kpi(baskets, window, sets), "weekly-kpi")
    shares = business.category_share(
        tables["transaction_data"], tables["product"], window, params.business.top_categories
    )
    shares = stage(shares, "category-share")
    return {
        "weekly_kpi": weekly,
        "category_share": shares,
        "business_totals": business.business_totals(baskets, window, weekly, sets),
        "trend_change": business.trend_change(weekly, params.business.trend_weeks),
        "top3_department_share": business.top3_department_share(shares),
    }


def rfm_section(tables: Tables, window: Window, params: JobParams) -> dict[str, DataFrame]:
    metrics = stage(rfm.rfm_metrics(basket_table(tables), window), "rfm-metrics")
    rules = params.rfm.segments
    segmented = rfm.assign_segments(rfm.rfm_scores(metrics, params.rfm.score_buckets), rules)
    summary = rfm.segment_summary(segmented, rules)
    return {
        "rfm_segmented": segmented,
        "rfm_segments": summary,
        "rfm_segments_long": report.segments_long(summary),
        "rfm_headline": rfm.rfm_headline(metrics),
        "top_customers_share": rfm.top_customers_share(metrics, params.rfm.top_customers_share),
    }


def cohort_section(tables: Tables, window: Window, params: JobParams) -> dict[str, DataFrame]:
    settings = params.cohorts
    activity = stage(
        cohorts.cohort_activity(basket_table(tables), window.end_week, settings.period_weeks),
        "cohort-activity",
    )
    matrix = cohorts.retention_matrix(
        activity,
        settings.min_cohort_size,
        cohorts.last_full_period(window.end_week, settings.period_weeks),
        settings.period_weeks,
    )
    average = cohorts.average_retention(matrix)
    return {
        "cohort_activity": activity,
        "cohort_sizes": cohorts.cohort_sizes(activity),
        "retention_matrix": matrix,
        "average_retention": average,
        "retention_plateau": cohorts.retention_plateau(average),
        "cohort_headline": cohorts.cohort_headline(
            activity, matrix, settings.min_cohort_size, settings.report_periods
        ),
    }


def churn_tables(
    tables: Tables, window: Window, params: JobParams
) -> tuple[DataFrame, DataFrame]:
    """Household table and household-department table, both staged."""
    lines, settings = tables["transaction_data"], params.churn
    groups = churn.household_groups(basket_table(tables), window, settings)
    households = churn.churn_households(groups, tables["hh_demographic"])
    departments = churn.household_department(lines, tables["product"], window, settings)
    return stage(households, "churn-households"), stage(departments, "household-department")


def churn_section(tables: Tables, window: Window, params: JobParams) -> dict[str, DataFrame]:
    households, departments = churn_tables(tables, window, params)
    settings = params.churn
    summary = churn.group_summary(households)
    mix = churn.department_mix(households, departments, settings.top_departments)
    mix_tests = churn.department_mix_tests(mix, settings.top_departments, settings.alpha)
    statistics = churn.demographic_statistics(households, settings.min_expected_count)
    return {
        "churn_rows": churn.churn_rows(households, departments),
        "churn_groups": summary,
        "churn_groups_long": report.groups_long(summary),
        "basket_value_test": churn.basket_value_test(households),
        "department_mix": mix_tests,
        "demographic_tests": churn.demographic_tests(statistics, settings.alpha),
        "churn_headline": churn.churn_headline(summary),
        "department_mix_headline": churn.department_mix_headline(mix_tests),
    }


def promo_members(
    product_weeks: DataFrame, window: Window, params: PromoParams
) -> tuple[DataFrame, DataFrame]:
    """Promo and cannibalisation event members with their outcome history, both staged."""
    return members_of(kept_product_weeks(product_weeks, params), window, params)


def kept_product_weeks(product_weeks: DataFrame, params: PromoParams) -> DataFrame:
    """Staged: making them reads the lines, and several results read them."""
    return stage(promo.keep_departments(product_weeks, params), "product-weeks")


def members_of(
    kept: DataFrame, window: Window, params: PromoParams
) -> tuple[DataFrame, DataFrame]:
    """``promo_members`` of a ready ``kept_product_weeks``."""
    flags = stage(promo.informative(kept, params, window), "promo-flags")
    return (
        stage(promo.promo_events(flags), "promo-events"),
        stage(promo.cannibalization_events(flags), "cannibalization-events"),
    )


def promo_models() -> tuple[dict[str, Model], dict[str, Model]]:
    """Effect models of the promo events and of the cannibalisation events."""
    return (
        {
            "units": inference.did_model("units"),
            "revenue": inference.did_model("revenue"),
            "units_display_control": inference.did_model("units", ("display_share",)),
        },
        {"cannibalization_units": inference.did_model("units")},
    )


def did_estimates(
    events: DataFrame, cannibal: DataFrame, params: PromoParams
) -> DataFrame:
    """The four effects: units, revenue, units given display, units of the siblings."""
    level, k = params.confidence_level, params.pre_weeks
    rows = [
        inference.did_rows(members, inference.fit_events(members, models, k), models, level)
        for members, models in zip((events, cannibal), promo_models(), strict=True)
    ]
    return rows[0].unionByName(rows[1])


def promo_section(tables: Tables, window: Window, params: JobParams) -> dict[str, DataFrame]:
    """All models of an event table are fitted from the same passes over it."""
    settings = params.promo
    level, k = settings.confidence_level, settings.pre_weeks
    kept = kept_product_weeks(tables["promo_product_week"], settings)
    both = members_of(kept, window, settings)
    estimates, studies = [], []
    for members, models in zip(both, promo_models(), strict=True):
        study = inference.study_model("units", k)
        fits = inference.fit_events(members, {**models, "study": study}, k)
        studies.append(inference.study_rows(members, fits.pop("study"), k, level))
        estimates.append(inference.did_rows(members, fits, models, level))
    combined = estimates[0].unionByName(estimates[1])
    panel = promo.expand_to_panel(both[0])
    return {
        "did_estimates": combined,
        "promo_effects": report.effects_table(combined),
        "event_study": studies[0],
        "cannibalization_event_study": studies[1],
        "promo_headline": inference.largest_pre_gap(studies[0]),
        "pretrend_tests": report.pretrend_tests(
            {"promo": studies[0], "cannibalization": studies[1]}
        ),
        "products_left_out": promo.products_left_out(kept),
        "promo_group_means": promo.group_means(panel, "units"),
        "display_share": promo.display_share(panel),
    }


def analyze(
    tables: Tables, window: Window, params: JobParams, data: Tables | None = None
) -> dict[str, DataFrame]:
    """All result tables by name, with one long table of the key numbers.

    Lines are read three times: for the basket table, the categories and the departments.
    ``data`` adds the data section, which reads them once more: ``prepare_stats`` as read by
    ``read_stats``, and the tables of ``read_report``.
    """
    lines = tables["transaction_data"]
    tables = {**tables, "baskets": stage(business.baskets(lines), "baskets")}
    results = {"parameters": report.parameters(lines.sparkSession, params, window)}
    if data is not None:
        results.update(data_section(tables, data))
    for section in (business_section, rfm_section, cohort_section, churn_section, promo_section):
        results.update(section(tables, window, params))
    results["results_metrics"] = report.results_metrics(
        {
            "business": [
                results[name]
                for name in ("business_totals", "trend_change", "top3_department_share")
            ],
            "rfm": [
                results["rfm_headline"].drop("households"),
                results["top_customers_share"],
                results["rfm_segments"].drop("segment_order"),
            ],
            "cohorts": [
                results["cohort_headline"],
                results["retention_plateau"],
                results["cohort_sizes"].withColumn(
                    "cohort_period", F.col("cohort_period").cast("string")
                ),
            ],
            "churning_loyal": [
                results["churn_headline"],
                results["churn_groups"],
                results["basket_value_test"].select(
                    "test", "churning_median", "stable_median", "p_value"
                ),
            ],
            "promo": [
                results["did_estimates"].drop("outcome"),
                results["promo_headline"],
                results["display_share"],
                results["pretrend_tests"],
                results["products_left_out"],
            ],
        }
    )
    return results


#: Rows of a written result come in this order; a minus sign means descending. Results that are not
#: listed are ordered by their columns from the left.
ORDER = {
    "rfm_segments": ("segment_order",),
    "rfm_segmented": ("household_key",),
    "churn_rows": ("household_key",),
    "category_share": ("category_level", "revenue_rank"),
}


def in_order(name: str, frame: DataFrame) -> DataFrame:
    """``frame`` sorted for readers: by range, so a large result is not sorted in one task."""
    plain = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.AtomicType)}
    wanted = [x for x in ORDER.get(name, ()) if x.lstrip("-") in plain]
    keys = wanted or [x for x in frame.columns if x in plain]
    return frame.orderBy(
        *(F.col(x[1:]).desc() if x.startswith("-") else F.col(x).asc_nulls_first() for x in keys)
    )


def write_results(results: Mapping[str, DataFrame], report_dir: str) -> None:
    for name, frame in results.items():
        in_order(name, frame).write.mode("overwrite").json(f"{report_dir}/{name}")
