"""Tables behind the results document and the charts."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.churn import is_loyal_group
from basketry.params import JobParams, Window


def long_metrics(frame: DataFrame, section: str, label: str | None = None) -> DataFrame:
    """Number columns as rows (section, metric, label, value)."""
    numbers = [name for name in frame.columns if name != label]
    wide = frame.select(
        (F.col(label).cast("string") if label else F.lit("")).alias("label"),
        *(F.col(name).cast("double").alias(name) for name in numbers),
    )
    return wide.unpivot(["label"], numbers, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "label", "value"
    )


def results_metrics(sections: Mapping[str, list[DataFrame]]) -> DataFrame:
    """One long table of every section's key numbers.

    A frame may carry one string column, which becomes the label of its rows.
    """
    rows = []
    for section, frames in sections.items():
        for frame in frames:
            text = [name for name, kind in frame.dtypes if kind == "string"]
            rows.append(long_metrics(frame, section, text[0] if text else None))
    return reduce(DataFrame.unionByName, rows)


def _dotted(prefix: str, value: Any) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from _dotted(f"{prefix}.{name}" if prefix else name, inner)
    else:
        yield prefix, json.dumps(value, ensure_ascii=False)


def parameters(spark: SparkSession, params: JobParams, window: Window) -> DataFrame:
    """Every parameter of a run and its window: dotted name and value as JSON text."""
    rows = [*_dotted("", asdict(params)), *_dotted("window", asdict(window))]
    return spark.createDataFrame(rows, "name string, value string")


def segments_long(summary: DataFrame) -> DataFrame:
    """Household and revenue share of every segment, one row per metric."""
    return summary.unpivot(["segment"], ["household_share", "revenue_share"], "metric", "share")


def groups_long(summary: DataFrame) -> DataFrame:
    """Baskets before and in the recent block for the loyal groups, one row per period."""
    return summary.where(is_loyal_group()).unpivot(
        ["household_group"], ["baseline_baskets", "recent_baskets"], "period", "baskets"
    )


def excluded_weeks(weekly: DataFrame, window: DataFrame) -> DataFrame:
    """Week ranges outside the analysis window: before its start, and after its end if any."""
    last = weekly.agg(F.max("week_no")).scalar()
    ranges = F.array(
        F.struct(
            F.lit("ramp_up").alias("reason"),
            F.lit(1).alias("first_week"),
            (F.col("start_week") - 1).alias("last_week"),
        ),
        F.struct(
            F.lit("incomplete").alias("reason"),
            (F.col("end_week") + 1).alias("first_week"),
            F.col("last").alias("last_week"),
        ),
    )
    return (
        window.withColumn("last", last)
        .select(F.inline(ranges))
        .where((F.col("reason") == "ramp_up") | (F.col("first_week") <= F.col("last_week")))
    )


def data_summary(
    stats: DataFrame, checks: DataFrame, window: DataFrame, weekly: DataFrame, totals: DataFrame
) -> DataFrame:
    """Row counts, removed share, check outcomes, window, excluded weeks and table totals."""
    counts = stats.drop("removed_share_of_distinct")
    outcome = checks.select("name", F.col("passed").cast("int").alias("check_passed"))
    return reduce(
        DataFrame.unionByName,
        [
            long_metrics(counts, "tables", "table_name"),
            long_metrics(outcome, "checks", "name"),
            long_metrics(window, "analysis_window"),
            long_metrics(excluded_weeks(weekly, window), "excluded_weeks", "reason"),
            long_metrics(totals, "totals"),
        ],
    )


def effects_table(estimates: DataFrame) -> DataFrame:
    """Effect in percent with its interval, one row per estimate."""
    return estimates.select("estimate", "effect_pct", "effect_pct_ci_low", "effect_pct_ci_high")


def pretrend_tests(studies: Mapping[str, DataFrame]) -> DataFrame:
    """Joint test of the weeks before the last one, one row per event study."""
    return reduce(
        DataFrame.unionByName,
        [
            study.where("rel_week = -1").select(
                F.lit(name).alias("study"), "pretrend_f", "pretrend_p_value"
            )
            for name, study in studies.items()
        ],
    )
