"""Checks, weekly activity and analysis window as tables; then the gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from basketry.operators import quality
from basketry.params import QualityParams, Window
from basketry.sources.storage import stage


REPORT_SCHEMAS = {
    "checks": "name string, passed boolean, critical boolean, details string, status string",
    "weekly_activity": "week_no int, active_households bigint, days bigint",
    "analysis_window": "start_week int, end_week int, active_households_threshold double",
}


def quality_report(
    tables: Mapping[str, DataFrame],
    params: QualityParams,
    measured: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The three tables of the report.

    The lines are read for one staged table of sets, which gives the weekly profile and the sold
    products, and for nulls and weeks only if the job that wrote them has not ``measured`` those.
    """
    lines = tables["transaction_data"]
    sets = stage(quality.line_sets(lines), "line-sets")
    weekly = stage(quality.weekly_activity(lines, sets), "weekly-activity")
    return {
        "checks": quality.run_checks(tables, params, measured, quality.sold_products(sets)),
        "weekly_activity": weekly,
        "analysis_window": quality.analysis_window(
            weekly, params.stable_activity_ratio, params.full_week_days
        ),
    }


def read_report(spark: SparkSession, report_dir: str) -> dict[str, DataFrame]:
    """The report as ``run_gate`` wrote it, by the same names."""
    return {
        name: spark.read.schema(schema).json(f"{report_dir}/{name}")
        for name, schema in REPORT_SCHEMAS.items()
    }


def run_gate(
    tables: Mapping[str, DataFrame],
    params: QualityParams,
    report_dir: str,
    measured: Mapping[str, DataFrame] | None = None,
) -> Window:
    """Write the report, then raise on critical failures; a failed run keeps its evidence.

    ``measured`` is what ``prepare`` observed while it wrote the tables (``read_measures``).
    """
    report = quality_report(tables, params, measured)
    for name, frame in report.items():
        frame.write.mode("overwrite").json(f"{report_dir}/{name}")
    written = read_report(report["checks"].sparkSession, report_dir)
    quality.raise_on_critical(written["checks"])
    row = written["analysis_window"].first()
    return Window(row["start_week"], row["end_week"])
