"""Reading and writing tables, temporary views, and named SQL files."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from basketry.functions.columns import snake_case, trim_strings
from basketry.sources.schemas import PROCESSED_TABLES, RAW_SCHEMAS


def read_raw(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """Read a raw CSV: explicit schema, snake-case names, trimmed text.

    A malformed value raises. ``enforceSchema=False`` also raises when the header does not
    have the schema's column order; by default the columns would be matched by position.
    """
    raw = spark.read.schema(RAW_SCHEMAS[table]).csv(
        f"{raw_dir}/{table}.csv", header=True, mode="FAILFAST", enforceSchema=False
    )
    return trim_strings(raw.toDF(*map(snake_case, raw.columns)))


def write_table(frame: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a Parquet table, optionally laid out in one folder per value.

    The rebalance hint gathers the rows of a folder into few files and splits a folder that
    is too large for one task.
    """
    if partition_by is None:
        frame.write.mode("overwrite").parquet(path)
    else:
        spread = frame.hint("rebalance", partition_by)
        spread.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def read_tables(spark: SparkSession, processed_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{processed_dir}/{name}") for name in PROCESSED_TABLES}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """One temporary view per table, so that SQL can name them."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def run_sql_file(
    spark: SparkSession, sql_dir: str, name: str, params: Mapping[str, Any] | None = None
) -> DataFrame:
    """Run ``<sql_dir>/<name>.sql`` with ``:name`` parameters bound by value."""
    with open(os.path.join(sql_dir, f"{name}.sql"), encoding="utf-8") as file:
        return spark.sql(file.read(), args=dict(params or {}))
