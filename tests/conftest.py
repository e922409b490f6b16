"""One local session for all tests, and small hand-made tables."""

from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

LINE = (
    "household_key INT, basket_id BIGINT, week_no INT, sales_value DOUBLE, day INT, "
    "product_id INT, quantity INT, store_id INT"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Partitions are not merged, so that ranks cross real partition borders.
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stage")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def lines(spark):
    """Purchase lines from (household, basket, week, sales) tuples; the day is the week's last."""

    def build(rows, **columns):
        full = [
            (
                household,
                basket,
                week,
                float(sales),
                None if week is None else week * 7,
                columns.get("product_id", 1),
                columns.get("quantity", 1),
                columns.get("store_id", 1),
            )
            for household, basket, week, sales in rows
        ]
        return spark.createDataFrame(full, LINE)

    return build
