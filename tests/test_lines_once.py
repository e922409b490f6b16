"""The lines are joined and summed once for all results that need them."""

from __future__ import annotations

from datetime import datetime

from basketry.params import PromoParams, Window
from basketry.plans import analyze
from basketry.sources import driver_tables as source
from checks import catalog

ROWS = {
    "region": [(0, "east")],
    "nation": [(0, "here", 0)],
    "customer": [(1, 0, 10.0, "trade"), (2, 0, -1.0, "home")],
    "supplier": [(1, 0)],
    "part": [(1, "red gear", "b1", "t1"), (2, "blue bolt", "b2", "t2")],
    "orders": [(1, 1, datetime(1995, 1, 3)), (2, 2, datetime(1995, 2, 3)), (3, 2, None)],
    # A copy, an order and a supplier that are not there.
    "lineitem": [(1, 1, 1, 2.0, 10.0, 0.1)] * 2
    + [(2, 2, 1, 1.0, 5.0, 0.0), (3, 1, 1, 1.0, 4.0, 0.0), (9, 1, 1, 1.0, 5.0, 0.0)]
    + [(2, 1, 9, 1.0, 5.0, 0.0)],
}


def driver_folder(spark, folder) -> str:
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, source.SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_retail_tables_join_the_lines_once(spark, tmp_path):
    folder = driver_folder(spark, tmp_path)
    lines = catalog.retail_tables(spark, folder)["transaction_data"]
    plain = source.transactions(spark, folder)
    assert not [name for name in lines.inputFiles() if "lineitem" in name]
    assert lines.schema == plain.schema
    assert sorted(map(str, lines.collect())) == sorted(map(str, plain.collect()))
    assert lines.count() == 4
    of_lines = source.promo_transactions(spark, folder, lines)
    assert not [name for name in of_lines.inputFiles() if "lineitem" in name]
    every = source.promo_transactions(spark, folder)
    assert sorted(map(str, of_lines.collect())) == sorted(map(str, every.collect()))


def test_promo_section_reads_the_product_weeks_once(spark, tmp_path):
    folder = str(tmp_path / "product-weeks")
    # Product 7 has no commodity, product 8 has no sub-commodity; the first one is promoted.
    spark.createDataFrame(
        [
            (p, week, "d", "c" if p < 7 else None, f"s{p % 2}" if p < 8 else None,
             1 + p * week % 5, 5.0, float((p, week) == (1, 8)), 0.0)
            for p in range(1, 9)
            for week in range(1, 13)
        ],
        "product_id INT, week_no INT, department STRING, commodity_desc STRING, "
        "sub_commodity_desc STRING, units BIGINT, revenue DOUBLE, mailer_store_share DOUBLE, "
        "display_store_share DOUBLE",
    ).write.parquet(folder)
    params = catalog.JobParams(
        promo=PromoParams(pre_weeks=2, min_pre_weeks_with_sales=1, excluded_departments=())
    )
    tables = {"promo_product_week": spark.read.parquet(folder)}
    results = analyze.promo_section(tables, Window(1, 12), params)
    left_out = results["products_left_out"]
    assert not [name for name in left_out.inputFiles() if folder in name]
    assert tuple(left_out.first()) == (1, 1)
