from __future__ import annotations

import pytest

from basketry.operators import business
from basketry.params import Window
from tests.helpers import as_dict


def test_weekly_kpi_skips_missing_weeks(lines):
    frame = lines([(1, 1, 1, 10), (1, 1, 1, 10), (2, 2, 1, 20), (1, 3, 3, 60), (1, 4, 9, 1)])
    rows = as_dict(business.weekly_kpi(frame, Window(1, 5)), "week_no")
    assert set(rows) == {1, 3}
    first, third = rows[1], rows[3]
    assert (first["revenue"], first["baskets"], first["active_households"]) == (40.0, 2, 2)
    assert (first["avg_basket_value"], first["revenue_wow_change"]) == (20.0, None)
    # Against week 1, the last week with purchases.
    assert third["revenue_wow_change"] == pytest.approx(0.5)


def test_a_basket_of_two_households_counts_once(lines):
    frame = lines([(1, 1, 1, 10), (2, 1, 1, 10)])
    row = business.weekly_kpi(frame, Window(1, 1)).first()
    assert (row["baskets"], row["active_households"]) == (1, 2)


@pytest.fixture(scope="module")
def shop(spark, lines):
    products = spark.createDataFrame(
        [(1, "A", "x"), (2, "B", "y"), (3, "C", "x"), (4, None, "z")],
        "product_id INT, department STRING, commodity_desc STRING",
    )
    parts = [
        lines([(1, 1, 1, 10), (1, 1, 1, 10)], product_id=1),
        lines([(1, 1, 1, 20)], product_id=2),
        lines([(1, 1, 1, 5)], product_id=3),
        lines([(1, 2, 2, 15)], product_id=4),
        lines([(1, 3, 3, 99)], product_id=5),
    ]
    frame = parts[0]
    for part in parts[1:]:
        frame = frame.unionByName(part)
    return frame, products


def test_category_share(shop):
    rows = business.category_share(*shop, Window(1, 9), 3).collect()
    got = {
        (row["category_level"], row["revenue_rank"]): (row["category"], row["revenue"])
        for row in rows
    }
    # The unknown product is left out, ties go by name, a missing name is a category.
    assert got == {
        ("department", 1): ("A", 20.0),
        ("department", 2): ("B", 20.0),
        ("department", 3): (None, 15.0),
        ("commodity", 1): ("x", 25.0),
        ("commodity", 2): ("y", 20.0),
        ("commodity", 3): ("z", 15.0),
    }
    # The share is of all categories, not only of the ranked ones.
    shares = {row["category"]: row["revenue_share"] for row in rows}
    assert shares["A"] == pytest.approx(20 / 60)


def test_top3(shop):
    shares = business.category_share(*shop, Window(1, 9), 10)
    assert business.top3_department_share(shares).first()[0] == pytest.approx(55 / 60)


def test_totals_and_trend(lines):
    frame = lines([(1, 1, 1, 10), (2, 2, 2, 20), (1, 3, 3, 30), (1, 3, 3, 30)])
    row = business.business_totals(frame, Window(1, 3)).first()
    assert (row["total_revenue"], row["total_baskets"], row["active_households"]) == (90.0, 3, 2)
    assert row["avg_weekly_revenue"] == 30.0 and row["avg_basket_value"] == 30.0
    weekly = business.weekly_kpi(frame, Window(1, 3))
    trend = business.trend_change(weekly, 1).first()
    assert trend["revenue_change"] == pytest.approx(5)
    assert trend["basket_value_change"] == pytest.approx(5)
    # Two-week ends overlap in week 2.
    assert business.trend_change(weekly, 2).first()["revenue_change"] == pytest.approx(40 / 15 - 1)


def test_basket_table_stands_for_the_lines(lines):
    frame = lines([(1, 1, 1, 5), (1, 1, 1, 2), (1, 2, 2, 3), (2, 3, 2, 4), (None, 4, 2, 1)])
    short = business.baskets(frame)
    assert short.count() == 4
    window = Window(1, 2)
    for build in (business.weekly_kpi, business.business_totals):
        left, right = (sorted(map(tuple, build(f, window).collect())) for f in (frame, short))
        assert left == right
    ready = business.weekly_kpi(short, window)
    assert business.business_totals(short, window, ready).first() == business.business_totals(
        frame, window
    ).first()
