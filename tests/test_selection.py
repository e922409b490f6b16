"""Rows at given ranks and NTILE of several orders, against windows over the whole table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators import selection
from basketry.sources.storage import stage

ROW = "key LONG, small INT, real DOUBLE, wide LONG"
ORDERS = {
    "x": [("small", False), ("key", True)],
    "y": [("real", True), ("key", False)],
    "z": [("wide", False), ("small", True), ("real", False), ("key", True)],
}


def rows_with_ties(n, seed=3):
    draw = random.Random(seed)
    reals = [0.0, -0.0, 1.5, -2.25, 1e300, -1e-310, 5e-324, None]
    wides = [-(1 << 63), (1 << 63) - 1, 5, 6, 7, None]
    return [
        (
            i - 50,
            draw.choice([None, 0, 1, 2, 3]),
            draw.choice(reals) if i % 3 else draw.gauss(0, 1),
            draw.choice(wides),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def table(spark):
    return stage(spark.createDataFrame(rows_with_ties(701), ROW), "selection")


def ranked(frame, order):
    by = Window.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order))
    return {r["key"]: r["rank"] for r in frame.select("key", F.row_number().over(by).alias("rank")).collect()}


@pytest.mark.parametrize("bins,few", [(selection.BINS, selection.FEW), (3, 0), (64, 20)])
def test_rows_after_a_rank(spark, table, bins, few):
    ranks = [1, 2, 350, 700, 701, 702]
    chosen = selection.Selection(table, ORDERS, dict.fromkeys(ORDERS, lambda n: ranks), bins, few)
    assert chosen.rows == 701
    got = table.select(
        "key",
        *(chosen.after(o, r).alias(f"after_{o}_{r}") for o in ORDERS for r in ranks),
        *(chosen.from_rank(o, r).alias(f"from_{o}_{r}") for o in ORDERS for r in ranks),
    ).collect()
    for name, order in ORDERS.items():
        want = ranked(table, order)
        for row in got:
            for rank in ranks:
                assert row[f"after_{name}_{rank}"] == (want[row["key"]] > rank)
                assert row[f"from_{name}_{rank}"] == (want[row["key"]] >= rank and rank <= 701)


@pytest.mark.parametrize("n,buckets", [(701, 5), (3, 5), (5, 5), (1, 2), (0, 5), (12, 1)])
def test_ntile(spark, table, n, buckets):
    frame = table.where(F.col("key") < n - 50)
    got = selection.with_ntiles(frame, ORDERS, buckets)
    for name, order in ORDERS.items():
        by = Window.orderBy(*(F.asc(c) if up else F.desc(c) for c, up in order))
        want = frame.select("key", F.ntile(buckets).over(by).alias("n")).collect()
        assert sorted((r["key"], r[name]) for r in got.collect()) == sorted(map(tuple, want))


def test_all_null_and_equal_columns(spark):
    frame = spark.createDataFrame([(i, None, 1.0, None) for i in range(9)], ROW)
    got = selection.with_ntiles(frame, ORDERS, 3)
    assert [(r["x"], r["y"], r["z"]) for r in got.orderBy("key").collect()] == [
        (1, 3, 1), (1, 3, 1), (1, 3, 1), (2, 2, 2), (2, 2, 2), (2, 2, 2), (3, 1, 3), (3, 1, 3), (3, 1, 3),
    ]


def test_scores_shuffle_no_row(spark, table):
    plan = selection.with_ntiles(table, ORDERS, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_columns_without_numbers_are_refused(spark):
    frame = spark.createDataFrame([("a",)], "name STRING")
    with pytest.raises(TypeError, match="name"):
        selection.Selection(frame, {"o": [("name", True)]}, {"o": lambda n: [1]})
