"""Mergeable sets of ids against Spark's own distinct counts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import business, distinct, quality
from basketry.params import Window

ROW = "week INT, near INT, far LONG, amount LONG"
NAMES = {"near": "n_near", "far": "n_far"}


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(4)
    far = [-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, None] + [draw.getrandbits(62) for _ in range(40)]
    rows = [
        (draw.choice([1, 2, 3, None]), draw.choice([None, *range(-70, 130)]), draw.choice(far), i)
        for i in range(900)
    ]
    return spark.createDataFrame(rows, ROW).repartition(3)


def expected(frame, by):
    return frame.groupBy(*by).agg(
        F.count_distinct("near").alias("n_near"), F.count_distinct("far").alias("n_far")
    )


@pytest.mark.parametrize("by", [[], ["week"]])
def test_counts(table, by):
    got = distinct.counts(distinct.id_sets(table, list(NAMES), by), NAMES, by)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected(table, by).collect()))


def test_weeks_merge_into_the_whole(table):
    sets = distinct.id_sets(table, list(NAMES), ["week"])
    got = distinct.counts(distinct.merged(sets), NAMES).collect()
    assert got == expected(table, []).collect()


def test_amounts_are_added_once(table):
    sets = distinct.id_sets(table, list(NAMES), ["week"], {"total": F.col("amount")})
    got = distinct.counts(sets, NAMES, ["week"], F.sum("total").alias("total")).collect()
    want = {r["week"]: r["t"] for r in table.groupBy("week").agg(F.sum("amount").alias("t")).collect()}
    assert {r["week"]: r["total"] for r in got} == want


def test_an_empty_table_counts_zero(table):
    none = table.where("week > 9")
    assert tuple(distinct.counts(distinct.id_sets(none, list(NAMES)), NAMES).first()) == (0, 0)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="name"):
        distinct.id_sets(spark.createDataFrame([("a",)], "name STRING"), ["name"])


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_expand_and_one_scan(spark, lines, tmp_path):
    folder = str(tmp_path / "lines")
    lines([(1, 1, 1, 10), (2, 2, 2, 5)]).write.parquet(folder)
    frame = spark.read.parquet(folder)
    for query in (
        quality.dataset_totals(frame),
        quality.weekly_activity(frame),
        business.weekly_kpi(frame, Window(1, 9)),
    ):
        assert "Expand" not in plan(query)
        assert plan(query).split("Initial Plan")[0].count("FileScan") == 1
        assert "ObjectHashAggregate" not in plan(query) and "SortAggregate" not in plan(query)
    # The totals read the staged sets, not the lines.
    totals = plan(business.business_totals(frame, Window(1, 9)))
    assert folder not in totals and "Expand" not in totals
