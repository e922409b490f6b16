"""Global ranks against Spark's own single-partition windows."""

from __future__ import annotations

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.operators import ranks

few = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
values = st.lists(st.integers(0, 12), min_size=1, max_size=60)


def table(spark, numbers):
    rows = [(key, float(number)) for key, number in enumerate(numbers)]
    return spark.createDataFrame(rows, "key INT, value DOUBLE").repartition(3)


@few
@given(numbers=values)
def test_cume_dist_equals_window(spark, numbers):
    frame = table(spark, numbers)
    got = ranks.with_cume_dist(frame, "value", "key", "spread")
    over = Window.orderBy(F.desc("value"))
    want = frame.select("value", F.cume_dist().over(over).alias("spread")).distinct()
    assert sorted(got.collect()) == sorted(want.collect())


@few
@given(numbers=values)
def test_rank_is_a_permutation_in_order(spark, numbers):
    got = ranks.global_rank(table(spark, numbers), [F.asc("value"), F.asc("key")])
    rows = sorted(got.collect(), key=lambda row: row["rank"])
    assert [row["rank"] for row in rows] == list(range(1, len(numbers) + 1))
    assert [(row["value"], row["key"]) for row in rows] == sorted(
        (float(number), key) for key, number in enumerate(numbers)
    )
    assert {row["total_rows"] for row in rows} == {len(numbers)}


@few
@given(numbers=values)
def test_group_medians(spark, numbers):
    frame = table(spark, numbers).withColumn("g", F.col("key") % 2)
    numbered = ranks.number(frame, [F.asc("value"), F.asc("key")])
    got = {r["g"]: r["median"] for r in ranks.group_medians(numbered, "g", "value").collect()}
    groups = {}
    for key, number in enumerate(numbers):
        groups.setdefault(key % 2, []).append(float(number))
    assert got == {g: statistics.median(v) for g, v in groups.items()}


def test_many_rows_cross_partitions(spark):
    frame = spark.range(20_000).select(
        F.col("id").alias("key"), (F.xxhash64("id") % 1000).alias("value")
    )
    order = [F.asc("value"), F.asc("key")]
    got = ranks.global_rank(frame, order)
    want = frame.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    assert got.select("key", "rank").exceptAll(want.select("key", "rank")).count() == 0
    assert got.agg(F.max("total_rows")).first()[0] == 20_000


def test_cutoff_excludes_ties_across_the_limit(spark):
    frame = table(spark, [9, 8, 8, 5, 1])
    cutoff = ranks.top_share_cutoff(frame, "value", 0.4)
    assert frame.where(F.col("value") >= cutoff).count() == 1
    none = ranks.top_share_cutoff(table(spark, [3, 3]), "value", 0.5)
    assert frame.where(F.col("value") >= none).count() == 0


@pytest.mark.parametrize("share, expected", [(0.2, 1), (0.4, 1), (0.6, 3), (1.0, 5)])
def test_cutoff_shares(spark, share, expected):
    frame = table(spark, [9, 8, 8, 5, 1])
    cutoff = ranks.top_share_cutoff(frame, "value", share)
    assert frame.where(F.col("value") >= cutoff).count() == expected


def test_medians_of_groups_across_many_ranges(spark):
    frame = spark.range(5_000).select(
        F.col("id").alias("key"),
        (F.xxhash64("id") % 997).alias("value"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"),  # a group without name
    )
    numbered = ranks.number(frame, [F.asc("value"), F.asc("key")])
    got = {r["g"]: r["median"] for r in ranks.group_medians(numbered, "g", "value").collect()}
    want = frame.groupBy("g").agg(F.median("value").alias("m")).collect()
    assert got == {r["g"]: r["m"] for r in want}


def test_cutoff_without_rows(spark):
    frame = table(spark, [1]).where("key < 0")
    assert ranks.top_share_cutoff(frame, "value", 0.5) is not None
    assert spark.range(1).select(ranks.top_share_cutoff(frame, "value", 0.5)).first()[0] is None
