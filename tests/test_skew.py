"""Hot keys: salted look-ups give the same rows as plain joins, and plans keep their promises."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.operators import churn, cohorts, promo, rfm
from basketry.operators.skew import heavy_keys, salted_lookup
from basketry.params import ChurnParams, PromoParams, Window


@pytest.fixture(scope="module")
def hot(spark):
    """9,000 rows; key 0 holds a third of them, some keys have no look-up row."""
    return spark.range(9000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("key"),
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_join(spark, hot, how):
    lookup = spark.range(40).select(
        F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("v")
    )
    got = salted_lookup(hot, lookup, ["key"], ["row_id"], how)
    want = hot.join(lookup, "key", how)
    assert got.columns == want.columns
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_hot_key_is_spread(spark, hot):
    """Without a broadcast the hot key goes to several tasks."""
    lookup = spark.range(50).select(F.col("id").cast("int").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_lookup(hot, lookup, ["key"], ["row_id"]).where("key = 0")
        tasks = joined.select(F.spark_partition_id().alias("task")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert tasks > 1


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("exact", [False, True])
def test_heavy_keys_are_the_only_copies(spark, hot, how, exact):
    """Key 0 holds a third of the rows and takes two of four shares; no other key is copied."""
    counts = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    heavy = heavy_keys(counts, ["key"], "n") if exact else heavy_keys(hot, ["key"])
    zero = spark.range(1).select(F.xxhash64(F.lit(0).cast("int"))).first()[0]
    assert [tuple(row) for row in heavy.collect()] == [(zero, 2)]
    lookup = spark.range(40).select(
        F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("v")
    )
    got = salted_lookup(hot, lookup, ["key"], ["row_id"], how, heavy=heavy)
    want = hot.join(lookup, "key", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_even_keys_are_joined_plainly(spark):
    even = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 50).alias("key"))
    lookup = spark.range(50).select(F.col("id").alias("key"), (-F.col("id")).alias("v"))
    heavy = heavy_keys(even, ["key"])
    assert heavy.isEmpty()
    joined = salted_lookup(even, lookup, ["key"], ["row_id"], heavy=heavy)
    assert "_salt" not in plan_of(joined) and "Generate" not in plan_of(joined)
    assert joined.where("v = -key").count() == 1000


def test_no_rows_no_heavy_keys(spark, hot):
    nothing = hot.limit(0)
    assert heavy_keys(nothing, ["key"]).isEmpty()
    counts = nothing.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert heavy_keys(counts, ["key"], "n").isEmpty()


def test_heavy_null_key_and_types(spark):
    """Null keys match nothing but stay in a left join; keys of two types are refused."""
    rows = spark.range(900).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 9).alias("key")
    )
    lookup = spark.range(9).select(F.col("id").alias("key"), F.col("id").alias("v"))
    heavy = heavy_keys(rows, ["key"])
    assert heavy.count() == 1
    left = salted_lookup(rows, lookup, ["key"], ["row_id"], "left", heavy=heavy)
    assert left.count() == 900 and left.where("v IS NULL").count() == 300
    assert salted_lookup(rows, lookup, ["key"], ["row_id"], heavy=heavy).count() == 600
    other = lookup.withColumn("key", F.col("key").cast("int"))
    with pytest.raises(TypeError, match="key"):
        salted_lookup(rows, other, ["key"], ["row_id"], heavy=heavy)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many_lines(spark):
    """60,000 lines; one household has a third of them, one product too."""
    return spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).cast("int").alias(
            "household_key"
        ),
        (F.col("id") % 9000).alias("basket_id"),
        (F.col("id") % 84 + 1).cast("int").alias("day"),
        F.when(F.col("id") % 3 == 1, 0).otherwise(F.col("id") % 31).cast("int").alias("product_id"),
        F.lit(1).alias("quantity"),
        (F.col("id") % 13 + 0.5).alias("sales_value"),
        (F.col("id") % 7).cast("int").alias("store_id"),
        (F.expr("(id % 84) div 7") + 1).cast("int").alias("week_no"),
    )


def test_no_single_partition_sort_of_households(many_lines):
    scores = rfm.rfm_scores(rfm.rfm_metrics(many_lines, Window(1, 12)), 5)
    assert scores.count() == 97
    text = plan_of(scores)
    # The unpartitioned windows see one row per range partition, never the households.
    for part in text.split("SinglePartition")[1:]:
        assert "_part" in part[:400]


def test_no_cross_join_and_no_python(many_lines):
    window, params = Window(1, 12), ChurnParams()
    frames = [
        cohorts.cohort_activity(many_lines, 12, 4),
        churn.household_activity(many_lines, window, params),
        rfm.rfm_metrics(many_lines, window),
    ]
    for frame in frames:
        text = plan_of(frame)
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
            assert word not in text


def test_flags_take_one_shuffle_and_no_spine(spark, many_lines):
    shelf = many_lines.groupBy("product_id", "week_no").agg(
        F.lit("D").alias("department"),
        F.lit("K").alias("commodity_desc"),
        F.lit("S").alias("sub_commodity_desc"),
        F.sum("quantity").alias("units"),
        F.sum("sales_value").alias("revenue"),
        F.lit(0.0).alias("mailer_store_share"),
        F.lit(0.0).alias("display_store_share"),
    )
    from basketry.sources.storage import stage

    flags = promo.promo_flags(stage(shelf, "shelf"), PromoParams(), Window(1, 12))
    text = plan_of(flags)
    assert text.count("Exchange hashpartitioning(product_id") == 1 and "Window" not in text


def test_hot_household_results(many_lines):
    metrics = {r["household_key"]: r for r in rfm.rfm_metrics(many_lines, Window(1, 12)).collect()}
    want = (
        many_lines.where("household_key = 0")
        .agg(F.countDistinct("basket_id"), F.sum("sales_value"))
        .first()
    )
    assert (metrics[0]["frequency"], metrics[0]["monetary"]) == tuple(want)
