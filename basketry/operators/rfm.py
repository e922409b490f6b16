"""RFM scores, segments and revenue concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.functions.columns import money_sum, ratio
from basketry.operators.business import in_window
from basketry.operators.selection import Selection, with_ntiles
from basketry.params import SegmentRule, Window
from basketry.sources.storage import stage


def rfm_metrics(transactions: DataFrame, window: Window) -> DataFrame:
    """Recency, frequency and revenue of every household active in the window."""
    return (
        transactions.where(in_window(window))
        .groupBy("household_key")
        .agg(
            (F.lit(window.end_week) - F.max("week_no")).alias("recency_weeks"),
            F.max("day").alias("last_purchase_day"),
            F.count_distinct("basket_id").alias("frequency"),
            money_sum("sales_value").alias("monetary"),
        )
    )


#: The order of each score, whose best households come last; the household key ends every tie.
SCORE_ORDERS = {
    "r_score": [("recency_weeks", False), ("last_purchase_day", True), ("household_key", True)],
    "f_score": [("frequency", True), ("household_key", True)],
    "m_score": [("monetary", True), ("household_key", True)],
}


def rfm_scores(metrics: DataFrame, buckets: int) -> DataFrame:
    """Scores 1..buckets, best last; ties go by last purchase day and household key.

    The households at the bucket ends of all three orders are found together; every other
    household is compared with them where it is.
    """
    scored = with_ntiles(stage(metrics, "rfm-metrics"), SCORE_ORDERS, buckets)
    return scored.select(
        "household_key",
        "recency_weeks",
        "frequency",
        "monetary",
        ratio("monetary", "frequency").alias("avg_basket_value"),
        *SCORE_ORDERS,
    )


def segment_name(rules: Sequence[SegmentRule]) -> Column:
    """CASE over the rules in order; scores that match none raise an error."""
    scores = [F.col(name) for name in ("r_score", "f_score", "m_score")]
    message = F.concat(
        F.lit("no segment rule matches scores "),
        F.concat_ws("/", *(score.cast("string") for score in scores)),
    )
    chain = F
    for rule in rules:
        matches = (
            scores[0].between(*rule.recency)
            & scores[1].between(*rule.frequency)
            & scores[2].between(*rule.monetary)
        )
        chain = chain.when(matches, F.lit(rule.name))
    return chain.otherwise(F.raise_error(message).cast("string"))


def assign_segments(scores: DataFrame, rules: Sequence[SegmentRule]) -> DataFrame:
    return scores.withColumn("segment", segment_name(rules))


def segment_summary(segmented: DataFrame, rules: Sequence[SegmentRule]) -> DataFrame:
    """Size, activity and revenue share of every non-empty segment, with its rule number."""
    order = F.array_position(
        F.array(*(F.lit(rule.name) for rule in rules)), F.col("segment")
    ).cast("int")
    per_segment = segmented.groupBy("segment").agg(
        F.count("household_key").alias("households"),
        F.sum("frequency").alias("baskets"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("recency_weeks").alias("avg_recency_weeks"),
        money_sum("monetary").alias("revenue"),
    )
    # At most one row per rule.
    total = W.partitionBy()
    return per_segment.select(
        order.alias("segment_order"),
        "segment",
        "households",
        ratio("households", F.sum("households").over(total)).alias("household_share"),
        ratio("revenue", "baskets").alias("avg_basket_value"),
        "avg_frequency",
        "avg_recency_weeks",
        "revenue",
        ratio("revenue", F.sum("revenue").over(total)).alias("revenue_share"),
    )


def top_customers_share(metrics: DataFrame, top_share: float) -> DataFrame:
    """Revenue share of the top households; their number is rounded half to even, at least 1."""
    rows = stage(metrics.select("household_key", "monetary"), "revenue")
    order = {"revenue": [("monetary", False), ("household_key", True)]}

    def wanted(total: int) -> int:
        return max(1, round(total * float(top_share)))

    chosen = Selection(rows, order, {"revenue": lambda total: [wanted(total)]})
    top = ~chosen.after("revenue", wanted(chosen.rows))
    return rows.agg(
        F.count(F.lit(1)).alias("households"),
        F.count_if(top).alias("top_households"),
        ratio(money_sum(F.when(top, F.col("monetary"))), money_sum("monetary")).alias(
            "top_customers_revenue_share"
        ),
    )


def rfm_headline(metrics: DataFrame) -> DataFrame:
    """Households scored and the share that bought in the last week."""
    return metrics.agg(
        F.count(F.lit(1)).alias("households"),
        F.avg((F.col("recency_weeks") == 0).cast("double")).alias("share_bought_in_last_week"),
    )
