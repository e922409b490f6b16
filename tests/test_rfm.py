from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from basketry.operators import rfm
from basketry.params import SEGMENT_RULES, Window
from tests.helpers import as_dict

WINDOW = Window(3, 20)

#: Household: weeks with a basket and what each of them costs; weeks 2 and 21 are outside.
BASKETS = {
    101: ((20, 18, 15, 9, 2), 30),
    102: ((19,), 400),
    103: ((12, 11), 20),
    104: ((17, 16, 14, 21), 25),
}


@pytest.fixture(scope="module")
def metrics(lines):
    rows = [
        (household, household * 100 + week, week, price)
        for household, (weeks, price) in BASKETS.items()
        for week in weeks
    ]
    return rfm.rfm_metrics(lines(rows), WINDOW)


@pytest.fixture(scope="module")
def scores(metrics):
    return rfm.rfm_scores(metrics, 4)


def test_metrics(scores):
    got = {
        row["household_key"]: (row["recency_weeks"], row["frequency"], row["monetary"])
        for row in scores.collect()
    }
    assert got == {101: (0, 4, 120.0), 102: (1, 1, 400.0), 103: (8, 2, 40.0), 104: (3, 3, 75.0)}
    assert as_dict(scores, "household_key", "avg_basket_value")[104] == 25.0


def test_each_score_ranks_by_its_own_measure(scores):
    got = {
        row["household_key"]: (row["r_score"], row["f_score"], row["m_score"])
        for row in scores.collect()
    }
    assert got == {101: (4, 4, 3), 102: (3, 1, 4), 103: (1, 2, 1), 104: (2, 3, 2)}


@pytest.mark.parametrize(
    "r, f, m, rule",
    [(4, 5, 4, 1), (5, 5, 3, 2), (4, 2, 5, 3), (2, 3, 1, 4), (2, 2, 5, 5), (3, 2, 5, 6)],
)
def test_first_matching_rule(spark, r, f, m, rule):
    frame = spark.createDataFrame([(r, f, m)], "r_score INT, f_score INT, m_score INT")
    segment = rfm.assign_segments(frame, SEGMENT_RULES).first()["segment"]
    assert segment == SEGMENT_RULES[rule - 1].name


def test_unmatched_scores_raise(spark):
    frame = spark.createDataFrame([(3, 3, 0)], "r_score INT, f_score INT, m_score INT")
    with pytest.raises(PySparkException, match="no segment rule matches scores 3/3/0"):
        rfm.assign_segments(frame, SEGMENT_RULES[:1]).collect()


def test_summary_of_segments(scores):
    segmented = rfm.assign_segments(scores, SEGMENT_RULES)
    rows = rfm.segment_summary(segmented, SEGMENT_RULES).orderBy("segment_order").collect()
    names = [rule.name for rule in SEGMENT_RULES]
    # 101 misses the first rule by its revenue; 102, 103 and 104 fall under the last three.
    assert [(row["segment_order"], row["segment"]) for row in rows] == [
        (place, names[place - 1]) for place in (2, 4, 5, 6)
    ]
    assert [row["revenue"] for row in rows] == [120.0, 75.0, 40.0, 400.0]
    assert [row["household_share"] for row in rows] == [0.25] * 4
    assert [row["revenue_share"] for row in rows] == [
        pytest.approx(part / 635) for part in (120, 75, 40, 400)
    ]
    assert [row["avg_basket_value"] for row in rows] == [30.0, 25.0, 20.0, 400.0]
    assert [row["avg_recency_weeks"] for row in rows] == [0.0, 3.0, 8.0, 1.0]


@pytest.mark.parametrize("share, households, revenue", [(0.25, 1, 400), (0.625, 2, 520), (0.01, 1, 400)])
def test_top_customers(metrics, share, households, revenue):
    """2.5 households round to the even 2; a tiny share still takes one."""
    row = rfm.top_customers_share(metrics, share).first()
    assert row["top_households"] == households
    assert row["top_customers_revenue_share"] == pytest.approx(revenue / 635)


def test_headline(metrics):
    row = rfm.rfm_headline(metrics).first()
    assert (row["households"], row["share_bought_in_last_week"]) == (4, 0.25)
