from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.operators import churn, group_tests
from basketry.params import DEMOGRAPHIC_COLUMNS, ChurnParams, Window
from tests.helpers import as_dict

WINDOW = Window(1, 8)
PARAMS = ChurnParams(loyal_top_share=0.5, recent_weeks=4, top_departments=2)


def visits(household, weeks, sales):
    return [(household, household * 100 + week, week, sales) for week in weeks]


@pytest.fixture(scope="module")
def bought(lines):
    """1 and 2 spend most in weeks 1-4; 1 leaves, 2 stays, 3 spends little, 4 comes late."""
    return lines(
        visits(1, [1, 2, 3, 4, 5], 50)
        + visits(2, [1, 2, 3, 4, 5, 6, 7, 8], 40)
        + visits(3, [1, 8], 5)
        + visits(4, [6, 7], 90)
        + visits(5, [2], 1)
    )


@pytest.fixture(scope="module")
def groups(bought):
    return churn.household_groups(bought, WINDOW, PARAMS)


def test_activity(bought):
    rows = as_dict(churn.household_activity(bought, WINDOW, PARAMS), "household_key")
    one, late = rows[1], rows[4]
    assert (one["first_half_revenue"], one["revenue"], one["recent_revenue"]) == (200, 250, 50)
    assert (one["baskets"], one["baseline_baskets"], one["recent_baskets"]) == (5, 4.0, 1)
    assert (late["first_half_revenue"], late["baseline_revenue"]) == (None, 0.0)
    assert late["baseline_baskets"] == 0.0


def test_baseline_is_scaled_to_one_block(lines):
    frame = lines(visits(1, [1, 2, 3, 4, 5, 6], 1))
    row = churn.household_activity(frame, WINDOW, ChurnParams(recent_weeks=2)).first()
    assert (row["baseline_baskets"], row["recent_baskets"]) == (2.0, 0)


def test_a_basket_in_both_periods_counts_in_both(lines):
    frame = lines([(1, 7, 4, 1), (1, 7, 5, 1)])
    row = churn.household_activity(frame, WINDOW, PARAMS).first()
    assert (row["baskets"], row["baseline_baskets"], row["recent_baskets"]) == (1, 1.0, 1)


def test_groups(groups):
    got = as_dict(groups, "household_key", "household_group")
    # 4 first-half buyers: the top half is two households; 4 has no first half.
    assert got == {
        1: "churning_loyal",
        2: "stable_loyal",
        3: "other",
        4: "other",
        5: "other",
    }


def test_loyalty_tie_across_the_limit(lines):
    frame = lines(visits(1, [1], 9) + visits(2, [1], 5) + visits(3, [1], 5) + visits(4, [1], 1))
    flags = churn.loyalty_flags(churn.household_activity(frame, WINDOW, PARAMS), PARAMS)
    assert as_dict(flags, "household_key", "is_loyal") == {1: True, 2: False, 3: False, 4: False}


def test_summary_and_headline(groups):
    summary = churn.group_summary(groups)
    rows = as_dict(summary, "household_group")
    assert rows["other"]["households"] == 3
    assert sum(row["recent_revenue_share"] for row in rows.values()) == pytest.approx(1)
    assert rows["churning_loyal"]["avg_basket_value"] == 50.0
    head = churn.churn_headline(summary).first()
    assert (head["churning_households"], head["loyal_households"]) == (1, 2)
    assert head["churning_basket_drop"] == pytest.approx(0.75)


def test_rows_keep_households_without_departments(spark, groups, bought):
    products = spark.createDataFrame([(1, "A")], "product_id INT, department STRING")
    people = spark.createDataFrame(
        [(1, *"abcdefg")],
        "household_key INT, " + ", ".join(f"{name} STRING" for name in DEMOGRAPHIC_COLUMNS),
    )
    departments = churn.household_department(bought, products, WINDOW, PARAMS)
    rows = as_dict(
        churn.churn_rows(churn.churn_households(groups, people), departments), "household_key"
    )
    assert (rows[1]["classification_1"], rows[1]["department_revenue"]) == ("a", 200.0)
    assert (rows[4]["classification_1"], rows[4]["department"]) == (None, None)


def brute_rank_sum(first, second):
    """U of the first sample and the tie term, straight from the pairs."""
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    pooled = [*first, *second]
    ties = sum(pooled.count(value) ** 3 - pooled.count(value) for value in set(pooled))
    return u, float(ties)


def test_rank_sums_per_test(spark):
    samples = {
        "p": ([3, 3, 5, 9], [3, 4, 4, 1, 0]),
        "q": ([1, 2], [3, 4, 5]),
        "r": ([7, 7], [7]),
    }
    rows = []
    for name, (first, second) in samples.items():
        for flag, values in ((True, first), (False, second)):
            rows.extend((name, float(value), len(rows) + i, flag) for i, value in enumerate(values))
    frame = spark.createDataFrame(rows, "test STRING, value DOUBLE, id INT, flag BOOLEAN")
    got = as_dict(
        group_tests.add_rank_sum_p_values(
            group_tests.rank_sums(frame, "test", "value", "id", F.col("flag"))
        ),
        "test",
    )
    for name, (first, second) in samples.items():
        u, ties = brute_rank_sum(first, second)
        assert (got[name]["u"], got[name]["tie_term"]) == (u, ties)
        assert (got[name]["n1"], got[name]["n2"]) == (len(first), len(second))
    assert got["q"]["method"] == "exact" and got["q"]["p_value"] == pytest.approx(0.2)
    assert got["p"]["method"] == "asymptotic"
    assert got["r"]["p_value"] is None


def test_department_mix(spark):
    loyal = [(key, "churning_loyal" if key <= 3 else "stable_loyal") for key in range(1, 8)]
    households = spark.createDataFrame(
        [*loyal, (8, "other")], "household_key INT, household_group STRING"
    )
    bought = [
        (1, "A", 30.0), (1, "B", 10.0), (2, "A", 10.0), (3, "B", 5.0), (3, "C", 5.0),
        (4, "A", 10.0), (4, "B", 30.0), (5, "B", 20.0), (6, "C", 1.0), (6, None, 99.0),
        (8, "A", 999.0),
    ]
    departments = spark.createDataFrame(
        bought, "household_key INT, department STRING, department_revenue DOUBLE"
    )
    mix = churn.department_mix(households, departments, 2)
    rows = as_dict(churn.department_mix_tests(mix, 2, 0.05), "department")
    # Revenue of the loyal: B 65, A 50, C 6. Household 7 bought nothing and drops out, the
    # unnamed department does not count.
    assert set(rows) == {"A", "B"}
    a = rows["A"]
    assert (a["n1"], a["n2"]) == (3, 3)
    assert a["churning_share"] == pytest.approx((0.75 + 1 + 0) / 3)
    assert a["stable_share"] == pytest.approx((0.25 + 0 + 0) / 3)
    assert a["difference_pp"] == pytest.approx(50)
    u, ties = brute_rank_sum([0.75, 1, 0], [0.25, 0, 0])
    assert (a["u"], a["tie_term"]) == (u, ties)
    head = churn.department_mix_headline(churn.department_mix_tests(mix, 2, 0.05)).first()
    assert tuple(head) == (0, None, None)
    lenient = churn.department_mix_tests(mix, 2, 1.99)
    assert churn.department_mix_headline(lenient).first()["department"] == "A"


def test_mix_without_loyal_households(spark):
    households = spark.createDataFrame([(1, "other")], "household_key INT, household_group STRING")
    departments = spark.createDataFrame(
        [(1, "A", 1.0)], "household_key INT, department STRING, department_revenue DOUBLE"
    )
    assert churn.department_mix(households, departments, 3).collect() == []


def counts_frame(spark, tables):
    rows = [
        (attribute, level, group, count)
        for attribute, levels in tables.items()
        for level, pair in levels.items()
        for group, count in zip((churn.CHURNING, churn.STABLE), pair, strict=True)
        if count
    ]
    return spark.createDataFrame(
        rows, "attribute STRING, level STRING, household_group STRING, households BIGINT"
    )


def test_chi_square(spark):
    tables = {
        "two": {"a": (10, 20), "b": (30, 25)},
        "three": {"a": (10, 20), "b": (30, 25), "c": (0, 15)},
        "one": {"a": (4, 6)},
    }
    tests = group_tests.chi_square(
        counts_frame(spark, tables), "household_group", churn.CHURNING, churn.STABLE
    )
    rows = as_dict(group_tests.add_chi_square_p_values(tests), "attribute")

    def by_hand(levels, correction):
        first = sum(a for a, _ in levels.values())
        second = sum(b for _, b in levels.values())
        total = first + second
        cells = [
            (observed, (a + b) * column / total)
            for a, b in levels.values()
            for observed, column in ((a, first), (b, second))
        ]
        statistic = sum(max(abs(o - e) - correction, 0) ** 2 / e for o, e in cells)
        return statistic, min(e for _, e in cells)

    for name, correction in (("two", 0.5), ("three", 0.0)):
        statistic, smallest = by_hand(tables[name], correction)
        assert rows[name]["statistic"] == pytest.approx(statistic)
        assert rows[name]["min_expected_count"] == pytest.approx(smallest)
        assert rows[name]["dof"] == len(tables[name]) - 1
    # Published: the uncorrected statistic of this 2 x 2 table is 2.94, the corrected 2.27.
    assert rows["two"]["statistic"] < by_hand(tables["two"], 0.0)[0]
    assert (rows["one"]["dof"], rows["one"]["p_value"]) == (0, 1.0)


def test_demographics_need_the_first_attribute(spark):
    columns = "household_key INT, household_group STRING, " + ", ".join(
        f"{name} STRING" for name in DEMOGRAPHIC_COLUMNS
    )
    rows = [
        (1, churn.CHURNING, *"abcdefg"),
        (2, churn.STABLE, "a", *[None] * 5, "k"),
        (3, churn.STABLE, None, *"bcdefg"),
        (4, churn.OTHER, *"abcdefg"),
    ]
    frame = spark.createDataFrame(rows, columns)
    cells = {tuple(row) for row in churn.demographic_crosstab(frame).collect()}
    assert ("classification_1", "a", churn.STABLE, 1) in cells
    assert ("kid_category_desc", "k", churn.STABLE, 1) in cells
    # Seven cells of household 1, two of household 2.
    assert len(cells) == 9
    statistics = churn.demographic_statistics(frame, 5.0)
    tested = as_dict(churn.demographic_tests(statistics, 0.05), "attribute")
    assert not tested["kid_category_desc"]["reliable"]
    assert tested["classification_2"]["statistic"] is None
    assert not tested["classification_2"]["significant"]
