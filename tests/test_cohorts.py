from __future__ import annotations

import pytest

from basketry.operators import cohorts
from tests.helpers import as_dict

END, PERIOD = 11, 3


@pytest.fixture(scope="module")
def activity(lines):
    """Three cohorts of 4, 3 and 1 households; weeks 10 and 11 are no complete period."""
    visits = {
        "first": {"a": (2, 8, 10), "b": (3, 4, 5), "c": (1, 2), "d": (1, 6, 9)},
        "second": {"e": (5, 7), "f": (6, 12), "g": (4, 9)},
        "third": {"h": (7,)},
    }
    rows = [
        (ord(name), 1000 + week, week, 2.5)
        for households in visits.values()
        for name, weeks in households.items()
        for week in weeks
    ]
    return cohorts.cohort_activity(lines(rows), END, PERIOD)


def shares(activity, smallest, last=2):
    frame = cohorts.retention_matrix(activity, smallest, last, PERIOD)
    out = {}
    for row in frame.orderBy("cohort_period", "periods_since_first").collect():
        out.setdefault(row["cohort_period"], []).append(row["retention"])
    return out


@pytest.mark.parametrize("end, length, last", [(11, 3, 2), (12, 3, 3), (53, 4, 12)])
def test_only_whole_periods_count(end, length, last):
    assert cohorts.last_full_period(end, length) == last


def test_shares_of_three_cohorts(activity):
    assert shares(activity, 1) == {
        0: [1.0, 0.5, 0.5],  # b and d return at once, a and d later
        1: [1.0, pytest.approx(2 / 3), None],
        2: [1.0, None, None],
    }


def test_a_period_without_visits_is_zero(lines):
    seen = cohorts.cohort_activity(lines([(7, 1, 2, 1), (7, 2, 8, 1)]), 9, PERIOD)
    assert shares(seen, 1) == {0: [1.0, 0.0, 1.0]}


def test_smallest_cohort_size(activity):
    assert [sorted(shares(activity, size)) for size in (2, 4, 5)] == [[0, 1], [0], []]


def test_visits_after_the_last_whole_period(lines):
    rows = [(7, 1, 1, 1), (7, 2, 10, 1), (8, 3, 10, 1)]
    got = cohorts.cohort_activity(lines(rows), 10, PERIOD).collect()
    assert [tuple(row) for row in got] == [(0, 0, 1)]


def test_averages_weigh_cohorts_by_size(activity):
    average = cohorts.average_retention(cohorts.retention_matrix(activity, 1, 2, PERIOD))
    assert as_dict(average, "periods_since_first", "avg_retention") == {
        0: 1.0,
        1: pytest.approx(4 / 7),
        2: 0.5,
    }
    low, high = cohorts.retention_plateau(average).first()
    assert (low, high) == (0.5, pytest.approx(4 / 7))


def test_headline_and_labels(activity):
    frame = cohorts.retention_matrix(activity, 3, 2, PERIOD)
    assert {row["cohort_label"] for row in frame.collect()} == {"нед. 1-3", "нед. 4-6"}
    row = cohorts.cohort_headline(activity, frame, 3, (1, 9)).first()
    assert row["cohorts_kept"] == 2
    assert (row["households_in_kept_cohorts"], row["households_in_dropped_cohorts"]) == (7, 1)
    assert row["retention_period_1"] == pytest.approx(4 / 7)
    assert row["retention_period_9"] is None


def test_more_periods_than_one_word_holds(lines):
    weeks = {1: (1, 64, 65, 66, 130, 200), 2: (63, 64, 129, 191), 3: (193, 194, 201)}
    rows = [(h, h * 1000 + w, w, 1) for h, seen in weeks.items() for w in seen for _ in range(2)]
    got = cohorts.cohort_activity(lines(rows), 200, 1).collect()
    want = {}
    for seen in weeks.values():
        for week in seen:
            if week <= 200:
                cell = (min(seen) - 1, week - min(seen))
                want[cell] = want.get(cell, 0) + 1
    assert {(r["cohort_period"], r["periods_since_first"]): r["active_households"] for r in got} == want


def test_activity_takes_one_row_per_household(lines):
    frame = cohorts.cohort_activity(lines([(1, 1, 1, 1)]), 300, 1)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 2


def test_weeks_before_the_first_raise(lines):
    with pytest.raises(Exception, match="week_no starts with 1"):
        cohorts.cohort_activity(lines([(1, 1, 0, 1)]), 20, PERIOD).collect()


def test_no_complete_period(lines):
    assert cohorts.cohort_activity(lines([(1, 1, 1, 1)]), 2, PERIOD).collect() == []
