"""Tail probabilities against published quantiles and brute force."""

from __future__ import annotations

import itertools
import math

import pytest

from basketry.functions import tails


def test_normal():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.normal_two_sided(-0.1) == 1.0


@pytest.mark.parametrize(
    "dof, critical", [(1, 3.841458821), (2, 5.991464547), (10, 18.30703805), (30, 43.77297183)]
)
def test_chi_square(dof, critical):
    assert tails.chi2_tail(critical, dof) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_tail(0.0, dof) == 1.0


@pytest.mark.parametrize(
    "dof, critical", [(1, 12.70620474), (5, 2.570581836), (10, 2.228138852), (120, 1.979930405)]
)
def test_student(dof, critical):
    assert tails.t_two_sided(critical, dof) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_quantile(0.95, dof) == pytest.approx(critical, abs=1e-7)


@pytest.mark.parametrize(
    "a, b, critical", [(1, 10, 4.964602744), (3, 20, 3.098391212), (4, 120, 2.447236)]
)
def test_fisher(a, b, critical):
    assert tails.f_tail(critical, a, b) == pytest.approx(0.05, abs=1e-6)
    t = tails.t_quantile(0.95, b)
    assert tails.f_tail(t * t, 1, b) == pytest.approx(0.05, abs=1e-9)


def test_exact_rank_sum_counts_arrangements():
    n1, n2 = 3, 5
    counts = {}
    for picked in itertools.combinations(range(n1 + n2), n1):
        u = sum(picked) - n1 * (n1 - 1) // 2
        counts[u] = counts.get(u, 0) + 1
    total = math.comb(n1 + n2, n1)
    for u in range(n1 * n2 + 1):
        extreme = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(c for value, c in counts.items() if value >= extreme) / total)
        assert tails.rank_sum_exact_two_sided(u, n1, n2) == pytest.approx(want)


def test_rank_sum_method():
    assert tails.rank_sum_p_value(0.0, 3, 3, 0.0)[1:] == (pytest.approx(0.1), "exact")
    assert tails.rank_sum_p_value(0.0, 3, 3, 6.0)[2] == "asymptotic"
    assert tails.rank_sum_p_value(0.0, 9, 9, 0.0)[2] == "asymptotic"
    assert tails.rank_sum_p_value(0.0, 0, 3, 0.0) == (None, None, "empty group")
    # All values tied: no variance, no p-value.
    assert tails.rank_sum_p_value(2.0, 2, 2, 60.0)[1] is None


@pytest.mark.parametrize("small", [1, 2, 5, 8])
def test_exact_rank_sum_of_a_small_group_needs_no_table(small):
    """The closed count equals counting every arrangement, and stays exact for large groups."""
    from itertools import combinations

    for large in (small, small + 3):
        sums = [sum(c) for c in combinations(range(1, small + large + 1), small)]
        low = small * (small + 1) // 2
        for u in range(small * large + 1):
            top = max(u, small * large - u)
            want = min(1.0, 2 * sum(s - low >= top for s in sums) / len(sums))
            assert tails.rank_sum_exact_two_sided(float(u), small, large) == pytest.approx(want)
    # Every value of the small group above 3 million others: one arrangement of all.
    extreme = tails.rank_sum_exact_two_sided(0.0, small, 3_000_000)
    assert extreme == pytest.approx(2 / math.comb(3_000_000 + small, small))


def test_the_method_is_never_changed():
    u, n = 4.0 * 2_000_000, 2_000_000
    z, exact, method = tails.rank_sum_p_value(u * 1.01, 8, n, 0.0)
    assert method == "exact"
    z, near, method = tails.rank_sum_p_value(u * 1.01, 8, n, 0.0, "asymptotic")
    assert method == "asymptotic" and near == pytest.approx(exact, rel=0.01)
    assert tails.rank_sum_p_value(40.0, 9, 12, 0.0)[2] == "asymptotic"
    assert tails.rank_sum_p_value(40.0, 9, 12, 0.0, "exact")[2] == "exact"
    with pytest.raises(ValueError, match="without ties"):
        tails.rank_sum_p_value(1.0, 3, 3, 6.0, "exact")


def test_two_large_groups_are_refused_by_name():
    assert tails.rank_sum_p_value(40_000.0, 250, 400, 0.0, "exact")[2] == "exact"
    with pytest.raises(ValueError, match="method='asymptotic'"):
        tails.rank_sum_p_value(5e9, 100_000, 100_000, 0.0, "exact")
    assert tails.rank_sum_p_value(5e9, 100_000, 100_000, 0.0)[2] == "asymptotic"
