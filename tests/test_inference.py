"""Clustered least squares against explicit dummies in numpy."""

from __future__ import annotations

import numpy as np
import pytest

from basketry.functions import tails
from basketry.operators import inference

K = 2
SCHEMA = (
    "event_id STRING, product_id INT, promo_week INT, treated BOOLEAN, "
    "history ARRAY<STRUCT<rel_week INT, units DOUBLE, revenue DOUBLE, display_share DOUBLE>>"
)


@pytest.fixture(scope="module")
def members():
    """Five events of six to nine products; products return in later events."""
    rng = np.random.default_rng(3)
    rows = []
    for event in range(5):
        for product in rng.choice(12, size=6 + event % 4, replace=False):
            history = [
                (week, float(rng.integers(1, 30)), float(rng.uniform(1, 99)), float(rng.uniform()))
                for week in range(-K, 1)
            ]
            rows.append((f"S|{event}", int(product), event, bool(rng.random() < 0.4), history))
    return rows


@pytest.fixture(scope="module")
def events(spark, members):
    return spark.createDataFrame(members, SCHEMA)


def dummies(members, regressors, outcome):
    """Coefficients, clustered covariance, N and G with all fixed effects as columns."""
    units = sorted({(row[0], row[1]) for row in members})
    weeks = sorted({(row[0], week) for row in members for week in range(-K, 1)})
    y, x, cluster = [], [], []
    for event, product, _, treated, history in members:
        for step in history:
            week, cells = step[0], dict(zip(("units", "revenue", "display"), step[1:]))
            fixed = np.zeros(len(units) + len(weeks))
            fixed[units.index((event, product))] = 1
            fixed[len(units) + weeks.index((event, week))] = 1
            x.append([*regressors(treated, week, cells), *fixed])
            y.append(np.log1p(cells[outcome]))
            cluster.append(product)
    x, y, cluster = np.array(x, dtype=float), np.array(y), np.array(cluster)
    k = len(regressors(True, 0, {"units": 0, "revenue": 0, "display": 0}))
    fixed = x[:, k:]
    clean = x[:, :k] - fixed @ np.linalg.lstsq(fixed, x[:, :k], rcond=None)[0]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    residual = y - x @ beta
    bread = np.linalg.inv(clean.T @ clean)
    names = np.unique(cluster)
    scores = np.array([clean[cluster == c].T @ residual[cluster == c] for c in names])
    g, n = len(names), len(y)
    scale = g / (g - 1) * (n - 1) / (n - k)
    return beta[:k], scale * bread @ (scores.T @ scores) @ bread, n, g


def test_one_regressor(members, events):
    beta, v, n, g = dummies(members, lambda d, week, _: [d and week == 0], "units")
    row = inference.estimate_did(events, "units", 0.9, K).first()
    assert row["coefficient"] == pytest.approx(beta[0], abs=1e-10)
    assert row["std_error"] == pytest.approx(np.sqrt(v[0, 0]), abs=1e-10)
    assert (row["observations"], row["clusters"]) == (n, g)
    width = tails.t_quantile(0.9, g - 1) * np.sqrt(v[0, 0])
    assert row["ci_high"] - row["coefficient"] == pytest.approx(width)
    assert row["p_value"] == pytest.approx(
        tails.t_two_sided(beta[0] / np.sqrt(v[0, 0]), g - 1), abs=1e-9
    )


def test_covariate(members, events):
    beta, v, _, _ = dummies(
        members, lambda d, week, cells: [d and week == 0, cells["display"]], "revenue"
    )
    row = inference.estimate_did(events, "revenue", 0.95, K, ("display_share",)).first()
    assert row["coefficient"] == pytest.approx(beta[0], abs=1e-10)
    assert row["std_error"] == pytest.approx(np.sqrt(v[0, 0]), abs=1e-10)


def test_event_study(members, events):
    beta, v, _, g = dummies(members, lambda d, week, _: [d and week == -2, d and week == 0], "units")
    rows = {
        row["rel_week"]: row
        for row in inference.estimate_event_study(events, "units", 0.95, K).collect()
    }
    for position, week in enumerate((-2, 0)):
        assert rows[week]["coefficient"] == pytest.approx(beta[position], abs=1e-10)
        assert rows[week]["std_error"] == pytest.approx(np.sqrt(v[position, position]), abs=1e-10)
    f = beta[0] ** 2 / v[0, 0]
    assert rows[0]["pretrend_f"] == pytest.approx(f)
    assert rows[0]["pretrend_p_value"] == pytest.approx(tails.f_tail(f, 1, g - 1))


def test_models_share_one_pass(events):
    models = {
        "units": inference.did_model("units"),
        "display": inference.did_model("units", ("display_share",)),
        "study": inference.study_model("units", K),
    }
    fits = inference.fit_events(events, models, K)
    single = inference.estimate_did(events, "units", 0.95, K).first()
    assert fits["units"].coefficient(0) == pytest.approx(single["coefficient"], abs=1e-12)
    assert set(fits) == set(models)


def test_collinear_covariate(spark, members):
    """A constant covariate vanishes under the fixed effects; the estimate stays the same."""
    flat = [
        (*row[:4], [(step[0], step[1], step[2], 0.5) for step in row[4]]) for row in members
    ]
    frame = spark.createDataFrame(flat, SCHEMA)
    with_it = inference.estimate_did(frame, "units", 0.95, K, ("display_share",)).first()
    without = inference.estimate_did(frame, "units", 0.95, K).first()
    assert with_it["coefficient"] == pytest.approx(without["coefficient"], abs=1e-8)


def test_outcomes_without_a_logarithm_raise(spark, members):
    broken = [list(row) for row in members]
    for place, units in ((0, -1.0), (3, -2.0)):
        history = [list(step) for step in broken[place][4]]
        history[K][1] = units
        broken[place][4] = [tuple(step) for step in history]
    frame = spark.createDataFrame([tuple(row) for row in broken], SCHEMA)
    models = {"units": inference.did_model("units")}
    with pytest.raises(ValueError, match="2 event members have an outcome of -1 or less"):
        inference.fit_events(frame, models, K)
    # Revenue is sound, so models of it go on.
    inference.fit_events(frame, {"revenue": inference.did_model("revenue")}, K)
