"""Stacked difference-in-differences with cluster-robust errors.

Event-specific product and week effects are removed by two-way demeaning, exact because every
event member has all weeks. A member is one row with a value per week, so its own mean needs no
shuffle. Spark reduces the members to sums of products per product (the cluster) and those to one
row; only that row is solved on the driver. Several models over the same events share all passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import tails
from basketry.operators.skew import heavy_keys, salted_lookup
from basketry.sources.storage import stage

# A series is one SQL expression per week, oldest first.
Series = Mapping[str, Sequence[str]]


def demean_members(members: DataFrame, series: Series) -> DataFrame:
    """Two-way demeaned ``series`` as columns ``<name>_<position>``, one row per member.

    ``members`` has one row per event and product. The week means of an event are a partial
    aggregate, which counts the members too, and come back by a salted join, so an event that
    holds a third of the members is spread over tasks.
    """
    names = {name: [f"{name}_{t}" for t in range(len(series[name]))] for name in series}
    flat = members.selectExpr(
        "event_id",
        "product_id",
        *(
            f"CAST({expression} AS DOUBLE) AS {column}"
            for name in series
            for column, expression in zip(names[name], series[name], strict=True)
        ),
    )
    counted = stage(
        flat.groupBy("event_id").agg(
            F.count(F.lit(1)).alias("_rows"),
            *(
                F.expr(f"avg({column}) AS _m_{column}")
                for group in names.values()
                for column in group
            ),
        ),
        "event-means",
    )
    heavy = heavy_keys(counted, ["event_id"], "_rows")
    means = counted.drop("_rows")
    joined = salted_lookup(flat, means, ["event_id"], ["product_id"], heavy=heavy)

    def demeaned(columns: list[str]) -> list[str]:
        own = f"({' + '.join(columns)}) / {len(columns)}"
        event = f"({' + '.join(f'_m_{column}' for column in columns)}) / {len(columns)}"
        return [f"{column} - {own} - _m_{column} + {event} AS {column}" for column in columns]

    return joined.selectExpr(
        "event_id",
        "product_id",
        *(expression for group in names.values() for expression in demeaned(group)),
    )


def two_way_demean(panel: DataFrame, columns: Sequence[str], pre_weeks: int) -> DataFrame:
    """Demean columns of a long balanced panel (event, product, relative week)."""
    weeks = range(-pre_weeks, 1)
    series = {name: [f"{name}_{t}" for t in range(pre_weeks + 1)] for name in columns}
    members = panel.groupBy("event_id", "product_id").agg(
        *(
            F.expr(f"max(CASE WHEN rel_week = {week} THEN {name} END) AS {series[name][t]}")
            for name in columns
            for t, week in enumerate(weeks)
        )
    )
    cells = ", ".join(
        f"named_struct('rel_week', {week}, "
        + ", ".join(f"'{name}', {series[name][t]}" for name in columns)
        + ")"
        for t, week in enumerate(weeks)
    )
    wide = demean_members(members, series)
    return wide.selectExpr("event_id", "product_id", f"inline(array({cells}))")


@dataclass(frozen=True)
class Model:
    """A regression of one series on others."""

    outcome: str
    regressors: tuple[str, ...]


@dataclass(frozen=True)
class ClusterFit:
    """Least squares on demeaned data with errors clustered by product."""

    coefficients: np.ndarray
    covariance: np.ndarray
    observations: int
    clusters: int

    @property
    def dof(self) -> int:
        return self.clusters - 1

    def coefficient(self, position: int) -> float:
        return float(self.coefficients[position])

    def standard_error(self, position: int) -> float:
        return math.sqrt(max(float(self.covariance[position, position]), 0.0))

    def p_value(self, position: int) -> float | None:
        error = self.standard_error(position)
        if error == 0.0 or self.dof < 1:
            return None
        return tails.t_two_sided(self.coefficient(position) / error, self.dof)

    def interval(self, position: int, level: float) -> tuple[float | None, float | None]:
        if self.dof < 1:
            return None, None
        width = tails.t_quantile(level, self.dof) * self.standard_error(position)
        return self.coefficient(position) - width, self.coefficient(position) + width

    def joint_test(self, positions: Sequence[int]) -> tuple[float | None, float | None]:
        """F statistic and p-value of all the given coefficients being zero."""
        index = list(positions)
        if not index or self.dof < 1:
            return None, None
        beta = self.coefficients[index]
        inner = np.linalg.pinv(self.covariance[np.ix_(index, index)])
        f = float(beta @ inner @ beta) / len(index)
        return f, tails.f_tail(f, len(index), self.dof)


def _pair(left: str, right: str) -> tuple[str, str]:
    return (left, right) if left <= right else (right, left)


def _cell(left: str, right: str) -> str:
    return "p_" + "_x_".join(_pair(left, right))


def fit_models(
    members: DataFrame, series: Series, models: Mapping[str, Model]
) -> dict[str, ClusterFit]:
    """Fit every model from one staged table of sums of products per cluster."""
    weeks = len(next(iter(series.values())))
    wide = demean_members(members, series)
    pairs = sorted(
        {
            _pair(left, right)
            for model in models.values()
            for left in model.regressors
            for right in (*model.regressors, model.outcome)
        }
    )
    sums = [
        F.expr(
            "sum(" + " + ".join(f"{a}_{t} * {b}_{t}" for t in range(weeks)) + f") AS {_cell(a, b)}"
        )
        for a, b in pairs
    ]
    outcomes = sorted({model.outcome for model in models.values()})
    # A member without a logarithm in some week would drop out of the sums but not of the counts.
    unusable = " OR ".join(
        f"{name}_{t} IS NULL OR isnan({name}_{t})" for name in outcomes for t in range(weeks)
    )
    clusters = stage(
        wide.groupBy("product_id").agg(
            F.count(F.lit(1)).alias("members"),
            F.count_if(F.expr(unusable)).alias("unusable"),
            *sums,
        ),
        "cluster-sums",
    )
    totals = clusters.agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("members").alias("members"),
        F.sum("unusable").alias("unusable"),
        *(F.sum(_cell(a, b)).alias(_cell(a, b)) for a, b in pairs),
    ).first()
    if totals["clusters"] == 0:
        raise ValueError("no events")
    if totals["unusable"]:
        raise ValueError(
            f"{totals['unusable']} event members have an outcome of -1 or less in some week, "
            "which has no logarithm; leave their events out or correct the quantities"
        )

    inverses: dict[str, np.ndarray] = {}
    betas: dict[str, np.ndarray] = {}
    outer: list[str] = []
    for name, model in models.items():
        x, y = model.regressors, model.outcome
        inverses[name] = np.linalg.pinv(
            np.array([[totals[_cell(left, right)] for right in x] for left in x])
        )
        betas[name] = inverses[name] @ np.array([totals[_cell(left, y)] for left in x])
        scores = [
            f"({_cell(left, y)} - "
            + " - ".join(
                f"{_cell(left, right)} * ({float(beta)!r}D)"
                for right, beta in zip(x, betas[name], strict=True)
            )
            + ")"
            for left in x
        ]
        outer.extend(
            f"sum({scores[i]} * {scores[j]}) AS {name}_{i}_{j}"
            for i in range(len(x))
            for j in range(i, len(x))
        )
    meats = clusters.agg(*map(F.expr, outer)).first()

    g, n = int(totals["clusters"]), int(totals["members"]) * weeks
    fits = {}
    for name, model in models.items():
        k = len(model.regressors)
        meat = np.array([[meats[f"{name}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        correction = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else math.nan
        covariance = correction * inverses[name] @ meat @ inverses[name]
        fits[name] = ClusterFit(betas[name], covariance, n, g)
    return fits


def _relative_weeks(pre_weeks: int) -> list[int]:
    """Weeks with a coefficient: all but the reference week -1."""
    return [week for week in range(-pre_weeks, 1) if week != -1]


def _dummy_name(week: int) -> str:
    return f"treated_{'pre' if week < 0 else 'week'}{abs(week)}"


def event_series(pre_weeks: int, names: Sequence[str]) -> dict[str, list[str]]:
    """Series of event members by name.

    ``log_units`` and ``log_revenue`` are log(1 + outcome), ``display_share`` is the covariate,
    ``treated_*`` marks treated members in one relative week.
    """
    span = range(pre_weeks + 1)
    known = {
        "log_units": [f"log1p(history[{t}].units)" for t in span],
        "log_revenue": [f"log1p(history[{t}].revenue)" for t in span],
        "display_share": [f"history[{t}].display_share" for t in span],
    }
    for week in _relative_weeks(pre_weeks):
        known[_dummy_name(week)] = [
            "IF(treated, 1D, 0D)" if t - pre_weeks == week else "0D" for t in span
        ]
    return {name: known[name] for name in names}


def did_model(outcome: str, controls: Sequence[str] = ()) -> Model:
    """Effect in the promo week on log(1 + outcome), given time-varying covariates."""
    return Model(f"log_{outcome}", (_dummy_name(0), *controls))


def study_model(outcome: str, pre_weeks: int) -> Model:
    """One coefficient per relative week; week -1 is the reference."""
    return Model(
        f"log_{outcome}", tuple(_dummy_name(week) for week in _relative_weeks(pre_weeks))
    )


def fit_events(
    events: DataFrame, models: Mapping[str, Model], pre_weeks: int
) -> dict[str, ClusterFit]:
    used = {
        name for model in models.values() for name in (model.outcome, *model.regressors)
    }
    return fit_models(events, event_series(pre_weeks, sorted(used)), models)


def did_units(events: DataFrame) -> DataFrame:
    """Events, treated and control members, and products of an event table."""
    return events.agg(
        F.count_distinct("event_id").alias("events"),
        F.count_if(F.col("treated")).alias("treated_units"),
        F.count_if(~F.col("treated")).alias("control_units"),
        F.count_distinct("product_id").alias("clusters"),
    )


DID_SCHEMA = (
    "estimate string, outcome string, coefficient double, std_error double, ci_low double, "
    "ci_high double, p_value double, effect_pct double, effect_pct_ci_low double, "
    "effect_pct_ci_high double, observations bigint, events bigint, treated_units bigint, "
    "control_units bigint, clusters bigint"
)


def did_rows(
    events: DataFrame,
    fits: Mapping[str, ClusterFit],
    models: Mapping[str, Model],
    level: float,
) -> DataFrame:
    """One row per DiD fit: the treated coefficient, its interval and the effect in percent."""
    size = did_units(events).first()

    def percent(value: float | None) -> float | None:
        return None if value is None else 100.0 * math.expm1(value)

    rows = []
    for name, fit in fits.items():
        low, high = fit.interval(0, level)
        rows.append(
            (
                name,
                models[name].outcome.removeprefix("log_"),
                fit.coefficient(0),
                fit.standard_error(0),
                low,
                high,
                fit.p_value(0),
                percent(fit.coefficient(0)),
                percent(low),
                percent(high),
                fit.observations,
                size["events"],
                size["treated_units"],
                size["control_units"],
                fit.clusters,
            )
        )
    return events.sparkSession.createDataFrame(rows, DID_SCHEMA)


def estimate_did(
    events: DataFrame,
    outcome: str,
    confidence_level: float,
    pre_weeks: int,
    controls: Sequence[str] = (),
) -> DataFrame:
    """Effect of treatment in the promo week on log(1 + outcome), one row."""
    models = {outcome: did_model(outcome, controls)}
    return did_rows(events, fit_events(events, models, pre_weeks), models, confidence_level)


STUDY_SCHEMA = (
    "rel_week int, coefficient double, std_error double, ci_low double, ci_high double, "
    "p_value double, pretrend_f double, pretrend_p_value double"
)


def study_rows(events: DataFrame, fit: ClusterFit, pre_weeks: int, level: float) -> DataFrame:
    """Coefficients by relative week, each row with the joint test of the weeks before -1."""
    weeks = _relative_weeks(pre_weeks)
    joint = fit.joint_test([t for t, week in enumerate(weeks) if week < -1])
    rows = [(-1, 0.0, 0.0, 0.0, 0.0, None, *joint)]
    rows.extend(
        (
            week,
            fit.coefficient(t),
            fit.standard_error(t),
            *fit.interval(t, level),
            fit.p_value(t),
            *joint,
        )
        for t, week in enumerate(weeks)
    )
    return events.sparkSession.createDataFrame(sorted(rows), STUDY_SCHEMA)


def estimate_event_study(
    events: DataFrame, outcome: str, confidence_level: float, pre_weeks: int
) -> DataFrame:
    """Treated-control gap by relative week; week -1 is the reference with coefficient 0."""
    models = {"study": study_model(outcome, pre_weeks)}
    fit = fit_events(events, models, pre_weeks)["study"]
    return study_rows(events, fit, pre_weeks, confidence_level)


def largest_pre_gap(study: DataFrame) -> DataFrame:
    """Largest treated-control gap before the reference week, in percent."""
    gap = F.max(F.when(F.col("rel_week") < -1, F.abs("coefficient")))
    return study.agg((100 * F.expm1(gap)).alias("max_pre_gap_pct"))
