"""Checking SQL for DuckDB, one statement per query, over the driver's tables.

Each statement recomputes a result from the given tables in plain SQL: unpartitioned windows,
cross joins and dense grids where they are the shortest way to say it. Tail probabilities are
integrated numerically.
"""

from __future__ import annotations

import re

from basketry.params import DEMOGRAPHIC_COLUMNS, KEY_COLUMNS, SEGMENT_RULES
from checks.catalog import LAST_PERIOD, PARAMS, WINDOW

START, END, MID = WINDOW.start_week, WINDOW.end_week, WINDOW.mid_week
RECENT = PARAMS.churn.recent_weeks
LIMIT = END - RECENT
K = PARAMS.promo.pre_weeks
PERIOD = PARAMS.cohorts.period_weeks

# --- numeric tails as SQL expressions -----------------------------------------------------------


def simpson(density: str, upper: str, steps: int = 2000) -> str:
    """Integral of ``density`` (an expression in ``u``) from 0 to ``upper``."""
    point = density.replace("{u}", f"(i * ({upper}) / {steps}.0)")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    values = f"list_transform(range(0, {steps + 1}), lambda i: {weight} * {point})"
    return f"(({upper}) / {steps}.0 / 3.0 * list_sum({values}))"


def normal_p(z: str) -> str:
    upper = f"least(greatest({z}, 0.0), 10.0)"
    return f"least(1.0, 1.0 - sqrt(2.0 / pi()) * {simpson('exp(-power({u}, 2) / 2.0)', upper)})"


def chi2_p(x: str, dof: str) -> str:
    body = f"exp(-power({{u}}, 2) / 2.0) * power({{u}}, {dof} - 1)"
    area = simpson(body, f"least(sqrt({x}), 30.0)")
    return f"(1.0 - 2.0 * exp(-lgamma({dof} / 2.0) - {dof} / 2.0 * ln(2.0)) * {area})"


def t_p(t: str, dof: str) -> str:
    body = f"power(1.0 + power({{u}}, 2) / {dof}, -({dof} + 1.0) / 2.0)"
    scale = f"exp(lgamma(({dof} + 1.0) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi())"
    return f"greatest(0.0, 1.0 - 2.0 * {scale} * {simpson(body, f'least(abs({t}), 40.0)')})"


def f_p(f: str, a: str, b: str) -> str:
    body = (
        f"2.0 * power({{u}}, {a} - 1.0) * "
        f"power(1.0 + {a} / {b} * power({{u}}, 2), -({a} + {b}) / 2.0)"
    )
    scale = (
        f"exp(lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0)) "
        f"* power({a} / {b}, {a} / 2.0)"
    )
    return f"greatest(0.0, 1.0 - {scale} * {simpson(body, f'least(sqrt({f}), 30.0)')})"


def t_width(dof: str) -> str:
    """97.5 % quantile of Student's t: expanded around the normal one, then one Newton step."""
    z = 1.959963984540054
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    powers = " + ".join(f"{term!r} / power({dof}, {n})" for n, term in enumerate(terms, 1))
    start = f"({z!r} + {powers})"
    density = (
        f"exp(lgamma(({dof} + 1.0) / 2.0) - lgamma({dof} / 2.0)) / sqrt({dof} * pi()) "
        f"* power(1.0 + power({start}, 2) / {dof}, -({dof} + 1.0) / 2.0)"
    )
    return f"({start} + ({t_p(start, dof)} - 0.05) / (2.0 * {density}))"


# --- shared relations ---------------------------------------------------------------------------

RELATIONS: dict[str, str] = {}

RELATIONS["lines"] = """
    SELECT o.o_custkey AS household_key, l.l_orderkey AS basket_id,
           CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) + 1 AS INTEGER)
               AS day,
           l.l_partkey AS product_id, CAST(l.l_quantity AS INTEGER) AS quantity,
           CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
                * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS sales_value,
           s.s_nationkey AS store_id,
           CAST(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE)) // 7 + 1
                AS INTEGER) AS week_no
    FROM lineitem l
    JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey"""

RELATIONS["goods"] = """
    SELECT p_partkey AS product_id, p_type AS department, p_brand AS commodity_desc,
           split_part(p_name, ' ', 2) AS sub_commodity_desc
    FROM part"""

RELATIONS["people"] = """
    SELECT c_custkey AS household_key,
           CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS classification_1,
           n_name AS classification_2, r_name AS classification_3,
           CASE WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS classification_4,
           CAST(c_custkey % 4 AS VARCHAR) AS classification_5,
           CASE WHEN c_custkey % 2 = 0 THEN 'owner' ELSE 'renter' END AS homeowner_desc,
           CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 7 AS VARCHAR) END
               AS kid_category_desc
    FROM customer
    JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey"""

RELATIONS["dirty_lines"] = """
    SELECT CASE WHEN basket_id % 1009 <> 0 THEN household_key END AS household_key,
           basket_id, day, product_id,
           CASE WHEN basket_id % 97 = 0 THEN 0 WHEN basket_id % 83 = 0 THEN -quantity
                ELSE quantity END AS quantity,
           CASE WHEN basket_id % 89 = 0 THEN 0 ELSE sales_value END AS sales_value,
           store_id, week_no
    FROM (SELECT * FROM lines
          UNION ALL SELECT * FROM lines WHERE basket_id % 101 = 0)"""

RELATIONS["dirty_goods"] = """
    SELECT product_id, CASE WHEN product_id % 53 = 0 THEN '  ' ELSE department END AS department,
           CASE WHEN product_id % 7 = 0 THEN '  ' || commodity_desc || ' '
                ELSE commodity_desc END AS commodity_desc,
           sub_commodity_desc
    FROM goods WHERE product_id % 211 <> 0
    UNION ALL
    SELECT product_id + 1000000000, NULL, NULL, NULL FROM goods WHERE product_id % 400 = 0"""

RELATIONS["unique_lines"] = "SELECT DISTINCT * FROM dirty_lines"
RELATIONS["good_lines"] = "SELECT * FROM unique_lines WHERE quantity <> 0 AND sales_value > 0"
RELATIONS["good_goods"] = """
    SELECT product_id, nullif(trim(department), '') AS department,
           nullif(trim(commodity_desc), '') AS commodity_desc,
           nullif(trim(sub_commodity_desc), '') AS sub_commodity_desc
    FROM dirty_goods"""

RELATIONS["window_lines"] = f"SELECT * FROM lines WHERE week_no BETWEEN {START} AND {END}"

RELATIONS["kpi"] = """
    SELECT week_no, CAST(sum(sales_value) AS DOUBLE) AS revenue,
           count(DISTINCT basket_id) AS baskets,
           count(DISTINCT household_key) AS active_households
    FROM window_lines GROUP BY week_no"""

RELATIONS["activity_by_week"] = """
    SELECT week_no, count(DISTINCT household_key) AS active_households,
           count(DISTINCT day) AS days
    FROM lines GROUP BY week_no"""

RELATIONS["chosen_window"] = f"""
    SELECT coalesce(max(week_no) FILTER (WHERE active_households < limit_value) + 1,
                    min(week_no)) AS start_week,
           max(end_week) AS end_week, max(limit_value) AS active_households_threshold
    FROM activity_by_week,
         (SELECT max(week_no) FILTER (WHERE days >= {PARAMS.quality.full_week_days}) AS end_week,
                 {PARAMS.quality.stable_activity_ratio} * median(active_households)
                     AS limit_value
          FROM activity_by_week)
    WHERE week_no <= end_week"""

RELATIONS["named_lines"] = """
    SELECT l.*, g.department, g.commodity_desc FROM window_lines l JOIN goods g USING (product_id)"""

RELATIONS["categories"] = """
    SELECT *, revenue / sum(revenue) OVER (PARTITION BY category_level) AS revenue_share,
           row_number() OVER (PARTITION BY category_level
                              ORDER BY revenue DESC, category) AS revenue_rank
    FROM (SELECT 'department' AS category_level, department AS category,
                 CAST(sum(sales_value) AS DOUBLE) AS revenue FROM named_lines GROUP BY 2
          UNION ALL
          SELECT 'commodity', commodity_desc, CAST(sum(sales_value) AS DOUBLE)
          FROM named_lines GROUP BY 2)"""

RELATIONS["totals"] = """
    SELECT CAST(sum(sales_value) AS DOUBLE) AS total_revenue,
           count(DISTINCT basket_id) AS total_baskets,
           count(DISTINCT household_key) AS active_households,
           (SELECT avg(revenue) FROM kpi) AS avg_weekly_revenue,
           (SELECT avg(baskets) FROM kpi) AS avg_weekly_baskets,
           (SELECT avg(active_households) FROM kpi) AS avg_weekly_active_households,
           CAST(sum(sales_value) AS DOUBLE) / count(DISTINCT basket_id) AS avg_basket_value
    FROM window_lines"""

_N = PARAMS.business.trend_weeks


def _change(name: str) -> str:
    return (
        f"avg({name}) FILTER (WHERE back <= {_N}) / avg({name}) FILTER (WHERE ahead <= {_N}) - 1"
    )


RELATIONS["trend"] = f"""
    SELECT *, (1 + revenue_change) / (1 + baskets_change) - 1 AS basket_value_change
    FROM (SELECT {_change("revenue")} AS revenue_change, {_change("baskets")} AS baskets_change,
                 {_change("active_households")} AS active_households_change
          FROM (SELECT *, row_number() OVER (ORDER BY week_no) AS ahead,
                       row_number() OVER (ORDER BY week_no DESC) AS back FROM kpi))"""

RELATIONS["rfm_base"] = f"""
    SELECT household_key, {END} - max(week_no) AS recency_weeks, max(day) AS last_day,
           count(DISTINCT basket_id) AS frequency, sum(sales_value) AS monetary
    FROM window_lines GROUP BY household_key"""

_B = PARAMS.rfm.score_buckets
RELATIONS["rfm_scored"] = f"""
    SELECT household_key, recency_weeks, frequency, CAST(monetary AS DOUBLE) AS monetary,
           CAST(monetary AS DOUBLE) / frequency AS avg_basket_value,
           CAST(ntile({_B}) OVER (ORDER BY recency_weeks DESC, last_day, household_key)
                AS INTEGER) AS r_score,
           CAST(ntile({_B}) OVER (ORDER BY frequency, household_key) AS INTEGER) AS f_score,
           CAST(ntile({_B}) OVER (ORDER BY monetary, household_key) AS INTEGER) AS m_score,
           monetary AS exact_money
    FROM rfm_base"""

_CASES = " ".join(
    f"WHEN r_score BETWEEN {rule.recency[0]} AND {rule.recency[1]} "
    f"AND f_score BETWEEN {rule.frequency[0]} AND {rule.frequency[1]} "
    f"AND m_score BETWEEN {rule.monetary[0]} AND {rule.monetary[1]} THEN {number}"
    for number, rule in enumerate(SEGMENT_RULES, 1)
)
_NAMES = "[" + ", ".join(f"'{rule.name}'" for rule in SEGMENT_RULES) + "]"
RELATIONS["rfm_labelled"] = f"""
    SELECT *, {_NAMES}[segment_order] AS segment
    FROM (SELECT *, CASE {_CASES} END AS segment_order FROM rfm_scored)"""

RELATIONS["segments"] = """
    SELECT CAST(segment_order AS INTEGER) AS segment_order, segment, count(*) AS households,
           count(*) / sum(count(*)) OVER () AS household_share,
           CAST(sum(exact_money) AS DOUBLE) / sum(frequency) AS avg_basket_value,
           avg(frequency) AS avg_frequency, avg(recency_weeks) AS avg_recency_weeks,
           CAST(sum(exact_money) AS DOUBLE) AS revenue,
           CAST(sum(exact_money) AS DOUBLE) / CAST(sum(sum(exact_money)) OVER () AS DOUBLE)
               AS revenue_share
    FROM rfm_labelled GROUP BY segment_order, segment"""

RELATIONS["top_customers"] = f"""
    SELECT count(*) AS households, count(*) FILTER (WHERE place <= wanted) AS top_households,
           CAST(sum(monetary) FILTER (WHERE place <= wanted) AS DOUBLE)
               / CAST(sum(monetary) AS DOUBLE) AS top_customers_revenue_share
    FROM (SELECT monetary, row_number() OVER (ORDER BY monetary DESC, household_key) AS place,
                 greatest(1, round_even(count(*) OVER () * {PARAMS.rfm.top_customers_share}, 0))
                     AS wanted
          FROM rfm_base)"""

RELATIONS["rfm_facts"] = """
    SELECT count(*) AS households,
           avg(CASE WHEN recency_weeks = 0 THEN 1.0 ELSE 0.0 END) AS share_bought_in_last_week
    FROM rfm_base"""

RELATIONS["cohort_cells"] = f"""
    SELECT cohort_period, activity_period - cohort_period AS periods_since_first,
           count(DISTINCT household_key) AS active_households
    FROM (SELECT household_key,
                 CAST((min(week_no) OVER (PARTITION BY household_key) - 1) // {PERIOD}
                      AS INTEGER) AS cohort_period,
                 CAST((week_no - 1) // {PERIOD} AS INTEGER) AS activity_period
          FROM lines WHERE week_no <= {END})
    WHERE activity_period < {END} // {PERIOD}
    GROUP BY ALL"""

RELATIONS["cohort_size"] = """
    SELECT cohort_period, active_households AS households
    FROM cohort_cells WHERE periods_since_first = 0"""

_MIN_COHORT = PARAMS.cohorts.min_cohort_size
RELATIONS["matrix"] = f"""
    SELECT s.cohort_period,
           'нед. ' || (s.cohort_period * {PERIOD} + 1) || '-' || ((s.cohort_period + 1) * {PERIOD})
               AS cohort_label,
           CAST(o.step AS INTEGER) AS periods_since_first, s.households,
           CASE WHEN s.cohort_period + o.step <= {LAST_PERIOD}
                THEN coalesce(c.active_households, 0) END AS active_households,
           CASE WHEN s.cohort_period + o.step <= {LAST_PERIOD}
                THEN coalesce(c.active_households, 0) / s.households END AS retention
    FROM (SELECT * FROM cohort_size WHERE households >= {_MIN_COHORT}) s
    CROSS JOIN (SELECT unnest(range(0, {LAST_PERIOD} - (SELECT min(cohort_period)
                FROM cohort_size WHERE households >= {_MIN_COHORT}) + 1)) AS step) o
    LEFT JOIN cohort_cells c
      ON c.cohort_period = s.cohort_period AND c.periods_since_first = o.step"""

RELATIONS["mean_retention"] = """
    SELECT periods_since_first,
           sum(active_households) / sum(households) FILTER (WHERE retention IS NOT NULL)
               AS avg_retention
    FROM matrix GROUP BY periods_since_first"""

RELATIONS["plateau"] = """
    SELECT min(avg_retention) AS retention_plateau_min, max(avg_retention) AS retention_plateau_max
    FROM mean_retention WHERE periods_since_first > 0"""

_AT = ", ".join(
    f"(SELECT avg_retention FROM mean_retention WHERE periods_since_first = {period}) "
    f"AS retention_period_{period}"
    for period in PARAMS.cohorts.report_periods
)
RELATIONS["cohort_facts"] = f"""
    SELECT count(*) FILTER (WHERE households >= {_MIN_COHORT}) AS cohorts_kept,
           CAST(coalesce(sum(households) FILTER (WHERE households >= {_MIN_COHORT}), 0) AS BIGINT)
               AS households_in_kept_cohorts,
           CAST(coalesce(sum(households) FILTER (WHERE households < {_MIN_COHORT}), 0) AS BIGINT)
               AS households_in_dropped_cohorts, {_AT}
    FROM cohort_size"""

RELATIONS["household_facts"] = f"""
    SELECT household_key,
           sum(sales_value) FILTER (WHERE week_no <= {MID}) AS first_half_revenue,
           sum(sales_value) AS revenue,
           coalesce(sum(sales_value) FILTER (WHERE week_no <= {LIMIT}), 0) AS baseline_revenue,
           coalesce(sum(sales_value) FILTER (WHERE week_no > {LIMIT}), 0) AS recent_revenue,
           count(DISTINCT basket_id) AS baskets,
           count(DISTINCT basket_id) FILTER (WHERE week_no <= {LIMIT}) * {RECENT}
               / ({LIMIT} - {START} + 1) AS baseline_baskets,
           count(DISTINCT basket_id) FILTER (WHERE week_no > {LIMIT}) AS recent_baskets
    FROM window_lines GROUP BY household_key"""

RELATIONS["buyers"] = f"""
    SELECT household_key, first_half_revenue,
           cume_dist() OVER (ORDER BY first_half_revenue DESC) AS spread,
           cume_dist() OVER (ORDER BY first_half_revenue DESC)
               <= CAST({PARAMS.churn.loyal_top_share} AS DOUBLE) AS is_loyal
    FROM household_facts WHERE first_half_revenue IS NOT NULL"""

RELATIONS["grouped"] = f"""
    SELECT f.household_key,
           CASE WHEN b.is_loyal AND f.recent_baskets
                     < CAST({1 - PARAMS.churn.activity_drop} AS DOUBLE) * f.baseline_baskets
                THEN 'churning_loyal'
                WHEN b.is_loyal THEN 'stable_loyal' ELSE 'other' END AS household_group,
           coalesce(f.first_half_revenue, 0) AS first_half_revenue, f.revenue, f.baseline_revenue,
           f.recent_revenue, f.baskets, f.baseline_baskets, f.recent_baskets,
           CAST(f.revenue AS DOUBLE) / f.baskets AS avg_basket_value
    FROM household_facts f LEFT JOIN buyers b USING (household_key)"""

RELATIONS["homes"] = f"""
    SELECT g.*, {", ".join(f"p.{name}" for name in DEMOGRAPHIC_COLUMNS)}
    FROM grouped g LEFT JOIN people p USING (household_key)"""

RELATIONS["home_departments"] = f"""
    SELECT l.household_key, g.department, sum(l.sales_value) AS department_revenue
    FROM lines l JOIN goods g USING (product_id)
    WHERE l.week_no BETWEEN {START} AND {LIMIT}
    GROUP BY l.household_key, g.department"""

RELATIONS["group_rows"] = """
    SELECT household_group, count(*) AS households,
           CAST(sum(revenue) AS DOUBLE) AS revenue,
           CAST(sum(baseline_revenue) AS DOUBLE) AS baseline_revenue,
           CAST(sum(recent_revenue) AS DOUBLE) AS recent_revenue,
           avg(baseline_baskets) AS baseline_baskets, avg(recent_baskets) AS recent_baskets,
           count(*) / sum(count(*)) OVER () AS household_share,
           CAST(sum(revenue) AS DOUBLE) / CAST(sum(sum(revenue)) OVER () AS DOUBLE)
               AS revenue_share,
           CAST(sum(baseline_revenue) AS DOUBLE)
               / CAST(sum(sum(baseline_revenue)) OVER () AS DOUBLE) AS baseline_revenue_share,
           CAST(sum(recent_revenue) AS DOUBLE)
               / CAST(sum(sum(recent_revenue)) OVER () AS DOUBLE) AS recent_revenue_share,
           CAST(sum(revenue) AS DOUBLE) / sum(baskets) AS avg_basket_value
    FROM grouped GROUP BY household_group"""

RELATIONS["churn_facts"] = """
    SELECT max(households) FILTER (WHERE household_group = 'churning_loyal')
               AS churning_households,
           CAST(sum(households) FILTER (WHERE household_group <> 'other') AS BIGINT)
               AS loyal_households,
           max(baseline_revenue_share) FILTER (WHERE household_group = 'churning_loyal')
               AS churning_baseline_revenue_share,
           max(recent_revenue_share) FILTER (WHERE household_group = 'churning_loyal')
               AS churning_recent_revenue_share,
           max(revenue_share) FILTER (WHERE household_group = 'churning_loyal')
               AS churning_window_revenue_share,
           1 - max(recent_baskets) FILTER (WHERE household_group = 'churning_loyal')
               / max(baseline_baskets) FILTER (WHERE household_group = 'churning_loyal')
               AS churning_basket_drop
    FROM group_rows"""


def rank_test(source: str, test: str, value: str) -> str:
    """Rank sums of the churning group against the stable group, one row per ``test``."""
    return f"""
    SELECT {test}, n1, n2, u, tie_term,
           (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5)
               / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1
                      - tie_term / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z
    FROM (SELECT {test}, max(n1) AS n1, max(n2) AS n2,
                 sum(middle) FILTER (WHERE churning) - max(n1) * (max(n1) + 1) / 2.0 AS u,
                 sum(CAST(ties AS DOUBLE) * ties - 1.0) AS tie_term
          FROM (SELECT {test}, household_group = 'churning_loyal' AS churning,
                       rank() OVER w + (count(*) OVER v - 1) / 2.0 AS middle,
                       count(*) OVER v AS ties,
                       count(*) FILTER (WHERE household_group = 'churning_loyal') OVER t AS n1,
                       count(*) FILTER (WHERE household_group = 'stable_loyal') OVER t AS n2
                FROM {source} WHERE household_group <> 'other'
                WINDOW w AS (PARTITION BY {test} ORDER BY {value}),
                       v AS (PARTITION BY {test}, {value}),
                       t AS (PARTITION BY {test}))
          GROUP BY {test})"""


RELATIONS["value_rows"] = "SELECT 'avg_basket_value' AS test, * FROM grouped"
RELATIONS["value_sums"] = rank_test("value_rows", "test", "avg_basket_value")

RELATIONS["loyal_departments"] = """
    SELECT d.*, g.household_group FROM home_departments d JOIN grouped g USING (household_key)
    WHERE g.household_group <> 'other' AND d.department IS NOT NULL"""

RELATIONS["top_departments"] = f"""
    SELECT department FROM loyal_departments GROUP BY department
    ORDER BY sum(department_revenue) DESC, department LIMIT {PARAMS.churn.top_departments}"""

RELATIONS["share_rows"] = """
    SELECT h.household_key, h.household_group, t.department,
           coalesce(CAST(d.department_revenue AS DOUBLE), 0.0) / CAST(h.total AS DOUBLE) AS share
    FROM (SELECT household_key, household_group, sum(department_revenue) AS total
          FROM loyal_departments GROUP BY ALL) h
    CROSS JOIN top_departments t
    LEFT JOIN loyal_departments d
      ON d.household_key = h.household_key AND d.department = t.department"""

RELATIONS["share_sums"] = rank_test("share_rows", "department", "share")

RELATIONS["mix"] = f"""
    SELECT m.*, s.n1, s.n2, s.u, s.tie_term, s.z, {normal_p("s.z")} AS p_value,
           'asymptotic' AS method
    FROM (SELECT department,
                 avg(share) FILTER (WHERE household_group = 'churning_loyal') AS churning_share,
                 avg(share) FILTER (WHERE household_group = 'stable_loyal') AS stable_share,
                 100 * (avg(share) FILTER (WHERE household_group = 'churning_loyal')
                        - avg(share) FILTER (WHERE household_group = 'stable_loyal'))
                     AS difference_pp
          FROM share_rows GROUP BY department) m JOIN share_sums s USING (department)"""

_LEVEL = PARAMS.churn.alpha / PARAMS.churn.top_departments
RELATIONS["mix_flagged"] = f"SELECT *, p_value < {_LEVEL!r} AS significant FROM mix"

RELATIONS["demographic_cells"] = " UNION ALL ".join(
    f"""
    SELECT '{name}' AS attribute, {name} AS level, household_group, count(*) AS households
    FROM homes
    WHERE household_group <> 'other' AND classification_1 IS NOT NULL AND {name} IS NOT NULL
    GROUP BY {name}, household_group"""
    for name in DEMOGRAPHIC_COLUMNS
)

RELATIONS["demographic_grid"] = """
    SELECT a.attribute, a.level, g.household_group, coalesce(c.households, 0) AS observed,
           sum(observed) OVER (PARTITION BY a.attribute, a.level)
               * sum(observed) OVER (PARTITION BY a.attribute, g.household_group)
               / sum(observed) OVER (PARTITION BY a.attribute) AS expected
    FROM (SELECT DISTINCT attribute, level FROM demographic_cells) a
    CROSS JOIN (SELECT unnest(['churning_loyal', 'stable_loyal']) AS household_group) g
    LEFT JOIN demographic_cells c
      ON c.attribute = a.attribute AND c.level = a.level
     AND c.household_group = g.household_group"""

RELATIONS["demographic_sums"] = """
    SELECT attribute,
           CAST(sum(observed) FILTER (WHERE household_group = 'churning_loyal') AS BIGINT)
               AS churning_with_demographics,
           CAST(sum(observed) FILTER (WHERE household_group = 'stable_loyal') AS BIGINT)
               AS stable_with_demographics,
           CASE WHEN count(DISTINCT level) = 2
                THEN sum(power(greatest(abs(observed - expected) - 0.5, 0), 2) / expected)
                ELSE sum(power(observed - expected, 2) / expected) END AS statistic,
           CAST(count(DISTINCT level) - 1 AS INTEGER) AS dof,
           min(expected) AS min_expected_count
    FROM demographic_grid GROUP BY attribute"""

_MIN_EXPECTED = PARAMS.churn.min_expected_count
RELATIONS["demographic_results"] = f"""
    SELECT *, min_expected_count >= {_MIN_EXPECTED} AS reliable,
           {chi2_p("statistic", "dof")} AS p_value
    FROM demographic_sums"""

# --- promotions ---------------------------------------------------------------------------------

RELATIONS["shelf"] = """
    SELECT DISTINCT CAST('0x' || substr(md5(p_name), 1, 6) AS INTEGER) AS product_id,
           split_part(p_name, ' ', 1) AS department,
           CASE WHEN split_part(p_name, ' ', 2) IN ('bolt', 'ring', 'rod', 'plate')
                THEN 'STOCK' ELSE 'MACHINE' END AS commodity_desc,
           split_part(p_name, ' ', 2) AS sub_commodity_desc
    FROM part"""

RELATIONS["placements"] = f"""
    SELECT product_id, store_id, week_no,
           in_mailer AND store_id IS NOT NULL AS mailer,
           (in_mailer AND store_id % 2 = 0) OR (product_id * 3 + week_no + store_id) % 7 = 0
               AS display
    FROM (SELECT s.product_id, n.store_id, CAST(w.week_no AS INTEGER) AS week_no,
                 (s.product_id * 5 + w.week_no) % 23 = 0 AND s.product_id % 2 = 0
                 AND s.sub_commodity_desc IN ('gear', 'bolt', 'widget', 'rod')
                 AND (n.store_id + s.product_id) % 4 <> 0 AS in_mailer
          FROM shelf s
          CROSS JOIN (SELECT DISTINCT s_nationkey AS store_id FROM supplier) n
          CROSS JOIN (SELECT unnest(range(1, {END + 1})) AS week_no) w)"""

RELATIONS["shelf_lines"] = """
    SELECT l.* REPLACE (CAST('0x' || substr(md5(p_name), 1, 6) AS INTEGER) AS product_id)
    FROM lines l JOIN part p ON p.p_partkey = l.product_id"""

RELATIONS["shelf_weeks"] = """
    SELECT coalesce(s.product_id, p.product_id) AS product_id,
           coalesce(s.week_no, p.week_no) AS week_no,
           h.department, h.commodity_desc, h.sub_commodity_desc,
           CAST(coalesce(s.units, 0) AS BIGINT) AS units,
           coalesce(CAST(s.revenue AS DOUBLE), 0.0) AS revenue,
           coalesce(p.mailers, 0) / c.stores AS mailer_store_share,
           coalesce(p.displays, 0) / c.stores AS display_store_share
    FROM (SELECT product_id, week_no, sum(quantity) AS units, sum(sales_value) AS revenue
          FROM shelf_lines GROUP BY ALL) s
    FULL JOIN (SELECT product_id, week_no,
                      count(DISTINCT store_id) FILTER (WHERE mailer) AS mailers,
                      count(DISTINCT store_id) FILTER (WHERE display) AS displays
               FROM placements GROUP BY ALL) p
      ON p.product_id = s.product_id AND p.week_no = s.week_no
    LEFT JOIN (SELECT week_no, count(DISTINCT store_id) AS stores
               FROM placements GROUP BY week_no) c
      ON c.week_no = coalesce(s.week_no, p.week_no)
    LEFT JOIN shelf h ON h.product_id = coalesce(s.product_id, p.product_id)"""

_EXCLUDED = ", ".join(f"'{name}'" for name in PARAMS.promo.excluded_departments)
RELATIONS["shelf_kept"] = f"""
    SELECT * FROM shelf_weeks WHERE department IS NOT NULL AND department NOT IN ({_EXCLUDED})"""

RELATIONS["shelf_calendar"] = """
    SELECT CAST(w AS INTEGER) AS week_no,
           EXISTS (SELECT 1 FROM shelf_kept k
                   WHERE k.week_no = w AND k.mailer_store_share IS NOT NULL) AS covered
    FROM (SELECT unnest(range(min(week_no), max(week_no) + 1)) AS w FROM shelf_kept)"""

RELATIONS["spine"] = """
    SELECT p.product_id, c.week_no, p.department, p.commodity_desc, p.sub_commodity_desc,
           coalesce(k.units, 0) AS units, coalesce(k.revenue, 0.0) AS revenue,
           CASE WHEN c.covered THEN coalesce(k.mailer_store_share, 0.0) END AS mailer_share,
           CASE WHEN c.covered THEN coalesce(k.display_store_share, 0.0) END AS display_share
    FROM (SELECT DISTINCT product_id, department, commodity_desc, sub_commodity_desc
          FROM shelf_kept) p
    CROSS JOIN shelf_calendar c
    LEFT JOIN shelf_kept k ON k.product_id = p.product_id AND k.week_no = c.week_no"""

RELATIONS["eligible_weeks"] = f"""
    SELECT a.week_no AS promo_week
    FROM shelf_calendar a JOIN shelf_calendar b ON b.week_no BETWEEN a.week_no - {K} AND a.week_no
    WHERE a.week_no BETWEEN {START + K} AND {END}
    GROUP BY a.week_no HAVING count(*) FILTER (WHERE b.covered) = {K + 1}"""

RELATIONS["marks"] = f"""
    SELECT product_id, promo_week, commodity_desc, sub_commodity_desc, has_sales, pre_mailer,
           promoted, promoted AND NOT pre_mailer AND has_sales AS treated,
           NOT pre_mailer AND mailer_share = 0 AND has_sales AS clean,
           pre_mailer OR mailer_share > 0 AS window_mailer
    FROM (SELECT product_id, week_no AS promo_week, commodity_desc, sub_commodity_desc,
                 mailer_share,
                 count(*) FILTER (WHERE units > 0) OVER before
                     >= {PARAMS.promo.min_pre_weeks_with_sales} AS has_sales,
                 coalesce(max(mailer_share) OVER before > 0, false) AS pre_mailer,
                 mailer_share >= {PARAMS.promo.treated_min_store_share} AS promoted
          FROM spine
          WINDOW before AS (PARTITION BY product_id ORDER BY week_no
                            RANGE BETWEEN {K} PRECEDING AND 1 PRECEDING))
    WHERE promo_week IN (SELECT promo_week FROM eligible_weeks)"""

RELATIONS["promo_members"] = """
    SELECT sub_commodity_desc || '|' || promo_week AS event_id, product_id, promo_week, treated
    FROM marks m
    WHERE (treated OR clean)
      AND (sub_commodity_desc, promo_week) IN
          (SELECT (sub_commodity_desc, promo_week) FROM marks GROUP BY ALL
           HAVING bool_or(treated) AND bool_or(clean))""".replace(
    "(SELECT (sub_commodity_desc, promo_week) FROM marks GROUP BY ALL\n",
    "(SELECT (sub_commodity_desc, promo_week) FROM marks\n"
    "           GROUP BY sub_commodity_desc, promo_week\n",
)

RELATIONS["sibling_sides"] = """
    SELECT m.*, s.fresh AS exposed
    FROM marks m
    JOIN (SELECT sub_commodity_desc, promo_week,
                 bool_or(promoted) AND NOT bool_or(pre_mailer) AS fresh,
                 NOT bool_or(window_mailer) AS quiet
          FROM marks GROUP BY sub_commodity_desc, promo_week) s
      ON s.sub_commodity_desc = m.sub_commodity_desc AND s.promo_week = m.promo_week
    WHERE m.clean AND (s.fresh OR s.quiet)"""

RELATIONS["sibling_members"] = """
    SELECT a.commodity_desc || '|' || a.promo_week AS event_id, a.product_id, a.promo_week,
           a.exposed AS treated
    FROM sibling_sides a
    WHERE EXISTS (SELECT 1 FROM sibling_sides b WHERE b.commodity_desc = a.commodity_desc
                  AND b.promo_week = a.promo_week AND b.exposed <> a.exposed)"""


def panel(members: str) -> str:
    return f"""
    SELECT m.event_id, m.product_id, m.promo_week, m.treated,
           s.week_no - m.promo_week AS rel_week, s.week_no = m.promo_week AS post,
           CAST(s.units AS DOUBLE) AS units, s.revenue, s.display_share
    FROM {members} m JOIN spine s
      ON s.product_id = m.product_id
     AND s.week_no BETWEEN m.promo_week - {K} AND m.promo_week"""


RELATIONS["promo_rows"] = panel("promo_members")
RELATIONS["sibling_rows"] = panel("sibling_members")


def demeaned(rows: str, series: dict[str, str]) -> str:
    """Within-event two-way demeaned series of a panel."""
    inner = ", ".join(f"{expression} AS raw_{name}" for name, expression in series.items())
    outer = ", ".join(
        f"raw_{name} - avg(raw_{name}) OVER unit - avg(raw_{name}) OVER week "
        f"+ avg(raw_{name}) OVER event AS {name}"
        for name in series
    )
    return f"""
    SELECT event_id, product_id, rel_week, {outer}
    FROM (SELECT event_id, product_id, rel_week, {inner} FROM {rows})
    WINDOW unit AS (PARTITION BY event_id, product_id),
           week AS (PARTITION BY event_id, rel_week), event AS (PARTITION BY event_id)"""


_TREATED_POST = "CASE WHEN treated AND post THEN 1.0 ELSE 0.0 END"
RELATIONS["flat_units"] = demeaned("promo_rows", {"x": _TREATED_POST, "y": "ln(1 + units)"})
RELATIONS["flat_revenue"] = demeaned("promo_rows", {"x": _TREATED_POST, "y": "ln(1 + revenue)"})
RELATIONS["flat_sibling"] = demeaned("sibling_rows", {"x": _TREATED_POST, "y": "ln(1 + units)"})
RELATIONS["flat_display"] = demeaned(
    "promo_rows", {"x": _TREATED_POST, "v": "display_share", "y": "ln(1 + units)"}
)
RELATIONS["flat_panel"] = demeaned("promo_rows", {"y": "ln(1 + units)", "display_share": "display_share"})


def one_regressor(flat: str) -> str:
    """Slope and clustered error with a single regressor."""
    return f"""
    SELECT max(b) AS coefficient,
           sqrt(sum(power(sxy - b * sxx, 2))) / sum(sxx)
               * sqrt(count(*) / (count(*) - 1.0) * (sum(n) - 1.0) / (sum(n) - 1.0)) AS std_error,
           sum(n) AS observations, count(*) AS clusters
    FROM (SELECT *, sum(sxy) OVER () / sum(sxx) OVER () AS b
          FROM (SELECT product_id, sum(x * x) AS sxx, sum(x * y) AS sxy, count(*) AS n
                FROM {flat} GROUP BY product_id))"""


RELATIONS["fit_units"] = one_regressor("flat_units")
RELATIONS["fit_revenue"] = one_regressor("flat_revenue")
RELATIONS["fit_sibling"] = one_regressor("flat_sibling")

# Two regressors: the first row of the inverse of [[a, c], [c, d]] is (d, -c) / (ad - cc).
RELATIONS["fit_display"] = """
    SELECT max(bx) AS coefficient,
           sqrt(sum(power((d * (xy - xx * bx - xv * bv) - c * (vy - xv * bx - vv * bv))
                          / (a * d - c * c), 2)))
               * sqrt(count(*) / (count(*) - 1.0) * (sum(n) - 1.0) / (sum(n) - 2.0)) AS std_error,
           sum(n) AS observations, count(*) AS clusters
    FROM (SELECT *, (d * p - c * q) / (a * d - c * c) AS bx, (a * q - c * p) / (a * d - c * c) AS bv
          FROM (SELECT *, sum(xx) OVER () AS a, sum(xv) OVER () AS c, sum(vv) OVER () AS d,
                       sum(xy) OVER () AS p, sum(vy) OVER () AS q
                FROM (SELECT product_id, sum(x * x) AS xx, sum(x * v) AS xv, sum(v * v) AS vv,
                             sum(x * y) AS xy, sum(v * y) AS vy, count(*) AS n
                      FROM flat_display GROUP BY product_id)))"""


def sizes(members: str) -> str:
    return f"""
    SELECT count(DISTINCT event_id) AS events, count(*) FILTER (WHERE treated) AS treated_units,
           count(*) FILTER (WHERE NOT treated) AS control_units,
           count(DISTINCT product_id) AS clusters
    FROM {members}"""


RELATIONS["promo_sizes"] = sizes("promo_members")
RELATIONS["sibling_sizes"] = sizes("sibling_members")

_ESTIMATES = (
    ("units", "units", "fit_units", "promo_sizes"),
    ("revenue", "revenue", "fit_revenue", "promo_sizes"),
    ("units_display_control", "units", "fit_display", "promo_sizes"),
    ("cannibalization_units", "units", "fit_sibling", "sibling_sizes"),
)
RELATIONS["estimates"] = """
    SELECT *, coefficient - width * std_error AS ci_low, coefficient + width * std_error AS ci_high,
           100 * (exp(coefficient) - 1) AS effect_pct,
           100 * (exp(coefficient - width * std_error) - 1) AS effect_pct_ci_low,
           100 * (exp(coefficient + width * std_error) - 1) AS effect_pct_ci_high
    FROM (SELECT e.*, {width} AS width, {p} AS p_value FROM ({union}) e)""".format(
    width=t_width("(e.clusters - 1.0)"),
    p=t_p("(e.coefficient / e.std_error)", "(e.clusters - 1.0)"),
    union=" UNION ALL ".join(
        f"SELECT '{name}' AS estimate, '{outcome}' AS outcome, f.coefficient, f.std_error, "
        f"CAST(f.observations AS BIGINT) AS observations, s.events, s.treated_units, "
        f"s.control_units, f.clusters FROM {fit} f, {size} s"
        for name, outcome, fit, size in _ESTIMATES
    ),
)

# Event study. With balanced events the coefficient of week t is the treated share weighted
# mean change since week -1; the score of a cluster is its part of that sum less the fit.
_WEEKS = [week for week in range(-K, 1) if week != -1]


def study(rows: str, prefix: str) -> None:
    RELATIONS[f"{prefix}_changes"] = f"""
    SELECT a.event_id, a.product_id, b.rel_week,
           d.weight, ln(1 + b.units) - ln(1 + a.units) AS change
    FROM {rows} a
    JOIN {rows} b ON b.event_id = a.event_id AND b.product_id = a.product_id
    JOIN (SELECT event_id, product_id, CASE WHEN treated THEN 1.0 ELSE 0.0 END
                 - avg(CASE WHEN treated THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY event_id)
                     AS weight
          FROM {rows} WHERE rel_week = 0) d
      ON d.event_id = a.event_id AND d.product_id = a.product_id
    WHERE a.rel_week = -1 AND b.rel_week <> -1"""
    RELATIONS[f"{prefix}_slopes"] = f"""
    SELECT rel_week, sum(weight * change) / sum(weight * weight) AS coefficient,
           sum(weight * weight) AS s, count(*) AS members, count(DISTINCT product_id) AS g
    FROM {prefix}_changes GROUP BY rel_week"""
    RELATIONS[f"{prefix}_scores"] = f"""
    SELECT product_id, c.rel_week,
           sum(c.weight * (c.change - c.level - c.weight * f.coefficient)) / max(f.s) AS score
    FROM (SELECT *, avg(change) OVER (PARTITION BY event_id, rel_week) AS level
          FROM {prefix}_changes) c JOIN {prefix}_slopes f USING (rel_week)
    GROUP BY product_id, c.rel_week"""
    cells = ", ".join(
        f"sum(a.score * b.score) FILTER (WHERE a.rel_week = {i} AND b.rel_week = {j}) "
        f"AS v_{n}_{m}"
        for n, i in enumerate(_WEEKS)
        for m, j in enumerate(_WEEKS)
    )
    slopes = ", ".join(
        f"(SELECT coefficient FROM {prefix}_slopes WHERE rel_week = {week}) AS b_{n}"
        for n, week in enumerate(_WEEKS)
    )
    RELATIONS[f"{prefix}_matrix"] = f"""
    SELECT *, g / (g - 1.0) * (members * {K + 1} - 1.0) / (members * {K + 1} - {K}.0) AS factor
    FROM (SELECT {cells}, {slopes},
                 (SELECT max(g) FROM {prefix}_slopes) AS g,
                 (SELECT max(members) FROM {prefix}_slopes) AS members
          FROM {prefix}_scores a JOIN {prefix}_scores b USING (product_id))"""
    # F = b' V^-1 b / 3 over the three weeks before -1, with the 3 x 3 inverse written out.
    minors = {
        (0, 0): "(v_1_1 * v_2_2 - v_1_2 * v_1_2)",
        (1, 1): "(v_0_0 * v_2_2 - v_0_2 * v_0_2)",
        (2, 2): "(v_0_0 * v_1_1 - v_0_1 * v_0_1)",
        (0, 1): "(v_0_2 * v_1_2 - v_0_1 * v_2_2)",
        (0, 2): "(v_0_1 * v_1_2 - v_0_2 * v_1_1)",
        (1, 2): "(v_0_1 * v_0_2 - v_0_0 * v_1_2)",
    }
    determinant = (
        f"(v_0_0 * {minors[0, 0]} + v_0_1 * {minors[0, 1]} + v_0_2 * {minors[0, 2]})"
    )
    form = " + ".join(
        f"{1 if i == j else 2} * b_{i} * b_{j} * {minor}" for (i, j), minor in minors.items()
    )
    RELATIONS[f"{prefix}_joint"] = f"""
    SELECT *, ({form}) / {determinant} / factor / 3.0 AS pretrend_f FROM {prefix}_matrix"""
    rows_sql = " UNION ALL ".join(
        f"SELECT {week} AS rel_week, b_{n} AS coefficient, sqrt(factor * v_{n}_{n}) AS std_error, "
        f"pretrend_f, g FROM {prefix}_joint"
        for n, week in enumerate(_WEEKS)
    )
    RELATIONS[f"{prefix}_study"] = f"""
    SELECT rel_week, coefficient, std_error, coefficient - width * std_error AS ci_low,
           coefficient + width * std_error AS ci_high,
           CASE WHEN rel_week <> -1 THEN {t_p("(coefficient / std_error)", "(g - 1.0)")} END
               AS p_value,
           pretrend_f, {f_p("pretrend_f", "3.0", "(g - 1.0)")} AS pretrend_p_value
    FROM (SELECT *, {t_width("(g - 1.0)")} AS width
          FROM ({rows_sql}
                UNION ALL SELECT -1, 0.0, 0.0, pretrend_f, g FROM {prefix}_joint))"""


study("promo_rows", "promo")
study("sibling_rows", "sibling")

RELATIONS["pre_gap"] = """
    SELECT 100 * (exp(max(abs(coefficient))) - 1) AS max_pre_gap_pct
    FROM promo_study WHERE rel_week < -1"""

RELATIONS["on_display"] = """
    SELECT avg(CASE WHEN display_share > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE treated) AS treated,
           avg(CASE WHEN display_share > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT treated)
               AS control
    FROM promo_rows WHERE post"""

# --- checks and documents -----------------------------------------------------------------------

_TABLES = {
    "transaction_data": "good_lines",
    "product": "good_goods",
    "hh_demographic": "people",
    "causal_data": "codes",
}
RELATIONS["codes"] = """
    SELECT product_id, store_id, week_no, CASE WHEN display THEN '1' ELSE '0' END AS display,
           CASE WHEN mailer THEN 'A' ELSE '0' END AS mailer
    FROM placements"""


def null_check(table: str, relation: str) -> str:
    columns = KEY_COLUMNS[table]
    listed = ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE {name} IS NULL) > 0 THEN '''{name}'': ' "
        f"|| count(*) FILTER (WHERE {name} IS NULL) END"
        for name in columns
    )
    return f"""
    SELECT 'no_nulls_{table}' AS name, found = '' AS passed, true AS critical,
           CASE WHEN found = '' THEN 'no nulls in {", ".join(columns)}'
                ELSE 'nulls: {{' || found || '}}' END AS details
    FROM (SELECT concat_ws(', ', {listed}) AS found FROM {relation})"""


_HIERARCHY = PARAMS.quality.hierarchy_columns
_MISSING = " OR ".join(f"{name} IS NULL" for name in _HIERARCHY)


def hierarchy_check(scope: str, condition: str) -> str:
    return f"""
    SELECT 'product_hierarchy_{scope}', count(*) = 0, {"true" if scope == "sold" else "false"},
           count(*) || ' {scope} products without {", ".join(_HIERARCHY)}'
    FROM good_goods WHERE ({_MISSING}) {condition}"""


def range_check(table: str, relation: str) -> str:
    low, high = PARAMS.quality.min_week, PARAMS.quality.max_week
    return f"""
    SELECT 'week_range_{table}', min(week_no) >= {low} AND max(week_no) <= {high}, true,
           'observed weeks ' || min(week_no) || '-' || max(week_no) || ', allowed {low}-{high}'
    FROM {relation}"""


def check_rows(lines: str) -> str:
    tables = {**_TABLES, "transaction_data": lines}
    parts = [null_check(table, relation) for table, relation in tables.items()]
    parts.append(f"""
    SELECT 'products_in_reference', count(DISTINCT product_id) = 0, true,
           count(DISTINCT product_id)
               || ' product_id values from transactions are missing in product'
    FROM {lines} WHERE product_id NOT IN (SELECT product_id FROM good_goods)""")
    parts.append(hierarchy_check("sold", f"AND product_id IN (SELECT product_id FROM {lines})"))
    parts.append(hierarchy_check("reference", ""))
    parts.append(range_check("transaction_data", lines))
    parts.append(range_check("causal_data", "codes"))
    return f"""
    SELECT *, CASE WHEN passed THEN 'PASS' WHEN critical THEN 'FAIL' ELSE 'WARN' END AS status
    FROM ({" UNION ALL ".join(parts)})"""


RELATIONS["checked"] = check_rows("good_lines")
RELATIONS["checked_all"] = check_rows("lines")

RELATIONS["counts"] = """
    SELECT *, (zero_quantity_removed + non_positive_sales_removed)
                  / (rows_raw - duplicates_removed) AS removed_share_of_distinct,
           (zero_quantity_removed + non_positive_sales_removed) / rows_raw AS removed_share_of_raw
    FROM (SELECT 'transaction_data' AS table_name, (SELECT count(*) FROM dirty_lines) AS rows_raw,
                 (SELECT count(*) FROM dirty_lines) - count(*) AS duplicates_removed,
                 count(*) FILTER (WHERE quantity = 0) AS zero_quantity_removed,
                 count(*) FILTER (WHERE quantity <> 0 AND sales_value <= 0)
                     AS non_positive_sales_removed,
                 count(*) FILTER (WHERE quantity IS NULL
                                  OR quantity <> 0 AND sales_value IS NULL) AS null_value_removed,
                 count(*) FILTER (WHERE quantity <> 0 AND sales_value > 0) AS rows_clean
          FROM unique_lines
          UNION ALL
          SELECT 'product', (SELECT count(*) FROM dirty_goods),
                 (SELECT count(*) FROM dirty_goods) - count(*), NULL, NULL, NULL, count(*)
          FROM (SELECT DISTINCT * FROM dirty_goods))"""

RELATIONS["table_totals"] = """
    SELECT count(DISTINCT household_key) AS households, count(DISTINCT basket_id) AS baskets,
           count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores,
           count(DISTINCT week_no) AS weeks
    FROM lines"""


def long(relation: str, section: str, columns: str, label: str = "") -> str:
    """Number columns of a relation as (section, metric, label, value)."""
    names = columns.split()
    label_sql = f"CAST({label} AS VARCHAR)" if label else "''"
    cells = ", ".join(f"CAST({name} AS DOUBLE)" for name in names)
    metrics = ", ".join(f"'{name}'" for name in names)
    return f"""
    SELECT '{section}' AS section, unnest([{metrics}]) AS metric, {label_sql} AS label,
           round(unnest([{cells}]), 6) AS value
    FROM {relation}"""


# --- statements -----------------------------------------------------------------------------------


def statement(body: str) -> str:
    """Prefix the relations a statement needs, directly or through others."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", pending.pop()))
        for name in words & RELATIONS.keys() - needed:
            needed.add(name)
            pending.append(RELATIONS[name])
    ctes = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in RELATIONS if name in needed)
    return f"WITH {ctes}\n{body}"


def select(relation: str, plain: str = "", doubles: str = "", where: str = "") -> str:
    """Columns of a relation, doubles rounded to six digits."""
    columns = [*plain.split(), *(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in doubles.split())]
    return statement(f"SELECT {', '.join(columns)} FROM {relation} {where}")


_GOODS = "product_id department commodity_desc sub_commodity_desc"
_LINES = "household_key basket_id day product_id quantity store_id week_no"
_HOME = "household_key household_group baskets recent_baskets"
_HOME_MONEY = (
    "first_half_revenue revenue baseline_revenue recent_revenue baseline_baskets avg_basket_value"
)
_SHELF = "product_id week_no department commodity_desc sub_commodity_desc units"
_STUDY = "coefficient std_error ci_low ci_high p_value pretrend_f pretrend_p_value"
_EFFECT = "effect_pct effect_pct_ci_low effect_pct_ci_high"
_SIZE = "observations events treated_units control_units clusters"
_TOTALS = (
    "total_revenue avg_weekly_revenue avg_weekly_baskets avg_weekly_active_households "
    "avg_basket_value"
)
_TREND = "revenue_change baskets_change active_households_change basket_value_change"
_CHURN_SHARES = (
    "churning_baseline_revenue_share churning_recent_revenue_share "
    "churning_window_revenue_share churning_basket_drop"
)
_GROUP = (
    "revenue baseline_revenue recent_revenue baseline_baskets recent_baskets household_share "
    "revenue_share baseline_revenue_share recent_revenue_share avg_basket_value"
)
_SEGMENT = (
    "household_share avg_basket_value avg_frequency avg_recency_weeks revenue revenue_share"
)
_AT_NAMES = " ".join(f"retention_period_{period}" for period in PARAMS.cohorts.report_periods)
_KEPT = "cohorts_kept households_in_kept_cohorts households_in_dropped_cohorts"
_COUNTS = (
    "rows_raw duplicates_removed zero_quantity_removed non_positive_sales_removed "
    "null_value_removed rows_clean"
)


def union_all(parts: list[str]) -> str:
    return statement(" UNION ALL ".join(parts))


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["csv_transactions"] = statement("""
        SELECT CAST(household_key AS INTEGER) AS household_key, basket_id, day,
               CAST(product_id AS INTEGER) AS product_id, quantity,
               round(CAST(sales_value AS DOUBLE), 6) AS sales_value, store_id,
               CAST(NULL AS DOUBLE) AS retail_disc, CAST(NULL AS INTEGER) AS trans_time, week_no,
               CAST(NULL AS DOUBLE) AS coupon_disc, CAST(NULL AS DOUBLE) AS coupon_match_disc
        FROM dirty_lines""")
    sql["csv_products"] = statement("""
        SELECT CAST(product_id AS INTEGER) AS product_id, CAST(NULL AS INTEGER) AS manufacturer,
               department, CAST(NULL AS VARCHAR) AS brand, commodity_desc, sub_commodity_desc,
               CAST(NULL AS VARCHAR) AS curr_size_of_product
        FROM good_goods""")
    sql["parquet_by_week"] = select(
        "lines", _LINES, "sales_value", "WHERE week_no BETWEEN 100 AND 200"
    )
    sql["sql_file"] = statement("""
        SELECT store_id, round(CAST(sum(sales_value) AS DOUBLE), 6) AS revenue,
               count(DISTINCT basket_id) AS baskets
        FROM lines WHERE week_no BETWEEN 100 AND 200 GROUP BY store_id""")
    sql["write_clean_counts"] = statement(f"""
        SELECT {", ".join(_COUNTS.split())}, rows_clean AS rows_written
        FROM counts WHERE table_name = 'transaction_data'""")
    sql["clean_strings"] = select("good_goods", _GOODS)
    sql["dedup_rows"] = select("unique_lines", _LINES, "sales_value")
    sql["invalid_reason_counts"] = statement("""
        SELECT reason, count(*) AS rows_removed
        FROM (SELECT CASE WHEN quantity = 0 THEN 'zero_quantity'
                          WHEN quantity <> 0 AND sales_value <= 0 THEN 'non_positive_sales'
                          WHEN quantity IS NULL OR sales_value IS NULL THEN 'null_value' END
                         AS reason
              FROM unique_lines)
        WHERE reason IS NOT NULL GROUP BY reason""")
    sql["clean_transactions"] = select("good_lines", _LINES, "sales_value")
    sql["prepare_stats"] = select(
        "counts", f"table_name {_COUNTS}", "removed_share_of_distinct removed_share_of_raw"
    )

    sql["dq_null_counts"] = union_all(
        [
            f"SELECT 'transaction_data' AS table_name, '{name}' AS column_name, "
            f"count(*) FILTER (WHERE {name} IS NULL) AS null_count FROM good_lines"
            for name in KEY_COLUMNS["transaction_data"]
        ]
    )
    sql["dq_orphan_products"] = statement(
        "SELECT DISTINCT product_id FROM good_lines "
        "WHERE product_id NOT IN (SELECT product_id FROM good_goods)"
    )
    sql["dq_hierarchy_sold"] = select(
        "good_goods",
        _GOODS,
        where=f"WHERE ({_MISSING}) AND product_id IN (SELECT product_id FROM good_lines)",
    )
    sql["dq_hierarchy_reference"] = select("good_goods", _GOODS, where=f"WHERE {_MISSING}")
    sql["dq_week_range"] = union_all(
        [
            f"SELECT '{table}' AS table_name, min(week_no) AS low, max(week_no) AS high "
            f"FROM {_TABLES[table]}"
            for table in ("transaction_data", "causal_data")
        ]
    )
    sql["dq_report"] = select("checked", "name passed critical details status")
    sql["quality_gate_failures"] = select(
        "checked", "name critical status details", where="WHERE critical AND NOT passed"
    )
    sql["weekly_activity"] = select("activity_by_week", "week_no active_households days")
    sql["analysis_window"] = select(
        "chosen_window", "start_week end_week", "active_households_threshold"
    )
    sql["dataset_totals"] = select("table_totals", "households baskets products stores weeks")

    sql["weekly_kpi"] = statement("""
        SELECT week_no, round(revenue, 6) AS revenue, baskets, active_households,
               round(revenue / baskets, 6) AS avg_basket_value,
               round(revenue / lag(revenue) OVER (ORDER BY week_no) - 1, 6) AS revenue_wow_change
        FROM kpi""")
    top = PARAMS.business.top_categories
    sql["category_share"] = statement(f"""
        SELECT category_level, category, round(revenue, 6) AS revenue,
               round(revenue_share, 6) AS revenue_share,
               CAST(revenue_rank AS INTEGER) AS revenue_rank
        FROM categories WHERE revenue_rank <= {top}""")
    top3 = """
        SELECT sum(revenue_share) AS top3_department_share FROM categories
        WHERE category_level = 'department' AND revenue_rank <= 3"""
    sql["top3_department_share"] = select(f"(SELECT * FROM ({top3}))", "", "top3_department_share")
    sql["business_totals"] = select("totals", "total_baskets active_households", _TOTALS)
    sql["trend_change"] = select("trend", "", _TREND)

    sql["rfm_scores"] = select(
        "rfm_scored",
        "household_key recency_weeks frequency r_score f_score m_score",
        "monetary avg_basket_value",
    )
    sql["rfm_segmented"] = select(
        "rfm_labelled",
        "household_key recency_weeks frequency r_score f_score m_score segment",
        "monetary avg_basket_value",
    )
    sql["rfm_segments"] = select("segments", "segment_order segment households", _SEGMENT)
    sql["rfm_segments_long"] = statement("""
        SELECT segment, unnest(['household_share', 'revenue_share']) AS metric,
               round(unnest([household_share, revenue_share]), 6) AS share
        FROM segments""")
    sql["top_customers_share"] = select(
        "top_customers", "households top_households", "top_customers_revenue_share"
    )
    sql["rfm_headline"] = select("rfm_facts", "households", "share_bought_in_last_week")

    sql["cohort_activity"] = select(
        "cohort_cells", "cohort_period periods_since_first active_households"
    )
    sql["cohort_sizes"] = select("cohort_size", "cohort_period households")
    sql["retention_matrix"] = select(
        "matrix",
        "cohort_period cohort_label periods_since_first households active_households",
        "retention",
    )
    sql["average_retention"] = select("mean_retention", "periods_since_first", "avg_retention")
    sql["retention_plateau"] = select(
        "plateau", "", "retention_plateau_min retention_plateau_max"
    )
    sql["cohort_headline"] = select("cohort_facts", _KEPT, _AT_NAMES)

    sql["household_activity"] = select(
        "household_facts",
        "household_key baskets recent_baskets",
        "first_half_revenue revenue baseline_revenue recent_revenue baseline_baskets",
    )
    sql["loyalty_flags"] = select("buyers", "household_key is_loyal", "first_half_revenue")
    sql["first_half_cume_dist"] = statement("""
        SELECT DISTINCT round(CAST(first_half_revenue AS DOUBLE), 6) AS first_half_revenue,
               round(spread, 6) AS cume_dist
        FROM buyers""")
    sql["churn_households"] = select(
        "homes", f"{_HOME} {' '.join(DEMOGRAPHIC_COLUMNS)}", _HOME_MONEY
    )
    sql["household_department"] = select(
        "home_departments", "household_key department", "department_revenue"
    )
    sql["churn_rows"] = select(
        "homes LEFT JOIN home_departments USING (household_key)",
        f"{_HOME} {' '.join(DEMOGRAPHIC_COLUMNS)} department",
        f"{_HOME_MONEY} department_revenue",
    )
    sql["churn_groups"] = select("group_rows", "household_group households", _GROUP)
    sql["churn_groups_long"] = statement("""
        SELECT household_group, unnest(['baseline_baskets', 'recent_baskets']) AS period,
               round(unnest([baseline_baskets, recent_baskets]), 6) AS baskets
        FROM group_rows WHERE household_group <> 'other'""")
    value_test = f"""(SELECT s.*, {normal_p("s.z")} AS p_value, 'asymptotic' AS method,
                    (SELECT median(avg_basket_value) FROM grouped
                     WHERE household_group = 'churning_loyal') AS churning_median,
                    (SELECT median(avg_basket_value) FROM grouped
                     WHERE household_group = 'stable_loyal') AS stable_median
             FROM value_sums s)"""
    sql["basket_value_test"] = select(
        value_test,
        "test n1 n2 method",
        "churning_median stable_median u tie_term z p_value",
    )
    sql["department_mix"] = select(
        "mix_flagged",
        "department n1 n2 method significant",
        "churning_share stable_share difference_pp u tie_term z p_value",
    )
    sql["department_mix_headline"] = statement("""
        SELECT count(*) FILTER (WHERE significant) AS significant_departments,
               arg_max(department, abs(difference_pp)) FILTER (WHERE significant) AS department,
               round(arg_max(difference_pp, abs(difference_pp)) FILTER (WHERE significant), 6)
                   AS difference_pp
        FROM mix_flagged""")
    sql["demographic_crosstab"] = select(
        "demographic_cells", "attribute level household_group households"
    )
    level = PARAMS.churn.alpha / len(DEMOGRAPHIC_COLUMNS)
    sql["demographic_tests"] = statement(f"""
        SELECT attribute, churning_with_demographics, stable_with_demographics, dof, reliable,
               round(statistic, 6) AS statistic, round(min_expected_count, 6) AS min_expected_count,
               round(p_value, 6) AS p_value, reliable AND p_value < {level!r} AS significant
        FROM demographic_results""")
    sql["churn_headline"] = select(
        "churn_facts", "churning_households loyal_households", _CHURN_SHARES
    )

    shares = "revenue mailer_store_share display_store_share"
    sql["promo_product_week"] = select("shelf_weeks", _SHELF, shares)
    sql["promo_product_week_filtered"] = select("shelf_kept", _SHELF, shares)
    sql["promo_spine"] = select("spine", _SHELF, "revenue mailer_share display_share")
    sql["promo_weeks"] = select("eligible_weeks", "promo_week")
    sql["promo_flags"] = select(
        "marks",
        "product_id promo_week commodity_desc sub_commodity_desc has_sales pre_mailer promoted "
        "treated clean window_mailer",
    )
    event = "event_id product_id promo_week treated"
    sql["promo_events"] = select("promo_members", event)
    sql["cannibalization_events"] = select("sibling_members", event)
    sql["promo_panel"] = select(
        "promo_rows", f"{event} rel_week post", "units revenue display_share"
    )
    sql["promo_group_means"] = statement("""
        SELECT rel_week, round(avg(ln(1 + units)) FILTER (WHERE treated), 6) AS treated,
               round(avg(ln(1 + units)) FILTER (WHERE NOT treated), 6) AS control
        FROM promo_rows GROUP BY rel_week""")
    sql["display_share"] = select("on_display", "", "treated control")
    sql["did_units"] = union_all(
        [
            "SELECT 'promo' AS design, * FROM promo_sizes",
            "SELECT 'cannibalization' AS design, * FROM sibling_sizes",
        ]
    )
    sql["demeaned_panel"] = select("flat_panel", "event_id product_id rel_week", "y display_share")
    sql["did_estimates"] = select(
        "estimates",
        f"estimate outcome {_SIZE}",
        f"coefficient std_error ci_low ci_high p_value {_EFFECT}",
    )
    sql["event_study"] = select("promo_study", "rel_week", _STUDY)
    sql["cannibalization_event_study"] = select("sibling_study", "rel_week", _STUDY)
    sql["promo_headline"] = select("pre_gap", "", "max_pre_gap_pct")
    sql["promo_effects"] = select("estimates", "estimate", _EFFECT)

    sql["products_left_out"] = statement("""
        SELECT count(DISTINCT product_id)
                   FILTER (sub_commodity_desc IS NULL OR product_id % 5 = 0)
                   AS products_without_sub_commodity,
               count(DISTINCT product_id)
                   FILTER (sub_commodity_desc IS NOT NULL AND product_id % 5 <> 0
                           AND (commodity_desc IS NULL OR product_id % 3 = 0))
                   AS products_without_commodity
        FROM shelf_kept""")
    sql["data_summary"] = union_all(
        [
            long("counts", "tables", f"{_COUNTS} removed_share_of_raw", "table_name"),
            long(
                "(SELECT *, CAST(passed AS INTEGER) AS check_passed FROM checked_all)",
                "checks",
                "check_passed",
                "name",
            ),
            long(
                "chosen_window", "analysis_window", "start_week end_week active_households_threshold"
            ),
            long(
                """(SELECT 'ramp_up' AS reason, 1 AS first_week, start_week - 1 AS last_week
                    FROM chosen_window
                    UNION ALL
                    SELECT 'incomplete', end_week + 1, last_week
                    FROM chosen_window,
                         (SELECT max(week_no) AS last_week FROM activity_by_week)
                    WHERE end_week < last_week)""",
                "excluded_weeks",
                "first_week last_week",
                "reason",
            ),
            long("table_totals", "totals", "households baskets products stores weeks"),
        ]
    )
    sql["results_metrics"] = union_all(
        [
            long("totals", "business", f"total_baskets active_households {_TOTALS}"),
            long("trend", "business", _TREND),
            long(f"({top3})", "business", "top3_department_share"),
            long("rfm_facts", "rfm", "share_bought_in_last_week"),
            long(
                "top_customers", "rfm", "households top_households top_customers_revenue_share"
            ),
            long("segments", "rfm", f"households {_SEGMENT}", "segment"),
            long("cohort_facts", "cohorts", f"{_KEPT} {_AT_NAMES}"),
            long("plateau", "cohorts", "retention_plateau_min retention_plateau_max"),
            long("cohort_size", "cohorts", "households", "cohort_period"),
            long(
                "churn_facts",
                "churning_loyal",
                f"churning_households loyal_households {_CHURN_SHARES}",
            ),
            long("group_rows", "churning_loyal", f"households {_GROUP}", "household_group"),
            long(value_test, "churning_loyal", "churning_median stable_median p_value", "test"),
            long(
                "estimates",
                "promo",
                f"coefficient std_error ci_low ci_high p_value {_EFFECT} {_SIZE}",
                "estimate",
            ),
            long("pre_gap", "promo", "max_pre_gap_pct"),
            long("on_display", "promo", "treated control"),
            long(
                """(SELECT 'promo' AS study, * FROM promo_study WHERE rel_week = -1
                    UNION ALL BY NAME
                    SELECT 'cannibalization' AS study, * FROM sibling_study
                    WHERE rel_week = -1)""",
                "promo",
                "pretrend_f pretrend_p_value",
                "study",
            ),
            long(
                """(SELECT count(DISTINCT product_id) FILTER (sub_commodity_desc IS NULL)
                               AS products_without_sub_commodity,
                           count(DISTINCT product_id)
                               FILTER (sub_commodity_desc IS NOT NULL AND commodity_desc IS NULL)
                               AS products_without_commodity
                    FROM shelf_kept)""",
                "promo",
                "products_without_sub_commodity products_without_commodity",
            ),
        ]
    )
    sql["rank_sum_exact"] = EXACT_RANK_SUM
    return sql


# All 53,130 ways to choose the ranks of five nations out of 25 are counted one by one.
EXACT_RANK_SUM = """
WITH balance AS (
  SELECT n_nationkey, n_regionkey, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS b
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
), ranked AS (
  SELECT *, rank() OVER (ORDER BY b) AS r FROM balance
), tests AS (
  SELECT t.r_regionkey AS test, count(*) FILTER (n_regionkey = t.r_regionkey) AS n1,
         count(*) FILTER (n_regionkey <> t.r_regionkey) AS n2,
         sum(r) FILTER (n_regionkey = t.r_regionkey) AS rank_sum
  FROM ranked, region t GROUP BY 1
), ways AS (
  SELECT a.i + b.i + c.i + d.i + e.i - 15 AS u, count(*) AS n
  FROM range(1, 26) a(i), range(1, 26) b(i), range(1, 26) c(i), range(1, 26) d(i), range(1, 26) e(i)
  WHERE a.i < b.i AND b.i < c.i AND c.i < d.i AND d.i < e.i GROUP BY 1
)
SELECT test, n1, n2, CAST(rank_sum - 15 AS DOUBLE) AS u,
       round(least(1.0, 2 * (SELECT sum(n) FROM ways
                             WHERE ways.u >= greatest(rank_sum - 15, 115 - rank_sum)) / 53130.0), 6)
         AS p_value,
       'exact' AS method
FROM tests
"""
