"""Parameters of every job, as plain frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SegmentRule:
    """Inclusive score ranges of one RFM segment."""

    name: str
    recency: tuple[int, int]
    frequency: tuple[int, int]
    monetary: tuple[int, int]


# Segment names and score ranges, first match wins.
SEGMENT_RULES = (
    SegmentRule("Чемпионы", (4, 5), (4, 5), (4, 5)),
    SegmentRule("Лояльные", (3, 5), (3, 5), (1, 5)),
    SegmentRule("Перспективные", (4, 5), (1, 2), (1, 5)),
    SegmentRule("Под угрозой ухода", (1, 2), (3, 5), (1, 5)),
    SegmentRule("Спящие", (1, 2), (1, 2), (1, 5)),
    SegmentRule("Середняки", (1, 5), (1, 5), (1, 5)),
)

# Columns that must never be NULL, per table.
KEY_COLUMNS = {
    "transaction_data": (
        "household_key", "basket_id", "day", "product_id",
        "quantity", "sales_value", "store_id", "week_no",
    ),
    "product": ("product_id",),
    "hh_demographic": ("household_key",),
    "causal_data": ("product_id", "store_id", "week_no", "display", "mailer"),
}

# Category columns a sold product must have.
HIERARCHY_COLUMNS = ("department", "commodity_desc", "sub_commodity_desc")

# Household attributes compared between loyal groups.
DEMOGRAPHIC_COLUMNS = (
    "classification_1",
    "classification_2",
    "classification_3",
    "classification_4",
    "classification_5",
    "homeowner_desc",
    "kid_category_desc",
)


@dataclass(frozen=True)
class Window:
    """First and last week of an analysis, both inclusive."""

    start_week: int
    end_week: int

    @property
    def mid_week(self) -> int:
        return (self.start_week + self.end_week) // 2


@dataclass(frozen=True)
class PlacementCodes:
    """Codes that mean "not placed"; every other non-NULL code is a placement."""

    mailer_absent: str = "0"
    display_absent: str = "0"


@dataclass(frozen=True)
class QualityParams:
    key_columns: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(KEY_COLUMNS))
    hierarchy_columns: tuple[str, ...] = HIERARCHY_COLUMNS
    min_week: int = 1
    max_week: int = 102
    stable_activity_ratio: float = 0.9
    full_week_days: int = 7


@dataclass(frozen=True)
class BusinessParams:
    top_categories: int = 10
    trend_weeks: int = 13


@dataclass(frozen=True)
class RfmParams:
    score_buckets: int = 5
    top_customers_share: float = 0.2
    segments: tuple[SegmentRule, ...] = SEGMENT_RULES


@dataclass(frozen=True)
class CohortParams:
    period_weeks: int = 4
    min_cohort_size: int = 50
    report_periods: tuple[int, ...] = (1, 3, 13)


@dataclass(frozen=True)
class ChurnParams:
    loyal_top_share: float = 0.2
    recent_weeks: int = 12
    activity_drop: float = 0.5
    top_departments: int = 8
    alpha: float = 0.05
    min_expected_count: float = 5.0


@dataclass(frozen=True)
class PromoParams:
    pre_weeks: int = 4
    treated_min_store_share: float = 0.5
    min_pre_weeks_with_sales: int = 4
    # Departments whose quantity is not an item count.
    excluded_departments: tuple[str, ...] = ("KIOSK-GAS", "MISC SALES TRAN")
    confidence_level: float = 0.95


@dataclass(frozen=True)
class JobParams:
    """Everything the analysis job needs."""

    codes: PlacementCodes = PlacementCodes()
    quality: QualityParams = field(default_factory=QualityParams)
    business: BusinessParams = BusinessParams()
    rfm: RfmParams = RfmParams()
    cohorts: CohortParams = CohortParams()
    churn: ChurnParams = ChurnParams()
    promo: PromoParams = PromoParams()
