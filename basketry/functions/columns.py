"""Column helpers shared by the operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Money is summed in whole ten-thousandths of the currency unit unless a caller says otherwise.
MONEY_SCALE = 10_000


def money_units(column: str | Column, scale: int = MONEY_SCALE) -> Column:
    """A money column in whole ``1 / scale`` units."""
    value = F.col(column) if isinstance(column, str) else column
    return F.rint(value.cast("double") * scale).cast("bigint")


def units_money(units: Column, scale: int = MONEY_SCALE) -> Column:
    """Whole units as money."""
    return units / F.lit(float(scale))


def money_sum(column: str | Column, scale: int = MONEY_SCALE) -> Column:
    """Sum of a money column in whole ``1 / scale`` units, as double.

    Every value is rounded to such a unit first: amounts of up to four decimals, which all money
    columns here have, are kept as they are. Adding doubles depends on the row order; adding
    integers does not, and stays on primitive values in generated code, unlike wide decimals. An
    overflow raises. The sum is exact up to 2**53 units; beyond, the double result is the nearest.
    """
    return units_money(F.sum(money_units(column, scale)), scale)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Double division that gives NULL for a zero denominator (ANSI mode would raise)."""
    top = F.col(numerator) if isinstance(numerator, str) else numerator
    bottom = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def any_null(columns: tuple[str, ...]) -> Column:
    return reduce(lambda left, right: left | right, (F.col(name).isNull() for name in columns))


def snake_case(name: str) -> str:
    """``BASKET_ID`` and ``basketId`` both become ``basket_id``."""
    words = re.findall(r"[A-Z]*[a-z0-9]+|[A-Z0-9]+", name)
    return "_".join(words).lower()


def trim_strings(frame: DataFrame) -> DataFrame:
    """Trim every string column; blank text becomes NULL."""
    return frame.select(
        *(
            F.nullif(F.trim(field.name), F.lit("")).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else F.col(field.name)
            for field in frame.schema.fields
        )
    )


def round_doubles(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as the last step before comparing results."""
    return frame.select(
        *(
            F.round(field.name, digits).alias(field.name)
            if isinstance(field.dataType, T.DoubleType)
            else F.col(field.name)
            for field in frame.schema.fields
        )
    )
