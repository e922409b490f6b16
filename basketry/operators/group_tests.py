"""Rank-sum and chi-square tests: one pass over the data, then a few numbers per test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import tails
from basketry.functions.columns import ratio
from basketry.operators.ranks import number, ranked


def rank_sums(frame: DataFrame, test: str, value: str, key: str, is_first: Column) -> DataFrame:
    """Mann-Whitney ingredients for every value of ``test`` in one job.

    Rows are ranked over the whole table by (test, value, key). A group of ties gets the mean
    of its ranks; subtracting the rows of the tests before it turns the global rank into the
    rank inside the test. Ties collapse on the map side, so a value shared by a third of the
    rows (a zero share, say) is one row per task.
    """
    numbered = number(
        frame.where(F.col(value).isNotNull()).select(test, value, key, is_first.alias("_first")),
        [F.asc(test), F.asc(value), F.asc(key)],
    )
    return rank_sums_of(numbered, test, value, F.col("_first"))


def rank_sums_of(numbered: DataFrame, test: str, value: str, is_first: Column) -> DataFrame:
    """``rank_sums`` of rows that are numbered by (test, value, key) already."""
    rows = ranked(numbered, "_rank", "_total").withColumn("_first", is_first)
    ties = rows.groupBy(test, value).agg(
        F.min("_rank").alias("_low"),
        F.count(F.lit(1)).alias("_t"),
        F.count_if(F.col("_first")).alias("_n1"),
    )
    t, n1 = F.col("_t").cast("double"), F.col("_n1").cast("double")
    middle = F.col("_low") + (t - 1) / 2
    before = F.min("_low") - 1
    sums = ties.groupBy(test).agg(
        F.sum("_n1").alias("n1"),
        (F.sum("_t") - F.sum("_n1")).alias("n2"),
        (F.sum(n1 * middle) - F.sum("_n1") * before).alias("rank_sum"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    a, b = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("rank_sum") - a * (a + 1) / 2
    n = a + b
    variance = a * b / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1)))
    gap = F.greatest(u1, a * b - u1) - a * b / 2 - 0.5
    z = F.when(variance > 0, F.try_divide(gap, F.sqrt(variance)))
    return sums.select(test, "n1", "n2", u1.alias("u"), "tie_term", z.alias("z"))


def add_rank_sum_p_values(sums: DataFrame, method: str = "auto") -> DataFrame:
    """``rank_sums`` rows with ``p_value`` and the ``method`` used (see ``rank_sum_p_value``).

    There is one row per test; the rows are finished on the driver and become a new table, so
    the job behind them runs once.
    """
    rows = [
        (
            *row,
            *tails.rank_sum_p_value(row["u"], row["n1"], row["n2"], row["tie_term"], method)[1:],
        )
        for row in sums.collect()
    ]
    schema = T.StructType(list(sums.schema.fields)).add("p_value", "double").add("method", "string")
    return sums.sparkSession.createDataFrame(rows, schema)


def crosstab(frame: DataFrame, attributes: Sequence[str], group: str) -> DataFrame:
    """Counts per attribute, level and group, long form; NULL levels are left out."""
    return (
        frame.unpivot([group], list(attributes), "attribute", "level")
        .where(F.col("level").isNotNull())
        .groupBy("attribute", "level", group)
        .agg(F.count(F.lit(1)).alias("households"))
    )


def chi_square(counts: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and smallest expected count per attribute.

    With two groups the sum over cells of observed squared over expected needs only level
    totals, so one aggregate gives every test. Tables with two levels use Yates' correction.
    """
    c, s = (
        F.coalesce(F.sum(F.when(F.col(group) == name, F.col("households"))), F.lit(0))
        for name in (first, second)
    )
    levels = counts.groupBy("attribute", "level").agg(c.alias("c"), s.alias("s"))
    c, s = F.col("c").cast("double"), F.col("s").cast("double")
    per_attribute = levels.groupBy("attribute").agg(
        F.sum("c").alias("n1"),
        F.sum("s").alias("n2"),
        F.count(F.lit(1)).alias("levels"),
        F.sum(c * c / (c + s)).alias("q1"),
        F.sum(s * s / (c + s)).alias("q2"),
        F.min(c + s).alias("small"),
        F.max(c + s).alias("large"),
        F.max_by(c, "level").alias("c1"),
        F.max_by(s, "level").alias("s1"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    general = n * (F.try_divide(F.col("q1"), n1) + F.try_divide(F.col("q2"), n2) - 1)
    cross = F.greatest(F.abs(F.col("c1") * n2 - F.col("s1") * n1) - n / 2, F.lit(0.0))
    yates = F.try_divide(n * cross * cross, F.col("small") * F.col("large") * n1 * n2)
    dof = (F.col("levels") - 1).cast("int")
    return per_attribute.select(
        "attribute",
        "n1",
        "n2",
        F.when((n1 > 0) & (n2 > 0), F.when(dof == 1, yates).otherwise(general)).alias(
            "statistic"
        ),
        dof.alias("dof"),
        ratio(F.least(n1, n2) * F.col("small"), n).alias("min_expected_count"),
    )


def add_chi_square_p_values(tests: DataFrame) -> DataFrame:
    """``chi_square`` rows with ``p_value``; one row per attribute reaches the driver."""
    rows = [
        (
            *row,
            None if row["statistic"] is None else tails.chi2_tail(row["statistic"], row["dof"]),
        )
        for row in tests.collect()
    ]
    schema = T.StructType(list(tests.schema.fields)).add("p_value", "double")
    return tests.sparkSession.createDataFrame(rows, schema)
