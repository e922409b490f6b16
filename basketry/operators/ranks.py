"""Ranks over a whole table without a single-partition sort.

``cume_dist``, rank sums and friends without PARTITION BY send every row to one task. Here the
rows are range-partitioned by the full order key, numbered inside each partition, and shifted by
the number of rows in the partitions before it. The numbering is staged first, because range
bounds come from a sample and another run of the same plan could cut the table elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.selection import Selection
from basketry.sources.storage import stage

# monotonically_increasing_id keeps the partition above bit 33 and the position below it.
_POSITION_BITS = 33


def number(frame: DataFrame, order: Sequence[Column], cells: int | None = None) -> DataFrame:
    """The rows in ``order``, staged, with ``_part``, their range, and ``_place``, their row in it.

    ``order`` must be total: end it with a unique key. Ranks, rank sums and medians of groups
    all follow from one numbering and counts per range. Where the ranges are known beforehand,
    ``order`` starts with their numbers, from 0 up to ``cells``; then nothing is sampled.
    """
    if cells is None:
        dealt = frame.repartitionByRange(*order)
    else:
        dealt = frame.repartitionById(cells, order[0])
    numbered = dealt.sortWithinPartitions(*order).withColumn(
        "_slot", F.monotonically_increasing_id()
    )
    position = F.col("_slot").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        stage(numbered, "rank")
        .withColumn("_part", F.shiftright("_slot", _POSITION_BITS))
        .withColumn("_place", position)
        .drop("_slot")
    )


def ranked(numbered: DataFrame, rank: str = "rank", total: str = "total_rows") -> DataFrame:
    """The 1-based position of every numbered row, and the number of rows."""
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range partition: bounded by a setting or by the caller's cells, not by the data.
    ordered = Window.orderBy("_part")
    offsets = sizes.select(
        "_part",
        (F.sum("_size").over(ordered) - F.col("_size")).alias("_before"),
        F.sum("_size").over(Window.partitionBy()).alias(total),
    )
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + F.col("_place") + 1)
        .drop("_part", "_place", "_before")
    )


def global_rank(
    frame: DataFrame,
    order: Sequence[Column],
    rank: str = "rank",
    total: str = "total_rows",
    cells: int | None = None,
) -> DataFrame:
    """Add the 1-based position of every row in ``order`` and the number of rows.

    ``order`` must be total: end it with a unique key; ``cells`` as in ``number``.
    """
    return ranked(number(frame, order, cells), rank, total)


def with_cume_dist(frame: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """``CUME_DIST() OVER (ORDER BY value DESC)``: one row per distinct value."""
    ranked = global_rank(
        frame.select(value, key), [F.col(value).desc(), F.col(key)], "_rank", "_total"
    )
    return ranked.groupBy(value).agg(
        (F.max("_rank").cast("double") / F.max("_total").cast("double")).alias(name)
    )


def top_share_cutoff(frame: DataFrame, value: str, share: float) -> Column:
    """Smallest value whose descending CUME_DIST is at most ``share`` (NULL if there is none).

    The value at the first rank beyond the share is selected; all values above it are inside. A
    group of ties that crosses the limit stays out as a whole. No row is sorted, and comparing
    with one cut-off replaces a join on the values, where a frequent value would be a hot key.
    ``frame`` is read several times, so it should be a staged table.
    """

    def inside(rows: int) -> int:
        # CUME_DIST is a quotient of doubles, so the same division decides.
        last = min(rows, max(0, int(rows * share)))
        while last < rows and (last + 1) / rows <= share:
            last += 1
        while last > 0 and last / rows > share:
            last -= 1
        return last

    known = frame.where(F.col(value).isNotNull()).select(value)
    order = {"value": [(value, False)]}
    chosen = Selection(known, order, {"value": lambda rows: [inside(rows) + 1]})
    above = F.lit(True)
    if inside(chosen.rows) < chosen.rows:
        above = ~chosen.from_rank("value", inside(chosen.rows) + 1)
    return known.where(above).agg(F.min(value)).scalar()


def group_medians(numbered: DataFrame, group: str, value: str) -> DataFrame:
    """Exact interpolated median of ``value`` per ``group``, from rows numbered by the value.

    Counts per range and group tell in which range a group's middle rows are and how many of the
    group's rows there come before them; only those ranges are read again. Rows numbered by
    further columns before the value need those in the group.
    """
    known = numbered.where(F.col(value).isNotNull()).select(group, value, "_part", "_place")
    # Groups times ranges: a few rows.
    sizes = known.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(group).orderBy("_part")
    middle = (
        sizes.select(
            group,
            "_part",
            "_size",
            (F.sum("_size").over(earlier) - F.col("_size")).alias("_before"),
            F.sum("_size").over(Window.partitionBy(group)).alias("_n"),
        )
        .select(
            group,
            "_part",
            "_size",
            F.explode(
                F.array_distinct(
                    F.array(
                        F.expr("(_n - 1) div 2 - _before"), F.expr("_n div 2 - _before")
                    )
                )
            ).alias("_at"),
        )
        .where("_at >= 0 AND _at < _size")
        .groupBy(group, "_part")
        .agg(F.collect_set("_at").alias("_wanted"))
        .withColumnRenamed(group, "_group")
    )
    inside = (F.col(group).eqNullSafe(F.col("_group"))) & (known["_part"] == middle["_part"])
    chosen = known.join(middle, inside).drop(middle["_part"])
    # A range of the numbering holds what one task holds.
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_place")) - 1
    return (
        chosen.withColumn("_row", place.cast("bigint"))
        .where(F.array_contains("_wanted", F.col("_row")))
        .groupBy(group)
        .agg(F.avg(F.col(value).cast("double")).alias("median"))
    )
