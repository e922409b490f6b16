"""Rows at given ranks of several orders, found by narrowing histograms.

A quantile boundary needs one row of an order, not the order. Every round counts the rows of the
staged table in bins: one histogram for each stretch of an order that still holds a wanted rank.
The bin with the rank is the next, narrower stretch; once all its values are equal, the next
column of the order takes over. A round is one scan with map-side sums: what is shuffled and what
reaches the driver is bounded by the number of ranks times the bins, not by the rows. The number
of rounds grows with the logarithm of the value range; all orders narrow in the same rounds. At the
end the keys of stretches that are left with few rows are sorted on the driver, all in one job.

Orders are lists of integer or floating-point columns; nulls come first in ascending and last in
descending columns, as in Spark. Rows that tie in all columns share a boundary, so an order that
must tell rows apart ends with a unique key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a stretch and round.
BINS = 1024

#: A stretch of at most so many rows is no longer narrowed: its rows are looked at.
FEW = 2048

#: A column and whether it ascends.
Key = tuple[str, bool]


@dataclass(frozen=True)
class Part:
    """One column of an order as a value that ascends and is never null."""

    value: Column
    whole: bool


@dataclass(frozen=True)
class Stretch:
    """Rows that agree with ``prefix`` and whose next value lies in ``low .. high``.

    There are ``rows`` of them, and ``before`` rows of the order come before; ``ranges`` are the
    least and largest values of the columns after the next one.
    """

    prefix: tuple
    low: float
    high: float
    before: int
    ranges: tuple
    rows: int


def _parts(frame: DataFrame, order: Sequence[Key], with_nulls: set[str]) -> list[Part]:
    out = []
    for name, ascending in order:
        kind = frame.schema[name].dataType
        whole = isinstance(kind, T.IntegralType)
        if not whole and not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
            raise TypeError(f"{name}: orders need integer or floating-point columns, not {kind}")
        value = F.col(name).cast("bigint" if whole else "double")
        if not ascending:
            # The complement reverses integers without overflow.
            value = F.bitwise_not(value) if whole else -value
        if name in with_nulls:
            known = F.col(name).isNotNull().cast("bigint")
            out.append(Part(known if ascending else F.bitwise_not(known), True))
            value = F.coalesce(value, F.lit(0).cast("bigint" if whole else "double"))
        out.append(Part(value, whole))
    return out


def _bin(name: str, whole: bool, low, high, bins: int) -> Column:
    """Number of the bin of a value between ``low`` and ``high``; it never falls as values rise."""
    if whole and high - low >= 1 << 62:
        return F.expr(f"shiftright({name}, 50) - ({low >> 50}L)")
    if whole:
        return F.expr(f"({name} - ({low}L)) div {-(-(high - low + 1) // bins)}L")
    value = F.col(name)
    if low <= 0 <= high or max(low / high, high / low) > bins:
        # By magnitude first: even bins would take hundreds of rounds to reach small values. The
        # logarithm of any double is above -750, and rises with it.
        size = F.log(F.abs(value)) + F.lit(750.0)
        value = F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * size)
        low, high = (math.copysign(math.log(abs(x)) + 750, x) if x else 0.0 for x in (low, high))
    width = (high - low) / bins
    if width == 0:
        return (value > F.lit(low)).cast("bigint")
    place = F.floor((value - F.lit(low)) / F.lit(width)).cast("bigint")
    return F.greatest(F.lit(0), F.least(place, F.lit(bins - 1))).cast("bigint")


def _inside(name: str, stretch: Stretch) -> Column:
    fixed = [F.col(f"{name}_{i}") == F.lit(value) for i, value in enumerate(stretch.prefix)]
    last = F.col(f"{name}_{len(stretch.prefix)}").between(stretch.low, stretch.high)
    return reduce(lambda a, b: a & b, [*fixed, last])


class Selection:
    """Keys at the wanted ranks of each order, and the number of rows.

    ``frame`` is read once a round, so it should be a staged table. ``ranks`` gives for a number of
    rows the 1-based ranks wanted in an order; ranks beyond the rows are left out.
    """

    def __init__(
        self,
        frame: DataFrame,
        orders: Mapping[str, Sequence[Key]],
        ranks: Mapping[str, Callable[[int], Sequence[int]]],
        bins: int = BINS,
        few: int = FEW,
    ):
        columns = sorted({column for order in orders.values() for column, _ in order})
        plain = {name: _parts(frame, order, set()) for name, order in orders.items()}
        ends = frame.agg(
            F.count(F.lit(1)).alias("rows"),
            *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns),
            *(
                f(part.value).alias(f"{f.__name__}_{name}_{i}")
                for name, parts in plain.items()
                for i, part in enumerate(parts)
                for f in (F.min, F.max)
            ),
        ).first()
        self.rows, self.few, self.rounds = ends["rows"], few, 0
        nulls = {column for column in columns if ends[f"nulls_{column}"]}
        self.names = {name: f"_o{i}" for i, name in enumerate(orders)}
        self.parts = {self.names[n]: _parts(frame, order, nulls) for n, order in orders.items()}
        self.keys: dict[str, dict[int, tuple]] = {name: {} for name in self.parts}
        values = frame.select(
            *(p.value.alias(f"{n}_{i}") for n, parts in self.parts.items() for i, p in enumerate(parts))
        )
        open_: list = []
        for order, keys in orders.items():
            ranges = []
            for i, (column, ascending) in enumerate(keys):
                low, high = ends[f"min_{order}_{i}"], ends[f"max_{order}_{i}"]
                if column in nulls:  # a flag comes first, and nulls count as zero
                    flags = (0, 1) if ascending else (-2, -1)
                    # All are null: the flag has the value of a null, 0 or its complement.
                    ranges.append(flags if low is not None else (0, 0) if ascending else (-1, -1))
                    low, high = min(low or 0, 0), max(high or 0, 0)
                ranges.append((low, high))
            wanted = sorted({r for r in ranks[order](self.rows) if 1 <= r <= self.rows})
            first = Stretch((), *ranges[0], 0, tuple(ranges[1:]), self.rows)
            self._settle(open_, self.names[order], first, wanted)
        small: list = []
        while open_:
            small += [entry for entry in open_ if entry[1].rows <= few]
            open_ = [entry for entry in open_ if entry[1].rows > few]
            if open_:
                self.rounds += 1
                open_ = self._narrowed(values, open_, bins)
        if small:
            self._looked_at(values, small)

    def _settle(self, open_: list, name: str, stretch: Stretch, wanted: list[int]) -> None:
        """Note the key of a stretch that has become a single one, else keep it open."""
        prefix, ranges = stretch.prefix, ((stretch.low, stretch.high), *stretch.ranges)
        while ranges and ranges[0][0] == ranges[0][1]:
            prefix, ranges = (*prefix, ranges[0][0]), ranges[1:]
        if not wanted:
            return
        if ranges:
            stretch = Stretch(prefix, *ranges[0], stretch.before, ranges[1:], stretch.rows)
            open_.append((name, stretch, wanted))
        else:
            self.keys[name].update((rank, prefix) for rank in wanted)

    def _narrowed(self, values: DataFrame, open_: list, bins: int) -> list:
        """One scan: a histogram of every open stretch, then the bins that hold wanted ranks."""
        width = max(len(parts) for parts in self.parts.values())
        rows = []
        for name, parts in self.parts.items():
            # The stretches of an order do not overlap.
            which = at_bin = F
            for number, (owner, stretch, _) in enumerate(open_):
                if owner == name:
                    inside, at = _inside(name, stretch), len(stretch.prefix)
                    place = _bin(f"{name}_{at}", parts[at].whole, stretch.low, stretch.high, bins)
                    which = which.when(inside, F.lit(number))
                    at_bin = at_bin.when(inside, place)
            if which is F:
                continue
            own = [which.alias("stretch"), at_bin.alias("bin")]
            for i in range(width):
                for whole, kind in ((True, "bigint"), (False, "double")):
                    has = i < len(parts) and parts[i].whole == whole
                    value = F.col(f"{name}_{i}") if has else F.lit(None).cast(kind)
                    own.append(value.alias(f"{kind}_{i}"))
            rows.append(F.struct(*own))
        measures = [F.count(F.lit(1)).alias("n")] + [
            f(f"{kind}_{i}").alias(f"{f.__name__}_{kind}_{i}")
            for i in range(width)
            for kind in ("bigint", "double")
            for f in (F.min, F.max)
        ]
        counted = (
            values.select(F.inline(F.array(*rows)))
            .where(F.col("stretch").isNotNull())
            .groupBy("stretch", "bin")
            .agg(*measures)
            .collect()
        )
        found: dict[int, list] = {}
        for row in sorted(counted, key=lambda r: (r["stretch"], r["bin"])):
            found.setdefault(row["stretch"], []).append(row)
        out: list = []
        for number, (name, stretch, wanted) in enumerate(open_):
            at, before = len(stretch.prefix), stretch.before
            kinds = ["bigint" if part.whole else "double" for part in self.parts[name]]
            for row in found[number]:
                inside = [rank for rank in wanted if before < rank <= before + row["n"]]
                ranges = tuple(
                    (row[f"min_{kinds[i]}_{i}"], row[f"max_{kinds[i]}_{i}"])
                    for i in range(at, len(kinds))
                )
                low, high = ranges[0]
                part = Stretch(stretch.prefix, low, high, before, ranges[1:], row["n"])
                self._settle(out, name, part, inside)
                before += row["n"]
        return out

    def _looked_at(self, values: DataFrame, small: list) -> None:
        """Keys of the wanted ranks in stretches of few rows, from those rows."""
        width = max(len(parts) for parts in self.parts.values())
        rows = []
        for number, (name, stretch, _) in enumerate(small):
            own = [F.lit(number).alias("stretch")]
            for i in range(width):
                for whole, kind in ((True, "bigint"), (False, "double")):
                    parts = self.parts[name]
                    has = i < len(parts) and parts[i].whole == whole
                    value = F.col(f"{name}_{i}") if has else F.lit(None).cast(kind)
                    own.append(value.alias(f"{kind}_{i}"))
            rows.append(F.when(_inside(name, stretch), F.struct(*own)))
        found: dict[int, list] = {}
        picked = values.select(F.explode(F.array_compact(F.array(*rows))).alias("_row"))
        for row in picked.select("_row.*").collect():
            kinds = ["bigint" if p.whole else "double" for p in self.parts[small[row["stretch"]][0]]]
            key = tuple(row[f"{kind}_{i}"] for i, kind in enumerate(kinds))
            found.setdefault(row["stretch"], []).append(key)
        for number, (name, stretch, wanted) in enumerate(small):
            keys = sorted(found[number])
            self.keys[name].update((rank, keys[rank - stretch.before - 1]) for rank in wanted)

    def after(self, order: str, rank: int) -> Column:
        """Whether a row comes after the one at ``rank``; false if there is no such rank."""
        name = self.names[order]
        key = self.keys[name].get(rank)
        out = F.lit(False)
        for part, value in reversed(list(zip(self.parts[name], key or ()))):
            out = (part.value > F.lit(value)) | ((part.value == F.lit(value)) & out)
        return out

    def from_rank(self, order: str, rank: int) -> Column:
        """Whether a row ties with the one at ``rank`` or comes after it."""
        name = self.names[order]
        key = self.keys[name].get(rank)
        out = F.lit(key is not None)
        for part, value in reversed(list(zip(self.parts[name], key or ()))):
            out = (part.value > F.lit(value)) | ((part.value == F.lit(value)) & out)
        return out


def ntile_ends(rows: int, buckets: int) -> list[int]:
    """Last rank of every NTILE bucket but the last one."""
    size, larger = divmod(rows, buckets)
    return [number * size + min(number, larger) for number in range(1, buckets)]


def with_ntiles(frame: DataFrame, orders: Mapping[str, Sequence[Key]], buckets: int) -> DataFrame:
    """``NTILE(buckets) OVER (ORDER BY order)`` as one column for every order.

    No row is shuffled: a row's bucket is the number of boundaries it comes after, plus one.
    """
    ends = dict.fromkeys(orders, lambda rows: ntile_ends(rows, buckets))
    chosen = Selection(frame, orders, ends)
    return frame.select(
        "*",
        *(
            reduce(
                lambda total, rank: total + chosen.after(name, rank).cast("int"),
                ntile_ends(chosen.rows, buckets),
                F.lit(1),
            ).alias(name)
            for name in orders
        ),
    )
