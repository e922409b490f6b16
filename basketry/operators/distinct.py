"""Exact distinct counts of several id columns at once, as sets that can be merged.

A set of ids is kept as words of 64 bits, one row for each word that has a bit set. ``bit_or``
builds and merges them: sets per week become the set of the window without another look at the
lines. All columns come from one scan; a task shuffles a word instead of its ids, and ids that lie
far apart cost a row each, as they would in any distinct count. Spark's own bitmap aggregates keep
four kilobytes for each 32,768 ids, however few are set, and sort the rows to build them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word(ids: Column) -> Column:
    """The word of 64 ids that holds an integer id."""
    return F.shiftright(ids.cast("bigint"), 6)


def bit(ids: Column) -> Column:
    """The bit of an id in its word."""
    place = ids.cast("bigint").bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def id_sets(
    frame: DataFrame, ids: Sequence[str], by: Sequence[str] = (), amounts: Mapping[str, Column] = {}
) -> DataFrame:
    """``by, kind, word, bits`` for every set, and sums of integer ``amounts``.

    ``kind`` is the place of the column in ``ids``. NULL ids are in no set. Every amount is added
    to the rows of the first column alone, so its sum over all of them is that of the lines.
    """
    for name in ids:
        if not isinstance(frame.schema[name].dataType, T.IntegralType):
            raise TypeError(f"{name} is no integer column")
    members = []
    for kind, name in enumerate(ids):
        counted = (
            (amount if kind == 0 else F.lit(None).cast("bigint")).alias(label)
            for label, amount in amounts.items()
        )
        members.append(
            F.struct(
                F.lit(kind).alias("kind"),
                word(F.col(name)).alias("word"),
                bit(F.col(name)).alias("bits"),
                *counted,
            )
        )
    return (
        frame.select(*by, F.inline(F.array(*members)))
        .groupBy(*by, "kind", "word")
        .agg(F.bit_or("bits").alias("bits"), *(F.sum(label).alias(label) for label in amounts))
    )


def members(sets: DataFrame, kind: int, name: str) -> DataFrame:
    """The ids of one kind, each once."""
    words = merged(sets.where((F.col("kind") == kind) & F.col("bits").isNotNull()))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    found = words.select("word", F.explode(places).alias("place"))
    first = F.call_function("shiftleft", F.col("word"), F.lit(6))
    return found.select(first.bitwiseOR(F.col("place").cast("bigint")).alias(name))


def merged(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The union of sets that agree in ``by``."""
    return sets.groupBy(*by, "kind", "word").agg(F.bit_or("bits").alias("bits"))


def counts(
    sets: DataFrame, names: Mapping[str, str], by: Sequence[str] = (), *amounts: Column
) -> DataFrame:
    """Sizes of the sets of each ``by``, named by ``names`` in the order of the ids, and ``amounts``."""
    size = F.bit_count("bits").cast("bigint")
    return sets.groupBy(*by).agg(
        *(
            F.coalesce(F.sum(F.when(F.col("kind") == kind, size)), F.lit(0)).alias(label)
            for kind, label in enumerate(names.values())
        ),
        *amounts,
    )
