"""What the text operators share: null handling, row identity, words, connected components."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.sources.storage import stage

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send the functions of ``module`` along with the tasks, so executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def identity(*columns: str) -> list[Column]:
    """Two 64-bit hashes that stand for a row in joins: never null, equal for repeated rows.

    A null is hashed as a marker of its own, so that moving it to another column changes the hash.
    """
    parts = [part for name in columns for part in (F.col(name), F.col(name).isNull())]
    return [
        F.xxhash64(*parts).alias("_k1"),
        F.xxhash64(F.lit(1), *reversed(parts)).alias("_k2"),
    ]


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``_row`` beside its identity and its ``doc_id`` and ``text``.

    Whatever further columns a table has, they cannot clash with the operator's own. Map columns
    have no hash; rows that differ in a map alone count as repeated.
    """
    hashed = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    return docs.select(
        F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("_row"),
        *identity(*(f"`{name}`" for name in hashed)),
        F.col("doc_id").alias("_id"),
        text_of().alias("_text"),
    )


def unpacked(frame: DataFrame, columns: Sequence[str], **replaced: Column) -> DataFrame:
    """The rows as they came, with some columns replaced; ``columns`` are those of the table."""
    return frame.select(
        *(
            (replaced[name] if name in replaced else F.col(f"_row.`{name}`")).alias(name)
            for name in columns
        )
    )


def new_text(text: Column, columns: Sequence[str]) -> dict[str, Column]:
    """Replacements for a rewritten text: the text and, where the table has one, its length."""
    out = {"text": text}
    if "n_chars" in columns:
        out["n_chars"] = F.length(text).cast("bigint")
    return out


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of ``links`` that is not its component's smallest.

    Alternating star contraction: neighbours are hung on the smallest node they know until
    nothing moves. Every round is staged, holds no more edges than the one before, and adds up
    minima before it shuffles; the number of rounds grows with the logarithm of the longest path.
    """
    edges = (
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u != v")
        .distinct()
    )
    edges = stage(edges, "links")
    before, now = None, _signature(edges)
    while now != before and now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = stage(small, "small-star")
        before, now = now, _signature(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
