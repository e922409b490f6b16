"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

The lines of a text that hold a word are taken three at a time, each window is hashed, and windows
that occur again anywhere are found by their hash. The first occurrence, by ``doc_id`` (null last),
then text, then place, stays whole; lines that later occurrences cover, and that no first
occurrence needs, are removed as merged spans, together with blank lines inside such a span.

A null text is an empty one. Texts with fewer than three such lines have no window and stay as
they are, and so do all other lines. Repeated rows are one document given several times: all of
them get the same text, as removing rows is not this operator's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WORD, new_text, packed, text_of, unpacked
from basketry.sources.storage import stage

SPAN = 3


def _places(lines: Column) -> Column:
    """Places of the lines that hold a word."""
    numbered = F.transform(lines, lambda line, i: F.when(line.rlike(WORD), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: document, place of its first line among lines with a word, its hash.

    Two 64-bit hashes over the three lines in different orders serve as one 128-bit key.
    """
    lines = F.filter(F.split(text_of(), "\n"), lambda line: line.rlike(WORD))
    return (
        docs.select("doc_id", F.xxhash64("text").alias("_content"), lines.alias("_lines"))
        .where(F.size("_lines") >= SPAN)
        .select(
            "doc_id",
            "_content",
            F.posexplode(
                F.arrays_zip(
                    F.slice("_lines", F.lit(1), F.size("_lines") - 2).alias("a"),
                    F.slice("_lines", F.lit(2), F.size("_lines") - 2).alias("b"),
                    F.slice("_lines", F.lit(3), F.size("_lines") - 2).alias("c"),
                )
            ).alias("_place", "_w"),
        )
        .select(
            "doc_id",
            "_content",
            "_place",
            F.xxhash64("_w.a", "_w.b", "_w.c").alias("_h1"),
            F.xxhash64("_w.c", "_w.a", "_w.b", F.lit(7)).alias("_h2"),
        )
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """Per document with removed lines: ``doc_id, _content`` and the sorted places removed.

    Minima and counts per hash are summed before the shuffle; only the small table of repeated
    windows is joined back, and the engine splits a hash that very many documents share.
    """
    found = stage(windows(docs).distinct(), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_content", "_place")
    repeated = (
        found.groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_times"), F.min(place).alias("_first"))
        .where("_times > 1")
        .select("_h1", "_h2", "_first")
    )
    is_first = place.eqNullSafe(F.col("_first"))
    marked = found.join(repeated, ["_h1", "_h2"]).select(
        "doc_id", "_content", "_place", is_first.alias("_is_first")
    )
    lines = lambda places: F.flatten(
        F.transform(places, lambda p: F.array(*(p + i for i in range(SPAN))))
    )
    return (
        marked.groupBy("doc_id", "_content")
        .agg(
            F.collect_list(F.when(~F.col("_is_first"), F.col("_place"))).alias("_later"),
            F.collect_list(F.when(F.col("_is_first"), F.col("_place"))).alias("_firsts"),
        )
        .select(
            "doc_id",
            "_content",
            F.array_sort(F.array_except(lines(F.col("_later")), lines(F.col("_firsts")))).alias(
                "_removed"
            ),
        )
        .where(F.size("_removed") > 0)
    )


def _spans(removed: str) -> tuple[Column, Column]:
    """First and last place of every run of consecutive places."""
    places, last = F.col(removed), F.size(removed) - 1
    starts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) < x - 1))
    ends = F.filter(places, lambda x, i: (i == last) | (F.get(places, i + 1) > x + 1))
    return starts, ends


def rewritten(docs: DataFrame) -> DataFrame:
    """Packed rows with ``_new`` text, ``_n_lines`` and ``_n_removed`` (of lines with a word)."""
    columns = docs.select("doc_id", "text")
    gone = covered_lines(columns).withColumnRenamed("doc_id", "_gid")
    rows = packed(docs).withColumn("_content", F.xxhash64("_row.text"))
    merged = rows.join(
        gone.withColumnRenamed("_content", "_gcontent"),
        F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_content") == F.col("_gcontent")),
        "left",
    )
    cut = merged.withColumn("_lines", F.split("_text", "\n"))
    cut = cut.withColumn("_at", _places(F.col("_lines")))
    starts, ends = _spans("_removed")
    line = lambda x: F.get(F.col("_at"), x)
    # Merged spans of removed lines, as places among all lines; what lies between them stays.
    cut = cut.withColumn("_from", F.transform(starts, line)).withColumn(
        "_to", F.transform(ends, line)
    )
    stays = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("_to", lambda x: x + 1)),
        F.concat("_from", F.array(F.size("_lines"))),
        lambda a, b: F.slice(F.col("_lines"), a + 1, b - a),
    )
    text = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(
        F.array_join(F.flatten(stays), "\n")
    )
    return cut.select(
        "_row",
        "_id",
        text.alias("_new"),
        F.size("_at").cast("bigint").alias("_n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint").alias("_n_removed"),
    )


def remove_windows(docs: DataFrame) -> DataFrame:
    """The documents with the lines of later windows removed, in the columns of ``docs``."""
    return unpacked(rewritten(docs), docs.columns, **new_text(F.col("_new"), docs.columns))
