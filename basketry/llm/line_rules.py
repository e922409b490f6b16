"""Quality rules from line frequencies across documents.

Every line is normalised and hashed together with its host. A line that more distinct documents
of a host hold than the limit allows is boilerplate: it is removed, and a document that loses too
much by it is rejected. Simple rules on a text alone (length, repetition) come first.

Copies of one text count as one document, so a text does not become boilerplate by being copied.
Null and empty texts have no words and fail the base rules; documents without a host form a host
of their own; repeated rows are judged alike and all kept or all rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import (
    LOWER,
    UPPER,
    WORD,
    identity,
    new_text,
    packed,
    ship,
    text_of,
    unpacked,
    word_count,
)
from basketry.sources.storage import stage

ship(__name__)

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """A line is boilerplate if more than ``max(docs, share * documents of its host)`` texts hold
    it; a document stays if at least ``min_words`` words and ``kept_share`` of its words remain.
    """

    docs: int = 10
    share: float = 0.001
    min_words: int = 10
    kept_share: float = 0.2
    repeat_percent: int = 20


def normal_line(line: Column) -> Column:
    """ASCII lower case, digits as 0, runs of blanks as one, none at the ends."""
    plain = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur at least twice."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(ids) <= WINDOW or len(seen) == len(ids):
        return 0
    # Windows are numbered by joining numbers of shorter windows: two, four, then five words.
    two = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    if two.max() + 1 == len(two):
        return 0
    four = np.unique(two[:-2] * len(two) + two[2:], return_inverse=True)[1]
    five = four[:-1] * len(seen) + ids[4:]
    _, number, times = np.unique(five, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[number] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[starts] += 1
    edges[starts + WINDOW] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


_KIND = np.zeros(256, np.uint8)  # 1 blank, 2 symbol, 3 inside a character of several bytes
_KIND[list(BLANKS)] = 1
_KIND[list(SYMBOLS)] = 2
_KIND[0x80:0xC0] = 3


def text_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=4)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        int(kinds[0] + kinds[2]),
        int(kinds[2]),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _figure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_bytes")
        rows = np.array([text_figures(t.as_py()) for t in texts], np.int64).reshape(-1, 5)
        kept = [name for name in batch.schema.names if name != "_bytes"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(name) for name in kept] + [pa.array(rows[:, i]) for i in range(5)],
            names=[*kept, *FIGURES],
        )


def figures(docs: DataFrame) -> DataFrame:
    """One row per document row: ``_k1, _k2, doc_id`` and the figures of its text."""
    narrow = docs.select(
        *identity("doc_id", "source", "text"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_of().cast("binary").alias("_bytes"),
    )
    columns = "_k1 long, _k2 long, doc_id long, " + ", ".join(f"{x} long" for x in FIGURES)
    return narrow.mapInArrow(_figure_batches, columns)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Lines with a word: document, host, hash of host and line, place and number of words."""
    lines = docs.select(
        *identity("doc_id", "source", "text"),
        F.xxhash64(F.col("source"), F.col("source").isNull()).alias("_host"),
        F.xxhash64("text").alias("_content"),
        F.posexplode(F.split(text_of(), "\n")).alias("_line", "_words"),
    ).where(F.col("_words").rlike(WORD))
    plain = normal_line(F.col("_words"))
    return lines.select(
        "_k1",
        "_k2",
        "_host",
        "_content",
        F.xxhash64("_host", plain).alias("_h1"),
        F.xxhash64(plain, "_host", F.lit(7)).alias("_h2"),
        "_line",
        word_count(F.col("_words")).alias("_words"),
    )


def frequent_lines(lines: DataFrame, rules: LineRules) -> DataFrame:
    """Hashes of the lines above their host's limit.

    Lines are first made distinct per text, which spreads a line that every document holds, and
    then counted with map-side sums.
    """
    counts = (
        lines.select("_h1", "_h2", "_host", "_content")
        .distinct()
        .groupBy("_h1", "_h2", "_host")
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") > rules.docs)
    )
    hosts = (
        lines.select("_host", "_content")
        .distinct()
        .groupBy("_host")
        .agg(F.count(F.lit(1)).alias("_host_docs"))
    )
    over = F.col("_docs") > F.col("_host_docs") * F.lit(rules.share)
    return counts.join(hosts, "_host").where(over).select("_h1", "_h2")


def judged(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document row: its figures, the places of its boilerplate lines, the verdict."""
    lines = stage(hashed_lines(docs), "lines")
    removed = (
        lines.join(frequent_lines(lines, rules), ["_h1", "_h2"])
        .groupBy("_k1", "_k2")
        .agg(F.collect_set(F.struct("_line", "_words")).alias("_removed"))
    )
    lost = F.aggregate("_removed", F.lit(0).cast("bigint"), lambda acc, x: acc + x["_words"])
    left = F.col("n_words") - F.col("n_frequent_words")
    return (
        figures(docs)
        .join(removed, ["_k1", "_k2"], "left")
        .withColumn("n_frequent_words", F.coalesce(lost, F.lit(0)))
        .withColumn("_removed", F.col("_removed._line"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")),
        )
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (left >= rules.min_words)
            & (left >= F.col("n_words") * F.lit(rules.kept_share)),
        )
    )


def quality_rules(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, without their boilerplate lines, in the columns of ``docs``."""
    verdict = (
        judged(docs.select("doc_id", "source", "text"), rules)
        .where("kept")
        .select("_k1", "_k2", "_removed")
        .dropDuplicates(["_k1", "_k2"])
    )
    rows = packed(docs).drop("_k1", "_k2")
    keys = identity("_row.doc_id", "_row.source", "_row.text")
    merged = rows.select("*", *keys).join(verdict, ["_k1", "_k2"])
    cut = merged.withColumn("_lines", F.split("_text", "\n"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    lines = F.transform(stays, lambda i: F.get(F.col("_lines"), i))
    text = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(F.array_join(lines, "\n"))
    return unpacked(
        cut.withColumn("_new", text), docs.columns, **new_text(F.col("_new"), docs.columns)
    )
