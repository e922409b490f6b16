"""License scans by diagonal voting.

Texts are cut into words, every rolling word gram is hashed and joined to the places of the
license templates that hold the same gram. A hit votes for a diagonal: its place in the text minus
its place in the template. Words that stand together as in the template vote for one diagonal;
inserted or dropped words move to the next, so diagonals at most ``slack`` apart are merged. A
merged span counts if it covers ``share`` of the template's words and is not much longer.

Phrases are templates of the base labels: they count where all their words stand consecutively on
one diagonal. Notices are longer and may be altered. A notice's gram has three words, a phrase's
two; both are looked up by the hash of the first two words, and the join compares all of them, so
hash collisions cannot count.

Null and empty texts have no words, no places, no labels and the score 0. Repeated rows are
scanned once and reported as often as they come. Templates are a small, given list and broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower, identity, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as their licenses word them, and labels of their own.
NOTICES = (
    ("Licensed under the GNU General Public License, version 3", "gpl-3"),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
        "gpl-notice",
    ),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
        "mit-notice",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "bsd-notice",
    ),
)


@dataclass(frozen=True)
class LicenseParams:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    notices: tuple[tuple[str, str], ...] = NOTICES
    share: float = 0.8
    slack: int = 2
    longer: float = 1.5
    chunk: int = 2000


def words_of(text: str) -> list[str]:
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return re.findall(WORD, lower)


def template_grams(params: LicenseParams) -> list[tuple]:
    """(template, place, three words, grams, words, label, base) of every gram of every template.

    The third word of a phrase's gram is null: it is not compared.
    """
    out = []
    for base, size, texts in ((True, 2, params.phrases), (False, 3, params.notices)):
        for text, label in texts:
            words = words_of(text)
            grams = len(words) - size + 1
            if grams < 1:
                raise ValueError(f"a template needs {size} words: {text!r}")
            number = len({row[0] for row in out})
            for i in range(grams):
                third = None if base else words[i + 2]
                out.append((number, i, *words[i : i + 2], third, grams, len(words), label, base))
    return out


def _pair(first: Column, second: Column) -> Column:
    return F.xxhash64(first, F.coalesce(second, F.lit("")))


def _grams(docs: DataFrame, params: LicenseParams) -> DataFrame:
    """Every place of every text with the words that begin there, and one end row per text.

    Texts are cut into chunks of ``chunk`` words that overlap by two, so no row is long. The end
    row has the empty word, which no text has, and its place is the number of words.
    """
    words = F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), F.lit(0))
    size = params.chunk
    chunks = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *identity("doc_id", "text"),
        F.concat(words, F.array(F.lit(""))).alias("_w"),
    ).select(
        "doc_id",
        "_k1",
        "_k2",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("_w"), F.lit(size)),
                lambda i: F.slice(F.col("_w"), i, F.lit(size + 2)),
            )
        ).alias("_chunk", "_c"),
    )
    zipped = F.arrays_zip(
        F.slice("_c", 1, size).alias("a"),
        F.slice("_c", 2, size).alias("b"),
        F.slice("_c", 3, size).alias("c"),
    )
    return (
        chunks.select("doc_id", "_k1", "_k2", "_chunk", F.posexplode(zipped).alias("_i", "_g"))
        .where("_g.a IS NOT NULL")
        .select(
            "doc_id",
            "_k1",
            "_k2",
            (F.col("_chunk").cast("bigint") * size + F.col("_i")).alias("_place"),
            F.col("_g.a").alias("_a"),
            F.col("_g.b").alias("_b"),
            F.col("_g.c").alias("_c"),
            _pair(F.col("_g.a"), F.col("_g.b")).alias("_pair"),
        )
    )


def hits(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """Votes: text, template, place in the template, diagonal. Template -1 is the end row."""
    spark: SparkSession = docs.sparkSession
    rows = [*template_grams(params), (-1, 0, "", None, None, 1, 1, "", False)]
    grams = spark.createDataFrame(
        rows,
        "_template int, _at int, _ta string, _tb string, _tc string, _grams int, _size int, "
        "_label string, _base boolean",
    ).withColumn("_key", _pair(F.col("_ta"), F.col("_tb")))
    same = (
        (F.col("_pair") == F.col("_key"))
        & (F.col("_a") == F.col("_ta"))
        & (F.col("_b").eqNullSafe(F.col("_tb")))
        & (F.col("_tc").isNull() | (F.col("_c") == F.col("_tc")))
    )
    return (
        _grams(docs, params)
        .join(F.broadcast(grams), same)
        .select(
            "doc_id",
            "_k1",
            "_k2",
            "_template",
            "_at",
            (F.col("_place") - F.col("_at")).alias("_diagonal"),
            "_grams",
            "_size",
            "_label",
            "_base",
        )
    )


def spans(votes: DataFrame, params: LicenseParams) -> DataFrame:
    """Merged diagonals: text, template, first and last place, share of the template covered.

    Phrases merge no diagonals. Sets hold places of a template, so they are bounded by its size.
    """
    text = ["_k1", "_k2", "_template"]
    by_diagonal = Window.partitionBy(*text).orderBy("_diagonal", "_at")
    slack = F.when(F.col("_base"), F.lit(0)).otherwise(F.lit(params.slack))
    apart = F.col("_diagonal") - F.lag("_diagonal").over(by_diagonal) > slack
    width = F.when(F.col("_base"), F.lit(2)).otherwise(F.lit(3))
    merged = (
        votes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("_span", F.sum("_new").over(by_diagonal))
        .withColumn("_width", width)
        .groupBy(*text, "_span", "_grams", "_size", "_label", "_base", "_width")
        .agg(
            F.collect_set("_at").alias("_set"),
            F.min(F.col("_diagonal") + F.col("_at")).alias("_from"),
            F.max(F.col("_diagonal") + F.col("_at") + F.col("_width")).alias("_to"),
        )
    )
    words = F.array_distinct(
        F.flatten(F.transform("_set", lambda i: F.sequence(i, i + F.col("_width") - 1)))
    )
    share = F.size(words) / F.col("_size")
    long = F.col("_to") - F.col("_from") > F.col("_size") * F.lit(params.longer)
    found = F.when(F.col("_base"), F.size("_set") == F.col("_grams")).otherwise(
        (share >= F.lit(params.share)) & ~long
    )
    return merged.select(
        "_k1", "_k2", "_label", "_base", "_from", "_to", share.alias("_share"), found.alias("_found")
    )


def scanned(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """One row per document row: words, base places, first and last, labels, score."""
    votes = hits(docs.select("doc_id", "text"), params)
    ends = F.col("_template") == -1
    # Votes of repeated rows are the same votes; the end rows say how often the row came.
    found = spans(votes.where(~ends).distinct(), params)
    base = F.col("_base") & F.col("_found")
    labels = lambda keep: F.array_join(
        F.array_sort(F.collect_set(F.when(keep, F.col("_label")))), ","
    )
    by_text = found.groupBy("_k1", "_k2").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("_from"))).alias("first_word"),
        F.max(F.when(base, F.col("_from"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("_found")).alias("labels"),
        F.max("_share").alias("score"),
    )
    texts = votes.where(ends).select(
        "doc_id", "_k1", "_k2", F.col("_diagonal").alias("n_words")
    )
    return texts.join(by_text, ["_k1", "_k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
