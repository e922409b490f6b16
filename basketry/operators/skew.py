"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.sources.storage import stage

SALTS = 16
#: Keys a sketch keeps apart: one that holds a thousandth of the rows is found for certain.
TRACKED = 10_000


def heavy_keys(keys: DataFrame, on: Sequence[str], rows: str | None = None) -> DataFrame:
    """(``_key``, ``_salts``): hashes of the keys with more rows than a task's fair share.

    ``keys`` holds a row per row of the large table, whose frequent keys a top-k sketch finds in
    one scan of ``on``, or a row per key with its exact count in ``rows``. A key is divided by its
    share of all rows over the partitions of a shuffle, so fewer keys than partitions are heavy
    and the result, which is staged, has a bounded size.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64(*on).alias("_key")
    if rows is None:
        most = min(parts, TRACKED)
        top = F.expr(f"approx_top_k(_key, {most}, {TRACKED})").alias("_top")
        sketch = keys.select(hashed).agg(top, F.count(F.lit(1)).alias("_total"))
        counted = sketch.select("_total", F.inline("_top").alias("_key", "_rows"))
    else:
        total = keys.agg(F.sum(rows)).first()[0] or 0
        counted = keys.select(hashed, F.col(rows).alias("_rows")).groupBy("_key")
        counted = counted.agg(F.sum("_rows").alias("_rows"), F.lit(total).alias("_total"))
    share = F.ceil(F.col("_rows") * parts / F.col("_total")).cast("int")
    return stage(
        counted.where(F.col("_rows") * parts > F.col("_total")).select(
            "_key", F.least(share, F.lit(parts)).alias("_salts")
        ),
        "heavy-keys",
    )


def salted_lookup(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join a large table to one with a single row per key.

    With ``heavy`` of ``heavy_keys`` only its keys are divided, each over its own number of
    sub-keys; without it every key of ``fact`` is divided over ``salts``. The sub-key is a hash of
    ``spread_by`` (stable, so a retried task sends each row to the same place) and the lookup row
    is copied to each of them. No broadcast of the lookup is forced: Spark picks one when its
    measured size allows it. Heavy keys are fewer than the partitions of a shuffle.
    """
    if heavy is None:
        many = lambda frame: frame.withColumn("_salts", F.lit(salts))
    elif [fact.schema[k].dataType for k in on] != [lookup.schema[k].dataType for k in on]:
        raise TypeError(f"keys {list(on)} have one type each on both sides of a salted look-up")
    elif heavy.isEmpty():
        return fact.join(lookup, list(on), how)
    else:

        def many(frame: DataFrame) -> DataFrame:
            keyed = frame.withColumn("_key", F.xxhash64(*on))
            marked = keyed.join(F.broadcast(heavy), "_key", "left").drop("_key")
            return marked.withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    own = F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int")
    salted = many(fact).withColumn("_salt", own).drop("_salts")
    all_salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    copies = many(lookup).withColumn("_salt", all_salts).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
