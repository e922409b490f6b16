"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: sources share ``share`` times all words by weight; none gets more than ``most`` times its
own words, and what is cut off is shared again by weight. Each source's target becomes an integer
number of blocks, and each source's blocks an integer quota for every one of its shards, both by
the highest quotients ``votes / (2 * seats + 1)``. Inside a shard, documents lie on a line in
seeded order; the quota takes whole rounds of the shard and then consecutive blocks from a seeded
start. As the order is random, so is the choice, and almost every document is taken whole.

Null and empty texts have no words, so none are taken. A null source is a source, last in order.
Repeated rows are documents of their own. One row per source and shard is held by the driver:
``most_shards`` (a power of two) bounds the shards of a source, and the sources are those that
somebody weighs. A shard of about ``shard_words`` is one task's work, so a hot source is many.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import identity, new_text, packed, unpacked, word_count
from basketry.sources.storage import stage


@dataclass(frozen=True)
class MixParams:
    """``share`` of all words to take, ``most`` rounds of a document, words per block and shard."""

    share: float = 1.5
    most: int = 2
    block: int = 16
    shard_words: int = 100_000
    most_shards: int = 16_384
    seed: int = 9


def cyclic_weights(count: int) -> list[float]:
    """5, 2, 1 and again, in the order of the sources."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(count)]


def targets(sizes: Sequence[int], weights: Sequence[float], params: MixParams) -> list[float]:
    """Words per source: by weight, none above ``most`` times its size, the excess shared again."""
    out, left = [0.0] * len(sizes), params.share * sum(sizes)
    open_ = [i for i, size in enumerate(sizes) if size and weights[i] > 0]
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] >= params.most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = float(params.most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(left, 0.0)
    return out


def apportion(votes: Sequence[float], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by the highest quotients ``votes / (2 * held + 1)``, never above ``limits``.

    Most seats follow from rounding at a common divisor; the few that rounding gives too many or
    too few are moved one at a time by quotient, which ends where one-by-one allocation ends.
    Equal quotients go to the earlier party.
    """
    seats = min(seats, sum(limit for limit, vote in zip(limits, votes) if vote > 0))
    if not seats or not votes:
        return [0] * len(votes)
    divisor = sum(votes) / seats
    held = [min(limit, int(vote / divisor + 0.5)) for vote, limit in zip(votes, limits)]
    gap = seats - sum(held)
    step = 1 if gap > 0 else -1

    def quotient(i: int) -> tuple[float, int]:
        if gap > 0:
            return -votes[i] / (2 * held[i] + 1), i
        return votes[i] / (2 * held[i] - 1), -i

    able = lambda i: held[i] < limits[i] and votes[i] > 0 if gap > 0 else held[i] > 0
    heap = [(quotient(i), i) for i in range(len(votes)) if able(i)]
    heapq.heapify(heap)
    for _ in range(abs(gap)):
        i = heapq.heappop(heap)[1]
        held[i] += step
        if able(i):
            heapq.heappush(heap, (quotient(i), i))
    return held


def _blocks(size: int, block: int) -> int:
    return -(-size // block)


def quotas(
    shards: list[tuple[str | None, int, int]],
    weigh: Callable[[int], Sequence[float]],
    params: MixParams,
) -> list[tuple[str | None, int, int, int, float, int]]:
    """From (source, shard, words): source, shard, words, source words, target, blocks to take."""
    sources: dict[str | None, list[tuple[int, int]]] = {}
    for source, shard, size in shards:
        sources.setdefault(source, []).append((shard, size))
    names = sorted(sources, key=lambda name: (name is None, name or ""))
    sizes = [sum(size for _, size in sources[name]) for name in names]
    wanted = targets(sizes, weigh(len(names)), params)
    blocks = [sum(_blocks(size, params.block) for _, size in sources[name]) for name in names]
    # Targets in blocks: a last, shorter block counts as one, so two rounds are two of each.
    votes = [
        target / size * many if size else 0.0
        for target, size, many in zip(wanted, sizes, blocks)
    ]
    given = apportion(votes, round(sum(votes)), [params.most * many for many in blocks])
    out = []
    for name, size, target, quota in zip(names, sizes, wanted, given):
        parts = sorted(sources[name])
        many = [_blocks(part, params.block) for _, part in parts]
        for (shard, part), share in zip(
            parts, apportion(many, quota, [params.most * n for n in many])
        ):
            out.append((name, shard, part, size, target, share))
    return out


def _sized(docs: DataFrame, params: MixParams) -> DataFrame:
    rows = packed(docs)
    keys = F.xxhash64("_k1", "_k2", F.lit(params.seed))
    return rows.select(
        "_row",
        "_id",
        "_text",
        "_k1",
        "_k2",
        F.col("_row.source").cast("string").alias("_source"),
        word_count(F.col("_text")).alias("_size"),
        keys.alias("_order"),
    )


def _overlap(first: Column, last: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(last, high) - F.greatest(first, low))


def mixed(
    docs: DataFrame,
    params: MixParams = MixParams(),
    weigh: Callable[[int], Sequence[float]] = cyclic_weights,
) -> DataFrame:
    """Every row with its size, its source's size and target, and the words taken of it.

    ``_rounds`` counts whole copies; beside them the words from ``_skip`` to ``_skip + _part`` of
    the document are taken once more, and ``_wrap`` words from its start where the run of blocks
    ends in the document it began in.
    """
    sized = _sized(docs, params)
    # Cells and shards are powers of two, so every shard of a source has as many cells.
    cell = F.pmod(F.shiftright("_order", 20), F.lit(params.most_shards)).cast("int")
    parts = stage(
        sized.groupBy("_source", cell.alias("_cell")).agg(F.sum("_size").alias("_words")),
        "shard-sizes",
    )
    totals = parts.groupBy("_source").agg(F.sum("_words").alias("_total")).collect()
    count = {
        row["_source"]: min(
            params.most_shards, 1 << (row["_total"] // params.shard_words).bit_length()
        )
        for row in totals
    }
    known = sized.sparkSession.createDataFrame([*count.items()], "_s string, _shards int")
    same_source = F.col("_source").eqNullSafe(F.col("_s"))
    in_shards = (
        parts.join(F.broadcast(known), same_source)
        .groupBy("_source", F.pmod("_cell", "_shards").alias("_shard"))
        .agg(F.sum("_words").alias("_words"))
    )
    cells = {(row[0], row[1]): row[2] for row in in_shards.collect()}
    plan = quotas([(*key, size) for key, size in cells.items()], weigh, params)
    table = sized.sparkSession.createDataFrame(
        plan,
        "_s string, _shard int, _words long, _source_size long, _target double, _quota long",
    )
    # Both small tables are bounded like the driver's copy: sources times shards.
    rows = (
        sized.join(F.broadcast(known), same_source)
        .withColumn("_own", F.pmod(cell, F.col("_shards")))
        .drop("_s")
        .join(F.broadcast(table), same_source & (F.col("_own") == F.col("_shard")))
    )
    line = (
        Window.partitionBy("_source", "_own")
        .orderBy("_order", "_k1", "_k2")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_last", F.sum("_size").over(line))
    block, size = F.lit(params.block), F.col("_words")
    blocks = F.ceil(size / block)
    rows = rows.select(
        "_row",
        "_id",
        "_text",
        "_source",
        "_size",
        "_source_size",
        "_target",
        "_words",
        (F.col("_last") - F.col("_size")).alias("_first"),
        "_last",
        F.when(size > 0, F.floor(F.col("_quota") / blocks)).otherwise(0).alias("_rounds"),
        F.when(size > 0, F.col("_quota") % blocks).otherwise(0).alias("_more"),
        F.when(size > 0, F.pmod(F.xxhash64("_s", "_own", F.lit(params.seed)), blocks))
        .otherwise(0)
        .alias("_start"),
    )
    # The extra run of blocks is [low, high) on the shard's line, and what passes its end goes on
    # at its start.
    low = F.col("_start") * block
    end = (F.col("_start") + F.col("_more")) * block
    over = F.greatest(F.lit(0), (F.col("_start") + F.col("_more") - F.ceil(size / block)) * block)
    first, last = F.col("_first"), F.col("_last")
    part = _overlap(first, last, low, F.least(end, size))
    wrap = _overlap(first, last, F.lit(0), over)
    return rows.select(
        "_row",
        "_id",
        "_text",
        "_source",
        "_size",
        "_source_size",
        "_target",
        "_rounds",
        F.greatest(F.lit(0), low - first).alias("_skip"),
        part.alias("_part"),
        wrap.alias("_wrap"),
        (F.col("_rounds") * F.col("_size") + part + wrap).cast("bigint").alias("_taken"),
    )


def word_slice(text: Column, skip: Column, count: Column) -> Column:
    """``count`` words after the first ``skip``, with the blanks that precede each word."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    return F.array_join(F.slice(words, skip.cast("int") + 1, count.cast("int")), "")


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixture itself, in the columns of ``docs``: whole copies, and parts at the run's ends."""
    rows = mixed(docs, params)
    whole = F.col("_part") + F.col("_wrap") == F.col("_size")
    rounds = F.col("_rounds") + F.when(whole, 1).otherwise(0)
    copies = F.when(F.col("_size") > 0, rounds).otherwise(0)
    text = F.col("_text")
    pieces = F.concat(
        F.array_repeat(text, copies.cast("int")),
        F.when(
            ~whole & (F.col("_part") > 0),
            F.array(word_slice(text, F.col("_skip"), F.col("_part"))),
        ).otherwise(F.array().cast("array<string>")),
        F.when(
            ~whole & (F.col("_wrap") > 0), F.array(word_slice(text, F.lit(0), F.col("_wrap")))
        ).otherwise(F.array().cast("array<string>")),
    )
    out = rows.select("_row", F.explode(pieces).alias("_new"))
    return unpacked(out, docs.columns, **new_text(F.col("_new"), docs.columns))
