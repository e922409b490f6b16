"""Packing: optimal length buckets, and token-budget batches inside each.

Documents are cut into pieces of at most ``longest`` words, so nothing is dropped and the global
histogram of lengths has at most that many rows. Dynamic programming over the histogram chooses
the bucket boundaries with the least padding. Inside a bucket, pieces in seeded order fill batches
of as many rows as the token budget holds at the bucket's length.

Null and empty texts have one piece without words, in the shortest bucket. Repeated rows are
packed once each. Ties in the seeded order are broken by the row's hashes; rows that still tie are
equal. An empty table gives no buckets and no rows.

Pieces are numbered in cells: each bucket is cut along the seeded order into as many cells as its
words need, so tasks hold about equal numbers of words, whatever the lengths and counts are. A
text longer than a cell cannot make one, since pieces have at most ``longest`` words.

Every piece carries its text, so batches can be filled from the result alone: pieces of a row,
joined in order, are its text, blanks included. ``row_key`` is equal for the pieces of one row and
tells rows of the same ``doc_id`` apart (a whole and a partial copy, say); repeated rows share it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import packed, word_count
from basketry.operators.ranks import global_rank


@dataclass(frozen=True)
class PackParams:
    """Words of the longest piece, number of buckets, and words in a batch, padding included.

    A task numbers about ``cell_words``, more if that took over ``most_cells`` tasks.
    """

    longest: int = 4096
    buckets: int = 12
    budget: int = 65_536
    seed: int = 2
    cell_words: int = 1 << 22
    most_cells: int = 1 << 16


#: Words that a row weighs beside its own: its keys and numbers.
ROW_WORDS = 8


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Bucket lengths with the least padding, and that padding.

    ``cost[k][j]`` is the least padding of the first ``j`` lengths in ``k`` buckets. The best last
    cut never moves left as ``j`` grows, so every row is found by divide and conquer.
    """
    size = np.array(lengths, np.int64)
    many = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    words = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) * size)])
    n = len(size)
    if not n:
        return [], 0
    cost = np.concatenate([[0], np.full(n, np.iinfo(np.int64).max // 4)])
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = cost.copy(), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            padding = size[j - 1] * (many[j] - many[i]) - (words[j] - words[i])
            best = int(np.argmin(cost[i] + padding))
            new[j], cut[j] = cost[i[best]] + padding[best], i[best]
            todo += [(low, j - 1, left, i[best]), (j + 1, high, i[best], right)]
        cost = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j:
            ends.append(int(size[j - 1]))
            j = int(cut[j])
    return ends[::-1], int(cost[n])


#: A word with the blanks before it; the last word of a text has those after it as well.
_WORD_AND_BLANKS = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?"


def _counted(docs: DataFrame, params: PackParams) -> DataFrame:
    """Packed rows with ``_words`` and ``_pieces``, the numbers of both."""
    rows = packed(docs).withColumn("_words", word_count(F.col("_text")))
    many = F.greatest(F.lit(1), F.ceil(F.col("_words") / F.lit(params.longest)))
    return rows.withColumn("_pieces", many.cast("bigint"))


def _length(params: PackParams) -> Column:
    return F.least(F.lit(params.longest), F.col("_words") - F.col("_piece") * params.longest)


def histogram(docs: DataFrame, params: PackParams) -> DataFrame:
    """(``_length``, ``n``) of the pieces, from the numbers of words alone."""
    rows = _counted(docs, params).groupBy("_words", "_pieces").agg(F.count(F.lit(1)).alias("_n"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)
    rows = rows.withColumn("_piece", F.explode(numbers))
    lengths = rows.select(_length(params).alias("_length"), "_n")
    return lengths.groupBy("_length").agg(F.sum("_n").alias("n"))


def pieces(docs: DataFrame, params: PackParams) -> DataFrame:
    """One row per piece of at most ``longest`` words: ``_piece`` from 0, ``_length`` words, text.

    A text that is longer is taken apart once, before its pieces are dealt out.
    """
    rows = _counted(docs, params)
    words = F.regexp_extract_all(F.col("_text"), F.lit(_WORD_AND_BLANKS), F.lit(0))
    rows = rows.withColumn("_parts", F.when(F.col("_pieces") > 1, words))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)
    cut = lambda i: F.array_join(
        F.slice("_parts", (i * params.longest + 1).cast("int"), F.lit(params.longest)), ""
    )
    texts = F.when(F.col("_parts").isNull(), F.array("_text")).otherwise(F.transform(numbers, cut))
    rows = rows.select("_k1", "_k2", "_id", "_words", F.posexplode(texts).alias("_at", "_piece_text"))
    rows = rows.withColumn("_piece", F.col("_at").cast("bigint"))
    return rows.select(
        "_k1",
        "_k2",
        "_id",
        "_piece",
        (F.col("_piece") * params.longest).alias("_start"),
        _length(params).alias("_length"),
        "_piece_text",
    )


def _bucket(length: Column, ends: list[int]) -> Column:
    """The shortest bucket that holds the length: position in the sorted list of lengths."""
    return F.element_at(F.filter(F.lit(ends).cast("array<bigint>"), lambda end: end >= length), 1)


def cells(
    lengths: list[int], counts: list[int], ends: list[int], least: int, params: PackParams
) -> dict[int, tuple[int, int, int]]:
    """For each bucket the pieces and the cells before it, and its own cells.

    Cells are dealt by words: at least ``least`` in all, and one for every bucket.
    """
    rows, words = [], []
    for end, low in zip(ends, [-1, *ends]):
        inside = [(x, c) for x, c in zip(lengths, counts) if low < x <= end]
        rows.append(sum(c for _, c in inside))
        words.append(sum((x + ROW_WORDS) * c for x, c in inside))
    total = max(1, sum(words))
    wanted = min(params.most_cells, max(least, -(-total // params.cell_words)))
    many = [max(1, -(-w * wanted // total)) for w in words]
    firsts = zip(ends, np.cumsum([0, *rows]), np.cumsum([0, *many]), many)
    return {end: (int(row), int(cell), n) for end, row, cell, n in firsts}


def packed_pieces(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """``_k1, _k2, _id``, the piece, its text, bucket length, batch (per bucket, from 0) and row.

    The seeded order inside a bucket is that of a hash, so equal shares of the hash's range are
    cells of equal size, known without a look at the rows; one bucket may hold any share of all
    rows. The histogram is the only thing collected, at most ``longest + 1`` rows. The texts are
    shuffled and staged once, by the cell; ``docs`` is read for the histogram and the cells, and
    must give the same rows each time.
    """
    lengths, counts = zip(
        *histogram(docs, params).orderBy("_length").collect() or [(0, 0)]
    )
    ends, _ = best_boundaries(list(lengths), list(counts), params.buckets)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells(list(lengths), list(counts), ends, least, params)

    def of_bucket(at: int) -> Column:
        pairs = (F.lit(x).cast("bigint") for end, of in dealt.items() for x in (end, of[at]))
        return F.element_at(F.create_map(*pairs), F.col("_bucket"))

    # The upper 32 bits of the hash, from 0: times the cells, they tell the cell in hash order.
    upper = F.shiftright("_hash", 32) + F.lit(1 << 31)
    cell = of_bucket(1) + F.shiftright(upper * of_bucket(2), 32)
    rows = (
        pieces(docs, params)
        .withColumn("_bucket", _bucket(F.col("_length"), ends))
        .withColumn("_hash", F.xxhash64("_k1", "_k2", "_piece", F.lit(params.seed)))
        .withColumn("_cell", cell.cast("int"))
    )
    order = [F.col(name) for name in ("_cell", "_hash", "_k1", "_k2", "_piece")]
    ranked = global_rank(rows, order, "_rank", "_total", sum(n for _, _, n in dealt.values()))
    place = F.col("_rank") - of_bucket(0) - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(params.budget) / F.greatest(F.lit(1), "_bucket")))
    return ranked.select(
        "_k1",
        "_k2",
        "_id",
        "_piece",
        "_start",
        "_length",
        "_bucket",
        F.floor(place / fits).cast("bigint").alias("_batch"),
        (place % fits).cast("bigint").alias("_slot"),
        "_piece_text",
    )


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start`` and ``n_words`` (words of the text),
    ``bucket`` (padded length), ``batch`` and ``slot`` in it, ``padding``, ``row_key`` of the row
    it was cut from, and the piece's ``text``.
    """
    return packed_pieces(docs, params).select(
        F.col("_id").cast("bigint").alias("doc_id"),
        F.col("_piece").alias("piece"),
        F.col("_start").alias("start"),
        F.col("_length").alias("n_words"),
        F.col("_bucket").alias("bucket"),
        F.col("_batch").alias("batch"),
        F.col("_slot").alias("slot"),
        (F.col("_bucket") - F.col("_length")).alias("padding"),
        F.col("_k1").alias("row_key"),
        F.col("_piece_text").alias("text"),
    )
