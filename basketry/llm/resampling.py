"""Importance resampling: which documents look like the target more than like the rest.

Word and word-pair counts, hashed into a fixed number of buckets, make two generative models: one
of labelled good documents, one of all documents. A document's log weight is the sum of the log
ratios of its features. Adding seeded Gumbel noise and keeping the ``k`` largest sums draws ``k``
documents without replacement in proportion to their weights.

The raw model counts every document. The target model is fitted on at most ``most_labelled`` good
documents, chosen by the hash of their id; ``k`` is the labelled good share of all rows, or
``share`` if given. Labels that contradict each other count as bad. Null and empty texts have no
features and the weight 0; null ids are unlabelled. Equal sums are told apart by the row's hashes;
repeated rows tie, and any of them may be drawn. Without good labels both models are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import identity, ship, text_of
from basketry.operators.ranks import global_rank

ship(__name__)

TOKEN = re.compile(r"\w+|[^\w\s]+")
BLANK = re.compile(r"\s")
#: Characters of a text that are taken apart at a time, up to the next blank.
BLOCK = 1_000_000


@dataclass(frozen=True)
class ResamplingParams:
    buckets: int = 10_000
    smoothing: float = 1.0
    most_labelled: int = 20_000
    share: float | None = None
    seed: int = 1


class TokenHashes(dict):
    """Hashes of tokens, so that a frequent one is hashed once; emptied when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[token] = xxhash.xxh64_intdigest(token)
        return out


def features(text: str, buckets: int, known: TokenHashes) -> Iterator[np.ndarray]:
    """Buckets of the tokens and token pairs of a text, in blocks of bounded size."""
    lower, at = text.lower(), 0
    last = np.zeros(0, np.uint64)
    while at < len(lower):
        # Tokens hold no blanks, so a block ends at one.
        border = BLANK.search(lower, at + BLOCK)
        end = border.start() if border else len(lower)
        block, at = TOKEN.findall(lower, at, end), end
        if not block:
            continue
        one = np.fromiter(map(known.__getitem__, block), np.uint64, len(block))
        chain = np.concatenate([last, one])
        two = (chain[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (chain[1:] >> np.uint64(7))
        last = one[-1:]
        yield np.concatenate([one, two]) % np.uint64(buckets)


def bucket_counts(docs: DataFrame, good: str, params: ResamplingParams) -> DataFrame:
    """``bucket, raw, target``: counts summed per task first, so as many rows as buckets a task."""
    buckets = params.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1)):
                for block in features(text.as_py(), buckets, known):
                    counts = np.bincount(block.astype(np.int64), minlength=buckets)
                    sums[0] += counts
                    if is_good.as_py():
                        sums[1] += counts
        seen = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(sums[0][seen]), pa.array(sums[1][seen])],
            names=["bucket", "raw", "target"],
        )

    return (
        docs.select("_text", good)
        .mapInArrow(run, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: list[tuple[int, int, int]], params: ResamplingParams) -> np.ndarray:
    """Log of target over raw probability per bucket, both smoothed."""
    table = np.zeros((2, params.buckets))
    for bucket, raw, target in counts:
        table[:, bucket] = raw, target
    if not table[1].any():
        return np.zeros(params.buckets)
    smooth = table + params.smoothing
    raw, target = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    return target - raw


def scored(docs: DataFrame, ratios: np.ndarray, params: ResamplingParams) -> DataFrame:
    """``docs`` (with ``_text``) with ``n_features`` and ``log_weight`` in place of the text."""
    buckets = params.buckets
    kept = [name for name in docs.columns if name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenHashes()
        for batch in batches:
            sizes, sums = [], []
            for text in batch.column("_text"):
                size, total = 0, 0.0
                for block in features(text.as_py(), buckets, known):
                    size += len(block)
                    total += float(ratios[block.astype(np.int64)].sum())
                sizes.append(size)
                sums.append(total)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.float64())],
                names=[*kept, "n_features", "log_weight"],
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{name} {kinds[name]}" for name in kept)
    return docs.mapInArrow(run, f"{schema}, n_features long, log_weight double")


def gumbel(*columns: str | Column) -> Column:
    """Standard Gumbel noise from a hash: the same row always gets the same."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double")
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def resampled(
    docs: DataFrame, labels: DataFrame, params: ResamplingParams = ResamplingParams()
) -> DataFrame:
    """``doc_id, n_features, log_weight, noisy_weight, kept``: one row per document row."""
    judged = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(
            ((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good")
        )
        .where("good IS NOT NULL")
    )
    # At most ``most_labelled`` ids are sent to the executors.
    sample = (
        judged.where("good")
        .orderBy(F.xxhash64("doc_id", F.lit(params.seed)), "doc_id")
        .limit(params.most_labelled)
        .select(F.col("doc_id").alias("_good_id"))
    )
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        *identity("doc_id", "text"),
        text_of().alias("_text"),
    )
    marked = rows.join(
        F.broadcast(sample), F.col("doc_id") == F.col("_good_id"), "left"
    ).withColumn("_good", F.col("_good_id").isNotNull())
    counts = bucket_counts(marked, "_good", params).collect()
    ratios = log_ratios([tuple(row) for row in counts], params)
    share = params.share
    if share is None:
        share = judged.agg(F.avg(F.col("good").cast("int"))).first()[0]
        share = 1.0 if share is None else share
    noisy = scored(rows, ratios, params).withColumn(
        "noisy_weight", F.col("log_weight") + gumbel("_k1", "_k2", F.lit(params.seed))
    )
    ranked = global_rank(noisy, [F.col("noisy_weight").desc(), F.col("_k1"), F.col("_k2")])
    return ranked.select(
        "doc_id",
        "n_features",
        "log_weight",
        "noisy_weight",
        (F.col("rank") <= F.ceil(F.col("total_rows") * F.lit(float(share)))).alias("kept"),
    )
