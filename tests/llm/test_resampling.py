import math
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from basketry.llm import resampling
from basketry.llm.resampling import ResamplingParams, TokenHashes


def plain_features(text, buckets):
    hashes = [xxhash.xxh64_intdigest(t) for t in re.findall(r"\w+|[^\w\s]+", text.lower())]
    pairs = [
        (a * 0x9E3779B97F4A7C15 % 2**64) ^ (b >> 7) for a, b in zip(hashes, hashes[1:])
    ]
    return [h % buckets for h in hashes + pairs]


def good_ids(labels):
    return {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}


def test_weights_match_brute_force(spark, documents, plain):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good, buckets = good_ids(labels), 500
    raw, target = np.ones(buckets), np.ones(buckets)
    for doc, text, _ in plain:
        for x in plain_features(text, buckets):
            raw[x] += 1
            target[x] += doc in good
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    rows = resampling.resampled(documents, labels, ResamplingParams(buckets=buckets)).collect()
    got = {r["doc_id"]: r for r in rows}
    for doc, text, _ in plain:
        features = plain_features(text, buckets)
        assert got[doc]["n_features"] == len(features)
        assert math.isclose(got[doc]["log_weight"], sum(ratio[features]), abs_tol=1e-6)
    share = len(good) / labels.count()
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == math.ceil(len(rows) * share)
    assert min(r["noisy_weight"] for r in kept) >= max(
        [r["noisy_weight"] for r in rows if not r["kept"]], default=-math.inf
    )


def test_blocks_of_long_texts_join(monkeypatch):
    text = " ".join(f"word{i}, and" for i in range(500))
    monkeypatch.setattr(resampling, "BLOCK", 7)
    found = np.concatenate(list(resampling.features(text, 1000, TokenHashes())))
    assert sorted(found.tolist()) == sorted(plain_features(text, 1000))


def test_held_out_documents_are_told_apart(spark):
    """Fitted on four fifths of the labels, judged on the rest."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    rows = resampling.resampled(docs, labels.where(fold != 0))
    judged = rows.join(labels.where(fold == 0), "doc_id").collect()
    good = [r["log_weight"] for r in judged if r["quality"] == 1]
    bad = [r["log_weight"] for r in judged if r["quality"] == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.9


def test_gumbel_noise_is_gumbel(spark):
    noise = resampling.gumbel("id")
    mean, deviation = spark.range(1_000_000).agg(F.avg(noise), F.stddev(noise)).first()
    assert abs(mean - 0.5772) < 0.005 and abs(deviation - 1.2825) < 0.005


def test_awkward_rows_and_labels(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (5, 1, 0), (5, 0, 0), (6, 1, None), (None, 1, 0), (7, None, 0)],
        "doc_id LONG, quality INT, toxic INT",
    )
    rows = resampling.resampled(awkward, labels).collect()
    assert len(rows) == 14
    assert sum(r["kept"] for r in rows) == math.ceil(14 * 2 / 3)
    assert {r["log_weight"] for r in rows if r["n_features"] == 0} == {0.0}
    assert resampling.resampled(nothing, labels).count() == 0
    unlabelled = resampling.resampled(awkward, labels.limit(0)).collect()
    assert all(r["kept"] and r["log_weight"] == 0 for r in unlabelled)
