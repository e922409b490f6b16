"""SimHash near-duplicates, found with pivot distance tables.

Fingerprints link when at most ``distance`` of their 64 bits differ. Distances from every distinct
fingerprint to fixed reference fingerprints are computed once. Two fingerprints whose distances to
any reference differ by more than ``distance`` cannot link, which the largest coordinate
difference decides before the bits themselves are compared.

A pivot table alone would have to look at all pairs: one coordinate keeps over half of unrelated
ones. Fingerprints therefore meet in buckets first: 64 bits are cut in ``distance + 2`` blocks, so
that two linked fingerprints agree on two blocks at least, and every pair of blocks is one key.
A bucket that is too large for one task is divided by the same rule over the bits its key leaves
open. This is exact, and it ends: 2**n fingerprints at most agree on all but n bits. In a bucket,
links are followed from one fingerprint to those not reached yet, so a group of near copies costs
a tree of links, not all its pairs.

Null and empty texts have the fingerprint zero and link like any other. Repeated rows share a
fingerprint. A null ``doc_id`` never names a component unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import (
    components,
    identity,
    packed,
    ship,
    text_of,
    unpacked,
)
from basketry.sources.storage import stage

ship(__name__)

BITS = 64


@dataclass(frozen=True)
class SimHashParams:
    """``words`` per shingle and the most differing bits of a link; ``pivots`` (a multiple of
    eight) and ``bucket`` set how links are searched, not which are found.
    """

    words: int = 4
    distance: int = 4
    pivots: int = 16
    bucket: int = 4_096
    seed: int = 42


def shingle_hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, in blocks of bounded size."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    ends = ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 100_000):
        spans = zip(starts[at : at + 100_000].tolist(), ends[at : at + 100_000].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")


def fingerprint(text: bytes, size: int, seed: int) -> int:
    """A bit is set if more than half of the shingle hashes have it."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, size, seed):
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``_k1, _k2, doc_id, _fp`` of every row; the identity is over all columns but maps."""
    size, seed = params.words, params.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), size, seed) for t in batch.column("_bytes")]
            columns = [batch.column(i) for i in range(3)] + [pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["_k1", "_k2", "doc_id", "_fp"])

    narrow = packed(docs).select(
        "_k1", "_k2", F.col("_id").cast("bigint"), F.col("_text").cast("binary").alias("_bytes")
    )
    return narrow.mapInArrow(run, "_k1 long, _k2 long, doc_id long, _fp long")


def references(count: int) -> list[int]:
    """Reference fingerprints: hashes of 0, 1, 2, ... as signed longs."""
    digests = [xxhash.xxh64_intdigest(i.to_bytes(8, "little")) for i in range(count)]
    return [d - (1 << BITS) if d >> 63 else d for d in digests]


def pivot_table(fps: DataFrame, params: SimHashParams) -> DataFrame:
    """Distances to the references, one byte each, eight to a long: ``_fp, _p0, _p1, ...``"""
    pivots = references(params.pivots)

    def eight(part: list[int]) -> Column:
        out = F.lit(0).cast("bigint")
        for place, pivot in enumerate(part):
            far = F.bit_count(F.col("_fp").bitwiseXOR(F.lit(pivot))).cast("bigint")
            out = out.bitwiseOR(F.shiftleft(far, 8 * place))
        return out

    return fps.select(
        "_fp",
        *(eight(pivots[i : i + 8]).alias(f"_p{i // 8}") for i in range(0, params.pivots, 8)),
    )


def block_masks(known: int, distance: int) -> list[int]:
    """Masks that add two blocks of the bits outside ``known``; linked pairs agree on one."""
    free = [bit for bit in range(BITS) if not known >> bit & 1]
    cuts = np.linspace(0, len(free), distance + 3).astype(int)
    blocks = [sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:])]
    return sorted({known | a | b for a, b in combinations(blocks, 2)})


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> 63 else mask


def bucketed(table: DataFrame, params: SimHashParams) -> DataFrame:
    """Fingerprints with the keys under which they meet; no bucket is over the limit unless its
    key leaves so few bits open that it is bounded by them.
    """
    first = [_signed(m) for m in block_masks(0, params.distance)]
    rows = table.withColumn("_mask", F.explode(F.lit(first).cast("array<bigint>")))
    rows = rows.withColumn("_key", F.col("_fp").bitwiseAND(F.col("_mask")))
    done = None
    while True:
        sizes = rows.groupBy("_mask", "_key").agg(F.count(F.lit(1)).alias("_n"))
        large = stage(sizes.where(F.col("_n") > params.bucket), "large-buckets")
        masks = [row[0] for row in large.select("_mask").distinct().collect()]
        finer = {}
        for mask in masks:  # as many as there are masks on a level, whatever the input
            open_bits = BITS - int(mask % (1 << BITS)).bit_count()
            if open_bits > params.distance + 2 and 1 << open_bits > params.bucket:
                finer[mask] = [_signed(m) for m in block_masks(mask % (1 << BITS), params.distance)]
        large = large.where(F.col("_mask").isin([*finer]))
        if not finer:
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, ["_mask", "_key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        table_of = F.create_map(
            *(F.lit(x) for mask, parts in finer.items() for x in (mask, parts))
        )
        rows = rows.join(large.select("_mask", "_key"), ["_mask", "_key"], "left_semi")
        rows = rows.withColumn("_mask", F.explode(F.element_at(table_of, F.col("_mask"))))
        rows = rows.withColumn("_key", F.col("_fp").bitwiseAND(F.col("_mask")))
        rows = stage(rows, "divided-buckets")


def pivots_allow(far: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of pivot distances differ from another in no coordinate by more than that."""
    return np.abs(far - own).max(axis=1, initial=0) <= distance


def bucket_links(fps: np.ndarray, far: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what can be connected in one bucket: at most one less than its rows.

    ``far`` holds the pivot distances. Rows are sorted by the first, so a slice has all that may
    link; the largest difference over the other pivots discards most, and bits decide the rest.
    """
    if len(fps) == 2:
        near = pivots_allow(far[:1], far[1], distance)[0]
        near = near and int(fps[0] ^ fps[1]).bit_count() <= distance
        return [(int(fps[0]), int(fps[1]))] if near else []
    order = np.argsort(far[:, 0], kind="stable")
    fps, far = fps[order], far[order]
    column = far[:, 0]
    lows = np.searchsorted(column, column - distance)
    highs = np.searchsorted(column, column + distance, side="right")
    links, waits = [], np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not waits[start]:
            continue
        waits[start] = False
        reached = [start]
        while reached:
            x = reached.pop()
            some = lows[x] + np.flatnonzero(waits[lows[x] : highs[x]])
            some = some[pivots_allow(far[some], far[x], distance)]
            some = some[np.bitwise_count(fps[some] ^ fps[x]) <= distance]
            links += [(int(fps[x]), int(fps[y])) for y in some]
            reached += some.tolist()
            waits[some] = False
    return links


def links(fps: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``left, right``: links between distinct fingerprints ``_fp`` that connect all linked ones."""
    table = stage(pivot_table(fps, params), "pivots")
    width, distance = params.pivots // 8, params.distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(parts[:, :2], axis=0) != 0).any(axis=1)) + 1
            cuts = np.concatenate([[0], cuts, [len(parts)]])
            out = []
            for i in np.flatnonzero(np.diff(cuts) > 1):
                rows = parts[cuts[i] : cuts[i + 1]]
                far = np.ascontiguousarray(rows[:, 3:]).view(np.uint8).astype(np.int16)
                out += bucket_links(rows[:, 2].astype(np.uint64), far, distance)
            pairs = np.array(out, np.uint64).reshape(-1, 2).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left", "right"]
            )

        held = np.zeros((0, 3 + width), np.int64)
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            held = np.concatenate([held, rows])
            # The last bucket may go on in the next batch.
            same = (held[:, :2] == held[-1, :2]).all(axis=1) if len(held) else held[:0, 0]
            cut = len(held) - int(same.sum())
            yield found(held[:cut])
            held = held[cut:]
        yield found(held)

    pivots = [f"_p{i}" for i in range(width)]
    return (
        bucketed(table, params)
        .select("_mask", "_key", "_fp", *pivots)
        .repartition("_mask", "_key")
        .sortWithinPartitions("_mask", "_key")
        .mapInArrow(run, "left long, right long")
    )


def grouped(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``_k1, _k2, doc_id, _fp, component_id``: one row per document row."""
    rows = stage(fingerprints(docs, params), "fingerprints")
    fps = stage(rows.groupBy("_fp").agg(F.min("doc_id").alias("_first")), "distinct")
    hung = components(links(fps.select("_fp"), params), "left", "right")
    roots = fps.join(hung, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root")
    )
    roots = stage(roots, "roots")
    names = roots.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rows.join(roots.join(names, "_root").select("_fp", "_root", "component_id"), "_fp")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``doc_id, fingerprint`` (hex) and ``component_id``, one row per document row."""
    return grouped(docs, params).select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """The document with the smallest id of every group, in the columns of ``docs``.

    Ids that tie, null ones included, are told apart by the hash of the row; of repeated rows one
    stays.
    """
    groups = grouped(docs, params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2"))
    stays = groups.groupBy("_root").agg(first.alias("_s")).select("_s._k1", "_s._k2")
    rows = packed(docs).join(stays, ["_k1", "_k2"], "left_semi")
    return unpacked(
        rows.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row")), docs.columns
    )
