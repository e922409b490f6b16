from itertools import combinations

import numpy as np
import pytest
import xxhash

from basketry.llm import simhash
from basketry.llm.common import components


def expected_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42)
        for i in range(len(words) - size + 1)
    ]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def expected_groups(fps):
    """Smallest id reachable over links of at most four bits."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, f), (b, g) in combinations(fps, 2):
        if (f ^ g).bit_count() <= 4:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i, _ in fps}


def test_fingerprints_and_groups_match_brute_force(documents, plain):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    fps = [(i, expected_fingerprint(t)) for i, t, _ in plain]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps}
    assert {i: r["component_id"] for i, r in got.items()} == expected_groups(fps)


@pytest.mark.parametrize("bucket", [1 << 20, 100])
def test_links_connect_a_dense_group(spark, bucket):
    """Fingerprints around a centre, and others; small buckets force keys to be divided."""
    draw = np.random.default_rng(5)
    centre = int(draw.integers(0, 2**63))
    fps = {centre}
    for _ in range(150):
        flips = draw.choice(64, size=int(draw.integers(1, 7)), replace=False)
        fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps |= {int(x) for x in draw.integers(0, 2**63, 60)}
    signed = [(f - 2**64 if f >> 63 else f,) for f in sorted(fps)]
    frame = spark.createDataFrame(signed, "_fp LONG")
    links = simhash.links(frame, simhash.SimHashParams(bucket=bucket))
    hung = {r["node"]: r["root"] for r in components(links, "left", "right").collect()}
    got = {f: hung.get(f, f) for (f,) in signed}
    want = expected_groups([(f, f % 2**64) for (f,) in signed])
    assert len(set(got.values())) == len(set(want.values()))
    for (a,), (b,) in combinations(signed, 2):
        assert (got[a] == got[b]) == (want[a] == want[b])


def test_pivots_never_discard_a_link():
    pivots = [p % 2**64 for p in simhash.references(16)]
    draw = np.random.default_rng(1)
    for _ in range(300):
        x = int(draw.integers(0, 2**63))
        y = x ^ sum(1 << int(b) for b in draw.choice(64, size=4, replace=False))
        far = max(abs((x ^ p).bit_count() - (y ^ p).bit_count()) for p in pivots)
        assert far <= 4


def test_block_masks_hold_every_pair():
    masks = simhash.block_masks(0, 4)
    for bits in [(0, 20, 40, 63), (1, 2, 3, 4), (10, 30, 31, 50)]:
        changed = sum(1 << b for b in bits)
        assert any(not mask & changed for mask in masks)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    frame = spark.createDataFrame([*path, *star, (7, 7)], "a LONG, b LONG")
    got = {r["node"]: r["root"] for r in components(frame, "a", "b").collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 500 for i in range(501, 560)}}


def test_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 14
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in empty} == {2, 3, 4, None}
    assert {r["component_id"] for r in empty} == {2}
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    # One row stays of each group: the smallest id, null only where no other is left.
    nulls_last = [(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in awkward.collect()]
    fps = list(enumerate(expected_fingerprint(text) for *_, text in sorted(nulls_last)))
    firsts = sorted(sorted(nulls_last)[i][:2] for i in set(expected_groups(fps).values()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == firsts
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0


def one_bucket(rows, seed):
    """Distinct fingerprints that agree on two blocks, and near ones around some of them."""
    draw = np.random.default_rng(seed)
    fixed = simhash.block_masks(0, 4)[0]
    open_bits = [b for b in range(64) if not fixed >> b & 1]
    fps = {int(x) & ~fixed & (2**64 - 1) for x in draw.integers(0, 2**64, rows, dtype=np.uint64)}
    for f in list(fps)[: rows // 50]:
        for _ in range(3):
            flips = draw.choice(open_bits, size=int(draw.integers(1, 6)), replace=False)
            f ^= sum(1 << int(b) for b in flips)
            fps.add(f)
    return sorted(fps)


def near_pairs(fps, distance=4):
    """All links, comparing every fingerprint with every other."""
    array = np.array(fps, np.uint64)
    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= distance):
            yield fps[i], fps[int(j)]


def connected(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_a_large_bucket_is_divided_and_loses_no_link(spark):
    """20,000 fingerprints meet under one key, five times what a task takes."""
    fps = one_bucket(20_000, 8)
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "_fp LONG")
    params = simhash.SimHashParams()
    assert len(fps) > 4 * params.bucket
    found = [(r["left"] % 2**64, r["right"] % 2**64) for r in simhash.links(frame, params).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert connected(found, fps) == connected(near_pairs(fps), fps)


def test_pivots_discard_most_pairs_of_a_bucket():
    """With sixteen pivots over nine of ten unrelated pairs go without a look at their bits."""
    fps = np.array(one_bucket(2_000, 9), np.uint64)
    pivots = np.array([p % 2**64 for p in simhash.references(16)], np.uint64)
    far = np.bitwise_count(fps[:, None] ^ pivots).astype(np.int16)
    kept = sum(int(simhash.pivots_allow(far[:i], far[i], 4).sum()) for i in range(len(fps)))
    share = 1 - kept / (len(fps) * (len(fps) - 1) / 2)
    assert share > 0.9
    near = sum(1 for _ in near_pairs(fps.tolist()))
    assert kept >= near
    print(f"pivots discard {share:.4f} of the pairs")
