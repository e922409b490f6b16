"""Links of embeddings against all cosines of a label."""

import math

import numpy as np
import pytest

from basketry.llm import vector_links
from basketry.llm.vector_links import LinkParams

ROW = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, _k1 STRING, node LONG"


def expected(rows, limit=0.98):
    """(vec_id, n_links, component_id) by looking at all pairs."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            return None
        v = np.array(v, float)
        return None if not v.any() else v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())

    units = [None if label is None else unit(v) for _, v, label in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(units):
        for j, b in enumerate(units[:i]):
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b >= limit:
                    links[i].add(j)
                    links[j].add(i)
    out, root = [], list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return out


def near_groups(seed, labels=3, groups=12, size=9, width=24, noise=0.03):
    """Random vectors, and groups of copies with noise around some of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        for _ in range(groups):
            center = rng.normal(size=width)
            center /= np.linalg.norm(center)
            for k in range(rng.integers(1, size)):
                v = center + noise * rng.normal(size=width) * (k > 0)
                rows.append((len(rows), v.astype(np.float32).tolist(), label))
    return rows


def found(spark, rows, params=LinkParams()):
    frame = spark.createDataFrame([(i, v, x, "k", 1) for i, v, x in rows], ROW)
    return [tuple(r) for r in vector_links.linked(frame, params).collect()]


def by_value(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(
    "params",
    [
        LinkParams(),
        LinkParams(lists=12, block=4),
        LinkParams(lists=5, subspaces=3, codewords=4, sample=64),
        LinkParams(lists=1, block=7),
    ],
)
def test_every_link_is_found_whatever_the_lists_and_blocks(spark, params):
    rows = near_groups(1)
    got = found(spark, rows, params)
    assert by_value((i, n, c) for i, n, c, _ in got) == by_value(expected(rows))
    assert sum(n for _, n, _, _ in got) > 100
    assert all(kept == (i == c) for i, _, c, kept in got)


def test_half_the_margin_finds_nine_links_of_ten(spark):
    rows = near_groups(2, noise=0.035)
    half = found(spark, rows, LinkParams(lists=12, margin=0.5))
    every = sum(n for _, n, _ in expected(rows))
    assert 0.9 * every <= sum(n for _, n, _, _ in half) <= every


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 7),
        (1, v, 7),  # a repeated row
        (2, [2.0, 4.0, 6.0], 7),  # the same direction
        (3, v, 8),
        (4, v, None),
        (5, None, 7),
        (6, [], 7),
        (7, [0.0, 0.0, 0.0], 7),
        (8, [1.0, None, 3.0], 7),
        (9, [1.0, float("nan"), 3.0], 7),
        (10, [1.0, float("inf"), 3.0], 7),
        (None, v, 7),
        (None, v, 9),
        (11, [1.0, 2.0], 7),
        (12, [1.0, 2.0, 3.0, 0.0], 7),
        (13, [1e-38, 2e-38, 3e-38], 7),
        (14, [1e38, 2e38, 3e38], 7),
    ]
    got = found(spark, rows)
    assert by_value((i, n, c) for i, n, c, _ in got) == by_value(expected(rows))
    # The group without any id keeps its row.
    assert (None, 0, None, True) in got


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = near_groups(3) + [(1000 + i, [1.0] * 24, 1) for i in range(60)]
    got = found(spark, rows, LinkParams(lists=8, block=8))
    assert by_value((i, n, c) for i, n, c, _ in got) == by_value(expected(rows))


def test_a_chain_of_links_is_one_component(spark):
    angle = math.acos(0.985)
    rows = [(50 - k, [math.cos(k * angle), math.sin(k * angle)], 1) for k in range(30)]
    got = found(spark, rows, LinkParams(lists=6, block=4))
    assert by_value((i, n, c) for i, n, c, _ in got) == by_value(expected(rows))


def test_a_table_without_rows_or_usable_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 2)]) == [(1, 0, 1, True)]


def test_lists_prune_and_codes_discard(spark):
    """The probes and look-ups leave out most of what cannot link, and nothing that does."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(2000, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    params = LinkParams()
    book = vector_links.fit(rows, 32, params)
    own, probed = vector_links.probes(rows, book, params.reach)
    assert probed.sum(axis=1).mean() < 0.5 * 32
    codes, rest = vector_links.encode(rows - book.centroids[own], book)
    stored = own == 3
    maybe = vector_links.close(rows - book.centroids[3], codes[stored], rest[stored], book, params.reach)
    exact = rows @ rows[stored].T >= params.cosine
    assert not (exact & ~maybe).any()
    assert maybe.mean() < 0.05
