"""The manifest against a tree built in plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm import catalog, manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "_tree long, _idx long, _n long, digest string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def path(levels, index, arity):
    out = []
    for nodes in levels[:-1]:
        first = index // arity * arity
        out.append((nodes[first:index], nodes[index + 1 : first + arity]))
        index //= arity
    return out


def expected(rows, arity=16):
    by = defaultdict(list)
    for row in rows:
        by[row["source"]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
        by[source].sort(key=order)
        trees[source] = tree([leaf(r) for r in by[source]], arity)
    above = tree([trees[s][-1][0] for s in sources], arity)
    root = above[-1][0] if sources else None
    for number, source in enumerate(sources):
        for index, row in enumerate(by[source]):
            steps = path(trees[source], index, arity) + path(above, number, arity)
            changed = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                changed["text"] = lower(row["text"])
            node = leaf(changed)
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*(d for left, right in steps for d in left + right))
            yield (row["doc_id"], leaf(row), trees[source][-1][0], root, proof, node, node == root)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_every_proof_equals_a_plain_tree(documents, arity):
    params = manifest.ManifestParams(arity=arity)
    rows = manifest.verified(documents, params, text=manifest.lower_one_in_five()).collect()
    want = list(expected([r.asDict() for r in documents.collect()], arity))
    assert Counter(map(tuple, rows)) == Counter(want)
    assert {r["verified"] for r in rows} == {True, False}


def test_nulls_ties_repeats_and_clashing_columns(awkward):
    rows = manifest.verified(awkward, text=manifest.lower_one_in_five()).collect()
    want = list(expected([r.asDict() for r in awkward.select(*FIELDS).collect()]))
    assert Counter(map(tuple, rows)) == Counter(want)
    # A null text and an empty one have different leaves.
    leaves = {r["doc_id"]: r["leaf"] for r in rows}
    assert leaves[2] != leaves[3]


def test_an_unchanged_table_verifies_and_any_changed_field_does_not(documents):
    assert manifest.verified(documents).where(~F.col("verified")).isEmpty()
    renamed = manifest.verified(documents, lang=F.lit("xx"))
    assert renamed.where("verified").isEmpty()


def test_a_table_without_rows_and_one_with_a_single_row(nothing, documents):
    assert manifest.verified(nothing).collect() == []
    (row,) = manifest.verified(documents.where("doc_id = 3")).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("size,arity", [(1, 16), (16, 16), (17, 16), (33, 16), (5, 2)])
def test_levels_of_a_tree(spark, size, arity):
    digests = [digest(str(i)) for i in range(size)]
    nodes = spark.createDataFrame([(1, i, size, d) for i, d in enumerate(digests)], NODE)
    levels = manifest.grow(nodes, arity, "levels")
    want = tree(digests, arity)
    got = [[r["digest"] for r in level.orderBy("_idx").collect()] for level in levels]
    assert got == want


def test_siblings_of_a_binary_tree_are_found_by_xor(spark):
    frame = spark.range(0, 10, 2).select("id", manifest.sibling_index(F.col("id"), F.lit(1), 2).alias("s"))
    assert all(r["s"] == r["id"] ^ 1 for r in frame.collect())


def test_the_query_returns_the_contract_columns(spark):
    frame = catalog.QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert dict(frame.dtypes) == {
        "doc_id": "bigint",
        **dict.fromkeys(
            ("leaf", "subroot", "root", "proof_sha256", "folded_root"), "string"
        ),
        "verified": "boolean",
    }
