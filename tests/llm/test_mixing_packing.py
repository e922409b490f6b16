from collections import Counter, defaultdict
from itertools import combinations

import pytest

from basketry.llm import mixing, packing
from basketry.llm.mixing import MixParams, apportion
from basketry.operators.ranks import number, ranked


def one_by_one(votes, seats, limits):
    held = [0] * len(votes)
    for _ in range(seats):
        able = [i for i in range(len(votes)) if held[i] < limits[i] and votes[i] > 0]
        best = max(able, key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
        held[best] += 1
    return held


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 333])
@pytest.mark.parametrize(
    "votes", [[5, 2, 1], [100.0, 99.5, 0.5, 3, 3, 3], [1] * 9, [1000, 1, 1, 1, 0]]
)
def test_apportionment_equals_one_seat_at_a_time(votes, seats):
    for limits in ([10**9] * len(votes), [seats // 2 + 1] * len(votes)):
        most = sum(n for n, v in zip(limits, votes) if v > 0)
        assert apportion(votes, seats, limits) == one_by_one(votes, min(seats, most), limits)


def expected_targets(sizes, weights):
    out, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        shares = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if shares[i] > 2 * sizes[i]}
        if not over:
            for i in open_:
                out[i] = shares[i]
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def check_mix(docs, rows, tolerance):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.encode().split())
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    targets = dict(
        zip(names, expected_targets([sizes[n] for n in names], mixing.cyclic_weights(len(names))))
    )
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["_source_size"] == sizes[r["_source"]]
        assert abs(r["_target"] - targets[r["_source"]]) < 1e-6 * max(1, targets[r["_source"]])
        assert 0 <= r["_taken"] <= 2 * r["_size"]
        taken[r["_source"]] += r["_taken"]
    for name in names:
        assert abs(taken[name] - targets[name]) <= tolerance
    again = mixing.mixed(docs).collect()
    key = lambda r: (r["_id"] or 0, r["_size"], r["_taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_sources_come_near_their_targets(documents, plain):
    check_mix(documents, plain, 40)


def test_mixture_has_the_words_that_were_counted(documents):
    counted = {(r["_id"]): r["_taken"] for r in mixing.mixed(documents).collect()}
    texts = defaultdict(list)
    for r in mixing.mix(documents).collect():
        texts[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for doc, taken in counted.items():
        assert sum(len(t.encode().split()) for t in texts.get(doc, [])) == taken


def test_small_shards_and_blocks_split_a_source(spark):
    rows = [(i, f"w{i} " * (i % 50 + 1), "big" if i % 3 else "small") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    params = MixParams(shard_words=500, most_shards=16)
    got = mixing.mixed(docs, params).collect()
    words = {"big": 0, "small": 0}
    for r in got:
        assert r["_taken"] <= 2 * r["_size"]
        words[r["_source"]] += r["_taken"]
    for r in got:
        assert abs(words[r["_source"]] - r["_target"]) <= 16 * 17


def test_mix_of_awkward_rows(awkward, nothing):
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    assert {r["_taken"] for r in mixing.mixed(awkward).collect() if r["_size"] == 0} == {0}
    assert None in {r["source"] for r in out.collect()}
    assert mixing.mix(nothing).count() == 0


def test_boundaries_have_the_least_padding():
    lengths, counts = [0, 1, 3, 4, 9, 10, 30, 31, 64, 200], [3, 9, 1, 7, 2, 8, 4, 4, 1, 2]
    for buckets in range(1, 12):
        ends, padding = packing.best_boundaries(lengths, counts, buckets)
        cost = lambda e: sum(c * (min(x for x in e if x >= n) - n) for n, c in zip(lengths, counts))
        size = min(buckets, len(lengths))
        best = min(cost((*inner, 200)) for inner in combinations(lengths[:-1], size - 1))
        assert padding == best == cost(ends) and ends[-1] == 200 and len(ends) <= buckets


def test_every_word_is_packed_once(documents, plain):
    params = packing.PackParams(longest=200, buckets=5, budget=1000)
    rows = packing.pack(documents, params).collect()
    pieces, batches = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n_words"]))
        batches[r["bucket"], r["batch"]].append(r)
        assert r["n_words"] <= min(200, r["bucket"]) and r["padding"] == r["bucket"] - r["n_words"]
    for doc, text, _ in plain:
        at = 0
        for start, size in sorted(pieces[doc]):
            assert start == at
            at += size
        assert at == len(text.encode().split())
    last = {}
    for (bucket, batch), found in batches.items():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
        assert len(found) * bucket <= 1000
        last[bucket] = max(last.get(bucket, 0), batch)
    for (bucket, batch), found in batches.items():
        if batch < last[bucket]:
            assert len(found) == 1000 // bucket
    ends = sorted({r["bucket"] for r in rows})
    lengths = Counter(r["n_words"] for r in rows)
    best, padding = packing.best_boundaries(sorted(lengths), [lengths[x] for x in sorted(lengths)], 5)
    assert ends == best and sum(r["padding"] for r in rows) == padding


def test_pack_of_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward, packing.PackParams(longest=4096)).collect()
    assert Counter(r["doc_id"] for r in rows)[7] == 8 and Counter(r["doc_id"] for r in rows)[2] == 1
    assert sum(r["n_words"] for r in rows if r["doc_id"] == 7) == 30_000
    assert packing.pack(nothing).count() == 0


def test_pieces_carry_the_text_of_their_row(spark, documents, awkward):
    """Two rows of one id stay apart, and joined pieces are the text, blanks included."""
    copies = [(1, "a b  c\n d e "), (1, "c\n d"), (2, " \n\t "), (3, None), (4, "\n x y z"), (5, "q  ")]
    own = spark.createDataFrame(copies, "doc_id LONG, text STRING")
    for docs, longest in ((own, 2), (documents, 200), (awkward, 4096)):
        rows = defaultdict(list)
        for r in packing.pack(docs, packing.PackParams(longest=longest)).collect():
            assert len(r["text"].encode().split()) == r["n_words"]
            rows[r["doc_id"], r["row_key"]].append((r["piece"], r["text"]))
        found = []
        for (doc, _), parts in rows.items():
            times = Counter(piece for piece, _ in parts)[0]  # of a repeated row
            for _ in range(times):
                found.append((doc, "".join(text for _, text in sorted(parts)[::times])))
        want = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)


def test_cells_hold_equal_words(spark, monkeypatch):
    """Few long and many short texts, a third of the rows copies: no task holds twice the mean."""
    docs = spark.range(6000).selectExpr(
        "id AS doc_id",
        "CASE WHEN id % 3 = 0 THEN repeat('copy ', 20) "
        "WHEN id % 30 = 1 THEN repeat(concat('w', id, ' '), 900) "
        "ELSE repeat(concat('v', id, ' '), CAST(1 + id % 40 AS INT)) END AS text",
        "'a' AS source",
    )
    seen = {}

    def watch(rows, order, rank, total, cells):
        seen.update(numbered=number(rows, order, cells), cells=cells)
        return ranked(seen["numbered"], rank, total)

    monkeypatch.setattr(packing, "global_rank", watch)
    params = packing.PackParams(longest=1000, buckets=6, budget=4000, cell_words=8000)
    rows = packing.pack(docs, params).collect()
    parts = defaultdict(int)
    for r in seen["numbered"].select("_part", "_cell", "_length").collect():
        assert r["_part"] == r["_cell"] < seen["cells"]
        parts[r["_part"]] += r["_length"] + packing.ROW_WORDS
    assert len(parts) > 30
    assert max(parts.values()) < 2 * sum(parts.values()) / len(parts)
    for bucket in {r["bucket"] for r in rows}:
        inside = sorted((r["batch"], r["slot"]) for r in rows if r["bucket"] == bucket)
        fits = max(1, params.budget // max(1, bucket))
        assert inside == [divmod(i, fits) for i in range(len(inside))]


def test_cells_are_bounded():
    """At any size there are few tasks more than asked for, and each bucket has one."""
    params = packing.PackParams(cell_words=100, most_cells=50)
    for scale in (1, 10**3, 10**9):
        dealt = packing.cells([0, 5, 90], [scale * 7, scale, scale * 2], [0, 5, 90], 4, params)
        assert [row for row, _, _ in dealt.values()] == [0, scale * 7, scale * 8]
        many = [n for _, _, n in dealt.values()]
        assert min(many) >= 1 and 4 <= sum(many) <= 50 + 3
    assert packing.cells([0], [0], [0], 4, params)[0][:2] == (0, 0)
