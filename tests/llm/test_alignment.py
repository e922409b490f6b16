"""Alignment of two tokenizers against whole texts encoded and compared one by one."""

import bisect
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basketry.llm import alignment
from basketry.llm.alignment import AlignParams, PerfectHash

PARAMS = AlignParams(
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
    public_tokenizers.path("piece_bpe_32k.model"),
)

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in PRINTED]
BYTE_OF = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(HIDDEN)}


def piece_bytes(i):
    piece = B.id_to_piece(i)
    if re.fullmatch("<0x..>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def places(parts):
    at, out = 0, []
    for part in parts:
        at += len(part)
        out.append(at)
    return out


def groups_of(text):
    """(ids of A, ids of B) of every group; None without tokens."""
    if not text:
        return None
    encoded = A.encode(" " + text, add_special_tokens=False)
    a, b = encoded.ids, B.encode(text)
    a_parts = [bytes(BYTE_OF[c] for c in t) for t in encoded.tokens]
    b_parts = [piece_bytes(i) for i in b]
    data = (" " + text).encode()
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None
    a_ends, b_ends = places(a_parts), places(b_parts)
    common = sorted(set(a_ends) & set(b_ends))
    groups = [([], []) for _ in common]
    for side, ids, ends in ((0, a, a_ends), (1, b, b_ends)):
        for i, end in zip(ids, ends):
            groups[bisect.bisect_left(common, end)][side].append(i)
    return groups


def expected(rows):
    every, counts, best = [], Counter(), defaultdict(int)
    for doc_id, text in rows:
        groups = groups_of(text)
        links = [(x, y) for a, b in groups or [] for x in a for y in b]
        counts.update(set(links))
        every.append((doc_id, groups, links))
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for doc_id, groups, links in every:
        if groups is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            doc_id,
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            len(links),
            sum(counts[x] == best[x[0]] for x in links),
            sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest(),
        )


def check(docs, params=PARAMS):
    got = Counter(map(tuple, alignment.alignments(docs, params).collect()))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got == Counter(expected(rows))
    return got


def test_documents(documents):
    assert len(check(documents)) == documents.count()


def test_small_blocks_buckets_and_a_deep_tree(documents):
    small = dict(block_bytes=1 << 15, buckets=7, fan_in=2, requests=1, words=500)
    check(documents, AlignParams(PARAMS.a_ranks, PARAMS.pattern, PARAMS.b_model, **small))


def test_awkward_rows(awkward):
    check(awkward)


def test_a_table_without_rows_or_tokens(spark, nothing, awkward):
    assert alignment.alignments(nothing, PARAMS).collect() == []
    rows = alignment.alignments(awkward.where("doc_id IN (2, 3)"), PARAMS).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 2


TEXTS = [
    " ", "  ", "a ", " a", "a  b", "a \n b", "\n", "\n\n a", "tab\t x", "x  y", "x　 y\x1c z",
    "a▁b c", "▁", "<|endoftext|> </s> <s> <unk>", "naïve 中文 \U0001f600\U0001f469‍\U0001f4bb x",
    "a\x00b c", "don't we'll 123 4567", "x" * 5000, "aa " * 3000, "é" * 700, "\x85 \x85", "é ﻿",
    "trailing\n", "​ ᠎ a", "½ ﬁ ① ㎏",
]


def test_texts_with_odd_blanks_and_signs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    check(spark.createDataFrame(rows, "doc_id LONG, text STRING"))


def test_words_tokenize_as_in_their_text():
    """Words behind a blank that follows no white space have the tokens they have in the text."""
    both = alignment.Aligner(PARAMS)
    rng = np.random.default_rng(0)
    signs = [" ", " ", "  ", "\n", "\t", "a", "The", "é", "中", "　", "1", "'s", "!", "\x1c", "\x85", "ing"]
    texts = ["".join(rng.choice(signs, 30)) for _ in range(400)] + TEXTS
    numbers, ends, groups = both.words(pa.array(texts))
    start, parts = 0, groups.to_pylist()
    for text, end in zip(texts, ends.tolist()):
        want = groups_of(text)
        written = ";".join(
            ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want or []
        )
        assert "".join(parts[start:end]).rstrip(";") == written, repr(text)
        start = end


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_survives_writing(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.int64)
    made = PerfectHash.load(*PerfectHash.build(keys).dump())
    assert sorted(made.places(keys).tolist()) == list(range(n))


def test_a_pair_that_was_not_hashed_is_noticed():
    keys = np.arange(100, dtype=np.int64)
    made = PerfectHash.build(keys)
    stored = np.empty_like(keys)
    stored[made.places(keys)] = keys
    sizes, bits = made.dump()
    row = {"sizes": sizes, "bits": bits, "keys": stored.tobytes()}
    with pytest.raises(RuntimeError, match="no place"):
        alignment.place_known(np.arange(1000, 1100), row)


def test_the_table_of_pairs(documents):
    pairs = alignment.frequent_pairs(documents, PARAMS).collect()
    counts = Counter()
    for r in documents.collect():
        counts.update({(x, y) for a, b in groups_of(r["text"]) or [] for x in a for y in b})
    assert {(r["a"], r["b"]): r["docs"] for r in pairs} == counts


def test_second_pass_makes_no_group_texts():
    texts = pa.array(["the cat sat", None, "  odd ▁x", "été the  cat\n\n y", "", "a▁b c"] * 2)
    first, second = alignment.Aligner(PARAMS), alignment.Aligner(PARAMS, with_texts=False)
    for _ in range(2):
        numbers, ends, groups = first.words(texts)
        found, found_ends, nothing = second.words(texts)
        assert (numbers == found).all() and (ends == found_ends).all()
        assert len(groups) == len(numbers) and nothing is None
        assert (first.links_of(numbers) == second.links_of(found)).all()
    assert first.texts and not second.texts


def test_chunks_keep_every_row():
    texts = pa.array(["abc", None, "", "abcdef", "x" * 50, "y"])
    parts = [part.to_pylist() for (part,) in alignment.chunks(texts, size=5)]
    assert [x for part in parts for x in part] == texts.to_pylist() and len(parts) > 2
