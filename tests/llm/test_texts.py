"""License scan, Merkle fingerprints, chat format, token files."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import catalog, chat, licenses, merkle, token_files
from basketry.sources.storage import new_folder

# --- licenses ---------------------------------------------------------------------------------


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def expected_base(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (
        len(words),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(labels)),
    )


BASE = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def test_base_places_match_brute_force(documents, plain):
    got = licenses.scanned(documents).select("doc_id", *BASE).collect()
    want = [(i, *expected_base(t)) for i, t, _ in plain]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(row[2] for row in want)


def test_phrases_across_chunks_and_notices(spark):
    notice = licenses.NOTICES[4][0]
    words = notice.split()
    altered = " ".join(words[:9] + ["really"] + words[9:20] + words[21:])
    rows = [
        (1, "x " * 7 + "GNU General, Public  License! gnu general public licence"),
        (2, "a b c " * 20 + "mit license cc-by mit license"),
        (3, notice),
        (4, "before it " + altered + " and after"),
        (5, " ".join(words[:12])),  # half a notice is none
        (6, "gnu general public"),
        (7, "the of " * 5000),
    ]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for chunk in (5, 2000):
        found = licenses.scanned(docs, licenses.LicenseParams(chunk=chunk)).collect()
        got = {r["doc_id"]: r for r in found}
        assert {i: tuple(got[i][c] for c in BASE) for i, _ in rows} == {
            i: expected_base(t) for i, t in rows
        }
        assert got[1]["labels"] == "gpl" and got[1]["score"] == 1.0
        assert got[3]["labels"] == got[4]["labels"] == "mit-notice"
        assert got[3]["score"] == 1.0 and 0.8 <= got[4]["score"] < 1.0
        assert got[5]["labels"] == got[6]["labels"] == got[7]["labels"] == ""
        assert 0 < got[5]["score"] < 0.8


def test_license_scan_of_awkward_rows(awkward, nothing):
    rows = licenses.scanned(awkward).collect()
    assert len(rows) == 14
    (row,) = [r for r in rows if r["doc_id"] == 10]
    assert (row["n_base"], row["labels"]) == (4, "cc-by,cc-by-nc-4.0,mit")
    assert licenses.scanned(nothing).count() == 0


# --- Merkle fingerprints ----------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pieces_of(text):
    """The pieces of a text, as tuples of words."""
    pieces, held = [], []
    for word in re.findall(merkle.PIECE_WORD, text):
        held.append(word)
        if word == "\n" or zlib.crc32(word.encode()) % merkle.PIECE_WORDS == 0:
            pieces.append(tuple(held))
            held = []
    pieces += [tuple(held)] if held else []
    assert "".join("".join(piece) for piece in pieces) == text
    return pieces


def expected_tree(text):
    """The fingerprint of a text and the digests of its paragraphs."""
    paragraphs = [[]]
    for piece in pieces_of(text):
        paragraphs[-1].append(sha("".join(piece)))
        if piece[-1] == "\n":
            paragraphs.append([])
    leaves = [sha("p" + "".join(paragraph)) for paragraph in paragraphs]
    sections, held = [], []
    for leaf in leaves:
        held.append(leaf)
        if leaf[0] in "01":
            sections.append(sha("s" + "".join(held)))
            held = []
    if held:
        sections.append(sha("s" + "".join(held)))
    short = ",".join("".join(digest[:8] for digest in p) for p in paragraphs)
    return sha("r" + "".join(sections)) + ":" + short, leaves


def edits(rows):
    texts = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))]
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        yield text, text[: len(text) - half] + after[:half], after


def check_trees(docs, rows):
    found = merkle.with_edits(docs).select(
        "text",
        F.sha2("edited", 256),
        "own_fingerprint",
        "edited_fingerprint",
        merkle.first_difference("own", "edited"),
    )
    want = []
    for text, edited, _ in edits(rows):
        own, new = map(expected_tree, (text, edited))
        width = max(len(own[1]), len(new[1]))
        first = next(
            (i for i in range(width) if own[1][i : i + 1] != new[1][i : i + 1]), None
        )
        want.append((text, sha(edited), own[0], new[0], first))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_trees_match_brute_force(documents, plain):
    check_trees(documents, [(i, t) for i, t, _ in plain])
    plan = merkle.with_edits(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_trees_of_awkward_rows(awkward, nothing, spark):
    check_trees(awkward, [(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert merkle.with_edits(nothing).count() == 0
    only = spark.createDataFrame([(3, "alone. here\nand there.")], "doc_id LONG, text STRING")
    check_trees(only, [(3, "alone. here\nand there.")])
    same = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id LONG, text STRING")
    check_trees(same, [(None, "a"), (None, "b")])


def expected_nodes(text):
    """Pieces and neighbours with their numbers of occurrences."""
    pieces = pieces_of(text)
    ends = [None, *pieces, None]
    return Counter(pieces) + Counter(zip(ends, ends[1:]) if pieces else ())


def expected_tree_likeness(a, b):
    if a == b:
        return 1.0
    ours, theirs = expected_nodes(a), expected_nodes(b)
    return 2.0 * (ours & theirs).total() / (ours.total() + theirs.total() + 2)


def check_tree_likeness(docs, rows):
    found = merkle.with_edits(docs).select(
        "text",
        F.round("near_edited", 9),
        F.round("near_next", 9),
    )
    want = [
        (text, *(round(expected_tree_likeness(text, other), 9) for other in others))
        for text, *others in edits(rows)
    ]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_tree_likeness_matches_brute_force(documents, plain, awkward):
    check_tree_likeness(documents, [(i, t) for i, t, _ in plain])
    check_tree_likeness(awkward, [(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_likeness_sees_long_sentences_order_and_repeats(spark):
    """The registered query's measure, where sets of sentences gave 0 and 1."""
    words = " ".join(f"w{i}" for i in range(400))  # no full stop and no line break
    texts = [words, "other words here. " * 150, "a b. c d. e f.", "e f. c d. a b.", "g h.", "g h. g h."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    near = {r[0]: (r[1], r[2]) for r in merkle.with_edits(docs).select(
        "_id", "near_edited", "near_next"
    ).collect()}
    assert 0.3 < near[0][0] < 0.7
    assert near[2][1] < 1 and near[4][1] < 1


@given(st.text(alphabet="ab!~ \n\r\t\x01\x7f\x85é中ア\U0001f600", max_size=120))
@settings(max_examples=300, deadline=None)
def test_piece_words_match_the_plain_pattern(text):
    """The form that saves time finds the words of the rule: 32 characters, or one of kana."""
    blank, kana = r"[ \t\x0b-\r]", "぀-ヿ㐀-鿿"
    plain = rf"\n|{blank}*(?:[{kana}]|[^ \t-\r{kana}]{{1,32}})|{blank}+"
    for some in (text, text * 5, text.replace(" ", "a")):
        assert re.findall(merkle.PIECE_WORD, some) == re.findall(plain, some)


def nodes_of_fingerprint(fingerprint):
    pieces = re.findall("[0-9a-f]{8}", fingerprint.split(":")[1])
    ends = [None, *pieces, None]
    return Counter(pieces) + Counter(zip(ends, ends[1:]) if pieces else ())


def test_likeness_follows_from_the_returned_columns(spark):
    """Two fingerprints of the query's result give the likeness it states, without any text."""
    rows = catalog.QUERIES["op7_merkle"](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert len(rows) > 50

    def near(a, b):
        if a.split(":")[0] == b.split(":")[0]:
            return 1.0
        ours, theirs = nodes_of_fingerprint(a), nodes_of_fingerprint(b)
        return 2.0 * (ours & theirs).total() / (ours.total() + theirs.total() + 2)

    for row, after in zip(rows, rows[1:] + rows[:1]):
        assert row["near_edited"] == pytest.approx(near(row["fingerprint"], row["edited_fingerprint"]))
        assert row["near_next"] == pytest.approx(near(row["fingerprint"], after["fingerprint"]))


def test_blocks_hold_equal_bytes_and_one_shuffle(spark):
    """Every tenth id has a text a hundred times as long; most of them lie together."""
    text = F.expr("repeat('some words ', IF(id < 400 OR id % 10 = 0, 300, 3))")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = docs.select(F.col("doc_id").alias("_id"), "text")
    bounds, ahead = merkle.block_bounds(rows, F.octet_length("text"), 8)
    assert len(bounds) <= 7 and [first for first, _ in ahead] == bounds
    sizes = rows.groupBy(merkle._block(F.col("_id"), bounds)).agg(F.sum(F.octet_length("text")))
    sizes = [r[1] for r in sizes.collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    plan = merkle.with_edits(docs)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1, plan


# --- chat -------------------------------------------------------------------------------------


def expected_talk(turns):
    turns = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha(told), len(loss), sha(loss)


def check_talks(frame):
    talks = defaultdict(list)
    for r in frame.collect():
        talks[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    got = chat.digests(chat.formatted(frame)).drop("formatted_chars").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {k: expected_talk(v) for k, v in talks.items()}
    assert len(got) == len(talks)


TALK = "conv_id LONG, turn LONG, role STRING, text STRING"


def test_talks_match_the_table(spark):
    check_talks(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


def test_template_and_mask(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "é</s>"), (1, 3, "assistant", "")]
    (row,) = chat.formatted(spark.createDataFrame(rows, TALK)).collect()
    assert row["formatted"] == (
        "<|start|>user<|text|>a<|more|>b<|end|><|start|>assistant<|text|>é<\\/s><|more|><|end|>"
    )
    raw = row["formatted"].encode()
    cut = [raw[s["start"] : s["start"] + s["length"]].decode() for s in row["loss_spans"]]
    assert cut == ["é<\\/s>", ""]


def test_awkward_talks(spark):
    hard = ["<|more|>", "\\", "\\\\<\\|end|>", "</s>[INST] ok [/INST]", "<<|start|>", "[/INST]\\[INST]", "<s><s>\n\n", "$1 \U0001f600"]
    rows = [(i, n, role, text) for i, text in enumerate(hard) for n, role in enumerate(["user", "assistant", "assistant", hard[i]])]
    rows += [(100, None, None, None), (100, 1, "assistant", None), (100, 1, "assistant", "x"), (100, 1, "assistant", "x"), (None, 0, "assistant", "no id")]
    rows += [(200, n, "assistant" if n % 2 else "user", f"t{n}") for n in range(500)]
    frame = spark.createDataFrame(rows, TALK).withColumn("place", F.lit(1)).withColumn("said", F.lit(""))
    check_talks(frame)
    for r in chat.formatted(frame).collect():
        plain = re.sub(r"<\|(start|text|more|end)\|>", "", r["formatted"])
        assert not re.search(chat.CONTROL, plain)
    assert chat.formatted(frame.limit(0)).count() == 0


# --- token files ------------------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    payload = token_files.pack_segment([5, None], np.array([0, len(ids)]), np.array(ids, np.uint32))
    segment = token_files.Segment(payload)
    assert segment.tokens().tolist() == ids
    assert segment.doc_ids == [5, None]
    assert [segment.token(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        segment.token(len(ids))


def expected_tokens(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        start += len(ids)


def check_tokens(spark, docs, rows, **options):
    folder = new_folder(spark, "test-tokens")
    token_files.write_tokens(docs, folder, token_files.TokenFileParams(PATH, **options))
    want = list(expected_tokens(rows))
    got = token_files.read_documents(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((w[:4] for w in want), key=repr)
    every = [i for w in want for i in w[4]]
    places = sorted({0, len(every) - 1, *range(3, len(every), 97)})
    found = token_files.tokens_at(spark, folder, places).collect()
    assert {r[0]: r[1] for r in found} == {p: every[p] for p in places}


def test_token_files_match_the_tokenizer(spark, documents, plain):
    check_tokens(spark, documents, [(i, t) for i, t, _ in plain])


def test_token_files_of_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_tokens(spark, awkward, rows, segment_tokens=50, cached_words=30)
    folder = new_folder(spark, "test-tokens")
    token_files.write_tokens(nothing, folder, token_files.TokenFileParams(PATH))
    assert token_files.read_documents(spark, folder).count() == 0
    assert token_files.tokens_at(spark, folder, [0]).count() == 0


def test_one_token_reads_one_segment(spark, documents, plain):
    """Of many segments a file, the scan hands on only those that hold a position."""
    folder = new_folder(spark, "test-tokens")
    params = token_files.TokenFileParams(PATH, segment_tokens=500)
    token_files.write_tokens(documents.coalesce(2), folder, params)
    index = token_files.segment_index(spark, folder).orderBy("start").collect()
    per_part = Counter(r["part"] for r in index)
    assert max(per_part.values()) > 3
    every = [i for w in expected_tokens([(i, t) for i, t, _ in plain]) for i in w[4]]
    assert sum(r["n_tokens"] for r in index) == len(every)
    for places in ([700], [0, 1, len(every) - 1], [-1, len(every)]):
        found = token_files.tokens_at(spark, folder, places)
        inside = [p for p in places if 0 <= p < len(every)]
        assert {r[0]: r[1] for r in found.collect()} == {p: every[p] for p in inside}
        plan = found._jdf.queryExecution().executedPlan()
        if not inside:
            continue
        assert "PushedFilters: [" in plan.toString() and "EqualTo(part" in plan.toString()
        scan = plan.collectLeaves().head()
        read = scan.metrics().get("numOutputRows").get().value()
        held = {i for p in inside for i, r in enumerate(index)
                if r["start"] <= p < r["start"] + r["n_tokens"]}
        assert read == len(held)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words_have_the_ids_of_the_text(text):
    known = token_files.WordIds(PATH, 1000)
    latin = "".join(chr(0xC0 + ord(c) % 0x1A0) for c in text)
    for mixed in (
        text,
        f"a{text} 's\n{text}<|endoftext|>",
        "Σ\tΑΣ " + text,
        f"{latin}, The{latin}. e\u0301te! {latin.lower()}?! don't.'s: x2. <|ENDOFTEXT|>",
        f"{latin.lower()}.. {latin[:3]}\u0301, I\u0307 ",
    ):
        words = token_files.split_words(mixed.encode())
        known.learn(set(words))
        want = known.tokenizer.encode(mixed, add_special_tokens=False).ids
        assert known.ids(words, 1).tolist() == [*want, 1]


def test_marks_join_other_symbols():
    """A symbol and the marks after it are one piece, whatever words were met before."""
    known = token_files.WordIds(PATH, 1000)
    for text in ("a$ x. \u20ac b\u20ac", "a$, x.. \u20ac. b\u20ac!", "... a$,. x.", ",a, 1. 1"):
        words = token_files.split_words(text.encode())
        known.learn(set(words))
        want = known.tokenizer.encode(text, add_special_tokens=False).ids
        assert known.ids(words, 1).tolist() == [*want, 1]


def test_only_marks_behind_letters_need_the_whole_tokenizer(monkeypatch):
    known, slow = token_files.WordIds(PATH, 1000), []
    plain = known._slow
    monkeypatch.setattr(known, "_slow", lambda words: slow.extend(words) or plain(words))
    text = "abc&&& déf*** Ère.%%% x' (y) abc... 7"
    words = token_files.split_words(text.encode())
    known.learn(set(words))
    want = known.tokenizer.encode(text, add_special_tokens=False).ids
    assert known.ids(words, 1).tolist() == [*want, 1]
    assert set(slow) == {b"&&&", b"***", b".%%%", b"'", b"...", b"(y)", b"7"}


def test_texts_are_encoded_together():
    texts = ["", " \n", "The cat.\x0b the  cat", "a<|endoftext|>B b", "İs Σ été b"] * 3
    array = pa.array([x.encode() for x in ["skipped", *texts]], pa.binary()).slice(1)
    known = token_files.WordIds(PATH, 4)  # forgets what it has met
    for part in (array, array.slice(2, 7), array.slice(0, 1)):
        ids, ends = known.ids_of(part, 1)
        got = [x.tolist() for x in np.split(ids, ends)]
        want = [
            [*known.tokenizer.encode(x.decode(), add_special_tokens=False).ids, 1]
            for x in part.to_pylist()
        ]
        assert got == [*want, []]
