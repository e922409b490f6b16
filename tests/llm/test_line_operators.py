import re
from collections import Counter, defaultdict

from basketry.llm import line_rules, line_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_windows(rows):
    """Rows (id, text) in order to (text, number removed)."""
    parts = []
    for doc, text in rows:
        lines = text.split("\n")
        at = [i for i, line in enumerate(lines) if WORD.search(line)]
        parts.append((doc, lines, at))
    places = defaultdict(list)
    for n, (_, lines, at) in enumerate(parts):
        for p in range(len(at) - 2):
            places[tuple(lines[i] for i in at[p : p + 3])].append((n, p))
    later, first = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            first[found[0][0]].update(range(found[0][1], found[0][1] + 3))
            for n, p in found[1:]:
                later[n].update(range(p, p + 3))
    out = []
    for n, (doc, lines, at) in enumerate(parts):
        gone = sorted(later[n] - first[n])
        dropped = {at[p] for p in gone}
        for a, b in zip(gone, gone[1:]):
            if b == a + 1:
                dropped.update(range(at[a], at[b]))
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if i not in dropped), len(gone)))
    return out


def test_windows_match_brute_force(documents, plain):
    got = line_windows.rewritten(documents).select("_id", "_new", "_n_removed").collect()
    assert sorted(map(tuple, got)) == expected_windows(sorted((i, t) for i, t, _ in plain))


def test_windows_overlap_blank_lines_and_own_repeats(spark):
    rows = [
        (1, "a\nb\nc\nd"),
        (2, "x\nb\n\nc\n \nd\ny"),  # blank lines between removed lines go too
        (3, "r\nr\nr\nr\nr"),  # the first window stays whole
        (4, "c\nd\nz"),  # its window is in no other text
        (5, "a\nb"),
    ]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r["doc_id"]: r["text"] for r in line_windows.remove_windows(docs).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\ny", 3: "r\nr\nr", 4: "c\nd\nz", 5: "a\nb"}


def test_windows_are_native(documents):
    plan = line_windows.rewritten(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_windows_of_awkward_rows(awkward, nothing):
    out = line_windows.remove_windows(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert len(rows) == 14
    first = [r["text"] for r in rows if r["doc_id"] == 1 and r["text"].startswith("line")]
    assert len(first) == 2 and len(set(first)) == 1 and first[0].count("\n") == 4
    assert [r["text"] for r in rows if r["doc_id"] == 5] == ["\nand more words after it"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert line_windows.remove_windows(nothing).count() == 0


def expected_figures(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_figures_match_brute_force(documents, plain):
    got = {r["doc_id"]: r for r in line_rules.judged(documents).collect()}
    for doc, text, _ in plain:
        assert tuple(got[doc][x] for x in line_rules.FIGURES) == expected_figures(text)


def test_repeats_of_every_length():
    words = [bytes([97 + i % 7]) for i in range(40)]
    for n in range(len(words)):
        text = b" ".join(words[:n])
        assert line_rules.text_figures(text) == expected_figures(text.decode())


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    footer = "Copyright 2024 all rights reserved by the owners of this page, contact us for more"
    rows = [(i, f"own words of document {i} w{i} are more than ten in\n{footer}", "h") for i in range(15)]
    rows += [(100 + i, f"tiny{i}\n{footer.replace('2024', '1999').upper()}", "h") for i in range(3)]
    rows += [(200, footer, "other host"), (300, footer, None)]
    rows += [(400, f"{footer}\n{footer}", "h")]  # repeats itself: fails the base rules
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    rules = line_rules.LineRules(docs=10)
    kept = {r["doc_id"]: r["text"] for r in line_rules.quality_rules(docs, rules).collect()}
    assert set(kept) == {*range(15), 200, 300}
    assert kept[3] == "own words of document 3 w3 are more than ten in"
    assert kept[200] == footer and kept[300] == footer


def test_copies_of_one_text_are_no_boilerplate(spark):
    text = "a text of well over ten words that was copied very many times indeed"
    docs = spark.createDataFrame([(i, text, "h") for i in range(40)], "doc_id LONG, text STRING, source STRING")
    assert line_rules.quality_rules(docs).count() == 40


def test_rules_of_awkward_rows(awkward, nothing):
    rows = line_rules.judged(awkward).collect()
    assert len(rows) == 14
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 10)
    out = line_rules.quality_rules(awkward)
    assert out.columns == awkward.columns
    # The five lines of documents 1 and 5 end alike, which the repeat rule rejects.
    assert sorted(r["doc_id"] for r in out.collect()) == [6, 10]
    assert line_rules.quality_rules(nothing).count() == 0
    assert line_rules.judged(nothing).count() == 0
