"""Alignment of the tokens of two tokenizers, and how often their pairs are linked corpus-wide.

Byte offsets where a token of A and one of B both end cut a text into groups; a token of A and one
of B are linked if they share a group. Both tokenizers end a token before every blank that follows
a character that is no white space, so a text is aligned word by word, and a word once per task.

First pass: documents are aligned in blocks of bounded size; a block keeps its texts and its distinct
pairs with the number of its documents that hold them. The pairs' ids are divided into buckets by
the id of A, so that a bucket holds all pairs of its ids. Every bucket gets a minimal perfect
hash over its distinct pairs, built level by level from bit arrays without collisions: the pair's
place is the rank of its bit. Counts are dense vectors indexed by it; vectors of many blocks are
summed as a tree. The pairs themselves stand beside the vector, in order of their hash, so that a
look-up of any other pair is noticed. Blocks then look their pairs up in the summed vectors.
Second pass: a block's texts meet the looked-up counts, are aligned again, and sum them up.

A bucket's size is bounded by the two vocabularies, not by the corpus; nothing but the tokens' bytes
and sizes is sent to all tasks, and blocks are cut by bytes, so no source, text or id is a hot key.

Texts that are null or empty, or that the tokens of A or B do not give back byte by byte (a U+2581
in the text, say), have no tokens: their figures are zero. Very long texts are aligned whole. Repeated
rows, and rows whose id ties or is null, count as documents of their own. An empty table has an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ship
from basketry.sources.storage import stage

ship(__name__)

#: Where both tokenizers end a token.
CUT = re.compile(r"(?<=\S) ")

#: Texts where a blank comes first or follows white space, so that not every blank is such a place.
ODD = (
    r"(^|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
)

#: A pair is one long: the id of A above these bits, the id of B below.
BITS = 24

#: Bytes of texts whose words are looked up together.
TEXT_BYTES = 2 << 20

DOCUMENT = "block long, doc_id long, text string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class AlignParams:
    """``a_ranks`` is A's vocabulary as ranks, ``pattern`` its division of a text; ``b_model`` is
    B's model. The rest sets sizes: text bytes of a block, buckets of pairs, vectors that are
    summed in one task, and words that a task remembers.
    """

    a_ranks: str
    pattern: str
    b_model: str
    block_bytes: int = 8 << 20
    buckets: int = 256
    fan_in: int = 16
    requests: int = 512
    words: int = 600_000


class Rows:
    """A column that grows."""

    def __init__(self):
        self.data, self.size = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(end, np.int64)])
        self.data[self.size : end] = values
        self.size = end


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts that end before the given places."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Aligner:
    """Both tokenizers, and the words that were aligned before.

    A word has a number; ``figures`` holds its tokens of A and B, its groups (-1 if the tokens do
    not give the word back) and its links, ``texts`` its groups as text, if these are wanted.
    """

    def __init__(self, params: AlignParams, with_texts: bool = True):
        import sentencepiece
        import tiktoken

        with open(params.a_ranks, "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines)}
        self.a = tiktoken.Encoding(
            "a", pat_str=params.pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_file=params.b_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self.piece_bytes(self.b.id_to_piece(i)) for i in range(len(self.b))]
        self.a_sizes, self.b_sizes = (
            np.array([len(t) for t in tokens], np.int64) for tokens in (self.a_bytes, self.b_bytes)
        )
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.blank = self.b.piece_to_id("▁")
        self.most, self.with_texts = params.words, with_texts
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.figures = {name: Rows() for name in (*FIGURES, "start")}
        self.links = Rows()

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Tokens of A and B of a blank and the text; None if they do not give it back."""
        a = self.a.encode_ordinary(" " + text)
        # B puts the blank before a text itself, but none before an empty one.
        b = self.b.encode(text) or [self.blank]
        data = (" " + text).encode()
        for ids, parts in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join([parts[i] for i in ids]) != data:
                return None
        return a, b

    def encoded_words(self, words: list[str]) -> tuple[list[int], list[int]] | None:
        """Tokens of words that stand one after another; short calls are what B is fast at."""
        texts = [" ".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        data = "".join([" " + text for text in texts])
        out = []
        for lists, parts in (
            ([self.a.encode_ordinary(data)], self.a_bytes),
            (self.b.encode(texts, num_threads=1), self.b_bytes),
        ):
            ids = list(chain.from_iterable(lists))
            if b"".join([parts[i] for i in ids]) != data.encode():
                return None
            out.append(ids)
        return out[0], out[1]

    def learn(self, words: list[str]) -> None:
        """Align new words, many in one call: each begins with its blank, where tokens end."""
        plain = [w for w in words if w and not w[-1].isspace() and "▁" not in w]
        found = self.encoded_words(plain) if plain else None
        if found:
            self.add(plain, *found)
        else:
            plain = []
        done = set(plain)
        for word in words:
            if word not in done:
                found = self.encoded(word)
                if found:
                    self.add([word], *found)
                else:
                    self.number([word])
                    for name, rows in self.figures.items():
                        rows.add([-1 if name == "n_groups" else 0])
                    if self.with_texts:
                        self.texts.append("")

    def number(self, words: list[str]) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))

    def add(self, words: list[str], a_ids: list[int], b_ids: list[int]) -> None:
        """Align the tokens of words that stand one after another, each behind a blank."""
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        a_n, b_n = (np.bincount(g, minlength=len(ends)) for g in (a_group, b_group))
        word_ends = np.cumsum([len(w.encode()) + 1 for w in words])
        last = np.searchsorted(ends, word_ends) + 1  # groups up to each word's end
        if self.with_texts:
            self.add_texts(np.concatenate([a, b]), np.concatenate([a_group, b_group]), a_n, b_n, last)
        each = b_n[a_group]
        pairs = (np.repeat(a, each) << BITS) | b[ranges((np.cumsum(b_n) - b_n)[a_group], each)]
        n_links = sums(a_n * b_n, last)
        start = self.links.size + np.cumsum(n_links) - n_links
        self.links.add(pairs)
        groups = np.diff(np.concatenate([[0], last]))
        columns = (sums(a_n, last), sums(b_n, last), groups, n_links, start)
        for rows, values in zip(self.figures.values(), columns):
            rows.add(values)
        self.number(words)

    def add_texts(
        self, tokens: np.ndarray, group: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, last: np.ndarray
    ) -> None:
        """Groups of words as text: all tokens by group, A's before B's, with what stands behind."""
        n_a = int(a_n.sum())
        order = np.argsort(2 * group + (np.arange(len(tokens)) >= n_a), kind="stable")
        group_ends = np.cumsum(a_n + b_n)
        behind = np.full(len(tokens), ",")
        behind[group_ends - b_n - 1] = "|"
        behind[group_ends - 1] = ";"
        behind[group_ends[last - 1] - 1] = "\n"
        names = self.names
        parts = [names[i] + s for i, s in zip(tokens[order].tolist(), behind.tolist())]
        self.texts += [text + ";" for text in "".join(parts).split("\n")[:-1]]

    def words(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray | None]:
        """Numbers of the words of all texts, where each text's words end, and their groups if wanted.

        A text without tokens has no words.
        """
        if len(self.known) > self.most:
            self.forget()
        texts = texts.fill_null("")
        words = pc.split_pattern(texts, " ")
        odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, ODD))
        if pc.any(odd).as_py():
            some = [CUT.split(t) if t else [] for t in texts.filter(odd).to_pylist()]
            own = np.arange(len(texts))
            own[odd.to_numpy(zero_copy_only=False)] = len(texts) + np.arange(len(some))
            words = pa.concat_arrays([words, pa.array(some, words.type)]).take(pa.array(own))
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        place, get = flat.indices.to_numpy(), self.known.get
        numbers = np.array([get(word, -1) for word in distinct], np.int64)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            new = [distinct[i] for i in unknown.tolist()]
            self.learn(new)
            numbers[unknown] = [self.known[word] for word in new]
        wrong = self.figures["n_groups"].data[numbers] < 0
        if wrong.any():
            starts = np.concatenate([[0], ends[:-1]])
            sound = sums(wrong[place], ends) == 0
            place = place[ranges(starts[sound], (ends - starts)[sound])]
            ends = np.cumsum(np.where(sound, ends - starts, 0))
        groups = None
        if self.with_texts:
            groups = pa.array([self.texts[i] for i in numbers.tolist()], pa.large_string())
            groups = groups.take(pa.array(place))
        return numbers[place], ends, groups

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """All links of the words with these numbers."""
        rows = self.figures
        return self.links.data[ranges(rows["start"].data[numbers], rows["n_links"].data[numbers])]


def chunks(*columns: pa.Array, size: int = 1 << 20) -> Iterator[list[pa.Array]]:
    """Slices of columns with about ``size`` bytes of texts, the last column, each."""
    sizes = pc.fill_null(pc.binary_length(columns[-1]), 0).to_numpy()
    number = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield [column.slice(start, end - start) for column in columns]


def blocks(docs: DataFrame, params: AlignParams) -> DataFrame:
    """Documents with their block and figures, and a row per block with ``pairs, docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = Aligner(params)
        number, size, found = 0, 0, []
        first = TaskContext.get().partitionId() << 32

        def pairs_row() -> pa.RecordBatch:
            pairs, counts = np.unique(np.concatenate(found), return_counts=True)
            row = (first + number, *[None] * 7, pairs, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, KINDS)], names=NAMES
            )

        for batch in batches:
            for ids, texts in chunks(*batch.columns, size=TEXT_BYTES):
                numbers, ends, groups = both.words(texts)
                figures = [sums(both.figures[f].data[numbers], ends).tolist() for f in FIGURES]
                digests, start = [], 0
                places = np.frombuffer(groups.buffers()[1], np.int64)
                data = memoryview(groups.buffers()[2] or b"")
                for end in ends.tolist():
                    if end > start:
                        # Groups of a word end in a separator, the text's last one is left out.
                        part = data[places[start] : places[end] - 1]
                        digests.append(hashlib.sha256(part).hexdigest())
                        found.append(np.unique(both.links_of(np.unique(numbers[start:end]))))
                    else:
                        digests.append("")
                    start = end
                n = len(texts)
                block, none = pa.array([first + number] * n, pa.int64()), pa.nulls(n, LONGS)
                columns = [block, ids, texts, *map(pa.array, figures), pa.array(digests), none, none]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(k) for c, k in zip(columns, KINDS)], names=NAMES
                )
                size += texts.nbytes
                if size > params.block_bytes:
                    if found:
                        yield pairs_row()
                    number, size, found = number + 1, 0, []
        if found:
            yield pairs_row()

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, f"{DOCUMENT}, pairs array<long>, docs array<long>")


NAMES = ["block", "doc_id", "text", *FIGURES, "groups_sha256", "pairs", "docs"]
LONGS = pa.list_(pa.int64())
KINDS = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), LONGS, LONGS]


def spread(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of keys, another one on each level."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: places ``0 .. n - 1`` for n distinct keys.

    A key sets a bit on the first level where no other key left shares it; its place is the
    number of bits set before it. A key that was not there may get any place or -1, so the caller
    compares it with the key stored at the place.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sums = np.cumsum([0, *(int(bits.sum()) for bits in levels)])
        self.before = [np.cumsum(bits) - 1 + s for bits, s in zip(levels, sums)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = 2 * len(left) + 1
            at = spread(left, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = spread(keys[left], level) % np.uint64(len(bits))
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        sizes = [len(bits) for bits in self.levels]
        return sizes, b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def load(cls, sizes: list[int], data: bytes) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            end = at + -(-size // 8)
            bits = np.unpackbits(np.frombuffer(data[at:end], np.uint8), count=size)
            levels.append(bits.astype(bool))
            at = end
        return cls(levels)


def _longs(values: np.ndarray) -> bytes:
    return np.asarray(values, "<i8").tobytes()


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows of longs (``i``) and binaries (``b``) and lists of longs (``l``), named in ``schema``."""
    fields = [part.split(":") for part in schema.split()]
    kinds = {"i": pa.int64(), "b": pa.binary(), "l": LONGS}
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(fields, columns)})


def hashes(pairs: DataFrame) -> DataFrame:
    """``bucket, sizes, bits, keys`` from distinct ``bucket, pair``; keys are in order of their place."""

    def run(table: pa.Table) -> pa.Table:
        keys = table.column("pair").to_numpy()
        made = PerfectHash.build(keys)
        ordered = np.empty_like(keys)
        ordered[made.places(keys)] = keys
        return _table(
            "bucket:i sizes:l bits:b keys:b",
            [(table.column("bucket")[0].as_py(), *made.dump(), _longs(ordered))],
        )

    schema = "bucket long, sizes array<long>, bits binary, keys binary"
    return pairs.groupBy("bucket").applyInArrow(run, schema)


def place_known(keys: np.ndarray, row: dict) -> np.ndarray:
    """Places of pairs that the hash was built for; any other raises."""
    places = PerfectHash.load(row["sizes"], row["bits"]).places(keys)
    if len(keys) and ((places < 0).any() or (_array(row["keys"])[places] != keys).any()):
        raise RuntimeError("a pair has no place in its bucket's hash")
    return places


def dense_counts(requests: DataFrame, made: DataFrame) -> DataFrame:
    """``bucket, salt, counts``: a dense vector of each part of the requests of a bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table("bucket:i salt:i counts:b", [])
        row = right.to_pylist()[0]
        counts = np.zeros(len(row["keys"]) // 8, np.int64)
        keys = np.concatenate([_array(k) for k in left.column("keys").to_pylist()])
        docs = np.concatenate([_array(d) for d in left.column("docs").to_pylist()])
        np.add.at(counts, place_known(keys, row), docs)
        return _table("bucket:i salt:i counts:b", [(row["bucket"], row["salt"], _longs(counts))])

    keys = ("bucket", "salt")
    return (
        requests.groupBy(*keys)
        .cogroup(made.groupBy(*keys))
        .applyInArrow(run, "bucket long, salt long, counts binary")
    )


def tree_sum(vectors: DataFrame, salts: int, fan_in: int) -> DataFrame:
    """Sum of the vectors of each bucket, ``fan_in`` at a time."""

    def run(table: pa.Table) -> pa.Table:
        row = (table.column("bucket")[0].as_py(), table.column("salt")[0].as_py())
        total = sum(_array(v) for v in table.column("counts").to_pylist())
        return _table("bucket:i salt:i counts:b", [(*row, _longs(total))])

    while salts > 1:
        salts = -(-salts // fan_in)
        vectors = vectors.withColumn("salt", F.floor(F.col("salt") / fan_in).cast("bigint"))
        vectors = vectors.groupBy("bucket", "salt").applyInArrow(
            run, "bucket long, salt long, counts binary"
        )
    return vectors.drop("salt")


def best_flags(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its id of A."""
    _, a = np.unique(keys >> BITS, return_inverse=True)
    highest = np.zeros(a.max() + 1 if len(a) else 0, np.int64)
    np.maximum.at(highest, a, counts)
    return counts == highest[a]


def looked_up(requests: DataFrame, summed: DataFrame) -> DataFrame:
    """``block, keys, counts``: the corpus-wide count of every requested pair, negative if it is
    the highest of its id of A.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            row = right.to_pylist()[0]
            counts = _array(row["counts"])
            signed = np.where(best_flags(_array(row["keys"]), counts), -counts, counts)
            keys = [_array(k) for k in left.column("keys").to_pylist()]
            found = signed[place_known(np.concatenate(keys), row)]
            ends = np.cumsum([len(k) for k in keys])
            for block, k, c in zip(left.column("block").to_pylist(), keys, np.split(found, ends[:-1])):
                out.append((block, _longs(k), _longs(c)))
        return _table("block:i keys:b counts:b", out)

    keys = ("bucket", "salt")
    return (
        requests.groupBy(*keys)
        .cogroup(summed.groupBy(*keys))
        .applyInArrow(run, "block long, keys binary, counts binary")
    )


def requested(staged: DataFrame, params: AlignParams) -> DataFrame:
    """``block, bucket, keys, docs``: the pairs of a block, a row for each bucket."""
    buckets = params.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                block = batch.column(0)[i].as_py()
                pairs, docs = (batch.column(c)[i].values.to_numpy() for c in (1, 2))
                bucket = (spread(pairs >> BITS, 99) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for part in np.split(order, cuts):
                    out.append((block, int(bucket[part[0]]), _longs(pairs[part]), _longs(docs[part])))
            yield from _table("block:i bucket:i keys:b docs:b", out).to_batches()

    rows = staged.where("pairs IS NOT NULL").select("block", "pairs", "docs")
    return rows.mapInArrow(run, "block long, bucket long, keys binary, docs binary")


def second_pass(staged: DataFrame, answers: DataFrame, params: AlignParams) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``: aligned again, beside their block's counts."""

    made: list[Aligner] = []  # one for all blocks of a task

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not made:
            made.append(Aligner(params, with_texts=False))
        both = made[0]
        keys = np.concatenate([np.zeros(0, np.int64), *map(_array, right.column("keys").to_pylist())])
        counts = np.concatenate([np.zeros(0, np.int64), *map(_array, right.column("counts").to_pylist())])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        best, total = [], []
        for (texts,) in chunks(left.column("text").combine_chunks(), size=TEXT_BYTES):
            numbers, text_ends, _ = both.words(texts)
            every, place = np.unique(numbers, return_inverse=True)
            found = counts[np.searchsorted(keys, both.links_of(every))]
            ends = np.cumsum(both.figures["n_links"].data[every])
            for values, out in ((found < 0, best), (np.abs(found), total)):
                out += sums(sums(values, ends)[place], text_ends).tolist()
        out = left.drop_columns(["block", "text"])
        return out.append_column("n_best", pa.array(best, pa.int64())).append_column(
            "count_sum", pa.array(total, pa.int64())
        )

    rows = staged.where("pairs IS NULL").select(
        "block", "doc_id", "text", *FIGURES, "groups_sha256"
    )
    figures = ", ".join(f"{name} long" for name in FIGURES)
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"doc_id long, {figures}, groups_sha256 string, n_best long, count_sum long"
    )


def pair_counts(staged: DataFrame, params: AlignParams) -> tuple[DataFrame, DataFrame, int]:
    """The blocks' requests, each bucket's hash with its summed counts, and the salts of a bucket."""
    asked = stage(requested(staged, params), "requests")
    most = asked.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // params.requests))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("bigint"))
    longs = staged.where("pairs IS NOT NULL").select(F.explode("pairs").alias("pair")).distinct()

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            bucket = (spread(pairs >> BITS, 99) % np.uint64(params.buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0)], ["bucket", "pair"])

    made = stage(hashes(longs.mapInArrow(bucket_of, "bucket long, pair long")), "hashes")
    copies = made.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "salt", F.col("salt").cast("bigint")
    )
    counts = tree_sum(dense_counts(asked, copies), salts, params.fan_in)
    return asked, stage(made.join(counts, "bucket"), "counts"), salts


def alignments(docs: DataFrame, params: AlignParams) -> DataFrame:
    """One row per document: figures of its alignment, ``n_best``, ``count_sum``, ``groups_sha256``."""
    staged = stage(blocks(docs, params), "aligned")
    asked, counts, salts = pair_counts(staged, params)
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn(
        "salt", F.col("salt").cast("bigint")
    )
    answers = looked_up(asked, copies)
    return second_pass(staged, answers, params).select(
        "doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"
    )


def frequent_pairs(docs: DataFrame, params: AlignParams) -> DataFrame:
    """``a, b, docs, is_best``: the table of linked pairs itself."""
    counts = pair_counts(stage(blocks(docs, params), "aligned"), params)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, found = _array(row["keys"]), _array(row["counts"])
                yield pa.RecordBatch.from_arrays(
                    [keys >> BITS, keys & ((1 << BITS) - 1), found, best_flags(keys, found)],
                    ["a", "b", "docs", "is_best"],
                )

    return counts.select("keys", "counts").mapInArrow(
        run, "a long, b long, docs long, is_best boolean"
    )
