"""Token ids in directly addressable codes: any token is read without decoding its neighbours.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id and a bitmap
that says which ids go on; level 1 holds the next chunk of those, and so on. The place of an id's
next chunk is the number of set bits before it: a rank, which a directory with the running count
per 512 bits gives in constant time.

The ids of whole documents make up segments of about ``segment_tokens``. A segment is one row of a
Parquet folder: the table format commits files atomically, so a lost executor leaves no half
written segment, and any store that Spark writes to will do. Rows carry their range partition and
the tokens before them in it; adding up partition totals gives global positions. Every row is a
Parquet page of its own, so one segment is read without the payloads of its neighbours.

Order is by ``doc_id`` (null last), then text. Null and empty texts have the end id alone.
Repeated rows are documents of their own. An empty table gives a folder without segments.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from basketry.llm.alignment import Rows, chunks, ranges
from basketry.llm.common import ship, text_of

ship(__name__)

MAGIC = b"DAC1"
WIDTH = 8
RANK_BITS = 512


@dataclass(frozen=True)
class TokenFileParams:
    """``end_id`` closes every document; ``cached_words`` bounds a worker's memory for words."""

    tokenizer: str
    end_id: int = 1
    segment_tokens: int = 262_144
    cached_words: int = 400_000


# --- codes ------------------------------------------------------------------------------------


def pack_segment(doc_ids: Sequence[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, document ids with a null flag, running ends, then level by level: length, chunks,
    bitmap, rank directory. All numbers are little-endian.
    """
    named = np.array([x is not None for x in doc_ids], np.uint8)
    plain = np.array([x or 0 for x in doc_ids], "<i8")
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest >> WIDTH
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-len(goes_on) // RANK_BITS) * RANK_BITS, np.uint8)
        padded[: len(goes_on)] = goes_on
        per_block = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(per_block)])[:-1].astype("<u8")
        chunks = (rest & ((1 << WIDTH) - 1)).astype(np.uint8)
        levels.append(
            struct.pack("<Q", len(rest))
            + chunks.tobytes()
            + bitmap.tobytes()
            + directory.tobytes()
        )
        if not goes_on.any():
            break
        rest = more[goes_on]
    head = MAGIC + struct.pack("<IQQ", len(levels), len(plain), len(ids))
    return b"".join(
        [head, named.tobytes(), plain.tobytes(), np.asarray(ends, "<u8").tobytes(), *levels]
    )


class Segment:
    """A segment over its bytes; nothing is decoded until it is asked for."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        count, docs, self.size = struct.unpack_from("<IQQ", payload, 4)
        at = 4 + struct.calcsize("<IQQ")

        def take(kind: str, number: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, number, at)
            at += out.nbytes
            return out

        self.named, self.ids = take("u1", docs), take("<i8", docs)
        self.ends = take("<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(count):
            size = int(take("<u8", 1)[0])
            chunks, bitmap = take("u1", size), take("u1", -(-size // 8))
            self.levels.append((chunks, bitmap, take("<u8", -(-size // RANK_BITS))))

    @property
    def doc_ids(self) -> list[int | None]:
        return [int(i) if known else None for i, known in zip(self.ids, self.named)]

    def token(self, place: int) -> int:
        """The id at one place: a chunk, a bit and a rank per level."""
        if not 0 <= place < self.size:
            raise IndexError(place)
        out = 0
        for level, (chunks, bitmap, directory) in enumerate(self.levels):
            out |= int(chunks[place]) << (WIDTH * level)
            if not bitmap[place >> 3] >> (place & 7) & 1:
                break
            block = place // RANK_BITS
            first = block * RANK_BITS // 8
            before = int(np.bitwise_count(bitmap[first : place >> 3]).sum())
            partial = int(bitmap[place >> 3]) & ((1 << (place & 7)) - 1)
            place = int(directory[block]) + before + partial.bit_count()
        return out

    def tokens(self) -> np.ndarray:
        """All ids, from the last level up."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            level = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            level[goes_on] |= values << WIDTH
            values = level
        return values


# --- writing ----------------------------------------------------------------------------------


#: Marks that stand apart from the letters before them: all printable ASCII but letters, digits.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

#: Small Latin letters that have one form only: a to z, and those with an accent up to U+00FF.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

# How the tokenizer must take texts apart for words to be encoded one by one.
NORMAL_FORM = ["NFC", "Replace", "Lowercase"]
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others for 256, 257, ... in their order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


#: Words in one call of the model, and bytes of texts whose words are looked up together.
JOINED = 1024
TEXT_BYTES = 4 << 20


class WordIds:
    """Ids of words between ASCII blanks.

    The tokenizer drops blanks and never joins characters across them, so a text's ids are those
    of its words one after another, and a word is encoded once. A word has a number; its ids are a
    range of ``flat``. Words of small Latin letters need none of the tokenizer's preparation: many
    go to its model in one call, which ends every word's last id. Marks after a word are encoded
    apart, as the tokenizer does itself. Beyond ``limit`` words all but those at hand are forgotten.
    """

    def __init__(self, path: str, limit: int):
        # One thread: Spark runs a task per core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        parts = json.loads(self.tokenizer.to_str())
        forms = [x["type"] for x in parts["normalizer"]["normalizers"]]
        split, level = parts["pre_tokenizer"]["pretokenizers"]
        if (forms, split["pattern"]["Regex"], level["type"]) != (
            NORMAL_FORM,
            LETTERS_APART,
            "ByteLevel",
        ):
            raise ValueError(f"{path} does not take texts apart at blanks and letters")
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = CharDelimiterSplit(" ")
        letters = byte_letters() | {ord(" "): ord(" ")}
        self.letters = np.array([letters[b] for b in range(256)], "<u4")
        vocabulary, last = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if last and piece.endswith(last)]] = True
        self.forget()

    def forget(self) -> None:
        self.flat, self.starts, self.sizes = Rows(), Rows(), Rows()
        self._add(np.zeros(0, np.int64), np.array([0]))  # the empty word is number 0
        self.known: dict[bytes, int] = {b"": 0}
        #: Words of letters alone, and what may follow them.
        self.stems: dict[bytes, int] = {b"": 0}
        self.marks: dict[bytes, int] = {b"": 0}

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Numbers of new words with these ids."""
        first = self.sizes.size
        self.starts.add(self.flat.size + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.flat.add(ids)
        return range(first, first + len(sizes))

    def _slow(self, words: list[bytes]) -> range:
        texts = [word.decode("utf-8") for word in words]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lists = [x.ids for x in found]
        flat = np.array(list(chain.from_iterable(lists)), np.int64)
        return self._add(flat, np.array([len(ids) for ids in lists], np.int64))

    def _fast(self, forms: list[bytes]) -> range | None:
        """Words of small letters in composed form; None if the model does not end every one."""
        joined = []
        for at in range(0, len(forms), JOINED):
            data = np.frombuffer(b" ".join(forms[at : at + JOINED]), np.uint8)
            joined.append(self.letters[data].tobytes().decode("utf-32-le"))
        found = self.plain.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(x.ids for x in found)), np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(forms):
            return None
        return self._add(ids, np.diff(ends, prepend=0))

    @staticmethod
    def _small(stem: bytes) -> bytes | None:
        """Letters as the tokenizer has them; None if it may do more than make them small."""
        text = stem.decode("utf-8")
        low = text.lower()
        if not low.isalpha() or max(low) >= "\u0250" or not unicodedata.is_normalized("NFC", text):
            return None
        return low.encode("utf-8")

    def _learn_stems(self, stems: set[bytes]) -> None:
        names = [stem for stem in stems if PLAIN.fullmatch(stem)]
        forms = {stem: self._small(stem) for stem in stems.difference(names)}
        forms = dict(zip(names, names)) | {stem: form for stem, form in forms.items() if form}
        numbers = self._fast([*forms.values()]) if forms else None
        if numbers:
            self.stems.update(zip(forms, numbers))

    def learn(self, words: Iterable[bytes]) -> None:
        """Make the ids of ``words`` known until the next call."""
        self.numbers([*words])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words."""
        get = self.known.get
        found = np.array([get(word, -1) for word in words], np.int64)
        places = np.flatnonzero(found < 0)
        if len(self.known) + len(places) > self.limit:
            self.forget()
            places = np.arange(len(words))
        if len(places):
            found[places] = self._new_numbers([words[i] for i in places.tolist()])
        return found

    def _new_numbers(self, words: list[bytes]) -> np.ndarray:
        stems = [word.rstrip(MARKS) for word in words]
        self._learn_stems(set(stems).difference(self.stems))
        get = self.stems.get
        out = np.array([get(stem, -1) for stem in stems], np.int64)
        longer = np.array([*map(len, words)]) > np.array([*map(len, stems)])
        odd, marked = np.flatnonzero(out < 0), np.flatnonzero(longer & (out >= 0))
        if len(odd):
            out[odd] = self._slow([words[i] for i in odd.tolist()])
        if len(marked):
            tails = [words[i][len(stems[i]) :] for i in marked.tolist()]
            unknown = [*set(tails).difference(self.marks)]
            if unknown:
                self.marks.update(zip(unknown, self._slow(unknown)))
            both = np.column_stack([out[marked], [self.marks[tail] for tail in tails]])
            sizes = self.sizes.data[both].sum(axis=1)
            out[marked] = self._add(self._ids(both.ravel()), sizes)
        self.known.update(zip(words, out.tolist()))
        return out

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat.data[ranges(self.starts.data[numbers], self.sizes.data[numbers])]

    def ids(self, words: list[bytes], end_id: int) -> np.ndarray:
        """Ids of known words and the end id."""
        numbers = np.array([self.known[word] for word in words], np.int64)
        return np.append(self._ids(numbers), end_id).astype("<u4")

    def ids_of(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with an end id after each, and where each text ends in them."""
        words, ends = words_of(texts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self.numbers(distinct)[coded.indices.to_numpy()]
        word_ends = np.concatenate([[0], np.cumsum(self.sizes.data[numbers])])
        ids = np.insert(self._ids(numbers), word_ends[ends], end_id)
        return ids.astype("<u4"), word_ends[ends] + np.arange(1, len(ends) + 1)


def known_words(path: str, limit: int) -> WordIds:
    """The words that this worker has met in earlier tasks.

    Shipped functions are built anew for every task, so what a worker keeps is in a module of its
    own, which it makes when it first needs it.
    """
    kept = sys.modules.setdefault("_kept_word_ids", ModuleType("_kept_word_ids")).__dict__
    if (path, limit) not in kept:
        kept[path, limit] = WordIds(path, limit)
    return kept[path, limit]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks of texts in bytes, in small letters as the tokenizer has them,
    and where each text's words end. A blank text has one empty word.

    Special tokens are told from other text by their letters, so a text that may hold one is left
    as it is.
    """
    texts = texts.view(pa.string())
    special = pc.match_substring(texts, "<|")
    small = pc.if_else(special, texts, pc.ascii_lower(texts))
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(small))
    ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
    return words.flatten().view(pa.binary()), ends


def split_words(text: bytes) -> list[bytes]:
    """``words_of`` a single text."""
    return [word for word in words_of(pa.array([text], pa.binary()))[0].to_pylist() if word]


def _segments(params: TokenFileParams, batches: Iterator[pa.RecordBatch]):
    known = known_words(params.tokenizer, params.cached_words)
    names, ends, parts = [], [], []
    number = before = held = 0

    def closed() -> pa.RecordBatch:
        nonlocal names, ends, parts, number, before, held
        payload = pack_segment(names, np.array(ends, np.int64), np.concatenate(parts))
        row = {
            "part": [TaskContext.get().partitionId()],
            "number": [number],
            "before": [before],
            "n_tokens": [held],
            "payload": [payload],
        }
        names, ends, parts, number, before, held = [], [], [], number + 1, before + held, 0
        return pa.RecordBatch.from_pydict(row, schema=SEGMENT_SCHEMA)

    for batch in batches:
        for doc_ids, texts in chunks(batch.column("_id"), batch.column("_bytes"), size=TEXT_BYTES):
            ids, text_ends = known.ids_of(texts, params.end_id)
            start = 0
            for doc_id, end in zip(doc_ids.to_pylist(), text_ends.tolist()):
                part = ids[start:end]
                start = end
                held += len(part)
                names.append(doc_id)
                ends.append(held)
                parts.append(part)
                if held >= params.segment_tokens:
                    yield closed()
    if names:
        yield closed()


SEGMENT_SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("number", pa.int32()),
        ("before", pa.int64()),
        ("n_tokens", pa.int64()),
        ("payload", pa.binary()),
    ]
)


#: Every row ends a page, and payloads are in no dictionary.
PAGE_PER_ROW = {
    "parquet.page.row.count.limit": 1,
    "parquet.page.size.row.check.min": 1,
    "parquet.enable.dictionary#payload": "false",
}


def write_tokens(docs: DataFrame, folder: str, params: TokenFileParams) -> None:
    """Encode every whole text and write segments in document order: one shuffle, by range."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_of().alias("_text"))
    by_id = F.col("_id").asc_nulls_last()
    # Ranges are of ids alone: Spark samples the ids for their bounds, not the texts.
    (
        rows.repartitionByRange(by_id)
        .sortWithinPartitions(by_id, F.col("_text"))
        .select("_id", F.col("_text").cast("binary").alias("_bytes"))
        .mapInArrow(
            lambda batches: _segments(params, batches),
            "part int, number int, before long, n_tokens long, payload binary",
        )
        .write.options(**PAGE_PER_ROW)
        .parquet(folder)
    )


# --- reading ----------------------------------------------------------------------------------


def _starts(rows: DataFrame) -> DataFrame:
    """``start``, the tokens before a segment in the whole folder, in place of ``before``.

    The window runs over one row per range partition of the writing job.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = F.sum("_tokens").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("_offset"))
    start = (F.col("_offset") + F.col("before")).alias("start")
    kept = [name for name in rows.columns if name != "before"]
    return rows.join(F.broadcast(offsets), "part").select(start, *kept)


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments with ``start``, the tokens before them in the whole folder."""
    return _starts(spark.read.parquet(folder)).select("start", "n_tokens", "payload")


def segment_index(spark: SparkSession, folder: str) -> DataFrame:
    """Where every segment is and begins, without its payload."""
    return _starts(spark.read.parquet(folder).select("part", "number", "before", "n_tokens"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column("start"), batch.column("payload")):
            segment = Segment(payload.as_py())
            ids = segment.tokens().astype("<u4")
            firsts = np.concatenate([[0], segment.ends[:-1]]).astype(np.int64)
            sums = [zlib.crc32(ids[a:b].data) for a, b in zip(firsts, segment.ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(segment.doc_ids, pa.int64()),
                    pa.array(firsts + start.as_py()),
                    pa.array(segment.ends - firsts),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens`` and the checksum of its decoded ids."""
    return (
        segments(spark, folder)
        .select("start", "payload")
        .mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def _found(
    wanted: dict[tuple[int, int], tuple[int, list[int]]], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, payload in zip(*(batch.column(i) for i in range(3))):
            start, positions = wanted[part.as_py(), number.as_py()]
            segment = Segment(payload.as_py())
            tokens = [segment.token(p - start) for p in positions]
            yield pa.RecordBatch.from_arrays(
                [pa.array(positions, pa.int64()), pa.array(tokens, pa.int64())],
                names=["position", "token"],
            )


def tokens_at(spark: SparkSession, folder: str, positions: Sequence[int]) -> DataFrame:
    """The ids at global positions; positions outside the folder give no row.

    The index names the segments that hold one, at most as many as ``positions``. Their numbers
    are pushed to the scan, which reads the payloads of these segments; none is decoded.
    """
    asked = sorted({int(p) for p in positions})
    holds = F.exists(
        F.lit(asked).cast("array<bigint>"),
        lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")),
    )
    wanted, numbers = {}, {}
    for r in segment_index(spark, folder).where(holds).collect():
        first, last = bisect_left(asked, r["start"]), bisect_left(asked, r["start"] + r["n_tokens"])
        wanted[r["part"], r["number"]] = (r["start"], asked[first:last])
        numbers.setdefault(r["part"], []).append(r["number"])
    chosen = F.lit(False)
    for part, inside in sorted(numbers.items()):
        chosen |= (F.col("part") == part) & F.col("number").isin(inside)
    return (
        spark.read.parquet(folder)
        .where(chosen)
        .select("part", "number", "payload")
        .mapInArrow(lambda batches: _found(wanted, batches), "position long, token long")
    )
