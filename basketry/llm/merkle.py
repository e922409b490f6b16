"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions.

The leaves are pieces: runs of about four words, each ending where the word's checksum or the line
says so, so borders follow the content and an edit moves only those near it. Joined in order they
are the text. A paragraph is a line, and its digest that of its pieces' digests. A section ends with
a paragraph whose digest begins with 0 or 1, one in eight. A section's digest is that of its
paragraphs, and the root's that of the sections: equal texts have equal roots, other texts have
others, and sections and paragraphs that differ say where an edit is.

A fingerprint is a string: the root, a colon, and the first eight hex digits of every piece's digest,
with a comma after each paragraph but the last. ``likeness`` needs two of them and no text: the share
of nodes that they have in common (twice the common ones by the sum of both), where nodes are the
pieces, each pair of neighbouring pieces and the root; a piece that occurs n times is n nodes. It is
1 for equal fingerprints and below 1 for others. About a third of the text's bytes is the price of
a likeness that sees every piece; the root alone tells equal from other.

A null text is an empty one: one paragraph without pieces, unlike any other but its equals.
Documents are in order of ``doc_id`` (null last), then text; repeated rows follow one another. A very
long text is one row: its pieces are arrays in that row. Rows of one ``doc_id`` meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import text_of

#: A line break, or a word with the blanks before it, or blanks that no word follows. Words end
#: after 32 characters at most, and a kana or Chinese character is a word. The first form of a word
#: only saves time: runs of printable ASCII that no other character continues.
PIECE_WORD = (
    r"[\x20\x09\x0B-\x0D]*+(?:[!-~]{1,32}+(?![^\x09-\x0D\x20-\x7E])|[\u3040-\u30FF\u3400-\u9FFF]"
    r"|[^\x20\x09-\x0D\u3040-\u30FF\u3400-\u9FFF]{1,32}+)|\n|[\x20\x09\x0B-\x0D]++"
)

#: One word in so many ends a piece.
PIECE_WORDS = 4

#: Hex digits of a whole digest, and of a piece's digest in a fingerprint.
DIGEST, SHORT = 64, 8

#: Ranges of ids whose bytes are counted, for each block of neighbouring ids.
FINE = 16


def _places(last: Column) -> Column:
    """0 to ``last``; none if it is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def sections(leaf: Column) -> Column:
    """Structs of a section's first and last paragraph and its digest; ``leaf`` is a column."""
    last = F.size(leaf) - 1
    stops = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == last) | F.substring(F.get(leaf, i), 1, 1).isin("0", "1"),
    )
    starts = F.concat(
        F.array(F.lit(0)), F.transform(F.slice(stops, 1, F.size(stops) - 1), lambda x: x + 1)
    )
    return F.zip_with(
        starts,
        stops,
        lambda a, b: F.struct(
            a.alias("first"),
            b.alias("last"),
            F.sha2(
                F.concat(F.lit("s"), F.array_join(F.slice(leaf, a + 1, b - a + 1), "")), 256
            ).alias("digest"),
        ),
    )


def root(section: Column) -> Column:
    return F.sha2(F.concat(F.lit("r"), F.array_join(section["digest"], "")), 256)


def with_tree(frame: DataFrame, text: str, prefix: str) -> DataFrame:
    """Columns ``<prefix>_leaves`` (of paragraphs), ``_sections`` and ``_fingerprint`` of ``text``."""
    words, stops, digests = (f"{prefix}_{name}" for name in ("words", "stops", "digests"))
    last = F.size(words) - 1
    ends_piece = lambda i: (
        (i == last)
        | (F.get(words, i) == "\n")
        | (F.crc32(F.get(words, i)) % F.lit(PIECE_WORDS) == 0)
    )
    frame = frame.withColumn(words, F.regexp_extract_all(text, F.lit(PIECE_WORD), F.lit(0)))
    frame = frame.withColumn(stops, F.filter(_places(last), ends_piece))
    starts = F.concat(F.array(F.lit(0)), F.transform(stops, lambda i: i + 1))
    # A piece's digest, with a comma if the piece ends its paragraph.
    digest = lambda a, b: F.concat(
        F.sha2(F.array_join(F.slice(words, a + 1, b - a + 1), ""), 256),
        F.when(F.get(words, b) == "\n", F.lit(",")).otherwise(F.lit("")),
    )
    frame = frame.withColumn(
        digests, F.zip_with(F.slice(starts, F.lit(1), F.size(stops)), stops, digest)
    )
    paragraphs = F.split(F.array_join(digests, ""), ",")
    short = F.transform(
        digests, lambda d: F.concat(F.substring(d, 1, SHORT), F.substring(d, DIGEST + 1, 1))
    )
    return (
        frame.withColumn(
            f"{prefix}_leaves",
            F.transform(paragraphs, lambda p: F.sha2(F.concat(F.lit("p"), p), 256)),
        )
        .withColumn(f"{prefix}_sections", sections(F.col(f"{prefix}_leaves")))
        .withColumn(
            f"{prefix}_fingerprint",
            F.concat(root(F.col(f"{prefix}_sections")), F.lit(":"), F.array_join(short, "")),
        )
        .drop(words, stops, digests)
    )


def with_nodes(frame: DataFrame, fingerprint: str, nodes: str) -> DataFrame:
    """Column ``nodes``: hashes of a fingerprint's pieces and of neighbours among them.

    Nodes that occur several times are numbered, so equal hashes do not fall together.
    """
    pieces, ends = f"{nodes}_pieces", f"{nodes}_ends"
    of_pieces = F.substring(fingerprint, DIGEST + 2, 2**31 - 1)
    frame = frame.withColumn(
        pieces,
        F.regexp_extract_all(of_pieces, F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)),
    )
    outside = F.array(F.lit(None).cast("string"))
    pairs = F.zip_with(
        F.concat(outside, pieces),
        F.concat(pieces, outside),
        lambda a, b: F.xxhash64(F.lit(1), a, a.isNull(), b, b.isNull()),
    )
    singles = F.transform(pieces, lambda piece: F.xxhash64(piece))
    every = F.when(F.size(pieces) > 0, F.sort_array(F.concat(singles, pairs)))
    frame = frame.withColumn(nodes, F.coalesce(every, F.array().cast("array<bigint>")))
    # Equal hashes are neighbours now: a run of them is told apart by its places in the run.
    final = F.size(nodes) - 1
    frame = frame.withColumn(
        ends,
        F.filter(_places(final), lambda i: (i == final) | (F.get(nodes, i) != F.get(nodes, i + 1))),
    )
    before = F.concat(F.array(F.lit(-1)), F.col(ends))
    numbered = F.zip_with(
        F.slice(before, F.lit(1), F.size(ends)),
        ends,
        lambda a, b: F.transform(
            F.sequence(F.lit(1), b - a), lambda n: F.xxhash64(F.get(nodes, b), n)
        ),
    )
    return frame.withColumn(nodes, F.flatten(numbered)).drop(pieces, ends)


def with_likeness(frame: DataFrame, left: str, right: dict[str, str]) -> DataFrame:
    """The likeness of fingerprint ``left`` to others: ``right`` names a new column for each."""
    own = "_own_nodes"
    frame = with_nodes(frame, left, own)
    for fingerprint, name in right.items():
        nodes = f"_{name}_nodes"
        frame = with_nodes(frame, fingerprint, nodes)
        common = F.size(F.array_intersect(own, nodes)) * F.lit(2.0)
        total = F.size(own) + F.size(nodes) + 2  # the roots are nodes as well
        same = F.substring(left, 1, DIGEST) == F.substring(fingerprint, 1, DIGEST)
        frame = frame.withColumn(name, F.when(same, F.lit(1.0)).otherwise(common / total))
        frame = frame.drop(nodes)
    return frame.drop(own)


def first_difference(left: str, right: str) -> Column:
    """Place of the first differing paragraph, found by the first differing section; null if none.

    Sections up to there are equal, hence of equal places, so leaves are compared in one section.
    """
    a, b = F.col(f"{left}_sections"), F.col(f"{right}_sections")
    ours, theirs = F.col(f"{left}_leaves"), F.col(f"{right}_leaves")
    equal = F.zip_with(a["digest"], b["digest"], lambda x, y: F.coalesce(x == y, F.lit(False)))
    branch = F.array_position(equal, F.lit(False))
    first = F.get(a, branch.cast("int") - 1)["first"]
    first = F.coalesce(first, F.get(b, branch.cast("int") - 1)["first"])
    tail = lambda x: F.slice(x, first + 1, F.greatest(F.size(x), F.lit(1)))
    same = F.zip_with(tail(ours), tail(theirs), lambda x, y: F.coalesce(x == y, F.lit(False)))
    place = first + F.array_position(same, F.lit(False)) - 1
    return F.when(branch > 0, place).cast("bigint")


def _block(value: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the value, by binary search; null comes last."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    found = F.aggregate(
        F.lit(steps or [0]).cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at),
    )
    return F.when(value.isNull(), F.lit(len(bounds))).otherwise(found)


def block_bounds(rows: DataFrame, size: Column, blocks: int) -> tuple[list[int], list[tuple]]:
    """First ids of the blocks but the first, cut so that blocks hold about equal bytes, and
    (first id, block before) of every block that has one before it.

    Ids are taken apart into ``FINE`` ranges a block, whose bytes are added up; only ranges reach
    the driver. A range is in one block whole, so a block exceeds its share by one range at most.
    """
    fine = FINE * blocks
    marks = [i / fine for i in range(1, fine)]
    bounds = rows.agg(F.percentile_approx("_id", marks, max(1000, 20 * fine))).first()[0]
    bounds = sorted(set(bounds or []))
    ranges = (
        rows.groupBy(_block(F.col("_id"), bounds).alias("range"))
        .agg(F.min("_id").alias("first"), F.sum(size).alias("bytes"))
        .orderBy("range")
        .collect()
    )
    share = max(1, sum(r["bytes"] for r in ranges)) / blocks
    cuts, ahead, held, now = [], [], 0, 0
    for r in ranges:
        # The middle of a range says which share of all bytes it lies in.
        at = int((held + r["bytes"] / 2) / share)
        # Ids that are null are the last range and belong to the block before them.
        if held and at > now and r["first"] is not None:
            ahead.append((r["first"], len(cuts)))
            cuts.append(r["first"])
        held, now = held + r["bytes"], at
    return cuts, ahead


def with_next(rows: DataFrame, order: list[Column], prefix: str) -> DataFrame:
    """``rows`` (``_id``, ``text``) with their trees, plus ``_next_text`` and the fingerprint
    ``next_fingerprint`` of the row that follows, after the last the first.

    Rows meet in blocks of neighbouring ids, at most as many as shuffle partitions and one a
    partition; the first ids of a block go to the block before as well. So the texts are shuffled
    once, trees are built where they meet, and the driver holds a few numbers per block.
    """
    spark = rows.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = F.octet_length("text") + F.lit(64)
    bounds, ahead = block_bounds(rows, size, blocks)
    first = rows.agg(F.min("_id")).first()[0]
    ahead.append((first, len(bounds)))  # the first row follows the last
    table = spark.createDataFrame(ahead, "_first long, _before int")
    here = F.struct(_block(F.col("_id"), bounds).alias("block"), F.lit(False).alias("ahead"))
    there = F.struct(F.col("_before").alias("block"), F.lit(True).alias("ahead"))
    dealt = (
        rows.join(F.broadcast(table), F.col("_id").eqNullSafe(F.col("_first")), "left")
        .withColumn(
            "_at",
            F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))),
        )
        .select("_id", "text", F.col("_at.block").alias("_block"), F.col("_at.ahead").alias("_ahead"))
        .repartitionById(blocks, "_block")
    )
    dealt = with_tree(dealt, "text", prefix)
    following = Window.partitionBy("_block").orderBy("_ahead", *order)
    # The copies sent ahead sort last, so each block's last own row is followed by one of them.
    return (
        dealt.withColumn("_next_text", F.lead("text").over(following))
        .withColumn("next_fingerprint", F.lead(f"{prefix}_fingerprint").over(following))
        .where("NOT _ahead")
        .drop("_block", "_ahead")
    )


def with_edits(docs: DataFrame) -> DataFrame:
    """Every document with its tree, that of its edited text, the next document's fingerprint, and
    the likeness of its fingerprint to both, ``near_edited`` and ``near_next``.

    The edited text has the last half of the code points (rounded down) replaced by as many from
    the start of the next text, or by all of it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_of().alias("text"))
    rows = with_next(rows, [F.col("_id").asc_nulls_last(), F.col("text")], "own")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), size - half),
            F.substring(F.col("_next_text"), F.lit(1), half),
        ),
    )
    rows = with_tree(rows, "edited", "edited")
    others = {"edited_fingerprint": "near_edited", "next_fingerprint": "near_next"}
    return with_likeness(rows, "own_fingerprint", others)
