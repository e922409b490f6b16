"""Chat formatting as relations: collected turns are sorted as structs, neighbours of one role are
merged with array functions, and everything is concatenated in Spark expressions.

    <|start|>role<|text|>first<|more|>second<|end|><|start|>...

A conversation is one row. Merged turns keep their border (``<|more|>``), so nothing is lost.
Inside roles and texts a backslash is doubled, and one is put into every control string (the
template's own, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``) after its first character; taking
away each backslash that precedes another character gives the text back.

``loss_spans`` marks, in UTF-8 bytes of the output, what a model is trained on: each text of the
trained role, without any marker. Null texts and roles are empty ones; turns are in order of
``turn`` (null first), then role and text, and repeated rows are repeated turns. A null ``conv_id``
is a conversation of its own. A conversation must fit a row, as it is one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, MORE, END = "<|start|>", "<|text|>", "<|more|>", "<|end|>"

#: First character and rest of the strings that must not appear unescaped.
CONTROL = r"(<|\[)(\||s>|/s>|INST\]|/INST\])"


@dataclass(frozen=True)
class ChatParams:
    trained_role: str = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (start and length in bytes)."""
    rows = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Bytes before each text: markers depend on whether a turn opens or closes a merged block.
    opens = ~F.lag("role").over(in_order).eqNullSafe(F.col("role"))
    closes = ~F.lead("role").over(in_order).eqNullSafe(F.col("role"))
    rows = rows.withColumn("opens", opens).withColumn("closes", closes)
    rows = rows.withColumn("name", escaped(F.col("role"))).withColumn("said", escaped("text"))
    head = F.when(
        F.col("opens"), F.octet_length("name") + F.lit(len(START) + len(TEXT))
    ).otherwise(F.lit(len(MORE)))
    tail = F.when(F.col("closes"), F.lit(len(END))).otherwise(F.lit(0))
    rows = rows.withColumn("size", F.octet_length("said").cast("bigint"))
    through = F.sum(head + F.col("size") + tail).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("begin", through - tail - F.col("size"))
    rows = rows.withColumn("place", F.row_number().over(in_order))
    sorted_turns = F.array_sort(
        F.collect_list(
            F.struct("place", "role", "name", "said", "opens", "closes", "begin", "size")
        )
    )
    talks = rows.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    # Runs of one role: where they begin and end, and the texts between.
    numbered = F.sequence(F.lit(0), F.size("turns") - 1)
    at = lambda i: F.get(F.col("turns"), i)
    talks = talks.withColumn("first", F.filter(numbered, lambda i: at(i)["opens"]))
    talks = talks.withColumn("last", F.filter(numbered, lambda i: at(i)["closes"]))
    blocks = F.zip_with(
        "first",
        "last",
        lambda a, b: F.concat(
            F.lit(START),
            at(a)["name"],
            F.lit(TEXT),
            F.array_join(
                F.transform(F.slice(F.col("turns"), a + 1, b - a + 1), lambda t: t["said"]), MORE
            ),
            F.lit(END),
        ),
    )
    trained = F.filter("turns", lambda t: t["role"] == F.lit(params.trained_role))
    spans = F.transform(
        trained, lambda t: F.struct(t["begin"].alias("start"), t["size"].alias("length"))
    )
    return talks.select(
        "conv_id",
        F.array_join(blocks, "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parsed(text: Column) -> Column:
    """Turns read back from the output: structs of ``role`` and ``text``."""

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        body = F.get(parts, 1)
        said = F.split(F.substring(body, F.lit(1), F.length(body) - len(END)), r"<\|more\|>")
        return F.transform(
            said,
            lambda s: F.struct(
                unescaped(F.get(parts, 0)).alias("role"), unescaped(s).alias("text")
            ),
        )

    blocks = F.split(text, r"<\|start\|>")
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), turns))


def under_mask(text: str, spans: str) -> Column:
    """The unescaped text under the loss mask, from the output's bytes."""
    raw = F.col(text).cast("binary")
    cut = lambda s: raw.substr(
        (s["start"] + 1).cast("int"), s["length"].cast("int")
    ).cast("string")
    return F.array_join(F.transform(spans, lambda s: unescaped(cut(s))), "")


def digests(talks: DataFrame) -> DataFrame:
    """What is read back from the output, as counts and digests."""
    read = talks.withColumn("_turns", parsed(F.col("formatted")))
    read = read.withColumn("_loss", under_mask("formatted", "loss_spans"))
    told = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
