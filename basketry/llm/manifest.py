"""Merkle manifest of a dataset: a tree of digests per group of rows, and one over the groups.

A leaf is the digest of a row's fields. The leaves of a group ascend by its order column; every
``arity`` consecutive nodes become one parent until a single node, the group's subroot, is left.
The subroots, in order of their groups, become the root the same way.

Every level is a self-join: the node in slot zero of a run computes the indices of its siblings
(XOR in a binary tree, slot offsets otherwise), meets them by an equality of tree and index, and
emits the parent. Runs have ``arity`` nodes at most, so neither a hot group nor a hot key forms.
Positions come from one distributed rank over all rows; texts are hashed where they are read and
never shuffled. Paths are put together from the root down, where tables are small: a leaf meets
only its parent's row.

Nulls in any field are hashed as ``-``, so they differ from empty texts; null groups and null
order values come first. Rows whose order value ties ascend by their leaf, and repeated rows are
leaves of their own with paths of their own. Texts of any length are one field. An empty table
has no rows, no subroots and no root. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import ascii_lower
from basketry.operators.ranks import global_rank
from basketry.operators.skew import salted_lookup
from basketry.sources.storage import stage

KEY = ["_tree", "_idx"]


@dataclass(frozen=True)
class ManifestParams:
    """The hashed fields in their order, the column that names a row's tree, the column that
    orders its leaves, and the nodes of a run.
    """

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "source"
    order: str = "doc_id"
    arity: int = 16


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of all parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of fields: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        size = F.octet_length(value).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def leaves(docs: DataFrame, params: ManifestParams, **replaced: Column) -> DataFrame:
    """``_tree, _idx, _n, _order, digest, claimed``: every row's place and leaf.

    ``claimed`` is the leaf of the row with some fields ``replaced``: what a reader of a changed
    table would find. ``_n`` counts the nodes of the tree's level.
    """
    own = [F.col(f"`{name}`") for name in params.fields]
    changed = [replaced.get(name, F.col(f"`{name}`")) for name in params.fields]
    group = F.col(f"`{params.group}`").cast("string")
    rows = docs.select(
        group.isNotNull().alias("_known"),
        F.coalesce(group, F.lit("")).alias("_group"),
        F.col(f"`{params.order}`").alias("_order"),
        leaf_of(own).alias("digest"),
        leaf_of(changed).alias("claimed"),
        # Keeps repeated rows apart, so that they spread over the ranges of the rank.
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["_known", "_group", F.asc_nulls_first("_order"), "digest", "claimed", "_tie"]
    by = [F.asc(o) if isinstance(o, str) else o for o in order]
    ranked = global_rank(rows, by, "_rank", "_all").drop("_tie", "_all")
    groups = ranked.groupBy("_known", "_group").agg(
        F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    trees = global_rank(groups, [F.asc("_known"), F.asc("_group")], "_tree", "_trees")
    placed = salted_lookup(ranked, trees, ["_known", "_group"], ["_rank"])
    return placed.select(
        "_tree",
        (F.col("_rank") - F.col("_first")).alias("_idx"),
        "_n",
        "_order",
        "digest",
        "claimed",
        "_trees",
    )


def sibling_index(index: Column, offset: Column, arity: int) -> Column:
    """Index of the node ``offset`` slots after slot zero of a run."""
    return index.bitwiseXOR(offset) if arity == 2 else index + offset


def parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The level above: ``_tree, _idx, _n, digest`` and the children's digests in order."""
    last = F.least(F.lit(arity), F.col("_n") - F.col("_idx")) - 1
    heads = (
        nodes.where((F.col("_idx") % arity == 0) & (F.col("_n") > 1))
        .select("_tree", "_idx", "_n", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_slot"))
        .select(
            "_tree",
            F.col("_idx").alias("_head"),
            "_n",
            "_slot",
            sibling_index(F.col("_idx"), F.col("_slot").cast("bigint"), arity).alias("_idx"),
        )
    )
    runs = heads.join(nodes.select(*KEY, "digest"), KEY).groupBy("_tree", "_head", "_n").agg(
        F.array_sort(F.collect_list(F.struct("_slot", "digest"))).alias("_run")
    )
    children = F.transform("_run", lambda node: node["digest"])
    return runs.select(
        "_tree",
        F.floor(F.col("_head") / arity).cast("bigint").alias("_idx"),
        F.ceil(F.col("_n") / arity).cast("bigint").alias("_n"),
        digest(F.array_join(children, "")).alias("digest"),
        children.alias("_children"),
    )


def grow(nodes: DataFrame, arity: int, label: str) -> list[DataFrame]:
    """All levels from the leaves up, each staged; their number is a logarithm of the largest tree."""
    levels = [nodes]
    size = nodes.agg(F.max("_n")).first()[0] or 0
    while size > 1:
        levels.append(stage(parents(levels[-1].select(*KEY, "_n", "digest"), arity), label))
        size = -(-size // arity)
    return levels


def tops(levels: Sequence[DataFrame]) -> DataFrame:
    """``_tree, digest`` of the last node of every tree."""
    return reduce(
        DataFrame.unionByName,
        (level.where(F.col("_n") == 1).select("_tree", "digest") for level in levels),
    )


def with_paths(levels: Sequence[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``_path``, the siblings left and right on every level up to the root.

    ``above`` has ``_tree``, the ``_path`` from the tree's last node on, and columns that every
    leaf of the tree gets, too.
    """
    carried = [name for name in above.columns if name not in ("_tree", "_path")]
    slot = (F.col("_idx") % arity).cast("int")
    children = F.col("_up._children")
    step = F.struct(
        F.array_join(F.slice(children, F.lit(1), slot), "").alias("left"),
        F.array_join(F.slice(children, slot + 2, F.lit(arity)), "").alias("right"),
    )
    upper = None
    for level in reversed(levels):
        own = [F.col(name) for name in level.columns]
        out = level.where(F.col("_n") == 1).join(above, "_tree").select(*own, "_path", *carried)
        if upper is not None:
            up = upper.select(
                F.col("_tree").alias("_t"),
                F.col("_idx").alias("_i"),
                F.struct("_children", "_path", *carried).alias("_up"),
            )
            meets = (F.col("_tree") == F.col("_t")) & (
                F.floor(F.col("_idx") / arity).cast("bigint") == F.col("_i")
            )
            below = level.where(F.col("_n") > 1).join(up, meets)
            out = out.unionByName(
                below.select(
                    *own,
                    F.concat(F.array(step), F.col("_up._path")).alias("_path"),
                    *(F.col(f"_up.{name}").alias(name) for name in carried),
                )
            )
        upper = out
    return upper


def manifest(
    docs: DataFrame, params: ManifestParams = ManifestParams(), **replaced: Column
) -> DataFrame:
    """Every row's leaf, subroot, root and path: ``_order, digest, claimed, subroot, root, _path``."""
    placed = stage(leaves(docs, params, **replaced), "leaves")
    levels = grow(placed, params.arity, "nodes")
    trees = placed.where(F.col("_idx") == 0).select("_tree", F.col("_trees").alias("_n"))
    subroots = stage(tops(levels).join(trees, "_tree"), "subroots").select(
        F.lit(0).cast("bigint").alias("_tree"),
        (F.col("_tree") - 1).alias("_idx"),
        "_n",
        "digest",
        F.col("_tree").alias("_of"),
    )
    top_levels = grow(subroots, params.arity, "top-nodes")
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    root = tops(top_levels).select("_tree", no_path.alias("_path"), F.col("digest").alias("root"))
    above = with_paths(top_levels, root, params.arity).select(
        F.col("_of").alias("_tree"), "_path", F.col("digest").alias("subroot"), "root"
    )
    return with_paths(levels, stage(above, "tops"), params.arity)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    siblings = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return digest(F.array_join(siblings, ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def lower_one_in_five(params: ManifestParams = ManifestParams()) -> Column:
    """The text, lower-cased where 5 divides the CRC-32 of the decimal ``doc_id``."""
    chosen = F.crc32(F.col(params.order).cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, ascii_lower(F.col("text"))).otherwise(F.col("text"))


def verified(docs: DataFrame, params: ManifestParams = ManifestParams(), **replaced) -> DataFrame:
    """One row per document: its proof, and whether the row with ``replaced`` fields folds to the root."""
    rows = manifest(docs, params, **replaced)
    return rows.select(
        F.col("_order").alias(params.order),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("_path")).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("_path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
