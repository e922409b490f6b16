"""Links between embedding vectors of one label, found with product quantisation.

Coarse centroids divide the unit vectors of every label into inverted lists. A vector is stored in
the list of its nearest centroid, as the codes of its residual's subspaces and the length of what
the codes leave out. It probes every list that can hold a vector close enough: two unit vectors
whose cosine reaches the limit lie within ``reach`` of each other, so a list is out of reach once
the vector is further than that from the plane between the list's centroid and another. In a list,
table lookups give the distance from the probing vector to each stored code; a code further off
than ``reach`` plus what it leaves out cannot link. The exact cosine, in double precision, decides
the rest. With ``margin`` 1 no link is lost, whatever the centroids; they, and the codes, are fitted on
a bounded sample and only set how much is looked at.

Equal vectors of a label are made one and counted first. A list that is too long for one task is
divided into blocks that meet pairwise. A block reports the number of links of each vector and
hangs linked vectors on one of them, so links are counted where they are found and never listed.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do
vectors with a null label or vectors of different lengths. Repeated rows are rows of their own that
link with each other. A null ``vec_id`` names a component only if all its ids are null; then all of
its rows are kept. An empty table has an empty result. Further columns are ignored. A vector has no
text; its length is limited by what fits one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import components, identity, ship
from basketry.operators.skew import salted_lookup
from basketry.sources.storage import stage

ship(__name__)

# Distances are compared with this much to spare, so that rounding loses no link.
SLACK = 1e-6


@dataclass(frozen=True)
class LinkParams:
    """The smallest cosine of a link, and how links are searched.

    ``sample`` rows at most fit the centroids and codes. ``lists`` is their number; unset, it
    grows with the fourth root of the distinct vectors. A residual is cut into ``subspaces`` parts of
    ``codewords`` each. ``block`` rows of a list meet as many others in one task. ``margin`` scales the
    reach of the probes: 1 finds every link, 0.5 all whose difference does not point at a centroid.
    """

    cosine: float = 0.98
    sample: int = 16_384
    lists: int | None = None
    max_lists: int = 4_096
    subspaces: int = 16
    codewords: int = 16
    block: int = 2_048
    margin: float = 1.0
    rounds: int = 8
    seed: int = 42

    @property
    def reach(self) -> float:
        """Largest distance of two unit vectors that link."""
        return math.sqrt(2.0 - 2.0 * self.cosine)


@dataclass(frozen=True)
class Codebook:
    """Coarse centroids and, for each subspace, its columns and codewords."""

    centroids: np.ndarray
    cuts: list[tuple[int, int]]
    words: list[np.ndarray]


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link at all."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull()
        & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < F.lit(math.inf)),
    )
    some = F.exists(vector, lambda x: x != 0)
    return label.isNotNull() & F.coalesce(finite & some, F.lit(False))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length in double precision, filled with zeros up to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    # Scaled first, so that squares neither overflow nor vanish.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(axis=1) - 2 * rows @ centers.T).argmin(axis=1)


def means(rows: np.ndarray, count: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centers of at most ``count`` clusters (Lloyd's rounds from random distinct rows)."""
    distinct = np.unique(rows, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:count]].copy()
    for _ in range(rounds):
        owner = nearest(rows, centers)
        sizes = np.bincount(owner, minlength=len(centers))
        for j in np.flatnonzero(sizes):
            centers[j] = rows[owner == j].mean(axis=0)
    return centers


def fit(rows: np.ndarray, lists: int, params: LinkParams) -> Codebook:
    """Centroids of the rows and codewords of their residuals."""
    rng = np.random.default_rng(params.seed)
    centroids = means(rows, lists, params.rounds, rng)
    residuals = rows - centroids[nearest(rows, centroids)]
    edges = np.linspace(0, rows.shape[1], min(params.subspaces, rows.shape[1]) + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    words = [means(residuals[:, a:b], params.codewords, params.rounds, rng) for a, b in cuts]
    return Codebook(centroids, cuts, words)


def encode(residuals: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the length of what they leave out."""
    codes = np.zeros((len(residuals), len(book.cuts)), np.uint8)
    rest = np.zeros(len(residuals))
    for m, ((a, b), words) in enumerate(zip(book.cuts, book.words)):
        part = residuals[:, a:b]
        codes[:, m] = nearest(part, words)
        rest += ((part - words[codes[:, m]]) ** 2).sum(axis=1)
    return codes, np.sqrt(rest)


def probes(rows: np.ndarray, book: Codebook, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest list of every row, and whether it must probe each list before that one.

    A pair of two lists meets in the first of them. A row is at least as far from a list as from
    the plane between the list's centroid and the row's own; centroids are distinct.
    """
    c = book.centroids
    far = (c * c).sum(axis=1) - 2 * rows @ c.T
    own = far.argmin(axis=1)
    gaps = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0)) if len(c) <= 512 else None
    out = np.zeros(far.shape, bool)
    for j in np.unique(own):
        mine = own == j
        apart = gaps[j] if gaps is not None else np.sqrt(((c - c[j]) ** 2).sum(axis=1))
        out[mine, :j] = far[mine, :j] - far[mine, j : j + 1] <= 2 * (reach + SLACK) * apart[:j]
    return own, out


def close(queries: np.ndarray, codes: np.ndarray, rest: np.ndarray, book: Codebook, reach: float):
    """Which stored codes may link with residuals of queries, by table lookups."""
    square = np.zeros((len(queries), len(codes)))
    for m, ((a, b), words) in enumerate(zip(book.cuts, book.words)):
        part = queries[:, a:b]
        table = (
            (part * part).sum(axis=1)[:, None] - 2 * part @ words.T + (words * words).sum(axis=1)
        )
        square += table[:, codes[:, m]]
    return np.sqrt(np.maximum(square, 0)) <= reach + rest + SLACK


def linked_parts(links: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of every connected part of a matrix of links, each looked at once."""
    rows_left = links.any(axis=1)
    while rows_left.any():
        new = np.flatnonzero(rows_left)[:1]
        rows, columns = np.zeros(len(links), bool), np.zeros(links.shape[1], bool)
        while len(new):
            rows[new] = True
            reached = links[new].any(axis=0) & ~columns
            columns |= reached
            new = np.flatnonzero(links[:, reached].any(axis=1) & ~rows)
        rows_left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(columns)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``_node, _k1, _k2, label, embedding, _m, _first``: usable vectors, equal ones counted."""
    rows = vectors.where(usable(F.col("embedding"), F.col("label")))
    return rows.groupBy("_k1", "_k2").agg(
        F.first("label").alias("label"),
        F.first("embedding").alias("embedding"),
        F.count(F.lit(1)).alias("_m"),
        F.min("vec_id").alias("_first"),
    ).withColumn("_node", F.monotonically_increasing_id())


def codebook(vectors: DataFrame, params: LinkParams) -> tuple[Codebook, int] | None:
    """Fitted on a sample by the vectors' hash, of ``params.sample`` rows at most."""
    count, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not count:
        return None
    share = min(1.0, 1.25 * params.sample / count)
    chosen = F.pmod("_k1", F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
    sample = vectors.where(chosen).orderBy("_k2", "_k1").limit(params.sample)
    column = sample.select("embedding").toArrow().column(0).combine_chunks()
    rows = unit_rows(column, width)
    lists = params.lists or min(params.max_lists, max(1, round(4 * count**0.25)))
    return fit(rows, max(1, min(lists, len(rows) // 8)), params), width


def assigned(vectors: DataFrame, book: Codebook, width: int, params: LinkParams) -> DataFrame:
    """Vectors with their list, codes, the codes' rest and the lists they probe."""
    reach = params.reach * params.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column("embedding"), width)
            own, probed = probes(rows, book, reach)
            codes, rest = encode(rows - book.centroids[own], book)
            lists = [np.flatnonzero(p).astype(np.int32) for p in probed]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(own.astype(np.int32)),
                    pa.array(lists, pa.list_(pa.int32())),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(rest),
                ],
                names=[*batch.schema.names, "_list", "_probed", "_codes", "_rest"],
            )

    schema = T.StructType(list(vectors.schema.fields))
    schema.add("_list", T.IntegerType()).add("_probed", T.ArrayType(T.IntegerType()))
    schema.add("_codes", T.BinaryType()).add("_rest", T.DoubleType())
    return vectors.mapInArrow(run, schema)


def meetings(stored: DataFrame, params: LinkParams) -> DataFrame:
    """Every stored row and every probing row once in each pair of blocks where it takes part.

    ``_home`` marks the stored side. Blocks hold ``params.block`` rows on average, by the hash of
    the vector.
    """
    lists = ["label", "_size", "_list"]
    sized = stored.withColumn("_size", F.size("embedding"))
    # Map-side sums: a row per list and task is shuffled, however long a list is.
    at_home = sized.groupBy(*lists).agg(F.count(F.lit(1)).alias("_stored"))
    coming = (
        sized.select("label", "_size", F.explode("_probed").alias("_list"))
        .groupBy(*lists)
        .agg(F.count(F.lit(1)).alias("_probing"))
    )
    blocks = at_home.join(coming, lists, "left").select(
        *lists,
        F.ceil(F.col("_stored") / params.block).cast("int").alias("_a"),
        F.ceil((F.col("_stored") + F.coalesce("_probing", F.lit(0))) / params.block)
        .cast("int")
        .alias("_b"),
    )
    vector = ["_node", "_m", "embedding"]
    home = sized.select(*lists, *vector, "_codes", "_rest", F.lit(True).alias("_home"), F.lit(True).alias("_own"))
    guests = sized.select(
        "label",
        "_size",
        F.explode(F.concat(F.col("_probed"), F.array("_list"))).alias("_to"),
        *vector,
        (F.col("_to") == F.col("_list")).alias("_own"),
    ).select(
        "label",
        "_size",
        F.col("_to").alias("_list"),
        *vector,
        F.lit(None).cast("binary").alias("_codes"),
        F.lit(None).cast("double").alias("_rest"),
        F.lit(False).alias("_home"),
        "_own",
    )
    both = salted_lookup(home.unionByName(guests), blocks, lists, ["_node"])
    part = F.xxhash64("_node")
    mine = F.when(F.col("_home"), F.pmod(part, F.col("_a"))).otherwise(F.pmod(part, F.col("_b")))
    others = F.sequence(F.lit(0), F.when(F.col("_home"), F.col("_b")).otherwise(F.col("_a")) - 1)
    return (
        both.withColumn("_mine", mine.cast("int"))
        .withColumn("_other", F.explode(others))
        .select(
            *lists,
            F.when(F.col("_home"), F.col("_mine")).otherwise(F.col("_other")).alias("_x"),
            F.when(F.col("_home"), F.col("_other")).otherwise(F.col("_mine")).alias("_y"),
            *vector,
            "_codes",
            "_rest",
            "_home",
            "_own",
        )
    )


def found_links(meeting: DataFrame, book: Codebook, width: int, params: LinkParams) -> DataFrame:
    """``node, n, other``: how many rows a vector links with in a pair of blocks, and one vector
    of its connected part there.
    """
    reach, limit = params.reach, params.cosine

    def run(table: pa.Table) -> pa.Table:
        at_home = table.column("_home").to_numpy()
        home, guests = table.filter(pa.array(at_home)), table.filter(pa.array(~at_home))
        counts: dict[int, int] = {}
        out = ([], [], [])

        def rows_of(part: pa.Table) -> np.ndarray:
            return unit_rows(part.column("embedding").combine_chunks(), width)

        if len(home) and len(guests):
            stored, coming = rows_of(home), rows_of(guests)
            codes = np.frombuffer(b"".join(home.column("_codes").to_pylist()), np.uint8)
            codes = codes.reshape(len(home), -1)
            rest = home.column("_rest").to_numpy()
            center = book.centroids[table.column("_list")[0].as_py()]
            node_h, node_g = home.column("_node").to_numpy(), guests.column("_node").to_numpy()
            m_h, m_g = home.column("_m").to_numpy(), guests.column("_m").to_numpy()
            own = guests.column("_own").to_numpy()
            links = np.zeros((len(coming), len(stored)), bool)
            step = max(1, (1 << 22) // len(stored))
            for i in range(0, len(coming), step):
                part = coming[i : i + step]
                maybe = close(part - center, codes, rest, book, reach)
                a, b = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
                exact = part[a] @ stored[b].T >= limit
                links[np.ix_(a + i, b)] = exact & maybe[np.ix_(a, b)]
            links &= node_g[:, None] != node_h[None]
            # Rows of the list itself meet from both sides, so they are counted as stored only.
            n_h = m_g @ links
            n_g = np.where(own, 0, links @ m_h)
            for nodes, n in ((node_h, n_h), (node_g, n_g)):
                for k in np.flatnonzero(n):
                    counts[int(nodes[k])] = counts.get(int(nodes[k]), 0) + int(n[k])
            for g, h in linked_parts(links):
                nodes = np.unique(np.concatenate([node_g[g], node_h[h]])).tolist()
                out[0].extend(nodes)
                # A vector can be in two parts, stored in one and probing in the other.
                out[1].extend(counts.pop(node, 0) for node in nodes)
                out[2].extend([nodes[0]] * len(nodes))
        return pa.table(
            {name: pa.array(values, pa.int64()) for name, values in zip(("node", "n", "other"), out)}
        )

    groups = meeting.groupBy("label", "_size", "_list", "_x", "_y")
    return groups.applyInArrow(run, "node long, n long, other long")


def linked(vectors: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector.

    ``n_links`` counts the other vectors linked directly; ``component_id`` is the smallest
    ``vec_id`` reachable over links; ``kept`` marks the vector of that id.
    """
    kind = vectors.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "label",
        F.col("embedding") if narrow else F.col("embedding").cast("array<double>"),
    ).select("*", *identity("label", "embedding"))
    distinct = stage(distinct_vectors(rows), "vectors")
    fitted = codebook(distinct, params)
    alone = [
        F.lit(0).cast("bigint").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    ]
    if fitted is None:
        return rows.select("vec_id", *alone)
    book, width = fitted
    stored = assigned(distinct.select("_node", "label", "embedding", "_m"), book, width, params)
    stored = stage(stored, "lists")
    found = stage(found_links(meetings(stored, params), book, width, params), "links")
    hung = components(found, "node", "other")
    counted = found.groupBy("node").agg(F.sum("n").alias("_n"))
    nodes = (
        distinct.select("_node", "_k1", "_k2", "_m", "_first")
        .join(counted, F.col("_node") == F.col("node"), "left")
        .drop("node")
        .join(hung, F.col("_node") == F.col("node"), "left")
        .select(
            "_k1",
            "_k2",
            "_first",
            (F.coalesce("_n", F.lit(0)) + F.col("_m") - 1).alias("_links"),
            F.coalesce("root", "_node").alias("_root"),
        )
    )
    nodes = stage(nodes, "nodes")
    names = nodes.groupBy("_root").agg(F.min("_first").alias("_name"))
    named = salted_lookup(nodes, names, ["_root"], ["_k1"]).select("_k1", "_k2", "_links", "_name")
    can_link = usable(F.col("embedding"), F.col("label"))
    with_name = salted_lookup(
        rows.select("vec_id", "_k1", "_k2", can_link.alias("_can")),
        named,
        ["_k1", "_k2"],
        ["vec_id"],
        "left",
    )
    name = F.when(F.col("_can"), F.col("_name")).otherwise(F.col("vec_id"))
    return with_name.select(
        "vec_id",
        F.when(F.col("_can"), F.col("_links")).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        name.alias("component_id"),
        F.col("vec_id").eqNullSafe(name).alias("kept"),
    )
