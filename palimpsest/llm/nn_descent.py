"""Near-duplicate vectors by comparing all pairs in blocks.

Equal vectors are one class.  Classes of one length are dealt into blocks by hash, and each
pair of blocks is compared once, so every link is counted whatever the groups look like.  A
pair of blocks hands on the number of links of each class and a spanning forest of them,
not the links.  The work is quadratic in the classes: exact link counts need all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, Workspace, key_of, table
from .graph import connected_components

THRESHOLD = 0.9
#: Vectors of a block and their bytes at most, but so many vectors at least; rows of a block that are compared at once.
BLOCK, BLOCK_BYTES, LEAST_BLOCK, STRIP = 4096, 1 << 20, 64, 512
#: Tasks that compare block pairs at most.
MOST_TASKS = 20_000


def unit_rows(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f4").reshape(len(vectors), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mult, embedding) to (id, mult, dim, v); drops nothing: rows are finite and non-zero."""
    for batch in batches:
        v = [np.array(x, "<f4").tobytes() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in v], pa.int32()), pa.array(v, pa.binary())], names=["id", "mult", "dim", "v"])


def _runs(batches: Iterator[pa.RecordBatch], same: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``same`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:same] != held[0][:same]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for seed in range(len(linked)):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            out += [(i, j) for j in new.tolist()]
            front += new.tolist()
    return out


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit rows of ``x`` are linked with which of ``y``: by single precision where that is sure, else by double."""
    out = np.zeros((len(x), len(y)), bool)
    x4, y4, slack = x.astype("<f4"), y.astype("<f4").T, 1e-6 + 2e-7 * x.shape[1]
    for s in range(0, len(x), STRIP):
        sims = x4[s : s + STRIP] @ y4
        at, to = np.nonzero(sims >= threshold - slack)
        ok = sims[at, to] >= threshold + slack
        unsure = np.flatnonzero(~ok)
        for k in range(0, len(unsure), 50_000):
            i = unsure[k : k + 50_000]
            ok[i] = np.einsum("ij,ij->i", x[s + at[i]], y[to[i]]) >= threshold
        out[s + at[ok], to[ok]] = True
    return out


BLOCKS = "dim int, block int, ids binary, mults binary, vs binary"
_BLOCKS = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("mults", pa.binary()), ("vs", pa.binary())])


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, block, id, mult, v) sorted by dim and block to a row for each block."""
    for rows in _runs(batches, 2):
        ids, mults = (np.array([r[k] for r in rows], "<i8").tobytes() for k in (2, 3))
        cols = [[rows[0][0]], [rows[0][1]], [ids], [mults], [b"".join(r[4] for r in rows)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOCKS, strict=True)], schema=_BLOCKS)


def _block_links(threshold: float):
    """Rows (dim, i, j, ids, mults, vs) of block pairs: links of each node that has some, and a forest."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            if len(rows) == 1 and rows[0][1] != rows[0][2]:  # the other block is empty
                continue
            sides = [(np.frombuffer(r[3], "<i8"), np.frombuffer(r[4], "<i8"), unit_rows([r[5][i : i + 4 * r[0]] for i in range(0, len(r[5]), 4 * r[0])])) for r in rows]
            (ids, mult, x), (other, other_mult, y) = sides[0], sides[-1]
            linked = _linked(x, y, threshold)
            if len(sides) == 1:
                np.fill_diagonal(linked, False)
            p, q = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            linked = linked[np.ix_(p, q)]
            node, n = ids[p], linked @ other_mult[q]
            if len(sides) == 2:
                node, n = np.concatenate([node, other[q]]), np.concatenate([n, linked.T @ mult[p]])
                both = np.zeros((len(node), len(node)), bool)
                both[: len(p), len(p) :], both[len(p) :, : len(p)] = linked, linked.T
                linked = both
            edges = _forest(linked)
            m = len(edges)
            yield pa.RecordBatch.from_arrays([
                pa.array([*node.tolist(), *[None] * m], pa.int64()), pa.array([*n.tolist(), *[None] * m], pa.int64()),
                pa.array([*[None] * len(node), *[int(node[i]) for i, _ in edges]], pa.int64()), pa.array([*[None] * len(node), *[int(node[j]) for _, j in edges]], pa.int64()),
            ], schema=schema)

    return run


def links_and_edges(ws: Workspace, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``id, n`` of the classes that have links, and edges ``a, b`` with the components of all links."""
    per_block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (4 * F.col("dim")))))
    sizes = ws.save(vectors.groupBy("dim").agg(F.ceil(F.count("*") / per_block).cast("int").alias("n_blocks")), "sizes")
    pairs = sizes.agg(F.coalesce(F.sum(F.col("n_blocks").cast("long") * (F.col("n_blocks") + 1) / 2), F.lit(0))).first()[0]
    rows = vectors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    rows = rows.select("dim", "block", "id", "mult", "v").repartition("dim", "block").sortWithinPartitions("dim", "block", "id")
    blocks = ws.save(rows.mapInArrow(_pack_blocks, BLOCKS), "blocks")
    rows = blocks.join(sizes, "dim").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("dim", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "ids", "mults", "vs")
    # about a pair of blocks a task, as each is a few MB
    rows = rows.repartition(max(1, min(int(pairs), MOST_TASKS)), "dim", "i", "j").sortWithinPartitions("dim", "i", "j")
    found = ws.save(rows.mapInArrow(_block_links(threshold), "id long, n long, a long, b long"), "found")
    return found.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")), found.where("a is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding)``.

    Vectors are linked when their cosine in double precision is ``threshold`` or more;
    ``n_links`` counts the other vectors, ``component_id`` is the smallest vec_id that links
    reach and ``kept`` says whether that is the row's own.  Vectors that are null, empty or
    zero or hold nulls, NaNs or infinities have no links, nor do vectors of different
    lengths with one another.  Rows that repeat id and vector are one vector; rows with one
    id and different vectors are different vectors.  A null id sorts last.  An empty table
    gives no rows.  Other columns are ignored.
    """
    ws = Workspace(vectors.sparkSession, "vectors")
    rows = vectors.select(key_of("vec_id").alias("key"), F.col("embedding").cast("array<float>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = ws.save(rows.withColumn("valid", valid), "rows")
    plain = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # -0 counts as 0
    good = rows.where("valid").select("key", plain.alias("embedding")).distinct()
    classes = good.groupBy("embedding").agg(F.min("key").alias("rep"), F.count("*").alias("mult"))
    classes = ws.save(classes.withColumn("id", F.xxhash64("rep", "embedding")), "classes")
    packed = ws.save(classes.select("id", "mult", "embedding").mapInArrow(_pack_vectors, "id long, mult long, dim int, v binary"), "vectors")

    links, edges = links_and_edges(ws, packed, threshold)
    roots = connected_components(ws, edges, "final")
    named = classes.select("id", "rep", "mult").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    known = named.join(least, "root").join(links, "id", "left")
    known = known.select("id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component")
    known = ws.save(classes.select("id", "embedding").join(known, "id"), "known")

    out = rows.withColumn("_e", F.when(F.col("valid"), plain)).join(known.withColumnRenamed("embedding", "_e").drop("id"), "_e", "left")
    real = lambda c: F.when(c != NULL_ID, c)
    component = F.coalesce("component", "key")
    return out.select(real(F.col("key")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real(component).alias("component_id"), (component == F.col("key")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
