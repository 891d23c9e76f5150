"""Tables of vectors as packed blocks, and work on pairs of blocks.

What compares many vectors with many others travels as blocks of bounded size:
one table's blocks lie in one slot each, the other's are sent to every slot, and
each pair of blocks is a row that a worker scores by one matrix product. No
vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers in a block (eight bytes each), and rows at most.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 18, 4096
#: Bytes of blocks that a worker gets at once.
BATCH_BYTES = str(16 << 20)
#: Inner products (eight bytes each) that a worker holds at once, or those of one row.
PRODUCTS_HELD = 1 << 20
#: Slots for each core of the session.
SLOTS_EACH = 2

BLOCK = "ids array<bigint>, vectors binary, width int, scopes array<string>"


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers of one length as rows; null and shorter ones are filled with zeros, and so are values that aren't finite."""
    sizes = np.maximum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def packed(table: DataFrame, id_column: str, vector_column: str, scope_column: str | None = None, group_column: str | None = None, normalised: bool = True) -> DataFrame:
    """Blocks of a table: ids, vectors (scaled to length 1 unless said otherwise), their width and, with a column of it, scopes as text.

    With ``group_column`` (whole numbers) a block has rows of one group, named in
    the column ``part``; the table is to be sorted by it within partitions.
    """
    bound_batches(table.sparkSession)
    columns = [F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), (F.col(scope_column).cast("string") if scope_column else F.lit(None).cast("string")).alias("scope")]
    columns.append((F.col(group_column).cast("long") if group_column else F.lit(0).cast("long")).alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            vectors = matrix(rows.column("vector").combine_chunks())
            vectors = unit_rows(vectors) if normalised else vectors
            scopes = rows.column("scope").to_pylist() if scope_column else None
            return pa.RecordBatch.from_arrays(
                [pa.array([rows.column("part")[0].as_py()], pa.int64()), pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([vectors.tobytes()], pa.binary()), pa.array([vectors.shape[1]], pa.int32()), pa.array([scopes], pa.list_(pa.string()))],
                names=["part", "ids", "vectors", "width", "scopes"],
            )

        count, size, part = 0, BLOCK_ROWS, None
        for batch in batches:
            groups = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)] if len(groups) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if count and (part != groups[a] or count >= size):
                        yield block()
                        held.clear()
                        count = 0
                    if not count:
                        part = groups[a]
                        first = batch.column("vector")[a]
                        size = max(16, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, len(first) if first.is_valid else 1)))
                    take = min(b - a, size - count)
                    held.append(batch.slice(a, take))
                    count += take
                    a += take
        if count:
            yield block()

    return table.select(*columns).mapInArrow(pack, f"part long, {BLOCK}")


class Block:
    """One block as a worker gets it."""

    def __init__(self, ids: list[int], vectors: bytes, width: int, scopes: list[str] | None):
        self.ids = np.array(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(ids), width)
        self.scopes = np.array(scopes, object) if scopes is not None else None


    def slices(self, other: Block) -> Iterator[Block]:
        """The block in slices, whose products with another block's vectors are few enough to be held."""
        size = max(1, PRODUCTS_HELD // max(1, len(other.ids)))
        for at in range(0, len(self.ids), size):
            part = copy(self)
            part.ids, part.vectors = self.ids[at : at + size], self.vectors[at : at + size]
            part.scopes = None if self.scopes is None else self.scopes[at : at + size]
            yield part


def products(left: Block, right: Block) -> np.ndarray:
    """Inner products of each two vectors; of different widths the shorter counts as if zeros followed."""
    width = min(left.vectors.shape[1], right.vectors.shape[1])
    return left.vectors[:, :width] @ right.vectors[:, :width].T


def paired(left: DataFrame, right: DataFrame, on: str | None = None) -> DataFrame:
    """Pairs of blocks (ids, vectors, width, scopes of either, as l_ and r_): those of one ``part``, or each with each by slots.

    The right table's blocks are sent to every slot, so it is to be the smaller one.
    """
    names = ("ids", "vectors", "width", "scopes")
    one = left.select(*([on] if on else []), *(F.col(name).alias(f"l_{name}") for name in names))
    two = right.select(*([on] if on else []), *(F.col(name).alias(f"r_{name}") for name in names))
    if not on:
        slots = SLOTS_EACH * left.sparkSession.sparkContext.defaultParallelism
        on = "slot"
        one = one.withColumn(on, F.pmod(F.xxhash64("l_ids"), F.lit(slots)))
        two = two.withColumn(on, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return one.join(two, on).select(*(f"{side}_{name}" for side in "lr" for name in names))


def on_pairs(pairs: DataFrame, work: Callable[[Block, Block], list], types: str) -> DataFrame:
    """The rows that ``work`` gives, as columns, for each pair of blocks."""
    names = [part.split()[0] for part in types.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[part.split()[1]] for part in types.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(8)]
                found = work(Block(*row[:4]), Block(*row[4:]))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(found, kinds, strict=True)], names=names)

    return pairs.mapInArrow(run, types)


def nearest(vectors: Block, queries: Block, k: int, threshold: float, exclude_self: bool, same_scope: bool) -> list:
    """(query_id, vec_id, score) of each query's ``k`` nearest vectors of a block, from ``threshold`` up; ties go to the lower id."""
    found = [_nearest(vectors, part, k, threshold, exclude_self, same_scope) for part in queries.slices(vectors)]
    return [np.concatenate(column) for column in zip(*found, strict=True)]


def _nearest(vectors: Block, queries: Block, k: int, threshold: float, exclude_self: bool, same_scope: bool) -> list:
    scores = np.round(products(queries, vectors), 9)
    if same_scope:
        agree = (queries.scopes[:, None] == vectors.scopes[None, :]) & (queries.scopes != None)[:, None]  # noqa: E711
        scores[~agree] = -np.inf
    if exclude_self:
        scores[queries.ids[:, None] == vectors.ids[None, :]] = -np.inf
    if scores.shape[1] > 4 * k:  # only what reaches the k-th score is ordered
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, c = np.nonzero(scores >= np.maximum(least, threshold)[:, None])
    else:
        q, c = np.nonzero(scores >= threshold)
    own = scores[q, c]
    order = np.lexsort((vectors.ids[c], -own, q))
    q, c, own = q[order], c[order], own[order]
    first = np.searchsorted(q, q)
    best = np.arange(len(q)) - first < k
    return [queries.ids[q[best]], vectors.ids[c[best]], own[best]]
