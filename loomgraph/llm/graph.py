"""Connected components of an edge table too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialize

#: Links up to which one task joins them (16 bytes each); more are worked off in rounds over the cluster, with the same result.
TASK_LINKS = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up, above := up[up]):
            up = above
        u, v = up[u], up[v]
        open_ = u != v
        u, v = u[open_], v[open_]
    return nodes, nodes[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(column.to_numpy() for column in batch.columns) for batch in batches if batch.num_rows]
        if parts:
            nodes, roots = forest(*(np.concatenate(side) for side in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def _in_rounds(edges: DataFrame, rounds: int) -> DataFrame:
    seen = None
    for _ in range(rounds):
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = around.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(down.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components haven't converged in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def components(links: DataFrame, rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the component's least node.

    Up to ``task_links`` links are joined by one task, since they fit it. More
    of them alternate large-star and small-star steps, so the number of rounds
    grows with the logarithm of the nodes. Each round's edges are written to the
    shared folder; only their number and a checksum come to the driver. A hub's
    neighbours are never gathered: its least neighbour is an aggregate that is
    joined back. Loops and repeated links change nothing.
    """
    both = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(both, "edges")
    if edges.count() <= task_links:
        roots = materialize(_in_one_task(edges), "roots")
        discard(edges)
        return roots
    return _in_rounds(edges, rounds)
