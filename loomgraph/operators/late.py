"""Late-interaction search in a corpus: token vectors in inverted lists, candidates by their summed scores, MaxSim of the best.

A chunk's score is the mean over the query's token vectors of the greatest
product with one of the chunk's. Each query token looks into the lists nearest
to it and so scores, for itself, the chunks that it meets there; the sums over
tokens give a shortlist, which is scored in full. A token's product with what
lies on lists it hasn't looked into is bounded, so exact search knows which
other chunks can still be among the best: those that were met are scored as
well, and queries for which even a chunk that was never met could be go through
all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.blocks import on_pairs, unit_rows
from loomgraph.operators.index import PROBES, SLACK, VectorIndex, _whole, build_index, nearest_lists, on_lists
from loomgraph.operators.retrieve import best_of_chunks, max_sim
from loomgraph.sources.shared import stored

#: Chunks of a query that are scored in full for each that is wanted.
SHORTLIST_EACH = 4


def index_tokens(chunk_tokens: DataFrame, lists: int | None = None) -> VectorIndex:
    """The index of a corpus's token vectors (chunk_id, c_vec), every one of them, as they are."""
    return build_index(chunk_tokens, "chunk_id", "c_vec", lists, normalised=False)


def token_bounds(index: VectorIndex, tokens: DataFrame, probes: int) -> DataFrame:
    """(query_id, scope, floor): the greatest product that a query token can have with a vector on the lists it doesn't look into."""
    shared = tokens.sparkSession.sparkContext.broadcast((index.centroids, index.reach, index.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = VectorIndex(*shared.value, blocks=None)
        for batch in batches:
            vectors = _whole(batch.column(1), own.centroids.shape[1])
            most = np.maximum(own.bounds(vectors), 0) * np.linalg.norm(vectors, axis=1, keepdims=True) * own.length[None, :] + SLACK
            order = np.argsort(-(unit_rows(vectors) @ own.centroids.T), axis=1, kind="stable")
            most[np.arange(len(vectors))[:, None], order[:, :probes]] = -np.inf
            floor = most.max(axis=1, initial=-np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(floor)], names=["query_id", "scope", "floor"])

    return tokens.select("query_id", "embedding", "scope").mapInArrow(run, "query_id long, scope string, floor double")


def late_search(index: VectorIndex, query_tokens: DataFrame, chunk_tokens: DataFrame, k: int, probes: int = PROBES, exact: bool = True, shortlist_each: int = SHORTLIST_EACH) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks of greatest MaxSim for each query, ties by lower id.

    ``query_tokens`` is (query_id, q_token, q_vec) with whole numbers as ids,
    ``chunk_tokens`` what was indexed. Scores are rounded to nine digits before
    they are ranked. Approximate search ranks the shortlist alone.
    """
    tokens = query_tokens.select(F.col("query_id").cast("long").alias("query_id"), F.col("q_vec").cast("array<double>").alias("embedding"), F.concat_ws(":", "query_id", "q_token").alias("scope"))
    met = on_pairs(on_lists(index, nearest_lists(index, tokens, probes), normalised=False), best_of_chunks, "query_id long, q_token long, chunk_id long, best double")
    met = stored(met.groupBy("query_id", "q_token", "chunk_id").agg(F.max("best").alias("best")), "late-met")
    order = W.partitionBy("query_id").orderBy(F.desc("sum"), "chunk_id")
    summed = met.groupBy("query_id", "chunk_id").agg(F.sum("best").alias("sum")).withColumn("r", F.row_number().over(order))
    short = summed.filter(F.col("r") <= shortlist_each * k).select("query_id", "chunk_id")
    in_full = lambda pairs: max_sim(query_tokens, chunk_tokens.join(pairs, "chunk_id")).withColumn("score", F.round("score", 9))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    scored = stored(in_full(short), "late-scored")
    if not exact:
        return top(scored)
    floors = token_bounds(index, tokens, probes).withColumn("q_token", F.substring_index("scope", ":", -1).cast("long")).drop("scope")
    kth = top(scored).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(float("-inf")).alias("least"))
    base = floors.groupBy("query_id").agg(F.sum("floor").alias("base"), F.count(F.lit(1)).alias("n")).join(kth, "query_id", "left")
    least = F.coalesce("least", F.lit(float("-inf"))) - SLACK
    base = stored(base.select("query_id", "base", "n", least.alias("least"), (F.col("base") / F.col("n") >= least).alias("open")), "late-bounds")
    more = met.join(base.filter("NOT open"), "query_id").join(floors, ["query_id", "q_token"])
    gain = F.when(F.col("floor") == float("-inf"), F.col("best")).otherwise(F.greatest(F.lit(0.0), F.col("best") - F.col("floor")))
    # a token that has looked into every list has no floor, and has met every chunk
    ground = F.first(F.when(F.col("base") == float("-inf"), 0.0).otherwise(F.col("base")))
    able = more.groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("gain"), ground.alias("base"), F.first("n").alias("n"), F.first("least").alias("least"))
    able = able.filter((F.col("base") + F.col("gain")) / F.col("n") >= F.col("least")).select("query_id", "chunk_id").join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    through = query_tokens.join(base.filter("open").select("query_id"), "query_id", "left_semi")
    everything = max_sim(through, chunk_tokens).withColumn("score", F.round("score", 9))
    closed = scored.join(base.filter("open").select("query_id"), "query_id", "left_anti").unionByName(in_full(able))
    return top(closed.unionByName(everything))
