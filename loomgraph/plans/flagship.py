"""The flagship query: vector search, graph expansion and personalised PageRank in one plan.

For each query vector the nearest vectors are found exactly, their own nearest
neighbours span the query's subgraph, a walk restarted at the three best
spreads over it, and what it scores is fused with the cosine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph, retrieve
from loomgraph.plans.fixtures import walks_sql
from loomgraph.plans.registry import query
from loomgraph.sources.shared import cut
from loomgraph.sources.tables import read_table

EVERY = 100
NEAREST, SEEDS, NEIGHBOURS, RETURNED = 12, 3, 4, 10


_COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


@query("flagship", f"""WITH near AS MATERIALIZED (SELECT a.vec_id AS q, b.vec_id AS v, {_COSINE} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0 AND {_COSINE} >= 0.05 QUALIFY rank <= {NEAREST}),
around AS MATERIALIZED (SELECT a.vec_id AS src, b.vec_id AS dst, {_COSINE} AS confidence FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT v FROM near)) a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE {_COSINE} >= 0.05 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) <= {NEIGHBOURS}),
among AS MATERIALIZED (SELECT q, src, dst, confidence FROM near JOIN around ON src = v),
ent AS MATERIALIZED (SELECT DISTINCT n.q, n.node, CASE WHEN s.rank <= {SEEDS} THEN 0 ELSE 1 END AS hops FROM (SELECT q, src AS node FROM among UNION SELECT q, dst FROM among UNION SELECT q, v FROM near) n LEFT JOIN near s ON s.q = n.q AND s.v = n.node AND s.rank <= {SEEDS}),
{walks_sql()},
fin AS (SELECT v.q, v.node, round(v.v, 6) AS walk, round(0.5 * coalesce(near.score, 0) + 0.5 * v.v, 6) AS fused FROM v5 v LEFT JOIN near ON near.q = v.q AND near.v = v.node)
SELECT q AS query_id, node, walk, fused, CAST(row_number() OVER (PARTITION BY q ORDER BY fused DESC, node) AS INTEGER) AS rank FROM fin QUALIFY rank <= {RETURNED}""")  # fmt: skip
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    near = retrieve.vector_top_k(queries, vectors, NEAREST, threshold=0.05)
    near = cut(near)
    found = near.select(F.col("vec_id").alias("query_id")).distinct()
    around = retrieve.vector_top_k(vectors.join(found, F.col("vec_id") == F.col("query_id"), "left_semi").withColumnRenamed("vec_id", "query_id"), vectors, NEIGHBOURS, threshold=0.05, exclude_self=True)
    edges = near.select("query_id", F.col("vec_id").alias("src")).join(around.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("confidence")), "src")
    edges = cut(edges)
    nodes = edges.select("query_id", F.explode(F.array("src", "dst")).alias("node")).union(near.select("query_id", "vec_id")).distinct()
    seeds = near.filter(F.col("rank") <= SEEDS).select("query_id", F.col("vec_id").alias("node"))
    walked = graph.personalized_pagerank(nodes, edges, seeds)
    cosine = near.select("query_id", F.col("vec_id").alias("node"), F.col("score").alias("cosine"))
    both = walked.join(cosine, ["query_id", "node"], "left").withColumn("fused", F.round(0.5 * F.coalesce("cosine", F.lit(0.0)) + 0.5 * F.col("score"), 6))
    return retrieve.top_per_query(both.select("query_id", "node", F.round("score", 6).alias("walk"), "fused"), RETURNED, F.desc("fused"), F.col("node"))
