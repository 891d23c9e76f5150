"""Queries on retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph, retrieve
from loomgraph.operators.stats import W
from loomgraph.plans import fixtures as fx
from loomgraph.plans.graphs import _ppr_sql, ppr_tables
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table


def vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("scope"))


COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9)"


def _top(scope: str, k: int, least: float, where: str, self_: str = "TRUE") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS score FROM embeddings q JOIN embeddings v ON {scope} AND {self_} WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= {least})
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _named(found):
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk", _top("TRUE", 10, 0.08, "q.vec_id % 100 = 0"))
def vector_topk(spark, sf_dir):
    queries = vectors(spark, sf_dir).filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return _named(retrieve.vector_top_k(queries, vectors(spark, sf_dir), 10))


@query("vector_scoped_topk", _top("q.label = v.label", 5, 0.08, "q.vec_id % 100 = 0"))
def vector_scoped_topk(spark, sf_dir):
    queries = vectors(spark, sf_dir).filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return _named(retrieve.vector_top_k(queries, vectors(spark, sf_dir), 5, same_scope=True))


@query("knn_similar_graph", _top("TRUE", 5, 0.2, "TRUE", "q.vec_id <> v.vec_id"))
def knn_similar_graph(spark, sf_dir):
    queries = vectors(spark, sf_dir).withColumnRenamed("vec_id", "query_id")
    return _named(retrieve.vector_top_k(queries, vectors(spark, sf_dir), 5, threshold=0.2, exclude_self=True))


@query("text_search_terms", """WITH t AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS x, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS o FROM benchmark),
f AS (SELECT query_id, (list_sort([list_position(o, e) FOR e IN x]))[:8] AS ps, o FROM t),
q AS (SELECT query_id, len(ps) AS n, unnest([o[p] FOR p IN ps]) AS term FROM f),
m AS (SELECT query_id, doc_id AS chunk_id, n, count(*) AS matched FROM q JOIN documents ON contains(lower(text), term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched / n DESC, chunk_id) AS rank FROM m)
SELECT query_id, chunk_id, CAST(matched AS BIGINT) AS matched, round(matched / n, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")  # fmt: skip
def text_search_terms(spark, sf_dir):
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    chunks = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieve.text_search(queries, chunks, 10).select("query_id", "chunk_id", "matched", F.round("score", 6).alias("score"), "rank")


@query("symbolic_lookup", f"""WITH {fx.ENTITIES}, q AS (SELECT n_nationkey AS query_id, 'which supplier ' || n_name || ' of region ' || r_name AS q FROM nation JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT query_id, lower(q) AS q, entity_id, lower(name) AS name FROM q, entities WHERE length(name) >= 4),
s AS (SELECT query_id, entity_id, name, contains(q, name)::INT AS in_question, contains(name, q)::INT AS holds_question,
      len([t FOR t IN list_distinct([x FOR x IN regexp_extract_all(q, '[A-Za-z0-9]+') IF length(x) >= 4 AND x NOT IN ('which', 'what')]) IF contains(name, t)]) AS overlap FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_question DESC, holds_question DESC, overlap DESC, length(name) DESC, entity_id) AS rank FROM s WHERE in_question = 1 OR holds_question = 1 OR overlap >= 2)
SELECT query_id, entity_id, in_question, CAST(overlap AS INTEGER) AS overlap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40""")  # fmt: skip
def symbolic_lookup(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    queries = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("which supplier "), "n_name", F.lit(" of region "), "r_name").alias("question"))
    return retrieve.symbolic_lookup(queries, fx.entities(spark, sf_dir)).select(F.col("query_id").cast("int").alias("query_id"), "entity_id", "in_question", "overlap", "rank")


@query("chunk_scores", _ppr_sql().rsplit("SELECT query_id, node", 1)[0].rstrip() + f""",
{fx.MENTIONS}, b AS (SELECT query_id, node AS entity_id, v / max(v) OVER (PARTITION BY query_id) AS s FROM v5),
l AS (SELECT question_id % 10 AS query_id, entity_id, chunk_id FROM mentions)
SELECT query_id, chunk_id, round(least(1, avg(s) + 0.05 * (count(*) - 1)), 6) AS score, CAST(count(*) AS BIGINT) AS links FROM l JOIN b USING (query_id, entity_id) GROUP BY ALL""")  # fmt: skip
def chunk_scores(spark, sf_dir):
    nodes, edges, seeds = ppr_tables(spark, sf_dir)
    scores = graph.personalized_pagerank(nodes, edges, seeds)
    linked = fx.mentions(spark, sf_dir).select((F.col("question_id") % 10).alias("query_id"), "entity_id", "chunk_id")
    return retrieve.chunk_scores(linked, scores).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "links")


SCORED = """scored AS (SELECT l_suppkey AS query_id, l_orderkey || ':' || l_linenumber AS chunk_id, l_orderkey % 40 AS passage, CAST(l_linenumber AS INTEGER) AS position, CAST(l_quantity AS INTEGER) AS links,
       round(1 - 7 * l_discount, 2) AS score, CAST(l_partkey % 4 AS INTEGER) AS hops, CASE WHEN l_partkey % 5 > 0 THEN round(l_tax * 10, 2) END AS cosine FROM lineitem)"""


def scored_chunks(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"),
        (F.col("l_orderkey") % 40).alias("passage"),
        F.col("l_linenumber").cast("int").alias("position"),
        F.col("l_quantity").cast("int").alias("links"),
        F.round(1 - 7 * F.col("l_discount"), 2).alias("score"),
        (F.col("l_partkey") % 4).cast("int").alias("hops"),
        F.when(F.col("l_partkey") % 5 > 0, F.round(F.col("l_tax") * 10, 2)).alias("cosine"),
    )


@query("hop_scores", f"""WITH {SCORED} SELECT chunk_id, CASE hops WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS hop_score FROM scored""")
def hop_scores(spark, sf_dir):
    return scored_chunks(spark, sf_dir).select("chunk_id", retrieve.hop_score(F.col("hops")).alias("hop_score"))


@query("passage_cap", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, passage ORDER BY score DESC, links DESC, position, chunk_id) AS r FROM scored)
SELECT query_id, passage, chunk_id, score FROM r WHERE r <= 2""")  # fmt: skip
def passage_cap(spark, sf_dir):
    return retrieve.passage_cap(scored_chunks(spark, sf_dir)).select("query_id", "passage", "chunk_id", "score")


@query("relevance_gate", f"""WITH {SCORED}, f AS (SELECT *, hops = 0 OR cosine IS NULL OR cosine >= 0.3 AS fine FROM scored), l AS (SELECT *, sum(fine::INT) OVER (PARTITION BY query_id) AS n FROM f)
SELECT query_id, chunk_id, hops, cosine FROM l WHERE fine OR n = 0""")  # fmt: skip
def relevance_gate(spark, sf_dir):
    return retrieve.relevance_gate(scored_chunks(spark, sf_dir)).select("query_id", "chunk_id", "hops", "cosine")


LISTS = f"""{SCORED}, l AS (SELECT query_id, list_id, chunk_id, score, row_number() OVER (PARTITION BY query_id, list_id ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT query_id, 1 AS list_id, chunk_id, score FROM scored UNION ALL SELECT query_id, 2, chunk_id, cosine FROM scored WHERE cosine IS NOT NULL UNION ALL SELECT query_id, 3, chunk_id, links / 50.0::DOUBLE FROM scored))"""


def ranked_lists(spark, sf_dir):
    rows = scored_chunks(spark, sf_dir)
    lists = rows.select("query_id", F.lit(1).alias("list_id"), "chunk_id", "score").union(rows.filter("cosine IS NOT NULL").select("query_id", F.lit(2), "chunk_id", "cosine")).union(rows.select("query_id", F.lit(3), "chunk_id", F.col("links") / F.lit(50.0)))
    return lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "list_id").orderBy(F.desc("score"), "chunk_id")))


@query("rrf_fusion", f"""WITH {LISTS}
SELECT query_id, chunk_id, CAST(count(DISTINCT list_id) AS BIGINT) AS support, round(sum(1.0::DOUBLE / (60 + rank)) + 0.05 * least(count(DISTINCT list_id), 3) + 0.01 * max(score), 7) AS score FROM l WHERE rank <= 30 GROUP BY ALL""")  # fmt: skip
def rrf_fusion(spark, sf_dir):
    return retrieve.reciprocal_rank_fusion(ranked_lists(spark, sf_dir).filter("rank <= 30")).select("query_id", "chunk_id", "support", F.round("score", 7).alias("score"))


@query("merge_contexts", f"""WITH {LISTS}, a AS (SELECT query_id, chunk_id, score FROM l WHERE list_id = 1 AND rank <= 15), b AS (SELECT query_id, chunk_id, score FROM l WHERE list_id = 3 AND rank <= 30),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.chunk_id = b.chunk_id)),
u AS (SELECT query_id, chunk_id, score, 'primary' AS origin FROM a UNION ALL SELECT query_id, chunk_id, greatest(score, 0.55), 'secondary' FROM n WHERE r <= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, origin, chunk_id) AS rank FROM u)
SELECT query_id, chunk_id, score, origin, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")  # fmt: skip
def merge_contexts(spark, sf_dir):
    lists = ranked_lists(spark, sf_dir)
    return retrieve.merge_contexts(lists.filter("list_id = 1 AND rank <= 15"), lists.filter("list_id = 3 AND rank <= 30"))


@query("max_sim", """WITH q AS (SELECT vec_id // 200 AS query_id, vec_id AS q_token, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id // 4 AS chunk_id, embedding AS e FROM embeddings),
b AS (SELECT query_id, chunk_id, q_token, max(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])) AS best FROM q, c GROUP BY ALL)
SELECT query_id, chunk_id, round(avg(best), 6) AS score FROM b GROUP BY ALL""")  # fmt: skip
def max_sim(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    q = rows.filter("vec_id % 100 = 0").select(F.floor(F.col("vec_id") / 200).alias("query_id"), F.col("vec_id").alias("q_token"), F.col("embedding").alias("q_vec"))
    c = rows.select(F.floor(F.col("vec_id") / 4).alias("chunk_id"), F.col("embedding").alias("c_vec"))
    return retrieve.max_sim(q, c).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("gumbel_sample_cold", f"""WITH {LISTS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM l WHERE list_id = 1 AND rank <= 10""")
def gumbel_sample_cold(spark, sf_dir):
    return retrieve.gumbel_top_k(ranked_lists(spark, sf_dir).filter("list_id = 1"), 10).select("query_id", "chunk_id", "score", "rank")


@query("gumbel_sample_warm", f"""WITH {LISTS}, n AS (SELECT *, score / 0.5 - ln(-ln((CAST('0x' || substr(md5('42|' || query_id || '|' || chunk_id), 1, 10) AS BIGINT) + 0.5) / 1099511627776.0::DOUBLE)) AS key FROM l WHERE list_id = 1 AND rank <= 30)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY key DESC, chunk_id) <= 10""")  # fmt: skip
def gumbel_sample_warm(spark, sf_dir):
    return retrieve.gumbel_top_k(ranked_lists(spark, sf_dir).filter("list_id = 1"), 10, temperature=0.5).select("query_id", "chunk_id", "score", "rank")
