"""Queries on entity links, gates, routes, the order of chunks and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import context, graph
from loomgraph.operators.stats import W
from loomgraph.plans import fixtures as fx
from loomgraph.plans.graphs import _ppr_sql, ppr_tables
from loomgraph.plans.registry import query
from loomgraph.sources.shared import stored
from loomgraph.sources.tables import read_table

COMPARED = """compared AS (SELECT s_suppkey AS query_id, 'Which is it, ' || split_part(p_type, ' ', 2) || ' or ' || split_part(p_name, ' ', 1) || '?' AS question, lower(split_part(p_type, ' ', 2)) AS x, lower(split_part(p_name, ' ', 1)) AS y FROM supplier JOIN part ON p_partkey = s_suppkey),
chunks AS (SELECT l_suppkey AS query_id, question, x, y, l_orderkey || ':' || l_linenumber AS chunk_id, l_orderkey AS question_id, l_orderkey % 3 AS passage, CAST(l_linenumber AS INTEGER) AS position, CAST(l_quantity AS INTEGER) % 3 AS links, round(1 - 7 * l_discount, 2) AS score, l_returnflag = 'R' AS adjacent,
  p_brand AS document, p_name || ' ' || p_type AS text, lower(p_brand || ' ' || p_name || ' ' || p_type) AS hay FROM lineitem JOIN part ON p_partkey = l_partkey JOIN compared ON query_id = l_suppkey),
marked AS (SELECT *, CASE WHEN length(x) >= 4 AND length(y) >= 4 THEN contains(hay, x)::INT + contains(hay, y)::INT WHEN length(x) >= 4 THEN contains(hay, x)::INT WHEN length(y) >= 4 THEN contains(hay, y)::INT ELSE 0 END AS branches,
  len([t FOR t IN list_distinct([x, y]) IF length(t) >= 4 AND contains(hay, t)]) AS overlap FROM chunks),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY branches DESC, overlap DESC, links DESC, score DESC, adjacent, position, chunk_id) AS INTEGER) AS rank FROM marked)"""


def compared_chunks(spark, sf_dir):
    part, supplier, lines = (read_table(spark, sf_dir, name) for name in ("part", "supplier", "lineitem"))
    word = lambda column, k: F.split_part(column, F.lit(" "), F.lit(k))
    asked = supplier.join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Which is it, "), word("p_type", 2), F.lit(" or "), word("p_name", 1), F.lit("?")).alias("question"))
    rows = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_suppkey").alias("query_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("question_id"), (F.col("l_orderkey") % 3).alias("passage"), F.col("l_linenumber").cast("int").alias("position"),
        (F.col("l_quantity").cast("int") % 3).alias("links"), F.round(1 - 7 * F.col("l_discount"), 2).alias("score"), (F.col("l_returnflag") == "R").alias("adjacent"), F.col("p_brand").alias("document"), F.concat_ws(" ", "p_name", "p_type").alias("text"),
    )
    return rows.join(context.with_question_parts(asked), "query_id")


def selected_chunks(spark, sf_dir, most: int = 5):
    return context.sorted_for_query(compared_chunks(spark, sf_dir), most)


@query("query_sort", f"""WITH {COMPARED} SELECT query_id, chunk_id, CAST(branches AS INTEGER) AS branches, CAST(overlap AS INTEGER) AS overlap, rank FROM ranked""")
def query_sort(spark, sf_dir):
    return context.sorted_for_query(compared_chunks(spark, sf_dir)).select("query_id", "chunk_id", "branches", "overlap", "rank")


@query("branch_coverage", f"""WITH {COMPARED}, s AS (SELECT query_id, hay, unnest([t FOR t IN [x, y] IF length(t) >= 4]) AS side FROM chunks), e AS (SELECT query_id, side, bool_or(contains(hay, side)) AS held FROM s GROUP BY ALL)
SELECT query_id, CAST(count(*) AS BIGINT) AS branches, CAST(sum(held::INT) AS BIGINT) AS covered FROM e GROUP BY query_id""")
def branch_coverage(spark, sf_dir):
    return context.covered_branches(compared_chunks(spark, sf_dir))


PRUNED = f"""{COMPARED}, {fx.MENTIONS}, {fx.SUPPLY_EDGES}, sel AS (SELECT * FROM ranked WHERE rank <= 5), ret AS (SELECT DISTINCT query_id, entity_id FROM sel JOIN mentions USING (chunk_id)),
kept AS (SELECT query_id, edge_id FROM (SELECT CAST(substr(src, 2) AS BIGINT) AS query_id, * FROM supply_edges) e WHERE EXISTS (SELECT 1 FROM ret WHERE ret.query_id = e.query_id AND ret.entity_id = e.src) AND EXISTS (SELECT 1 FROM ret WHERE ret.query_id = e.query_id AND ret.entity_id = e.dst)
  AND EXISTS (SELECT 1 FROM sel WHERE sel.query_id = e.query_id AND sel.position = e.position))"""


def pruned(spark, sf_dir):
    selected, mentions = stored(selected_chunks(spark, sf_dir), "context-selected"), fx.mentions(spark, sf_dir)
    edges = fx.supply_edges(spark, sf_dir).select(
        F.expr("CAST(substr(src, 2) AS BIGINT)").alias("query_id"), "edge_id", "src", "dst", F.array("position").alias("positions"), F.array().cast("array<bigint>").alias("passages"), F.array("question_id").alias("question_ids"),
    )
    retained = stored(context.retained_entities(selected, mentions), "context-retained")
    return selected, retained, context.pruned_edges(edges, selected, mentions, retained)


@query("context_pruning", f"""WITH {PRUNED} SELECT query_id, edge_id FROM kept""")
def context_pruning(spark, sf_dir):
    return pruned(spark, sf_dir)[2].select("query_id", "edge_id")


@query("retained_entities", f"""WITH {PRUNED} SELECT query_id, entity_id FROM ret""")
def retained_entities(spark, sf_dir):
    return pruned(spark, sf_dir)[1]


@query("context_totals", f"""WITH {PRUNED} SELECT query_id, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT document) AS BIGINT) AS documents, round(sum(score), 6) AS total_score,
CAST((SELECT count(*) FROM ret WHERE ret.query_id = sel.query_id) AS BIGINT) AS entities, CAST((SELECT count(*) FROM kept WHERE kept.query_id = sel.query_id) AS BIGINT) AS relations FROM sel GROUP BY query_id""")
def context_totals(spark, sf_dir):
    return context.context_totals(*pruned(spark, sf_dir)).withColumn("total_score", F.round("total_score", 6))


@query("selected_scopes", f"""WITH {COMPARED} SELECT query_id, array_to_string(list_sort(list_distinct(list(position))), ',') AS positions, array_to_string(list_sort(list_distinct(list(question_id::VARCHAR))), ',') AS question_ids,
array_to_string(list_sort(list_distinct(list(question_id || '::p' || passage))), ',') AS passage_keys FROM ranked WHERE rank <= 5 GROUP BY query_id""")
def selected_scopes(spark, sf_dir):
    out = context.selected_scopes(selected_chunks(spark, sf_dir))
    return out.select("query_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("positions", "question_ids", "passage_keys")])


@query("result_texts", f"""WITH {COMPARED}, t AS (SELECT query_id, text, min(rank) AS r FROM ranked WHERE rank <= 12 GROUP BY query_id, text) SELECT query_id, md5(string_agg(text, '|' ORDER BY r)) AS texts FROM t GROUP BY query_id""")
def result_texts(spark, sf_dir):
    return context.result_texts(selected_chunks(spark, sf_dir, 12)).select("query_id", F.md5(F.array_join("texts", "|")).alias("texts"))


@query("told_blocks", f"""WITH {COMPARED} SELECT query_id, md5('PASSAGES:' || chr(10) || string_agg('[' || rank || '] ' || trim(text), chr(10) || chr(10) ORDER BY rank)) AS passages,
md5(string_agg('[' || rank || '] ' || document || ': ' || left(text, 320), chr(10) ORDER BY rank) FILTER (rank <= 8)) AS guardrail, md5(string_agg('[Source: ' || document || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rank)) AS sources FROM ranked WHERE rank <= 12 GROUP BY query_id""")
def told_blocks(spark, sf_dir):
    selected = selected_chunks(spark, sf_dir, 12)
    blocks = [f(selected).select("query_id", F.md5("told").alias(name)) for f, name in ((context.passages_block, "passages"), (context.guardrail_block, "guardrail"), (context.sources_block, "sources"))]
    return blocks[0].join(blocks[1], "query_id").join(blocks[2], "query_id")


@query("linked_entities", """WITH s AS (SELECT q.vec_id // 200 AS query_id, CASE WHEN q.vec_id % 200 > 0 THEN q.vec_id END AS mention, v.vec_id // 5 AS entity_id, max(round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9)) AS cosine
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, mention ORDER BY cosine DESC, entity_id) AS r FROM s),
k AS (SELECT * FROM r WHERE r <= 15 AND cosine >= CASE WHEN mention IS NULL THEN 0.55 ELSE 0.72 END)
SELECT query_id, entity_id, round(max(cosine * CASE WHEN entity_id % 4 = 3 THEN 1 ELSE 1.0::DOUBLE / (1 + entity_id % 4) END), 6) AS score FROM k GROUP BY ALL""")
def linked_entities(spark, sf_dir):
    from loomgraph.operators.retrieve import vector_top_k

    rows = read_table(spark, sf_dir, "embeddings")
    found = vector_top_k(rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows.select("vec_id", "embedding"), 15 * 5, threshold=0.5)
    vec = F.col("query_id")
    scored = found.select(F.floor(vec / 200).alias("query_id"), F.when(vec % 200 > 0, vec).alias("mention"), F.floor(F.col("vec_id") / 5).alias("entity_id"), "score")
    scored = scored.groupBy("query_id", "mention", "entity_id").agg(F.max("score").alias("cosine"))
    own = rows.select(F.floor(F.col("vec_id") / 5).alias("entity_id")).distinct().filter("entity_id % 4 < 3").withColumn("specificity", 1.0 / (1 + F.col("entity_id") % 4))
    return context.linked_entities(scored, own).select("query_id", "entity_id", F.round("score", 6).alias("score"))


CANDIDATES = """l AS (SELECT l_suppkey AS query_id, 'P' || l_partkey AS entity_id, p_name AS name, l_partkey, max((l_linenumber = 1)::INT) AS in_question, max((l_linenumber = 2 AND l_tax > 0.05)::INT) AS holds_question, CAST(max(l_linenumber % 4) AS INTEGER) AS overlap, round(1 - min(l_discount), 2) AS score
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
b AS (SELECT coalesce(s.query_id, a.query_id) AS query_id, coalesce(s.entity_id, a.entity_id) AS entity_id, coalesce(s.name, a.name) AS name, coalesce(in_question, 0) AS in_question, coalesce(holds_question, 0) AS holds_question, coalesce(overlap, 0) AS overlap, coalesce(a.score, 0.0) AS score
  FROM (SELECT * EXCLUDE score FROM l WHERE l_partkey % 3 > 0) s FULL JOIN (SELECT query_id, entity_id, name, score FROM l WHERE l_partkey % 2 = 0) a ON a.query_id = s.query_id AND a.entity_id = s.entity_id),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY in_question DESC, holds_question DESC, overlap DESC, score DESC, length(name) DESC, entity_id) AS INTEGER) AS rank FROM b WHERE entity_id NOT IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 7))"""


def candidates(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    key = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    flag = lambda c: F.max(c.cast("int"))
    rows = read_table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("query_id"), key.alias("entity_id"), F.col("p_name").alias("name"), "l_partkey").agg(
        flag(F.col("l_linenumber") == 1).alias("in_question"), flag((F.col("l_linenumber") == 2) & (F.col("l_tax") > 0.05)).alias("holds_question"), flag(F.col("l_linenumber") % 4).alias("overlap"), F.round(1 - F.min("l_discount"), 2).alias("score"),
    )
    masked = part.filter("p_size = 7").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"))
    symbolic = rows.filter("l_partkey % 3 > 0").select("query_id", "entity_id", "name", "in_question", "holds_question", "overlap")
    return context.merged_candidates(symbolic, rows.filter("l_partkey % 2 = 0").select("query_id", "entity_id", "name", "score"), masked)


@query("merged_candidates", f"""WITH {CANDIDATES} SELECT query_id, entity_id, in_question, holds_question, overlap, score, rank FROM c WHERE rank <= 12""")
def merged_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select("query_id", "entity_id", "in_question", "holds_question", "overlap", "score", "rank")


@query("confidence_gate", f"""WITH {CANDIDATES}, m AS (SELECT query_id, bool_or(in_question > 0 OR holds_question > 0 OR overlap >= 2) AS told FROM c WHERE rank <= 12 AND entity_id LIKE '%5' GROUP BY query_id)
SELECT query_id FROM m JOIN supplier ON s_suppkey = query_id WHERE told OR (s_suppkey % 10) / 10.0 >= 0.5""")
def confidence_gate(spark, sf_dir):
    """Candidates are cut to some ids after ranking, so that some queries have none by letters."""
    grounding = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") % 10 / 10.0).alias("grounding"))
    return context.confident_queries(candidates(spark, sf_dir).filter(F.col("entity_id").endswith("5")), grounding)


@query("sufficient_chunks", """WITH c AS (SELECT conv_id AS query_id, turn FROM conversations WHERE role = 'assistant') SELECT query_id, turn FROM c WHERE query_id IN (SELECT query_id FROM c GROUP BY query_id HAVING count(*) >= 2)""")
def sufficient_chunks(spark, sf_dir):
    return context.sufficient(read_table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), "turn"))


ROUTES = """r AS (SELECT o_orderkey AS query_id, (['hybrid_auto', 'entity_first', 'rfge', 'vector_only'])[o_orderkey % 4 + 1] AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'comparison' ELSE 'generic' END AS kind, o_custkey % 3 AS entity_chunks, o_custkey % 2 AS expanded, o_orderkey % 7 > 1 AS vectors,
  o_orderkey % 3 > 0 AS fallback, CASE WHEN o_custkey % 11 > 0 THEN (o_custkey % 11) / 10.0 END AS grounding, o_orderstatus = 'F' AS structure, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END AS branches, o_custkey % 3 AS covered FROM orders),
m AS (SELECT *, entity_chunks > 0 AND NOT (grounding IS NOT NULL AND grounding < 0.5 AND NOT structure) AND CASE WHEN branches > 0 THEN covered >= branches ELSE structure OR coalesce(grounding >= 0.5, false) END AS meaningful FROM r)"""


@query("retrieval_routes", f"""WITH {ROUTES} SELECT query_id, meaningful, CASE WHEN mode IN ('hybrid_auto', 'entity_first') AND kind <> 'comparison' AND entity_chunks > 0 THEN CASE WHEN NOT vectors THEN 'entity_first' WHEN meaningful THEN 'hybrid' ELSE 'hybrid_vector_primary' END
WHEN mode IN ('hybrid_auto', 'rfge') AND kind <> 'comparison' AND expanded > 0 THEN 'rfge' WHEN mode = 'entity_first' AND NOT fallback THEN 'entity_first_empty' WHEN vectors THEN 'semantic_only' ELSE 'text' END AS route FROM m""")
def retrieval_routes(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 5 == 0, "comparison").otherwise("generic")
    grounding = F.when(cust % 11 > 0, cust % 11 / 10.0)
    meaningful = context.graph_is_meaningful(grounding, F.col("o_orderstatus") == "F", cust % 3 > 0, F.when(key % 5 == 0, 2).otherwise(0), cust % 3)
    mode = F.element_at(F.array(*map(F.lit, ["hybrid_auto", "entity_first", "rfge", "vector_only"])), (key % 4).cast("int") + 1)
    route = context.retrieval_route(mode, kind, cust % 3, meaningful, cust % 2, key % 7 > 1, key % 3 > 0)
    return read_table(spark, sf_dir, "orders").select(key.alias("query_id"), meaningful.alias("meaningful"), route.alias("route"))


@query("walk_starts", f"""WITH {fx.MENTIONS}, c AS (SELECT l_suppkey AS query_id, l_orderkey || ':' || l_linenumber AS chunk_id, round(l_tax * 10, 2) AS cosine FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM c WHERE cosine >= 0.2),
t AS (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY entity_id) AS k FROM n JOIN (SELECT DISTINCT chunk_id, entity_id FROM mentions) USING (chunk_id) WHERE r <= 60)
SELECT DISTINCT query_id, entity_id AS node FROM t WHERE k <= 4""")
def walk_starts(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.round(F.col("l_tax") * 10, 2).alias("cosine"))
    return context.walk_starts(chunks, fx.mentions(spark, sf_dir))


@query("walked_chunks", _ppr_sql().rsplit("SELECT query_id, node", 1)[0].rstrip() + f""",
{fx.MENTIONS}, b AS (SELECT query_id, node AS entity_id, v / max(v) OVER (PARTITION BY query_id) AS s, v >= 0.005 AS strong FROM v5),
ww AS (SELECT query_id, chunk_id, least(1, avg(s) + 0.05 * (count(*) - 1)) AS walk, bool_or(strong) AS strong FROM (SELECT DISTINCT chunk_id, entity_id FROM mentions) JOIN b USING (entity_id) GROUP BY ALL),
c AS (SELECT l_orderkey % 10 AS query_id, l_orderkey || ':' || l_linenumber AS chunk_id, round(1 - 7 * l_discount, 2) AS cosine FROM lineitem WHERE l_discount <= 0.04)
SELECT query_id, chunk_id, round(CASE WHEN cosine IS NULL THEN 0.3 * walk ELSE 0.5 * cosine + 0.5 * coalesce(walk, 0) END, 6) AS score FROM c FULL JOIN ww USING (query_id, chunk_id) WHERE cosine IS NOT NULL OR strong""")  # fmt: skip
def walked_chunks(spark, sf_dir):
    nodes, edges, seeds = ppr_tables(spark, sf_dir)
    walks = graph.personalized_pagerank(nodes, edges, seeds)
    lines = read_table(spark, sf_dir, "lineitem").filter("l_discount <= 0.04")  # those that are near enough
    chunks = lines.select((F.col("l_orderkey") % 10).alias("query_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.round(1 - 7 * F.col("l_discount"), 2).alias("cosine"))
    return context.walked_chunks(chunks, fx.mentions(spark, sf_dir), walks).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("fusion_and_hop_queries", """WITH d AS (SELECT p_partkey AS query_id, CASE WHEN p_size % 2 = 0 THEN 'Which is it, ' || split_part(p_type, ' ', 2) || ' or ' || p_name || '?' ELSE '  What   about ' || p_name || '? ' END AS question, p_name AS part, p_size % 3 AS hop, p_size % 5 > 0 AS anchored, CASE WHEN p_size % 7 > 0 THEN p_brand END AS later, p_type, p_size FROM part),
s AS (SELECT *, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS whole FROM d)
SELECT query_id, array_to_string(list_concat([whole], CASE WHEN p_size % 2 = 0 THEN [x FOR x IN [split_part(p_type, ' ', 2), part] IF length(x) >= 4] ELSE [] END), '|') AS variants,
CASE WHEN hop > 0 AND anchored THEN part || chr(10) || 'Original question: ' || whole || CASE WHEN later IS NOT NULL THEN chr(10) || 'Next hop target: ' || later ELSE '' END ELSE part END AS asked,
(p_size % 2 = 0 AND p_size % 3 < 2) OR (hop >= 2 AND p_size % 4 > 0) AS fused FROM s""")
def fusion_and_hop_queries(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    question = F.when(size % 2 == 0, F.concat(F.lit("Which is it, "), F.split_part("p_type", F.lit(" "), F.lit(2)), F.lit(" or "), name, F.lit("?"))).otherwise(F.concat(F.lit("  What   about "), name, F.lit("? ")))
    fused = context.wants_fusion(question, F.when(size % 2 == 0, 2).otherwise(0), size % 3, F.lit(9), size % 3, F.when(size % 4 == 0, "iterative_hop"))
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.array_join(context.fusion_variants(question), "|").alias("variants"),
        context.hop_query(question, name, size % 3, size % 5 > 0, F.when(size % 7 > 0, F.col("p_brand"))).alias("asked"), fused.alias("fused"),
    )


@query("vanilla_retrieval", f"""WITH {COMPARED}, first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, text) AS r FROM marked WHERE score >= 0.08),
sel AS (SELECT * EXCLUDE r FROM first WHERE r <= 10), beside AS (SELECT c.*, true AS near FROM marked c WHERE EXISTS (SELECT 1 FROM sel s WHERE s.query_id = c.query_id AND s.question_id = c.question_id AND s.passage = c.passage AND abs(s.position - c.position) = 1) AND NOT EXISTS (SELECT 1 FROM sel s WHERE s.query_id = c.query_id AND s.chunk_id = c.chunk_id)),
m AS (SELECT *, false AS near FROM sel UNION ALL SELECT * FROM beside),
o AS (SELECT query_id, chunk_id, near, CAST(row_number() OVER (PARTITION BY query_id ORDER BY branches DESC, overlap DESC, score DESC, near, position, chunk_id) AS INTEGER) AS rank FROM m)
SELECT query_id, chunk_id, near, rank FROM o WHERE rank <= 8""")
def vanilla_retrieval(spark, sf_dir):
    """Dense retrieval alone: the best chunks, those beside them, in the question's order, cut."""
    chunks = compared_chunks(spark, sf_dir)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "text")
    selected = chunks.filter("score >= 0.08").withColumn("_r", F.row_number().over(best)).filter("_r <= 10").drop("_r")
    place = ["query_id", "question_id", "passage", "position"]
    spots = selected.select(*place[:3], F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("position")).distinct()
    beside = chunks.join(spots, place, "left_semi").join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = selected.withColumn("adjacent", F.lit(False)).unionByName(beside.withColumn("adjacent", F.lit(True))).withColumn("links", F.lit(0))
    return context.sorted_for_query(both, 8).select("query_id", "chunk_id", F.col("adjacent").alias("near"), "rank")
