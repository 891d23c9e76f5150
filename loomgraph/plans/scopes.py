"""Queries on the scope of entities, edges and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import scope
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table


@query("entity_support", f"""WITH {fx.ENTITIES}, {fx.MENTIONS}
SELECT entity_id, type FROM entities WHERE EXISTS (SELECT 1 FROM mentions m JOIN orders o ON o.o_orderkey = m.question_id AND o.o_orderstatus = 'F' WHERE m.entity_id = entities.entity_id)""")  # fmt: skip
def entity_support(spark, sf_dir):
    questions = read_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("question_id"))
    return scope.supported_entities(fx.entities(spark, sf_dir), fx.mentions(spark, sf_dir), questions).select("entity_id", "type")


@query("pair_support", f"""WITH {fx.MENTIONS}
SELECT DISTINCT x.question_id, x.entity_id AS a, y.entity_id AS b FROM mentions x JOIN mentions y
ON x.question_id = y.question_id AND coalesce(x.passage, -1) = coalesce(y.passage, -1) AND abs(x.position - y.position) <= 1 AND x.entity_id <> y.entity_id""")  # fmt: skip
def pair_support(spark, sf_dir):
    return scope.near_mentions(fx.mentions(spark, sf_dir))


@query("scoped_edges", f"""WITH {fx.SUPPLY_EDGES}, {fx.MENTIONS},
near AS (SELECT DISTINCT x.question_id, x.entity_id AS a, y.entity_id AS b FROM mentions x JOIN mentions y ON x.question_id = y.question_id AND x.passage = y.passage AND abs(x.position - y.position) <= 1 AND x.entity_id <> y.entity_id)
SELECT question_id, edge_id, src, dst, confidence FROM supply_edges e WHERE confidence >= 0.4 AND EXISTS (SELECT 1 FROM near n WHERE n.question_id = e.question_id AND n.a = e.src AND n.b = e.dst)""")  # fmt: skip
def scoped_edges(spark, sf_dir):
    return scope.scoped_edges(fx.supply_edges(spark, sf_dir), fx.mentions(spark, sf_dir)).select("question_id", "edge_id", "src", "dst", "confidence")


@query("adjacent_chunks", f"""WITH {fx.MENTIONS}, c AS (SELECT DISTINCT chunk_id, question_id, passage, position FROM mentions), s AS (SELECT * FROM c WHERE position = 2)
SELECT DISTINCT c.chunk_id, c.question_id, c.position FROM c JOIN s ON s.question_id = c.question_id AND s.passage = c.passage AND abs(s.position - c.position) = 1 WHERE c.chunk_id NOT IN (SELECT chunk_id FROM s)""")  # fmt: skip
def adjacent_chunks(spark, sf_dir):
    chunks = fx.mentions(spark, sf_dir).select("chunk_id", "question_id", "passage", "position").distinct()
    return scope.adjacent_chunks(chunks.filter("position = 2"), chunks).select("chunk_id", "question_id", "position")


@query("chunks_for_entities", f"""WITH {fx.MENTIONS}, q AS (SELECT s_suppkey % 25 AS query_id, 'S' || s_suppkey AS entity_id FROM supplier UNION ALL SELECT p_partkey % 25, 'P' || p_partkey FROM part),
l AS (SELECT query_id, chunk_id, position, count(DISTINCT entity_id) AS links, array_to_string(list_sort(list_distinct(list(entity_id))), ',') AS linked FROM mentions JOIN q USING (entity_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY links DESC, position, chunk_id) AS rank FROM l)
SELECT query_id, chunk_id, CAST(links AS BIGINT) AS links, linked, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 25""")  # fmt: skip
def chunks_for_entities(spark, sf_dir):
    suppliers = read_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).alias("query_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"))
    parts = read_table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("query_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"))
    found = scope.chunks_of_entities(fx.mentions(spark, sf_dir), suppliers.union(parts), 25)
    return found.select("query_id", "chunk_id", "links", F.array_join("linked", ",").alias("linked"), "rank")


@query("leakage_check", """WITH g AS (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]{5,}') AS gold FROM conversations WHERE role = 'user')
SELECT g.conv_id, g.turn, bool_or(contains(lower(c.text), lower(g.gold))) AS leaked FROM g JOIN conversations c ON c.conv_id = g.conv_id AND c.turn <> g.turn WHERE length(g.gold) > 3 GROUP BY ALL""")  # fmt: skip
def leakage_check(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    gold = turns.filter("role = 'user'").select("conv_id", "turn", F.regexp_extract("text", "[A-Za-z]{5,}", 0).alias("gold"))
    contexts = turns.select("conv_id", F.col("turn").alias("place"), F.col("text").alias("context"))
    return scope.leaked(gold, contexts)
