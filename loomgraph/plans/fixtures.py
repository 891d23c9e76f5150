"""The graph, retrieval and evaluation tables that the queries derive from the driver tables.

Each comes twice: as a DataFrame, and as SQL for common table expressions of the
oracle. The rules are deterministic and say the same in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.tables import read_table


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, name, type) of regions, nations, customers, suppliers and parts."""
    kinds = [("region", "r", "region", "Region"), ("nation", "n", "nation", "Nation"), ("customer", "c", "cust", "Customer"), ("supplier", "s", "supp", "Supplier"), ("part", "p", "part", "Part")]
    parts = [
        read_table(spark, sf_dir, table).select(F.concat(F.lit(p.upper()), F.col(f"{p}_{key}key").cast("string")).alias("entity_id"), F.col(f"{p}_name").alias("name"), F.lit(kind).alias("type"))
        for table, p, key, kind in kinds
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ENTITIES = """entities AS (
  SELECT 'R' || r_regionkey AS entity_id, r_name AS name, 'Region' AS type FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'Customer' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Supplier' FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, 'Part' FROM part)"""


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, one edge a line item: id, src, dst, rel_type, confidence, negated, condition, question_id, position."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.lit("S"), "l_orderkey", "l_linenumber").alias("edge_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"),
        F.lit("SUPPLIES").alias("rel_type"),
        F.round(1 - 7 * F.col("l_discount"), 2).alias("confidence"),
        (F.col("l_returnflag") == "R").alias("negated"),
        F.col("l_linestatus").alias("condition"),
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").cast("int").alias("position"),
    )


SUPPLY_EDGES = """supply_edges AS (
  SELECT 'S:' || l_orderkey || ':' || l_linenumber AS edge_id, 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'SUPPLIES' AS rel_type,
         round(1 - 7 * l_discount, 2) AS confidence, l_returnflag = 'R' AS negated, l_linestatus AS condition,
         l_orderkey AS question_id, CAST(l_linenumber AS INTEGER) AS position FROM lineitem)"""


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations, nations to regions."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    customer, supplier, nation = (read_table(spark, sf_dir, table) for table in ("customer", "supplier", "nation"))
    located = customer.select(name("C", "c_custkey").alias("src"), name("N", "c_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("rel_type"))
    located = located.unionByName(supplier.select(name("S", "s_suppkey").alias("src"), name("N", "s_nationkey").alias("dst"), F.lit("LOCATED_IN").alias("rel_type")))
    return located.unionByName(nation.select(name("N", "n_nationkey").alias("src"), name("R", "n_regionkey").alias("dst"), F.lit("PART_OF_REGION").alias("rel_type")))


PLACE_EDGES = """place_edges AS (
  SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'LOCATED_IN' AS rel_type FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LOCATED_IN' FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF_REGION' FROM nation)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, chunk_id, question_id, passage, position): a line item is a chunk that mentions its part and supplier."""
    lines = read_table(spark, sf_dir, "lineitem")
    both = F.explode(F.array(F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))))
    return lines.select(
        both.alias("entity_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"),
        F.col("l_orderkey").alias("question_id"),
        (F.col("l_orderkey") % 3).alias("passage"),
        F.col("l_linenumber").cast("int").alias("position"),
    )


MENTIONS = """mentions AS (
  SELECT unnest(['P' || l_partkey, 'S' || l_suppkey]) AS entity_id, l_orderkey || ':' || l_linenumber AS chunk_id,
         l_orderkey AS question_id, l_orderkey % 3 AS passage, CAST(l_linenumber AS INTEGER) AS position FROM lineitem)"""


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluated question a labelled document, answered by two systems, with uncertainty metrics."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    q = F.col("doc_id")
    return docs.join(labels, "doc_id").select(
        q.alias("question_id"),
        F.col("source").alias("dataset"),
        F.col("lang").alias("task_type"),
        (F.col("quality") == 1).alias("correct"),
        (F.col("toxic") == 1).alias("failed"),
        ((q * 31) % 10 < 7).alias("kg_correct"),
        (q % 17 == 0).alias("kg_failed"),
        (1 + q % 6).cast("int").alias("hops"),
        ((q * 7919) % 1009 / F.lit(1009.0)).alias("u1"),
        ((F.col("n_chars") * 31 + q) % 13 / F.lit(13.0)).alias("u2"),
        F.when(q % 11 != 0, (q * 104729) % 101 / F.lit(101.0)).alias("u3"),
    )


EVAL_ROWS = """eval_rows AS (
  SELECT doc_id AS question_id, source AS dataset, lang AS task_type, quality = 1 AS correct, toxic = 1 AS failed,
         (doc_id * 31) % 10 < 7 AS kg_correct, doc_id % 17 = 0 AS kg_failed, CAST(1 + doc_id % 6 AS INTEGER) AS hops,
         ((doc_id * 7919) % 1009) / 1009.0::DOUBLE AS u1, ((n_chars * 31 + doc_id) % 13) / 13.0::DOUBLE AS u2,
         CASE WHEN doc_id % 11 <> 0 THEN ((doc_id * 104729) % 101) / 101.0::DOUBLE END AS u3
  FROM documents JOIN labels USING (doc_id))"""


def graph_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, event_type): the sets that a user's daily states are made of."""
    return read_table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()


GRAPH_STATES = """graph_states AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events)"""


def walks_sql(steps: int = 5) -> str:
    """Restarted walks from the nodes of no hops among ``ent`` (q, node, hops) over ``among`` (q, src, dst, confidence): v1, v2, ..., and ``walk``, shares of the best."""
    rounds = "".join(
        f""",
i{k} AS (SELECT v.q, k.d AS node, sum(v.v * k.share) AS x FROM v{k - 1} v JOIN k ON k.q = v.q AND k.s = v.node GROUP BY v.q, k.d),
z{k} AS (SELECT q, sum(CASE WHEN linked THEN 0 ELSE v END) AS idle FROM v{k - 1} GROUP BY q),
v{k} AS MATERIALIZED (SELECT v.q, v.node, v.e, v.linked, 0.15 * v.e + 0.85 * (coalesce(i.x, 0) + z.idle * v.e) AS v FROM v{k - 1} v JOIN z{k} z ON z.q = v.q LEFT JOIN i{k} i ON i.q = v.q AND i.node = v.node)"""
        for k in range(1, steps + 1)
    )
    return f"""u AS (SELECT q, least(src, dst) AS a, greatest(src, dst) AS b, max(confidence) AS w FROM among WHERE src <> dst GROUP BY ALL),
k AS MATERIALIZED (SELECT q, s, d, w / sum(w) OVER (PARTITION BY q, s) AS share FROM (SELECT q, a AS s, b AS d, w FROM u UNION ALL SELECT q, b, a, w FROM u)),
n0 AS (SELECT q, node, hops = 0 AS seed FROM ent WHERE q IN (SELECT q FROM among)),
v0 AS MATERIALIZED (SELECT n0.q, n0.node, CASE WHEN seed THEN 1.0::DOUBLE / sum(seed::INT) OVER (PARTITION BY n0.q) ELSE 0.0::DOUBLE END AS e, (n0.q, n0.node) IN (SELECT (q, s) FROM k) AS linked,
       CASE WHEN seed THEN 1.0::DOUBLE / sum(seed::INT) OVER (PARTITION BY n0.q) ELSE 0.0::DOUBLE END AS v FROM n0){rounds},
walk AS (SELECT q, node, v / max(v) OVER (PARTITION BY q) AS share FROM v{steps})"""
