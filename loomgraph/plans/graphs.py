"""Queries on graphs: degrees, paths, expansion, PageRank and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table


@query("degree_report", f"""WITH {fx.PLACE_EDGES}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM place_edges UNION ALL SELECT dst, 0, 1 FROM place_edges)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(count(*) AS BIGINT) AS degree FROM e GROUP BY node""")  # fmt: skip
def degree_report(spark, sf_dir):
    return graph.degrees(fx.place_edges(spark, sf_dir))


def seed_edges(spark, sf_dir):
    """All supply edges that are certain enough, and each supplier as a query's seed."""
    edges = graph.readable_edges(fx.supply_edges(spark, sf_dir))
    suppliers = read_table(spark, sf_dir, "supplier")
    return edges, suppliers.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))


TRAIL_EDGES = f"""{fx.SUPPLY_EDGES},
e AS (SELECT edge_id, src, dst FROM supply_edges WHERE confidence >= 0.4),
s AS (SELECT edge_id, src AS f, dst AS t FROM e UNION ALL SELECT edge_id, dst, src FROM e),
seeds AS (SELECT s_suppkey AS query_id, 'S' || s_suppkey AS seed FROM supplier),
p1 AS (SELECT query_id, seed, s.t AS node, 1 AS hops, s.edge_id AS e1, NULL AS e2, [seed, s.t] AS nodes FROM seeds JOIN s ON s.f = seed),
p2 AS (SELECT query_id, seed, s.t AS node, 2 AS hops, e1, s.edge_id AS e2, list_append(nodes, s.t) AS nodes FROM p1 JOIN s ON s.f = p1.node AND s.edge_id <> e1),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""


@query("sample_paths", f"""WITH {TRAIL_EDGES}, d AS (SELECT DISTINCT query_id, node, hops, array_to_string(nodes, '>') AS path FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY hops, path) AS r FROM d)
SELECT query_id, node, hops, path FROM r WHERE r <= 3""")  # fmt: skip
def sample_paths(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    return graph.sampled_paths(seeds, edges, 2)


@query("expand_entities", f"""WITH {TRAIL_EDGES},
n AS (SELECT query_id, node, min(hops) AS min_hops, count(DISTINCT seed) AS seed_count FROM p WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = p.query_id AND x.seed = p.node) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed_count DESC, min_hops, node) AS rank FROM n)
SELECT query_id, node, CAST(min_hops AS INTEGER) AS min_hops, CAST(seed_count AS BIGINT) AS seed_count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""")  # fmt: skip
def expand_entities(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    return graph.expand_entities(seeds, edges, 2)


@query("reachable_nodes", f"""WITH {TRAIL_EDGES}
SELECT query_id, node, CAST(min(hops) AS INTEGER) AS hops FROM p WHERE node <> seed GROUP BY ALL""")  # fmt: skip
def reachable_nodes(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    return graph.reach(seeds, edges, 2)


def ppr_tables(spark, sf_dir):
    edges = fx.supply_edges(spark, sf_dir).filter(F.col("confidence") >= 0.4).withColumn("query_id", F.col("question_id") % 10)
    nodes = edges.select("query_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    seeds = nodes.filter(F.col("node").startswith("S")).groupBy("query_id").agg(F.min("node").alias("node"))
    return nodes, edges, seeds


def _ppr_sql(steps: int = 5) -> str:
    rounds = "".join(
        f""",
i{k} AS (SELECT v.query_id, k.dst AS node, sum(v.v * k.share) AS x FROM v{k - 1} v JOIN k ON k.query_id = v.query_id AND k.src = v.node GROUP BY ALL),
v{k} AS (SELECT v.query_id, v.node, v.e, 0.15 * v.e + 0.85 * coalesce(i.x, 0) AS v FROM v{k - 1} v LEFT JOIN i{k} i ON i.query_id = v.query_id AND i.node = v.node)"""
        for k in range(1, steps + 1)
    )
    return f"""WITH {fx.SUPPLY_EDGES}, e AS (SELECT question_id % 10 AS query_id, src, dst, confidence FROM supply_edges WHERE confidence >= 0.4),
w AS (SELECT query_id, src AS a, dst AS b, max(confidence) AS w FROM e GROUP BY ALL),
u AS (SELECT query_id, a AS src, b AS dst, w FROM w UNION ALL SELECT query_id, b, a, w FROM w),
k AS (SELECT query_id, src, dst, w / sum(w) OVER (PARTITION BY query_id, src) AS share FROM u),
n AS (SELECT DISTINCT query_id, src AS node FROM u),
s AS (SELECT query_id, min(node) AS seed FROM n WHERE node LIKE 'S%' GROUP BY query_id),
v0 AS (SELECT n.query_id, n.node, CASE WHEN n.node = s.seed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e, CASE WHEN n.node = s.seed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM n JOIN s USING (query_id)){rounds}
SELECT query_id, node, round(v, 7) AS score FROM v{steps}"""


@query("personalized_pagerank", _ppr_sql())
def personalized_pagerank(spark, sf_dir):
    nodes, edges, seeds = ppr_tables(spark, sf_dir)
    return graph.personalized_pagerank(nodes, edges, seeds).select("query_id", "node", F.round("score", 7).alias("score"))


def _pagerank_sql(steps: int = 24) -> str:
    rounds = "".join(
        f""",
i{k} AS (SELECT dst AS node, sum(v * share) AS x FROM v{k - 1} JOIN k ON k.src = node GROUP BY dst),
v{k} AS MATERIALIZED (SELECT v.node, 0.15 / n.n + 0.85 * (coalesce(i.x, 0) + d.m / n.n) AS v FROM v{k - 1} v LEFT JOIN i{k} i ON i.node = v.node, n, (SELECT coalesce(sum(v), 0) AS m FROM v{k - 1} WHERE node NOT IN (SELECT src FROM k)) d)"""
        for k in range(1, steps + 1)
    )
    return f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES}, l AS (SELECT src, dst, count(*) AS m FROM place_edges GROUP BY ALL),
k AS MATERIALIZED (SELECT src, dst, m / sum(m) OVER (PARTITION BY src) AS share FROM l),
n AS (SELECT count(*)::DOUBLE AS n FROM entities),
v0 AS (SELECT entity_id AS node, 1.0 / n.n AS v FROM entities, n){rounds}
SELECT node, round(v, 7) AS score FROM v{steps}"""


@query("pagerank", _pagerank_sql())
def pagerank(spark, sf_dir):
    nodes = fx.entities(spark, sf_dir).select(F.col("entity_id").alias("node"))
    return graph.pagerank(nodes, fx.place_edges(spark, sf_dir)).select("node", F.round("score", 7).alias("score"))


@query("connected_components", f"""WITH RECURSIVE {fx.ENTITIES}, {fx.SUPPLY_EDGES}, u AS (SELECT src AS a, dst AS b FROM supply_edges WHERE confidence >= 0.95 UNION SELECT dst, src FROM supply_edges WHERE confidence >= 0.95),
cc(node, component) USING KEY (node) AS (
  SELECT entity_id, entity_id FROM entities
  UNION (SELECT u.a, min(f.component) FROM cc f JOIN u ON u.b = f.node JOIN recurring.cc o ON o.node = u.a GROUP BY u.a, o.component HAVING min(f.component) < o.component))
SELECT node, component FROM cc""")  # fmt: skip
def connected_components(spark, sf_dir):
    edges = fx.supply_edges(spark, sf_dir).filter(F.col("confidence") >= 0.95)
    nodes = fx.entities(spark, sf_dir).select(F.col("entity_id").alias("node"))
    return graph.connected_components(nodes, edges)


@query("relation_planning", f"""WITH {fx.PLACE_EDGES}, {fx.SUPPLY_EDGES}, al AS (SELECT src, dst, rel_type FROM place_edges UNION ALL SELECT src, dst, CASE WHEN position % 2 = 0 THEN 'STOCKS' ELSE rel_type END FROM supply_edges),
t AS (SELECT CAST(substr(x, 2) AS BIGINT) AS query_id, rel_type, count(*) AS n FROM (SELECT rel_type, src AS x FROM al UNION ALL SELECT rel_type, dst FROM al) WHERE x LIKE 'S%' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, rel_type) AS rank FROM t) SELECT query_id, rel_type, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 40""")  # fmt: skip
def relation_planning(spark, sf_dir):
    """Each supplier is a question's seed."""
    supply = fx.supply_edges(spark, sf_dir).select("src", "dst", F.when(F.col("position") % 2 == 0, "STOCKS").otherwise(F.col("rel_type")).alias("rel_type"))
    seeds = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("query_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.relation_plan(seeds, fx.place_edges(spark, sf_dir).unionByName(supply))