"""Queries on reports, evidence and stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph, report, scope
from loomgraph.operators.chunking import section_of
from loomgraph.plans import fixtures as fx
from loomgraph.plans.graphs import seed_edges
from loomgraph.plans.registry import query
from loomgraph.plans.retrieval import LISTS, ranked_lists
from loomgraph.plans.statistics import answered
from loomgraph.sources.tables import read_table


@query("kg_degree_report", f"""WITH {fx.ENTITIES}, {fx.SUPPLY_EDGES}, g AS (SELECT x AS entity_id, count(*) AS d FROM (SELECT src AS x FROM supply_edges UNION ALL SELECT dst FROM supply_edges) GROUP BY x),
c AS (SELECT type, coalesce(d, 0) AS d FROM entities LEFT JOIN g USING (entity_id))
SELECT type, CASE WHEN d = 0 THEN '0' WHEN d = 1 THEN '1' WHEN d < 5 THEN '2-4' WHEN d < 10 THEN '5-9' ELSE '10+' END AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(max(d) AS BIGINT) AS most FROM c GROUP BY ALL""")  # fmt: skip
def kg_degree_report(spark, sf_dir):
    return report.degree_buckets(fx.entities(spark, sf_dir), fx.supply_edges(spark, sf_dir))


@query("component_summaries", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES}, c AS (SELECT entity_id AS node, name, CASE left(entity_id, 1) WHEN 'R' THEN r.r_regionkey WHEN 'N' THEN n.n_regionkey ELSE coalesce(cn.n_regionkey, sn.n_regionkey) END AS reg FROM entities
  LEFT JOIN region r ON entity_id = 'R' || r.r_regionkey LEFT JOIN nation n ON entity_id = 'N' || n.n_nationkey LEFT JOIN customer cu ON entity_id = 'C' || cu.c_custkey LEFT JOIN nation cn ON cn.n_nationkey = cu.c_nationkey
  LEFT JOIN supplier su ON entity_id = 'S' || su.s_suppkey LEFT JOIN nation sn ON sn.n_nationkey = su.s_nationkey WHERE type <> 'Part'),
k AS (SELECT reg, min(node) AS component FROM c GROUP BY reg), g AS (SELECT x AS node, count(*) AS d FROM (SELECT src AS x FROM place_edges UNION ALL SELECT dst FROM place_edges) GROUP BY x),
r AS (SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY coalesce(d, 0) DESC, name, c.node) AS r FROM c JOIN k USING (reg) LEFT JOIN g ON g.node = c.node),
l AS (SELECT component, count(*) AS n FROM place_edges JOIN c ON c.node = src JOIN k USING (reg) GROUP BY component)
SELECT component, CAST(count(*) AS BIGINT) AS entities, CAST(max(l.n) AS BIGINT) AS relations, string_agg(name, '; ' ORDER BY r) FILTER (r <= 6) AS top FROM r JOIN l USING (component) GROUP BY component""")  # fmt: skip
def component_summaries(spark, sf_dir):
    nodes, edges = fx.entities(spark, sf_dir).filter("type <> 'Part'"), fx.place_edges(spark, sf_dir)  # parts have no place
    found = graph.connected_components(nodes.select(F.col("entity_id").alias("node")), edges)
    return report.component_summaries(found, nodes, edges)


@query("claims", f"""WITH {fx.SUPPLY_EDGES}, t AS (SELECT edge_id, src || CASE WHEN negated THEN ' does not' ELSE '' END || ' supplies [' || condition || '] ' || dst AS claim FROM supply_edges) SELECT edge_id, claim, sha1(claim) AS claim_id FROM t""")
def claims(spark, sf_dir):
    return report.claims(fx.supply_edges(spark, sf_dir))


@query("qualifiers", f"""WITH {fx.SUPPLY_EDGES}, q AS (SELECT edge_id, 'condition' AS kind, condition AS value FROM supply_edges UNION ALL SELECT edge_id, 'position', CAST(position AS VARCHAR) FROM supply_edges)
SELECT edge_id, kind, value, sha1(edge_id || ':' || kind || ':' || value) AS qualifier_id FROM q WHERE length(trim(value)) > 0""")  # fmt: skip
def qualifiers(spark, sf_dir):
    return report.qualifiers(fx.supply_edges(spark, sf_dir))


@query("iterative_merge", f"""WITH {LISTS}, f AS (SELECT query_id, chunk_id, list_id AS hop, max(score) AS score FROM l GROUP BY query_id, chunk_id, list_id QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hop, chunk_id) AS rank FROM f) SELECT query_id, chunk_id, hop, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")  # fmt: skip
def iterative_merge(spark, sf_dir):
    return report.merge_hops(ranked_lists(spark, sf_dir).withColumnRenamed("list_id", "hop"), 20)


@query("used_entities", f"""WITH {fx.ENTITIES}, a AS (SELECT n_regionkey AS query_id, string_agg(n_name, ', ' ORDER BY n_nationkey) AS answer FROM nation GROUP BY n_regionkey), e AS (SELECT r_regionkey AS query_id, entity_id, lower(name) AS name FROM entities, region WHERE type IN ('Nation', 'Region'))
SELECT DISTINCT query_id, entity_id FROM a JOIN e USING (query_id) WHERE contains(lower(answer), name) OR len([w FOR w IN regexp_split_to_array(name, '[^a-z0-9]+') IF length(w) >= 4 AND contains(lower(answer), w)]) > 0""")  # fmt: skip
def used_entities(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    said = nation.groupBy(F.col("n_regionkey").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]), ", ").alias("answer"))
    retrieved = fx.entities(spark, sf_dir).filter(F.col("type").isin("Nation", "Region")).join(F.broadcast(region.select(F.col("r_regionkey").alias("query_id"))))  # a context is all nations; regions are few
    return report.used_entities(said, retrieved)


@query("asof_last_login", """SELECT e.event_id, coalesce((SELECT max(l.event_id) FROM events l WHERE l.user_id = e.user_id AND l.event_id <= e.event_id AND l.event_type = (SELECT min(event_type) FROM events)), -1) AS last_id FROM events e""")
def asof_last_login(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("t"))
    marks = events.join(F.broadcast(first), F.col("event_type") == F.col("t")).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("section"))
    found = section_of(events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos")), marks)
    return found.select(F.col("pos").alias("event_id"), F.when(F.col("section") == "Preamble", -1).otherwise(F.col("section").try_cast("long")).cast("long").alias("last_id"))


@query("edges_of_chunks", f"""WITH {fx.SUPPLY_EDGES}, e AS (SELECT question_id AS query_id, edge_id, position, position % 3 AS kind FROM supply_edges), s AS (SELECT l_orderkey AS query_id, list(CAST(l_linenumber AS INTEGER)) AS ps FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey)
SELECT e.query_id, edge_id FROM e JOIN s USING (query_id) WHERE kind <> 0 OR list_contains(ps, position)""")  # fmt: skip
def edges_of_chunks(spark, sf_dir):
    places = F.when(F.col("position") % 3 == 0, F.array("position"))
    edges = fx.supply_edges(spark, sf_dir).select(F.col("question_id").alias("query_id"), "edge_id", places.alias("positions"), F.array().cast("array<long>").alias("passages"), F.array("question_id").alias("question_ids"))
    chunks = read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("position"), (F.col("l_orderkey") % 3).alias("passage"), F.col("l_orderkey").alias("question_id"))
    return scope.supported_by_chunks(edges, chunks).select("query_id", "edge_id")


@query("perturbation_stability")
def perturbation_stability(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    paths = graph.expand_paths(seeds, edges, 1)
    return report.perturbation_stability(paths.withColumn("weight", 1.0 / F.col("hops")))


@query("learned_certificate")
def learned_certificate(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("dataset", F.col("task_type"))
    return report.learned_certificate(rows, ["u1", "u2", "u3"])
