"""Queries on what a store holds: counts, hubs, reuse, health, provenance, clean-up and scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph, inventory, scope
from loomgraph.plans import fixtures as fx
from loomgraph.plans.graphs import TRAIL_EDGES, seed_edges
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table

CHUNKS = """chunks AS (SELECT l_linestatus AS kg_name, l_orderkey || ':' || l_linenumber AS chunk_id, l_orderkey AS document, l_orderkey AS question_id, l_orderkey % 3 AS passage, CAST(l_linenumber AS INTEGER) AS position FROM lineitem)"""


def chunks(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("kg_name"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").alias("document"), F.col("l_orderkey").alias("question_id"), (F.col("l_orderkey") % 3).alias("passage"), F.col("l_linenumber").cast("int").alias("position"),
    )


@query("kg_stats", f"""WITH {CHUNKS}, {fx.MENTIONS}, {fx.SUPPLY_EDGES} SELECT c.kg_name, CAST(count(DISTINCT document) AS BIGINT) AS documents, CAST(count(DISTINCT chunk_id) AS BIGINT) AS chunks, (SELECT CAST(count(DISTINCT entity_id) AS BIGINT) FROM mentions m JOIN chunks x USING (chunk_id) WHERE x.kg_name = c.kg_name) AS entities,
(SELECT CAST(count(*) AS BIGINT) FROM mentions m JOIN chunks x USING (chunk_id) WHERE x.kg_name = c.kg_name) AS links, (SELECT CAST(count(*) AS BIGINT) FROM supply_edges e WHERE e.condition = c.kg_name) AS relations FROM chunks c GROUP BY c.kg_name""")
def kg_stats(spark, sf_dir):
    own = chunks(spark, sf_dir)
    links = fx.mentions(spark, sf_dir).join(own.select("chunk_id", "kg_name"), "chunk_id")
    return inventory.graph_stats(own, links, fx.supply_edges(spark, sf_dir).withColumnRenamed("condition", "kg_name"))


@query("label_counts", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES} SELECT 'node' AS kind, type AS label, CAST(count(*) AS BIGINT) AS n FROM entities GROUP BY type UNION ALL SELECT 'relation', rel_type, CAST(count(*) AS BIGINT) FROM place_edges GROUP BY rel_type""")
def label_counts(spark, sf_dir):
    return inventory.label_counts(fx.entities(spark, sf_dir), fx.place_edges(spark, sf_dir))


@query("hub_report", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES}, g AS (SELECT x AS entity_id, count(*) AS d FROM (SELECT src AS x FROM place_edges UNION ALL SELECT dst FROM place_edges) GROUP BY x), o AS (SELECT type, name, entity_id, coalesce(d, 0) AS d FROM entities LEFT JOIN g USING (entity_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY d DESC, entity_id) AS r FROM o) SELECT type, CAST(count(*) AS BIGINT) AS entities, CAST(count(*) FILTER (d = 0) AS BIGINT) AS isolated, round(avg(d), 6) AS mean_degree,
round(CASE WHEN sum(d) > 0 THEN coalesce(sum(d) FILTER (r <= 10), 0) / sum(d) ELSE 0 END, 6) AS top_share, coalesce(string_agg(name, '; ' ORDER BY r) FILTER (r <= 10 AND d > 0), '') AS hubs FROM r GROUP BY type""")
def hub_report(spark, sf_dir):
    out = inventory.hub_report(fx.entities(spark, sf_dir), fx.place_edges(spark, sf_dir))
    return out.withColumn("mean_degree", F.round("mean_degree", 6)).withColumn("top_share", F.round("top_share", 6))


@query("entity_details", f"""WITH {fx.ENTITIES}, {CHUNKS}, {fx.MENTIONS}, t AS (SELECT entity_id, count(DISTINCT chunk_id) AS c, count(DISTINCT document) AS d FROM mentions JOIN chunks USING (chunk_id) GROUP BY entity_id)
SELECT entity_id, name, type, CAST(coalesce(c, 0) AS BIGINT) AS chunks, CAST(coalesce(d, 0) AS BIGINT) AS documents FROM entities LEFT JOIN t USING (entity_id) WHERE contains(lower(name), 'supplier') OR contains(lower(name), 'an')""")
def entity_details(spark, sf_dir):
    low = F.lower("name")
    return inventory.entity_details(fx.entities(spark, sf_dir), fx.mentions(spark, sf_dir), chunks(spark, sf_dir), F.contains(low, F.lit("supplier")) | F.contains(low, F.lit("an")))




@query("reuse_reasons", """WITH m AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS f1, (o_orderkey + o_custkey) % 2 = 0 AS f2, o_orderstatus AS t1, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'F' END AS t2, o_orderkey % 3 AS n1, o_custkey % 3 AS n2, CASE WHEN o_custkey % 2 = 0 THEN 'evaluation_subset' ELSE 'whole' END AS scope FROM orders),
r AS (SELECT id, [CASE WHEN f1 <> f2 THEN 'uses_global_corpus' END, CASE WHEN t2 <> '' AND t1 <> t2 THEN 'content_hash' END, CASE WHEN n1 <> n2 THEN 'kg_chunk_size' END, CASE WHEN scope = 'evaluation_subset' AND NOT f2 AND n1 <> n2 THEN 'selection_key' END] AS x FROM m)
SELECT id, array_to_string([y FOR y IN x IF y IS NOT NULL], ',') AS reasons, len([y FOR y IN x IF y IS NOT NULL]) = 0 AS reusable FROM r""")
def reuse_reasons(spark, sf_dir):
    key, cust, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None).cast("string")
    told = {"uses_global_corpus": (key % 2 == 0, (key + cust) % 2 == 0), "content_hash": (F.col("o_orderstatus"), F.when(cust % 5 == 0, "").otherwise("F")), "kg_chunk_size": (key % 3, cust % 3), "selection_key": ((key % 3).cast("string"), (cust % 3).cast("string")), "dataset_kg_scope": (none, F.when(cust % 2 == 0, "evaluation_subset").otherwise("whole"))}
    names = [*inventory.COMPARED_FLAGS, *inventory.COMPARED_TEXTS, *inventory.COMPARED_NUMBERS, "selection_key"]
    pairs = [side.alias(f"{kind}_{name}") for name in names for kind, side in zip(("stored", "expected"), told.get(name, (none, none)), strict=True)]
    return inventory.reuse_reasons(read_table(spark, sf_dir, "orders").select(key.alias("id"), *pairs)).select("id", "reasons", "reusable")


@query("store_health", """WITH r AS (SELECT o_custkey AS run, count(*) * 20 AS extracted, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus <> 'P') * 20 - count(*) FILTER (o_orderpriority = '1-URGENT') AS stored, count(*) FILTER (o_orderpriority = '1-URGENT') AS failures FROM orders GROUP BY o_custkey),
t AS (SELECT *, greatest(0, extracted - skipped) AS attempted FROM r), b AS (SELECT *, attempted < 100 OR CASE WHEN attempted > 0 THEN failures / attempted ELSE 1 END > 0.005 OR (attempted > 0 AND stored = 0) AS bad FROM t)
SELECT run, CAST(attempted AS BIGINT) AS attempted, round(CASE WHEN attempted > 0 THEN stored / attempted ELSE 1 END, 6) AS store_ratio, failures > 0 AND bad AS failed, failures > 0 AND NOT bad AS degraded FROM b""")
def store_health(spark, sf_dir):
    count = lambda c: F.sum(c.cast("long"))
    p, urgent = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"
    runs = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg((F.count(F.lit(1)) * 20).alias("extracted"), count(p).alias("skipped"), (count(~p) * 20 - count(urgent)).alias("stored"), count(urgent).alias("failures"))
    return inventory.store_health(runs).select("run", F.col("attempted").cast("long").alias("attempted"), F.round("store_ratio", 6).alias("store_ratio"), "failed", "degraded")


@query("orphans", f"""WITH {fx.ENTITIES}, {fx.MENTIONS} SELECT 'entity' AS kind, entity_id AS id FROM entities WHERE entity_id LIKE 'P%' AND entity_id NOT IN (SELECT entity_id FROM mentions WHERE position = 1)
UNION ALL SELECT 'qualifier', 'C' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def orphans(spark, sf_dir):
    lost = inventory.orphan_entities(fx.entities(spark, sf_dir), fx.mentions(spark, sf_dir).filter("position = 1"), "P")
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    orders = read_table(spark, sf_dir, "orders")
    links = orders.filter("o_orderstatus = 'F'").select(F.lit("x").alias("src"), name("o_custkey").alias("dst")).union(orders.filter("o_orderstatus = 'O'").select(name("o_custkey"), F.lit("x")))
    open_ = inventory.orphan_qualifiers(read_table(spark, sf_dir, "customer").select(name("c_custkey").alias("qualifier_id")), links)
    return lost.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).union(open_.select(F.lit("qualifier"), "qualifier_id"))


@query("verification_chunks", """WITH c AS (SELECT conv_id AS kg_name, turn AS position, conv_id || ':' || turn AS chunk_id FROM conversations), e AS (SELECT DISTINCT conv_id AS edge_id, conv_id AS kg_name, CASE WHEN conv_id % 3 = 0 THEN [900] ELSE [conv_id % 4, conv_id % 4 + 1] END AS positions FROM conversations),
s AS (SELECT DISTINCT edge_id, chunk_id FROM e JOIN c ON c.kg_name = e.kg_name AND list_contains(e.positions, c.position))
SELECT * FROM s UNION ALL SELECT DISTINCT edge_id, chunk_id FROM e JOIN c USING (kg_name) WHERE edge_id NOT IN (SELECT edge_id FROM s)""")
def verification_chunks(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    key = F.col("conv_id")
    own = rows.select(key.alias("kg_name"), F.col("turn").alias("position"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))
    places = F.when(key % 3 == 0, F.array(F.lit(900).cast("long"))).otherwise(F.array(key % 4, key % 4 + 1))
    return inventory.verification_chunks(rows.select(key.alias("edge_id"), key.alias("kg_name"), places.alias("positions")).distinct(), own)


@query("local_provenance", """WITH e AS (SELECT DISTINCT l_partkey AS edge_id, l_orderkey * 10 + l_linenumber AS position FROM lineitem), c AS (SELECT l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_orderkey % 7 > 0 THEN l_orderkey END AS question_id, l_orderkey % 3 AS passage FROM lineitem)
SELECT edge_id, md5(array_to_string(list_sort(list_distinct(list(question_id::VARCHAR))), ',')) AS questions, md5(array_to_string(list_sort(list_distinct(list(question_id || '::p' || passage))), ',')) AS passages FROM e JOIN c USING (position) WHERE question_id IS NOT NULL GROUP BY edge_id""")
def local_provenance(spark, sf_dir):
    """A part's edge has the places of all its line items; places are one of a kind across questions."""
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = read_table(spark, sf_dir, "lineitem")
    edges = lines.groupBy(F.col("l_partkey").alias("edge_id")).agg(F.collect_set(place).alias("positions"))
    own = lines.select(place.alias("position"), F.when(F.col("l_orderkey") % 7 > 0, F.col("l_orderkey")).alias("question_id"), (F.col("l_orderkey") % 3).alias("passage"))
    out = inventory.local_provenance(edges, own)
    return out.select("edge_id", F.md5(F.array_join("question_ids", ",")).alias("questions"), F.md5(F.array_join("passage_keys", ",")).alias("passages"))


NAMES = """e AS (SELECT 'P' || p_partkey AS entity_id, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'Concept' ELSE p_type END AS type, p_size AS mentions, p_brand AS scope, replace(lower(p_name), ' ', '_') AS key, (p_size % 4 = 0)::INT AS g FROM part),
names AS (SELECT key, arg_min(entity_id, (g, -mentions, entity_id)) AS entity_id FROM e GROUP BY key), scoped AS (SELECT scope, key, min(entity_id) AS entity_id FROM e GROUP BY ALL)"""


def named(spark, sf_dir):
    size = F.col("p_size")
    own = read_table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.when(size % 4 == 0, "Concept").otherwise(F.col("p_type")).alias("type"), size.alias("mentions"), F.col("p_brand").alias("scope"))
    return own, inventory.name_map(own)


@query("name_map", f"""WITH {NAMES} SELECT key, entity_id FROM names""")
def name_map(spark, sf_dir):
    return named(spark, sf_dir)[1]


@query("resolved_ends", f"""WITH {NAMES}, x AS (SELECT p_partkey AS edge_id, p_brand AS scope, replace(lower(p_name), ' ', '_') AS s, CASE WHEN p_size % 5 = 0 THEN 'nobody' ELSE (SELECT min(key) FROM names) END AS t FROM part)
SELECT edge_id, coalesce(a.entity_id, b.entity_id) AS src, coalesce(c.entity_id, d.entity_id) AS dst FROM x LEFT JOIN scoped a ON a.scope = x.scope AND a.key = s LEFT JOIN names b ON b.key = s LEFT JOIN scoped c ON c.scope = x.scope AND c.key = t LEFT JOIN names d ON d.key = t""")
def resolved_ends(spark, sf_dir):
    from loomgraph.functions.text import entity_key

    own, names = named(spark, sf_dir)
    scoped = own.groupBy("scope", entity_key(F.col("name")).alias("key")).agg(F.min("entity_id").alias("entity_id"))
    first = names.agg(F.min("key").alias("first"))
    edges = read_table(spark, sf_dir, "part").join(F.broadcast(first)).select(F.col("p_partkey").alias("edge_id"), F.col("p_brand").alias("scope"), F.col("p_name").alias("source"), F.when(F.col("p_size") % 5 == 0, "nobody").otherwise(F.col("first")).alias("target"))  # one row
    return inventory.resolved_ends(edges, scoped, names).select("edge_id", "src", "dst")


@query("restoration_status", f"""WITH {fx.SUPPLY_EDGES}, g AS (SELECT edge_id, negated AS s, position % 2 = 0 AS r, confidence > 0.6 AS t FROM supply_edges) SELECT edge_id, CASE WHEN s AND r AND t THEN 'full' WHEN s AND t THEN 'partial' WHEN s OR r OR t THEN 'minimal' ELSE 'failed' END AS status FROM g""")
def restoration_status(spark, sf_dir):
    return fx.supply_edges(spark, sf_dir).select("edge_id", inventory.restoration_status(F.col("negated"), F.col("position") % 2 == 0, F.col("confidence") > 0.6).alias("status"))


@query("merged_spans", """WITH s AS (SELECT l_orderkey AS edge_id, l_returnflag AS t, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS a, l_quantity::INTEGER % 5 AS b FROM lineitem), d AS (SELECT DISTINCT * FROM s)
SELECT edge_id, string_agg(coalesce(a::VARCHAR, '-') || ':' || b || t, ' ' ORDER BY a NULLS LAST, b, t) AS spans FROM d GROUP BY edge_id""")
def merged_spans(spark, sf_dir):
    span = F.struct(F.col("l_returnflag").alias("text"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("int")).alias("start"), (F.col("l_quantity").cast("int") % 5).alias("end"))
    halves = [F.collect_list(F.when(F.col("l_linenumber") % 2 == k, span)) for k in (0, 1)]
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id")).agg(*[h.alias(n) for h, n in zip(halves, "xy", strict=True)])
    told = F.transform(inventory.merged_spans(F.col("x"), F.col("y")), lambda s: F.concat(F.coalesce(s["start"].cast("string"), F.lit("-")), F.lit(":"), s["end"].cast("string"), s["text"]))
    return rows.select("edge_id", F.array_join(told, " ").alias("spans"))


@query("community_rollup", """WITH m AS (SELECT 'C' || c_custkey AS e, 'N' || c_nationkey AS n, 'R' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT e AS entity_id, 1 AS level, n AS community FROM m UNION ALL SELECT e, 2, r FROM m UNION ALL SELECT e, 3, 'World' FROM m""")
def community_rollup(spark, sf_dir):
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    members = read_table(spark, sf_dir, "customer").select(name("C", "c_custkey").alias("entity_id"), name("N", "c_nationkey").alias("community"))
    parents = nation.select(name("N", "n_nationkey").alias("community"), name("R", "n_regionkey").alias("parent")).union(region.select(name("R", "r_regionkey"), F.lit("World")))
    return inventory.community_rollup(members, parents)


@query("visible_graph", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES} SELECT src, dst FROM place_edges WHERE rel_type = 'LOCATED_IN' AND src IN (SELECT entity_id FROM entities WHERE type IN ('Nation', 'Customer')) AND dst IN (SELECT entity_id FROM entities WHERE type IN ('Nation', 'Customer'))""")
def visible_graph(spark, sf_dir):
    return inventory.visible(fx.entities(spark, sf_dir), fx.place_edges(spark, sf_dir), ["Nation", "Customer"], ["LOCATED_IN"])[1].select("src", "dst")


@query("scope_violations", f"""WITH {CHUNKS}, r AS (SELECT l_suppkey AS query_id, CASE WHEN l_tax > 0.06 THEN 'F' ELSE l_linestatus END AS kg_name, CASE WHEN l_quantity < 10 THEN l_orderkey + 1 WHEN l_quantity < 30 THEN l_orderkey END AS question_id, l_orderkey || ':' || l_linenumber AS chunk_id FROM lineitem)
SELECT query_id, chunk_id FROM r LEFT JOIN chunks c USING (kg_name, chunk_id) GROUP BY query_id, chunk_id HAVING NOT bool_or(c.question_id IS NOT NULL AND (r.question_id IS NULL OR r.question_id = c.question_id))""")
def scope_violations(spark, sf_dir):
    quantity, key = F.col("l_quantity"), F.col("l_orderkey")
    retrieved = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.when(F.col("l_tax") > 0.06, "F").otherwise(F.col("l_linestatus")).alias("kg_name"), F.when(quantity < 10, key + 1).when(quantity < 30, key).alias("question_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"),
    )
    return inventory.scope_violations(retrieved, chunks(spark, sf_dir))


@query("supported_paths", f"""WITH {TRAIL_EDGES.replace("confidence >= 0.4", "confidence >= 0.4 AND edge_id IN (SELECT edge_id FROM supply_edges WHERE confidence >= 0.7)")} SELECT query_id, e1 || coalesce('+' || e2, '') AS path_id FROM p""")
def supported_paths(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    paths = graph.expand_paths(seeds, inventory.edges_in_scope(edges, edges.filter("confidence >= 0.7")), 2)
    return paths.select("query_id", F.array_join("edge_ids", "+").alias("path_id"))


@query("reachable_passages", f"""WITH {TRAIL_EDGES}, {fx.MENTIONS}, r AS (SELECT query_id, node, min(hops) AS hops FROM p WHERE node <> seed GROUP BY ALL) SELECT query_id, passage, CAST(min(hops) AS INTEGER) AS hops FROM r JOIN (SELECT DISTINCT entity_id, passage FROM mentions) m ON m.entity_id = node GROUP BY ALL""")
def reachable_passages(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    return inventory.passages_within(seeds, edges, fx.mentions(spark, sf_dir), 2)


@query("documents_support", f"""WITH {fx.SUPPLY_EDGES}, {fx.MENTIONS}, d AS (SELECT DISTINCT entity_id FROM mentions WHERE passage = 1) SELECT DISTINCT src, dst FROM supply_edges WHERE src IN (SELECT entity_id FROM d) AND dst IN (SELECT entity_id FROM d)""")
def documents_support(spark, sf_dir):
    """Pairs each of whose entities some chunk of the given documents mentions."""
    told = scope.supported_entities(fx.entities(spark, sf_dir), fx.mentions(spark, sf_dir).filter("passage = 1"))
    pairs = fx.supply_edges(spark, sf_dir).select("src", "dst").distinct()
    for end in ("src", "dst"):
        pairs = pairs.join(told.select(F.col("entity_id").alias(end)), end, "left_semi")
    return pairs
