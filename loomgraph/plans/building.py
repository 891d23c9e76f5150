"""Queries on graph construction, chunking and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import build, chunking, graph, spans, uncertainty
from loomgraph.operators.stats import W
from loomgraph.plans import fixtures as fx
from loomgraph.plans.graphs import TRAIL_EDGES, seed_edges
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table


@query("harmonize_entities", """WITH r AS (SELECT p_name AS name, CASE p_size % 4 WHEN 0 THEN 'Concept' ELSE split_part(p_type, ' ', 1) END AS type, p_brand AS description FROM part),
k AS (SELECT *, replace(lower(name), ' ', '_') AS key, type = 'Concept' AS generic FROM r),
s AS (SELECT key, type, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, type) AS r FROM k WHERE NOT generic GROUP BY key, type),
b AS (SELECT k.*, CASE WHEN generic THEN coalesce(s.type, 'Concept') ELSE k.type END AS bucket FROM k LEFT JOIN s ON s.key = k.key AND s.r = 1)
SELECT key, bucket, CAST(count(*) AS BIGINT) AS mentions, array_to_string(list_sort(list_distinct(list(name))), '|') AS all_names FROM b GROUP BY ALL""")  # fmt: skip
def harmonize_entities(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    rows = part.select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, "Concept").otherwise(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("type"), F.col("p_brand").alias("description"))
    return build.harmonize_entities(rows).select("key", "bucket", "mentions", F.array_join("all_names", "|").alias("all_names"))


@query("merge_relations", f"""WITH {fx.SUPPLY_EDGES}
SELECT src, rel_type, dst, negated, lower(trim(condition)) AS condition, max(confidence) AS confidence, CAST(count(*) AS BIGINT) AS copies, array_to_string(list_sort(list_distinct(list(question_id))), ',') AS question_ids,
array_to_string(list_sort(list_distinct(list(position))), ',') AS positions FROM supply_edges GROUP BY src, rel_type, dst, negated, lower(trim(condition))""")  # fmt: skip
def merge_relations(spark, sf_dir):
    out = build.merge_relations(fx.supply_edges(spark, sf_dir))
    return out.select("src", "rel_type", "dst", "negated", "condition", "confidence", "copies", F.array_join("question_ids", ",").alias("question_ids"), F.array_join("positions", ",").alias("positions"))


@query("contradictions", f"""WITH {fx.SUPPLY_EDGES}
SELECT src, rel_type, dst, lower(trim(condition)) AS condition, CAST(count(*) FILTER (NOT negated) AS BIGINT) AS affirmed, CAST(count(*) FILTER (negated) AS BIGINT) AS denied FROM supply_edges
GROUP BY src, rel_type, dst, lower(trim(condition)) HAVING count(*) FILTER (NOT negated) > 0 AND count(*) FILTER (negated) > 0""")  # fmt: skip
def contradictions(spark, sf_dir):
    return build.contradictions(fx.supply_edges(spark, sf_dir))


@query("flagged_contradictions", f"""WITH {fx.SUPPLY_EDGES}, e AS (SELECT *, CASE position % 3 WHEN 0 THEN ' 5 MG' WHEN 1 THEN '5 mg ' END AS quantity FROM supply_edges),
g AS (SELECT src, dst, rel_type, lower(trim(condition)) AS c, lower(trim(coalesce(quantity, ''))) AS u, count(DISTINCT negated) AS n FROM e GROUP BY ALL)
SELECT edge_id, e.src, e.dst, confidence, g.n = 2 AS contradicted FROM e JOIN g ON g.src = e.src AND g.dst = e.dst AND g.c = lower(trim(condition)) AND g.u = lower(trim(coalesce(quantity, '')))""")  # fmt: skip
def flagged_contradictions(spark, sf_dir):
    quantity = F.when(F.col("position") % 3 == 0, " 5 MG").when(F.col("position") % 3 == 1, "5 mg ")
    out = build.flagged_contradictions(fx.supply_edges(spark, sf_dir).withColumn("quantitative", quantity))
    return out.select("edge_id", "src", "dst", "confidence", "contradicted")


@query("titled_entities", """WITH r AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'result' ELSE split_part(p_name, ' ', 1) END AS name, CASE p_size % 4 WHEN 0 THEN 'Concept' WHEN 1 THEN 'Person' ELSE 'Place' END AS type, CASE p_size % 3 WHEN 0 THEN ' HotpotQA' ELSE 'bioasq' END AS ds,
  CASE p_size % 5 WHEN 0 THEN upper(split_part(p_name, ' ', 1)) || ' (thing)' ELSE 'Other' END AS title, 's' || p_partkey % 3 AS scope FROM part),
k AS (SELECT *, lower(name) AS key, type = 'Concept' AS generic, CASE WHEN ds = ' HotpotQA' AND title <> 'Other' THEN scope END AS ts FROM r WHERE name <> 'result' AND length(name) >= 3),
m AS (SELECT key, count(DISTINCT ts) AS n FROM k GROUP BY key), q AS (SELECT k.*, CASE WHEN n > 1 THEN ts END AS t FROM k JOIN m USING (key)),
s AS (SELECT key, t, type, row_number() OVER (PARTITION BY key, t ORDER BY count(*) DESC, type) AS r FROM q WHERE NOT generic GROUP BY key, t, type),
b AS (SELECT q.*, CASE WHEN generic THEN coalesce(s.type, 'Concept') ELSE q.type END AS bucket FROM q LEFT JOIN s ON s.key = q.key AND s.t IS NOT DISTINCT FROM q.t AND s.r = 1)
SELECT key, bucket, t AS title_scope, CAST(count(*) AS BIGINT) AS mentions FROM b GROUP BY key, bucket, t""")  # fmt: skip
def titled_entities(spark, sf_dir):
    size, first = F.col("p_size"), F.split_part("p_name", F.lit(" "), F.lit(1))
    rows = read_table(spark, sf_dir, "part").select(
        F.when(size % 6 == 0, "result").otherwise(first).alias("name"), F.when(size % 4 == 0, "Concept").when(size % 4 == 1, "Person").otherwise("Place").alias("type"), F.lit(None).cast("string").alias("description"),
        F.when(size % 3 == 0, " HotpotQA").otherwise("bioasq").alias("dataset"), F.when(size % 5 == 0, F.concat(F.upper(first), F.lit(" (thing)"))).otherwise("Other").alias("source_title"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("scope_key"),
    )
    return build.harmonize_entities(rows).select("key", "bucket", "title_scope", "mentions")


@query("triple_confidence", r"""WITH g AS (SELECT doc_id, doc_id % 50 AS grp, lower(text) AS text FROM documents),
t AS (SELECT item_id AS triple_id, lower(split_part(text, ' ', 1)) AS s, lower(split_part(text, ' ', 3)) AS t, item_id % 60 AS grp FROM benchmark),
j AS (SELECT triple_id, s, t, text, [x FOR x IN regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))] AS sents FROM t LEFT JOIN g USING (grp)),
f AS (SELECT triple_id, count(text) AS n, bool_or(len(list_filter(sents, lambda x: contains(x, s) AND contains(x, t))) > 0) AS a, bool_or(contains(text, s) AND contains(text, t)) AS b, bool_or(contains(text, s)) AS c, bool_or(contains(text, t)) AS d FROM j GROUP BY triple_id)
SELECT triple_id, CASE WHEN n = 0 THEN 0.5::DOUBLE WHEN a THEN 1.0::DOUBLE WHEN b THEN 0.7::DOUBLE WHEN c AND d THEN 0.4::DOUBLE WHEN c OR d THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM f""")  # fmt: skip
def triple_confidence(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("group"), "text")
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    triples = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("triple_id"), word(1).alias("source"), word(3).alias("target"), (F.col("item_id") % 60).alias("group"))
    return build.triple_confidence(triples, chunks)


@query("node_specificity", f"""WITH {fx.MENTIONS} SELECT entity_id, CAST(count(DISTINCT chunk_id) AS BIGINT) AS passages, round(1.0 / count(DISTINCT chunk_id), 9) AS specificity FROM mentions GROUP BY entity_id""")
def node_specificity(spark, sf_dir):
    return build.node_specificity(fx.mentions(spark, sf_dir)).select("entity_id", "passages", F.round("specificity", 9).alias("specificity"))


@query("mention_linking", r"""WITH w AS (SELECT item_id, [x FOR x IN string_split(lower(text), ' ') IF regexp_matches(x, '^[a-z0-9]{4,}$')] AS ws FROM benchmark),
n AS (SELECT DISTINCT name FROM (SELECT unnest(ws) AS name FROM w UNION ALL SELECT unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w)),
c AS (SELECT doc_id AS chunk_id, text, lower(text) AS low FROM documents),
h AS (SELECT chunk_id, name, text FROM c JOIN n ON contains(low, name) WHERE regexp_matches(low, '(^|[^a-z0-9])' || name || '($|[^a-z0-9])'))
SELECT chunk_id, name AS entity_id, left(coalesce([s FOR s IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF contains(lower(s), name)][1], left(text, 200)), 500) AS quote FROM h""")  # fmt: skip
def mention_linking(spark, sf_dir):
    """Names are the words of all items, and their neighbouring pairs."""
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w.rlike("^[a-z0-9]{4,}$"))
    pairs = F.zip_with(F.col("ws"), F.slice("ws", 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    names = read_table(spark, sf_dir, "benchmark").select(words.alias("ws")).select(F.explode(F.concat("ws", F.filter(pairs, lambda p: p.isNotNull()))).alias("name")).distinct()
    chunks = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return spans.mention_links(chunks, names.select(F.col("name").alias("entity_id"), "name"))


@query("self_consistency", f"""WITH {fx.SUPPLY_EDGES} SELECT src, dst, CAST(count(DISTINCT position % 5) AS BIGINT) AS votes FROM supply_edges GROUP BY src, dst HAVING count(DISTINCT position % 5) >= 3""")
def self_consistency(spark, sf_dir):
    return build.voted(fx.supply_edges(spark, sf_dir).withColumn("sample_id", F.col("position") % 5), ["src", "dst"], 5)


@query("unconnected_entities", f"""WITH {fx.ENTITIES}, {fx.SUPPLY_EDGES} SELECT entity_id, type FROM entities WHERE entity_id NOT IN (SELECT src FROM supply_edges WHERE confidence > 0.9 UNION SELECT dst FROM supply_edges WHERE confidence > 0.9)""")
def unconnected_entities(spark, sf_dir):
    return build.unconnected(fx.entities(spark, sf_dir), fx.supply_edges(spark, sf_dir).filter("confidence > 0.9")).select("entity_id", "type")


@query("upsert_entities", f"""WITH {fx.ENTITIES}, o AS (SELECT entity_id, type, [name, lower(name)] AS n FROM entities WHERE type <> 'Part'), w AS (SELECT entity_id, upper(type) AS type, [name] AS n FROM entities WHERE type IN ('Nation', 'Part'))
SELECT entity_id, coalesce(w.type, o.type) AS type, array_to_string(list_concat(coalesce(o.n, []), coalesce(w.n, [])), '|') AS all_names FROM o FULL JOIN w USING (entity_id)""")  # fmt: skip
def upsert_entities(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    old = e.filter("type <> 'Part'").select("entity_id", "type", F.array("name", F.lower("name")).alias("all_names"))
    new = e.filter(F.col("type").isin("Nation", "Part")).select("entity_id", F.upper("type").alias("type"), F.array("name").alias("all_names"))
    return build.upsert_entities(old, new).select("entity_id", "type", F.array_join("all_names", "|").alias("all_names"))


@query("contiguous_groups", """WITH o AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY e.ts, o.event_id) AS BIGINT) AS group_no FROM o JOIN events e USING (user_id, event_id)""")  # fmt: skip
def contiguous_groups(spark, sf_dir):
    return build.contiguous_groups(read_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "group_no")


@query("fixed_window_chunks", """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 64) / 192.0) AS BIGINT)))) AS k FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(k AS INTEGER) AS position, CAST(k * 192 AS INTEGER) AS start_pos, CAST(length(substr(text, k * 192 + 1, 256)) AS INTEGER) AS size, sha1(doc_id || ':' || k || ':' || substr(text, k * 192 + 1, 256)) AS chunk_id FROM c""")  # fmt: skip
def fixed_window_chunks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return chunking.fixed_windows(docs, 256, 64).select("doc_id", "position", "start_pos", F.length("chunk").alias("size"), F.sha1(F.concat_ws(":", "doc_id", "position", "chunk")).alias("chunk_id"))


@query("passage_dedupe_first", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, trim(text) ORDER BY doc_id) AS r FROM documents WHERE trim(text) <> '') SELECT doc_id, source FROM r WHERE r = 1""")
def passage_dedupe_first(spark, sf_dir):
    return chunking.first_passages(read_table(spark, sf_dir, "documents"), ["source"], ["doc_id"]).select("doc_id", "source")


@query("sliding_segments", """WITH s AS (SELECT conv_id, turn, text, lead(text, 1) OVER w AS t2, lead(text, 2) OVER w AS t3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 2 AS width, md5(text || ' ' || t2) AS digest FROM s WHERE t2 IS NOT NULL UNION ALL SELECT conv_id, turn, 3, md5(text || ' ' || t2 || ' ' || t3) FROM s WHERE t3 IS NOT NULL""")  # fmt: skip
def sliding_segments(spark, sf_dir):
    out = chunking.sliding_segments(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)
    return out.select("conv_id", "turn", "width", F.md5("segment").alias("digest"))


@query("json_props", """SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) WHERE e = event_id""")
def json_props(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


CLUSTERED = """samples AS (SELECT conv_id AS question_id, turn AS sample_id, length(text) % 3 AS cluster, text FROM conversations WHERE role = 'assistant')"""


def clustered(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("sample_id"), (F.length("text") % 3).alias("cluster"), "text")


@query("discrete_semantic_entropy", f"""WITH {CLUSTERED}, c AS (SELECT question_id, cluster, count(*) AS c FROM samples GROUP BY ALL), p AS (SELECT question_id, c, c / sum(c) OVER (PARTITION BY question_id) AS p FROM c)
SELECT question_id, round(-sum(p * ln(p)) + 0.0, 6) + 0.0 AS entropy, CAST(count(*) AS BIGINT) AS labels, CAST(sum(c) AS BIGINT) AS n FROM p GROUP BY question_id""")  # fmt: skip
def discrete_semantic_entropy(spark, sf_dir):
    return uncertainty.entropy(clustered(spark, sf_dir), ["question_id"], "cluster").select("question_id", (F.round("entropy", 6) + 0.0).alias("entropy"), "labels", "n")


@query("semantic_entropy", f"""WITH {CLUSTERED}, f AS (SELECT *, count(*) OVER (PARTITION BY question_id, lower(trim(text))) AS f FROM samples), m AS (SELECT question_id, cluster, sum(f) AS m FROM f GROUP BY ALL),
p AS (SELECT question_id, m / sum(m) OVER (PARTITION BY question_id) AS p FROM m) SELECT question_id, round(-sum(p * ln(p)) + 0.0, 6) + 0.0 AS semantic_entropy, CAST(count(*) AS BIGINT) AS clusters FROM p GROUP BY question_id""")  # fmt: skip
def semantic_entropy(spark, sf_dir):
    return uncertainty.semantic_entropy(clustered(spark, sf_dir)).select("question_id", (F.round("semantic_entropy", 6) + 0.0).alias("semantic_entropy"), "clusters")


@query("p_true", f"""WITH {CLUSTERED}, f AS (SELECT question_id, arg_min(cluster, sample_id) AS own, count(*) AS n FROM samples GROUP BY question_id)
SELECT question_id, CASE WHEN max(n) < 2 THEN 0.5 ELSE round(avg((cluster = own)::INT), 6) END AS p_true FROM samples JOIN f USING (question_id) GROUP BY question_id""")  # fmt: skip
def p_true(spark, sf_dir):
    return uncertainty.p_true(clustered(spark, sf_dir)).select("question_id", F.round("p_true", 6).alias("p_true"))


@query("lexical_clusters", r"""WITH RECURSIVE t AS (SELECT conv_id AS q, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'assistant'),
r AS (
  SELECT q, turn, i, [w] AS heads, 0 AS label FROM t WHERE i = 0
  UNION ALL SELECT q, turn, i, CASE WHEN k IS NULL THEN list_append(heads, w) ELSE heads END, coalesce(k - 1, len(heads))
  FROM (SELECT t.q, t.turn, t.i, t.w, heads, nullif(list_position([len(list_distinct(list_concat(h, t.w))) = 0 OR len(list_intersect(h, t.w)) / len(list_distinct(list_concat(h, t.w))) >= 0.45 FOR h IN heads], TRUE), 0) AS k FROM r JOIN t ON t.q = r.q AND t.i = r.i + 1))
SELECT q AS question_id, turn AS sample_id, CAST(label AS INTEGER) AS cluster FROM r""")  # fmt: skip
def lexical_clusters(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return uncertainty.lexical_clusters(turns.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("sample_id"), "text")).select("question_id", "sample_id", "cluster")


@query("graph_state_entropy", f"""WITH {fx.GRAPH_STATES}, s AS (SELECT user_id, day, string_agg(event_type, '||' ORDER BY event_type) AS sig FROM graph_states GROUP BY ALL), c AS (SELECT user_id, sig, count(*) AS c FROM s GROUP BY ALL),
p AS (SELECT user_id, c, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, round(-sum(p * log2(p)) + 0.0, 6) + 0.0 AS entropy, round(CASE WHEN sum(c) > 1 THEN -sum(p * log2(p)) / log2(sum(c)) ELSE 0 END + 0.0, 6) + 0.0 AS normalized, CAST(count(*) AS BIGINT) AS labels FROM p GROUP BY user_id""")  # fmt: skip
def graph_state_entropy(spark, sf_dir):
    states = fx.graph_states(spark, sf_dir).groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "||").alias("signature"))
    out = uncertainty.entropy(states, ["user_id"], "signature", base2=True)
    scaled = F.when(F.col("n") > 1, F.col("entropy") / F.log2(F.col("n").cast("double"))).otherwise(0.0)
    return out.select("user_id", (F.round("entropy", 6) + 0.0).alias("entropy"), (F.round(scaled, 6) + 0.0).alias("normalized"), "labels")


@query("pairwise_jaccard", f"""WITH {fx.GRAPH_STATES}, s AS (SELECT user_id, day, list(event_type) AS x FROM graph_states GROUP BY ALL),
p AS (SELECT a.user_id, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS j FROM s a JOIN s b ON a.user_id = b.user_id AND a.day < b.day)
SELECT s.user_id, round(coalesce(max(m.j), 1.0), 6) AS jaccard FROM (SELECT DISTINCT user_id FROM s) s LEFT JOIN (SELECT user_id, avg(j) AS j FROM p GROUP BY user_id) m ON m.user_id = s.user_id GROUP BY s.user_id""")  # fmt: skip
def pairwise_jaccard(spark, sf_dir):
    sets = fx.graph_states(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set("event_type").alias("items"))
    return uncertainty.mean_pairwise_jaccard(sets, ["user_id"], "day", "items").select("user_id", F.round("jaccard", 6).alias("jaccard"))


@query("seu_ecu", """WITH l AS (SELECT l_orderkey AS question_id, count(*) FILTER (l_returnflag = 'N') AS e, count(*) FILTER (l_returnflag = 'R') AS c, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT question_id, round((1 - (e - c) / n) / 2, 6) AS seu, round(CASE WHEN n >= 2 THEN e * c / (n * (n - 1) / 2) ELSE 0 END, 6) AS ecu FROM l""")  # fmt: skip
def seu_ecu(spark, sf_dir):
    flag = lambda f: F.sum((F.col("l_returnflag") == f).cast("long"))
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("question_id")).agg(flag("N").alias("e"), flag("R").alias("c"), F.count(F.lit(1)).alias("n"))
    e, c, n = F.col("e"), F.col("c"), F.col("n")
    return rows.select("question_id", F.round(uncertainty.support_uncertainty(e, c, n), 6).alias("seu"), F.round(uncertainty.conflict_uncertainty(e, c, n), 6).alias("ecu"))


@query("graph_path_support", f"""WITH {TRAIL_EDGES}, a AS (SELECT s_suppkey AS query_id, unnest(['P' || (s_suppkey * 7), 'P' || (s_suppkey * 7 + 1), 'S' || (s_suppkey + 1)]) AS node FROM supplier),
r AS (SELECT DISTINCT query_id, node FROM p)
SELECT query_id, round(1 - count(r.node) / count(*), 6) AS support_uncertainty FROM a LEFT JOIN r USING (query_id, node) GROUP BY query_id""")  # fmt: skip
def graph_path_support(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    k = F.col("query_id")
    part = lambda n: F.concat(F.lit("P"), n.cast("string"))
    wanted = seeds.select("query_id", F.explode(F.array(part(k * 7), part(k * 7 + 1), F.concat(F.lit("S"), (k + 1).cast("string")))).alias("node"))
    return uncertainty.graph_path_support(wanted, graph.reached_among(seeds, edges, wanted, 2)).select("query_id", F.round("support_uncertainty", 6).alias("support_uncertainty"))


@query("path_disagreement", f"""WITH {TRAIL_EDGES}, c AS (SELECT query_id, node, count(*) AS c FROM p GROUP BY ALL), q AS (SELECT query_id, c / sum(c) OVER (PARTITION BY query_id) AS x FROM c)
SELECT query_id, round(-sum(x * ln(x + 1e-12)) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END, 6) AS disagreement, CAST(count(*) AS BIGINT) AS ends FROM q GROUP BY query_id""")  # fmt: skip
def path_disagreement(spark, sf_dir):
    edges, seeds = seed_edges(spark, sf_dir)
    return uncertainty.path_disagreement(graph.path_counts(seeds, edges, 2)).select("query_id", F.round("disagreement", 6).alias("disagreement"), "ends")


@query("competing_alternatives", f"""WITH {fx.SUPPLY_EDGES}, e AS (SELECT DISTINCT src, rel_type, dst FROM supply_edges), s AS (SELECT dst, min(src) AS src FROM e GROUP BY dst),
q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey WHEN p_partkey % 3 = 1 THEN src ELSE 'nobody' END AS node FROM part LEFT JOIN s ON dst = 'P' || p_partkey),
a AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN src ELSE 'P' || p_partkey END AS node FROM part LEFT JOIN s ON dst = 'P' || p_partkey),
w AS (SELECT src AS f, dst AS t, rel_type, 0 AS d FROM e UNION ALL SELECT dst, src, rel_type, 1 FROM e),
k AS (SELECT q.query_id, d, rel_type, t FROM w JOIN q ON q.node = f WHERE t <> q.node), ty AS (SELECT DISTINCT k.query_id, d, rel_type FROM k JOIN a ON a.query_id = k.query_id AND a.node = t), c AS (SELECT query_id, min(d) AS d FROM ty GROUP BY query_id),
n AS (SELECT k.query_id, k.rel_type, count(DISTINCT t) AS n FROM k JOIN ty USING (query_id, d, rel_type) JOIN c USING (query_id, d) GROUP BY k.query_id, k.rel_type), m AS (SELECT query_id, max(n) AS n FROM n GROUP BY query_id)
SELECT q.query_id, coalesce(round(1 - 1 / (1 + n), 6), 0) AS competition FROM q LEFT JOIN m ON m.query_id = q.query_id WHERE node IS NOT NULL""")  # fmt: skip
def competing_alternatives(spark, sf_dir):
    """Questions name a part's first supplier, the part itself or nobody; answers are the part, or for those that name it the supplier."""
    edges = fx.supply_edges(spark, sf_dir).select("src", "rel_type", "dst")
    key, part = F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    rows = read_table(spark, sf_dir, "part").select(key.alias("query_id"), part.alias("dst")).join(edges.groupBy("dst").agg(F.min("src").alias("src")), "dst", "left")
    k = F.col("query_id") % 3
    asked = rows.select("query_id", F.when(k == 0, F.col("dst")).when(k == 1, F.col("src")).otherwise("nobody").alias("node")).filter("node IS NOT NULL")
    wanted = rows.select("query_id", F.when(k == 0, F.col("src")).otherwise(F.col("dst")).alias("node"))
    return uncertainty.competing_alternatives(edges, asked, wanted).select("query_id", F.round("competition", 6).alias("competition"))


@query("spectral_metrics")
def spectral_metrics(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    key = F.floor(F.col("vec_id") / 10)
    first = F.first("embedding").over(W.partitionBy(key).orderBy("vec_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return uncertainty.spectral_metrics(rows.select(key.alias("question_id"), F.col("vec_id").alias("sample_id"), "embedding", first.alias("question_embedding")))
