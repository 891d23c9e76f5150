"""Queries on evidence, anchors, relation windows, fingerprints and typing by an ontology's vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import canonical
from loomgraph.operators import evidence, ontology, windows
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table


@query("evidence_entropy", """WITH t AS (SELECT vec_id // 3 AS q, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY vec_id // 3 ORDER BY vec_id) AS r FROM embeddings WHERE vec_id % 7 > 0),
a AS (SELECT q, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS a FROM t WHERE r = 1), b AS (SELECT q, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS b FROM t WHERE r = 2),
q AS (SELECT vec_id AS q, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings WHERE vec_id % 2 = 0),
m AS (SELECT q.q, e, a, b, list_dot_product(a, b) AS c, CASE WHEN b IS NULL THEN a ELSE [x[1] + x[2] FOR x IN list_zip(a, b)] END AS s FROM q LEFT JOIN a ON a.q = q.q LEFT JOIN b ON b.q = q.q),
u AS (SELECT q, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS n, CASE WHEN b IS NULL THEN 0 ELSE -((1 + c) / 2 * ln((1 + c) / 2) + CASE WHEN 1 - c > 2e-12 THEN (1 - c) / 2 * ln((1 - c) / 2) ELSE 0 END) / ln(2) END AS spread,
  greatest(0, least(1, list_dot_product(s, e) / sqrt(list_dot_product(s, s)))) AS al FROM m)
SELECT q AS query_id, CAST(n AS INTEGER) AS triples, CASE WHEN n = 0 THEN 0 ELSE round(1 - al * (1 - greatest(0, least(1, spread))), 6) END AS uncertainty FROM u""")  # fmt: skip
def evidence_entropy(spark, sf_dir):
    """Over the first two triples of a question, as their eigenvalues can be told in SQL."""
    rows = read_table(spark, sf_dir, "embeddings")
    triples = rows.filter("vec_id % 7 > 0").select(F.floor(F.col("vec_id") / 3).alias("query_id"), F.col("vec_id").alias("triple_id"), "embedding")
    out = evidence.evidence_entropy(triples, rows.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), most=2)
    return out.select("query_id", "triples", F.round("uncertainty", 6).alias("uncertainty"))


STATES = """st AS (SELECT l_orderkey AS question_id, l_linenumber AS sample_id, unnest(['P' || l_partkey % 5, 'S' || l_suppkey % 3]) AS seed FROM lineitem),
dom AS (SELECT question_id, seed AS anchor, count(DISTINCT sample_id) AS states FROM st GROUP BY question_id, seed QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY count(DISTINCT sample_id) DESC, seed) = 1)"""


def states(spark, sf_dir):
    seed = lambda letter, column, k: F.concat(F.lit(letter), (F.col(column) % k).cast("string"))
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("sample_id"), F.array(seed("P", "l_partkey", 5), seed("S", "l_suppkey", 3)).alias("seeds"))


@query("dominant_anchors", f"""WITH {STATES} SELECT question_id, anchor, CAST(states AS BIGINT) AS states FROM dom""")
def dominant_anchors(spark, sf_dir):
    return evidence.dominant_anchors(states(spark, sf_dir))


@query("covering_anchors", f"""WITH {STATES}, s2 AS (SELECT st.* FROM st WHERE NOT EXISTS (SELECT 1 FROM dom JOIN st x ON x.question_id = dom.question_id AND x.seed = dom.anchor WHERE x.question_id = st.question_id AND x.sample_id = st.sample_id)),
d2 AS (SELECT question_id, seed AS anchor, count(DISTINCT sample_id) AS states FROM s2 GROUP BY question_id, seed QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY count(DISTINCT sample_id) DESC, seed) = 1)
SELECT question_id, 1 AS turn, anchor, CAST(states AS BIGINT) AS covered FROM dom UNION ALL SELECT question_id, 2, anchor, CAST(states AS BIGINT) FROM d2""")
def covering_anchors(spark, sf_dir):
    return evidence.covering_anchors(states(spark, sf_dir), 2)


@query("masking_candidates", f"""WITH {STATES} SELECT question_id, anchor, CAST(states AS BIGINT) AS states FROM (SELECT o_orderkey AS question_id, (o_orderkey % 4) / 1e10::DOUBLE AS sd, (o_orderkey % 10) / 10.0::DOUBLE AS seu, o_orderkey % 3 = 0 AS correct, o_orderkey % 11 = 0 AS failed,
CASE o_orderkey % 7 WHEN 0 THEN 'entity_first_empty' WHEN 1 THEN '' ELSE 'entity_first' END AS route FROM orders) r JOIN dom USING (question_id) WHERE NOT failed AND sd <= 2e-10 AND seu >= 0.5 AND NOT correct AND route = 'entity_first'""")
def masking_candidates(spark, sf_dir):
    key = F.col("o_orderkey")
    route = F.when(key % 7 == 0, "entity_first_empty").when(key % 7 == 1, "").otherwise("entity_first")
    runs = read_table(spark, sf_dir, "orders").select(key.alias("question_id"), ((key % 4) / F.lit(1e10)).alias("sd_uq"), ((key % 10) / F.lit(10.0)).alias("seu"), (key % 3 == 0).alias("correct"), (key % 11 == 0).alias("failed"), route.alias("route"))
    return evidence.masking_candidates(runs, states(spark, sf_dir), sd_threshold=2e-10).select("question_id", "anchor", "states")


@query("relation_windows", r"""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS t FROM conversations),
e AS (SELECT DISTINCT conv_id, turn, lower(w) AS id FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\p{L}{4,}')[:3]) AS w FROM conversations)),
w AS (SELECT a.conv_id, a.turn AS start, n.n AS width, list(b.t ORDER BY b.turn) AS ts, list(b.turn * 2 ORDER BY b.turn) AS ps FROM s a, (VALUES (2), (3)) n(n) JOIN s b ON b.conv_id = a.conv_id AND b.turn BETWEEN a.turn AND a.turn + n.n - 1 GROUP BY ALL HAVING count(*) = n.n),
x AS (SELECT conv_id, start, width, array_to_string([t FOR t IN ts IF trim(t) <> ''], chr(10) || chr(10)) AS text, array_to_string(ps, ',') AS positions FROM w),
m AS (SELECT DISTINCT x.conv_id, start, width, id FROM x JOIN e ON e.conv_id = x.conv_id AND e.turn BETWEEN start AND start + width - 1 WHERE regexp_matches(lower(text), '(^|[^a-zA-Z0-9_])' || id || '($|[^a-zA-Z0-9_])'))
SELECT x.conv_id AS scope, x.start, CAST(x.width AS INTEGER) AS width, positions, md5(text) AS text, string_agg(id, ',' ORDER BY encode(id)) AS entities FROM x JOIN m ON m.conv_id = x.conv_id AND m.start = x.start AND m.width = x.width GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def relation_windows(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    segments = rows.select(F.col("conv_id").alias("scope"), F.col("turn").alias("place"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("text"), (2 * F.col("turn")).alias("position"))
    words = F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), F.lit(0)), 1, 3)
    entities = rows.select(F.col("conv_id").alias("scope"), F.col("turn").alias("place"), F.explode(words).alias("w")).select("scope", "place", F.lower("w").alias("entity_id"), F.array("w").alias("names"))
    out = windows.relation_windows(segments, entities)
    return out.select("scope", "start", "width", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), F.md5("text").alias("text"), F.array_join("entities", ",").alias("entities"))


@query("global_places", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id % 5, conv_id, turn) - 1 AS position FROM conversations")
def global_places(spark, sf_dir):
    """Turns are chunks of passages that are ordered by a remainder of the conversation, then by it."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 5).alias("part_of"))
    local = F.row_number().over(windows.W.partitionBy("conv_id").orderBy("turn")) - 1
    return windows.global_places(rows.withColumn("local", local), ["part_of", "conv_id"], "local").select("conv_id", "turn", "position")


def _digest_sql(columns: dict[str, str], source: str) -> str:
    pairs = " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in sorted(columns.items()))
    sums = [f"CAST(coalesce(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)), 0) AS HUGEINT)" for k in range(8)]
    told = " || '|' || ".join(["count(*)", *sums])
    return f"(SELECT sha256({told}) FROM (SELECT sha256('{{' || {pairs} || '}}') AS h FROM {source}))"


@query("content_hash", f"""SELECT sha256('{{"chunkSize":1500,"datasetKgScope":"question","selectionKey":"","usesGlobalCorpus":true}}|' || {_digest_sql({"dataset": "to_json(coalesce(source, ''))", "question_id": "to_json(CAST(doc_id // 10 AS VARCHAR))", "passage_index": "CAST(doc_id % 10 AS VARCHAR)", "text": chr(116) + "o_json(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'))"}, "documents")}) AS content_hash, (SELECT count(*) FROM documents) AS passages""")
def content_hash(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.floor(F.col("doc_id") / 10).alias("question_id"), (F.col("doc_id") % 10).alias("passage_index"), "text")
    return canonical.content_hash(docs, {"usesGlobalCorpus": True, "selectionKey": "first", "datasetKgScope": "question", "chunkSize": 1500})


_TYPES = "(SELECT DISTINCT p_type AS id, upper(p_type) AS label FROM part)"
_RELATIONS = "(SELECT 'R' || r_regionkey AS id, r_name AS label, CASE WHEN r_regionkey > 1 THEN 'Nation' END AS domain, 'Region' AS range FROM region)"


@query("schema_card", f"""SELECT array_to_string(list_sort(list_distinct(list(id))), ',') AS classes, (SELECT string_agg(id, ',' ORDER BY id) FROM {_RELATIONS}) AS relationships, CAST(count(*) AS BIGINT) AS class_count, CAST((SELECT count(*) FROM {_RELATIONS}) AS BIGINT) AS relationship_count,
sha256({_digest_sql({"id": "to_json(id)", "label": "to_json(label)"}, _TYPES)} || '|' || {_digest_sql({"id": "to_json(id)", "label": "to_json(label)", "domain": "coalesce(CAST(to_json(domain) AS VARCHAR), 'null')", "range": "to_json(range)"}, _RELATIONS)}) AS schema_hash FROM {_TYPES}""")
def schema_card(spark, sf_dir):
    types = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("id"), F.upper("p_type").alias("label")).distinct()
    relations = read_table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.when(F.col("r_regionkey") > 1, "Nation").alias("domain"), F.lit("Region").alias("range"))
    return canonical.schema_card(types, relations).withColumns({name: F.array_join(name, ",") for name in ("classes", "relationships")})


def classes(spark, sf_dir):
    """What kinds of parts there are, with vectors by their number, and two more that words and nothing tell."""
    part, vectors = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "embeddings")
    kinds = part.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("id")).distinct().withColumn("number", (F.row_number().over(windows.W.orderBy("id")) - 1).cast("long"))
    more = read_table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Symptom").otherwise("Thing").alias("id"), (1000 + F.col("r_regionkey")).cast("long").alias("number"))
    return kinds.unionByName(more).join(vectors.select(F.col("vec_id").alias("number"), "embedding"), "number", "left").filter("number < 1000 OR id <> ''").select("id", F.initcap("id").alias("label"), "number", F.when(F.col("number") < 1000, F.col("embedding")).alias("embedding"))


def typed_entities(spark, sf_dir):
    part, vectors = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "embeddings")
    k = F.col("p_partkey")
    name = F.when(k % 4 == 1, F.concat("p_brand", F.lit(" of "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))).when(k % 4 == 2, F.concat("p_brand", F.lit(" fever"))).otherwise(F.concat("p_brand", F.lit(" item")))
    rows = part.select(k.alias("number"), name.alias("name"), F.when(k % 4 == 0, k % 9).alias("vec_id"))
    return rows.join(vectors.select("vec_id", "embedding"), "vec_id", "left").select(F.concat(F.lit("P"), F.col("number").cast("string")).alias("entity_id"), "number", "name", "embedding")


@query("classified_entities", """WITH k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS id FROM part)),
e AS (SELECT 'P' || p_partkey AS entity_id, p_partkey % 4 AS m, p_partkey % 9 AS v, p_type, lower(p_brand) AS b FROM part),
near AS (SELECT DISTINCT v, arg_max(k.id, (round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9), -number)) AS id FROM (SELECT DISTINCT v FROM e) e JOIN embeddings x ON x.vec_id = v JOIN k ON TRUE JOIN embeddings y ON y.vec_id = k.number
  WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) >= 0.5 GROUP BY v)
SELECT entity_id, CASE WHEN m = 0 AND near.id IS NOT NULL THEN near.id WHEN m = 1 THEN split_part(p_type, ' ', 1) WHEN m = 2 THEN 'Symptom' ELSE 'Thing' END AS class_id,
CASE WHEN m = 0 AND near.id IS NOT NULL THEN 'vector' WHEN m = 1 THEN 'name' WHEN m = 2 THEN 'word' ELSE 'generic' END AS by FROM e LEFT JOIN near ON near.v = e.v""")  # fmt: skip
def classified_entities(spark, sf_dir):
    return ontology.classified_entities(typed_entities(spark, sf_dir), classes(spark, sf_dir))


@query("classified_relations", """SELECT s_suppkey AS pair_id, CASE s_suppkey % 4 WHEN 0 THEN 'IS_IN' WHEN 1 THEN 'TREATS' WHEN 2 THEN 'DIAGNOSES' ELSE 'RELATED_TO' END AS relation FROM supplier""")
def classified_relations(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    nation = read_table(spark, sf_dir, "nation")
    relations = nation.agg(F.min("n_nationkey")).select(F.explode(F.array(F.struct(F.lit("is-in").alias("id"), F.lit("Is in").alias("label"), F.lit("Supplier").alias("domain"), F.lit("nation").alias("range")), F.struct(F.lit("far").alias("id"), F.lit("zzz").alias("label"), F.lit("Supplier").alias("domain"), F.lit(None).cast("string").alias("range")))).alias("r")).select("r.*")
    pairs = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("pair_id"), F.when(k == 2, F.lit("A Doctor")).when(k == 1, F.concat(F.lit("Drug "), "s_name")).otherwise(F.col("s_name")).alias("source"), F.when(k == 2, "the patient").otherwise("is in").alias("target"),
        F.when(k == 0, "Supplier").otherwise("Other").alias("source_type"), F.lit("Nation").alias("target_type"),
    )
    return ontology.classified_relations(pairs, relations)
