"""Queries on passages, evidence scope and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import passages as fp
from loomgraph.operators import trust
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.plans.statistics import WITH, answered
from loomgraph.sources.tables import read_table


@query("passage_titles", r"""WITH t AS (SELECT doc_id, trim(CASE doc_id % 3 WHEN 0 THEN 'Title: ' || source || chr(10) || text ELSE text END) AS w, doc_id % 3 = 1 AS titled FROM documents)
SELECT doc_id, CASE WHEN lower(w) LIKE 'title:%' THEN nullif(trim(regexp_extract(w, '(?i)^title:([^\n]*)', 1)), '')
 WHEN titled AND contains(w, '. ') AND length(split_part(w, '. ', 1)) BETWEEN 1 AND 160 THEN trim(split_part(w, '. ', 1)) END AS title FROM t""")  # fmt: skip
def passage_titles(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Title: "), "source", F.lit("\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", fp.passage_title(text, F.col("doc_id") % 3 == 1).alias("title"))


@query("scope_keys", "SELECT event_id, CASE WHEN trim(event_type) <> '' THEN event_type || '/' || user_id || '/p' || (event_id % 5) END AS scope_key FROM events")
def scope_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", fp.scope_key(F.col("event_type"), F.col("user_id"), F.col("event_id") % 5).alias("scope_key"))


@query("evidence_scope", """WITH l AS (SELECT l_orderkey, round(1 - 9 * avg(l_discount), 2) AS c, count(*) AS n, count(DISTINCT l_returnflag) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n = 0 THEN 'unknown' WHEN c >= 0.95 THEN 'sentence' WHEN c >= 0.65 THEN 'chunk' WHEN c >= 0.35 THEN CASE WHEN s > 1 THEN 'cross_section' ELSE 'cross_chunk' END WHEN c >= 0.25 THEN 'partial_grounding' ELSE 'unsupported' END AS scope FROM l""")  # fmt: skip
def evidence_scope(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(1 - 9 * F.avg("l_discount"), 2).alias("c"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_returnflag").alias("s"))
    return rows.select("l_orderkey", fp.evidence_scope(F.col("c"), F.col("n"), F.col("s")).alias("scope"))


@query("qualifier_sentences", rf"""WITH s AS (SELECT doc_id, [x FOR x IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF regexp_matches(x, '{fp.QUALIFIER_PATTERN}')] AS l FROM documents)
SELECT doc_id, array_to_string([trim(x) FOR x IN l[greatest(1, len(l) - 3):]], ' ') AS qualifiers FROM s""")
def qualifier_sentences(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", fp.qualifier_sentences(F.col("text")).alias("qualifiers"))


@query("section_headers", rf"""SELECT doc_id, CAST(len([l FOR l IN string_split(text, chr(10)) IF regexp_matches(l, '{fp.HEADING_LINE}')]) AS INTEGER) AS sections FROM documents""")
def section_headers(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(fp.section_headers(F.col("text"))).alias("sections"))


SCORED = """a AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, 'P' || l_partkey AS entity_id, l_quantity / 50 AS cosine, l_returnflag = 'R' AS surface, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 END AS length, 1 + l_orderkey % 2 AS expected FROM lineitem)"""


@query("depth_matched_support", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, entity_id) AS r FROM a WHERE surface OR cosine >= 0.6),
s AS (SELECT query_id, sum(cosine) AS down, sum(coalesce(cosine * power(0.4::DOUBLE, abs(length - expected)), 0)) AS up FROM r WHERE r <= 5 GROUP BY query_id)
SELECT q.query_id, CASE WHEN coalesce(down, 0) > 0 THEN round(1 - up / down, 8) ELSE 0.5 END AS score, CASE WHEN coalesce(down, 0) > 0 THEN NULL ELSE 'no_a_entities' END AS null_reason FROM (SELECT DISTINCT query_id FROM a) q LEFT JOIN s USING (query_id)""")  # fmt: skip
def depth_matched_support(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("entity_id"), (F.col("l_quantity") / 50).alias("cosine"),
        (F.col("l_returnflag") == "R").alias("surface"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 4).alias("length"), (1 + F.col("l_orderkey") % 2).alias("expected"),
    )
    return trust.depth_matched_support(rows).withColumn("score", F.round("score", 8))


@query("calm_wrong_buckets", f"""{WITH}, b AS (SELECT dataset, CASE WHEN NOT wrong THEN 'correct' WHEN u2 >= 0.5 THEN 'wrong_not_silent' WHEN hops % 3 = 0 THEN 'silent_empty_route'
 WHEN hops % 3 = 1 THEN CASE WHEN u1 > 0.5 OR u3 IS NULL OR u3 > 0.5 THEN 'silent_route_unknown_flagged' ELSE 'silent_route_unknown_calm' END
 WHEN u1 > 0.5 THEN 'silent_populated_seu_contradiction' WHEN u3 IS NULL OR u3 > 0.5 THEN 'silent_populated_gps_weak_or_abstained' ELSE 'silent_all_families_calm' END AS bucket FROM answered)
SELECT dataset, bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""")  # fmt: skip
def calm_wrong_buckets(spark, sf_dir):
    route = F.when(F.col("hops") % 3 == 0, "empty").when(F.col("hops") % 3 == 1, "unknown").otherwise("populated")
    weak = F.col("u3").isNull() | (F.col("u3") > 0.5)
    bucket = trust.calm_wrong_bucket(~F.col("wrong"), F.col("u2") < 0.5, route, F.col("u1") > 0.5, weak)
    return answered(spark, sf_dir).groupBy("dataset", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("selfcheck", """WITH p AS (SELECT a.conv_id AS question_id, a.turn AS i, b.turn AS j, (length(a.text) + 2 * length(b.text)) % 3 AS f, (length(b.text) + 2 * length(a.text)) % 3 AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role = 'assistant' AND b.role = 'assistant'),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i, j) AS r FROM p) SELECT question_id, round(sum((f = 0)::INT + (g = 0)::INT) / (2 * count(*)), 6) AS selfcheck FROM r WHERE r <= 50 GROUP BY question_id""")  # fmt: skip
def selfcheck(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    a = turns.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("i"), F.length("text").alias("x"))
    b = turns.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("j"), F.length("text").alias("y"))
    label = lambda n: F.when(n % 3 == 0, "contradiction").otherwise("neutral")
    pairs = a.join(b, "question_id").filter("i < j").select("question_id", "i", "j", label(F.col("x") + 2 * F.col("y")).alias("forward"), label(F.col("y") + 2 * F.col("x")).alias("backward"))
    return trust.selfcheck(pairs).withColumn("selfcheck", F.round("selfcheck", 6))


@query("title_variants", f"""WITH {fx.ENTITIES} SELECT entity_id, array_to_string(list_distinct([replace(lower(name), ' ', '_')]), '|') AS variants FROM entities WHERE regexp_matches(name, '^[A-Za-z0-9 ]+$')""")
def title_variants(spark, sf_dir):
    plain = fx.entities(spark, sf_dir).filter(F.col("name").rlike("^[A-Za-z0-9 ]+$"))
    return plain.select("entity_id", F.array_join(fp.title_variants(F.concat("name", F.lit(" (disambiguation)"))), "|").alias("both")).select("entity_id", F.substring_index("both", "|", -1).alias("variants"))
