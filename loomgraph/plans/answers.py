"""Queries on answers: scoring functions, accuracy and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import answers as fa
from loomgraph.functions import text as ft
from loomgraph.operators import answers, retrieve
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table

PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
NORM = r"array_to_string([x FOR x IN regexp_split_to_array(regexp_replace(lower(coalesce(COLUMN, '')), 'PUNCT', '', 'g'), '\s+') IF x NOT IN ('', 'a', 'an', 'the')], ' ')".replace("PUNCT", PUNCT)


def norm(column: str) -> str:
    return NORM.replace("COLUMN", column)


ENTITY_KEY = r"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '\s+', ' ', 'g')), '^(the|an|a|and|or) ', ''), '[,()\[\];:.]', '', 'g'), '[\-/]', '_', 'g')), '\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"

PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS gold FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')"""


def answer_pairs(spark, sf_dir):
    """Assistant turns as predictions for the user turn before them."""
    turns = read_table(spark, sf_dir, "conversations")
    a = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    u = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold"))
    return a.join(u, ["conv_id", "turn"])


@query("answer_exact_match", f"""WITH {PAIRS}
SELECT conv_id, turn, {norm('prediction')} AS normalized, ({norm('prediction')} = {norm('gold')})::DOUBLE AS em FROM pairs""")  # fmt: skip
def answer_exact_match(spark, sf_dir):
    return answer_pairs(spark, sf_dir).select("conv_id", "turn", fa.normalize_answer(F.col("prediction")).alias("normalized"), fa.exact_match(F.col("prediction"), F.array("gold")).alias("em"))


@query("answer_token_f1", f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, [x FOR x IN string_split({norm('prediction')}, ' ') IF x <> ''] AS p, [x FOR x IN string_split({norm('gold')}, ' ') IF x <> ''] AS g FROM pairs),
c AS (SELECT conv_id, turn, p, g, coalesce(list_sum([least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))) FOR x IN list_distinct(p)]), 0) AS same FROM t)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(g) = 0 OR array_to_string(p, ' ') IN ('yes', 'no', 'maybe', 'insufficient information') OR array_to_string(g, ' ') IN ('yes', 'no', 'maybe', 'insufficient information')
  THEN (p = g)::INT::DOUBLE ELSE 2.0 * same / (len(p) + len(g)) END, 6) AS f1 FROM c""")  # fmt: skip
def answer_token_f1(spark, sf_dir):
    return answer_pairs(spark, sf_dir).select("conv_id", "turn", F.round(fa.token_f1(F.col("prediction"), F.array("gold")), 6).alias("f1"))


@query("decision_labels", r"""WITH t AS (SELECT conv_id, turn, trim(lower(CASE turn % 4 WHEN 0 THEN 'Yes, ' || text WHEN 1 THEN text || ' The answer is no' WHEN 2 THEN 'maybe' ELSE text END)) AS x FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN regexp_matches(x, '^(yes|true)\b') OR regexp_matches(x, '\b(answer|conclusion|final answer)\s*(is|:)\s*(yes|true)\b') OR x = 'y' THEN 'yes'
 WHEN regexp_matches(x, '^(no|false)\b') OR regexp_matches(x, '\b(answer|conclusion|final answer)\s*(is|:)\s*(no|false)\b') OR x = 'n' THEN 'no'
 WHEN regexp_matches(x, '^(maybe|uncertain)\b') OR regexp_matches(x, '\b(answer|conclusion|final answer)\s*(is|:)\s*(maybe|uncertain)\b') OR x = 'unknown' THEN 'maybe' ELSE '' END AS label FROM t""")  # fmt: skip
def decision_labels(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Yes, "), "text")).when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" The answer is no"))).when(F.col("turn") % 4 == 2, "maybe").otherwise(F.col("text"))
    return turns.select("conv_id", "turn", fa.decision_label(text).alias("label"))


SAYINGS = ["Yes. ", "Thus, no ", "It is unclear whether ", "The two are correlated and not effective, no evidence. ", "This supports it; comparable. ", "It failed to show benefit. ", "Not associated, yet associated. ", ""]


def _counted(patterns) -> str:
    return " + ".join(f"regexp_matches(x, '{pattern}')::INT" for pattern in patterns)


@query("inferred_decisions", rf"""WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(([{", ".join("'" + s + "'" for s in SAYINGS)}])[turn % {len(SAYINGS)} + 1] || text, '\s+', ' ', 'g'))) AS x, conv_id % 2 = 0 AS asked FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, {_counted(fa.AFFIRMING_PATTERNS)} AS y, {_counted(fa.DENYING_PATTERNS)} AS n FROM t)
SELECT conv_id, turn, CASE WHEN regexp_matches(left(x, 220), '^\s*(yes|true)\b') OR regexp_matches(x, '\b(answer|conclusion)\s*(is|:)\s*(yes|true)\b') THEN 'yes' WHEN regexp_matches(left(x, 220), '^\s*(no|false)\b') OR regexp_matches(x, '\b(answer|conclusion)\s*(is|:)\s*(no|false)\b') THEN 'no'
 WHEN regexp_matches(x, '\b(so|therefore|thus|hence|in summary|in conclusion),?\s*(yes|true)\b') THEN 'yes' WHEN regexp_matches(x, '\b(so|therefore|thus|hence|in summary|in conclusion),?\s*(no|false)\b') THEN 'no' WHEN regexp_matches(left(x, 220), '^\s*(maybe|uncertain)\b') THEN 'maybe'
 WHEN {" OR ".join(f"regexp_matches(x, '{pattern}')" for pattern in fa.OPEN_PATTERNS)} THEN 'maybe' WHEN y > n THEN 'yes' WHEN n > y THEN 'no' WHEN asked AND regexp_matches(x, '{fa.TIED_AFFIRMING}') THEN 'yes' WHEN asked AND regexp_matches(x, '{fa.TIED_DENYING}') THEN 'no' ELSE '' END AS decision FROM c""")  # fmt: skip
def inferred_decisions(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    said = F.concat(F.get(F.array(*map(F.lit, SAYINGS)), (F.col("turn") % len(SAYINGS)).cast("int")), F.col("text"))
    asked = F.when(F.col("conv_id") % 2 == 0, "Is it so?").otherwise("Why so?")
    return turns.select("conv_id", "turn", fa.inferred_decision(said, asked).alias("decision"))


@query("word_scored_datasets", "SELECT DISTINCT source AS dataset, FALSE AS scored FROM documents UNION ALL SELECT ' MuSiQue ', TRUE FROM documents WHERE doc_id = 0")
def word_scored_datasets(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    names = docs.select(F.col("source").alias("dataset")).distinct().unionByName(docs.filter("doc_id = 0").select(F.lit(" MuSiQue ").alias("dataset")))
    return names.select("dataset", fa.is_word_scored(F.col("dataset")).alias("scored"))


@query("generation_failures", """WITH t AS (SELECT conv_id, turn, trim(lower(CASE turn % 3 WHEN 0 THEN 'Not enough information. ' || text WHEN 1 THEN 'Insufficient information.' ELSE text END)) AS x FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, x = '' OR contains(x, '429') OR x = 'insufficient information.' OR contains(x, 'not enough information') OR contains(x, 'timed out') AS failed FROM t""")  # fmt: skip
def generation_failures(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Not enough information. "), "text")).when(F.col("turn") % 3 == 1, "Insufficient information.").otherwise(F.col("text"))
    return turns.select("conv_id", "turn", fa.is_generation_failure(text, F.lit("x")).alias("failed"))


@query("support_gate", f"""WITH {fx.EVAL_ROWS}
SELECT question_id, CASE WHEN (u1 < 0.4)::INT + (u2 < 0.5)::INT + coalesce((u3 < 0.4)::INT, 0) >= 2 THEN 'abstain' ELSE 'keep' END AS decision FROM eval_rows""")  # fmt: skip
def support_gate(spark, sf_dir):
    return fx.eval_rows(spark, sf_dir).select("question_id", fa.support_gate(F.col("u1"), F.col("u2"), F.col("u3")).alias("decision"))


@query("normalize_entity_names", f"""WITH {fx.ENTITIES}, l AS (SELECT entity_id, trim(regexp_replace(lower('The ' || name || ', (Ltd.)'), '\\s+', ' ', 'g')) AS x FROM entities),
k AS (SELECT entity_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(x, '^(the|an|a|and|or) ', ''), '[,()\\[\\];:.]', '', 'g'), '[\\-/]', '_', 'g')), '\\s+', '_', 'g'), '_+', '_', 'g') AS x FROM l)
SELECT entity_id, trim(x, '_') AS key FROM k""")  # fmt: skip
def normalize_entity_names(spark, sf_dir):
    return fx.entities(spark, sf_dir).select("entity_id", ft.entity_key(F.concat(F.lit("The "), "name", F.lit(", (Ltd.)"))).alias("key"))


@query("valid_entity_names", r"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM conversations)
SELECT name FROM w WHERE regexp_matches(trim(name), '[A-Za-z0-9]') AND NOT regexp_matches(trim(name), '^[\d\W_]+$') AND (length(trim(name)) >= 3 OR regexp_matches(trim(name), '[\d\-.]'))
AND lower(trim(name)) NOT IN (""" + ", ".join(f"'{word}'" for word in ft.GENERAL_WORDS) + ")")  # fmt: skip
def valid_entity_names(spark, sf_dir):
    words = read_table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("name")).distinct()
    return words.filter(ft.is_entity_name(F.col("name")))


@query("content_tokens", """WITH t AS (SELECT item_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[A-Za-z0-9]+') IF length(x) >= 4 AND x NOT IN ('what', 'with', 'that', 'this', 'from', 'these', 'those', 'into', 'have', 'there', 'their', 'they', 'them', 'which', 'where', 'when', 'would', 'could', 'should', 'does')]) AS ts FROM benchmark),
s AS (SELECT item_id, len(ts) AS tokens, unnest(ts) AS term FROM t), m AS (SELECT item_id, tokens, doc_id, count(*) AS overlap FROM s JOIN documents ON contains(lower(text), term) GROUP BY ALL)
SELECT item_id, CAST(max(tokens) AS INTEGER) AS tokens, CAST(count(*) AS BIGINT) AS documents, CAST(max(overlap) AS BIGINT) AS most, CAST(sum(overlap) AS BIGINT) AS overlaps FROM m GROUP BY item_id""")  # fmt: skip
def content_tokens(spark, sf_dir):
    items = read_table(spark, sf_dir, "benchmark").select("item_id", ft.content_tokens(F.col("text")).alias("ts"))
    asked = items.select("item_id", F.size("ts").alias("tokens"), F.explode("ts").alias("term"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    met = retrieve.term_hits(asked.select("term"), docs).join(asked, "term").groupBy("item_id", "tokens", "chunk_id").agg(F.count(F.lit(1)).alias("overlap"))
    return met.groupBy("item_id").agg(F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("overlap").alias("most"), F.sum("overlap").alias("overlaps"))


OPENINGS = ["who was the author of", "which is older,", "how many people like", "describe", "say"]
ASKED = f"""a AS (SELECT item_id, ({OPENINGS})[item_id % 5 + 1] || ' ' || text || CASE WHEN item_id % 5 = 1 THEN ' or that one' ELSE '' END AS q FROM benchmark), n AS (SELECT item_id, regexp_replace(trim(q), '\\?+$', '') AS t, regexp_replace(trim(lower(q)), '\\?+$', '') AS low FROM a),
b AS (SELECT *, trim(string_split(trim(regexp_extract(t, '(?is)^(.*?)\\bor\\b(.*)$', 1)), ',')[-1]) AS x, trim(regexp_extract(t, '(?is)^(.*?)\\bor\\b(.*)$', 2)) AS y FROM n),
s AS (SELECT *, length(regexp_replace(trim(regexp_replace(x, '(?i)^(which|what|who|where|when|whose|is|are|was|were|has|have|had|does|do|did)\\s+', '')), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')) >= 4 AND length(regexp_replace(y, '^[ ,.;:]+|[ ,.;:]+$', '', 'g')) >= 4 AND contains(lower(t), ' or ') AS sides,
  len([w FOR w IN (string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' '))[2:] IF regexp_matches(w, '^\\p{{Lu}}\\p{{L}}{{2,}}$')]) AS names FROM b)"""
told = lambda terms: " OR ".join(f"contains(low, '{term}')" for term in terms)


@query("question_types", f"""WITH {ASKED}, k AS (SELECT item_id, CASE WHEN regexp_matches(low, '{ft.COMPARISON_PATTERN}') OR sides THEN 'comparison' WHEN regexp_matches(low, '^(who|what|which|where|when|whose)') AND names >= 2 THEN 'bridge'
  WHEN {told(ft.STATISTICAL_TERMS)} THEN 'statistical' WHEN {told(ft.SEMANTIC_TERMS)} THEN 'semantic' ELSE 'generic' END AS kind FROM s)
SELECT item_id, kind, CASE WHEN kind = 'semantic' THEN 0.10::DOUBLE ELSE 0.08::DOUBLE END AS threshold, CASE kind WHEN 'statistical' THEN 200 WHEN 'semantic' THEN 15 ELSE 20 END AS max_chunks FROM k""")  # fmt: skip
def question_types(spark, sf_dir):
    items = read_table(spark, sf_dir, "benchmark")
    asked = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("item_id") % 5 + 1).cast("int")), F.col("text"), F.when(F.col("item_id") % 5 == 1, "or that one"))
    kind = ft.question_type(asked)
    return items.select("item_id", kind.alias("kind"), ft.retrieval_threshold(kind).alias("threshold"), ft.retrieval_limit(kind).alias("max_chunks"))


@query("hash_ids", f"""WITH {fx.ENTITIES} SELECT entity_id, md5(type || ':' || lower(name)) AS content_hash, sha1(entity_id || ':' || name) AS chunk_hash, sha256(entity_id || '::' || name) AS mention_hash FROM entities""")
def hash_ids(spark, sf_dir):
    return fx.entities(spark, sf_dir).select("entity_id", F.md5(F.concat("type", F.lit(":"), F.lower("name"))).alias("content_hash"), F.sha1(F.concat("entity_id", F.lit(":"), "name")).alias("chunk_hash"), F.sha2(F.concat("entity_id", F.lit("::"), "name"), 256).alias("mention_hash"))


@query("uuid5_entity_ids", f"""WITH {fx.ENTITIES}, k AS (SELECT entity_id, name, {ENTITY_KEY} || ':' || type AS key FROM entities), d AS (SELECT entity_id, sha1(from_hex('{ft.OID_NAMESPACE}') || encode(key)) AS d, sha256(entity_id || '||' || name) AS s FROM k)
SELECT entity_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || printf('%02x', (('0x' || substr(d, 17, 2))::INTEGER & 63) | 128) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS uuid, CAST(('0x' || left(s, 16))::UBIGINT AS DECIMAL(20, 0)) AS seed FROM d""")
def uuid5_entity_ids(spark, sf_dir):
    return fx.entities(spark, sf_dir).select("entity_id", ft.uuid5(F.concat(ft.entity_key(F.col("name")), F.lit(":"), "type")).alias("uuid"), ft.stable_seed(F.col("entity_id"), F.col("name")).alias("seed"))


@query("relation_labels", f"""WITH {fx.SUPPLY_EDGES} SELECT edge_id, CASE WHEN negated THEN 'NOT ' ELSE '' END || rel_type || ' [' || condition || ']' || CASE WHEN contains(lower(condition), lower(CAST(position AS VARCHAR))) THEN '' ELSE ' (' || position || ')' END AS label FROM supply_edges""")
def relation_labels(spark, sf_dir):
    return fx.supply_edges(spark, sf_dir).select("edge_id", ft.relation_label(F.col("rel_type"), F.col("negated"), F.col("condition"), F.col("position").cast("string")).alias("label"))


@query("confidence_scores", """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN CAST(o_orderkey % 3 AS VARCHAR) WHEN 2 THEN 'n/a' WHEN 3 THEN 'moderate' ELSE '0.25' END AS x FROM orders)
SELECT o_orderkey, CASE WHEN lower(x) = 'high' THEN 0.8::DOUBLE WHEN lower(x) = 'moderate' THEN 0.55::DOUBLE ELSE coalesce(least(greatest(try_cast(x AS DOUBLE), 0), 1), 0) END AS confidence FROM v""")  # fmt: skip
def confidence_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, "High").when(k % 5 == 1, (k % 3).cast("string")).when(k % 5 == 2, "n/a").when(k % 5 == 3, "moderate").otherwise("0.25")
    return read_table(spark, sf_dir, "orders").select(k, ft.confidence(value).alias("confidence"))


SHARES = "coalesce(round(avg(%s::INT) FILTER (%s), 6), 0)"


@query("accuracy_breakdown", f"""WITH {fx.EVAL_ROWS}
SELECT dataset, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (NOT failed AND NOT kg_failed) AS BIGINT) AS n_shared, {SHARES % ('(correct AND NOT failed)', 'TRUE')} AS raw_1, {SHARES % ('(kg_correct AND NOT kg_failed)', 'TRUE')} AS raw_2,
{SHARES % ('correct', 'NOT failed')} AS clean_1, {SHARES % ('kg_correct', 'NOT kg_failed')} AS clean_2, {SHARES % ('correct', 'NOT failed AND NOT kg_failed')} AS shared_1, {SHARES % ('kg_correct', 'NOT failed AND NOT kg_failed')} AS shared_2 FROM eval_rows GROUP BY dataset""")  # fmt: skip
def accuracy_breakdown(spark, sf_dir):
    out = answers.accuracy_breakdown(fx.eval_rows(spark, sf_dir), ["dataset"])
    return out.select("dataset", "n", "n_shared", *[F.round(c, 6).alias(c) for c in ("raw_1", "raw_2", "clean_1", "clean_2", "shared_1", "shared_2")])


@query("hop_accuracy", f"""WITH {fx.EVAL_ROWS} SELECT CASE WHEN hops >= 5 THEN '5+-hop' ELSE hops || '-hop' END AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(correct::INT), 6) AS accuracy_1, round(avg(kg_correct::INT), 6) AS accuracy_2,
round(avg(coalesce(u3, 0)), 6) AS mean_u3 FROM eval_rows GROUP BY 1""")  # fmt: skip
def hop_accuracy(spark, sf_dir):
    return answers.hop_accuracy(fx.eval_rows(spark, sf_dir)).select("bucket", "n", *[F.round(c, 6).alias(c) for c in ("accuracy_1", "accuracy_2", "mean_u3")])


@query("task_type_accuracy", f"""WITH {fx.EVAL_ROWS} SELECT task_type, CAST(count(*) AS BIGINT) AS n, round(avg(correct::INT), 6) AS accuracy FROM eval_rows GROUP BY task_type""")
def task_type_accuracy(spark, sf_dir):
    return fx.eval_rows(spark, sf_dir).groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


@query("cube_accuracy", f"""WITH {fx.EVAL_ROWS} SELECT dataset, task_type, CAST(count(*) AS BIGINT) AS n, round(avg(correct::INT), 6) AS accuracy FROM eval_rows GROUP BY CUBE (dataset, task_type)""")
def cube_accuracy(spark, sf_dir):
    return fx.eval_rows(spark, sf_dir).cube("dataset", "task_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


RUNS = f"""{fx.EVAL_ROWS}, runs AS (SELECT 'track' || (CAST(substr(dataset, 4) AS INTEGER) % 3) AS track, 'c' || (question_id % 4) AS config, dataset, question_id % 2 AS run, avg(correct::INT) AS accuracy, avg(kg_correct::INT) AS f1, avg(u1) AS em,
       avg((NOT failed)::INT) AS answered, avg((correct AND NOT failed)::INT) AS raw_accuracy FROM eval_rows GROUP BY ALL)"""


def runs(spark, sf_dir):
    rows = fx.eval_rows(spark, sf_dir)
    track = F.concat(F.lit("track"), (F.substring("dataset", 4, 9).cast("int") % 3).cast("string"))
    config = F.concat(F.lit("c"), (F.col("question_id") % 4).cast("string"))
    mean = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(track.alias("track"), config.alias("config"), "dataset", (F.col("question_id") % 2).alias("run")).agg(
        mean(F.col("correct")).alias("accuracy"), mean(F.col("kg_correct")).alias("f1"), mean(F.col("u1")).alias("em"), mean(~F.col("failed")).alias("answered"), mean(F.col("correct") & ~F.col("failed")).alias("raw_accuracy")
    )


@query("track_macro", f"""WITH {RUNS}, f AS (SELECT *, row_number() OVER (PARTITION BY track, config, dataset ORDER BY run) AS r FROM runs)
SELECT track, config, round(sum(coalesce(accuracy, 0)) / count(DISTINCT dataset), 6) AS macro, CAST(count(DISTINCT dataset) AS BIGINT) AS datasets FROM f WHERE r = 1 GROUP BY ALL""")  # fmt: skip
def track_macro(spark, sf_dir):
    return answers.track_macro(runs(spark, sf_dir)).select("track", "config", F.round("macro", 6).alias("macro"), "datasets")


@query("best_config", f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, f1 DESC, em DESC, answered DESC, raw_accuracy DESC, config DESC) AS r FROM runs)
SELECT dataset, config, round(accuracy, 6) AS accuracy FROM r WHERE r = 1""")  # fmt: skip
def best_config(spark, sf_dir):
    return answers.best_config(runs(spark, sf_dir), ["dataset"]).select("dataset", "config", F.round("accuracy", 6).alias("accuracy"))


@query("routing_distribution", f"""WITH {fx.EVAL_ROWS}, c AS (SELECT dataset, CASE hops % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'graph' ELSE 'unknown' END AS route, count(*) AS n FROM eval_rows WHERE NOT failed GROUP BY ALL)
SELECT dataset, route, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS share FROM c""")  # fmt: skip
def routing_distribution(spark, sf_dir):
    route = F.when(F.col("hops") % 3 == 0, "dense").when(F.col("hops") % 3 == 1, "graph").otherwise("unknown")
    out = answers.routing_distribution(fx.eval_rows(spark, sf_dir).withColumn("route", route), ["dataset"])
    return out.withColumn("share", F.round("share", 6))


@query("complementarity", f"""WITH {fx.EVAL_ROWS} SELECT dataset, CASE WHEN correct AND kg_correct THEN 'both' WHEN correct THEN 'first_only' WHEN kg_correct THEN 'second_only' ELSE 'neither' END AS kind, CAST(count(*) AS BIGINT) AS n FROM eval_rows GROUP BY ALL""")
def complementarity(spark, sf_dir):
    return answers.complementarity(fx.eval_rows(spark, sf_dir), ["dataset"])


@query("kg_key_scores", f"""WITH {fx.SUPPLY_EDGES}, p AS (SELECT DISTINCT src, rel_type, dst FROM supply_edges WHERE position % 2 = 0), g AS (SELECT DISTINCT src, rel_type, dst FROM supply_edges WHERE position % 3 <> 1),
c AS (SELECT (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM p JOIN g USING (src, rel_type, dst)) AS tp)
SELECT CAST(tp AS BIGINT) AS tp, CAST(p - tp AS BIGINT) AS fp, CAST(g - tp AS BIGINT) AS fn, round(tp / p, 4) AS precision, round(tp / g, 4) AS recall, round(2 * tp / (p + g), 4) AS f1 FROM c""")  # fmt: skip
def kg_key_scores(spark, sf_dir):
    edges = fx.supply_edges(spark, sf_dir)
    return answers.key_scores(edges.filter("position % 2 = 0"), edges.filter("position % 3 <> 1"), ["src", "rel_type", "dst"])


@query("kg_quality_gate", f"""WITH {fx.MENTIONS}, {fx.SUPPLY_EDGES}, m AS (SELECT question_id % 10 AS kg, count(DISTINCT chunk_id) AS chunks, count(DISTINCT entity_id) AS entities FROM mentions GROUP BY ALL),
r AS (SELECT question_id % 10 AS kg, count(DISTINCT src || '|' || dst) AS relations FROM supply_edges WHERE confidence >= 0.6 GROUP BY ALL),
s AS (SELECT kg, chunks, entities, relations, chunks / chunks < 0.35 AS a, entities / chunks < 0.5 AS b, relations / (entities * (entities - 1)) < 0.018 AS c FROM m JOIN r USING (kg))
SELECT kg, CAST(entities AS BIGINT) AS entities, array_to_string([x FOR x IN [CASE WHEN a THEN 'low_coverage' END, CASE WHEN b THEN 'few_entities' END, CASE WHEN c THEN 'low_density' END] IF x IS NOT NULL], ',') AS reasons, NOT (a OR b OR c) AS passed FROM s""")  # fmt: skip
def kg_quality_gate(spark, sf_dir):
    kg = (F.col("question_id") % 10).alias("kg")
    found = fx.mentions(spark, sf_dir).groupBy(kg).agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("entity_id").alias("entities"))
    relations = fx.supply_edges(spark, sf_dir).filter("confidence >= 0.6").groupBy(kg).agg(F.countDistinct("src", "dst").alias("relations"))
    return answers.quality_gate(found.join(relations, "kg").withColumn("linked_chunks", F.col("chunks"))).select("kg", "entities", "reasons", "passed")
