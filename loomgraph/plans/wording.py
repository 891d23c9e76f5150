"""Queries on the wording of answers, names and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import answers, naming, text, wording
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table

DATASETS = ["pubmedqa", "bioasq", "hotpotqa", "realmedqa", "musique", "other"]
QUESTIONS = ["When was the order placed?", "How many items were sold?", "Which football club was it?", "Is it urgent?", "What is the status?"]


def replies(spark, sf_dir):
    """A reply for each order: (question_id, dataset, task, question, reply)."""
    key, text_of = F.col("o_orderkey"), lambda name: F.col(name).cast("string")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    forms = F.array(
        F.concat(F.lit("Answer: It was placed on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" or in 1999.")),
        F.concat(F.lit("Final answer: about "), text_of("o_custkey"), F.lit(" kg of goods. More follows.")),
        F.lit("Ordino Football Club."),
        F.concat(F.lit("Yes, the order "), text_of("o_orderkey"), F.lit(" is urgent. It was so.")),
        F.concat(F.lit("The answer is "), F.col("o_orderpriority")),
        F.concat(F.lit("Status "), F.col("o_orderstatus"), F.lit(" is the state of order; nothing more: done. Then three. And four. Five.")),
    )
    return read_table(spark, sf_dir, "orders").select(
        key.alias("question_id"),
        pick(DATASETS, key % 6).alias("dataset"),
        F.when(key % 7 == 0, "binary").otherwise("free").alias("task"),
        pick(QUESTIONS, key % 5).alias("question"),
        F.element_at(forms, (F.floor(key / 5) % 6).cast("int") + 1).alias("reply"),
    )


REPLIES = f"""replies AS (SELECT o_orderkey AS question_id, ({DATASETS})[o_orderkey % 6 + 1] AS dataset, CASE WHEN o_orderkey % 7 = 0 THEN 'binary' ELSE 'free' END AS task, ({QUESTIONS})[o_orderkey % 5 + 1] AS question,
  (['Answer: It was placed on ' || strftime(o_orderdate, '%B %-d, %Y') || ' or in 1999.', 'Final answer: about ' || o_custkey || ' kg of goods. More follows.', 'Ordino Football Club.',
    'Yes, the order ' || o_orderkey || ' is urgent. It was so.', 'The answer is ' || o_orderpriority, 'Status ' || o_orderstatus || ' is the state of order; nothing more: done. Then three. And four. Five.'])[(o_orderkey // 5) % 6 + 1] AS reply FROM orders)"""


def _label(column: str, labels: list[str]) -> str:
    names = "|".join(labels)
    return rf"coalesce(nullif(regexp_extract(trim(lower({column})), '^\s*({names})\b', 1), ''), regexp_extract(trim(lower({column})), '\b(?:answer|final answer|conclusion)\s*(?:is|:)\s*({names})\b', 1))"


def _bare(column: str) -> str:
    return rf"regexp_replace(trim({column}), '^[ .]+|[ .]+$', '', 'g')"


def _dates(column: str) -> str:
    best = lambda p: f"nullif({_bare(f"list_sort(list_transform(regexp_extract_all({column}, '(?i){p}'), lambda d, i: {{'n': length(d), 'i': i, 'd': d}}))[-1].d")}, '')"
    return f"CASE WHEN question LIKE 'When %' THEN coalesce({', '.join(map(best, wording.DATE_PATTERNS))}, '') ELSE '' END"


def _words(column: str) -> str:
    return rf"len([w FOR w IN regexp_split_to_array({column}, '\s+') IF w <> ''])"


SHORT = wording.SHORT_LABELS
STRIPPED = rf"""{REPLIES}, m AS (SELECT *, coalesce(nullif(regexp_extract(reply, '(?i)^\s*(?:final answer|answer)\s*[:\-]\s*(.+?)\s*$', 1), ''), regexp_extract(reply, '(?i)^\s*the answer is\s+(.+?)\s*$', 1)) AS inner_ FROM replies),
w AS (SELECT *, CASE WHEN inner_ <> '' THEN {_bare('inner_')} ELSE reply END AS whole FROM m),
s AS (SELECT *, trim(string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1)), chr(1))[1]) AS sentence FROM w),
k AS (SELECT *, trim(regexp_split_to_array(sentence, '\s*[,:;]\s*')[1]) AS clause, regexp_replace(trim(regexp_extract(sentence, '(?i){wording.COPULA_PATTERN}', 1)), '^[ ,.;:]+|[ ,.;:]+$', '', 'g') AS subject,
  {_dates('whole')} AS day, CASE WHEN question LIKE 'How many%' THEN {_bare(f"coalesce(nullif(regexp_extract(whole, '(?i){wording.NUMBER_PATTERN}', 1), ''), regexp_extract(whole, '(?i){wording.NUMBER_WORD_PATTERN}', 0))")} ELSE '' END AS number FROM s),
c AS (SELECT *, CASE WHEN {_words('subject')} BETWEEN 1 AND 8 THEN subject ELSE '' END AS told, CASE WHEN {_words('sentence')} BETWEEN 1 AND 6 THEN {_bare('sentence')} ELSE whole END AS brief FROM k),
n AS (SELECT *, CASE WHEN question LIKE '%club%' AND {_words('brief')} <= 6 AND {_bare("regexp_replace(brief, '(?i)" + chr(92) + "s+(football club|f" + chr(92) + ".c|fc)" + chr(92) + ".?$', '')")} <> '' THEN {_bare("regexp_replace(brief, '(?i)" + chr(92) + "s+(football club|f" + chr(92) + ".c|fc)" + chr(92) + ".?$', '')")} ELSE brief END AS named FROM c)"""


@query("date_and_number_spans", rf"""WITH {STRIPPED} SELECT question_id, day AS date_span, number AS number_span, told AS subject FROM n""")
def date_and_number_spans(spark, sf_dir):
    whole = answers.strip_wrapper(F.col("reply"))
    rows = replies(spark, sf_dir).withColumn("whole", whole).withColumn("sentence", wording.first_sentence(F.col("whole")))
    q = F.col("question")
    return rows.select("question_id", wording.date_span(F.col("whole"), q).alias("date_span"), wording.number_span(F.col("whole"), q).alias("number_span"), wording.subject_before_copula(F.col("sentence")).alias("subject"))


@query("answer_contract", rf"""WITH {STRIPPED} SELECT question_id, CASE
  WHEN dataset = 'pubmedqa' THEN coalesce(nullif({_label('reply', ['yes', 'no', 'maybe'])}, ''), reply)
  WHEN dataset = 'bioasq' AND task = 'binary' THEN coalesce(nullif({_label('reply', ['yes', 'no'])}, ''), reply)
  WHEN task = 'binary' THEN coalesce(nullif({_label('reply', SHORT)}, ''), reply)
  WHEN dataset IN ('hotpotqa', 'musique') THEN coalesce(CASE WHEN question LIKE 'Is %' THEN nullif({_label('whole', SHORT)}, '') END, nullif(day, ''), named)
  WHEN dataset = 'bioasq' THEN coalesce(nullif(day, ''), nullif(number, ''), nullif(told, ''), CASE WHEN {_words('clause')} BETWEEN 1 AND 8 THEN {_bare('clause')} WHEN {_words('sentence')} BETWEEN 1 AND 8 THEN {_bare('sentence')} ELSE whole END)
  WHEN dataset = 'realmedqa' THEN array_to_string([trim(x) FOR x IN string_split(regexp_replace(whole, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))][:3], ' ')
  ELSE whole END AS answer FROM n""")  # fmt: skip
def answer_contract(spark, sf_dir):
    answer = wording.contracted_answer(F.col("dataset"), F.col("task"), F.col("reply"), F.col("question"))
    return replies(spark, sf_dir).select("question_id", answer.alias("answer"))


@query("short_answer_parts", rf"""WITH {STRIPPED} SELECT question_id, whole AS unwrapped, {_label('reply', SHORT)} AS label,
  CASE WHEN length(string_split(regexp_replace(reply, '([.!?])\s+', '\1' || chr(1)), chr(1))[1]) <= 150 THEN string_split(regexp_replace(reply, '([.!?])\s+', '\1' || chr(1)), chr(1))[1] ELSE left(reply, 150) END AS span, regexp_matches(lower(question), '^(is|are|does|do|can|should|was|were|has|have|did) ') AS yes_or_no FROM n""")  # fmt: skip
def short_answer_parts(spark, sf_dir):
    reply = F.col("reply")
    return replies(spark, sf_dir).select(
        "question_id",
        answers.strip_wrapper(reply).alias("unwrapped"),
        answers.leading_label(reply, SHORT).alias("label"),
        answers.primary_span(reply).alias("span"),
        wording.asks_yes_or_no(F.col("question")).alias("yes_or_no"),
    )


@query("guardrail_verdicts", """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"decision": "' || event_type || '"}' WHEN 1 THEN 'So: {"decision": "KEEP", "why": "' || event_type || '"} ok' WHEN 2 THEN 'please retry ' || event_type
  WHEN 3 THEN 'I would keep it' WHEN 4 THEN 'abstain or keep' ELSE event_type END AS raw FROM events)
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'keep' WHEN 2 THEN 'retry' WHEN 3 THEN 'keep' ELSE 'abstain' END AS verdict FROM r""")
def guardrail_verdicts(spark, sf_dir):
    kind = F.col("event_type")
    forms = F.array(
        F.concat(F.lit('{"decision": "'), kind, F.lit('"}')), F.concat(F.lit('So: {"decision": "KEEP", "why": "'), kind, F.lit('"} ok')),
        F.concat(F.lit("please retry "), kind), F.lit("I would keep it"), F.lit("abstain or keep"), kind,
    )
    rows = read_table(spark, sf_dir, "events").select("event_id", F.element_at(forms, (F.col("event_id") % 6).cast("int") + 1).alias("raw"))
    return rows.select("event_id", answers.guardrail_verdict(F.col("raw")).alias("verdict"))


NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("expected_text_matches", f"""WITH r AS (SELECT s_suppkey AS a, p_partkey AS b, {NORM.format("s_name || ' sells ' || p_name || ' of ' || p_brand")} AS h, {NORM.format("CASE WHEN p_partkey % 3 = 0 THEN p_name || ' goods' WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END")} AS n FROM supplier JOIN part ON s_suppkey = p_partkey % 10 + 1),
t AS (SELECT *, string_split(n, ' ') AS ts, string_split(h, ' ') AS hs FROM r), c AS (SELECT *, len([x FOR x IN ts IF list_contains(hs, x)]) / len(ts) AS share FROM t)
SELECT a, b, CASE WHEN contains(' ' || h || ' ', ' ' || n || ' ') THEN true WHEN length(n) <= 3 THEN false WHEN len(ts) >= 4 THEN share >= 0.75 WHEN len(ts) > 1 THEN share >= 0.85 ELSE false END AS found FROM c""")
def expected_text_matches(spark, sf_dir):
    part, supplier = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "supplier")
    rows = supplier.join(part, F.col("s_suppkey") == F.col("p_partkey") % 10 + 1)
    hay = F.concat("s_name", F.lit(" sells "), "p_name", F.lit(" of "), "p_brand")
    needle = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" goods"))).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    return rows.select(F.col("s_suppkey").alias("a"), F.col("p_partkey").alias("b"), answers.token_coverage_match(hay, needle).alias("found"))


@query("normalised_names", f"""WITH {fx.ENTITIES} SELECT entity_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS structural, regexp_replace(regexp_replace(regexp_replace(trim(lower(name)), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS ontology,
  trim(regexp_replace(lower(name), '[_\\s]+', ' ', 'g')) AS view, array_to_string(list_sort(list_distinct([name, lower(name), replace(name, '_', ' '), replace(name, ' ', '_'),
  regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '^(the|an|a|and|or) ', ''), '[,()\\[\\];:.]', '', 'g'), '[\\-/]', '_', 'g')), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')])), '|') AS variants FROM entities""")
def normalised_names(spark, sf_dir):
    name = F.col("name")
    return fx.entities(spark, sf_dir).select(
        "entity_id", text.structural_text(name).alias("structural"), naming.ontology_key(name).alias("ontology"), naming.view_name(name).alias("view"),
        F.array_join(F.array_sort(text.name_variants(name)), "|").alias("variants"),
    )


@query("candidate_names", f"""WITH {fx.ENTITIES}, c AS (SELECT entity_id, [x FOR x IN [entity_id, name, type, name || ' (' || type || ')', lower(name), ' '] IF trim(x) <> ''] AS l FROM entities)
SELECT entity_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], '|') AS names FROM c""")
def candidate_names(spark, sf_dir):
    e = fx.entities(spark, sf_dir)
    names = naming.candidate_names(F.col("entity_id"), F.col("name"), F.array("type", F.concat("name", F.lit(" ("), "type", F.lit(")"))), F.array(F.lower("name"), F.lit(" ")))
    return e.select("entity_id", F.array_join(names, "|").alias("names"))


ALIAS_KEY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), '^(the|an|a|and|or) ', ''), '[,()\[\];:.]', '', 'g'), '[\-/]', '_', 'g'), '[\s_]+', '_', 'g')"


@query("alias_keys", f"""WITH n AS (SELECT p_partkey AS node, p_name || CASE p_size % 4 WHEN 0 THEN ' protein' WHEN 1 THEN ' receptor complex' WHEN 2 THEN ' (' || p_brand || ')' ELSE '' END AS name, p_name AS plain, p_size % 4 AS c FROM part),
t AS (SELECT *, {ALIAS_KEY.format("name")} AS key, {ALIAS_KEY.format("plain")} AS plain_key FROM n), k AS (SELECT *, string_split(key, '_') AS ts, string_split(plain_key, '_') AS ps FROM t),
i AS (SELECT *, array_to_string([left(x, 1) FOR x IN ts], '') AS ti, array_to_string([left(x, 1) FOR x IN ps], '') AS pi FROM k)
SELECT node, array_to_string(list_sort(list_distinct(list_concat(list_concat([key], CASE WHEN len(ts) >= 2 THEN [ti] ELSE [] END),
  CASE c WHEN 0 THEN list_concat([plain_key], CASE WHEN len(ps) >= 2 THEN [pi] ELSE [] END) WHEN 1 THEN list_concat([plain_key, plain_key || '_receptor'], list_concat([pi || 'r'], CASE WHEN len(ps) >= 2 THEN [pi] ELSE [] END)) WHEN 2 THEN [plain_key] ELSE [] END))), '|') AS keys FROM i""")
def alias_keys(spark, sf_dir):
    size = F.col("p_size") % 4
    name = F.concat("p_name", F.when(size == 0, " protein").when(size == 1, " receptor complex").when(size == 2, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise(""))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.array_join(naming.alias_keys(name), "|").alias("keys"))


@query("text_spans", r"""WITH n AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS ts FROM benchmark),
r AS (SELECT item_id, 0 AS i, 0 AS k, array_to_string(ts, ' ') AS s FROM n UNION ALL SELECT item_id, i, k, array_to_string(ts[i:i + k - 1], ' ') FROM (SELECT item_id, ts, i, unnest(range(1, least(8, len(ts) - i + 1) + 1)) AS k FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM n))),
f AS (SELECT item_id, s, min(i * 100 + k) AS place FROM r WHERE length(s) >= 4 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS r FROM f)
SELECT item_id, CAST(count(*) AS BIGINT) AS spans, md5(string_agg(s, '|' ORDER BY len(string_split(s, ' ')) DESC, length(s) DESC, s)) AS digest FROM o WHERE r <= 128 GROUP BY item_id""")
def text_spans(spark, sf_dir):
    rows = read_table(spark, sf_dir, "benchmark").select("item_id", naming.text_spans(F.col("text"), 4).alias("s"))
    return rows.filter(F.size("s") > 0).select("item_id", F.size("s").cast("long").alias("spans"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("entity_match_scores", r"""WITH n AS (SELECT n_nationkey AS node, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS f FROM nation), q AS (SELECT r_regionkey AS query_id, 'from ' || (SELECT string_agg(lower(n_name), ' to ' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0) || ' and xuniteds' AS t FROM region),
c AS (SELECT query_id, node, f, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS t FROM q, n WHERE t IS NOT NULL)
SELECT query_id, node, round(CASE WHEN contains(' ' || t || ' ', ' ' || f || ' ') THEN 5 ELSE 4 END + least(len(string_split(f, ' ')), 8) * 0.2 + least(length(f), 64) / 64.0, 6) AS score FROM c WHERE contains(t, f)""")
def entity_match_scores(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    told = nation.filter("n_nationkey % 2 = 0").groupBy(F.col("n_regionkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("n")))).alias("ns"))
    asked = told.select("query_id", F.concat(F.lit("from "), F.array_join(F.col("ns.n"), " to "), F.lit(" and xuniteds")).alias("t")).withColumn("spans", naming.text_spans(F.col("t"), 3, most=4096))
    pairs = nation.select(F.col("n_nationkey").alias("node"), naming.surface_forms(3, F.array("n_name")).alias("forms")).join(F.broadcast(asked))  # a region's text each: a fixed few
    return pairs.select("query_id", "node", F.round(naming.span_match(F.col("t"), F.col("spans"), F.col("forms")), 6).alias("score")).filter("score > 0")


@query("identities", f"""WITH {fx.SUPPLY_EDGES} SELECT edge_id, src || '-' || rel_type || '-' || dst || '-negated=' || CASE WHEN negated THEN 'True' ELSE 'False' END || '-condition=' || condition || '-quantitative=' AS relation, src || '::' || rel_type || '::' || dst || '::neg=' || CASE WHEN negated THEN 'True' ELSE 'False' END AS state,
  src || '->' || dst AS path, CASE WHEN position % 2 = 0 THEN edge_id ELSE left(src || ' ' || condition, 80) END AS chunk FROM supply_edges""")
def identities(spark, sf_dir):
    none = F.lit(None).cast("string")
    src, kind, dst, negated = (F.col(name) for name in ("src", "rel_type", "dst", "negated"))
    return fx.supply_edges(spark, sf_dir).select(
        "edge_id",
        naming.relation_identity(none, src, kind, dst, negated, F.col("condition"), none).alias("relation"),
        naming.state_relation_id(none, src, kind, dst, negated).alias("state"),
        naming.state_path_id(F.array("src", "dst"), none).alias("path"),
        naming.chunk_identity(F.when(F.col("position") % 2 == 0, F.col("edge_id")), none, F.concat_ws(" ", "src", "condition")).alias("chunk"),
    )


@query("safe_labels", """SELECT p_partkey AS node, CASE WHEN p_size % 9 = 0 THEN 'Concept' WHEN p_size % 9 = 1 THEN 'Concept' ELSE regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') END AS label, regexp_replace(regexp_replace(p_type || '/' || p_name, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM part""")
def safe_labels(spark, sf_dir):
    kind = F.when(F.col("p_size") % 9 == 0, "Chunk").when(F.col("p_size") % 9 == 1, F.concat(F.lit("9 "), "p_type")).otherwise(F.col("p_type"))
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), naming.safe_label(kind).alias("label"), naming.safe_token(F.concat_ws("/", "p_type", "p_name")).alias("token"))


@query("subset_identities", """WITH s AS (SELECT source, lang, string_agg(doc_id, chr(10) ORDER BY doc_id) AS ids, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, lang, coalesce(nullif(regexp_replace(regexp_replace(trim(coalesce(source, '')), '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'default') || '__n' || n || '_seed42_h' || left(sha1(ids), 12) AS subset FROM s""")
def subset_identities(spark, sf_dir):
    sets = read_table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.array_sort(F.collect_list("doc_id")).cast("array<string>").alias("ids"))
    return sets.select("source", "lang", naming.subset_id(F.col("source"), F.col("ids"), F.size("ids"), F.lit(42)).alias("subset"))


@query("view_styles", f"""WITH {fx.SUPPLY_EDGES} SELECT edge_id, CASE WHEN confidence >= 0.8 THEN '#f1c40f' WHEN confidence >= 0.5 THEN '#e67e22' WHEN confidence >= 0.3 THEN '#95a5a6' WHEN confidence IS NOT NULL THEN '#555e68' END AS colour,
  CASE WHEN position > 0 THEN floor(24 * (1 + 2.6 * sqrt(least(1, position / 7))) + 0.5) ELSE 24 END::DOUBLE AS width FROM supply_edges""")
def view_styles(spark, sf_dir):
    return fx.supply_edges(spark, sf_dir).select("edge_id", naming.edge_colour(F.col("confidence")).alias("colour"), naming.node_width(F.col("position"), F.lit(7)).alias("width"))


@query("grounding_quality", r"""WITH q AS (SELECT item_id, list_distinct([t FOR t IN regexp_extract_all(lower(text), '[A-Za-z0-9]+') IF length(t) >= 4 AND t NOT IN ('what', 'which', 'where', 'when', 'whom', 'whose', 'does', 'done', 'have', 'with', 'from', 'that', 'this', 'these', 'those', 'into', 'about', 'after', 'before', 'through', 'there', 'their', 'them', 'they', 'would', 'could', 'should', 'question', 'answer', 'answers', 'company', 'county', 'state', 'city', 'country', 'province', 'league', 'team', 'film', 'band', 'album', 'series', 'season', 'owner', 'located', 'founded', 'born', 'spouse', 'husband', 'wife', 'plays', 'performed', 'performer')]) AS ts FROM benchmark),
n AS (SELECT string_agg(lower(p_name), ' ') AS hay FROM part)
SELECT item_id, CAST(len(ts) AS INTEGER) AS tokens, CAST(len([t FOR t IN ts IF contains(hay, t)]) AS INTEGER) AS matched, round(CASE WHEN len(ts) > 0 THEN least(1, len([t FOR t IN ts IF contains(hay, t)]) / len(ts)) ELSE 0 END, 6) AS quality FROM q, n""")
def grounding_quality(spark, sf_dir):
    """Tokens of items that stand in any part's name."""
    asked = read_table(spark, sf_dir, "benchmark").select("item_id", text.content_tokens(F.col("text")).alias("ts"))
    names = read_table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    spread = asked.select("item_id", F.explode("ts").alias("t"))
    hit = spread.select("t").distinct().join(names, F.contains(F.col("name"), F.col("t")), "left_semi").withColumn("hit", F.lit(1))
    matched = spread.join(hit, "t").groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("matched"))
    rows = asked.join(matched, "item_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return rows.select("item_id", F.size("ts").alias("tokens"), "matched", F.round(text.grounding_quality(F.col("ts"), F.col("matched")), 6).alias("quality"))
