"""Queries on reports over evaluated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import audit, stats
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table

JUDGED = f"""{fx.EVAL_ROWS}, j AS (SELECT question_id, dataset, task_type, correct, CASE WHEN question_id % 4 = 0 THEN 0.0 WHEN question_id % 4 = 1 THEN 0.5004 ELSE u1 END::DOUBLE AS entropy, CASE WHEN question_id % 3 = 0 THEN 0.0 ELSE u2 END::DOUBLE AS spread, u2 AS seu, u3 AS gps FROM eval_rows)"""


def judged(spark, sf_dir):
    q = F.col("question_id")
    entropy = F.when(q % 4 == 0, 0.0).when(q % 4 == 1, 0.5004).otherwise(F.col("u1"))
    return fx.eval_rows(spark, sf_dir).select("question_id", "dataset", "task_type", "correct", entropy.alias("entropy"), F.when(q % 3 == 0, 0.0).otherwise(F.col("u2")).alias("spread"), F.col("u2").alias("seu"), F.col("u3").alias("gps"))


@query("clean_headline", f"""WITH {fx.EVAL_ROWS}, a AS (SELECT dataset, round(avg(correct::INT), 6) AS r1, round(avg(kg_correct::INT), 6) AS r2, round(avg(correct::INT) FILTER (NOT failed), 6) AS c1, round(avg(kg_correct::INT) FILTER (NOT kg_failed), 6) AS c2 FROM eval_rows GROUP BY dataset)
SELECT dataset, CASE WHEN coalesce(c1, 0) <> 0 THEN c1 ELSE r1 END AS accuracy_1, CASE WHEN coalesce(c2, 0) <> 0 THEN c2 ELSE r2 END AS accuracy_2, r1 AS raw_1, r2 AS raw_2 FROM a""")
def clean_headline(spark, sf_dir):
    mean = lambda c, among=None: F.round(F.avg(F.col(c).cast("int") if among is None else F.when(~F.col(among), F.col(c).cast("int"))), 6)
    runs = fx.eval_rows(spark, sf_dir).groupBy("dataset").agg(mean("correct").alias("accuracy_1"), mean("kg_correct").alias("accuracy_2"), mean("correct", "failed").alias("clean_1"), mean("kg_correct", "kg_failed").alias("clean_2"))
    return audit.clean_headline(runs)


@query("metric_averages", f"""WITH {fx.EVAL_ROWS}, s AS (SELECT dataset, 'u1' AS metric, u1 AS v FROM eval_rows UNION ALL SELECT dataset, 'u2', u2 FROM eval_rows UNION ALL SELECT dataset, 'u3', u3 FROM eval_rows)
SELECT dataset, metric, round(coalesce(avg(v), 0.5), 6) AS mean, CAST(count(v) AS BIGINT) AS n FROM s GROUP BY ALL""")
def metric_averages(spark, sf_dir):
    return audit.metric_averages(fx.eval_rows(spark, sf_dir), ["dataset"], ["u1", "u2", "u3"], 0.5).withColumn("mean", F.round("mean", 6))


@query("config_means", f"""WITH {fx.EVAL_ROWS}, m AS (SELECT task_type, dataset, avg(u3) AS m FROM eval_rows GROUP BY ALL) SELECT task_type, round(avg(m), 6) AS mean, CAST(count(m) AS BIGINT) AS groups FROM m WHERE m IS NOT NULL GROUP BY task_type""")
def config_means(spark, sf_dir):
    return audit.mean_of_means(fx.eval_rows(spark, sf_dir), ["task_type"], "dataset", "u3").withColumn("mean", F.round("mean", 6))


CALM = "(abs(entropy) < 1e-9 AND spread <= 1e-9)"


@query("calm_ladder", f"""WITH {JUDGED} SELECT dataset, CAST(count(*) AS BIGINT) AS n_wrong, round(avg({CALM}::INT), 6) AS strict, round(avg((abs(entropy) < 1e-9)::INT), 6) AS unanimous, round(avg((entropy <= 0.51)::INT), 6) AS near FROM j WHERE NOT correct GROUP BY dataset""")
def calm_ladder(spark, sf_dir):
    out = audit.calm_ladder(judged(spark, sf_dir), ["dataset"])
    return out.select("dataset", "n_wrong", *[F.round(c, 6).alias(c) for c in ("strict", "unanimous", "near")])


@query("prevalence", f"""WITH {JUDGED}, m AS (SELECT task_type, dataset, median(spread) AS med FROM j GROUP BY ALL), k AS (SELECT j.*, {CALM} AS calm, coalesce(seu > 0.5, false) OR coalesce(gps > 0.5, true) AS flagged, coalesce(spread <= med AND seu <= 0.5, false) AND coalesce(gps <= 0.5, false) AS cert FROM j JOIN m USING (task_type, dataset))
SELECT task_type, CAST(count(*) AS BIGINT) AS answered, CAST(count(*) FILTER (NOT correct) AS BIGINT) AS wrong, CAST(count(*) FILTER (NOT correct AND calm) AS BIGINT) AS calm_wrong, round(avg(calm::INT) FILTER (NOT correct), 6) AS calm_share,
round(avg(flagged::INT) FILTER (NOT correct AND calm), 6) AS flagged_share, round(avg((NOT calm)::INT) FILTER (NOT correct), 6) AS noisy_share, round(avg(cert::INT) FILTER (correct), 6) AS certified_share FROM k GROUP BY task_type""")
def prevalence(spark, sf_dir):
    out = audit.prevalence(judged(spark, sf_dir), ["task_type"], ["dataset"])
    return out.select("task_type", "answered", "wrong", "calm_wrong", *[F.round(c, 6).alias(c) for c in ("calm_share", "flagged_share", "noisy_share", "certified_share")])


@query("rank_biserial", f"""WITH {fx.EVAL_ROWS}, p AS (SELECT dataset, avg(CASE WHEN w.u1 > r.u1 THEN 1 WHEN w.u1 = r.u1 THEN 0.5 ELSE 0 END) AS a FROM eval_rows w JOIN eval_rows r USING (dataset) WHERE NOT w.correct AND r.correct GROUP BY dataset)
SELECT dataset, round(2 * a - 1, 6) AS rank_biserial FROM (SELECT DISTINCT dataset FROM eval_rows) LEFT JOIN p USING (dataset)""")
def rank_biserial(spark, sf_dir):
    rows = fx.eval_rows(spark, sf_dir).withColumn("wrong", ~F.col("correct")).withColumn("u", F.col("u1"))
    return stats.auroc(rows, ["dataset"]).select("dataset", F.round(audit.rank_biserial(F.col("auroc")), 6).alias("rank_biserial"))


@query("answered_counts", f"""WITH {fx.EVAL_ROWS} SELECT dataset, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT failed) AS BIGINT) AS answered, CAST(count(*) FILTER (failed) AS BIGINT) AS failures, round(avg(failed::INT), 6) AS failure_rate,
round((count(*) FILTER (failed) + 0.5) * (count(*) FILTER (NOT kg_failed) + 0.5) / ((count(*) FILTER (NOT failed) + 0.5) * (count(*) FILTER (kg_failed) + 0.5)), 6)::DOUBLE AS odds_ratio FROM eval_rows GROUP BY dataset""")
def answered_counts(spark, sf_dir):
    rows = fx.eval_rows(spark, sf_dir)
    out = audit.answered_counts(rows, ["dataset"]).join(audit.failure_odds(rows, ["dataset"]), "dataset")
    return out.withColumn("failure_rate", F.round("failure_rate", 6)).withColumn("odds_ratio", F.round(F.col("odds_ratio").cast("double"), 6))


@query("hopwise_wrong", f"""WITH {fx.EVAL_ROWS}, h AS (SELECT hops, count(*) AS n, avg(correct::INT) AS a, count(*) FILTER (NOT correct) AS w FROM eval_rows GROUP BY hops) SELECT hops, CAST(n AS BIGINT) AS n, round(a, 6) AS accuracy, CAST(w AS BIGINT) AS n_wrong FROM h""")
def hopwise_wrong(spark, sf_dir):
    rows = fx.eval_rows(spark, sf_dir).groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    return audit.hopwise_wrong(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("overlap_stability", f"""WITH {fx.GRAPH_STATES}, s AS (SELECT user_id, day, list(event_type) AS x FROM graph_states GROUP BY ALL), p AS (SELECT a.user_id, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) AS j FROM s a JOIN s b ON a.user_id = b.user_id AND a.day < b.day)
SELECT user_id, CAST(count(*) AS BIGINT) AS pairs, round(avg(j), 6) AS mean, round(median(j), 6) AS median FROM p GROUP BY user_id""")
def overlap_stability(spark, sf_dir):
    sets = fx.graph_states(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set("event_type").alias("x"))
    pairs = sets.alias("a").join(sets.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.day") < F.col("b.day")))  # a user has a day each of a bounded period
    share = F.size(F.array_intersect("a.x", "b.x")) / F.size(F.array_union("a.x", "b.x"))
    out = audit.overlap_stability(pairs.select(F.col("a.user_id").alias("user_id"), share.alias("jaccard")), ["user_id"])
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query("fact_audit", f"""WITH {fx.EVAL_ROWS}, f AS (SELECT doc_id AS question_id, k, (doc_id + k) % 3 > 0 AS g, (doc_id * k) % 60 AS rank, (doc_id + k) % 2 = 0 AS w FROM documents, (SELECT unnest(range(1, 4)) AS k) WHERE doc_id % 9 > 0),
o AS (SELECT question_id, avg(g::INT) AS g, avg((rank <= 40)::INT) AS r, avg(w::INT) AS w FROM f GROUP BY question_id), c AS (SELECT question_id, CASE WHEN correct AND kg_correct THEN 'both_correct' WHEN correct THEN 'vanilla_only' WHEN kg_correct THEN 'kg_only' ELSE 'neither' END AS kind FROM eval_rows)
SELECT kind, CAST(count(*) AS BIGINT) AS n, round(avg(g), 6) AS in_graph, round(avg(r), 6) AS retrieved, round(avg(w), 6) AS reachable, round(avg(coalesce(r >= 1, false)::INT), 6) AS all_retrieved FROM c LEFT JOIN o USING (question_id) GROUP BY kind""")
def fact_audit(spark, sf_dir):
    q, k = F.col("question_id"), F.col("k")
    facts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id")).filter(q % 9 > 0).select("question_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))  # some questions have no facts
    facts = facts.select("question_id", ((q + k) % 3 > 0).alias("in_graph"), ((q * k) % 60).alias("rank"), ((q + k) % 2 == 0).alias("reachable"))
    classes = fx.eval_rows(spark, sf_dir).select("question_id", audit.correctness_class(F.col("correct"), F.col("kg_correct")).alias("kind"))
    return audit.fact_audit(facts, classes).select("kind", "n", *[F.round(c, 6).alias(c) for c in ("in_graph", "retrieved", "reachable", "all_retrieved")])


@query("config_grid", """SELECT t AS threshold, k, 't' AS variant, 'threshold=' || t || ',k=' || k || ',variant=t' AS name FROM (SELECT unnest(['0.08', '0.2', '0.3']) AS t), (SELECT unnest([5::BIGINT, 10, 20]) AS k)""")
def config_grid(spark, sf_dir):
    return audit.config_grid(spark, threshold=["0.08", "0.2", "0.3"], k=[5, 10, 20], variant=["t"])


@query("seeded_subset", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS d FROM documents) SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS place FROM r WHERE d <= 5""")
def seeded_subset(spark, sf_dir):
    return audit.seeded_subset(read_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 5, 42)


@query("support_grid", """WITH a AS (SELECT l_orderkey AS question_id, l_quantity / 50 AS cosine, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 4 END AS length FROM lineitem), g AS (SELECT t AS tau, y AS gamma FROM (SELECT unnest([0.4, 0.6, 0.8]::DOUBLE[]) AS t), (SELECT unnest([0.4, 0.7]::DOUBLE[]) AS y)),
s AS (SELECT tau, gamma, question_id, sum(coalesce(cosine * power(gamma, length - 1), 0)) FILTER (cosine >= tau) AS up, sum(cosine) FILTER (cosine >= tau) AS down FROM a, g GROUP BY ALL)
SELECT tau, gamma, question_id, round(CASE WHEN down > 0 THEN 1 - up / down END, 9) AS score FROM s""")
def support_grid(spark, sf_dir):
    answers = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_quantity") / 50).alias("cosine"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 4).alias("length"))
    return audit.support_grid(answers, audit.config_grid(spark, tau=[0.4, 0.6, 0.8], gamma=[0.4, 0.7]).drop("name")).withColumn("score", F.round("score", 9))


TOLD = """t AS (SELECT r_regionkey AS text_id, (SELECT trim(regexp_replace(string_agg(lower(n_name), ' to ' ORDER BY n_nationkey), '[^a-z0-9]+', ' ', 'g')) FROM nation WHERE n_regionkey = r_regionkey) AS text FROM region), n AS (SELECT n_nationkey AS entity_id, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS f FROM nation WHERE length(n_name) >= 4),
s AS (SELECT text_id, entity_id, f, 5 + least(len(string_split(f, ' ')), 8) * 0.2 + least(length(f), 64) / 64.0 AS score FROM t, n WHERE contains(' ' || text || ' ', ' ' || f || ' ')), k AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, length(f) DESC, entity_id) AS rank FROM s)"""


def told(spark, sf_dir):
    nation = read_table(spark, sf_dir, "nation")
    texts = nation.groupBy(F.col("n_regionkey").alias("text_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("n")))), lambda s: s["n"]), " to ").alias("text"))
    return texts, nation.select(F.col("n_nationkey").alias("entity_id"), F.array("n_name").alias("names"))


@query("text_entities", f"""WITH {TOLD} SELECT text_id, entity_id, round(score, 6)::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def text_entities(spark, sf_dir):
    return audit.text_entities(*told(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("answer_sources", f"""WITH {fx.MENTIONS}, q AS (SELECT DISTINCT question_id, entity_id FROM mentions WHERE position = 1 AND entity_id LIKE 'S%' AND question_id % 5 > 0), a AS (SELECT DISTINCT question_id, entity_id FROM mentions WHERE position <= 2 AND entity_id LIKE 'S%' AND question_id % 7 > 0),
l AS (SELECT question_id, list(entity_id) AS q FROM q GROUP BY question_id), o AS (SELECT DISTINCT o_orderkey AS question_id FROM orders), j AS (SELECT o.question_id, a.entity_id, l.q, [x FOR x IN list_sort(l.q) IF x <> a.entity_id] AS s FROM o LEFT JOIN l USING (question_id) LEFT JOIN a USING (question_id)),
m AS (SELECT *, max((len(s) > 0)::INT) OVER (PARTITION BY question_id) AS u FROM j), r AS (SELECT *, CASE WHEN q IS NULL THEN 'no_q_entities' WHEN entity_id IS NULL THEN 'no_a_entities' WHEN coalesce(u, 0) = 0 THEN 'trivial_overlap' END AS reason FROM m)
SELECT question_id, entity_id, array_to_string(s, ',') AS sources, reason AS null_reason FROM r WHERE entity_id IS NOT NULL AND q IS NOT NULL AND len(s) > 0 UNION ALL SELECT DISTINCT question_id, NULL, NULL, reason FROM r WHERE reason IS NOT NULL""")
def answer_sources(spark, sf_dir):
    suppliers = fx.mentions(spark, sf_dir).filter(F.col("entity_id").startswith("S"))
    asked = suppliers.filter("position = 1 AND question_id % 5 > 0").select("question_id", "entity_id").distinct()
    answered = suppliers.filter("position <= 2 AND question_id % 7 > 0").select("question_id", "entity_id").distinct()
    out = audit.answer_sources(asked, answered, read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id")))
    return out.select("question_id", "entity_id", F.array_join("sources", ",").alias("sources"), "null_reason")
