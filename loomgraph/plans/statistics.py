"""Queries on selective prediction and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.answers import hop_bucket
from loomgraph.operators import stats
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query

ANSWERED = "answered AS (SELECT *, NOT correct AS wrong FROM eval_rows WHERE NOT failed)"
WITH = f"WITH {fx.EVAL_ROWS}, {ANSWERED}"


def answered(spark, sf_dir):
    return fx.eval_rows(spark, sf_dir).filter(~F.col("failed")).withColumn("wrong", ~F.col("correct"))


@query("auroc", f"""{WITH},
r AS (SELECT dataset, wrong, rank() OVER (PARTITION BY dataset ORDER BY u1) + (count(*) OVER (PARTITION BY dataset, u1) - 1) / 2.0 AS k FROM answered),
g AS (SELECT dataset, count(*) AS n, count(*) FILTER (wrong) AS n1, sum(CASE WHEN wrong THEN k ELSE 0 END) AS s FROM r GROUP BY dataset)
SELECT dataset, CAST(n AS BIGINT) AS n, CASE WHEN n1 > 0 AND n1 < n THEN round((s - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)), 6) END AS auroc FROM g""")  # fmt: skip
def auroc(spark, sf_dir):
    return stats.auroc(answered(spark, sf_dir), ["dataset"], score="u1").select("dataset", "n", F.round("auroc", 6).alias("auroc"))


@query("aurec", f"""{WITH},
r AS (SELECT task_type, avg(wrong::INT) OVER (PARTITION BY task_type ORDER BY u1, question_id ROWS UNBOUNDED PRECEDING) AS e FROM answered)
SELECT task_type, round(avg(e), 6) AS aurec FROM r GROUP BY task_type""")  # fmt: skip
def aurec(spark, sf_dir):
    return stats.aurec(answered(spark, sf_dir), ["task_type"], score="u1").select("task_type", F.round("aurec", 6).alias("aurec"))


@query("ppv_at_k", f"""{WITH},
r AS (SELECT dataset, wrong::INT AS w, row_number() OVER (PARTITION BY dataset ORDER BY u1 DESC, question_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM answered)
SELECT dataset, CASE WHEN count(*) >= 4 THEN round(avg(w) FILTER (r <= greatest(1, ceil(n * 0.1::DOUBLE))), 6) END AS ppv_10,
       CASE WHEN count(*) >= 4 THEN round(avg(w) FILTER (r <= greatest(1, ceil(n * 0.2::DOUBLE))), 6) END AS ppv_20,
       CASE WHEN count(*) >= 4 THEN round(avg(w) FILTER (r <= greatest(1, ceil(n * 0.3::DOUBLE))), 6) END AS ppv_30, round(avg(w), 6) AS base_error
FROM r GROUP BY dataset""")  # fmt: skip
def ppv_at_k(spark, sf_dir):
    out = stats.ppv_at(answered(spark, sf_dir), ["dataset"], [0.1, 0.2, 0.3], score="u1")
    return out.select("dataset", *[F.round(c, 6).alias(c) for c in ("ppv_10", "ppv_20", "ppv_30", "base_error")])


BINS = """s AS (SELECT task_type, wrong, u1, min(u1) OVER w AS lo, max(u1) OVER w AS hi FROM answered WINDOW w AS (PARTITION BY task_type)),
c AS (SELECT task_type, wrong, 1 - (u1 - lo) / (hi - lo) AS conf FROM s WHERE hi - lo >= 1e-12),
b AS (SELECT task_type, CAST(least(floor(round(conf * 10, 9)), 9) AS INTEGER) AS bin, count(*) AS n, avg(conf) AS confidence, avg((NOT wrong)::INT) AS accuracy FROM c GROUP BY ALL)"""


@query("ece", f"""{WITH}, {BINS}
SELECT task_type, CASE WHEN sum(n) >= 4 AND count(*) >= 5 THEN round(sum(n * abs(confidence - accuracy)) / sum(n), 6) END AS ece, CAST(count(*) AS BIGINT) AS filled_bins
FROM b GROUP BY task_type""")  # fmt: skip
def ece(spark, sf_dir):
    return stats.ece(answered(spark, sf_dir), ["task_type"], score="u1").select("task_type", F.round("ece", 6).alias("ece"), "filled_bins")


@query("reliability_bins", f"""{WITH}, {BINS}
SELECT task_type, bin, CAST(n AS BIGINT) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b""")  # fmt: skip
def reliability_bins(spark, sf_dir):
    return stats.calibration_bins(answered(spark, sf_dir), ["task_type"], score="u1").select("task_type", "bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query("null_rates", f"""WITH {fx.EVAL_ROWS}, r AS (SELECT dataset, CASE WHEN u3 IS NULL THEN CASE WHEN failed THEN 'error' ELSE 'no_q_entities' END ELSE 'defined' END AS reason FROM eval_rows),
t AS (SELECT dataset, reason, count(*) AS n FROM r GROUP BY ALL)
SELECT dataset, reason, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY dataset), 6) AS rate FROM t""")  # fmt: skip
def null_rates(spark, sf_dir):
    reason = F.when(F.col("u3").isNotNull(), "defined").when(F.col("failed"), "error").otherwise("no_q_entities")
    counts = fx.eval_rows(spark, sf_dir).groupBy("dataset", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", F.round(F.col("n") / F.sum("n").over(stats.W.partitionBy("dataset")), 6))


@query("hop_stratified_auroc", f"""{WITH},
r AS (SELECT hops, wrong, rank() OVER (PARTITION BY hops ORDER BY u2) + (count(*) OVER (PARTITION BY hops, u2) - 1) / 2.0 AS k
      FROM (SELECT CASE WHEN hops >= 5 THEN '5+-hop' ELSE hops || '-hop' END AS hops, wrong, u2 FROM answered)),
g AS (SELECT hops, count(*) AS n, count(*) FILTER (wrong) AS n1, sum(CASE WHEN wrong THEN k ELSE 0 END) AS s FROM r GROUP BY hops)
SELECT hops, CAST(n AS BIGINT) AS n, CASE WHEN n1 > 0 AND n1 < n THEN round((s - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)), 6) END AS auroc,
       CASE WHEN n1 > 0 AND n1 < n THEN round(2 * (s - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)) - 1, 6) END AS rank_biserial FROM g""")  # fmt: skip
def hop_stratified_auroc(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("hops", hop_bucket(F.col("hops")))
    return stats.auroc(rows, ["hops"], score="u2").select("hops", "n", F.round("auroc", 6).alias("auroc"), F.round(2 * F.col("auroc") - 1, 6).alias("rank_biserial"))


@query("wilson", f"""{WITH}, g AS (SELECT dataset, count(*) AS n, avg(wrong::INT) AS p FROM answered GROUP BY dataset)
SELECT dataset, CAST(n AS BIGINT) AS n, round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS low,
       round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 6) AS high FROM g""")  # fmt: skip
def wilson(spark, sf_dir):
    counts = answered(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wrong").cast("long")).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("dataset", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("silent_rate", f"""{WITH}
SELECT dataset, CAST(count(*) FILTER (wrong) AS BIGINT) AS wrong, round(avg((u2 < 0.3 AND u1 < 0.5)::INT) FILTER (wrong), 6) AS silent_rate,
       round(avg((u2 < 0.1)::INT) FILTER (wrong), 6) AS at_10, round(avg((u2 < 0.2)::INT) FILTER (wrong), 6) AS at_20, round(avg((u2 < 0.4)::INT) FILTER (wrong), 6) AS at_40
FROM answered GROUP BY dataset""")  # fmt: skip
def silent_rate(spark, sf_dir):
    share = lambda held: F.round(F.avg(F.when(F.col("wrong"), held.cast("int"))), 6)
    u = F.col("u2")
    return answered(spark, sf_dir).groupBy("dataset").agg(
        F.sum(F.col("wrong").cast("long")).alias("wrong"), share((u < 0.3) & (F.col("u1") < 0.5)).alias("silent_rate"), share(u < 0.1).alias("at_10"), share(u < 0.2).alias("at_20"), share(u < 0.4).alias("at_40")
    )


@query("selective_risk", f"""{WITH},
r AS (SELECT dataset, wrong::INT AS w, row_number() OVER (PARTITION BY dataset ORDER BY u1, question_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM answered)
SELECT dataset, round(avg(w) FILTER (r <= greatest(1, round_even(n * 0.8::DOUBLE, 0))), 6) AS risk_80, round(avg(w) FILTER (r <= greatest(1, round_even(n * 0.9::DOUBLE, 0))), 6) AS risk_90,
       round(avg(w), 6) AS risk_100 FROM r GROUP BY dataset""")  # fmt: skip
def selective_risk(spark, sf_dir):
    out = stats.selective_risk(answered(spark, sf_dir), ["dataset"], [0.8, 0.9, 1.0], score="u1")
    return out.select("dataset", *[F.round(c, 6).alias(c) for c in ("risk_80", "risk_90", "risk_100")])


@query("percentile_rank", f"""{WITH}
SELECT question_id, coalesce(round((row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY dataset) - 1, 0), 9), 0) AS rank
FROM answered WINDOW w AS (PARTITION BY dataset ORDER BY coalesce(u3, 1.0), question_id)""")  # fmt: skip
def percentile_rank(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("u3", F.coalesce("u3", F.lit(1.0)))
    return stats.percentile_rank(rows, ["dataset"], "u3", "rank").select("question_id", F.round("rank", 9).alias("rank"))


@query("certificate", f"""{WITH}, m AS (SELECT *, median(u1) OVER (PARTITION BY task_type) AS mid FROM answered),
c AS (SELECT task_type, wrong, u1 <= mid AND u2 <= 0.5 AND coalesce(u3, 1.0) <= 0.5 AS ok FROM m)
SELECT task_type, round(avg(ok::INT), 6) AS coverage, round(avg((NOT wrong)::INT) FILTER (ok), 6) AS precision FROM c GROUP BY task_type""")  # fmt: skip
def certificate(spark, sf_dir):
    rows = answered(spark, sf_dir)
    mid = rows.groupBy("task_type").agg(F.percentile("u1", 0.5).alias("mid"))
    ok = (F.col("u1") <= F.col("mid")) & (F.col("u2") <= 0.5) & (F.coalesce("u3", F.lit(1.0)) <= 0.5)
    marked = rows.join(mid, "task_type").withColumn("ok", ok)
    return marked.groupBy("task_type").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(F.col("ok"), (~F.col("wrong")).cast("int"))), 6).alias("precision"))


@query("transition_matrix", f"""WITH {fx.EVAL_ROWS}
SELECT dataset, CASE WHEN failed THEN 'failed' WHEN correct THEN 'correct' ELSE 'wrong' END AS before, CASE WHEN kg_failed THEN 'failed' WHEN kg_correct THEN 'correct' ELSE 'wrong' END AS after,
       CAST(count(*) AS BIGINT) AS n FROM eval_rows GROUP BY ALL""")  # fmt: skip
def transition_matrix(spark, sf_dir):
    state = lambda failed, correct: F.when(F.col(failed), "failed").when(F.col(correct), "correct").otherwise("wrong")
    return fx.eval_rows(spark, sf_dir).groupBy("dataset", state("failed", "correct").alias("before"), state("kg_failed", "kg_correct").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query("mantel_haenszel", f"""{WITH},
t AS (SELECT task_type, dataset, count(*) FILTER (u2 < 0.5 AND wrong)::DOUBLE AS a, count(*) FILTER (u2 < 0.5 AND NOT wrong)::DOUBLE AS b, count(*) FILTER (u2 >= 0.5 AND wrong)::DOUBLE AS c,
             count(*) FILTER (u2 >= 0.5 AND NOT wrong)::DOUBLE AS d, count(*) AS n FROM answered GROUP BY ALL)
SELECT task_type, CASE WHEN sum(b * c / n) > 0 THEN round(sum(a * d / n) / sum(b * c / n), 6) END AS odds_ratio,
       round((sum(a) + 0.5) * (sum(d) + 0.5) / ((sum(b) + 0.5) * (sum(c) + 0.5)), 6) AS haldane_ratio, CAST(count(*) AS BIGINT) AS strata FROM t GROUP BY task_type""")  # fmt: skip
def mantel_haenszel(spark, sf_dir):
    rows = answered(spark, sf_dir).withColumn("sure", F.col("u2") < 0.5)
    return stats.mantel_haenszel(rows, ["task_type"], "dataset", "sure", "wrong").select("task_type", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("haldane_ratio", 6).alias("haldane_ratio"), "strata")


@query("spearman", f"""{WITH},
r AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY u1) + (count(*) OVER (PARTITION BY dataset, u1) - 1) / 2.0 AS x,
             rank() OVER (PARTITION BY dataset ORDER BY u3) + (count(*) OVER (PARTITION BY dataset, u3) - 1) / 2.0 AS y FROM answered WHERE u3 IS NOT NULL)
SELECT dataset, round(corr(x, y), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY dataset""")  # fmt: skip
def spearman(spark, sf_dir):
    return stats.spearman(answered(spark, sf_dir), ["dataset"], "u1", "u3").select("dataset", F.round("rho", 6).alias("rho"), "n")


@query("cohens_kappa", f"""WITH {fx.EVAL_ROWS}, g AS (SELECT dataset, avg(correct::INT) AS a, avg(kg_correct::INT) AS b, avg((correct = kg_correct)::INT) AS o FROM eval_rows GROUP BY dataset)
SELECT dataset, round(o, 6) AS agreement, round(CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN (o - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) ELSE 1 END, 6) + 0.0 AS kappa FROM g""")  # fmt: skip
def cohens_kappa(spark, sf_dir):
    return stats.kappa(fx.eval_rows(spark, sf_dir), ["dataset"], "correct", "kg_correct").select("dataset", F.round("agreement", 6).alias("agreement"), (F.round("kappa", 6) + 0.0).alias("kappa"))


@query("bootstrap_auroc", f"""{WITH},
d AS (SELECT task_type, wrong, u1, 4 * j + k AS draw, (CAST('0x' || substr(md5('42|' || j || '|' || question_id), 8 * k + 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE AS u FROM answered, (SELECT unnest(range(50)) AS j), (SELECT unnest(range(4)) AS k) WHERE u1 IS NOT NULL),
w AS (SELECT *, {" + ".join(f"(u > {step}::DOUBLE)::INT" for step in stats.POISSON)} AS w FROM d),
v AS (SELECT task_type, draw, u1, sum(w) FILTER (wrong) AS one, sum(w) FILTER (NOT wrong) AS zero FROM w GROUP BY task_type, draw, u1),
c AS (SELECT task_type, draw, coalesce(one, 0) AS one, coalesce(zero, 0) AS zero, coalesce(sum(zero) OVER (PARTITION BY task_type, draw ORDER BY u1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v),
a AS (SELECT task_type, draw, CASE WHEN sum(one) > 0 AND sum(zero) > 0 THEN sum(one * (below + zero / 2.0::DOUBLE)) / (sum(one) * sum(zero)) END AS auroc FROM c GROUP BY task_type, draw)
SELECT task_type, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.5), 6) AS median, round(quantile_cont(auroc, 0.975), 6) AS high FROM a GROUP BY task_type""")  # fmt: skip
def bootstrap_auroc(spark, sf_dir):
    out = stats.bootstrap_auroc(answered(spark, sf_dir), ["task_type"], score="u1")
    return out.select("task_type", *[F.round(name, 6).alias(name) for name in ("low", "median", "high")])


@query("auroc_matrix", f"""{WITH},
l AS (UNPIVOT (SELECT dataset, wrong, u1, u2, u3 FROM answered) ON u1, u2, u3 INTO NAME metric VALUE u),
r AS (SELECT dataset, metric, wrong, rank() OVER (PARTITION BY dataset, metric ORDER BY u) + (count(*) OVER (PARTITION BY dataset, metric, u) - 1) / 2.0 AS k FROM l),
g AS (SELECT dataset, metric, count(*) AS n, count(*) FILTER (wrong) AS n1, sum(CASE WHEN wrong THEN k ELSE 0 END) AS s FROM r GROUP BY ALL),
a AS (SELECT dataset, metric, CASE WHEN n1 > 0 AND n1 < n THEN round((s - n1 * (n1 + 1) / 2.0) / (n1 * (n - n1)), 6) END AS auroc FROM g)
SELECT dataset, max(auroc) FILTER (metric = 'u1') AS u1, max(auroc) FILTER (metric = 'u2') AS u2, max(auroc) FILTER (metric = 'u3') AS u3 FROM a GROUP BY dataset""")  # fmt: skip
def auroc_matrix(spark, sf_dir):
    long = answered(spark, sf_dir).unpivot(["dataset", "wrong"], ["u1", "u2", "u3"], "metric", "u")
    return stats.auroc(long, ["dataset", "metric"]).groupBy("dataset").pivot("metric", ["u1", "u2", "u3"]).agg(F.round(F.first("auroc"), 6))
