"""Trust in answers: depth-matched path support and what wrong but calm answers have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def depth_matched_support(answers: DataFrame, least: float = 0.6, decay: float = 0.4, most: int = 5) -> DataFrame:
    """(query_id, score, null_reason): 1 - weighted share of answer entities at the expected depth.

    Entities have (query_id, entity_id, cosine, surface, length, expected).
    Those named outright or with a cosine of ``least`` count, ``most`` of them
    at most, in the order of their rank. One at a length off by d weighs
    decay ** d, one that isn't reached nothing. Without weight the score is .5
    with a reason.
    """
    ranked = answers.filter(F.col("surface") | (F.col("cosine") >= least)).withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "entity_id"))).filter(F.col("_r") <= most)
    reached = F.col("cosine") * F.pow(F.lit(decay), F.abs(F.col("length") - F.col("expected")))
    sums = ranked.groupBy("query_id").agg(F.sum("cosine").alias("down"), F.sum(F.coalesce(reached, F.lit(0.0))).alias("up"))
    all_ = answers.select("query_id").distinct().join(sums, "query_id", "left")
    fine = F.coalesce(F.col("down"), F.lit(0.0)) > 0
    return all_.select("query_id", F.when(fine, 1 - F.col("up") / F.col("down")).otherwise(0.5).alias("score"), F.when(~fine, "no_a_entities").alias("null_reason"))


def calm_wrong_bucket(correct: Column, silent: Column, route: Column, contradiction: Column, weak_path: Column) -> Column:
    """Where a wrong answer that no output metric marks was still visible: an empty route, contradicted evidence, weak paths, or nowhere."""
    return (
        F.when(correct, "correct").when(~silent, "wrong_not_silent").when(route == "empty", "silent_empty_route")
        .when(route == "unknown", F.when(contradiction | weak_path, "silent_route_unknown_flagged").otherwise("silent_route_unknown_calm"))
        .when(contradiction, "silent_populated_seu_contradiction").when(weak_path, "silent_populated_gps_weak_or_abstained").otherwise("silent_all_families_calm")
    )


def selfcheck(labels: DataFrame, most: int = 50) -> DataFrame:
    """Share of contradictions over both orders of the first pairs of samples; rows are (question_id, i, j, forward, backward) with i < j."""
    first = labels.withColumn("_r", F.row_number().over(W.partitionBy("question_id").orderBy("i", "j"))).filter(F.col("_r") <= most)
    hits = F.sum((F.col("forward") == "contradiction").cast("int") + (F.col("backward") == "contradiction").cast("int"))
    return first.groupBy("question_id").agg((hits / (2 * F.count(F.lit(1)))).alias("selfcheck"))


def graph_context_holds(grounding: Column, has_structure: Column, has_chunks: Column, weak: float = 0.5) -> Column:
    """Whether a graph context is strong enough to stay primary, for questions that compare nothing."""
    return has_chunks & (has_structure | (F.coalesce(grounding, F.lit(0.0)) >= weak))
