"""Answer scoring and run-level aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.answers import hop_bucket


def _share(hit: Column, among: Column) -> Column:
    """The share of hits among rows; 0 where there are none."""
    return F.coalesce(F.avg(F.when(among, hit.cast("double"))), F.lit(0.0))


def accuracy_breakdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy of two systems over all rows, over those each answered, and over those both answered."""
    one, two = ~F.col("failed"), ~F.col("kg_failed")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((one & two).cast("long")).alias("n_shared"),
        _share(F.col("correct") & one, F.lit(True)).alias("raw_1"),
        _share(F.col("kg_correct") & two, F.lit(True)).alias("raw_2"),
        _share(F.col("correct"), one).alias("clean_1"),
        _share(F.col("kg_correct"), two).alias("clean_2"),
        _share(F.col("correct"), one & two).alias("shared_1"),
        _share(F.col("kg_correct"), one & two).alias("shared_2"),
    )


def hop_accuracy(rows: DataFrame) -> DataFrame:
    """Rows, accuracy of both systems and mean uncertainty by hop bucket; unknown hops are left out, null metrics count as 0."""
    bucketed = rows.withColumn("bucket", hop_bucket(F.col("hops"))).filter(F.col("bucket").isNotNull())
    return bucketed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy_1"),
        F.avg(F.col("kg_correct").cast("double")).alias("accuracy_2"),
        F.avg(F.coalesce("u3", F.lit(0.0))).alias("mean_u3"),
    )


def track_macro(runs: DataFrame) -> DataFrame:
    """Mean accuracy over a track's datasets, by config: the first run of each dataset, missing values as 0."""
    first = runs.withColumn("_r", F.row_number().over(W.partitionBy("track", "config", "dataset").orderBy("run"))).filter("_r = 1")
    return first.groupBy("track", "config").agg((F.sum(F.coalesce("accuracy", F.lit(0.0))) / F.countDistinct("dataset")).alias("macro"), F.countDistinct("dataset").alias("datasets"))


def best_config(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The config of greatest accuracy, then f1, em, answered, raw accuracy, then name."""
    order = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in ("accuracy", "f1", "em", "answered", "raw_accuracy")], F.col("config"))
    return runs.groupBy(*keys).agg(F.max(order).alias("b")).select(*keys, F.col("b.config").alias("config"), F.col("b.accuracy").alias("accuracy"))


def routing_distribution(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Number and share of each route among answers that didn't fail."""
    counts = routes.filter(~F.col("failed")).groupBy(*keys, "route").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def quality_gate(stats: DataFrame, coverage: float = 0.35, per_chunk: float = 0.5, density: float = 0.018) -> DataFrame:
    """Why a graph isn't good enough: low chunk coverage, few entities a chunk, few relations an entity pair."""
    low = [
        F.when(F.col("linked_chunks") / F.col("chunks") < coverage, "low_coverage"),
        F.when(F.col("entities") / F.col("chunks") < per_chunk, "few_entities"),
        F.when(F.col("relations") / (F.col("entities") * (F.col("entities") - 1)) < density, "low_density"),
    ]
    reasons = F.filter(F.array(*low), lambda reason: reason.isNotNull())
    return stats.withColumn("reasons", F.array_join(reasons, ",")).withColumn("passed", F.size(reasons) == 0)


def key_scores(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of distinct keys, to four digits."""
    one, two = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)), gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p, g = F.sum("_p"), F.sum("_g")
    tp = F.sum(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0))
    ratio = lambda up, down: F.when(down > 0, F.round(up / down, 4)).otherwise(0.0)
    counts = one.join(two, keys, "full").agg(tp.alias("tp"), F.coalesce(p, F.lit(0)).alias("p"), F.coalesce(g, F.lit(0)).alias("g"))
    return counts.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("g")).alias("recall"), ratio(2 * F.col("tp"), F.col("p") + F.col("g")).alias("f1"))


def complementarity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many questions both systems, one or neither answered right."""
    kind = F.when(F.col("correct") & F.col("kg_correct"), "both").when(F.col("correct"), "first_only").when(F.col("kg_correct"), "second_only").otherwise("neither")
    return rows.groupBy(*keys, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
