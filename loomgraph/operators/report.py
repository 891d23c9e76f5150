"""Reports on graphs and runs: components, degrees, claims, qualifiers, evidence use, stability."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import relation_label
from loomgraph.operators.graph import degrees


def degree_buckets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by type and degree: 0, 1, 2-4, 5-9, 10+; with the greatest degree of each."""
    counted = nodes.join(degrees(edges).select(F.col("node").alias("entity_id"), "degree"), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    d = F.col("degree")
    bucket = F.when(d == 0, "0").when(d == 1, "1").when(d < 5, "2-4").when(d < 10, "5-9").otherwise("10+")
    return counted.groupBy("type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("degree").alias("most"))


def component_summaries(components: DataFrame, nodes: DataFrame, edges: DataFrame, shown: int = 6) -> DataFrame:
    """(component, entities, relations, top): sizes, and the entities of greatest degree, ties by name."""
    degree = degrees(edges).select("node", "degree")
    named = components.join(nodes.select(F.col("entity_id").alias("node"), "name"), "node").join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = named.withColumn("_r", F.row_number().over(W.partitionBy("component").orderBy(F.desc("degree"), "name", "node")))
    top = F.array_sort(F.collect_list(F.when(F.col("_r") <= shown, F.struct("_r", "name"))))
    links = edges.join(components.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("relations"))
    sized = ranked.groupBy("component").agg(F.count(F.lit(1)).alias("entities"), F.array_join(F.transform(top, lambda s: s["name"]), "; ").alias("top"))
    return sized.join(links, "component", "left").select("component", "entities", F.coalesce("relations", F.lit(0)).alias("relations"), "top")


def claims(edges: DataFrame) -> DataFrame:
    """(claim_id, claim): each edge as a sentence, and a hash of it."""
    label = relation_label(F.lower(F.regexp_replace("rel_type", "_", " ")), F.lit(False), F.col("condition"), F.lit(None).cast("string"))
    text = F.concat_ws(" ", F.col("src"), F.when(F.col("negated"), F.lit("does not")), label, F.col("dst"))
    return edges.select("edge_id", text.alias("claim")).withColumn("claim_id", F.sha1("claim"))


def qualifiers(edges: DataFrame) -> DataFrame:
    """One row for each qualifier that an edge has: (edge_id, kind, value, qualifier_id)."""
    pairs = F.array(F.struct(F.lit("condition").alias("kind"), F.col("condition").alias("value")), F.struct(F.lit("position").alias("kind"), F.col("position").cast("string").alias("value")))
    spread = edges.select("edge_id", F.explode(pairs).alias("q")).select("edge_id", "q.kind", "q.value").filter(F.length(F.trim("value")) > 0)
    return spread.withColumn("qualifier_id", F.sha1(F.concat_ws(":", "edge_id", "kind", "value")))


def merge_hops(hops: DataFrame, limit: int) -> DataFrame:
    """Chunks of several retrieval hops as one list: each once, at its first hop and its best score there; best score first, then hop and id; hops that keep none are idle."""
    first = hops.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hop", -F.col("score"))).alias("b")).select("query_id", "chunk_id", "b.hop", (-F.col("b.col2")).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "hop", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def used_entities(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id) of retrieved entities whose name an answer holds, or a word of four letters or more of it."""
    low = F.lower("answer")
    words = F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    held = F.contains(low, F.lower("name")) | F.exists(words, lambda w: F.contains(low, w))
    return answers.join(entities, "query_id").filter(held).select("query_id", "entity_id").distinct()


def perturbation_stability(paths: DataFrame, draws: int = 16, low: float = 0.1, high: float = 0.4) -> DataFrame:
    """1 - mean share of support that is left when a tenth to two fifths of a query's edges are dropped.

    ``paths`` are (query_id, edge_ids, weight). The draws' seed is 42 XOR the
    CRC-32 of the query's id; a query without paths isn't in the result, and
    counts as 1. A query's paths are capped by expansion, so a group is small.
    """

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(42 ^ zlib.crc32(str(key[0]).encode()))
        paths_ = [set(ids) for ids in group["edge_ids"]]
        weight = group["weight"].to_numpy(dtype=float)
        edges = sorted(set().union(*paths_))
        base = weight.sum()
        left = []
        for _ in range(draws):
            n = max(1, round(rng.uniform(low, high) * len(edges)))
            gone = set(rng.choice(edges, size=n, replace=False).tolist())
            left.append(min(1.0, max(0.0, sum(w for w, ids in zip(weight, paths_, strict=True) if not ids & gone) / base)) if base > 0 else 0.0)
        return pd.DataFrame({"query_id": [key[0]], "instability": [1 - float(np.mean(left))]})

    return paths.select("query_id", "edge_ids", "weight").groupBy("query_id").applyInPandas(run, "query_id long, instability double")


def learned_certificate(rows: DataFrame, features: list[str], dataset: str = "dataset") -> DataFrame:
    """Probability that an answer is right, by logistic regression trained on the other datasets.

    Each dataset has its own model. A row without a dataset trains none, and
    its probability is null.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    filled = rows.fillna(1.0, features).withColumn("label", F.col("correct").cast("double"))
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(filled).persist()
    fitted = []
    for row in ready.select(dataset).distinct().filter(F.col(dataset).isNotNull()).orderBy(dataset).toLocalIterator():
        model = LogisticRegression(maxIter=50, regParam=0.01).fit(ready.filter(F.col(dataset) != row[0]))
        fitted.append((row[0], [float(w) for w in model.coefficients], float(model.intercept)))
    kind = ready.schema[dataset].dataType.simpleString()
    models = rows.sparkSession.createDataFrame(fitted, f"`{dataset}` {kind}, _w array<double>, _b double")
    margin = F.col("_b")
    for i, feature in enumerate(features):
        margin = margin + F.col("_w")[i] * F.col(feature)
    return ready.join(models, dataset, "left").select("question_id", dataset, (1 / (1 + F.exp(-margin))).alias("p_correct"))
