"""Uncertainty of what was retrieved, and which anchors to take away to see what they carry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.blocks import bound_batches, matrix, unit_rows

#: Triples of a question that count, at most.
TRIPLES = 20
#: Sampled graph states that a partition is given.
STATES_EACH = 250_000
# What makes a run's answer calm and unsupported, and so worth an intervention.
CALM, UNSUPPORTED = 1e-9, 0.5


def spread_and_alignment(vectors: np.ndarray, question: np.ndarray) -> tuple[float, float]:
    """The entropy of the eigenvalues of the vectors' density matrix over its greatest, and the cosine of their mean with the question; both within 0 and 1."""
    unit = unit_rows(vectors)
    n = len(unit)
    values = np.clip(np.linalg.eigvalsh(unit @ unit.T / n), 0, None)
    values = values[values > 1e-12]
    entropy = float(-(values * np.log(values)).sum()) / (np.log(n) if n > 1 else 1.0)
    mean = unit.mean(axis=0)
    size = float(np.linalg.norm(mean))
    mean = mean / size if size > 1e-10 else mean
    return min(1.0, max(0.0, entropy)), min(1.0, max(0.0, float(mean @ unit_rows(question[None, :])[0])))


def evidence_entropy(triples: DataFrame, questions: DataFrame, most: int = TRIPLES) -> DataFrame:
    """(query_id, triples, spread, alignment, uncertainty) of each question (query_id, embedding): 1 - alignment * (1 - spread) of its retrieved triples (query_id, triple_id, embedding).

    The first ``most`` triples of a question by id count, so a question's group
    is bounded; questions without any have an uncertainty of 0.
    """
    bound_batches(questions.sparkSession)
    first = W.partitionBy("query_id").orderBy("triple_id")
    kept = triples.filter(F.col("embedding").isNotNull()).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    own = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("triple_id", F.col("embedding").cast("array<double>").alias("v")))).alias("t"))
    rows = questions.select("query_id", F.col("embedding").cast("array<double>").alias("q")).join(own, "query_id", "left").select("query_id", "q", F.transform("t", lambda t: t["v"]).alias("t"))
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = matrix(batch.column(1))
            counts, found = [], []
            for k, given in enumerate(batch.column(2)):
                n = len(given) if given.is_valid else 0
                counts.append(n)
                found.append(spread_and_alignment(matrix(given.values)[:, : asked.shape[1]], asked[k]) if n else (None, None))
            spread, aligned = zip(*found, strict=True) if found else ((), ())
            sure = [1 - a * (1 - s) if s is not None else 0.0 for s, a in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), *(pa.array(c, pa.float64()) for c in (spread, aligned, sure))], names=["query_id", "triples", "spread", "alignment", "uncertainty"])

    return rows.mapInArrow(run, f"query_id {kind}, triples int, spread double, alignment double, uncertainty double")


def dominant_anchors(states: DataFrame) -> DataFrame:
    """(question_id, anchor, states): the seed that most of a question's sampled graph states (question_id, sample_id, seeds) hold, ties by id."""
    return covering_anchors(states, 1).select("question_id", "anchor", F.col("covered").alias("states"))


def covering_anchors(states: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, turn, anchor, covered): seeds chosen one after the other, each holding most of the sampled states that those before it don't.

    ``states`` is (question_id, sample_id, seeds). There are ``most`` turns at
    most; ties go to the lower id, and a question ends when no state with a
    seed is left. Rows travel once, to their question's partition, of which
    there are as many as states ask for; turns are windows within it.
    """
    parts = max(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-states.count() // STATES_EACH))
    each = states.select("question_id", "sample_id", F.explode(F.array_distinct("seeds")).alias("anchor")).filter(F.trim("anchor") != "")
    rows = each.repartition(parts, "question_id").distinct().withColumn("_left", F.lit(True))
    own = W.partitionBy("question_id")
    for turn in range(1, most + 1):
        rows = rows.withColumn("_n", F.count(F.when(F.col("_left"), 1)).over(W.partitionBy("question_id", "anchor")))
        rows = rows.withColumn(f"_{turn}", F.min(F.when(F.col("_left"), F.struct((-F.col("_n")).alias("n"), "anchor"))).over(own))
        if turn < most:
            holds = F.max(F.coalesce(F.col("anchor") == F.col(f"_{turn}.anchor"), F.lit(False))).over(W.partitionBy("question_id", "sample_id"))
            rows = rows.withColumn("_left", F.col("_left") & ~holds)
    chosen = rows.groupBy("question_id").agg(*[F.first(f"_{turn}").alias(f"_{turn}") for turn in range(1, most + 1)])
    turns = F.array(*[F.struct(F.lit(turn).alias("turn"), F.col(f"_{turn}.anchor").alias("anchor"), (-F.col(f"_{turn}.n")).alias("covered")) for turn in range(1, most + 1)])
    return chosen.select("question_id", F.explode(turns).alias("t")).select("question_id", "t.*").filter("anchor IS NOT NULL")


def masking_candidates(runs: DataFrame, states: DataFrame, sd_threshold: float = CALM, seu_threshold: float = UNSUPPORTED, wrong_only: bool = True, populated_route: bool = True) -> DataFrame:
    """The runs (question_id, sd_uq, seu, correct, failed, route) that an intervention is worth, with the anchor to mask.

    They didn't fail, are calm and unsupported, by choice wrong and by a route
    that found something; runs without an anchor are left out.
    """
    fine = ~F.coalesce("failed", F.lit(False)) & (F.col("sd_uq") <= sd_threshold) & (F.col("seu") >= seu_threshold)
    if wrong_only:
        fine = fine & ~F.coalesce("correct", F.lit(False))
    if populated_route:
        fine = fine & (F.coalesce("route", F.lit("")) != "") & ~F.endswith("route", F.lit("_empty"))
    return runs.filter(fine).join(dominant_anchors(states).select("question_id", "anchor", "states"), "question_id")
