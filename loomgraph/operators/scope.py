"""Predicates that tie entities and edges to questions, passages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def supported_entities(entities: DataFrame, mentions: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Entities that some chunk mentions, within the given questions if there are any."""
    seen = mentions if questions is None else mentions.join(questions, "question_id", "left_semi")
    return entities.join(seen, "entity_id", "left_semi")


#: Mentions that a partition is given where a question's are dealt to one.
MENTIONS_EACH = 200_000


def _question_parts(mentions: DataFrame) -> int:
    """How many partitions questions are dealt to."""
    return max(int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mentions.count() // MENTIONS_EACH))


def near_mentions(mentions: DataFrame) -> DataFrame:
    """(question_id, a, b): entities that occur in chunks at most one place apart in one passage.

    Mentions travel once, to their question's partition. There each place takes
    the entities of the places beside it, and pairs are made and told apart;
    none of them travels.
    """
    passage = F.coalesce("passage", F.lit(-1)).alias("passage")
    given = mentions.filter(F.col("question_id").isNotNull() & F.col("entity_id").isNotNull() & F.col("position").isNotNull())
    dealt = given.select("question_id", passage, "position", "entity_id").repartition(_question_parts(mentions), "question_id")
    places = dealt.groupBy("question_id", "passage", "position").agg(F.collect_set("entity_id").alias("here"))
    w = W.partitionBy("question_id", "passage").orderBy("position")
    beside = lambda of, step: F.when(of(F.col("position")).over(w) == F.col("position") + step, of(F.col("here")).over(w)).otherwise(F.array())
    near = places.select("question_id", "here", F.array_distinct(F.concat("here", beside(F.lag, -1), beside(F.lead, 1))).alias("near"))
    pairs = near.select("question_id", "near", F.explode("here").alias("a")).select("question_id", "a", F.explode("near").alias("b"))
    return pairs.filter(F.col("a") != F.col("b")).distinct()


def scoped_edges(edges: DataFrame, mentions: DataFrame, min_confidence: float = 0.4, limit: int | None = None) -> DataFrame:
    """Edges that a question may use: certain enough, and with both ends near each other in it.

    Done once on edges, so that paths are expanded over what is in scope only.
    Edges and mentions travel once, to their question's partition, where an edge
    takes the places of its two ends; near pairs aren't listed. With a limit, the
    most certain edges of each question stay, ties by id.
    """
    sure = edges.filter((F.col("confidence") >= min_confidence) & F.col("question_id").isNotNull() & (F.col("src") != F.col("dst")))
    asked = sure.select("question_id", F.col("src").alias("_node"), F.lit(None).alias("_place"), F.struct(*edges.columns).alias("_edge"))
    place = F.struct(F.coalesce("passage", F.lit(-1)).alias("passage"), F.col("position").alias("position"))
    told = mentions.filter(F.col("position").isNotNull()).select("question_id", F.col("entity_id").alias("_node"), place.alias("_place"), F.lit(None).alias("_edge"))
    rows = told.unionByName(asked).repartition(_question_parts(mentions), "question_id")
    at_node = F.collect_set("_place").over(W.partitionBy("question_id", "_node"))
    rows = rows.withColumn("_from", at_node).withColumn("_node", F.coalesce("_edge.dst", "_node")).withColumn("_from", F.when(F.col("_edge").isNotNull(), F.col("_from")))
    rows = rows.withColumn("_to", at_node).filter(F.col("_edge").isNotNull())
    around = F.flatten(F.transform("_from", lambda p: F.array(*[p.withField("position", p["position"] + step) for step in (-1, 0, 1)])))
    kept = rows.filter(F.size(F.array_intersect(around, F.col("_to"))) > 0).select("_edge.*")
    if limit is None:
        return kept
    best = W.partitionBy("question_id").orderBy(F.desc("confidence"), "edge_id")
    return kept.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit).drop("_r")


def adjacent_chunks(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks one place before or after a selected one, in the same question and passage, that aren't selected."""
    beside = selected.select("question_id", "passage", F.explode(F.array(F.col("position") - 1, F.col("position") + 1)).alias("position")).distinct()
    return chunks.join(beside, ["question_id", "passage", "position"], "left_semi").join(selected, "chunk_id", "left_anti")


def chunks_of_entities(mentions: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """The chunks that mention most of the given entities of a query, ties by place: linked ids and their number.

    The number is that of the ids gathered, so rows aren't told apart a second time to count them.
    """
    linked = mentions.join(entities, "entity_id").groupBy("query_id", "chunk_id", "position").agg(F.array_sort(F.collect_set("entity_id")).alias("linked"))
    best = W.partitionBy("query_id").orderBy(F.desc("links"), "position", "chunk_id")
    ranked = linked.withColumn("links", F.size("linked").cast("long")).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= limit)


def leaked(gold: DataFrame, contexts: DataFrame) -> DataFrame:
    """Whether a gold answer of four characters or more occurs in another context of its question: (conv_id, turn, leaked)."""
    asked = gold.filter(F.length("gold") > 3)
    met = asked.join(contexts, "conv_id").filter(F.col("turn") != F.col("place"))
    return met.groupBy("conv_id", "turn").agg(F.bool_or(F.contains(F.lower("context"), F.lower("gold"))).alias("leaked"))


def supported_by_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges that a query's selected chunks bear out: by place if the edge has places, else by passage, else by question, else always.

    Edges carry query_id and arrays positions, passages, question_ids; chunks
    carry query_id, position, passage and question_id.
    """
    selected = chunks.groupBy("query_id").agg(F.collect_set("position").alias("_p"), F.collect_set("passage").alias("_g"), F.collect_set("question_id").alias("_q"))
    given = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    borne = (
        F.when(given("positions"), F.arrays_overlap("positions", "_p"))
        .when(given("passages"), F.arrays_overlap("passages", "_g"))
        .when(given("question_ids"), F.arrays_overlap("question_ids", "_q"))
        .otherwise(True)
    )
    return edges.join(selected, "query_id").filter(borne).drop("_p", "_g", "_q")
