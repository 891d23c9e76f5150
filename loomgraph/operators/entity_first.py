"""From questions to pruned contexts: entities first, and what takes over where they find nothing.

All questions go through the steps together. A step that is to run only for
questions that the step before left without a context gets those questions
alone: their ids are settled by a table that is written first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import content_tokens, grounding_quality, overlap_count
from loomgraph.functions.vectors import cosine
from loomgraph.operators.build import node_specificity
from loomgraph.operators.context import LINKS_EACH, QUESTION_LINK, linked_entities, merged_candidates, retained_entities
from loomgraph.operators.graph import MIN_CONFIDENCE, expand_entities, personalized_pagerank, readable_edges
from loomgraph.operators.retrieve import hop_score, passage_cap, relevance_gate, symbolic_lookup, text_search, top_per_query, vector_top_k
from loomgraph.operators.scope import supported_by_chunks
from loomgraph.sources.shared import stored

# How far a graph is walked, and how sure an anchor must be, for graphs that have limits of their own.
SEED_LIMIT, SEED_LIMITS = 24, {"multihoprag": 12}
NEIGHBOUR_LIMIT, NEIGHBOUR_LIMITS = 30, {"multihoprag": 12}
HOP_LIMITS = {"multihoprag": 2}
LEAST_GROUNDING = 0.25
LEAST_GROUNDINGS = {"hotpotqa": 0.30, "2wikimultihopqa": 0.25, "musique": 0.25, "multihoprag": 0.20, "bioasq": 0.30, "pubmedqa": 0.30, "realmedqa": 0.30}

HOPS = 2
CHUNKS = 20
#: Chunks that are scored for each that is wanted, and at most.
CANDIDATES_EACH, MOST_CANDIDATES = 10, 200
LEAST_CHUNKS = 2
#: Cosine from which a chunk answers a question by itself.
LEAST_COSINE = 0.08


@dataclass
class Store:
    """A graph's tables.

    ``entities`` is (entity_id, name) and may have number (a whole number of its
    own) with embedding, source_title, all_names and synonyms; ``edges`` is
    (edge_id, src, dst, rel_type, confidence) and may have the arrays positions,
    passages and question_ids; ``mentions`` is (chunk_id, entity_id); ``chunks`` is
    (chunk_id, text, document, passage, position) with whole-number ids and may
    have question_id and embedding.
    """

    entities: DataFrame
    edges: DataFrame
    mentions: DataFrame
    chunks: DataFrame


@dataclass
class Context:
    """What questions get: chunks (query_id, chunk_id, route, score, hops, links, rank), entities (query_id, entity_id, hops), edges (query_id and the edge's columns)."""

    chunks: DataFrame
    entities: DataFrame
    edges: DataFrame


def by_graph(kg_name: Column, given: dict[str, float], default: float | Column) -> Column:
    """A limit of the graph of this name, whatever its case, else the default."""
    name = F.lower(F.trim(F.coalesce(kg_name, F.lit(""))))
    out = default if isinstance(default, Column) else F.lit(default)
    for key, value in given.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def _kg(queries: DataFrame) -> Column:
    return F.col("kg_name") if "kg_name" in queries.columns else F.lit(None).cast("string")


def question_entities(queries: DataFrame, store: Store, masked: DataFrame | None = None) -> DataFrame:
    """(query_id, entity_id, name, in_question, holds_question, overlap, score): the entities that questions name or lie near, the best few of each."""
    symbolic = symbolic_lookup(queries, store.entities)
    if "embedding" in queries.columns and "embedding" in store.entities.columns:
        asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
        vectors = store.entities.filter(F.col("embedding").isNotNull()).select(F.col("number").alias("vec_id"), "embedding")
        near = vector_top_k(asked, vectors, LINKS_EACH, threshold=QUESTION_LINK)
        scored = near.join(store.entities.select(F.col("number").alias("vec_id"), "entity_id"), "vec_id").select("query_id", F.lit(None).cast("string").alias("mention"), "entity_id", F.col("score").alias("cosine"))
        linked = linked_entities(scored, node_specificity(store.mentions).select("entity_id", "specificity"))
    else:
        linked = symbolic.limit(0).select("query_id", "entity_id", F.lit(0.0).alias("score"))
    return merged_candidates(symbolic, linked.join(store.entities.select("entity_id", "name"), "entity_id"), masked)


def anchored_seeds(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, node): the candidates of the questions that may be walked from.

    A question's grounding is the share of its content tokens that its
    candidates' names hold; weakly grounded ones need a candidate met by its letters.
    """
    names = candidates.groupBy("query_id").agg(F.array_join(F.collect_list("name"), " ").alias("names"), F.bool_or((F.col("in_question") > 0) | (F.col("holds_question") > 0) | (F.col("overlap") >= 2)).alias("told"))
    tokens = content_tokens(F.col("question"))
    met = queries.select("query_id", tokens.alias("tokens"), by_graph(_kg(queries), LEAST_GROUNDINGS, LEAST_GROUNDING).alias("least"), by_graph(_kg(queries), SEED_LIMITS, SEED_LIMIT).alias("seeds")).join(names, "query_id")
    sure = met.filter(F.col("told") | (grounding_quality(F.col("tokens"), overlap_count(F.col("tokens"), F.col("names"))) >= F.col("least")))
    return candidates.join(sure.select("query_id", "seeds"), "query_id").filter(F.col("rank") <= F.col("seeds")).select("query_id", F.col("entity_id").alias("node"))


def walked_entities(queries: DataFrame, seeds: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(query_id, entity_id, hops): each question's seeds and the neighbours that its graph's limits allow."""
    limits = queries.select("query_id", by_graph(_kg(queries), HOP_LIMITS, hops).alias("most_hops"), by_graph(_kg(queries), NEIGHBOUR_LIMITS, NEIGHBOUR_LIMIT).alias("most"))
    near = expand_entities(seeds, edges, hops, limit=1 << 30).drop("rank").join(limits, "query_id").filter(F.col("min_hops") <= F.col("most_hops"))
    order = W.partitionBy("query_id").orderBy(F.desc("seed_count"), "min_hops", "node")
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("most"))
    own = seeds.select("query_id", F.col("node").alias("entity_id"), F.lit(0).alias("hops")).distinct()
    return own.unionByName(near.select("query_id", F.col("node").alias("entity_id"), F.col("min_hops").alias("hops")))


def edges_among(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of each question with both ends among its entities (query_id, entity_id)."""
    own = entities.select("query_id", "entity_id")
    met = edges.join(own.withColumnRenamed("entity_id", "src"), "src")
    return met.join(own.withColumnRenamed("entity_id", "dst"), ["query_id", "dst"], "left_semi")


def candidate_chunks(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """(query_id, chunk_id, position, links, hops): the chunks that mention most of a question's entities, of questions that have enough of them."""
    met = mentions.select("chunk_id", "entity_id").distinct().join(entities, "entity_id").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("links"), F.min("hops").alias("hops"))
    placed = met.join(chunks.select("chunk_id", F.coalesce("position", F.lit(0)).alias("position")), "chunk_id")
    kept = top_per_query(placed, most, F.desc("links"), F.col("position"), F.col("chunk_id")).drop("rank")
    enough = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    return kept.withColumn("n", enough).filter(F.col("n") >= LEAST_CHUNKS).drop("n")


def entity_scores(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, entity_id, score): restarted walks over the best of a question's where its entities have edges, else by hops."""
    seeds = entities.filter("hops = 0").select("query_id", F.col("entity_id").alias("node"))
    linked = edges.select("query_id").distinct()
    walked = personalized_pagerank(entities.join(linked, "query_id", "left_semi").select("query_id", F.col("entity_id").alias("node")), edges.select("query_id", "src", "dst", "confidence"), seeds)
    best = F.max("score").over(W.partitionBy("query_id"))
    share = walked.withColumn("best", best).select("query_id", F.col("node").alias("entity_id"), F.when(F.col("best") > 0, F.col("score") / F.col("best")).alias("share"))
    return entities.join(share, ["query_id", "entity_id"], "left").select("query_id", "entity_id", F.coalesce("share", hop_score(F.col("hops"))).alias("score"))


def entity_first(queries: DataFrame, store: Store, most: int = CHUNKS, hops: int = HOPS, masked: DataFrame | None = None) -> Context:
    """The contexts of the questions (query_id, question and, if there, embedding and kg_name) that entities lead to.

    Entities are met by letters and by vectors; questions without a sure anchor
    get no context. The graph is walked from them, and the chunks that mention
    what was reached are scored by restarted walks. Chunks that a hop led to
    must lie near the question where both have vectors; a passage gives two of
    them at most. Edges are those among the entities that the chosen chunks
    mention, from a confidence of 0.4 on, and borne out by these chunks.
    """
    candidates = stored(question_entities(queries, store, masked), "context-candidates")
    seeds = stored(anchored_seeds(queries, candidates), "context-seeds")
    edges = readable_edges(store.edges)
    entities = stored(walked_entities(queries, seeds, edges, hops), "context-entities")
    among = stored(edges_among(entities, edges), "context-edges")
    chunks = candidate_chunks(entities, store.mentions, store.chunks, min(most * CANDIDATES_EACH, MOST_CANDIDATES))

    linked = store.mentions.select("chunk_id", "entity_id").distinct().join(entity_scores(entities, among), "entity_id")
    mean = linked.join(chunks.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "chunk_id").agg(F.round(F.least(F.lit(1.0), F.avg("score") + 0.05 * (F.count(F.lit(1)) - 1)), 9).alias("score"))
    scored = chunks.join(mean, ["query_id", "chunk_id"])
    near = F.lit(None).cast("double").alias("cosine")
    given = ["passage", "document", *(["question_id"] if "question_id" in store.chunks.columns else [])]
    if "embedding" in queries.columns and "embedding" in store.chunks.columns:
        scored = scored.join(store.chunks.select("chunk_id", *given, F.col("embedding").alias("c_vec")), "chunk_id").join(queries.select("query_id", F.col("embedding").alias("q_vec")), "query_id")
        near = F.when(F.col("c_vec").isNotNull() & F.col("q_vec").isNotNull(), F.round(cosine(F.col("c_vec"), F.col("q_vec")), 9)).alias("cosine")
    else:
        scored = scored.join(store.chunks.select("chunk_id", *given), "chunk_id")
    scored = scored.select("query_id", "chunk_id", *given, "position", "links", "hops", "score", near)
    kept = passage_cap(relevance_gate(scored))
    chosen = top_per_query(kept, most, F.desc("score"), F.desc("links"), F.col("position"), F.col("chunk_id")).drop("cosine")
    chosen = stored(chosen.withColumn("route", F.lit("entity_first")), "context-chunks")

    retained = retained_entities(chosen, store.mentions)
    own = entities.join(retained, ["query_id", "entity_id"], "left_semi")
    told = edges_among(own, store.edges.filter(F.coalesce("confidence", F.lit(1.0)) >= MIN_CONFIDENCE))
    scopes = chosen if "question_id" in given else chosen.withColumn("question_id", F.lit(None).cast("string"))
    arrays = {}
    for name, scope in (("positions", "position"), ("passages", "passage"), ("question_ids", "question_id")):
        none = F.array().cast(f"array<{scopes.schema[scope].dataType.simpleString()}>")
        arrays[name] = F.col(name) if name in store.edges.columns else none
    told = told.select(*[c for c in told.columns if c not in arrays], *(c.alias(name) for name, c in arrays.items()))
    return Context(chosen, own, supported_by_chunks(told, scopes).dropDuplicates(["query_id", "edge_id"]))


def by_vectors(queries: DataFrame, store: Store, most: int = CHUNKS, least: float = LEAST_COSINE) -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest chunks of the questions that have a vector."""
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    found = vector_top_k(asked, store.chunks.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").alias("vec_id"), "embedding"), most, threshold=least)
    return found.select("query_id", F.col("vec_id").alias("chunk_id"), "score", "rank")


def retrieved_context(queries: DataFrame, store: Store, most: int = CHUNKS, hops: int = HOPS, masked: DataFrame | None = None) -> Context:
    """A context for every question that any route finds one for: entities first, else vectors, else words.

    Questions of the kind ``comparison`` (a column kind, if there) skip the
    graph. Each route gets only the questions that the one before left empty.
    ``route`` tells which one a chunk came by: entity_first, semantic_only or text.
    """
    walking = queries.filter(F.coalesce(F.col("kind"), F.lit("")) != "comparison") if "kind" in queries.columns else queries
    first = entity_first(walking, store, most, hops, masked)
    columns = ["query_id", "chunk_id", "route", "score", "hops", "links", "rank"]
    none = [F.lit(None).cast("int").alias("hops"), F.lit(None).cast("long").alias("links")]
    chunks = first.chunks.select(columns)
    left = stored(queries.join(chunks.select("query_id").distinct(), "query_id", "left_anti"), "context-left")
    if "embedding" in queries.columns and "embedding" in store.chunks.columns:
        near = stored(by_vectors(left, store, most).select("query_id", "chunk_id", F.lit("semantic_only").alias("route"), "score", *none, "rank"), "context-near")
        chunks = chunks.unionByName(near.select(columns))
        left = left.join(near.select("query_id").distinct(), "query_id", "left_anti")
    words = text_search(left, store.chunks.select("chunk_id", "text"), most)
    chunks = chunks.unionByName(words.select("query_id", "chunk_id", F.lit("text").alias("route"), "score", *none, "rank").select(columns))
    return Context(chunks, first.entities, first.edges)
