"""From candidates to a context: entity links, gates, routes, the order of chunks, selection and what is told to a model.

Tables carry query_id. Chunks of a query are (chunk_id, text, document, links,
score, position), entities (entity_id), edges (src, dst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import comparison_branches, content_tokens, overlap_count, squeeze
from loomgraph.operators.retrieve import top_per_query
from loomgraph.operators.scope import supported_by_chunks
from loomgraph.sources.shared import cut, stored

#: Cosines from which an entity is linked to a mention, or to a whole question.
MENTION_LINK, QUESTION_LINK = 0.72, 0.55
LINKS_EACH = 15
SEEDS = 12
#: Restarted walks: chunks of this cosine start them, so many of them and so many entities of each.
START_COSINE, START_CHUNKS, STARTS_EACH = 0.20, 60, 4
LEAST_WALK = 0.005


def linked_entities(scored: DataFrame, specificity: DataFrame) -> DataFrame:
    """(query_id, entity_id, score) from (query_id, mention, entity_id, cosine): null mentions stand for the whole question.

    The nearest few of each mention above the threshold, weighed by how specific
    the entity is (1 where unknown); the best of each entity stays.
    """
    near = W.partitionBy("query_id", "mention").orderBy(F.desc("cosine"), "entity_id")
    least = F.when(F.col("mention").isNull(), QUESTION_LINK).otherwise(MENTION_LINK)
    kept = scored.withColumn("_r", F.row_number().over(near)).filter((F.col("_r") <= LINKS_EACH) & (F.col("cosine") >= least))
    weighed = kept.join(specificity, "entity_id", "left").withColumn("score", F.col("cosine") * F.coalesce("specificity", F.lit(1.0)))
    return weighed.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))


def merged_candidates(symbolic: DataFrame, linked: DataFrame, masked: DataFrame | None = None, most: int = SEEDS) -> DataFrame:
    """Candidates by letters (in_question, holds_question, overlap) and by vectors (score) as one list: each entity once.

    Order: name in question, question in name, token overlap, score, longer
    name, id. Masked entities (entity_id) are left out before the cut.
    """
    names = F.coalesce(F.col("s.name"), F.col("l.name")).alias("name")
    both = symbolic.alias("s").join(linked.alias("l"), ["query_id", "entity_id"], "full")
    rows = both.select(
        "query_id", "entity_id", names, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("in_question", "holds_question", "overlap")], F.coalesce("score", F.lit(0.0)).alias("score")
    )
    if masked is not None:
        rows = rows.join(masked, "entity_id", "left_anti")
    return top_per_query(rows, most, F.desc("in_question"), F.desc("holds_question"), F.desc("overlap"), F.desc("score"), F.desc(F.length("name")), F.col("entity_id"))


def confident_queries(candidates: DataFrame, grounding: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id) of the queries whose candidates may be walked from: grounded enough, or one met by its letters.

    Queries without candidates or without a grounding aren't among them.
    """
    by_letters = F.bool_or((F.col("in_question") > 0) | (F.col("holds_question") > 0) | (F.col("overlap") >= 2))
    met = candidates.groupBy("query_id").agg(by_letters.alias("told")).join(grounding, "query_id")
    return met.filter(F.col("told") | (F.col("grounding") >= least)).select("query_id")


def sufficient(chunks: DataFrame, least: int = 2) -> DataFrame:
    """The chunks of the queries that have ``least`` of them."""
    enough = chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return chunks.join(enough, "query_id", "left_semi")


def with_question_parts(queries: DataFrame) -> DataFrame:
    """Questions with their ``sides`` and ``tokens``: joined to chunks, these spare working them out for each chunk."""
    return queries.withColumns({"sides": comparison_branches(F.col("question")), "tokens": content_tokens(F.col("question"))})


def branch_matches(sides: Column, *texts: Column) -> Column:
    """How many sides of an "A or B" question the texts hold."""
    hay = F.lower(F.concat_ws(" ", *texts))
    return F.size(F.filter(sides, lambda side: F.contains(hay, F.lower(side))))


def sorted_for_query(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks with their rank: most sides of a comparison, most content tokens, most linked entities, best score, not adjacent, first place, id.

    Chunks may carry ``sides`` and ``tokens`` of their questions.
    """
    texts = (F.col("document"), F.col("text"))
    given = chunks if {"sides", "tokens"} <= set(chunks.columns) else with_question_parts(chunks)
    marked = given.withColumn("branches", branch_matches(F.col("sides"), *texts)).withColumn("overlap", overlap_count(F.col("tokens"), *texts)).drop("sides", "tokens")
    order = [F.desc("branches"), F.desc("overlap"), F.desc("links"), F.desc("score"), F.coalesce(F.col("adjacent").cast("int"), F.lit(0)), F.coalesce("position", F.lit(0)), F.col("chunk_id")]
    ranked = marked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def covered_branches(chunks: DataFrame) -> DataFrame:
    """(query_id, branches, covered): the sides of a question and how many of them any chunk holds."""
    sides = chunks.select("query_id", F.explode(comparison_branches(F.col("question"))).alias("side"), F.lower(F.concat_ws(" ", "document", "text")).alias("hay"))
    each = sides.groupBy("query_id", "side").agg(F.bool_or(F.contains("hay", F.lower("side"))).alias("held"))
    return each.groupBy("query_id").agg(F.count(F.lit(1)).alias("branches"), F.sum(F.col("held").cast("long")).alias("covered"))


def graph_is_meaningful(grounding: Column, has_structure: Column, has_chunks: Column, branches: Column, covered: Column, weak: float = 0.5) -> Column:
    """Whether a graph context stays primary: it has chunks, isn't weak without structure, covers a comparison, and has structure or grounding."""
    sure = F.coalesce(grounding >= weak, F.lit(False))
    weakly = grounding.isNotNull() & ~sure & ~has_structure
    return has_chunks & ~weakly & F.when(F.coalesce(branches, F.lit(0)) > 0, covered >= branches).otherwise(has_structure | sure)


def retrieval_route(mode: Column, kind: Column, entity_chunks: Column, meaningful: Column, expanded_chunks: Column, vectors: Column, fallback: Column) -> Column:
    """The route that answers a query: entities first, expansion from retrieved chunks, or plain search.

    ``mode`` is hybrid_auto, entity_first, rfge or vector_only; comparisons skip
    the graph. ``vectors`` tells whether there is a vector index, ``fallback``
    whether entity_first may fall back to it.
    """
    walks = kind != "comparison"
    first = mode.isin("hybrid_auto", "entity_first") & walks & (entity_chunks > 0)
    merged = F.when(~vectors, "entity_first").when(meaningful, "hybrid").otherwise("hybrid_vector_primary")
    expanded = mode.isin("hybrid_auto", "rfge") & walks & (expanded_chunks > 0)
    return F.when(first, merged).when(expanded, "rfge").when((mode == "entity_first") & ~fallback, "entity_first_empty").when(vectors, "semantic_only").otherwise("text")


def walk_starts(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, node): the entities that walks restart at, a few of each of the nearest chunks (query_id, chunk_id, cosine)."""
    near = top_per_query(chunks.filter(F.col("cosine") >= START_COSINE), START_CHUNKS, F.desc("cosine"), F.col("chunk_id"))
    told = near.join(mentions.select("chunk_id", "entity_id").distinct(), "chunk_id")
    each = W.partitionBy("query_id", "chunk_id").orderBy("entity_id")
    return told.withColumn("_r", F.row_number().over(each)).filter(F.col("_r") <= STARTS_EACH).select("query_id", F.col("entity_id").alias("node")).distinct()


def walked_chunks(chunks: DataFrame, mentions: DataFrame, walks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): half the cosine and half what walks (query_id, node, score) give a retrieved chunk; 0.3 of that for chunks that walks alone reach.

    A chunk's share of a walk is the mean of its entities' scores over the
    query's best, 0.05 more for each further entity, at most 1. Only entities
    of LEAST_WALK or more bring new chunks.
    """
    walks = cut(walks)
    best = walks.groupBy("query_id").agg(F.max("score").alias("best"))
    scaled = walks.join(best, "query_id").filter("best > 0").select("query_id", F.col("node").alias("entity_id"), (F.col("score") / F.col("best")).alias("s"), (F.col("score") >= LEAST_WALK).alias("strong"))
    told = mentions.select("chunk_id", "entity_id").distinct()
    # scores of a walk sum to 1, so strong entities are few; other chunks than theirs and the retrieved ones aren't asked for
    reached = told.join(scaled.filter("strong").select("query_id", "entity_id"), "entity_id").select("query_id", "chunk_id")
    wanted = chunks.select("query_id", "chunk_id").unionByName(reached).distinct()
    met = wanted.join(told, "chunk_id").join(scaled, ["query_id", "entity_id"])
    share = met.groupBy("query_id", "chunk_id").agg(F.least(F.lit(1.0), F.avg("s") + 0.05 * (F.count(F.lit(1)) - 1)).alias("walk"), F.bool_or("strong").alias("strong"))
    both = chunks.select("query_id", "chunk_id", "cosine").join(share, ["query_id", "chunk_id"], "full")
    score = F.when(F.col("cosine").isNull(), 0.3 * F.col("walk")).otherwise(0.5 * F.col("cosine") + 0.5 * F.coalesce("walk", F.lit(0.0)))
    return both.filter(F.col("cosine").isNotNull() | F.col("strong")).select("query_id", "chunk_id", score.alias("score"))


def walk_grounding(starts: DataFrame, walks: DataFrame) -> DataFrame:
    """(query_id, grounding): the share of a query's starts that walks come back to."""
    met = starts.join(walks, ["query_id", "node"], "left")
    return met.groupBy("query_id").agg(F.avg(F.coalesce((F.col("score") >= LEAST_WALK).cast("double"), F.lit(0.0))).alias("grounding"))


def retained_entities(selected: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, entity_id) that the selected chunks mention."""
    return selected.select("query_id", "chunk_id").join(mentions.select("chunk_id", "entity_id"), "chunk_id").select("query_id", "entity_id").distinct()


def selected_scopes(selected: DataFrame) -> DataFrame:
    """(query_id, positions, question_ids, passage_keys) of the selected chunks, sorted; a passage's key is ``question::pN``."""
    given = F.col("question_id").isNotNull() & (F.trim(F.col("question_id").cast("string")) != "")
    passage = F.when(given, F.concat(F.col("question_id").cast("string"), F.lit("::p"), F.coalesce("passage", F.lit(-1)).cast("string")))
    question = F.when(given, F.col("question_id").cast("string"))
    return selected.groupBy("query_id").agg(*[F.array_sort(F.collect_set(c)).alias(name) for c, name in ((F.col("position"), "positions"), (question, "question_ids"), (passage, "passage_keys"))])


def pruned_edges(edges: DataFrame, selected: DataFrame, mentions: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """The edges of each query's context that its selected chunks leave: both ends retained, and borne out by the chunks.

    ``selected`` and ``retained``, the entities that it mentions, are read several times, so let them be stored tables.
    """
    kept = stored(retained_entities(selected, mentions), "context-retained") if retained is None else retained
    ends = [kept.withColumnRenamed("entity_id", end) for end in ("src", "dst")]
    inside = edges.join(ends[0], ["query_id", "src"], "left_semi").join(ends[1], ["query_id", "dst"], "left_semi")
    return supported_by_chunks(inside, selected)


def context_totals(selected: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunks, documents, total_score, entities, relations) of each query's pruned context."""
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    own = selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document").alias("documents"), F.sum("score").alias("total_score"))
    return own.join(count(entities, "entities"), "query_id", "left").join(count(edges, "relations"), "query_id", "left").fillna(0, ["entities", "relations"])


def result_texts(selected: DataFrame) -> DataFrame:
    """(query_id, texts): the texts of each query's chosen chunks (query_id, rank, text) in their order, blank and repeated ones left out."""
    told = selected.filter(F.trim("text") != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"])
    return told.groupBy("query_id").agg(F.array_distinct(ordered).alias("texts"))


def _told(rows: DataFrame, line: Column, separator: str) -> DataFrame:
    """(query_id, told): the lines of a query's chunks in the order of their ranks."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), separator).alias("told"))


def passages_block(selected: DataFrame) -> DataFrame:
    """(query_id, told): the passages of a query as a numbered block, blank ones left out but counted."""
    text = F.trim(F.coalesce("text", F.lit("")))
    lines = _told(selected.filter(text != ""), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), text), "\n\n")
    every = selected.select("query_id").distinct().join(lines, "query_id", "left")
    return every.select("query_id", F.coalesce(F.concat(F.lit("PASSAGES:\n"), "told"), F.lit("(No passages retrieved)")).alias("told"))


def guardrail_block(selected: DataFrame, most: int = 8, characters: int = 320) -> DataFrame:
    """(query_id, told): the first chunks of a query as a guardrail reads them, cut to some characters each."""
    document = F.when(F.col("document") != "", F.col("document")).otherwise("unknown")
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), document, F.lit(": "), F.left(squeeze(F.coalesce("text", F.lit(""))), F.lit(characters)))
    return _told(selected.filter(F.col("rank") <= most), line, "\n")


def sources_block(selected: DataFrame) -> DataFrame:
    """(query_id, told): all chunks under their sources."""
    return _told(selected, F.concat(F.lit("[Source: "), F.coalesce("document", F.lit("unknown")), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n")), "\n")


def fusion_variants(question: Column) -> Column:
    """The question and one question for each side of a comparison, each once."""
    asked = squeeze(question)
    return F.array_distinct(F.concat(F.array(asked), F.transform(comparison_branches(asked), squeeze)))


def wants_fusion(question: Column, branches: Column, covered: Column, chunks: Column, hops: Column, method: Column) -> Column:
    """Whether a question is to be asked in variants: a side uncovered, several hops but by hops already, or long with few chunks."""
    uncovered = (F.coalesce(branches, F.lit(0)) > 0) & (F.coalesce(covered, F.lit(0)) < branches)
    thin = (F.size(content_tokens(question)) >= 8) & (chunks < 4)
    return uncovered | ((hops >= 2) & (F.coalesce(method, F.lit("")) != "iterative_hop")) | thin


def hop_query(question: Column, part: Column, hop: Column, anchored: Column, later: Column) -> Column:
    """What a hop asks: its part of the question, after the first hop and where anchored with the whole question and the next part."""
    whole, own, following = (squeeze(F.coalesce(c, F.lit(""))) for c in (question, part, later))
    told = F.concat_ws("\n", own, F.concat(F.lit("Original question: "), whole), F.when(following != "", F.concat(F.lit("Next hop target: "), following)))
    return F.when((hop > 0) & anchored & (whole != "") & (own != "") & ~F.contains(own, whole), told).otherwise(part)
