"""What a store of graphs holds and whether it is sound: counts, listings, reuse, health, provenance and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import entity_key
from loomgraph.operators.build import is_generic
from loomgraph.operators.graph import degrees, neighbours, reach

# What is compared before a stored graph is used again, as numbers or as text.
COMPARED_TEXTS = [
    "corpus_source", "question_context_role", "dataset_kg_scope", "content_hash", "kg_builder", "kg_extraction_provider",
    "kg_extraction_model", "kg_embedding_provider",
]
COMPARED_NUMBERS = ["kg_build_fingerprint_version", "kg_chunk_size", "kg_chunk_overlap"]
COMPARED_FLAGS = ["uses_global_corpus"]


def graph_stats(chunks: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """(kg_name, documents, chunks, entities, links, relations) of each graph that has chunks."""
    own = chunks.groupBy("kg_name").agg(F.countDistinct("document").alias("documents"), F.countDistinct("chunk_id").alias("chunks"))
    met = links.groupBy("kg_name").agg(F.countDistinct("entity_id").alias("entities"), F.count(F.lit(1)).alias("links"))
    related = edges.groupBy("kg_name").agg(F.count(F.lit(1)).alias("relations"))
    return own.join(met, "kg_name", "left").join(related, "kg_name", "left").fillna(0, ["entities", "links", "relations"])


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): how many nodes and edges have each label."""
    one = nodes.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    return one.unionByName(edges.groupBy(F.col("rel_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("kind"), "label", "n"))


def hub_report(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(type, entities, isolated, mean_degree, top_share, hubs) by type: the share of all ends that its most linked nodes hold, and their names."""
    own = nodes.join(degrees(edges).select(F.col("node").alias("entity_id"), "degree"), "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("type").orderBy(F.desc("degree"), "entity_id")))
    top = F.col("r") <= most
    names = F.transform(F.array_sort(F.collect_list(F.when(top & (F.col("degree") > 0), F.struct("r", "name")))), lambda x: x["name"])
    total = F.sum("degree")
    share = F.when(total > 0, F.sum(F.when(top, F.col("degree")).otherwise(0)) / total).otherwise(0.0)
    isolated = F.sum((F.col("degree") == 0).cast("long"))
    return ranked.groupBy("type").agg(F.count(F.lit(1)).alias("entities"), isolated.alias("isolated"), F.avg("degree").alias("mean_degree"), share.alias("top_share"), F.array_join(names, "; ").alias("hubs"))


def entity_details(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, wanted: Column | None = None) -> DataFrame:
    """(entity_id, name, type, chunks, documents) of entities, also of those that no chunk mentions; ``wanted`` is a condition on them."""
    own = entities if wanted is None else entities.filter(wanted)
    told = mentions.select("entity_id", "chunk_id").distinct().join(chunks.select("chunk_id", "document").distinct(), "chunk_id")
    counts = told.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("document").alias("documents"))
    return own.join(counts, "entity_id", "left").fillna(0, ["chunks", "documents"])


def reuse_reasons(pairs: DataFrame) -> DataFrame:
    """Pairs of metadata, ``stored_x`` and ``expected_x``, with the names of what differs and whether the graph can be used again.

    What either side lacks is no difference; selection_key counts only for
    graphs of a subset without a corpus of their own.
    """

    def differs(name: str, kind: str | None = None) -> Column:
        one, two = F.col(f"stored_{name}"), F.col(f"expected_{name}")
        given = one.isNotNull() & two.isNotNull() & (one.cast("string") != "") & (two.cast("string") != "")
        return F.when(given & (one.cast(kind) != two.cast(kind) if kind else one != two), name)

    found = [*(differs(n, "boolean") for n in COMPARED_FLAGS), *map(differs, COMPARED_TEXTS), *(differs(n, "long") for n in COMPARED_NUMBERS)]
    subset = (F.col("expected_dataset_kg_scope") == "evaluation_subset") & ~F.coalesce(F.col("expected_uses_global_corpus").cast("boolean"), F.lit(False))
    reasons = F.filter(F.array(*found, F.when(subset, differs("selection_key"))), lambda reason: reason.isNotNull())
    return pairs.withColumn("reasons", F.array_join(reasons, ",")).withColumn("reusable", F.size(reasons) == 0)


def store_health(runs: DataFrame) -> DataFrame:
    """Runs (extracted, skipped, stored, failures) with attempted, store_ratio, failed and degraded.

    A run with failures fails if fewer than 100 edges were attempted, if more
    than half a percent failed, or if nothing was stored.
    """
    attempted = F.greatest(F.lit(0), F.col("extracted") - F.col("skipped"))
    tried = runs.withColumn("attempted", attempted)
    ratio = lambda c: F.when(F.col("attempted") > 0, F.col(c) / F.col("attempted")).otherwise(1.0)
    bad = (F.col("attempted") < 100) | (ratio("failures") > 0.005) | ((F.col("attempted") > 0) & (F.col("stored") == 0))
    any_ = F.col("failures") > 0
    return tried.withColumn("store_ratio", ratio("stored")).withColumn("failed", any_ & bad).withColumn("degraded", any_ & ~bad)


def orphan_entities(entities: DataFrame, mentions: DataFrame, prefix: str) -> DataFrame:
    """Entities of a graph, by the prefix of their ids, that no chunk mentions."""
    return entities.filter(F.col("entity_id").startswith(prefix)).join(mentions.select("entity_id"), "entity_id", "left_anti")


def orphan_qualifiers(qualifiers: DataFrame, links: DataFrame) -> DataFrame:
    """Qualifiers that lack an edge to them or one from them; links are (src, dst)."""
    ins = links.select(F.col("dst").alias("qualifier_id")).distinct()
    outs = links.select(F.col("src").alias("qualifier_id")).distinct()
    return qualifiers.join(ins.join(outs, "qualifier_id", "left_semi"), "qualifier_id", "left_anti")


def verification_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(edge_id, chunk_id): a graph's chunks at an edge's places (array positions), or all of its chunks where none is there.

    Both carry kg_name. An edge without places in the graph is verified on the
    whole of it, as the rule has it; graphs are documents' worth of chunks.
    """
    placed = edges.select("edge_id", "kg_name", F.explode("positions").alias("position")).distinct()
    scoped = placed.join(chunks.select("kg_name", "position", "chunk_id"), ["kg_name", "position"]).select("edge_id", "chunk_id")
    rest = edges.select("edge_id", "kg_name").join(scoped.select("edge_id").distinct(), "edge_id", "left_anti")
    return scoped.unionByName(rest.join(chunks.select("kg_name", "chunk_id"), "kg_name").select("edge_id", "chunk_id")).distinct()


def local_provenance(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(edge_id, question_ids, passage_keys): the questions and passages, ``question::pN``, of the chunks at an edge's places, sorted."""
    placed = edges.select("edge_id", F.explode("positions").alias("position")).distinct()
    met = placed.join(chunks.filter(F.col("question_id").isNotNull()), "position")
    question = F.col("question_id").cast("string")
    passage = F.concat(question, F.lit("::p"), F.coalesce("passage", F.lit(-1)).cast("string"))
    return met.groupBy("edge_id").agg(F.array_sort(F.collect_set(question)).alias("question_ids"), F.array_sort(F.collect_set(passage)).alias("passage_keys"))


def name_map(entities: DataFrame) -> DataFrame:
    """(key, entity_id): the entity that a name stands for: one of a specific type, then with most mentions, then of least id."""
    order = F.struct(is_generic(F.col("type")).cast("int"), -F.col("mentions"), F.col("entity_id").alias("id"))
    return entities.groupBy(entity_key(F.col("name")).alias("key")).agg(F.min(order)["id"].alias("entity_id")).filter("key <> ''")


def resolved_ends(edges: DataFrame, scoped: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (edge_id, scope, source, target) with the entities that their names stand for, in their scope if one is known there.

    ``scoped`` is (scope, key, entity_id) and ``names`` (key, entity_id). An end
    that nothing stands for is null; whoever drops such edges counts them.
    """
    out = edges
    for end, name in (("src", "source"), ("dst", "target")):
        own = scoped.select("scope", F.col("key").alias("_k"), F.col("entity_id").alias("_own"))
        all_ = names.select(F.col("key").alias("_k"), F.col("entity_id").alias("_all"))
        out = out.withColumn("_k", entity_key(F.col(name))).join(own, ["scope", "_k"], "left").join(all_, "_k", "left")
        out = out.withColumn(end, F.coalesce("_own", "_all")).drop("_k", "_own", "_all")
    return out


def restoration_status(source: Column, relation: Column, target: Column) -> Column:
    """full, partial, minimal or failed, from what of a triple is grounded in text."""
    n = source.cast("int") + relation.cast("int") + target.cast("int")
    return F.when(n == 3, "full").when(source & target, "partial").when(n >= 1, "minimal").otherwise("failed")


def merged_spans(*groups: Column) -> Column:
    """Anchor spans (text, start, end, ...) of several arrays, each once: by start, end, unknown ones last, then text."""
    spans = F.array_distinct(F.concat(*[F.coalesce(group, F.array()) for group in groups]))
    late = F.lit((1 << 31) - 1)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.coalesce(s["start"], late).alias("a"), F.coalesce(s["end"], late).alias("b"), s["text"].alias("t"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def community_rollup(members: DataFrame, parents: DataFrame, levels: int = 3) -> DataFrame:
    """(entity_id, level, community): the communities that entities (entity_id, community) belong to, up to ``levels`` of them.

    ``parents`` is (community, parent); what has no parent ends there.
    """
    found = here = members.select("entity_id", F.lit(1).alias("level"), "community")
    for level in range(2, levels + 1):
        up = here.join(parents, "community").select("entity_id", F.lit(level).alias("level"), F.col("parent").alias("community"))
        found, here = found.unionByName(up), up
    return found


def visible(nodes: DataFrame, edges: DataFrame, labels: list[str] | None, kinds: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that a view shows: null lists show all, empty ones nothing; edges need both ends shown."""
    kept = nodes if labels is None else nodes.filter(F.col("type").isin(labels) if labels else F.lit(False))
    left = edges if kinds is None else edges.filter(F.col("rel_type").isin(kinds) if kinds else F.lit(False))
    for end in ("src", "dst"):
        left = left.join(kept.select(F.col("entity_id").alias(end)), end, "left_semi")
    return kept, left


def scope_violations(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks (query_id, kg_name, question_id, chunk_id) that aren't in their graph, or not in their question where one is given."""
    inside = chunks.select("kg_name", "chunk_id", F.col("question_id").alias("_q"))
    met = retrieved.join(inside, ["kg_name", "chunk_id"], "left").withColumn("_in", F.col("_q").isNotNull() & (F.col("question_id").isNull() | (F.col("question_id") == F.col("_q"))))
    return met.groupBy("query_id", "chunk_id").agg(F.bool_or("_in").alias("_ok")).filter(~F.col("_ok")).select("query_id", "chunk_id")


def supported_paths(paths: DataFrame, scoped_edges: DataFrame) -> DataFrame:
    """Paths (path_id, edge_ids) all of whose edges are in scope; a path without edges is none."""
    steps = paths.select("path_id", F.explode("edge_ids").alias("edge_id"))
    lost = steps.join(scoped_edges.select("edge_id"), "edge_id", "left_anti").select("path_id").distinct()
    return paths.filter(F.size("edge_ids") > 0).join(lost, "path_id", "left_anti")


def edges_in_scope(edges: DataFrame, scoped_edges: DataFrame) -> DataFrame:
    """The edges that paths are to be expanded over where all of a path's edges must be in scope: no other path is ever made."""
    return edges.join(scoped_edges.select("edge_id").distinct(), "edge_id", "left_semi")


def reachable_passages(reached: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, passage, hops): the passages that nodes reached (query_id, node, hops) are mentioned in, with the fewest hops."""
    told = mentions.select(F.col("entity_id").alias("node"), "passage").distinct()
    return reached.join(told, "node").groupBy("query_id", "passage").agg(F.min("hops").alias("hops"))


def passages_within(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 2) -> DataFrame:
    """What ``reachable_passages`` gives of the nodes that queries' seeds (query_id, node) reach in 1..hops steps.

    Up to two steps from a query's only seed no node is reached for: each node
    learns its neighbours' passages, and with each the first and last neighbour
    that has it, as a passage of the seed alone doesn't count.
    """
    starts = seeds.select("query_id", "node").distinct()
    if not 1 <= hops <= 2 or not starts.groupBy("query_id").count().filter("count > 1").isEmpty():
        return reachable_passages(reach(seeds, edges, hops), mentions)
    pairs = neighbours(edges)
    told = mentions.select(F.col("entity_id").alias("node"), "passage").distinct()
    near = told.select(F.col("node").alias("mid"), "passage", F.lit(1).alias("hops"), F.col("node").alias("whose"))
    if hops == 2:
        known = told.groupBy("node").agg(F.collect_set(F.struct("passage")).alias("passages"))  # a struct, as sets leave nulls out
        sent = pairs.join(known, F.col("node") == F.col("_from")).select(F.col("_to").alias("mid"), "passages", F.col("node").alias("whose")).repartition("mid")
        near = near.unionByName(sent.select("mid", F.explode("passages.passage").alias("passage"), F.lit(2).alias("hops"), "whose"))
    near = near.groupBy("mid", "passage", "hops").agg(F.min("whose").alias("first"), F.max("whose").alias("last"))
    met = starts.join(pairs, F.col("node") == F.col("_from")).select("query_id", "node", F.col("_to").alias("mid")).join(near, "mid")
    return met.filter((F.col("first") != F.col("node")) | (F.col("last") != F.col("node"))).groupBy("query_id", "passage").agg(F.min("hops").alias("hops"))
