"""Graph construction: harmonised entities and relations, checks, confidence and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.passages import title_variants
from loomgraph.functions.text import entity_key, is_entity_name

# Types that say nothing about an entity.
GENERIC_TYPES = ["concept", "entity", "unknown", "other", ""]
MIN_TRIPLE_CONFIDENCE = 0.15


def is_generic(kind: Column) -> Column:
    return F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(GENERIC_TYPES)


#: Datasets whose passages are articles with a title each.
TITLED_DATASETS = ["hotpotqa", "2wikimultihopqa", "musique"]


def harmonize_entities(rows: DataFrame) -> DataFrame:
    """One entity a key and specific type, from mentions of (name, type, description) and, where known, (dataset, source_title, scope_key).

    Names that are too general or too short to be an entity's are left out.
    Mentions meet by the key of their name. Those that name their own passage's
    title, in a dataset of titled passages, are the article's: where a key has
    them in several scopes, each scope's stay apart. What is left splits by
    specific type; generic ones join the largest specific type (ties: the lower
    name), or stand alone. The representative is the most specific, longest
    described, longest named mention. Names are collected as a sorted set.
    """
    known = rows.filter(is_entity_name(F.col("name")))
    keyed = known.withColumn("key", entity_key(F.col("name"))).filter(F.col("key") != "").withColumn("generic", is_generic(F.col("type")))
    keyed = keyed.withColumn("title_scope", F.lit(None).cast("string"))
    if {"dataset", "source_title", "scope_key"} <= set(rows.columns):
        own = F.lower(F.trim("dataset")).isin(TITLED_DATASETS) & (F.trim("scope_key") != "") & F.array_contains(title_variants(F.col("source_title")), F.col("key"))
        titled = keyed.withColumn("title_scope", F.when(F.coalesce(own, F.lit(False)), F.trim("scope_key")))
        several = titled.groupBy("key").agg(F.countDistinct("title_scope").alias("n")).filter("n > 1").select("key", F.lit(True).alias("several"))
        keyed = titled.join(several, "key", "left").withColumn("title_scope", F.when(F.col("several"), F.col("title_scope"))).drop("several")
    scope = F.coalesce("title_scope", F.lit("")).alias("scope")
    sizes = keyed.groupBy("key", scope, "generic", "type").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.filter("NOT generic").groupBy("key", "scope").agg(F.min(F.struct(-F.col("n"), F.col("type")))["type"].alias("main"))
    placed = keyed.withColumn("scope", scope).join(best, ["key", "scope"], "left").withColumn("bucket", F.when(F.col("generic"), F.coalesce("main", F.lit("Concept"))).otherwise(F.col("type")))
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    rank = F.struct((~F.col("generic")).cast("int").alias("s"), length("description").alias("d"), length("name").alias("l"), F.col("name"))
    return placed.groupBy("key", "bucket", "title_scope").agg(F.max(rank)["name"].alias("name"), F.count(F.lit(1)).alias("mentions"), F.array_sort(F.collect_set("name")).alias("all_names"))


def edge_key(edges: DataFrame) -> list[Column]:
    """What an edge is known by: ends, type, polarity, condition and, where there is one, quantity."""
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c)
    return [F.col("src"), F.col("rel_type"), F.col("dst"), F.col("negated"), text("condition"), *([text("quantitative")] if "quantitative" in edges.columns else [])]


def merge_relations(edges: DataFrame) -> DataFrame:
    """One edge for each identity (ends, type, polarity, condition): most certain confidence, questions and places as sorted sets."""
    return edges.groupBy(*edge_key(edges)).agg(
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("copies"),
        F.array_sort(F.collect_set("question_id")).alias("question_ids"),
        F.array_sort(F.collect_set("position")).alias("positions"),
    )


def contradictions(edges: DataFrame) -> DataFrame:
    """Identities but for polarity that are both affirmed and negated: number of edges either way."""
    yes, no = F.sum((~F.col("negated")).cast("long")), F.sum(F.col("negated").cast("long"))
    keys = [c for i, c in enumerate(edge_key(edges)) if i != 3]
    return edges.groupBy(*keys).agg(yes.alias("affirmed"), no.alias("denied")).filter("affirmed > 0 AND denied > 0")


def flagged_contradictions(edges: DataFrame) -> DataFrame:
    """The edges with ``contradicted``: whether an edge that is the same but for polarity has the other one."""
    clash = contradictions(edges)
    names = [name for name in clash.columns if name not in ("affirmed", "denied")]
    keys = [c.alias(f"{name}_key") for name, c in zip(names, [c for i, c in enumerate(edge_key(edges)) if i != 3], strict=True)]
    keyed = edges.select("*", *keys)
    met = keyed.join(clash.select(*(F.col(name).alias(f"{name}_key") for name in names), F.lit(True).alias("contradicted")), [f"{name}_key" for name in names], "left")
    return met.select(*edges.columns, F.coalesce("contradicted", F.lit(False)).alias("contradicted"))


def triple_confidence(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """How well chunks bear out (triple_id, source, target, group): 1 in one sentence, .7 one chunk, .4 apart, .3 one name, .1 neither, .5 without chunks."""
    hay = chunks.select("group", F.lower("text").alias("text"), F.split(F.lower("text"), r"(?<=[.!?])\s+").alias("sentences"))
    s, t = F.lower("source"), F.lower("target")
    joined = triples.join(hay, "group", "left")
    has_s, has_t = F.contains("text", s), F.contains("text", t)
    one = F.exists("sentences", lambda x: F.contains(x, s) & F.contains(x, t))
    found = joined.groupBy("triple_id").agg(F.count("text").alias("n"), F.bool_or(one).alias("sentence"), F.bool_or(has_s & has_t).alias("chunk"), F.bool_or(has_s).alias("s"), F.bool_or(has_t).alias("t"))
    score = F.when(F.col("n") == 0, 0.5).when(F.col("sentence"), 1.0).when(F.col("chunk"), 0.7).when(F.col("s") & F.col("t"), 0.4).when(F.col("s") | F.col("t"), 0.3).otherwise(0.1)
    return found.select("triple_id", score.alias("confidence"))


def adjusted_confidence(confidence: Column, status: Column, upstream: Column) -> Column:
    """At least .95 for restored triples that were sure upstream, at most .1 for failed ones."""
    return F.when((status == "full") & upstream, F.greatest(confidence, F.lit(0.95))).when(status == "failed", F.least(confidence, F.lit(0.1))).otherwise(confidence)


def node_specificity(mentions: DataFrame) -> DataFrame:
    """1 over the number of distinct chunks that mention an entity."""
    return mentions.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("passages")).withColumn("specificity", 1.0 / F.col("passages"))


def voted(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys that more than half of n samples hold; a sample has one vote."""
    return samples.groupBy(*keys).agg(F.countDistinct("sample_id").alias("votes")).filter(F.col("votes") >= n // 2 + 1)


def unconnected(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no edge touches."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return entities.join(ends, "entity_id", "left_anti")


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by id: the new type wins, names are appended in order (old first), nothing is lost."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy("entity_id").agg(F.max_by("type", "_v").alias("type"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_v", "all_names"))), lambda s: s["all_names"])).alias("all_names"))


def contiguous_groups(rows: DataFrame, partition: list[str], order: list[str], key: str) -> DataFrame:
    """Numbers runs of equal keys in order: a group begins whenever the key changes."""
    w = W.partitionBy(*partition).orderBy(*order)
    new = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w)).drop("_new")
