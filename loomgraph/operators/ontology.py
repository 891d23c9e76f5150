"""Typing of entities and relations by an ontology.

An ontology is two small tables: types (id, label) and relations (id, label,
domain, range). They are broadcast behind a check of their size. Fuzzy matches
are made over distinct raw names, so the work follows the number of spellings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import match_ratio
from loomgraph.operators.alike import similar_names
from loomgraph.operators.retrieve import held_texts, vector_top_k

#: Rows up to which an ontology table is broadcast.
SMALL = 50_000
# Ids that stand for anything.
GENERIC_TYPES = ["concept", "entity", "thing", "unknown", "other"]
GENERIC_RELATIONS = ["related_to", "associated_with", "connects_to", "linked_to"]


def identifier(name: Column) -> Column:
    """Lower case with single underscores for spaces and hyphens."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def match_types(names: DataFrame, types: DataFrame, least: float = 0.80) -> DataFrame:
    """(raw, type_id, score): each distinct raw name's type, by equal id or label, else the most alike from ``least`` up; null if none."""
    raw = names.select("raw").distinct().withColumn("key", identifier(F.col("raw"))).filter("key <> ''")
    forms = types.select(F.col("id").alias("type_id"), F.explode(F.array_distinct(F.array(identifier(F.col("id")), identifier(F.col("label"))))).alias("form")).filter("form <> ''")
    alike = similar_names(raw.select(F.col("key").alias("name")), forms.select(F.col("form").alias("name")), least).select(F.col("a").alias("key"), F.col("b").alias("form"), F.when(F.col("a") == F.col("b"), 2.0).otherwise(F.col("ratio")).alias("score"))
    met = alike.join(forms, "form").groupBy("key").agg(F.max(F.struct("score", F.struct((-F.ascii("type_id")).alias("a"), "type_id"))).alias("b"))
    best = raw.join(met, "key", "left")
    return best.select("raw", F.col("b.col2.type_id").alias("type_id"), F.when(F.col("b.score").isNotNull(), F.least(F.col("b.score"), F.lit(1.0))).alias("score"))


def coerce_types(entities: DataFrame, types: DataFrame, least: float = 0.80) -> DataFrame:
    """Entities (entity_id, name, type) with the ontology's type: by their type, else a type that is their name, else the generic type; others go."""
    by_type = match_types(entities.select(F.col("type").alias("raw")), types, least).withColumnsRenamed({"raw": "type", "type_id": "_by_type"}).drop("score")
    exact = types.select(identifier(F.col("id")).alias("_key"), F.col("id").alias("_by_name")).dropDuplicates(["_key"])
    generic = types.filter(identifier(F.col("id")).isin(GENERIC_TYPES)).agg(F.min("id").alias("_generic"))
    typed = entities.join(by_type, "type", "left").withColumn("_key", identifier(F.col("name"))).join(_small(exact), "_key", "left").join(F.broadcast(generic))  # one row
    return typed.withColumn("type_id", F.coalesce("_by_type", "_by_name", "_generic")).filter("type_id IS NOT NULL").drop("_by_type", "_by_name", "_generic", "_key")


#: Cosine from which a class's vector types an entity.
LEAST_COSINE = 0.50
# Words that tell a type, and a relation, where nothing else does.
TYPE_WORDS = {
    "Disease": ["disease", "cancer", "tumor", "syndrome", "disorder", "carcinoma", "malignancy"],
    "Treatment": ["drug", "medication", "treatment", "therapy", "surgery", "chemotherapy", "radiotherapy"],
    "Patient": ["patient", "person", "individual", "male", "female"],
    "Physician": ["doctor", "physician", "surgeon", "specialist", "oncologist", "urologist"],
    "Hospital": ["hospital", "clinic", "center", "institute", "department"],
    "Symptom": ["symptom", "sign", "manifestation", "pain", "fever"],
    "Biomarker": ["gene", "mutation", "protein", "biomarker", "receptor", "marker"],
    "ClinicalFinding": ["score", "grade", "stage", "classification", "risk"],
}
FALLBACK_TYPE, FALLBACK_RELATION = "Concept", "RELATED_TO"


def _holds_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def classified_entities(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """(entity_id, class_id, by): a class for every entity (entity_id, number, name, embedding) by the first step that finds one.

    ``classes`` is (id, label, number, embedding), numbers in the ontology's
    order. Steps: the class of the nearest vector from a cosine of .5 up; the
    first class whose id or label stands in the name; what a word of the name
    tells, if the ontology has it; the ontology's generic class; else what the
    word tells. Each step gets only the entities that the one before left.
    """
    asked = entities.filter(F.col("embedding").isNotNull()).select(F.col("number").alias("query_id"), "embedding")
    vectors = classes.filter(F.col("embedding").isNotNull()).select(F.col("number").alias("vec_id"), "embedding")
    near = vector_top_k(asked, vectors, 1, threshold=LEAST_COSINE).select(F.col("query_id").alias("number"), F.col("vec_id").alias("class_number"))
    by_vector = entities.join(near, "number").join(classes.select(F.col("number").alias("class_number"), F.col("id").alias("class_id")), "class_number").select("entity_id", "class_id", F.lit("vector").alias("by"))

    left = entities.join(by_vector.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lower("name").alias("name"))
    forms = classes.select("number", F.col("id").alias("class_id"), F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("label")))).alias("form")).filter("form <> ''")
    held = held_texts(forms.select(F.col("form").alias("needle")).distinct(), left.select(F.col("name").alias("hay")).distinct()).select(F.col("needle").alias("form"), F.col("hay").alias("name"))
    first = held.join(forms, "form").groupBy("name").agg(F.min_by("class_id", "number").alias("class_id"))
    by_name = left.join(first, "name").select("entity_id", "class_id", F.lit("name").alias("by"))

    rest = left.join(by_name.select("entity_id"), "entity_id", "left_anti")
    told = F.lit(FALLBACK_TYPE)
    for name, words in reversed(TYPE_WORDS.items()):
        told = F.when(_holds_any(F.col("name"), words), name).otherwise(told)
    known = classes.select(identifier(F.col("id")).alias("key"), "number", F.col("id").alias("own")).groupBy("key").agg(F.min_by("own", "number").alias("own"))
    generic = classes.filter(identifier(F.col("id")).isin(GENERIC_TYPES)).agg(F.min_by("id", "number").alias("generic"))
    word = rest.withColumn("told", told).withColumn("key", identifier(F.col("told"))).join(known, "key", "left").join(F.broadcast(generic))  # one row
    by = F.when(F.col("own").isNotNull(), "word").when(F.col("generic").isNotNull(), "generic").otherwise("fallback")
    return by_vector.unionByName(by_name).unionByName(word.select("entity_id", F.coalesce("own", "generic", "told").alias("class_id"), by.alias("by")))


def classified_relations(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """(pair_id, relation): a relation for each pair (pair_id, source, target, source_type, target_type).

    Of the ontology's relations that fit the types the one whose label is most
    like the two names, ties by id; where none fits, what words of the names tell.
    """
    typed = pairs.select("source_type", "target_type").distinct()
    fits = compatible_relations(typed, relations).join(relations.select(F.col("id").alias("relation"), "label"), "relation")
    met = pairs.join(fits, ["source_type", "target_type"])
    scored = met.withColumn("ratio", match_ratio(F.lower("label"), F.lower(F.concat_ws(" ", "source", "target"))))
    order = W.partitionBy("pair_id").orderBy(F.desc("ratio"), "relation")
    best = scored.withColumn("r", F.row_number().over(order)).filter("r = 1").select("pair_id", F.upper(F.translate("relation", " -", "__")).alias("relation"))
    rest = pairs.join(best.select("pair_id"), "pair_id", "left_anti")
    a, b = F.lower("source"), F.lower("target")
    cure = ["treatment", "therapy", "drug"]
    told = F.when(_holds_any(a, cure) | _holds_any(b, cure), "TREATS").when(_holds_any(a, ["disease", "cancer"]) & _holds_any(b, ["symptom", "sign"]), "HAS_SYMPTOM").when(_holds_any(a, ["physician", "doctor"]) & _holds_any(b, ["patient", "person"]), "DIAGNOSES").otherwise(FALLBACK_RELATION)
    return best.unionByName(rest.select("pair_id", told.alias("relation")))


def compatible_relations(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_type, target_type, relation, fit): relations whose domain and range are open or equal; 0 both equal, 1 one, 2 both open."""
    lower = lambda name: F.lower(F.col(name))
    same = lambda own, asked: F.col(own).isNull() | (lower(own) == lower(asked))
    met = pairs.join(_small(relations.select(F.col("id").alias("relation"), "domain", "range")), same("domain", "source_type") & same("range", "target_type"))
    fit = F.col("domain").isNull().cast("int") + F.col("range").isNull().cast("int")
    return met.select("source_type", "target_type", "relation", fit.alias("fit"))


def canonical_relations(edges: DataFrame, relations: DataFrame, least: float = 0.72, boost: float = 0.10) -> DataFrame:
    """Edges (edge_id, rel_type, source_type, target_type) with the ontology's relation.

    An equal id or label that fits the types comes first, then an equal one,
    then the most alike from ``least`` up, where a fit adds ``boost``; else the
    generic relation, or null.
    """
    asked = edges.select("rel_type", "source_type", "target_type").distinct()
    forms = relations.select(F.col("id").alias("relation"), "domain", "range", F.explode(F.array_distinct(F.array(identifier(F.col("id")), identifier(F.col("label"))))).alias("form"))
    fits = (F.col("domain").isNull() | (F.lower("domain") == F.lower("source_type"))) & (F.col("range").isNull() | (F.lower("range") == F.lower("target_type")))
    keyed = asked.withColumn("key", identifier(F.col("rel_type")))
    near = similar_names(keyed.select(F.col("key").alias("name")), forms.select(F.col("form").alias("name")), least - boost).select(F.col("a").alias("key"), F.col("b").alias("form"), "ratio")
    scored = keyed.join(near, "key", "left").join(forms, "form", "left").withColumn("fits", F.coalesce(fits & F.col("relation").isNotNull(), F.lit(False)))
    alike = F.coalesce("ratio", F.lit(0.0)) + F.when(F.col("fits"), boost).otherwise(0.0)
    score = F.when((F.col("key") == F.col("form")) & F.col("fits"), 9.0).when(F.col("key") == F.col("form"), 8.0).otherwise(alike)
    order = W.partitionBy("rel_type", "source_type", "target_type").orderBy(F.desc("score"), "relation")
    best = scored.withColumn("score", score).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    generic = relations.filter(identifier(F.col("id")).isin(GENERIC_RELATIONS)).agg(F.min("id").alias("_generic"))
    named = best.join(F.broadcast(generic)).select("rel_type", "source_type", "target_type", F.when(F.col("score") >= least, F.col("relation")).otherwise(F.col("_generic")).alias("relation"))
    return edges.join(named, ["rel_type", "source_type", "target_type"], "left")


def enforce_schema(entities: DataFrame, edges: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with a type of the ontology, and the edges whose ends are among them."""
    kept = coerce_types(entities, types)
    ids = kept.select("entity_id")
    return kept, edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def typed_view(entities: DataFrame, edges: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph as an ontology's view shows it: nodes (entity_id, label, type) with the ontology's types, and the edges (src, dst, label) between them.

    A node's label is its name, else its id; an edge's is its type in words.
    """
    kept, inside = enforce_schema(entities, edges, types)
    label = F.coalesce(F.when(F.trim("name") != "", F.trim("name")), F.col("entity_id"))
    return kept.select("entity_id", label.alias("label"), F.col("type_id").alias("type")), inside.select("src", "dst", F.lower(F.translate("rel_type", "_", " ")).alias("label"))
