"""Typed demonstratives ("this disease") replaced by what the chunks before speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings that point back.
MARKERS = (
    r"(?i)\b(?:these\s+(?:conditions?|cells?|animals?|mice|rats?|patients?|results?|findings?|data)|"
    r"this\s+(?:model|system|treatment|context|approach|protocol|setup|condition|disease|disorder|syndrome|gene|protein|enzyme|receptor|biomarker)|"
    r"such\s+conditions?|under\s+these\s+(?:conditions?|circumstances?)|the\s+(?:treated|knockout|mutant|control)\s+(?:group|cells?|mice|animals?)|"
    r"the\s+above[-\s](?:mentioned\s+)?(?:conditions?|treatment|model|protocol)|as\s+(?:described|mentioned|stated)\s+(?:above|previously|earlier))\b"
)
# For each kind of thing the types that stand for it, words of a description that do, and what points back to it, in the order of replacement.
KINDS = {
    "disease": (["Disease", "MedicalCondition", "Condition", "Disorder"], ["disease", "condition", "disorder", "illness", "syndrome"], ("this|the", "disease|condition|disorder|syndrome")),
    "treatment": (["Treatment", "Drug", "Medication", "MedicalProcedure"], ["treatment", "therapy", "drug", "medication", "procedure"], ("this|the", "treatment|therapy|drug|medication|procedure")),
    "gene": (["Gene", "Genetic Mutation", "Genetic Variant", "Genetic Disorder"], ["gene", "mutation", "variant", "allele"], ("this|the", "gene|mutation|variant|allele")),
    "protein": (["Protein", "Biomarker", "Enzyme", "Receptor"], ["protein", "enzyme", "receptor", "biomarker"], ("this|the", "protein|enzyme|receptor|biomarker")),
    "patient": (["Patient", "PopulationGroup", "Person"], ["patient", "patients", "subject", "subjects", "cohort"], ("these|the", "patients|subjects|cases|participants")),
    "cell": (["Cell", "Cell Type", "CellType", "Cell Line"], ["cell", "cells", "line", "lines"], ("these|the", "cells|cell lines")),
    "animal": (["Organism", "PopulationGroup"], ["animal", "animals", "mouse", "mice", "rat", "rats"], ("these|the", "animals|mice|rats")),
    "model": (["Model", "Concept", "Biological System"], ["model", "system", "context", "protocol", "setup"], ("this|the", "model|system|protocol|setup|context")),
    "person": (["Person", "Physician"], ["person", "people", "actor", "director", "scientist"], ("this|the", "person|actor|director|scientist")),
    "organization": (["Organization", "Hospital", "Institute"], ["organization", "company", "museum", "institute", "university"], ("this|the", "organization|company|museum|institute|university")),
    "location": (["Location", "Anatomical Structure", "AnatomicalStructure"], ["city", "country", "state", "province", "location"], ("this|the", "city|country|state|province|location")),
    "work": (["Work", "CreativeWork", "Film"], ["film", "movie", "book", "song", "album", "series"], ("this|the", "film|movie|book|song|album|series")),
}
#: Chunks back that a demonstrative may point.
BACK = 2


def points_back(text: Column) -> Column:
    """Whether a text has a wording that points back."""
    return F.coalesce(text.rlike(MARKERS), F.lit(False))


def phrase_pattern(kind: str) -> str:
    before, nouns = KINDS[kind][2]
    return rf"(?i)\b(?:{before})\s+(?:{nouns})\b"


def kinds_of(entity_type: Column, description: Column) -> Column:
    """The kinds that an entity stands for, by its type or by a word of its description."""
    low = F.lower(F.coalesce(description, F.lit("")))
    cases = [F.when(F.coalesce(entity_type.isin(types), F.lit(False)) | F.arrays_overlap(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.array(*map(F.lit, words))), F.lit(kind)) for kind, (types, words, _) in KINDS.items()]
    return F.filter(F.array(*cases), lambda kind: kind.isNotNull())


def antecedents(entities: DataFrame, back: int = BACK) -> DataFrame:
    """(document, position, latest, by_kind) of each chunk that has entities in the ``back`` chunks before it.

    ``entities`` is (document, position, place, name, type, description): what a
    chunk speaks of, in order of ``place``. ``latest`` is the last name before
    the chunk, ``by_kind`` a map of kind to the last name that stands for it. An
    entity goes to the few chunks after its own, so no range of chunks is joined.
    """
    named = entities.filter(F.trim("name") != "")
    order = F.struct(F.col("position").alias("from"), "place", "name")
    ahead = named.select("document", F.explode(F.sequence(F.col("position") + 1, F.col("position") + back)).alias("target"), order.alias("at"), kinds_of(F.col("type"), F.col("description")).alias("kinds"))
    latest = ahead.groupBy("document", "target").agg(F.max("at")["name"].alias("latest"))
    kinds = ahead.select("document", "target", "at", F.explode("kinds").alias("kind")).groupBy("document", "target", "kind").agg(F.max("at")["name"].alias("name"))
    by_kind = kinds.groupBy("document", "target").agg(F.map_from_entries(F.collect_list(F.struct("kind", "name"))).alias("by_kind"))
    return latest.join(by_kind, ["document", "target"], "left").withColumnRenamed("target", "position")


def resolved(text: Column, latest: Column, by_kind: Column) -> Column:
    """The text with each pointing phrase replaced by the name of its kind, else by the latest name; as it is without names or wordings that point back."""
    literal = lambda name: F.regexp_replace(name, r"([\\$])", r"\\$1")
    out = text
    for kind in KINDS:
        name = F.coalesce(F.try_element_at(by_kind, F.lit(kind)), latest, F.lit(""))
        out = F.regexp_replace(out, F.lit(phrase_pattern(kind)), literal(name))
    return F.when(points_back(text) & latest.isNotNull(), out).otherwise(text)


def resolved_chunks(chunks: DataFrame, entities: DataFrame, back: int = BACK) -> DataFrame:
    """The chunks (document, position, text) with ``resolved_text``: pointing phrases give way to what the chunks before speak of."""
    met = chunks.join(antecedents(entities, back), ["document", "position"], "left")
    return met.withColumn("resolved_text", resolved(F.col("text"), F.col("latest"), F.col("by_kind"))).drop("latest", "by_kind")
