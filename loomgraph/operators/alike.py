"""Joins of names that are spelled alike, without comparing every two: endpoints of relations, types, synonyms.

Likeness is the ratio of matching blocks. What two names match is at most what
letters they have in common, so a ratio from ``least`` up asks for a number of
common letters that follows from the lengths. Each name's letters are numbered
by their occurrence ("a1", "a2") and ordered by how rare they are; two names
with enough in common share one among the first few of either. So names meet
in an equi-join on those, are held to the bounds by built-in functions, and the
ratio is worked out for what is left. No pair above the threshold is lost.

Letters are few, so names of one length are met by most others through them.
Where the threshold leaves few characters to take out of two lengths until the
names are one text, names meet on what is left instead: hardly any others do.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import match_ratio
from loomgraph.functions.naming import candidate_names
from loomgraph.functions.text import entity_key, name_variants, shortened

#: Shortened forms of a name, at most, by which names of two lengths meet; where there are more they meet by letters.
FORMS = 500
#: Rounding of bounds on whole numbers of letters.
SLACK = 1e-9
# Scores of an endpoint that one name holds the other, and of shared words; what resolves an end, and by how much.
HELD, WORDS, LEAST_HELD = 0.94, 0.92, 4
RESOLVED, AHEAD = 0.90, 0.03


def numbered_letters(text: Column) -> Column:
    """Each character with the number of its occurrence."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    counts = lambda c, i: F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda d: d == c))
    return F.transform(letters, lambda c, i: F.concat(c, counts(c, i).cast("string")))


def possible_ratio(a: Column, b: Column, least: float) -> Column:
    """Whether numbered letters in common allow a ratio from ``least`` up."""
    return 2 * F.size(F.array_intersect(a, b)) >= least * (F.size(a) + F.size(b)) - SLACK


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): the names of two tables (name) whose ratio is ``least`` (above 0) or more; each name once, blank and null ones in no pair."""
    named = lambda rows: rows.select("name").filter(F.col("name") != "").distinct()
    names = {"a": named(left), "b": named(right)}
    lengths = {side: sorted(row[0] for row in rows.select(F.length("name")).distinct().collect()) for side, rows in names.items()}  # one number a length
    few, many = [], []
    for n in lengths["a"]:
        for m in lengths["b"]:
            common = max(1, ceil(least * (n + m) / 2 - SLACK))
            if common <= min(n, m):
                (few if max(comb(n, common), comb(m, common)) <= FORMS else many).append((n, m, common))
    near = _met_shortened(names, few)
    if many:
        near = near.unionByName(_met_by_letters(names, many, least))
    return near.withColumn("ratio", match_ratio("a", "b")).filter(F.col("ratio") >= least)


def _met_shortened(names: dict[str, DataFrame], few: list[tuple[int, int, int]]) -> DataFrame:
    """(a, b): names of the given pairs of lengths that have the given number of characters in common, in order."""
    spark = names["a"].sparkSession
    kinds = F.broadcast(spark.createDataFrame(few, "n int, m int, common int"))  # pairs of lengths

    def forms(side: str, own: str) -> DataFrame:
        most = max([(n, m)[own == "m"] - common for n, m, common in few], default=0)
        rows = names[side].withColumn(own, F.length("name")).join(kinds, own)
        return rows.select(F.col("name").alias(side), "n", "m", F.explode(shortened(F.col("name"), F.col(own) - F.col("common"), most)).alias("form"))

    return forms("a", "n").join(forms("b", "m"), ["n", "m", "form"]).select("a", "b").distinct()


def _met_by_letters(names: dict[str, DataFrame], many: list[tuple[int, int, int]], least: float) -> DataFrame:
    """(a, b): names of the given pairs of lengths whose letters allow the ratio."""
    spark = names["a"].sparkSession
    kinds = F.broadcast(spark.createDataFrame(many, "n int, m int, common int"))
    sides = {side: names[side].join(kinds.select(F.col(own).alias("_n")).distinct(), F.length("name") == F.col("_n")).select("name", numbered_letters(F.col("name")).alias("letters")) for side, own in (("a", "n"), ("b", "m"))}
    often = sides["a"].select(F.explode("letters").alias("letter")).unionByName(sides["b"].select(F.explode("letters").alias("letter"))).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(side: str) -> DataFrame:
        """The rarest letters, so many that a name with enough in common has one of them: all but those of the least overlap, plus one."""
        size = F.size("letters")
        overlap = F.ceil(least * size / (2 - least) - SLACK)  # with the shortest partner that the ratio allows
        rows = sides[side].select("name", (size - overlap + 1).alias("first"), F.explode("letters").alias("letter")).join(often, "letter")
        ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("n", "letter")))
        return ranked.filter(F.col("r") <= F.col("first")).select(F.col("name").alias(side), "letter")

    met = prefixes("a").join(prefixes("b"), "letter").select("a", "b").distinct()
    met = met.join(kinds, (F.length("a") == F.col("n")) & (F.length("b") == F.col("m")), "left_semi")
    for side in "ab":
        met = met.join(sides[side].select(F.col("name").alias(side), F.col("letters").alias(f"letters_{side}")), side)
    return met.filter(possible_ratio(F.col("letters_a"), F.col("letters_b"), least)).select("a", "b")


def end_score(raw: Column, candidate: Column, ratio: Column) -> Column:
    """How surely a candidate's key is what an end's key means: equal 1, one holding the other .94 (four letters), else the ratio or .92 of the shared words."""
    a, b = F.split(raw, "_"), F.split(candidate, "_")
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))
    holds = F.contains(raw, candidate) | F.contains(candidate, raw)
    short = F.least(F.length(raw), F.length(candidate)) < LEAST_HELD
    return F.when(raw == candidate, 1.0).when(holds, F.when(short, 0.0).otherwise(HELD)).otherwise(F.greatest(F.coalesce(ratio, F.lit(0.0)), WORDS * shared))


def resolved_endpoints(ends: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, raw, entity_id): what the ends (chunk_id, raw) of a chunk's relations mean among its extracted entities (chunk_id, entity_id, name, all_names, aliases).

    An end whose variants are an entity's, whatever their case, means that one,
    if several then the one of that very id. Else the entity of the greatest
    score, if it has .90 and is .03 ahead of the next. Ends that mean nothing
    have no row. Names of one chunk meet by its id; only those whose letters
    allow it are compared by ratio.
    """
    lists = [F.col(name) for name in ("all_names", "aliases") if name in entities.columns]
    low = lambda names: F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))
    asked = ends.select("chunk_id", F.trim("raw").alias("end"), "raw").filter("end <> ''").distinct()
    asked = asked.withColumn("variants", low(name_variants(F.col("end")))).withColumn("key", entity_key(F.col("end")))
    known = entities.filter(F.trim("entity_id") != "").select("chunk_id", "entity_id", candidate_names(F.col("entity_id"), F.col("name"), *lists).alias("names"))
    known = known.select("chunk_id", "entity_id", low(F.flatten(F.transform("names", name_variants))).alias("forms"))
    met = asked.join(known, "chunk_id").withColumn("direct", F.arrays_overlap("variants", "forms"))

    same = (F.lower("entity_id") == F.lower("end")).cast("int")
    direct = met.filter("direct").groupBy("chunk_id", "raw").agg(F.countDistinct("entity_id").alias("n"), F.max(F.struct(same.alias("same"), "entity_id")).alias("best"))
    told = direct.filter((F.col("n") == 1) | (F.col("best.same") == 1)).select("chunk_id", "raw", "best.entity_id")

    open_ = met.filter("NOT direct").join(direct.select("chunk_id", "raw"), ["chunk_id", "raw"], "left_anti")
    pairs = open_.select("chunk_id", "raw", "entity_id", "key", F.explode(F.array_distinct(F.transform("forms", entity_key))).alias("form")).filter("key <> '' AND form <> ''")
    least = RESOLVED - AHEAD  # a lower score neither resolves an end nor stands in another's way
    near = pairs.select("key", "form").distinct().filter(possible_ratio(numbered_letters(F.col("key")), numbered_letters(F.col("form")), least)).withColumn("ratio", match_ratio("key", "form"))
    scored = pairs.join(near, ["key", "form"], "left").withColumn("score", end_score(F.col("key"), F.col("form"), F.col("ratio")))
    each = scored.groupBy("chunk_id", "raw", "entity_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("chunk_id", "raw").orderBy(F.desc("score"), "entity_id")
    ranked = each.withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0))).withColumn("r", F.row_number().over(order)).filter("r = 1")
    sure = ranked.filter((F.col("score") >= RESOLVED) & (F.col("score") - F.col("next") >= AHEAD - SLACK)).select("chunk_id", "raw", "entity_id")
    return told.unionByName(sure)


def fuzzy_ends(edges: DataFrame, names: DataFrame, least: float = RESOLVED) -> DataFrame:
    """(name, entity_id): for the end names (source, target) of edges that no key of ``names`` (key, entity_id) stands for, the entity of the most alike key.

    Its ratio is ``least`` or more and .03 ahead of the next entity's.
    """
    asked = edges.select(F.explode(F.array("source", "target")).alias("raw")).distinct().withColumn("key", entity_key(F.col("raw"))).filter("key <> ''")
    open_ = asked.join(names.select("key"), "key", "left_anti")
    alike = similar_names(open_.select(F.col("key").alias("name")), names.select(F.col("key").alias("name")), least - AHEAD)
    best = alike.join(names.withColumnRenamed("key", "b"), "b").groupBy("a", "entity_id").agg(F.max("ratio").alias("ratio"))
    order = W.partitionBy("a").orderBy(F.desc("ratio"), "entity_id")
    ranked = best.withColumn("next", F.coalesce(F.lead("ratio").over(order), F.lit(0.0))).withColumn("r", F.row_number().over(order))
    sure = ranked.filter((F.col("r") == 1) & (F.col("ratio") >= least) & (F.col("ratio") - F.col("next") >= AHEAD - SLACK))
    return open_.join(sure.select(F.col("a").alias("key"), "entity_id"), "key").select(F.col("raw").alias("name"), "entity_id")
