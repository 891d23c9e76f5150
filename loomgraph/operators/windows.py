"""Windows of neighbouring segments from which relations are asked for, and places that are unique across passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.naming import appears_in
from loomgraph.sources.shared import stored

#: Entities that a prompt for relations names, at most.
POOL = 40


def global_places(chunks: DataFrame, order: list[str], local: str) -> DataFrame:
    """The chunks with ``position``: their place in their passage after all chunks of the passages before, in the passages' order.

    Passages are dealt out by ranges of their order; each range's chunks are
    summed by themselves, and the ranges' totals, of which there are as many as
    partitions, are added up once.
    """
    sizes = chunks.groupBy(*order).agg(F.count(F.lit(1)).alias("size"))
    placed = stored(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "places")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = placed.groupBy("part").agg(F.sum("size").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offsets = placed.withColumn("inside", inside).join(F.broadcast(before), "part").select(*order, (F.col("before") + F.col("inside")).alias("offset"))
    return chunks.join(offsets, order).withColumn("position", F.col("offset") + F.col(local)).drop("offset")


def relation_windows(segments: DataFrame, entities: DataFrame, most: int = 3, pool: int = POOL) -> DataFrame:
    """(scope, start, width, text, positions, entities): runs of 2..most neighbouring segments with the entities that a relation may join in them.

    ``segments`` is (scope, place, text, position) with places counted from any
    number on without gaps, ``entities`` (scope, place, entity_id, names). A
    window's entities are those of its segments that stand in its text, each
    once; of more than ``pool`` those with most names in the text, then the
    longest name, then the least id. Windows without text or with fewer than two
    entities are left out.
    """
    w = W.partitionBy("scope").orderBy("place").rowsBetween(0, most - 1)
    gathered = segments.select("scope", F.col("place").alias("start"), F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text"), "position")).over(w).alias("run"))
    widths = gathered.withColumn("width", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("run"))))).filter(F.col("width") <= F.size("run"))
    text = F.array_join(F.filter(F.transform("run", lambda s: s["text"]), lambda t: F.trim(t) != ""), "\n\n")
    windows = widths.withColumn("run", F.slice("run", F.lit(1), F.col("width"))).select("scope", "start", "width", text.alias("text"), F.transform("run", lambda s: s["position"]).alias("positions"), F.transform("run", lambda s: s["place"]).alias("places"))
    windows = windows.filter(F.trim("text") != "")
    met = windows.select("scope", "start", "width", "text", F.explode("places").alias("place")).join(entities, ["scope", "place"])
    given = F.array_distinct(F.flatten(F.collect_list("names")))
    each = met.groupBy("scope", "start", "width", "entity_id").agg(F.first("text").alias("text"), given.alias("names")).filter(appears_in(F.col("text"), F.col("names")))
    low = F.lower("text")
    held = F.size(F.filter("names", lambda n: F.contains(low, F.lower(n))))
    longest = F.array_max(F.transform("names", lambda n: F.length(n)))
    order = W.partitionBy("scope", "start", "width").orderBy(F.desc("held"), F.desc("longest"), "entity_id")
    ranked = each.select("scope", "start", "width", "entity_id", held.alias("held"), longest.alias("longest")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= pool)
    chosen = ranked.groupBy("scope", "start", "width").agg(F.array_sort(F.collect_list("entity_id")).alias("entities")).filter(F.size("entities") >= 2)
    return windows.drop("places").join(chosen, ["scope", "start", "width"])
