"""Sums over all rows before, in an order, for groups larger than a task.

Rows are dealt out by ranges of group and order, so a large group is many
ranges. Each range sums by itself; the ranges' totals, as many rows as there are
ranges and groups in them, are added up and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.sources.shared import stored


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """The rows with, for each name, the sum of its column up to and with the row, in the group's ``order``, which is to tell all its rows apart."""
    group = [F.col(key) for key in keys]
    placed = stored(rows.withColumns({f"own_{name}": column for name, column in sums.items()}).repartitionByRange(*group, *order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = placed.groupBy("range", *keys).agg(*(F.sum(f"own_{name}").alias(f"all_{name}") for name in sums))
    earlier = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("range", *keys, *(F.coalesce(F.sum(f"all_{name}").over(earlier), F.lit(0)).alias(f"before_{name}") for name in sums))
    whole = placed.withColumns({f"inside_{name}": F.sum(f"own_{name}").over(inside) for name in sums}).alias("w").join(before.alias("b"), [F.col("w.range") == F.col("b.range"), *(F.col(f"w.{key}").eqNullSafe(F.col(f"b.{key}")) for key in keys)])
    return whole.select(*(F.col(f"w.{name}") for name in rows.columns), *((F.col(f"w.inside_{name}") + F.col(f"b.before_{name}")).alias(name) for name in sums))


def ranked_values(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, value, out): the average rank, from 1, that the rows of each distinct value have in their group."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("equal"))
    upto = running_sums(counts, keys, [F.col(value)], upto=F.col("equal"))
    return upto.select(*keys, value, (F.col("upto") - (F.col("equal") - 1) / 2.0).alias(out))
