"""Selective-prediction statistics over evaluated answers.

Every function takes a long table of rows with a group, a boolean that says
whether the answer is wrong, and an uncertainty, and returns one row a group.
Rows with a null uncertainty are left out. Where a statistic is undefined the
result is null. Ties are broken by the id column, so results are deterministic.
Groups are data-sized: ranks and running sums are worked out by ranges of the
score (see :mod:`loomgraph.operators.running`), everything else by aggregates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.operators.running import ranked_values, running_sums
from loomgraph.sources.shared import stored


def _in_order(df: DataFrame, keys: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """The rows with their place in their group, its size and running sums."""
    rows = running_sums(df, keys, order, place=F.lit(1), **sums)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return rows.alias("r").join(sizes.alias("s"), [F.col(f"r.{key}").eqNullSafe(F.col(f"s.{key}")) for key in keys]).select("r.*", "s.size")


def auroc(df: DataFrame, keys: list[str], wrong: str = "wrong", score: str = "u") -> DataFrame:
    """Probability that a wrong answer is more uncertain than a right one, ties by half; null unless both occur."""
    told = F.col(wrong).cast("long")
    values = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(told).alias("w"), F.sum(1 - told).alias("r"))
    below = running_sums(values, keys, [F.col(score)], upto=F.col("r"))
    hits = F.sum(F.col("w") * (F.col("upto") - F.col("r") / 2.0))
    n1, n0 = F.sum("w"), F.sum("r")
    return below.groupBy(*keys).agg(F.when((n1 > 0) & (n0 > 0), hits / (n1 * n0)).alias("auroc"), (n1 + n0).alias("n"))


def aurec(df: DataFrame, keys: list[str], wrong: str = "wrong", score: str = "u", id_column: str = "question_id") -> DataFrame:
    """Mean error rate of the least uncertain k answers, over every k."""
    rows = running_sums(df.filter(F.col(score).isNotNull()).select(*keys, score, id_column, wrong), keys, [F.col(score), F.col(id_column)], place=F.lit(1), upto=F.col(wrong).cast("long"))
    return rows.groupBy(*keys).agg(F.avg(F.col("upto") / F.col("place")).alias("aurec"))


def ppv_at(df: DataFrame, keys: list[str], fractions: list[float], wrong: str = "wrong", score: str = "u", id_column: str = "question_id") -> DataFrame:
    """Share of wrong answers among the most uncertain n * f, rounded up; null below four answers."""
    ranked = _in_order(df.filter(F.col(score).isNotNull()).select(*keys, score, id_column, wrong), keys, [F.desc(score), F.col(id_column)])
    share = lambda f: F.avg(F.when(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("size") * f)), F.col(wrong).cast("double")))
    columns = [F.when(F.count(F.lit(1)) >= 4, share(f)).alias(f"ppv_{round(100 * f)}") for f in fractions]
    return ranked.groupBy(*keys).agg(*columns, F.avg(F.col(wrong).cast("double")).alias("base_error"))


def calibration_bins(df: DataFrame, keys: list[str], wrong: str = "wrong", score: str = "u", bins: int = 10) -> DataFrame:
    """Confidence 1 - minmax(u) in equal bins: size, mean confidence and accuracy of each that has rows."""
    group = W.partitionBy(*keys)
    spread = F.max(score).over(group) - F.min(score).over(group)
    scaled = df.filter(F.col(score).isNotNull()).withColumn("_range", spread).withColumn("_conf", F.when(F.col("_range") >= 1e-12, 1 - (F.col(score) - F.min(score).over(group)) / F.col("_range")))
    binned = scaled.filter(F.col("_conf").isNotNull()).withColumn("bin", F.least(F.floor(F.round(F.col("_conf") * bins, 9)), F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_conf").alias("confidence"), F.avg((~F.col(wrong)).cast("double")).alias("accuracy"))


def ece(df: DataFrame, keys: list[str], wrong: str = "wrong", score: str = "u", bins: int = 10) -> DataFrame:
    """Expected calibration error; null for a flat metric, under four rows, or under half of the bins filled."""
    filled = calibration_bins(df, keys, wrong, score, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")
    enough = (F.sum("n") >= 4) & (F.count(F.lit(1)) >= max(2, bins // 2))
    return filled.groupBy(*keys).agg(F.when(enough, gap).alias("ece"), F.count(F.lit(1)).alias("filled_bins"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval, within 0..1."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def selective_risk(df: DataFrame, keys: list[str], coverages: list[float], wrong: str = "wrong", score: str = "u", id_column: str = "question_id") -> DataFrame:
    """Error rate among the least uncertain answers at each coverage; the number is rounded half to even."""
    ranked = _in_order(df.filter(F.col(score).isNotNull()).select(*keys, score, id_column, wrong), keys, [F.col(score), F.col(id_column)])
    kept = lambda c: F.greatest(F.lit(1), F.bround(F.col("size") * c, 0))
    return ranked.groupBy(*keys).agg(*[F.avg(F.when(F.col("place") <= kept(c), F.col(wrong).cast("double"))).alias(f"risk_{round(100 * c)}") for c in coverages])


def percentile_rank(df: DataFrame, keys: list[str], score: str, out: str, id_column: str = "question_id") -> DataFrame:
    """i / (n - 1) in a stable sort; ties get ranks in the order of their id."""
    ranked = _in_order(df, keys, [F.col(score), F.col(id_column)])
    share = F.when(F.col("size") > 1, (F.col("place") - 1) / (F.col("size") - 1)).otherwise(0.0)
    return ranked.select(*df.columns, share.alias(out))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation on midranks, over rows where both are given."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    for name in "xy":
        ranks = ranked_values(rows, keys, name, f"{name}_rank")
        pairs = pairs.alias("p").join(ranks.alias("k"), [*(F.col(f"p.{key}").eqNullSafe(F.col(f"k.{key}")) for key in keys), F.col(f"p.{name}") == F.col(f"k.{name}")]).select("p.*", f"k.{name}_rank")
    weighed = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    n, mean = F.sum("n"), (F.sum("n") + 1) / 2.0  # of midranks
    spread = lambda a: weighed(f"{a}_rank", f"{a}_rank") - n * mean * mean
    across = weighed("x_rank", "y_rank") - n * mean * mean
    return pairs.groupBy(*keys).agg(F.when((spread("x") > 0) & (spread("y") > 0), across / F.sqrt(spread("x") * spread("y"))).alias("rho"), n.alias("n"))


def mantel_haenszel(df: DataFrame, keys: list[str], stratum: str, exposed: str, outcome: str) -> DataFrame:
    """Odds ratio pooled over strata; null if the denominator is 0."""
    cell = lambda e, o: F.sum(((F.col(exposed) == e) & (F.col(outcome) == o)).cast("double"))
    tables = df.groupBy(*keys, stratum).agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"), F.count(F.lit(1)).alias("n"))
    up, down = F.sum(F.col("a") * F.col("d") / F.col("n")), F.sum(F.col("b") * F.col("c") / F.col("n"))
    pooled = (F.sum("a") + 0.5) * (F.sum("d") + 0.5) / ((F.sum("b") + 0.5) * (F.sum("c") + 0.5))
    return tables.groupBy(*keys).agg(F.when(down > 0, up / down).alias("odds_ratio"), pooled.alias("haldane_ratio"), F.count(F.lit(1)).alias("strata"))


def kappa(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Agreement of two boolean ratings and Cohen's kappa; 1 where chance agreement is certain."""
    a, b = F.avg(F.col(first).cast("double")), F.avg(F.col(second).cast("double"))
    observed = F.avg((F.col(first) == F.col(second)).cast("double"))
    chance = a * b + (1 - a) * (1 - b)
    return df.groupBy(*keys).agg(observed.alias("agreement"), F.when(chance < 1, (observed - chance) / (1 - chance)).otherwise(1.0).alias("kappa"))


#: Poisson(1) as steps of its distribution function: a draw above so many of them counts a row so often.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
#: Draws that one digest of a row gives weights for.
DRAWS_EACH = 4


def row_weights(ids: list, draws: int, seed: int) -> np.ndarray:
    """How often each row counts in each draw, from a digest of seed, number of four draws and id: one line a row."""
    blocks = -(-draws // DRAWS_EACH)
    digests = b"".join(hashlib.md5(f"{seed}|{block}|{key}".encode()).digest() for key in ids for block in range(blocks))
    unit = (np.frombuffer(digests, ">u4").reshape(len(ids), blocks * DRAWS_EACH)[:, :draws] + 0.5) / 2.0**32
    return (unit[:, :, None] > np.array(POISSON)).sum(axis=2)


def bootstrap_auroc(df: DataFrame, keys: list[str], wrong: str = "wrong", score: str = "u", draws: int = 200, seed: int = 42, id_column: str = "question_id") -> DataFrame:
    """2.5 and 97.5 percentiles of the AUROC over resamples of each group.

    A row's weight in a draw is Poisson(1) (the bootstrap of data too large to
    draw with replacement), taken from a hash of the draw and the row's id, so
    it is the same in every run and on any partitioning. Rows are dealt out by
    ranges of the score once and read in order; each range adds up, for all
    draws together, its own pairs and weights, and pairs across ranges follow
    from the ranges' totals.
    """
    rows = df.filter(F.col(score).isNotNull()).select(*keys, F.col(score).cast("double").alias("score"), F.col(wrong).cast("boolean").alias("wrong"), F.col(id_column).cast("string").alias("id"))
    sorted_rows = rows.repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")
    kinds = ", ".join(f"`{key}` {rows.schema[key].dataType.simpleString()}" for key in keys)
    width = len(keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = None, []
        hits = right = ones = equal_right = equal_ones = np.zeros(draws)
        last = None

        def close() -> None:
            """Count the rows of the last score, whose right ones stand half below its wrong ones."""
            nonlocal hits, right, ones, equal_right, equal_ones
            hits = hits + equal_ones * (right + equal_right / 2.0)
            right, ones = right + equal_right, ones + equal_ones
            equal_right = equal_ones = np.zeros(draws)

        def end() -> None:
            nonlocal hits, right, ones
            close()
            if group is not None:
                out.append((*group, hits.tolist(), ones.tolist(), right.tolist()))
            hits = right = ones = np.zeros(draws)

        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            weights = row_weights(columns[width + 2], draws, seed)
            for k, (value, is_wrong) in enumerate(zip(columns[width], columns[width + 1], strict=True)):
                own = tuple(column[k] for column in columns[:width])
                if own != group:
                    end()
                    group, last = own, value
                elif value != last:
                    close()
                    last = value
                if is_wrong:
                    equal_ones = equal_ones + weights[k]
                else:
                    equal_right = equal_right + weights[k]
        end()
        named = zip(*out, strict=True) if out else ([] for _ in range(width + 3))
        types = [sorted_types[key] for key in keys] + [pa.list_(pa.float64())] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(named, types, strict=True)], names=[*keys, "hits", "ones", "rights"])

    sorted_types = {field.name: field.type for field in to_arrow_schema(rows.select(*keys).schema)}
    parts = stored(sorted_rows.mapInArrow(add, f"{kinds}, hits array<double>, ones array<double>, rights array<double>").withColumn("range", F.spark_partition_id()), "draws")
    each = parts.select(*keys, "range", F.posexplode(F.arrays_zip("hits", "ones", "rights")).alias("draw", "x")).select(*keys, "range", "draw", "x.*")
    below = F.coalesce(F.sum("rights").over(W.partitionBy(*keys, "draw").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    one, zero = F.sum("ones"), F.sum("rights")
    per_draw = each.withColumn("below", below).groupBy(*keys, "draw").agg(F.when((one > 0) & (zero > 0), F.sum(F.col("hits") + F.col("ones") * F.col("below")) / (one * zero)).alias("auroc"))
    ends = F.percentile("auroc", [0.025, 0.5, 0.975])
    return per_draw.groupBy(*keys).agg(ends.alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))
