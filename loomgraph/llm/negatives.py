"""Hard negatives of labelled vectors, found exactly behind an orthogonal rotation.

Every component x counts as the whole number floor(``scale`` * x), and a row's
score is its inner product with the anchor; a vector that is shorter than
another counts as if zeros followed. Higher scores come first, ties by smaller
id. An anchor's positives are its first rows of the same label, and the
negatives of a positive are the first rows of other labels whose score lies in a
stated share of the positive's.

Method. The rotation onto the principal axes of all rows (from their second
moments, added up by Spark) leaves inner products as they are and puts most of
them into the leading axes. Rows and anchors travel as packed blocks, and each
pair of blocks is one task's work: products over the leading axes are added up
in steps, the rest is bounded by the product of the norms of what is left, plus
slack for rounding, and pairs that can't reach their anchor's present limit go
early. What survives is scored by whole numbers, so the rotation decides nothing
but time. Each pair of blocks yields the first rows of each of its anchors, and
the first of those over all blocks are the result: nothing is capped.

Blocks are sorted by label, so positives are looked for in blocks that share a
label with the anchors' block; a label that a third of all rows have is many
blocks. The driver gets the second moments (the square of the dimension) and
the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, discard, materialize, read_table

#: Rows and anchors of a block, and rows that are compared at once.
ROW_BLOCK, ANCHOR_BLOCK, STRIP = 8192, 1024, 512
#: Numbers in a block, which has fewer rows where vectors are long.
BLOCK_NUMBERS = 1 << 21
#: Shares of the axes after which pairs are bounded.
STEPS = (0.25, 0.5, 0.75)
#: Share of pairs below which single pairs are followed up instead of whole strips.
FEW = 0.1

#: Whole numbers are held within this (9e15), where a double still has them exactly.
MOST = 1 << 53

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score lies within these hundredths of its positive's.
LOW, HIGH = 30, 90


def pack_rows(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    """Ids, labels and whole-number vectors of a block, in the narrowest type that holds them."""
    reach = int(np.abs(vectors).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if reach <= np.iinfo(k).max)
    head = np.array([len(ids), vectors.shape[1], int(kind[2])], "<i8")
    return b"".join((head.tobytes(), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), np.ascontiguousarray(vectors, kind).tobytes()))


def unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, width, size = np.frombuffer(blob, "<i8", 3).tolist()
    ids = np.frombuffer(blob, "<i8", n, 24)
    labels = np.frombuffer(blob, "<i8", n, 24 + 8 * n)
    return ids, labels, np.frombuffer(blob, f"<i{size}", n * width, 24 + 16 * n).reshape(n, width).astype(np.int64)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, one by one, as whole numbers; held within 63 bits."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if reach < 1 << 63:
        return (a * b).sum(axis=1)
    end = (1 << 63) - 1
    wide = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(-end, min(end, int(v))) for v in np.atleast_1d(wide)], np.int64)


class Rotated:
    """Whole-number vectors with their rotation and the norms of what follows each step."""

    def __init__(self, vectors: np.ndarray, rotation: np.ndarray):
        self.whole = vectors
        self.turned = vectors.astype(np.float64) @ rotation
        d = rotation.shape[1]
        self.cuts = sorted({max(1, int(d * step)) for step in STEPS} | {d})
        squares = self.turned**2
        self.rest = [np.sqrt(squares[:, cut:].sum(axis=1)) for cut in self.cuts]
        self.norm = np.sqrt(squares.sum(axis=1))


def survivors(rows: Rotated, strip: slice, anchors: Rotated, least: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of the strip, anchor) among the wanted ones whose product may reach the anchor's ``least``."""
    x, norm = rows.turned[strip], rows.norm[strip]
    d = x.shape[1]
    slack = 16 * d * (d + 2) * np.finfo(np.float64).eps  # of the rotation, its application and the sums
    room = slack * np.outer(norm, anchors.norm)
    total = np.zeros(wanted.shape)
    done, open_ = 0, wanted
    for k, cut in enumerate(rows.cuts):
        total += x[:, done:cut] @ anchors.turned[:, done:cut].T
        done = cut
        open_ = open_ & (total + np.outer(rows.rest[k][strip], anchors.rest[k]) + room >= least)
        if np.count_nonzero(open_) <= FEW * open_.size:
            break
    i, j = np.nonzero(open_)
    part = total[i, j]
    for k, cut in enumerate(rows.cuts):
        if cut <= done or not len(i):
            continue
        part = part + (x[i, done:cut] * anchors.turned[j, done:cut]).sum(axis=1)
        done = cut
        near = part + rows.rest[k][strip][i] * anchors.rest[k][j] + room[i, j] >= least[j]
        i, j, part = i[near], j[near], part[near]
    return i, j


def first_rows(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows: higher scores first, ties by smaller id."""
    return np.lexsort((ids, -scores))[:most]


class Lists:
    """The first rows of each key so far, with the score that a further row must reach."""

    def __init__(self, keys: int, most: int):
        self.most = most
        self.scores = [np.zeros(0, np.int64)] * keys
        self.ids = [np.zeros(0, np.int64)] * keys

    def add(self, key: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[key], scores)), np.concatenate((self.ids[key], ids))
        best = first_rows(scores, ids, self.most)
        self.scores[key], self.ids[key] = scores[best], ids[best]

    def limit(self, key: int) -> float:
        own = self.scores[key]
        return float(own[-1]) if len(own) == self.most else -np.inf


def block_positives(rows: tuple, anchors: tuple, rotation: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(anchor, positive, score): the first rows of each anchor's own label in a block of rows."""
    ids, labels, vectors = rows
    own, own_labels, own_vectors = anchors
    left, right = Rotated(vectors, rotation), Rotated(own_vectors, rotation)
    lists = Lists(len(own), most)
    limits = np.full(len(own), -np.inf)
    for at in range(0, len(ids), STRIP):
        strip = slice(at, at + STRIP)
        wanted = (labels[strip, None] == own_labels) & (ids[strip, None] != own)
        if not wanted.any():
            continue
        i, j = survivors(left, strip, right, limits, wanted)
        scores = exact_products(vectors[strip][i], own_vectors[j])
        for key, places in _by_key(j):
            lists.add(key, scores[places], ids[strip][i[places]])
            limits[key] = lists.limit(key)
    return [(int(own[k]), vec, score) for k in range(len(own)) for vec, score in zip(lists.ids[k].tolist(), lists.scores[k].tolist(), strict=True)]


def block_negatives(rows: tuple, anchors: tuple, positives: tuple, rotation: np.ndarray, most: int, low: int, high: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor, positive, positive's score, negative, score): the first rows of other labels in reach of each positive in a block of rows.

    ``positives`` are the anchor's place, the id and the score of each, by anchor.
    """
    ids, labels, vectors = rows
    own, own_labels, own_vectors = anchors
    of, positive, reached = positives
    reached = [int(v) for v in reached]
    floor = np.array([-(-low * v // 100) for v in reached], np.float64)  # least and greatest whole score allowed
    ceiling = np.array([high * v // 100 for v in reached], np.float64)
    possible = ceiling >= floor
    left, right = Rotated(vectors, rotation), Rotated(own_vectors, rotation)
    lists = Lists(len(of), most)
    limits = np.where(possible, floor, np.inf)
    begin, end = np.searchsorted(of, np.arange(len(own))), np.searchsorted(of, np.arange(len(own)), side="right")

    def least() -> np.ndarray:
        return np.array([limits[a:b].min(initial=np.inf) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])

    reach = least()
    for at in range(0, len(ids), STRIP):
        strip = slice(at, at + STRIP)
        wanted = (labels[strip, None] != own_labels) & np.isfinite(reach)
        if not wanted.any():
            continue
        i, j = survivors(left, strip, right, reach, wanted)
        scores = exact_products(vectors[strip][i], own_vectors[j])
        for key, places in _by_key(j):
            found, whose = scores[places], ids[strip][i[places]]
            open_ = np.flatnonzero((limits[begin[key] : end[key]] <= found.max()) & (ceiling[begin[key] : end[key]] >= found.min())) + begin[key]
            for p in open_.tolist():
                fits = np.array([low * reached[p] <= 100 * s <= high * reached[p] for s in found.tolist()]) if abs(reached[p]) > MOST else (found >= floor[p]) & (found <= ceiling[p])
                if possible[p] and fits.any():
                    lists.add(p, found[fits], whose[fits])
                    limits[p] = max(limits[p], lists.limit(p))
            reach[key] = limits[begin[key] : end[key]].min(initial=np.inf)
    out = []
    for p, (place, name) in enumerate(zip(of.tolist(), positive.tolist(), strict=True)):
        out += [(int(own[place]), name, reached[p], vec, score) for vec, score in zip(lists.ids[p].tolist(), lists.scores[p].tolist(), strict=True)]
    return out


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with its places."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            yield int(keys[places[0]]), places


def whole_rows(table: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, one for each id (the least of several by label, then vector), components as whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.transform(F.col(f"`{vector_column}`"), lambda x: x.cast("double"))
    known = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("long").alias("label"), vector.alias("x"))
    known = known.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(F.forall("x", finite))
    held = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x)) * scale).cast("long")))
    return known.select("id", "label", F.transform("x", held).alias("v")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, shorter ones with zeros behind."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _blocks(rows: DataFrame, size: int, width: int, tag: str, extra: bool = False) -> DataFrame:
    """(block, labels, blob): rows sorted by label in packed blocks of at most ``size`` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, labels, vectors = (rows.column(name).combine_chunks() for name in ("id", "label", "v"))
            labels = labels.to_numpy()
            columns = [pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())), pa.array([pack_rows(ids.to_numpy(), labels, _matrix(vectors, width))], pa.binary())]
            names = ["labels", "blob"]
            if extra:
                told = rows.column("positives").to_pylist()
                of = [k for k, own in enumerate(told) for _ in own]
                numbers = np.array([of, [p["id"] for own in told for p in own], [p["score"] for own in told for p in own]], "<i8").reshape(3, -1)
                columns.append(pa.array([numbers.tobytes()], pa.binary()))
                names.append("positives")
            return pa.RecordBatch.from_arrays(columns, names=names)

        count = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == size:
                    yield block()
                    held.clear()
                    count = 0
        if count:
            yield block()

    types = "labels array<long>, blob binary" + (", positives binary" if extra else "")
    packed = rows.select("id", "label", "v", *(["positives"] if extra else [])).mapInArrow(pack, types)
    return materialize(packed.select(F.monotonically_increasing_id().alias("block"), "*"), tag)


def second_moments(rows: DataFrame, width: int) -> np.ndarray:
    """Sums of products of each two components over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            vectors = _matrix(batch.column(0), width).astype(np.float64)
            total += vectors.T @ vectors
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    out = np.zeros((width, width))
    for row in rows.select("v").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["s"]
    return out


def principal_axes(moments: np.ndarray) -> np.ndarray:
    """Orthogonal axes of a matrix of second moments as columns, the weightiest first."""
    scale = np.abs(moments).max(initial=0)
    return np.linalg.eigh(moments / scale)[1][:, ::-1].copy() if scale else np.eye(len(moments))


def hard_negatives(
    table: DataFrame,
    anchors: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    row_block: int = ROW_BLOCK,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column ``id``, ids and labels are whole
    numbers. Rows with a null id, label or vector, or with a component that is
    null or not finite, take no part; of several rows of one id the least by
    label, then by vector, does. Vectors of other lengths, empty ones included,
    count as if zeros followed. Whole numbers beyond 2 ** 53 are held there, and
    scores within 63 bits. A positive with a score below zero has no negatives,
    as nothing lies between 0.3 and 0.9 of it; one of zero has those of zero.
    Anchors without positives or negatives yield no row; neither does an empty
    table. Further columns have no part in it, whatever their names.
    """
    spark = table.sparkSession
    bound_batches(spark)
    rows = materialize(whole_rows(table, id_column, vector_column, label_column, scale), "negatives-rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not width:
        width = 1
    rotation = principal_axes(second_moments(rows, width))
    row_block, anchor_block = (max(16, min(size, BLOCK_NUMBERS // width)) for size in (row_block, anchor_block))
    parts = max(1, -(-n // (4 * row_block)))
    by_label = lambda table, count: table.repartitionByRange(count, "label", "id").sortWithinPartitions("label", "id").coalesce(count)
    row_blocks = _blocks(by_label(rows, parts), row_block, width, "negatives-blocks")
    asked = rows.filter(anchors)
    anchor_parts = max(1, -(-asked.count() // (4 * anchor_block)))
    asked_blocks = _blocks(by_label(asked, anchor_parts), anchor_block, width, "negatives-anchors")
    slots = max(1, row_blocks.count())

    def grid(blocks: DataFrame, fits: Column, tag: str) -> tuple[DataFrame, int]:
        """Pairs of a block of rows and one of anchors: each anchors' block goes to every slot, a rows' block to one."""
        left = row_blocks.select(F.col("block").alias("r"), F.col("labels").alias("of_rows"), F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"))
        right = blocks.select(F.col("block").alias("a"), F.col("labels").alias("of_anchors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
        pairs = materialize(left.join(right, "slot").filter(fits).select("r", "a"), tag)
        return pairs, pairs.count()

    def on_cells(pairs: DataFrame, count: int, blocks: DataFrame, work, types: str) -> DataFrame:
        joined = pairs.join(row_blocks.select(F.col("block").alias("r"), F.col("blob").alias("left")), "r")
        joined = joined.join(blocks.select(F.col("block").alias("a"), F.col("blob").alias("right"), *([F.col("positives")] if "positives" in blocks.columns else [])), "a")
        names = [part.split()[0] for part in types.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    found = work(*(batch.column(c)[k].as_py() for c in range(batch.num_columns)))
                    columns = list(zip(*found, strict=True)) or [()] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        return joined.repartition(max(1, min(count, 20_000)), "r", "a").drop("r", "a").mapInArrow(run, types)

    pairs, count = grid(asked_blocks, F.arrays_overlap("of_rows", "of_anchors"), "negatives-same")
    near = on_cells(pairs, count, asked_blocks, lambda left, right: block_positives(unpack_rows(left), unpack_rows(right), rotation, positives), "anchor long, id long, score long")
    first = lambda *key: W.partitionBy(*key).orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(first("anchor"))).filter(F.col("place") <= positives)
    chosen = near.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    told = asked.join(chosen, asked["id"] == chosen["anchor"]).drop("anchor")
    told_blocks = _blocks(by_label(told, anchor_parts), anchor_block, width, "negatives-told", extra=True)

    differ = (F.size("of_rows") > 1) | (F.size("of_anchors") > 1) | (F.col("of_rows")[0] != F.col("of_anchors")[0])
    others, other_count = grid(told_blocks, differ, "negatives-others")

    def mine(left: bytes, right: bytes, told: bytes) -> list[tuple]:
        return block_negatives(unpack_rows(left), unpack_rows(right), tuple(np.frombuffer(told, "<i8").reshape(3, -1)), rotation, negatives, low, high)

    found = on_cells(others, other_count, told_blocks, mine, "anchor long, positive long, reached long, id long, score long")
    best = found.withColumn("rank", F.row_number().over(first("anchor", "positive"))).filter(F.col("rank") <= negatives)
    names = {"anchor": "anchor_id", "positive": "positive_id", "rank": "rank", "id": "negative_id", "reached": "positive_score", "score": "negative_score"}
    out = materialize(best.select(*(F.col(a).alias(b) for a, b in names.items())), "negatives")
    discard(rows, row_blocks, asked_blocks, pairs, told_blocks, others)
    return out.select(*(part.split()[0] for part in schema.split(", ")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH k AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM k a JOIN k b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
