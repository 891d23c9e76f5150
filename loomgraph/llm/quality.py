"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text is a vector of two parts of equal say: hashed byte trigrams, and runs of
three word shapes (a repeat of the word before, capitals, symbols, digits and
so on). Both are damped and weighted by how rare they are in the labelled
sample, and together reduced to a few latent directions by a singular value
decomposition of that sample. The labelled vectors are
broadcast; their number is bounded. Every document's cosines with all of them
are computed exactly, a block of documents at a time, and the nearest ones vote
with weights that grow with similarity. Cosines count to five decimals, and of
equal ones the neighbour of the lower id is nearer, so a table's layout changes
no score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, keeping_columns, labelled_ids, labelled_texts, plain_columns, read_table, with_fields
from loomgraph.llm.language import id_remainder
from loomgraph.llm.spans import Words
from loomgraph.llm.tokens import text_groups

#: Labelled rows that the vectors are learned from, in the order of a hash of their ids.
FIT_ROWS = 3_000
BINS = 4_096
SHAPES = 8
DIRECTIONS = 64
NEIGHBOURS = 25
#: Power of the cosine that a neighbour's vote weighs.
SHARPNESS = 16
THRESHOLD = 0.3
#: Texts that are turned to vectors together.
BLOCK = 256

OUTPUT = ["score", "predicted"]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Damped counts of hashed byte trigrams, one row a text; digits count alike."""
    parts = [b"\x02" + text.encode() + b"\x03" for text in texts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    data[(data >= 48) & (data < 58)] = 48
    doc = np.repeat(np.arange(len(texts)), [len(part) for part in parts])
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)  # 32 - log2(BINS)
    inside = doc[:-2] == doc[2:]
    counts = np.bincount((doc[:-2] * BINS + bins)[inside], minlength=len(texts) * BINS)
    return np.log1p(counts.reshape(len(texts), BINS).astype(np.float32))


def shape_counts(texts: list[str]) -> np.ndarray:
    """Damped counts of runs of three word shapes, one row a text."""
    words = Words([text.encode() for text in texts])
    data = np.frombuffer(words.buffer, np.uint8)

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[words.ends] - sums[words.starts]

    upper = within((data >= 65) & (data <= 90))
    digits = within((data >= 48) & (data <= 57))
    letters = within((data >= 97) & (data <= 122) | (data >= 128)) + upper
    symbols = words.ends - words.starts - letters - digits
    repeat = np.zeros(len(words.hash), bool)
    repeat[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = np.select(
        [repeat, letters + digits == 0, symbols >= 2, (upper >= 2) & (upper == letters), digits > 0, upper > 0, symbols == 1],
        [1, 2, 3, 4, 5, 6, 7],
        0,
    )
    out = np.zeros((len(texts), SHAPES**3), np.float32)
    if len(shape) > 2:
        inside = words.doc[:-2] == words.doc[2:]
        code = words.doc[:-2] * SHAPES**3 + (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:]
        out = np.bincount(code[inside], minlength=len(texts) * SHAPES**3).reshape(out.shape).astype(np.float32)
    return np.log1p(out)


def text_counts(texts: list[str]) -> np.ndarray:
    return np.concatenate((trigram_counts(texts), shape_counts(texts)), axis=1)


class NeighbourVote:
    """Labelled vectors and the directions they live in."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, directions: int = DIRECTIONS, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS):
        self.neighbours, self.sharpness = min(neighbours, len(labels)), sharpness
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        weighted = self._weighted(counts)
        self.directions = self._subspace(weighted, min(directions, *weighted.shape))
        self.vectors = self._unit(weighted @ self.directions)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean())

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        rows = counts * self.idf
        return np.concatenate((self._unit(rows[:, :BINS]), self._unit(rows[:, BINS:])), axis=1)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    @staticmethod
    def _subspace(rows: np.ndarray, k: int) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a fixed start."""
        basis = np.random.default_rng(7).standard_normal((rows.shape[1], min(rows.shape[1], k + 12))).astype(np.float32)
        for _ in range(6):
            basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
        _, _, turned = np.linalg.svd(rows @ basis, full_matrices=False)
        return (basis @ turned.T[:, :k]).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """The share of label 1 in the nearest neighbours' vote, from 0 to 1."""
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            counts = text_counts(texts[at : at + BLOCK])
            vectors = self._unit(self._weighted(counts) @ self.directions)
            near, cosine = nearest(np.round(vectors @ self.vectors.T, 5), self.neighbours)
            weight = np.maximum(cosine, 0).astype(np.float64) ** self.sharpness
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(np.round(out, 9), 0, 1)


def nearest(cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the ``k`` greatest values of each row in ascending order, and these values; of equal values the first columns."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k).tolist():
        near[i] = np.argsort(-cosine[i], kind="stable")[:k]
    near.sort(axis=1)
    return near, np.take_along_axis(cosine, near, axis=1)


def fit_quality(labelled: DataFrame) -> NeighbourVote | None:
    """Learn from all rows of (doc_id, label, text), a bounded sample; None if there are none.

    One task fits the vectors, since the sample is bounded, with its rows in
    the order of their ids; only the vectors come to the driver.
    """
    bound_batches(labelled.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(2).to_pylist()]
            places, values = [], []
            for at in range(0, len(texts), BLOCK):
                for row in text_counts(texts[at : at + BLOCK]):
                    full = np.flatnonzero(row)
                    places.append(full.astype("<u2").tobytes())
                    values.append(row[full].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "places", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
        rows.sort(key=lambda row: row[0])
        if rows:
            counts = np.zeros((len(rows), BINS + SHAPES**3), np.float32)
            for i, (_, _, places, values) in enumerate(rows):
                counts[i, np.frombuffer(places, "<u2")] = np.frombuffer(values, "<f4")
            model = NeighbourVote(counts, np.array([row[1] for row in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    told = labelled.select("doc_id", "label", "text").mapInArrow(counted, f"doc_id {kind}, label int, places binary, counts binary").repartition(1)
    fitted = told.mapInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, fit_rows: int = FIT_ROWS, text_column: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``fit_rows`` labelled documents: those of least hash of their id.

    An id with several labels has the greatest of them; however often it is
    repeated it counts once, with its text of least hash.
    """
    chosen = labelled_ids(labels.filter(keep), label)
    return labelled_texts(docs, chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), text_column)


@keeping_columns(OUTPUT)
def score_quality(docs: DataFrame, model: NeighbourVote | None, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each row with score (0 to 1) and predicted (1 if score >= threshold).

    Null text counts as empty and is scored like any other; equal texts get
    equal scores, so repeated rows and null ids do. Where nothing was learned
    every score is 1, and where one label alone was, that label. Input columns with the results' names are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [text or "" for text in batch.column(0).to_pylist()]
            parts = [own.score(group) if own else np.ones(len(group)) for group in text_groups(texts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names[1:], *OUTPUT])

    listed = docs.select(F.col(text_column).alias("_text"), *plain_columns(docs, OUTPUT))
    return listed.mapInArrow(run, with_fields(listed.schema.fields[1:], "score double, predicted int"))


def op6_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, read_table(spark, sf_dir, "labels"), "quality", id_remainder("doc_id", 5) != 0)
    held_out = id_remainder("doc_id", 5) == 0
    return score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), fit_quality(sample)).select("doc_id", "held_out", *OUTPUT)
