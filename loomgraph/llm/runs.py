"""Repeated runs of words across documents: the engine of substring removal.

A window is ``width`` consecutive units of one document. Each window has a
minimiser, the least hash among its k-grams; equal windows have equal
minimisers. Consecutive windows that share one form a run and travel as one
packed string to the minimiser's bucket, with the document and the place.
Equal packed strings of a group of documents travel once, with the place of
least document alone: the group's other places repeat it for certain, and go to
the result by buckets that have nothing to do with the string. So what a passage
that a third of all documents hold brings to its bucket is a place for each
group of documents. In a bucket, windows are compared in full, not by their
hashes, and each window's earliest document is found; the others are repeats.

Most runs have a minimiser that no other run has and repeat nothing. A first
pass sends only the minimisers' hashes and sets, in a bitmap of bounded size, a
bit for each that occurs twice; runs without their bit stay at home. The bitmap
lets some others through, but holds no repeat back, so results don't depend on
its size.

A minimiser that is common in many different contexts would bring all of them to
one bucket. The first pass finds those that more than ``FREQUENT`` groups'
worth of runs have; their runs travel window by window, each to the bucket of
its own words' hash, so a bucket's load doesn't follow a minimiser's.

A bucket is worked on alone and dropped: memory follows the size of a bucket,
and the number of buckets follows the input.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bitmap import Bitmap, blobs_by_key, named_batches, repeated_hashes
from loomgraph.llm.common import bound_batches, plan_bytes
from loomgraph.llm.spans import grams, mix, window_minima

#: Bytes of the input that a bucket stands for; what it holds is a few times that.
BUCKET_BYTES = 1_250_000
#: Characters of text that are packed together.
GROUP_CHARACTERS = 2_000_000
#: Packed blobs below this size are not compressed.
PLAIN_BYTES = 256

#: Runs, two for each group of documents at most, from which a minimiser's windows travel apart.
FREQUENT = 400

#: Input bytes for each run of words.
RUN_BYTES = 21

LAST = np.iinfo(np.int64).max  # the order of a document without id: after all others

REPEATS = "_kid long, _th int, _null boolean, first int, n int"
_HEAD = struct.Struct("<II")


@dataclass
class Units:
    """The units of several documents end to end."""

    hash: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    pack: Callable[[int, int], bytes]  # first and last unit


def keyed(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    """Columns that identify a row by id and text: _kid, _th, _null. Equal rows share them, and have equal results."""
    key, text = F.col(id_column), F.col(text_column)
    return [
        F.coalesce(key.cast("long"), F.xxhash64(text)).alias("_kid"),
        F.hash(text).alias("_th"),
        key.isNull().alias("_null"),
    ]


def _runs(units: Units, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each run."""
    minima = window_minima(grams(units.hash, k), width - k + 1)
    n = len(minima)
    inside = np.flatnonzero(units.doc[:n] == units.doc[width - 1 : width - 1 + n])
    if not len(inside):
        return inside, inside, np.zeros(0, np.uint64)
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) != 1) | (minima[inside][1:] != minima[inside][:-1]) | (units.doc[inside][1:] != units.doc[inside][:-1])
    at = np.flatnonzero(new)
    return inside[at], inside[np.concatenate((at[1:] - 1, [len(inside) - 1]))], minima[inside[at]]


def _blobs(units: Units, kid: np.ndarray, th: np.ndarray, null: np.ndarray, width: int, k: int, buckets: int, shared: Bitmap) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed runs) of a group of documents."""
    first, last, minimiser = _runs(units, width, k)
    hashes = mix(minimiser)
    held = shared.holds(hashes)
    first, last, minimiser, hashes = first[held], last[held], minimiser[held], hashes[held]
    if shared.frequent is not None and (apart := shared.frequent.holds(hashes)).any():
        count = (last - first + 1)[apart]
        each = np.repeat(first[apart], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        own = mix(grams(units.hash, width)[each])
        first, last, minimiser = np.concatenate((first[~apart], each)), np.concatenate((last[~apart], each)), np.concatenate((minimiser[~apart], own))
        hashes = np.concatenate((hashes[~apart], mix(own)))
    if not len(first):
        return
    bucket = hashes % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
    compress = zstandard.ZstdCompressor(level=3).compress
    rank = np.where(null, LAST, kid)[units.doc[first]]
    sure: list[int] = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        members = order[a:b]
        places: dict[bytes, list[int]] = {}
        for i, f, z in zip(members.tolist(), first[members].tolist(), last[members].tolist(), strict=True):
            places.setdefault(units.pack(f, z + width - 1), []).append(i)
        for own in places.values():
            if len(own) > 1:
                least = min(rank[i] for i in own)
                sure += [i for i in own if rank[i] > least]
                own[:] = [i for i in own if rank[i] == least]
        refs = np.array([i for own in places.values() for i in own], np.int64)
        lead = np.array([own[0] for own in places.values()], np.int64)
        start = first[refs]
        doc = units.doc[start]
        body = b"".join(
            (
                _HEAD.pack(len(lead), len(refs)),
                minimiser[lead].astype("<u8").tobytes(),
                np.array([len(p) for p in places], "<u4").tobytes(),
                np.array([len(own) for own in places.values()], "<u4").tobytes(),
                kid[doc].astype("<i8").tobytes(),
                th[doc].astype("<i4").tobytes(),
                (units.at[start].astype(np.int64) * 2 + null[doc]).astype("<u4").tobytes(),
                *places,
            )
        )
        yield int(bucket[order[a]]), b"\0" + body if len(body) < PLAIN_BYTES else b"\1" + compress(body)
    if sure:
        start = first[sure]
        doc = units.doc[start]
        columns = (kid[doc].astype("<i8"), th[doc].astype("<i4"), null[doc].astype("<i4"), units.at[start].astype("<i4"), (last[sure] - start + 1).astype("<i4"))
        yield int(mix(kid[doc[:1]].view(np.uint64))[0] % np.uint64(buckets)), b"\2" + compress(struct.pack("<I", len(sure)) + b"".join(c.tobytes() for c in columns))


def _sure_repeats(blob: bytes) -> Iterator[tuple[int, int, bool, int, int]]:
    """What a group of documents knew to be repeats by itself."""
    body = zstandard.decompress(blob[1:])
    (n,) = struct.unpack_from("<I", body)
    columns, at = [], 4
    for kind in ("<i8", "<i4", "<i4", "<i4", "<i4"):
        columns.append(np.frombuffer(body, kind, n, at).tolist())
        at += n * int(kind[2])
    columns[2] = [value == 1 for value in columns[2]]
    yield from zip(*columns, strict=True)


def _unpacked(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed strings, their minimisers and numbers of places; then kid, th and place of every place."""
    packs: list[bytes] = []
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for blob in blobs:
        body = blob[1:] if blob[0] == 0 else zstandard.decompress(blob[1:])
        n, m = _HEAD.unpack_from(body)
        at = _HEAD.size
        read = []
        for kind, count in (("<u8", n), ("<u4", n), ("<u4", n), ("<i8", m), ("<i4", m), ("<u4", m)):
            read.append(np.frombuffer(body, kind, count, at))
            at += count * int(kind[2])
        ends = at + np.cumsum(read[1], dtype=np.int64)
        packs += [body[e - size : e] for e, size in zip(ends.tolist(), read[1].tolist(), strict=True)]
        for column, values in zip(columns, (read[0], *read[2:]), strict=True):
            column.append(values)
    minimiser, count, kid, th, place = (np.concatenate(column) for column in columns)
    return packs, minimiser, count.astype(np.int64), kid, th, place.astype(np.int64)


def bucket_repeats(blobs: list[bytes], windows: Callable[[bytes], list[bytes]]) -> Iterator[tuple[int, int, bool, int, int]]:
    """(kid, th, null, first window, windows) of each stretch of repeats in a bucket.

    A window is a repeat if it also starts in a document of smaller id.
    """
    for blob in blobs:
        if blob[0] == 2:
            yield from _sure_repeats(blob)
    blobs = [blob for blob in blobs if blob[0] != 2]
    if not blobs:
        return
    packs, minimiser, count, kid, th, place = _unpacked(blobs)
    null = place & 1 == 1
    place = place >> 1
    rank = np.where(null, LAST, kid)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)))
    least = np.minimum.reduceat(rank, starts[:-1])
    order = np.lexsort((least, minimiser))
    edges = np.concatenate(([0], np.flatnonzero(np.diff(minimiser[order])) + 1, [len(order)]))
    total = np.add.reduceat(count[order], edges[:-1])
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    lonely = total == 1  # one place alone repeats nothing
    ids, hashes, nulls, ranks, places = kid.tolist(), th.tolist(), null.tolist(), rank.tolist(), place.tolist()
    order, least, starts = order.tolist(), least.tolist(), starts.tolist()
    for (a, b), skip in zip(spans, lonely.tolist(), strict=True):
        if skip:
            continue
        seen: dict[bytes, int] = {}
        known: dict[bytes, list[int]] = {}
        for p in order[a:b]:
            pack = packs[p]
            firsts = known.get(pack)
            if firsts is None:
                d = least[p]
                firsts = known[pack] = [seen.setdefault(w, d) for w in windows(pack)]
            for r in range(starts[p], starts[p + 1]):
                d, at, run = ranks[r], places[r], 0
                for i, fd in enumerate(firsts):
                    if fd < d:
                        run += 1
                    elif run:
                        yield ids[r], hashes[r], nulls[r], at + i - run, run
                        run = 0
                if run:
                    yield ids[r], hashes[r], nulls[r], at + len(firsts) - run, run


def text_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[tuple]]]:
    """Texts and their (kid, th, null), in groups of some characters."""
    texts: list[bytes] = []
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for kid, th, null, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            texts.append(text.encode())
            rows.append((kid, th, null))
            size += len(texts[-1])
            if size >= GROUP_CHARACTERS:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def shared_minimisers(listed: DataFrame, units_of: Callable[[list[bytes]], Units], width: int, k: int, size: int) -> Bitmap:
    """The bitmap of minimisers that occur more than once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for texts, _ in text_groups(batches):
            yield mix(_runs(units_of(texts), width, k)[2])

    return repeated_hashes(listed, hashes, size // RUN_BYTES, FREQUENT)


def repeats(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    units_of: Callable[[list[bytes]], Units],
    windows: Callable[[bytes], list[bytes]],
    width: int,
    k: int,
) -> DataFrame:
    """Stretches of repeated windows, by row: _kid, _th, _null and an array ``runs`` of (first, n)."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = plan_bytes(docs)
    buckets = max(64, size // BUCKET_BYTES)
    listed = docs.filter(F.col(text_column).isNotNull()).select(*keyed(docs, id_column, text_column), F.col(text_column))
    shared = spark.sparkContext.broadcast(shared_minimisers(listed, units_of, width, k, size))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            for texts, rows in text_groups(batches):
                kid, th, null = (np.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int64), strict=True))
                yield from _blobs(units_of(texts), kid, th, null, width, k, buckets, shared.value)

        yield from named_batches(pairs(), "bucket")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["_kid", "_th", "_null", "first", "n"], [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for _, blobs in blobs_by_key(batches):
            for row in bucket_repeats(blobs, windows):
                rows.append(row)
                if len(rows) >= 20_000:
                    yield batch_of()
                    rows.clear()
        if rows:
            yield batch_of()

    packed = listed.mapInArrow(spread, "bucket long, blob binary")
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduce, REPEATS)
    return found.groupBy("_kid", "_th", "_null").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
