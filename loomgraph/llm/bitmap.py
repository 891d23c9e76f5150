"""Bitmaps and counters of bounded size over the 64-bit hashes of a table: which occur more than once, and how often."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits as powers of two: about five for each hash expected, and 2 ** 30 (128 MB) at most.
LEAST_POWER, MOST_POWER = 20, 30
#: Bits for frequent hashes: 2 MB at most.
MOST_FREQUENT_POWER = 24
#: Hashes that a slice of the hash space is made for, and the most slices.
SLICE_HASHES, MOST_SLICES = 50_000, 1 << 16


@dataclass
class Bitmap:
    """A set of hashes by their leading bits; may hold more than was put in, never less."""

    power: int
    bits: np.ndarray
    frequent: Bitmap | None = None

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.power)).astype(np.int64)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def named_batches(pairs: Iterator[tuple[int, bytes]], name: str) -> Iterator[pa.RecordBatch]:
    """(name, blob) rows in batches of bounded bytes."""
    names, blobs, held = [], [], 0
    for key, blob in pairs:
        names.append(key)
        blobs.append(blob)
        held += len(blob)
        if held > 4 << 20 or len(blobs) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=[name, "blob"])
            names, blobs, held = [], [], 0
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=[name, "blob"])


def blobs_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each key, from batches that are sorted by it."""
    own: list[bytes] = []
    current = None
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != current and own:
                yield current, own
                own = []
            current = key
            own.append(blob)
    if own:
        yield current, own


def hash_slices(hashes: np.ndarray, power: int) -> Iterator[tuple[int, bytes]]:
    """(slice, the 32 bits of each hash below the slice's); twice what occurs more than once."""
    values, counts = np.unique(hashes, return_counts=True)
    values = np.repeat(values, np.minimum(counts, 2))
    part = (values >> np.uint64(64 - power)).astype(np.int64)
    rest = (values >> np.uint64(32 - power)).astype("<u4")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a < b:
            yield int(part[a]), rest[a:b].tobytes()


def slice_bits(blobs: list[bytes], power: int, least: int = 2) -> bytes:
    """The bits, ``2 ** power`` of them, of what occurs ``least`` times or more in a slice."""
    values = np.sort(np.concatenate([np.frombuffer(blob, "<u4") for blob in blobs]))
    often = np.unique(values[least - 1 :][values[least - 1 :] == values[: len(values) - least + 1]]) >> np.uint32(32 - power)
    bits = np.zeros(1 << power, np.uint8)
    bits[often] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def repeated_hashes(table: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int, frequent: int | None = None) -> Bitmap:
    """The bitmap of hashes that occur more than once, from scrambled hashes of a table's batches.

    Four bytes of each distinct hash of a group travel; the driver gets the
    bits alone. Slices of the hash space are counted apart, in memory that
    follows ``expected`` hashes over the number of slices. With ``frequent``, the
    bitmap's own ``frequent`` one has the hashes that so many travel of.
    """
    power = min(MOST_POWER, max(LEAST_POWER, (5 * expected).bit_length()))
    slices = max(6, (min(MOST_SLICES, expected // SLICE_HASHES + 1) - 1).bit_length())
    often = min(power, max(MOST_FREQUENT_POWER, slices + 3))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from named_batches((pair for own in hashes(batches) for pair in hash_slices(own, slices)), "slice")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            for key, blobs in blobs_by_key(batches):
                yield key, slice_bits(blobs, power - slices)
                if frequent and sum(map(len, blobs)) >= 4 * frequent:
                    yield key + (1 << slices), slice_bits(blobs, often - slices, frequent)

        yield from named_batches(pairs(), "slice")

    sent = table.mapInArrow(spread, "slice long, blob binary").repartition("slice").sortWithinPartitions("slice")
    found = Bitmap(power, np.zeros(1 << power - 3, np.uint8), Bitmap(often, np.zeros(1 << often - 3, np.uint8)) if frequent else None)
    for row in sent.mapInArrow(reduce, "slice long, blob binary").collect():
        own = found.frequent if row["slice"] >> slices else found
        each, at = 1 << own.power - slices - 3, row["slice"] & ((1 << slices) - 1)
        own.bits[at * each : (at + 1) * each] = np.frombuffer(row["blob"], np.uint8)
    return found


#: Counters as powers of two, at most (32 MB), and the slices that they are summed in.
COUNTERS_POWER, COUNTER_SLICES = 24, 6


@dataclass
class Counters:
    """How often hashes occur, by their leading bits: never too few, too many where hashes share a counter."""

    power: int
    counts: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.counts[(hashes >> np.uint64(64 - self.power)).astype(np.int64)]


def hash_counters(table: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], expected: int) -> Counters:
    """Counters of scrambled hashes of a table's batches; the driver gets two bytes of each counter."""
    power = min(COUNTERS_POWER, max(LEAST_POWER, (4 * expected).bit_length()))
    inner = power - COUNTER_SLICES

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            for own in hashes(batches):
                bins, counts = np.unique((own >> np.uint64(64 - power)).astype(np.int64), return_counts=True)
                edges = np.searchsorted(bins >> inner, np.arange((1 << COUNTER_SLICES) + 1))
                for part, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if a < b:
                        yield part, (bins[a:b] & ((1 << inner) - 1)).astype("<u4").tobytes() + counts[a:b].astype("<u4").tobytes()

        yield from named_batches(pairs(), "slice")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, bytes]]:
            for part, blobs in blobs_by_key(batches):
                total = np.zeros(1 << inner, np.int64)
                for blob in blobs:
                    bins, counts = np.frombuffer(blob, "<u4").reshape(2, -1)
                    total[bins] += counts
                yield part, np.minimum(total, 65_535).astype("<u2").tobytes()

        yield from named_batches(pairs(), "slice")

    counts = np.zeros(1 << power, np.uint16)
    sent = table.mapInArrow(spread, "slice long, blob binary").repartition("slice").sortWithinPartitions("slice")
    for row in sent.mapInArrow(reduce, "slice long, blob binary").collect():
        counts[row["slice"] << inner : (row["slice"] + 1) << inner] = np.frombuffer(row["blob"], "<u2")
    return Counters(power, counts)
