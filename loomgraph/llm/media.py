"""Media columns: a data source over archive directories of losslessly stored samples.

A payload of bytes is stored as an 8-bit greyscale PNG of 576 samples a row, so
it is compressed and yet read back bit by bit. Images are members of archive
files in one directory: each writing task makes one file, and the manifest,
written at commit, names the files of the tasks that succeeded.

An archive file is its members end to end, then their offsets (64 bits each),
then the number of members and the offset of that index. A member is a header
(mark, id, id-is-null, payload's unpadded bytes, image's bytes, CRC-32 of
header fields and image) and the image.

The reader plans byte ranges of the files as partitions. A range owns the
members that begin inside it. Members are read by offset one by one; one that
can't be read or fails its checksum is tried again alone, from a newly opened
file, and what was read before it stays. Members leave in Arrow batches of
bounded bytes. A member that fails every try fails the task; none is dropped.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomgraph.llm.common import bound_batches, new_shared_path, read_table

UNIT = 576
FILL = b"\xff"

RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
TRIES = 4

MARK = b"LMA1"
HEADER = struct.Struct("<4sq?qqI")
FOOTER = struct.Struct("<qq4s")
MANIFEST = "_manifest.json"

PNG_MARK = b"\x89PNG\r\n\x1a\n"


def to_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with 255 to a positive multiple of 576, and the unfilled length; null is empty."""
    raw = (text or "").encode()
    total = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + FILL * (total - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale image of 576 samples a row, unfiltered."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return PNG_MARK + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> bytes:
    """The samples of an image that :func:`encode_png` made; every chunk's checksum is verified."""
    if image[:8] != PNG_MARK:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(image):
        (length,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", image, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't supported")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Block-mean hash of 64 stretches (16 hex digits), mean and deviation of the samples in thousandths."""
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    n, total = len(samples), int(samples.sum())
    edges = np.arange(65) * n // 64
    sums = np.add.reduceat(samples, edges[:-1])
    bits = sums * n > total * np.diff(edges)
    value = int.from_bytes(np.packbits(bits).tobytes(), "big")
    variance = int((samples * samples).sum()) * n - total * total
    return f"{value:016x}-{total * 1000 // n:06d}-{int(variance**0.5 * 1000 / n):06d}"


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class ArchivePart(WriterCommitMessage):
    name: str
    size: int
    members: int


@dataclass
class ArchiveRange(InputPartition):
    name: str
    size: int
    first: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes one file; commit names those of the tasks that succeeded."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ArchivePart:
        store, root = _open_fs(self.path)
        store.create_dir(root, recursive=True)
        name, at, offsets = f"part-{uuid.uuid4().hex}.lma", 0, []
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for key, n_bytes, image in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    fields = HEADER.pack(MARK, key or 0, key is None, n_bytes, len(image), 0)[:-4]
                    out.write(fields + struct.pack("<I", zlib.crc32(image, zlib.crc32(fields))) + image)
                    offsets.append(at)
                    at += HEADER.size + len(image)
            out.write(np.array(offsets, dtype="<i8").tobytes())
            out.write(FOOTER.pack(len(offsets), at, MARK))
        return ArchivePart(name, at + 8 * len(offsets) + FOOTER.size, len(offsets))

    def commit(self, messages: list) -> None:
        store, root = _open_fs(self.path)
        parts = [{"name": m.name, "size": m.size, "members": m.members} for m in messages if m is not None]
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(parts).encode())

    def abort(self, messages: list) -> None:
        store, root = _open_fs(self.path)
        for message in messages:
            if message is not None:
                store.delete_file(f"{root}/{message.name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int, tries: int):
        self.path, self.range_bytes, self.batch_bytes, self.tries = path, range_bytes, batch_bytes, tries

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges of the files that the manifest names; only sizes are looked at."""
        store, root = _open_fs(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as file:
            parts = json.loads(file.read())
        step = self.range_bytes
        return [ArchiveRange(p["name"], p["size"], at, min(at + step, p["size"])) for p in parts if p["members"] for at in range(0, p["size"], step)]

    def read(self, partition: ArchiveRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty archive has no ranges
            return
        store, root = _open_fs(self.path)
        whole = f"{root}/{partition.name}"
        offsets = self._again(lambda: _member_offsets(store, whole, partition.size))
        own = offsets[np.searchsorted(offsets, partition.first) : np.searchsorted(offsets, partition.end)]
        rows: list[tuple] = []
        held = 0
        file = None
        try:
            for offset in own.tolist():
                for left in reversed(range(self.tries)):
                    try:
                        if file is None:
                            file = store.open_input_file(whole)
                        row = read_member(file, offset)
                        break
                    except (OSError, ValueError):
                        if not left:
                            raise
                        file = None  # a new handle; the members before stay read
                        time.sleep(0.05 * 2 ** (self.tries - left))
                rows.append(row)
                held += len(row[2])
                if held >= self.batch_bytes:
                    yield _member_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _member_batch(rows)
        finally:
            if file is not None:
                file.close()

    def _again(self, action):
        for left in reversed(range(self.tries)):
            try:
                return action()
            except (OSError, ValueError):
                if not left:
                    raise
                time.sleep(0.05 * 2 ** (self.tries - left))


def _member_offsets(store: fs.FileSystem, path: str, size: int) -> np.ndarray:
    with store.open_input_file(path) as file:
        count, at, mark = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if mark != MARK:
            raise ValueError(f"{path} has no footer")
        return np.frombuffer(file.read_at(8 * count, at), dtype="<i8")


def read_member(file: pa.NativeFile, offset: int) -> tuple[int | None, int, bytes]:
    """(id, unpadded bytes, image) of the member at an offset; ValueError if it is damaged."""
    head = file.read_at(HEADER.size, offset)
    if len(head) != HEADER.size:
        raise ValueError(f"short header at {offset}")
    mark, key, null, n_bytes, length, crc = HEADER.unpack(head)
    if mark != MARK:
        raise ValueError(f"no member at {offset}")
    image = file.read_at(length, offset + HEADER.size)
    if len(image) != length or zlib.crc32(image, zlib.crc32(head[:-4])) != crc:
        raise ValueError(f"checksum of the member at {offset}")
    return (None if null else key), n_bytes, image


def _member_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, sizes, images = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "media"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(dir)`` and ``df.write.format("media_archive").save(dir)``.

    Options of the reader: range_bytes, batch_bytes, tries.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        take = lambda key, default: int(self.options.get(key, default))
        return ArchiveReader(self.options["path"], take("range_bytes", RANGE_BYTES), take("batch_bytes", BATCH_BYTES), take("tries", TRIES))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an image; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload, n_bytes = to_payload(text.as_py())
                rows.append((key, n_bytes, encode_png(payload)))
                held += len(rows[-1][2])
                if held >= BATCH_BYTES:
                    yield _member_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _member_batch(rows)

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(2):
                image = image.as_py()
                payload = decode_png(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_media(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write texts as media into an archive directory and return the table that reads it.

    Repeated rows and null ids are members of their own; an empty table makes
    an empty archive; other columns are not stored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spark.dataSource.register(MediaArchive)
    text_media(docs, id_column, text_column).write.format("media_archive").mode("append").save(path)
    return spark.read.format("media_archive").load(path)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(read_table(spark, sf_dir, "documents"), new_shared_path(spark, "media")))
