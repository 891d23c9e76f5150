"""Hierarchical multi-length packing of tokenised documents.

A document is its token ids and one closing id. Documents are routed to tiers
of context size: what fills whole windows of the longest tier is cut off as it
is, and the rest goes to the smallest tier that holds it. Each tier, longest
first, is packed into windows of its own length: the largest waiting piece
opens a window, shorter tiers fill the gap best-fit, and what no piece fits is
filled by cutting one. So every window is full; only at a partition's end are
the last few tokens split into windows of descending powers of two.
Windows of a tier are dealt to step groups of one number of tokens each.

Packing is local to a partition: no shuffle, and a bounded pool of pieces is
held. Ids are functions of the partition and the order of its rows, so a task
that runs again gives the same rows.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, read_table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
TIERS = (128, 256, 512, 1024)
#: Tokens of a step group: 16 windows of 1024, 32 of 512, ...
STEP_TOKENS = 16_384
#: Pieces that wait in a partition's pool before windows are closed.
POOL = 4_096
#: Stretches of text, and pre-tokens, that a worker remembers in a task, and those it keeps for the next.
CACHE_ENTRIES, KEPT_ENTRIES = 600_000, 200_000
CACHED_CHARACTERS = 48

#: Characters of text that are encoded together.
GROUP_CHARACTERS = 8_000_000

WIDTH = 4  # bytes of an id
SHIFT = 33  # a partition's own numbers lie below 2 ** SHIFT

Piece = tuple[int, int, tuple, int, bytes]  # length, order, document, start, ids


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that begin at ``starts``, end to end, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)], ends


class IdTable:
    """Strings and their ids in arrays; when full, it forgets its newer half, as frequent strings are met early."""

    def __init__(self, entries: int):
        self.entries = entries
        self.strings = pa.array([], pa.large_string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def of(self, strings: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of distinct strings; ``encode`` gives those of strings not known."""
        at = pc.index_in(strings, value_set=self.strings)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        starts = np.cumsum(self.sizes) - self.sizes
        new = strings.filter(pa.array(~known))
        new_flat, new_sizes = encode(new)
        sizes, begins = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        sizes[known], begins[known] = self.sizes[at[known]], starts[at[known]]
        sizes[~known], begins[~known] = new_sizes, len(self.flat) + np.cumsum(new_sizes) - new_sizes
        both = np.concatenate((self.flat, new_flat))
        out, _ = _gathered(both, begins, sizes)
        self.strings = pa.concat_arrays([self.strings, new])
        self.sizes, self.flat = np.concatenate((self.sizes, new_sizes)), both
        if len(self.strings) > self.entries:
            self.keep(self.entries // 2)
        return out, sizes

    def keep(self, entries: int) -> None:
        self.strings = pa.concat_arrays([self.strings[:entries]])
        self.sizes = self.sizes[:entries].copy()
        self.flat = self.flat[: int(self.sizes.sum())].copy()


class PieceEncoder:
    """Ids of texts as little-endian 32-bit bytes; equal to the library's, special strings included.

    Between two characters that aren't white space, a single space always
    begins a pre-token, so the ids of a text are those of its stretches, each
    with the space before it. Stretches met before are looked up; the others
    are cut into pre-tokens by the vocabulary's pattern, and the library
    encodes those that are new. Both memories are bounded.
    """

    #: White space beside a space: such a text is cut by the pattern alone.
    SPACED = re.compile(r" \s|\s ")

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.special = {token.content: number.to_bytes(WIDTH, "little") for number, token in self.library.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pretokens, self.stretches = IdTable(entries), IdTable(entries)

    def rest(self) -> None:
        """Between tasks, keep what was met first, which is what is frequent."""
        for table in (self.pretokens, self.stretches):
            table.keep(KEPT_ENTRIES)

    def _by_library(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = new.to_pylist()
        flat, sizes = array("I"), np.zeros(len(pieces), np.int64)
        for at in range(0, len(pieces), 4096):
            for i, one in enumerate(self.library.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False), at):
                ids = one.ids
                flat.extend(ids)
                sizes[i] = len(ids)
        return np.frombuffer(flat, "<u4") if flat else np.zeros(0, "<u4"), sizes

    def _by_pattern(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of texts cut into pre-tokens."""
        # A space and letters alone are one pre-token.
        found = [[text] if text[:1] == " " and text[1:].isalpha() else self.find(text) for text in texts]
        numbers = np.fromiter(map(len, found), np.int64, len(found))
        coded = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        flat, sizes = self.pretokens.of(coded.dictionary, self._by_library)
        out, ends = _gathered(flat, (np.cumsum(sizes) - sizes)[which], sizes[which])
        edges = np.concatenate((np.zeros(1, np.int64), ends))[np.concatenate((np.zeros(1, np.int64), np.cumsum(numbers)))]
        return out, np.diff(edges)

    def _by_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids) of texts cut at spaces; each distinct stretch is looked up once."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges = cut.offsets.to_numpy()
        heads, head_sizes = self._by_pattern(cut.values.take(pa.array(edges[:-1])).to_pylist())
        coded = cut.values.dictionary_encode()
        which = coded.indices.to_numpy()
        flat, sizes = self.stretches.of(coded.dictionary, lambda new: self._by_pattern([" " + piece for piece in new.to_pylist()]))
        starts, lengths = (np.cumsum(sizes) - sizes)[which] + len(heads), sizes[which]
        starts[edges[:-1]], lengths[edges[:-1]] = np.cumsum(head_sizes) - head_sizes, head_sizes  # a text's first stretch has no space before it
        out, ends = _gathered(np.concatenate((heads, flat)), starts, lengths)
        return out, np.diff(np.concatenate((np.zeros(1, np.int64), ends))[edges])

    @staticmethod
    def _apart(ids: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        body, ends = ids[0].tobytes(), (np.cumsum(ids[1]) * WIDTH).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                parts = self.split.split(text)
                found = iter(self._apart(self._by_pattern([part for part in parts if part not in self.special])))
                out[i] = b"".join(self.special[part] if part in self.special else next(found) for part in parts)
            else:
                (odd if self.SPACED.search(text) else plain).append(i)
        for group, way in ((plain, self._by_stretches), (odd, self._by_pattern)):
            if group:
                for i, ids in zip(group, self._apart(way([texts[i] for i in group])), strict=True):
                    out[i] = ids
        return out


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """One encoder for a worker process: what it remembers serves all its tasks."""
    return PieceEncoder(path)


class TierPacker:
    """Packs pieces of one partition; windows come out as lists of (document, start, ids)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.tiers = tuple(sorted(tiers))
        self.pool = pool
        self.waiting: dict[int, list[Piece]] = {tier: [] for tier in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.held = 0
        self.order = 0

    def _put(self, document: tuple, start: int, ids: bytes) -> None:
        length = len(ids) // WIDTH
        tier = self.tiers[bisect.bisect_left(self.tiers, length)]
        self.order += 1
        bisect.insort(self.waiting[tier], (length, self.order, document, start, ids))
        self.tokens[tier] += length
        self.held += 1

    def _take(self, tier: int, at: int) -> Piece:
        piece = self.waiting[tier].pop(at)
        self.tokens[tier] -= piece[0]
        self.held -= 1
        return piece

    def add(self, document: tuple, ids: bytes) -> Iterator[tuple[int, list]]:
        top = self.tiers[-1]
        n, start = len(ids) // WIDTH, 0
        while n - start >= top:
            yield top, [(document, start, ids[start * WIDTH : (start + top) * WIDTH])]
            start += top
        if start < n:
            self._put(document, start, ids[start * WIDTH :])
            if self.held >= self.pool:
                yield from self._close()

    def _fitting(self, tiers: tuple[int, ...], gap: int) -> Piece | None:
        """The largest waiting piece of at most ``gap`` tokens."""
        for tier in reversed(tiers):
            at = bisect.bisect_right(self.waiting[tier], gap, key=lambda piece: piece[0])
            if at:
                return self._take(tier, at - 1)
        return None

    def _close(self) -> Iterator[tuple[int, list]]:
        """Full windows of each tier, longest tier first, while there is enough to fill them."""
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], self.tiers[: k + 1]
            while self.waiting[tier] and sum(self.tokens[t] for t in below) >= tier:
                window, gap = [], tier
                while gap:
                    piece = self._take(tier, -1) if gap == tier else self._fitting(below, gap)
                    if piece is None:  # none fits: cut the first of the shortest tier that has any
                        short = next(t for t in below if self.waiting[t])
                        _, _, document, start, ids = self._take(short, 0)
                        self._put(document, start + gap, ids[gap * WIDTH :])
                        piece = (gap, 0, document, start, ids[: gap * WIDTH])
                    window.append(piece[2:])
                    gap -= piece[0]
                yield tier, window

    def finish(self) -> Iterator[tuple[int, list]]:
        yield from self._close()
        left = [self._take(tier, -1) for tier in reversed(self.tiers) for _ in range(len(self.waiting[tier]))]
        total, power = sum(piece[0] for piece in left), self.tiers[-1]
        while total:
            power //= 2
            if not total & power:
                continue
            window, gap = [], power
            while gap:
                length, order, document, start, ids = left.pop(0)
                if length > gap:
                    left.insert(0, (length - gap, order, document, start + gap, ids[gap * WIDTH :]))
                    length, ids = gap, ids[: gap * WIDTH]
                window.append((document, start, ids))
                gap -= length
            yield power, window
            total -= power


PACKED = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length int, step_group long"


def pack_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: str = VOCABULARY,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    pool: int = POOL,
) -> DataFrame:
    """One row per piece: the id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset, sequence_length and step_group.

    Null text is empty and is one piece of the closing id. Every row is its own
    document, repeated rows and null ids too. All tokens are packed; windows
    are of a tier's length, and a partition's last tokens of powers of two.
    Tiers are powers of two.
    """
    bound_batches(docs.sparkSession)
    path = public_tokenizers.path(vocabulary)
    kind = docs.schema[id_column].dataType.simpleString()
    end = END_ID.to_bytes(WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(path), TierPacker(tiers, pool)
        base = TaskContext.get().partitionId() << SHIFT
        sequences, groups = 0, 0
        open_groups: dict[int, list[int]] = {}  # by window length: the group and the tokens it has
        rows: list[tuple] = []
        id_type = None

        def lay(windows: Iterator[tuple[int, list]]) -> None:
            nonlocal sequences, groups
            for size, window in windows:
                group = open_groups.get(size)
                if group is None or group[1] + size > step_tokens:
                    group = open_groups[size] = [groups, 0]
                    groups += 1
                group[1] += size
                offset = 0
                for (name, tokens), start, ids in window:
                    length = len(ids) // WIDTH
                    rows.append((name, start, length, ids, tokens, base + sequences, offset, size, base + group[0]))
                    offset += length
                sequences += 1

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def grouped() -> Iterator[tuple[list, list[str]]]:
            nonlocal id_type
            names: list = []
            texts: list[str] = []
            size = 0
            for batch in batches:
                id_type = batch.schema.field(0).type
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    names.append(name)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= GROUP_CHARACTERS:
                        yield names, texts
                        names, texts, size = [], [], 0
            if texts:
                yield names, texts

        for names, texts in grouped():
            for name, ids in zip(names, encoder.encode(texts), strict=True):
                lay(packer.add((name, len(ids) // WIDTH + 1), ids + end))
                if len(rows) >= 2_000:
                    yield flushed()
        lay(packer.finish())
        if rows:
            yield flushed()
        encoder.rest()

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, {PACKED}")


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")
