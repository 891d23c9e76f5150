"""Token counts by rank-synchronous array merging.

The text is cut into pre-tokens by the vocabulary's own pattern. Pre-tokens not
met before are held together as one ragged numpy array of symbol ids; in each
round every sequence finds its pair of lowest merge rank and all its
occurrences of that pair are merged at once, for all sequences together. What
is left after the last round is counted. A worker remembers the counts of
pre-tokens (bounded), so a word is merged once, not once for each place.

The counts equal those of the ``tokenizers`` library without added tokens; a
special token's string inside a text is one token, as it is there by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, plain_columns, read_table, with_fields

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

#: Pre-tokens that a worker remembers; when full it starts anew, so the memory is bounded.
CACHE_ENTRIES = 300_000
#: Pre-tokens above this many bytes are not remembered.
CACHED_BYTES = 64

OUTPUT = ["n_bytes", "n_tokens", "over_limit"]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 upwards in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class RankMerger:
    """Byte-level merges of a vocabulary file, applied to many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.of_byte = np.array([vocab[symbol] for symbol in byte_symbols()], dtype=np.int64)
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in merges]
        self.size = max(vocab.values()) + 1
        codes = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks, self.made = codes[order], order.astype(np.int64), made
        self.none = len(pairs)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``self.none`` where the pair doesn't merge."""
        code = left * self.size + right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.ranks[at], self.none)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of each piece, end to end, and their numbers."""
        counts = np.array([len(piece) for piece in pieces], dtype=np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        alive = np.arange(len(pieces))  # sequences that may still merge
        done_symbols: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        lengths = counts.copy()
        while len(alive):
            owner = np.repeat(np.arange(len(alive)), lengths)
            ranks = np.full(len(symbols), self.none, dtype=np.int64)
            if len(symbols) > 1:
                same = owner[:-1] == owner[1:]
                ranks[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            full = lengths > 0
            least = np.full(len(alive), self.none, dtype=np.int64)
            least[full] = np.minimum.reduceat(ranks, starts[full]) if full.any() else self.none
            over = least == self.none
            if over.any():  # finished sequences leave the working set
                gone = over[owner]
                done_symbols.append(symbols[gone])
                done_owner.append(alive[owner[gone]])
                symbols, ranks, owner = symbols[~gone], ranks[~gone], owner[~gone]
                keep = ~over
                alive, lengths, least = alive[keep], lengths[keep], least[keep]
                owner = np.repeat(np.arange(len(alive)), lengths)
                if not len(alive):
                    break
            hit = ranks == least[owner]
            # Of overlapping occurrences (a a a) the first, third, ... merge.
            where = np.flatnonzero(hit)
            if len(where) > 1:
                run = np.concatenate(([True], np.diff(where) != 1))
                first = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[where] = self.made[least[owner[where]]]
            dropped = np.ones(len(symbols), dtype=bool)
            dropped[where + 1] = False
            lengths = lengths - np.bincount(owner[where], minlength=len(alive))
            symbols = symbols[dropped]
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, dtype=np.int64)
        left = np.concatenate(done_symbols) if done_symbols else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        return left[order], np.bincount(owner, minlength=len(pieces))


class TokenCounter:
    """Counts tokens of texts, remembering the counts of pre-tokens."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.merger = RankMerger(path)
        self.entries = entries
        self.known: dict[str, int] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.merger.special)) + ")") if self.merger.special else None
        self.special = set(self.merger.special)

    def _learn(self, new: list[str]) -> dict[str, int]:
        counts = self.merger.merge([piece.encode() for piece in new])[1].tolist()
        return dict(zip(new, counts, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        found: list[list[str]] = []
        extra: list[int] = []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            extra.append(sum(part in self.special for part in parts))
            found.append([piece for part in parts if part not in self.special for piece in self.merger.pattern.findall(part)])
        if len(self.known) > self.entries:
            self.known.clear()
        here: dict[str, int] = {}
        new = list({piece for pieces in found for piece in pieces if piece not in self.known})
        if new:
            counts = self._learn(new)
            self.known.update((piece, n) for piece, n in counts.items() if len(piece) <= CACHED_BYTES)
            here = {piece: n for piece, n in counts.items() if len(piece) > CACHED_BYTES}
        if not here:
            get = self.known.__getitem__
            return [sum(map(get, pieces)) + more for pieces, more in zip(found, extra, strict=True)]
        return [sum(here[p] if p in here else self.known[p] for p in pieces) + more for pieces, more in zip(found, extra, strict=True)]


def text_groups(texts: list[str], characters: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts in groups of about so many characters, so that what is made of them stays small."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(docs: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Each row with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty: 0 bytes and 0 tokens. Whole texts are counted,
    of any length. There is no shuffle; equal texts get equal counts. Input
    columns with the results' names are replaced.
    """
    bound_batches(docs.sparkSession)
    path = public_tokenizers.path(vocabulary)
    kept = [name for name in docs.columns if name.lower() not in OUTPUT]
    at = kept.index(next(name for name in kept if name.lower() == text_column.lower()))
    schema = docs.select(*[F.col(f"`{name}`") for name in kept]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            texts = [text or "" for text in batch.column(at).to_pylist()]
            counts = [n for group in text_groups(texts) for n in counter.count(group)]
            sizes = [len(text.encode()) for text in texts]
            arrays = [*batch.columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *OUTPUT])

    return docs.select(*plain_columns(docs, OUTPUT)).mapInArrow(run, with_fields(schema.fields, "n_bytes long, n_tokens long, over_limit boolean"))


def op4_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", *OUTPUT)
