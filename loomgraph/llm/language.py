"""Language identification by interpolated Kneser-Ney character models.

A text is reduced to lower-case letters; whatever lies between them counts as
one space. Each language has a model of character 4-grams, interpolated down to
single characters, whose counts are those of all training rows: no 4-gram and
no language is left out. The most frequent 4-grams are held together as one
sorted array of hashes with a row of log-probabilities, one for each language;
the others are worked out from the counts when a text has them, with the same
result. The language of lowest cross-entropy per character
is chosen. A text whose cross-entropy lies above what a language's own texts
show (mean and deviations over all distinct training texts) is marked as not
accepted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, keeping_columns, materialize, plain_columns, read_table, with_fields
from loomgraph.llm.spans import mix
from loomgraph.llm.tokens import text_groups

UNKNOWN = "und"
ORDER = 4
#: 4-grams, most frequent first, whose log-probabilities are worked out beforehand; the others are when met.
MAX_NGRAMS = 600_000
#: Log-probabilities that are worked out beforehand, over all languages.
MAX_CELLS = 24_000_000
#: Deviations above the mean cross-entropy of a language's own texts up to which a text is accepted.
ACCEPTED_DEVIATIONS = 6.0
#: Characters that count towards the certainty of a score, and that a text needs to count towards a limit.
CERTAIN_CHARACTERS = 40
#: Texts that a language's mean and deviation need.
LIMIT_TEXTS = 3
#: Least deviation of cross-entropy that is believed.
LEAST_DEVIATION = 0.02
#: Cross-entropies are summed as whole numbers of this part, so the sums don't depend on their order.
ENTROPY_UNITS = 1 << 20
#: 4-grams that a task counts before it hands them on.
HELD_NGRAMS = 1_500_000

OUTPUT = ["lang_pred", "score", "accepted"]

_SPACE, _START = 32, 2


def _fold_table() -> np.ndarray:
    """What each UTF-16 unit counts as: a lower-case letter, or a space."""
    table = np.full(1 << 16, _SPACE, np.uint16)
    for unit in range(1 << 16):
        if 0xD800 <= unit < 0xE000:  # halves of characters beyond the plane stand for themselves
            table[unit] = unit
        elif (char := chr(unit)).isalpha():
            low = char.lower()
            table[unit] = ord(low) if len(low) == 1 else unit
    table[_START] = _START
    return table


_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0]


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram codes of every place of the texts, and each code's text; none where a text has no letter."""
    start = "\x02" * (ORDER - 1)
    parts = [(start + text.replace("\x02", " ")).encode("utf-16-le", "surrogatepass") for text in texts]
    units = fold_table()[np.frombuffer(b"".join(parts), "<u2")]
    doc = np.repeat(np.arange(len(texts)), [len(part) // 2 for part in parts])
    keep = units != _SPACE
    keep[1:] |= (units[:-1] != _SPACE) & (units[:-1] != _START)
    units, doc = units[keep], doc[keep]
    wide = units.astype(np.uint64)
    codes = np.zeros(max(0, len(wide) - ORDER + 1), np.uint64)
    for j in range(ORDER):
        codes = (codes << np.uint64(16)) | wide[j : len(wide) - ORDER + 1 + j]
    inside = units[ORDER - 1 :] != _START
    return codes[inside], doc[ORDER - 1 :][inside]


class KneserNey:
    """One language: counts of 4-grams and continuation counts of what they end in."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, alphabet: int):
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        self.alphabet = alphabet
        self.levels = []  # from 4-grams to bigrams
        for n in range(ORDER, 1, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            contexts, at = np.unique(codes >> np.uint64(16), return_index=True)
            total = np.add.reduceat(counts, at)
            types = np.diff(np.append(at, len(codes)))
            self.levels.append((codes, np.maximum(counts - discount, 0), contexts, total, discount * types))
            codes, counts = np.unique(codes & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
            counts = counts.astype(np.float64)
        self.single, self.single_share = codes, counts / counts.sum()

    @staticmethod
    def _at(sorted_codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
        return at, sorted_codes[at] == wanted

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of each 4-gram's last character given the three before it."""
        at, hit = self._at(self.single, codes & np.uint64(0xFFFF))
        prob = 0.999 * np.where(hit, self.single_share[at], 0) + 0.001 / self.alphabet
        for n, (grams, rest, contexts, total, spare) in zip(range(2, ORDER + 1), reversed(self.levels), strict=True):
            gram = codes & np.uint64((1 << 16 * n) - 1)
            at, hit = self._at(grams, gram)
            of, known = self._at(contexts, gram >> np.uint64(16))
            inner = (np.where(hit, rest[at], 0) + spare[of] * prob) / total[of]
            prob = np.where(known, inner, prob)
        return np.log(prob)


class SortedHashes:
    """Places in a sorted array of hashes, looked up through an index of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = max(1, math.ceil(math.log2(len(hashes) + 1)))
        self.shift = np.uint64(64 - bits)
        self.index = np.searchsorted(hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        lead = (wanted >> self.shift).astype(np.int64)
        at, end = self.index[lead], self.index[lead + 1]
        found = np.full(len(wanted), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], wanted[open_]
        while len(open_):
            same = self.hashes[at] == wanted
            found[open_[same]] = at[same]
            at = at + 1
            on = np.flatnonzero(~same & (at < end))
            open_, at, end, wanted = open_[on], at[on], end[on], wanted[on]
        return found


class LanguageModels:
    """Models of all languages, scoring many texts at once."""

    def __init__(self, languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]], max_ngrams: int = MAX_NGRAMS):
        self.languages = languages
        alphabet = len(np.unique(np.concatenate([codes & np.uint64(0xFFFF) for codes, _ in grams]))) + 1
        self.models = [KneserNey(codes, counts, alphabet) for codes, counts in grams]
        union, which = np.unique(np.concatenate([codes for codes, _ in grams]), return_inverse=True)
        most = max(1, min(max_ngrams, MAX_CELLS // len(languages)))
        if len(union) > most:
            total = np.bincount(which, np.concatenate([n for _, n in grams]))
            union = union[np.argpartition(-total, most - 1)[:most]]
        hashes = mix(union)
        order = np.argsort(hashes)
        self.known = SortedHashes(hashes[order])
        self.rows = np.stack([model.log_prob(union[order]) for model in self.models], axis=1).astype(np.float32)
        self.limit = np.full(len(languages), np.inf)

    def entropies(self, texts: list[str], of_language: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, or the one named, and the number of characters."""
        which_models = slice(None) if of_language is None else slice(of_language, of_language + 1)
        models, table = self.models[which_models], self.rows[:, which_models]
        codes, doc = text_grams(texts)
        counts = np.bincount(doc, minlength=len(texts))
        out = np.full((len(texts), len(models)), np.inf)
        if not len(codes):
            return out, counts
        full = np.flatnonzero(counts)
        out[full] = 0
        step = max(1, MAX_CELLS // len(models))
        for first in range(0, len(codes), step):
            part, of = codes[first : first + step], doc[first : first + step]
            at = self.known.find(mix(part))
            rows = table[at]
            missed = np.flatnonzero(at < 0)
            if len(missed):
                new, which = np.unique(part[missed], return_inverse=True)
                rows[missed] = np.stack([model.log_prob(new) for model in models], axis=1)[which]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[starts]] -= np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        out[full] /= counts[full, None]
        return out, counts

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, certainty, accepted) of each text; the unknown language where there is no letter."""
        entropy, counts = self.entropies(texts)
        lettered = [any(map(str.isalpha, text)) for text in texts]
        out: list[tuple[str, float, bool]] = []
        for row, n, has in zip(entropy, counts.tolist(), lettered, strict=True):
            if not has or not n:
                out.append((UNKNOWN, 0.0, False))
                continue
            best = int(np.argmin(row))
            share = np.exp((row[best] - row) * min(n, CERTAIN_CHARACTERS))
            out.append((self.languages[best], float(1 / share.sum()), bool(row[best] <= self.limit[best])))
        return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, which = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(which, np.concatenate([k for _, k in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for group in text_groups(own):
                    codes, n = np.unique(text_grams(group)[0], return_counts=True)
                    held.setdefault(lang, []).append((codes, n))
                    size += len(codes)
            if size > HELD_NGRAMS:
                yield from merged()
                held, size = {}, 0
        yield from merged()

    counted = rows.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def own_entropies(rows: DataFrame, models: Broadcast) -> DataFrame:
    """(lang, n, total, squares): number and sums, in units, of the cross-entropy of each language's own distinct texts.

    All rows of (lang, text) are scored; texts of fewer than CERTAIN_CHARACTERS
    characters are left out. Only digests and numbers are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = models.value
        at = {name: k for k, name in enumerate(own.languages)}
        for batch in batches:
            texts, digests = batch.column(1).to_pylist(), batch.column(2)
            places: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                places.setdefault(lang, []).append(i)
            for lang in places.keys() & at.keys():
                parts = [own.entropies(group, at[lang]) for group in text_groups([texts[i] for i in places[lang]])]
                entropy, counts = (np.concatenate(part) for part in zip(*parts, strict=True))
                enough = np.flatnonzero(counts >= CERTAIN_CHARACTERS)
                units = np.rint(entropy[enough, 0] * ENTROPY_UNITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(enough), pa.string()), digests.take(pa.array(np.array(places[lang])[enough])), pa.array(units)], names=["lang", "digest", "units"])

    known = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.md5("text").alias("digest"))
    each = known.mapInArrow(run, "lang string, digest string, units long").groupBy("lang", "digest").agg(F.min("units").alias("units"))
    wide = F.col("units").cast("decimal(18,0)")
    return each.groupBy("lang").agg(F.count("units").alias("n"), F.sum(wide).alias("total"), F.sum(wide * wide).alias("squares"))


def fit_languages(rows: DataFrame, max_ngrams: int = MAX_NGRAMS) -> LanguageModels | None:
    """Models from all rows of (lang, text), or None if there is nothing to learn from.

    All counted 4-grams come to the driver, so its memory follows the distinct
    pairs of language and 4-gram, not the texts. ``max_ngrams`` bounds only
    what is worked out beforehand and changes no result. All rows are then
    scored under their own language, for the limits of acceptance; a language
    of fewer than LIMIT_TEXTS distinct texts long enough has none.
    """
    bound_batches(rows.sparkSession)
    grams = materialize(count_grams(rows), "language-grams")
    table = grams.toArrow()
    if not table.num_rows:
        return None
    lang = table.column("lang").combine_chunks().dictionary_encode()
    code, n = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()
    names = lang.dictionary.to_pylist()
    order = np.argsort(lang.indices.to_numpy(), kind="stable")
    own = dict(zip(names, np.split(order, np.cumsum(np.bincount(lang.indices.to_numpy()))[:-1]), strict=True))
    languages = sorted(names)
    models = LanguageModels(languages, [(code[own[name]], n[own[name]]) for name in languages], max_ngrams)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    for row in own_entropies(rows, shared).collect():  # one row a language
        if row["n"] >= LIMIT_TEXTS:
            n, total, squares = row["n"], int(row["total"]), int(row["squares"])
            deviation = math.sqrt(n * squares - total * total) / n / ENTROPY_UNITS
            models.limit[languages.index(row["lang"])] = total / n / ENTROPY_UNITS + ACCEPTED_DEVIATIONS * max(deviation, LEAST_DEVIATION)
    shared.destroy()
    return models


@keeping_columns(OUTPUT)
def identify(docs: DataFrame, models: LanguageModels | None, text_column: str = "text") -> DataFrame:
    """Each row with lang_pred, score (0 to 1) and accepted.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything where nothing was learned. Equal texts get equal results; ties
    go to the first language by name. Input columns with the results' names
    are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [text or "" for text in batch.column(0).to_pylist()]
            found = [row for group in text_groups(texts) for row in (own.predict(group) if own else [(UNKNOWN, 0.0, False)] * len(group))]
            names, scores, accepted = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[*batch.schema.names[1:], *OUTPUT])

    listed = docs.select(F.col(text_column).alias("_text"), *plain_columns(docs, OUTPUT))
    return listed.mapInArrow(run, with_fields(listed.schema.fields[1:], "lang_pred string, score double, accepted boolean"))


def id_remainder(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % parts


def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    models = fit_languages(docs.filter(~held_out).select("lang", "text"))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), models)
    return found.select("doc_id", "held_out", *OUTPUT)
