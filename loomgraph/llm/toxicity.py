"""Toxicity by a chain of linear classifiers.

A text is the set of its words, lower-cased, and of their first four and five
letters. From a bounded sample of labelled rows three categories are made, each
narrower than what ``toxic`` says of a text:

* ``marked``: toxic, and it holds a word that is typical of toxic texts;
* ``dense``: toxic, and it holds at least the median number of such words;
* ``toxic``: the label itself.

They are predicted in this order. Each is a logistic regression over the
features that tell toxic from other texts and over the probabilities of the
categories before it; when it is trained, those are predictions for rows that
the earlier models have not seen (out of fold). What a fold's models go by, the
features, the typical words and so the categories, is chosen from the other
folds alone. The chain is fitted by one task, since the sample is bounded; only
its weights come to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, keeping_columns, labelled_ids, labelled_texts, plain_columns, read_table, with_fields

CATEGORIES = ("marked", "dense", "toxic")
#: Labelled rows of each value that the chain is learned from, in the order of a hash of their ids.
FIT_ROWS_EACH = 4_000
FOLDS = 3
#: Features that are kept, at most, and the least number of texts that hold one.
MAX_FEATURES = 4_000
LEAST_TEXTS = 3
#: Log-odds above which a word is typical of toxic texts, and the least evidence (a likelihood ratio) of a feature.
TYPICAL = 2.0
LEAST_EVIDENCE = 6.0
PENALTY = 0.02
THRESHOLD = 0.5
#: Words that a worker remembers as having no feature.
REMEMBERED_WORDS = 150_000

OUTPUT = [*(f"p_{name}" for name in CATEGORIES), "toxic_pred"]

_WORDS = regex.compile(r"\p{L}+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its first letters; the lowest two bits tell which."""
    digest = xxhash.xxh3_64_intdigest
    parts = [word, word[:4] if len(word) > 4 else "", word[:5] if len(word) > 5 else ""]
    return tuple((digest(part) & 0x3FFFFFFFFFFFFFFC) | kind for kind, part in enumerate(parts) if part)


def text_words(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


def text_features(text: str) -> np.ndarray:
    return np.array(sorted({f for word in text_words(text) for f in word_features(word)}), np.int64)


class Logistic:
    """Logistic regression on sparse 0/1 features and a few dense ones, by accelerated gradient steps."""

    def __init__(self, features: int, dense: int):
        self.sparse, self.dense, self.bias = np.zeros(features), np.zeros(dense), 0.0

    def logits(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.sparse[columns], minlength=len(dense)) + dense @ self.dense + self.bias

    def fit(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, labels: np.ndarray, steps: int = 250) -> Logistic:
        n, positive = len(labels), labels.mean()
        weight = np.where(labels == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9)) / n
        width = np.bincount(rows, minlength=n).max(initial=0) + dense.shape[1] + 1
        rate = 4.0 / max(1.0, min(width, 64))
        flat = lambda: np.concatenate((self.sparse, self.dense, [self.bias]))
        size, cut = len(self.sparse), len(self.sparse) + len(self.dense)
        here = ahead = flat()
        for step in range(steps):
            self.sparse, self.dense, self.bias = ahead[:size], ahead[size:cut], ahead[cut]
            error = weight * (sigmoid(self.logits(rows, columns, dense)) - labels)
            slope = np.concatenate((np.bincount(columns, error[rows], minlength=size), dense.T @ error, [error.sum()]))
            slope[:cut] += PENALTY / np.sqrt(n) * ahead[:cut]
            after = ahead - rate * slope
            ahead, here = after + step / (step + 3) * (after - here), after
        self.sparse, self.dense, self.bias = here[:size], here[size:cut], here[cut]
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class View:
    """A sample as some of its rows, ``seen``, have it: their telling features, and the categories by their typical words."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, seen: np.ndarray):
        self.seen = seen
        self.features = telling_features([text for text, own in zip(texts, seen.tolist(), strict=True) if own], labels[seen])
        self.rows, self.columns = placed_features(texts, self.features)
        typical = self._typical(labels)
        found = np.bincount(self.rows, typical[self.columns], minlength=len(texts))
        toxic = seen & (labels == 1)
        several = np.median(found[toxic]) if toxic.any() else 0
        self.targets = [(labels * (found > 0)).astype(float), (labels * (found >= max(1, several))).astype(float), labels.astype(float)]

    def _typical(self, labels: np.ndarray) -> np.ndarray:
        """1 for whole words that are typical of toxic texts."""
        size, own = len(self.features), self.seen[self.rows]
        toxic = labels[self.rows] == 1
        one = (np.bincount(self.columns[own & toxic], minlength=size) + 0.5) / ((labels[self.seen] == 1).sum() + 1)
        zero = (np.bincount(self.columns[own & ~toxic], minlength=size) + 0.5) / ((labels[self.seen] == 0).sum() + 1)
        return ((np.log(one / zero) >= TYPICAL) & (self.features & 3 == 0)).astype(float)

    def model(self, category: int, before: np.ndarray) -> Logistic:
        place = np.cumsum(self.seen) - 1
        inside = self.seen[self.rows]
        return Logistic(len(self.features), before.shape[1]).fit(place[self.rows[inside]], self.columns[inside], before[self.seen], self.targets[category][self.seen])

    def predictions(self, model: Logistic, before: np.ndarray) -> np.ndarray:
        return sigmoid(model.logits(self.rows, self.columns, before))


def telling_features(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features whose share differs most between toxic and other texts."""
    counts = {y: np.unique(np.concatenate([np.zeros(0, np.int64), *(text for text, label in zip(texts, labels.tolist(), strict=True) if label == y)]), return_counts=True) for y in (0, 1)}
    n = {y: int((labels == y).sum()) for y in (0, 1)}
    all_ = np.union1d(counts[0][0], counts[1][0])
    one, zero = np.zeros(len(all_)), np.zeros(len(all_))
    one[np.searchsorted(all_, counts[1][0])] = counts[1][1]
    zero[np.searchsorted(all_, counts[0][0])] = counts[0][1]
    enough = one + zero >= LEAST_TEXTS
    all_, one, zero = all_[enough], one[enough], zero[enough]
    share1, share0 = (one + 0.5) / (n[1] + 1), (zero + 0.5) / (n[0] + 1)
    share = (one + zero + 0.5) / (n[0] + n[1] + 1)
    evidence = 2 * (one * np.log(share1 / share) + zero * np.log(share0 / share))
    telling = (evidence >= LEAST_EVIDENCE) & (share1 > share0)
    order = np.lexsort((all_, -evidence))
    return np.sort(all_[order[telling[order]][:MAX_FEATURES]])


def placed_features(texts: list[np.ndarray], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in ``features``) of every feature that a text has."""
    rows = np.repeat(np.arange(len(texts)), [len(text) for text in texts])
    values = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    if not len(features):
        return rows[:0], values[:0]
    at = np.minimum(np.searchsorted(features, values), len(features) - 1)
    hit = features[at] == values
    return rows[hit], at[hit]


class ToxicityChain:
    """Features that tell toxic texts, and one linear model for each category."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray):
        folds = np.arange(len(texts)) % FOLDS
        whole = View(texts, labels, np.ones(len(texts), bool))
        views = [View(texts, labels, folds != fold) for fold in range(FOLDS)]
        before = np.zeros((len(texts), 0))
        self.models: list[Logistic] = []
        for category in range(len(CATEGORIES)):
            unseen = np.zeros(len(texts))
            for fold, view in enumerate(views):
                own = folds == fold
                unseen[own] = view.predictions(view.model(category, before), before)[own]
            self.models.append(whole.model(category, before))
            before = np.column_stack((before, unseen))
        self.unseen = before  # of the sample's rows, by models that haven't seen them
        self.features = whole.features
        self.place = {f: i for i, f in enumerate(self.features.tolist())}
        self.none: set[str] = set()
        self.some: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"none": set(), "some": {}}

    def forget(self) -> None:
        """Give back the memory of words met."""
        self.none.clear()
        self.some.clear()

    def _of_word(self, word: str) -> tuple[int, ...]:
        return tuple(self.place[f] for f in word_features(word) if f in self.place)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a category."""
        rows: list[int] = []
        columns: list[int] = []
        for i, text in enumerate(texts):
            own: set[int] = set()
            for word in text_words(text) - self.none:
                found = self.some.get(word)
                if found is None:
                    found = self._of_word(word)
                    if found and len(word) < 64:
                        self.some[word] = found
                    elif not found and len(word) < 64:
                        self.none.add(word)
                own.update(found)
            rows += [i] * len(own)
            columns += own
            if len(self.none) > REMEMBERED_WORDS:
                self.none.clear()
            if len(self.some) > REMEMBERED_WORDS:
                self.some.clear()
        r, c = np.array(rows, np.int64), np.array(columns, np.int64)
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack((out, sigmoid(model.logits(r, c, out))))
        return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows_each: int = FIT_ROWS_EACH, text_column: str = "text") -> ToxicityChain | None:
    """Learn from at most ``fit_rows_each`` labelled documents of either value; None unless both occur.

    The sample is the ids of least hash. An id with several labels is toxic if
    any says so; however often it is repeated it counts once, with its text of
    least hash. Null text counts as empty. Nothing of the sample comes to the
    driver but the fitted weights.
    """
    bound_batches(docs.sparkSession)
    known = labelled_ids(labels, "toxic")
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows_each) for y in (0, 1)]
    sample = labelled_texts(docs, parts[0].union(parts[1]), text_column)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(text).astype("<i8").tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
        rows.sort(key=lambda row: row[0])
        labels_of = np.array([row[1] for row in rows])
        if len(set(labels_of.tolist())) == 2:
            chain = ToxicityChain([np.frombuffer(row[2], "<i8") for row in rows], labels_of)
            chain.unseen = None
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = sample.mapInArrow(features, f"doc_id {kind}, label int, features binary").repartition(1)
    fitted = told.mapInArrow(fit, "chain binary").collect()
    return pickle.loads(fitted[0]["chain"]) if fitted else None


@keeping_columns(OUTPUT)
def score_toxicity(docs: DataFrame, chain: ToxicityChain | None, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Each row with the probability of each category and toxic_pred (p_toxic >= threshold).

    Null text counts as empty, and a text without words has no features. Equal
    texts get equal results, so repeated rows and null ids do. A probability at
    the threshold is toxic. Where nothing was learned all probabilities are 0.
    Input columns with the results' names are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [text or "" for text in batch.column(0).to_pylist()]
            found = own.probabilities(texts) if own and texts else np.zeros((len(texts), len(CATEGORIES)))
            arrays = [*batch.columns[1:], *(pa.array(found[:, k]) for k in range(len(CATEGORIES))), pa.array(found[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[1:], *OUTPUT])
        if own:
            own.forget()

    listed = docs.select(F.col(text_column).alias("_text"), *plain_columns(docs, OUTPUT))
    return listed.mapInArrow(run, with_fields(listed.schema.fields[1:], ", ".join([*(f"p_{name} double" for name in CATEGORIES), "toxic_pred boolean"])))


def op9_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    chain = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), chain)
