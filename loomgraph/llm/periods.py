"""Periodic runs of words by Lyndon arrays, in time linear in a text's words.

Words are what lies between bytes 20 and 09-0D. A run is a stretch of
consecutive words with smallest period q (words q apart are identical) and a
length of at least ``least`` words and ``repeats`` times q, which no neighbouring
word extends keeping period q.

Method (after Ellert and Fischer). Words are compared only as members of an
ordered alphabet: by the number they get when a text first shows them, and by
that number turned round. For either order a sweep from left to right keeps the
places whose next smaller suffix is still to come on a stack and compares the
suffix at hand with the one on top, which yields the Lyndon array (the longest
Lyndon word from each place) and how far each pair of suffixes agrees. No
comparison starts anew where an earlier one has looked: the pair (x, y) whose
agreement reaches furthest right, to k, says that what follows y repeats what
follows x, so a later pair below k has the agreement of its image there, or
reaches k at least and goes on from k. Only comparisons beyond k cost a step, so
there are no more of them than words; no suffix structure and no hash is needed.
A run has, in one of the two orders, a Lyndon word of its period from whose
place the text goes on agreeing with itself for at least ``repeats - 2`` periods;
the first such place lies less than a period after the run's start, so the
stretch to the left is scanned for less than one period.

Before that, whatever can't lie in a run is cut out: every word of a run occurs
``repeats`` times in it, so a text falls apart at words that occur less often, the
parts do so again, and parts shorter than ``least`` are left. This loses no run
and changes none (a neighbour that extended a run would be part of it); where it
cuts nothing the sweep sees the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bound_batches, keeping_columns, let, read_table, with_fields

#: Words and periods of the shortest run.
LEAST, REPEATS = 24, 3
#: Times that texts fall apart before the sweep; what is left after them is swept whole.
ROUNDS = 12

GAP = r"[\x20\x09-\x0D]+"
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
OUTPUT = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed_text"]


class Alphabet(dict):
    """Words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def lyndon_array(w: list[int]) -> tuple[list[int], list[int]]:
    """The place of the next smaller suffix of each place (the length if there is none), and how far the two agree."""
    n = len(w)
    after, agree = [n] * n, [0] * n
    before, agreed = [-1] * n, [0] * n
    stack: list[int] = []
    x = y = k = 0
    for j in range(n):
        while stack:
            i = stack[-1]
            same = 0
            if j < k:
                image = j - y + x
                own = i - y + x if i >= y else i
                same = k - j
                if before[image] == own:
                    known = agreed[image]
                elif after[own] == image:
                    known = agree[own]
                else:
                    known = same
            if j >= k or known >= same:
                a, b = i + same, j + same
                while b < n and w[a] == w[b]:
                    a += 1
                    b += 1
                same = b - j
                x, y, k = i, j, b
            else:
                same = known
            if j + same == n or w[i + same] > w[j + same]:
                after[i], agree[i] = j, same
                stack.pop()
            else:
                before[j], agreed[j] = i, same
                break
        stack.append(j)
    return after, agree


def sweep(w: list[int], least: int = LEAST, repeats: int = REPEATS) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of one sequence of numbers."""
    found = set()
    n = len(w)
    for order in (w, [-v for v in w]):
        after, agree = lyndon_array(order)
        nexts = np.array(after)
        period = nexts - np.arange(n)
        for i in np.flatnonzero((nexts < n) & (np.array(agree) > (repeats - 2) * period)).tolist():
            p = after[i] - i
            if i >= p and after[i - p] == i and agree[i - p] >= p:
                continue  # the run has a place further left
            a, b = i, i + p
            while a and i - a < p and w[a - 1] == w[b - 1]:
                a -= 1
                b -= 1
            length = i + p + agree[i] - a
            if length >= max(least, repeats * p):
                found.add((a, length, p))
    return found


def stretches(ids: np.ndarray, doc: np.ndarray, least: int, repeats: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Stretches (first place, end) outside which no run has a word; ``ids`` are numbers of words, ``doc`` those of their texts."""
    at, part = np.arange(len(ids)), doc
    for _ in range(rounds):
        if not len(at):
            break
        key = part.astype(np.int64) * (int(ids.max()) + 1) + ids[at]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[inverse] >= repeats
        fell = not keep.all()
        at, part = at[keep], part[keep]
        if not len(at):
            break
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(part) != 0)
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= least
        at, part = at[long], part[long]
        if not fell:
            break
    if not len(at):
        return []
    edges = np.flatnonzero(np.diff(part)) + 1
    return list(zip(at[np.concatenate(([0], edges))].tolist(), (at[np.concatenate((edges - 1, [len(at) - 1]))] + 1).tolist(), strict=True))


def text_runs(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), by start, then period."""
    ids = np.fromiter((number for words in texts for number in map(Alphabet().__getitem__, words)), np.int64)
    sizes = np.array([len(words) for words in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    found: list[set] = [set() for _ in texts]
    for a, b in stretches(ids, doc, least, repeats):
        own = int(doc[a])
        shift = a - int(begins[own])
        found[own] |= {(start + shift, length, period) for start, length, period in sweep(ids[a:b].tolist(), least, repeats)}
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in found]


def steepest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length over period; of equal ones the first, then that of least period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside all runs and of the runs' first periods, joined by one space."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


@keeping_columns(OUTPUT)
def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Each row with n_runs, its steepest run (start, length, period, exponent_milli), all ``runs`` and collapsed_text.

    The steepest run has the greatest exact length/period, then the smallest
    start, then period; without runs its columns are null. ``runs`` are by
    start, then period. Null and empty texts have no words, no runs and an empty
    collapsed_text. Rows are judged one by one, so repeated rows and null ids get
    what any other row of their text gets; an empty table gives an empty one.
    Ids may be of any type. Input columns with the results' names are replaced,
    all others are kept. ``repeats`` is at least 3.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three periods aren't looked for")
    bound_batches(docs.sparkSession)
    kept = [name for name in docs.columns if name not in (text_column, *OUTPUT)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(text or "").encode().split() for text in batch.column(0).to_pylist()]
            runs = text_runs(texts, least, repeats)
            best = [steepest(own) if own else (None, None, None) for own in runs]
            columns = [pa.array([len(own) for own in runs], pa.int64())]
            columns += [pa.array([row[i] for row in best], pa.int64()) for i in range(3)]
            columns.append(pa.array([row[1] * 1000 // row[2] if row[2] else None for row in best], pa.int64()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns.append(pa.array([[dict(zip(("start", "length", "period"), run, strict=True)) for run in own] for own in runs], kind))
            columns.append(pa.array([collapsed(words, own) for words, own in zip(texts, runs, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *OUTPUT])

    rows = docs.select(text_column, *kept)
    return rows.mapInArrow(find, with_fields(rows.schema.fields, f"n_runs long, start long, length long, period long, exponent_milli long, runs {RUN}, collapsed_text string"))


def _looped(text: Column, doc_id: Column) -> Column:
    """The text, for a tenth of the ids with what follows some place replaced by a loop."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("long")
        looped = let(
            F.struct(words.alias("w"), a.alias("a"), p.alias("p")),
            lambda s: F.array_join(F.transform(s["w"], lambda word, i: F.when(i < s["a"], word).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "),
        )
        return F.when(n > 0, looped).otherwise(text)

    return F.when(h % 10 == 0, let(F.array_remove(F.split(text, GAP), ""), loop)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the runs and the collapsed texts; the operator's own output is both in full."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text"))
    line = lambda run: F.concat(run["start"].cast("string"), F.lit(","), run["length"].cast("string"), F.lit(","), run["period"].cast("string"), F.lit("\n"))
    return periodic_runs(docs).select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


#: Runs are at least 24 words long and have three periods, so 8 words repeat a period later from at least 9 places in a row.
ORACLE_SQL = r"""
WITH bits AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
d0 AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
d1 AS (
  SELECT doc_id, w, len(w) AS n,
         xor(list_reduce([ascii(id[k]) FOR k IN range(1, len(id) + 1)], lambda c, v: xor(c >> 8, t[CAST(xor(c, v) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM d0, bits),
d2 AS (SELECT *, h // 10 AS g FROM d1),
d3 AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM d2),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END FOR i IN range(0, n)] ELSE w END AS w
  FROM d3),
gram AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 7)) AS i FROM d WHERE n >= 24)),
hit AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM gram a JOIN gram b ON b.doc_id = a.doc_id AND b.s = a.s AND b.i > a.i),
isle AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM hit) GROUP BY doc_id, q, isle),
run AS (SELECT doc_id, start, length, min(q) AS period FROM isle WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(best.length * 1000 // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i + 1] FOR i IN range(0, n) IF NOT list_contains(gone, i)] END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
