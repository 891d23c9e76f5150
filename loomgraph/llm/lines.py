"""Line removal by winnowing over line hashes.

A line's hash is taken without the white space (20, 09-0D) at its ends; blank
lines have no part in it. A window is ``width`` consecutive lines of a
document that aren't blank. A run of fewer lines counts by its words: with
``words``, the shortest runs of whole lines with enough words are windows too,
one from each line on and one up to each line, so that every line of a repeated
run lies in a window that the run holds. A line is deleted if a window that
covers it also starts earlier: in a document of smaller id, or at an earlier
line of its own document. Repeats of fewer lines than ``width`` and fewer words
than ``words`` stay.

Method. Each window selects the place of its least line hash, a fingerprint:
equal windows select the same place, so each repeated run has one. Neighbouring
windows mostly select one place, and a place travels once, with the line hashes
to both sides as far as its windows reach. Places are joined, by fingerprint,
with the earliest place of theirs, and the match is extended line by line to
both sides: the windows inside it are repeats, and since all of them hold the
place they are one run. A fingerprint's earliest place may have other lines
around it than a later one; windows that a match leaves out look for the
earliest place of their own lines, by their hash. Both kinds of earliest place
are aggregates that are written and joined back, so a line that a third of all
documents hold is never one task's.

A first pass sends the windows' hashes alone and sets, in a bitmap of bounded
size, a bit for each that occurs twice; the others select nothing. The bitmap
holds no repeat back, so results don't depend on its size.

Lines are compared by hashes of 64 bits. Two different ones of ``n`` distinct
lines of a corpus share one with a probability of some n * n / 4e19, and matter
only where the lines around them agree as well or where one line is a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bitmap import repeated_hashes
from loomgraph.llm.common import bound_batches, discard, keeping_columns, materialize, plain_columns, plan_bytes, read_table, with_fields
from loomgraph.llm.runs import LAST, keyed, text_groups
from loomgraph.llm.spans import mix, power_tables

#: Lines of the shortest run that counts as repeated.
WIDTH = 3
#: Words, by white space, of the shortest run that counts whatever its lines.
WORDS = 10
#: Input bytes for each window.
WINDOW_BYTES = 25

OUTPUT = ["n_lines", "n_removed_lines", "kept_text"]


@dataclass
class Windows:
    """Windows of several documents by their number: first and last line, place of the least hash and the hash of all; the documents' lines end to end."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    lines: np.ndarray
    doc: np.ndarray
    begin: np.ndarray


def first_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The place of the least value, the first of equal ones, in each stretch."""
    out, size = first.copy(), last - first + 1
    step, level = 1, np.arange(len(values))
    while step <= size.max(initial=0):
        own = (size >= step) & (size < 2 * step)
        i, j = level[first[own]], level[last[own] - step + 1]
        out[own] = np.where(values[i] <= values[j], i, j)
        i, j = level[:-step], level[step:]
        level = np.where(values[i] <= values[j], i, j)
        step *= 2
    return out


def line_windows(texts: list[bytes], width: int, least: int | None) -> Windows:
    """The windows of texts by lines and, with ``least``, by words."""
    digest = xxhash.xxh3_64_intdigest
    hashes: list[int] = []
    sizes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = [line for line in map(bytes.strip, text.split(b"\n")) if line]
        counts[i] = len(own)
        hashes += map(digest, own)
        sizes += [len(line.split()) for line in own] if least else []
    values = np.array(hashes, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    end = (begin + counts - 1)[doc]
    at = np.arange(len(values))
    fits = at + width - 1 <= end
    pairs = [(at[fits] << 32) | (at[fits] + width - 1)]
    if least:
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.array(sizes, np.int64))))
        last = np.searchsorted(sums, sums[:-1] + least) - 1  # from each line on
        first = np.searchsorted(sums, sums[1:] - least, side="right") - 1  # up to each line
        on, upto = last <= end, first >= begin[doc]
        pairs += [(at[on] << 32) | last[on], (first[upto] << 32) | at[upto]]
    spans = np.unique(np.concatenate(pairs))
    a, b = spans >> 32, spans & 0xFFFFFFFF
    up, down = power_tables(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
    whole = mix((total[b + 1] - total[a]) * down[a] + (b + 1 - a).astype(np.uint64))
    return Windows(a, b, first_minima(values, a, b), whole, values, doc, begin)


def selected_places(windows: Windows, held: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """(document, place in it, fingerprint, line hashes to the left from the nearest one, to the right, windows) of each place that held windows select.

    Windows are numbers of lines to the left and to the right of the place.
    """
    order = held[np.argsort(windows.place[held], kind="stable")]
    if not len(order):
        return
    place = windows.place[order]
    reach = np.stack((place - windows.first[order], windows.last[order] - place), axis=1).astype("<u4")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    most = np.maximum.reduceat(reach, edges, axis=0).tolist()
    ends = [*edges[1:].tolist(), len(order)]
    lines = windows.lines
    for (left, right), a, b, p in zip(most, edges.tolist(), ends, place[edges].tolist(), strict=True):
        doc = int(windows.doc[p])
        yield doc, p - int(windows.begin[doc]), int(lines[p]), lines[p - left : p][::-1].tobytes(), lines[p + 1 : p + 1 + right].tobytes(), reach[a:b].tobytes()


def agreeing(one: bytes, two: bytes) -> int:
    """How many line hashes two sides begin with alike."""
    n = min(len(one), len(two))
    if one[:n] == two[:n]:
        return n // 8
    return next(k for k in range(0, n, 8) if one[k : k + 8] != two[k : k + 8]) // 8


def extended(mark: int, left: bytes, right: bytes, reach: bytes, other_left: bytes, other_right: bytes) -> tuple[tuple[int, int] | None, list[tuple[int, int, bytes]]]:
    """The lines to both sides of a place that repeat another place's, as far as windows do, and the windows that don't, each with a hash."""
    near, far = agreeing(left, other_left), agreeing(right, other_right)
    run, rest = None, []
    for x, y in np.frombuffer(reach, "<u4").reshape(-1, 2).tolist():
        if x <= near and y <= far:
            run = (max(x, run[0]), max(y, run[1])) if run else (x, y)
        else:
            rest.append((x, y, xxhash.xxh3_128_digest(b"%d,%d,%d," % (mark, x, y) + left[: 8 * x] + right[: 8 * y])))
    return run, rest


def kept_lines(text: str, runs: list | None) -> tuple[str, int, int]:
    """The text without the lines of repeated windows, its lines that aren't blank, and those deleted."""
    lines = text.split("\n")
    full = [i for i, line in enumerate(lines) if line.strip(" \t\n\r\x0b\x0c")]
    if not runs:
        return text, len(full), 0
    gone = np.zeros(len(full) + 1, np.int64)
    for run in runs:
        gone[run["first"]] += 1
        gone[run["last"] + 1] -= 1
    drop = {full[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) > 0).tolist()}
    return "\n".join(line for i, line in enumerate(lines) if i not in drop), len(full), len(drop)


def repeated_windows(docs: DataFrame, width: int, words: int | None, id_column: str, text_column: str) -> DataFrame:
    """Repeated windows, by row: _kid, _th, _null and an array ``runs`` of (first, last)."""
    spark = docs.sparkSession
    bound_batches(spark)
    listed = docs.filter(F.col(text_column).isNotNull()).select(*keyed(docs, id_column, text_column), F.col(text_column))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for texts, _ in text_groups(batches):
            yield line_windows(texts, width, words).hash

    shared = spark.sparkContext.broadcast(repeated_hashes(listed, hashes, plan_bytes(docs) // WINDOW_BYTES))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark", "at", "left", "right", "reach", "_kid", "_th", "_null"]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()]
        for texts, rows in text_groups(batches):
            found = line_windows(texts, width, words)
            held = np.flatnonzero(shared.value.holds(found.hash))
            places = [(mark - (mark >> 63 << 64), at, left, right, reach, *rows[doc]) for doc, at, mark, left, right, reach in selected_places(found, held)]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*places, strict=True) if places else [()] * 8, kinds, strict=True)], names=names)

    places = materialize(listed.mapInArrow(spread, "mark long, at int, left binary, right binary, reach binary, _kid long, _th int, _null boolean"), "line-places")
    shared.destroy()
    rank = F.when(F.col("_null"), F.lit(int(LAST))).otherwise(F.col("_kid")).alias("rank")
    firsts = places.groupBy("mark").agg(F.min(F.struct(rank, "at", "left", "right")).alias("early"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = materialize(firsts, "line-firsts")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_kid", "_th", "_null", "first", "last", "at", "window"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out = []
            for mark, at, left, right, reach, kid, th, null, own, early in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                same = (own, at) == (early["rank"], early["at"])
                if same and (left, right) == (early["left"], early["right"]):
                    continue  # the earliest place itself
                run, rest = extended(mark, left, right, reach, *((b"", b"") if same else (early["left"], early["right"])))
                if run and not same:
                    out.append((kid, th, null, at - run[0], at + run[1], at, None))
                out += [(kid, th, null, at - x, at + y, at, window) for x, y, window in rest]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], names=names)

    met = places.withColumn("rank", rank).join(firsts, "mark").select("mark", "at", "left", "right", "reach", "_kid", "_th", "_null", "rank", "early")
    found = materialize(met.mapInArrow(extend, "_kid long, _th int, _null boolean, first int, last int, at int, window binary"), "line-runs")
    place = F.struct(rank, "at")
    open_ = found.filter("window IS NOT NULL")
    earliest = open_.groupBy("window").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = open_.join(materialize(earliest, "line-windows"), "window").filter(place > F.col("earliest"))
    columns = ["_kid", "_th", "_null", "first", "last"]
    sure = found.filter("window IS NULL").select(columns).unionByName(later.select(columns))
    discard(places, firsts)
    return sure.groupBy("_kid", "_th", "_null").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


@keeping_columns(OUTPUT)
def remove_lines(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text", words: int | None = WORDS) -> DataFrame:
    """Each row with n_lines (not blank), n_removed_lines and kept_text.

    A text without repeats is returned as it is; null stays null and has no
    lines. What is left of a text keeps its blank lines, and may be empty. Ids
    are whole numbers. A null id counts as greater than every other; equal ids
    count as one document at one place, so repeated rows leave each other
    alone. Input columns with the results' names are replaced. Without
    ``words`` runs count by lines alone.
    """
    found = repeated_windows(docs, width, words, id_column, text_column)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, removed = [], [], []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, n, gone = kept_lines(text, runs) if text is not None else (None, 0, 0)
                kept.append(left)
                lines.append(n)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[2:], *OUTPUT])

    rows = docs.select(*keyed(docs, id_column, text_column), F.col(text_column).alias("_text"), *plain_columns(docs, OUTPUT))
    joined = rows.join(found, ["_kid", "_th", "_null"], "left").select("_text", "runs", *plain_columns(docs, OUTPUT))
    return joined.mapInArrow(apply, with_fields(joined.schema.fields[2:], "n_lines long, n_removed_lines long, kept_text string"))


def op7_remove_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the kept texts; the operator's own output is the texts."""
    out = remove_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH ln AS (
  SELECT doc_id, k, l, regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS l
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
num AS (
  SELECT doc_id, k, s, row_number() OVER w - 1 AS n, sum(wc) OVER w AS upto, sum(wc) OVER w - wc AS before
  FROM (SELECT *, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS wc FROM ln WHERE s <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
near AS (SELECT a.doc_id, a.n AS f, b.n AS l FROM num a JOIN num b ON b.doc_id = a.doc_id AND b.n BETWEEN a.n AND a.n + 9 AND b.upto - a.before >= 10),
span AS (
  SELECT doc_id, f, min(l) AS l FROM near GROUP BY doc_id, f
  UNION SELECT doc_id, max(f), l FROM near GROUP BY doc_id, l
  UNION SELECT a.doc_id, a.n, b.n FROM num a JOIN num b ON b.doc_id = a.doc_id AND b.n = a.n + 2),
win AS (SELECT span.doc_id, f, l, string_agg(s, chr(10) ORDER BY n) AS run FROM span JOIN num ON num.doc_id = span.doc_id AND n BETWEEN f AND l GROUP BY span.doc_id, f, l),
rep AS (SELECT doc_id, f, l FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, f) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS n FROM rep),
out AS (
  SELECT ln.doc_id, count(num.k) AS n_lines, count(gone.n) AS n_removed_lines,
         coalesce(string_agg(ln.l, chr(10) ORDER BY ln.k) FILTER (gone.n IS NULL), '') AS kept
  FROM ln LEFT JOIN num ON num.doc_id = ln.doc_id AND num.k = ln.k
  LEFT JOIN gone ON gone.doc_id = num.doc_id AND gone.n = num.n GROUP BY ln.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed_lines, 0) AS BIGINT) AS n_removed_lines,
       sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN out ON out.doc_id = d.doc_id
"""
