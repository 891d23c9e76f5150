"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are cut into words; A-Z counts as a-z. A benchmark item's windows are its
runs of ``window`` consecutive words; an item of fewer words, but not none, is
one window. A document's word is hit if it lies inside an occurrence of a window.

Method. With k-grams of ``k = window // 2`` words, every run of ``window``
words holds ``window - k + 1`` k-grams, and its fingerprint is the least k-gram
hash among them. Equal runs have equal fingerprints, so each shared run of at
least ``window`` words is found. Neighbouring runs with one fingerprint travel
as one row (the density of winnowing). Fingerprints of documents are joined
with those of the benchmark, and each hit is extended over every run that the
fingerprint stands for, comparing the words themselves. Items below ``window``
words have no such k-grams; they are matched by the hash of all their words,
against every position, and then compared in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, keeping_columns, let, materialize, plain_columns, read_table

#: What lies between words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

#: Bytes of benchmark windows, and of their items, up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_BYTES = 48 << 20

OUTPUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    found = F.array_remove(F.split(ascii_lower(text), GAP), "")  # only the ends can be empty
    return F.coalesce(found, F.array().cast("array<string>"))


def _positions(last: Column) -> Column:
    """0 .. last, or nothing where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _combined(values: Column, width: int, join: Callable[[Column, Column], Column]) -> Column:
    """``join`` over each ``width`` consecutive values, in about log2(width) passes over the array.

    ``join`` may see a value twice, so it is a minimum, or a hash of which only
    equality for equal runs is asked.
    """

    def paired(a: Column, step: int) -> Column:
        n = F.greatest(F.size(a) - step, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), join)

    def widen(a: Column, have: int) -> Column:
        if have == width:
            return a
        step = min(have, width - have)
        return let(paired(a, step), lambda b: widen(b, have + step))

    return let(values, lambda a: widen(a, 1))


def _long_spans(word_list: Column, window: int) -> Column:
    """Runs of window starts that share a fingerprint: array of (v, first, last, len)."""
    k = max(1, window // 2)
    per_window = window - k + 1

    def spans(minima: Column) -> Column:
        last = F.size(minima) - 1
        starts = F.filter(_positions(last), lambda i: (i == 0) | (F.get(minima, i) != F.get(minima, i - 1)))
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda first, at: F.struct(
                    F.get(minima, first).alias("v"),
                    first.alias("first"),
                    F.coalesce(F.get(s, at + 1) - 1, last).alias("last"),
                    F.lit(window).alias("len"),
                ),
            ),
        )

    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    grams = _combined(hashes, k, lambda a, b: F.xxhash64(a, b))
    return let(_combined(grams, per_window, lambda a, b: F.least(a, b)), spans)


def _short_spans(word_list: Column, length: int) -> Column:
    """Every position as a span of one window of ``length`` words."""
    return let(
        word_list,
        lambda w: F.transform(
            _positions(F.size(w) - length),
            lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, length)).alias("v"), i.alias("first"), i.alias("last"), F.lit(length).alias("len")),
        ),
    )


def item_windows(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Distinct windows of the benchmark's items: (v, len, run, item).

    ``run`` is the words joined by a space, ``v`` its fingerprint and ``item``
    the id, as a string, of an item that holds it. Items of equal id count as
    one; a null id counts as the id ``null``.
    """
    listed = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("item"), words(F.col(text_column)).alias("w")).filter(F.size("w") > 0)
    spans = F.when(F.size("w") >= window, _long_spans(F.col("w"), window)).otherwise(
        F.array(F.struct(F.xxhash64("w").alias("v"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.size("w").alias("len")))
    )
    spread = listed.select("item", "w", F.explode(spans).alias("s")).select("item", "w", "s.v", "s.len", F.explode(F.sequence("s.first", "s.last")).alias("at"))
    return spread.select("v", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("run"), "item").distinct()


@keeping_columns(OUTPUT)
def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each document's row with n_words, n_hit, n_items, items_sha256 and contaminated.

    Null text has no words. Rows of equal id and text get equal results, null
    ids as well; an empty benchmark hits nothing. Columns of the input that
    have one of the names of the results are replaced by them.
    """
    held = materialize(item_windows(items, window, item_id_column, item_text_column), "bench-items")
    windows = materialize(held.select("v", "len", "run").distinct().withColumn("wid", F.monotonically_increasing_id()), "bench-windows")
    owners = held.join(windows, ["v", "len", "run"]).select("wid", "item")
    size = lambda table, text: table.agg(F.sum(F.octet_length(text) + 48)).first()[0] or 0
    small = size(held, "run") <= broadcast_bytes
    fit = F.broadcast if small else (lambda table: table)
    lengths = sorted(row[0] for row in windows.filter(F.col("len") < window).select("len").distinct().collect())  # below ``window`` values

    keyed = docs.select(F.col(id_column).alias("_id"), F.xxhash64(F.col(text_column)).alias("_th"), words(F.col(text_column)).alias("w")).filter(F.size("w") > 0)
    found = [_long_spans(F.col("w"), window), *(_short_spans(F.col("w"), length) for length in lengths)]
    spans = keyed.select("_id", "_th", "w", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("s"))
    spans = spans.select("_id", "_th", "s.v", "s.len", "s.first", F.slice("w", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + F.col("s.len")).alias("span"))
    hits = spans.join(fit(windows.select("v", "len").distinct()), ["v", "len"], "left_semi")
    runs = hits.select("_id", "_th", "v", "len", "first", "span", F.explode(_positions(F.size("span") - F.col("len"))).alias("step"))
    runs = runs.select("_id", "_th", "v", "len", (F.col("first") + F.col("step")).alias("at"), F.array_join(F.slice("span", F.col("step") + 1, F.col("len")), " ").alias("run"))
    sure = runs.join(fit(windows), ["v", "len", "run"]).select("_id", "_th", "at", (F.col("at") + F.col("len")).alias("end"), "wid")

    before = W.partitionBy("_id", "_th").orderBy("at", "end").rowsBetween(W.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.lit(0))))
    per_doc = sure.withColumn("new", covered).groupBy("_id", "_th").agg(F.sum("new").alias("_hit"), F.collect_set("wid").alias("_wids"))
    named = per_doc.select("_id", "_th", "_hit", F.explode("_wids").alias("wid")).join(fit(owners), "wid")
    per_doc = named.groupBy("_id", "_th").agg(F.max("_hit").alias("_hit"), F.array_sort(F.collect_set("item")).alias("_items"))

    left = docs.withColumn("_n_words", F.size(words(F.col(text_column)))).withColumn("_own", F.xxhash64(F.col(text_column)))
    joined = left.join(per_doc, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_th")), "left")
    return joined.select(
        *plain_columns(docs, OUTPUT),
        F.col("_n_words").cast("long").alias("n_words"),
        F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", *OUTPUT)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, run)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
