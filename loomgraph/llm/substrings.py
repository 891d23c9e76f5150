"""Substring removal by super-k-mer partitioning.

Words are what lies between bytes 20 and 09-0D, unchanged. A window is
``width`` consecutive words of one document; a word is removed if a window that
covers it also starts in a document of smaller id. Windows are judged on the
input, not on what is left. See :mod:`loomgraph.llm.runs` for the method.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import keeping_columns, plain_columns, read_table, with_fields
from loomgraph.llm.runs import Units, keyed, repeats
from loomgraph.llm.spans import Words

WIDTH = 13
#: Words of the k-grams that minimisers are chosen from.
GRAM = 4

OUTPUT = ["n_words", "n_removed", "kept_text"]


def word_units(texts: list[bytes]) -> Units:
    words = Words(texts)
    starts, ends, buffer = words.starts, words.ends, words.buffer
    return Units(words.hash, words.doc, words.at, lambda first, last: buffer[starts[first] : ends[last]])


def word_windows(pack: bytes, width: int) -> list[bytes]:
    words = pack.split(b" ")
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


@keeping_columns(OUTPUT)
def remove_substrings(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row with n_words, n_removed and kept_text (the kept words joined by one space).

    Null text has no words. Ids are whole numbers, or texts of them. A null id counts as greater than every other, so
    such a row keeps what no identified document has, and two such rows leave
    each other alone, as do rows of one id. Input columns with the results'
    names are replaced.
    """
    gram = min(GRAM, width)
    found = repeats(docs, id_column, text_column, word_units, lambda pack: word_windows(pack, width), width, gram)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, runs in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                runs = runs.as_py()
                if runs:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for run in runs:
                        gone[run["first"]] += 1
                        gone[run["first"] + run["n"] + width - 1] -= 1
                    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    removed.append(len(words) - len(left))
                    words = [words[i] for i in left.tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[2:], *OUTPUT])

    rows = docs.select(*keyed(docs, id_column, text_column), F.col(text_column).alias("_text"), *plain_columns(docs, OUTPUT))
    joined = rows.join(found, ["_kid", "_th", "_null"], "left").select("_text", "runs", *plain_columns(docs, OUTPUT))
    return joined.mapInArrow(apply, with_fields(joined.schema.fields[2:], "n_words long, n_removed long, kept_text string"))


def op8_remove_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the kept texts; the operator's own output is the texts."""
    out = remove_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
rep AS (
  SELECT win.doc_id, win.i FROM win JOIN (SELECT run, min(doc_id) AS first FROM win GROUP BY run) f USING (run) WHERE f.first < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM rep),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(ps, k)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
