"""Chunks of a text are told of beside it: no text is shuffled, and lists hold what the tables do."""

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from loomgraph.operators import chunking
from loomgraph.plans import registry

TEXTS = [(1, "Intro line\nMethods\nWe did it all here.\nResults:\nIt worked."), (2, None), (3, "  "), (4, "plain " * 40), (4, "twice the same id")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["recursive_chunks", "retrieval_chunks"])
def test_chunks_without_shuffles(spark, name):
    assert "Exchange" not in plan_of(registry.queries()[name](spark, DATA))


def test_lists_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chunking, "GATHERED", 10)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    listed = chunking.chunk_lists(docs, F.array("text", F.lit("one more")), F.array(F.lit(0), F.lit(100)), 12, 4)
    rows = {(r["doc_id"], r["text"]): r["chunks"] for r in listed.collect()}
    assert set(rows) == set(TEXTS)
    for (_, text), chunks in rows.items():
        assert [c["chunk"] for c in chunks if c["part"] == 0] == chunking.split_text(text or "", 12, 4)
        assert [(c["chunk"], c["start_pos"], c["total_chunks"]) for c in chunks if c["part"] == 1] == [("one more", 100, 1)]


def test_sectioned_chunks_without_shuffles(spark):
    assert "Exchange" not in plan_of(registry.queries()["sectioned_chunks"](spark, DATA))


def test_sectioned_chunks_of_rows_of_one_id(spark):
    """Each row's chunks are numbered for themselves, and no row gets another's sections."""
    docs = spark.createDataFrame([(7, "Methods\nWe did it all here."), (7, "Results:\nIt worked.")], "doc_id long, text string")
    found = chunking.sectioned_chunks(docs, 12, 4).groupBy("section").agg(F.min("position"), F.max("position"), F.count(F.lit(1))).collect()
    assert {tuple(r)[0] for r in found} == {"Methods", "Results"} and all(r[1] == 0 and r[2] == r[3] - 1 for r in found)
