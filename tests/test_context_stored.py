"""A context's chunks are chosen once, whatever asks for them, and the parts of a question are worked out once a question."""

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from loomgraph.operators import context
from loomgraph.plans import contexts, registry


@pytest.mark.parametrize("name", ["context_pruning", "context_totals", "retained_entities"])
def test_chunks_are_chosen_once(spark, name):
    assert "p_brand" not in registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_question_parts_may_come_with_chunks(spark):
    chunks = contexts.compared_chunks(spark, DATA)
    assert {"sides", "tokens"} <= set(chunks.columns)
    ranked = [context.sorted_for_query(rows).select("query_id", "chunk_id", "rank", "branches", "overlap") for rows in (chunks, chunks.drop("sides", "tokens"))]
    assert ranked[0].exceptAll(ranked[1]).count() == ranked[1].exceptAll(ranked[0]).count() == 0 and ranked[0].filter(F.col("overlap") > 0).count() > 0
