"""What is counted of chunks is counted where they are."""

import re

from oracle import DATA

from loomgraph.plans import registry


def plan_of(spark, name) -> str:
    return registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_linked_ids_are_not_told_apart_twice(spark):
    assert not re.search(r"hashpartitioning\(query_id#\w+, chunk_id#\w+, position#\w+, entity_id", plan_of(spark, "chunks_for_entities"))


def test_hits_are_counted_where_their_chunk_lies(spark):
    assert not re.search(r"hashpartitioning\(item_id#\w+, tokens#\w+, chunk_id", plan_of(spark, "content_tokens"))
