import pytest
from pyspark.sql import functions as F

from loomgraph.operators import entity_first as ef


@pytest.fixture(scope="module")
def store(spark):
    names = ["aspirin", "headache", "ibuprofen", "stomach", "clinic", "fever"]
    entities = spark.createDataFrame([(f"e{k}", name, k, [1.0 if j == k else 0.0 for j in range(6)]) for k, name in enumerate(names)], "entity_id string, name string, number long, embedding array<double>")
    links = [("a", "e0", "e1", "TREATS", 0.9), ("b", "e1", "e2", "TREATED_BY", 0.8), ("c", "e2", "e3", "HURTS", 0.7), ("d", "e0", "e4", "SOLD_IN", 0.3), ("m", "e0", "e5", "MENTIONS", 0.9)]
    edges = spark.createDataFrame(links, "edge_id string, src string, dst string, rel_type string, confidence double")
    mentions = spark.createDataFrame([(1, "e0"), (1, "e1"), (2, "e1"), (3, "e2"), (4, "e3"), (5, "e4"), (6, "e0"), (7, "e0"), (8, "e2")], "chunk_id long, entity_id string")
    rows = [(k, f"text of chunk {k}", "doc", 0 if k < 6 else 3 if k < 8 else 4, k, [0.0] * 5 + [1.0] if k == 8 else None) for k in range(1, 10)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, document string, passage int, position int, embedding array<double>")
    return ef.Store(entities, edges, mentions, chunks)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, question string, embedding array<double>, kg_name string, kind string")


def test_a_question_walks_from_what_it_names(spark, store):
    found = ef.entity_first(asked(spark, (1, "what does aspirin treat", None, None, None)), store)
    rows = {row["chunk_id"]: row for row in found.chunks.collect()}
    assert {row["entity_id"]: row["hops"] for row in ef.walked_entities(asked(spark, (1, "", None, None, None)), spark.createDataFrame([(1, "e0")], "query_id long, node string"), ef.readable_edges(store.edges)).collect()} == {"e0": 0, "e1": 1, "e2": 2}
    assert 5 not in rows and 4 not in rows  # a weak edge isn't walked, and three hops are too far
    assert {key: row["hops"] for key, row in rows.items()} == {1: 0, 2: 1, 6: 0, 7: 0} | ({3: 2} if 3 in rows else {}) | ({8: 2} if 8 in rows else {})
    assert sum(row["passage"] == 0 for row in rows.values()) <= 2  # of one passage
    assert {row["edge_id"] for row in found.edges.collect()} >= {"a"} and "d" not in {row["edge_id"] for row in found.edges.collect()}


def test_chunks_that_a_hop_led_to_lie_near_the_question(spark, store):
    near = asked(spark, (1, "what does aspirin treat", [0.0] * 5 + [1.0], None, None), (2, "what does aspirin treat", [1.0] + [0.0] * 5, None, None))
    rows = {(row["query_id"], row["chunk_id"]) for row in ef.entity_first(near, store).chunks.collect()}
    assert (1, 8) in rows and (2, 8) not in rows


def test_each_route_gets_what_the_one_before_left(spark, store):
    vector = [0.0] * 5 + [1.0]
    rows = [(1, "what does aspirin treat", None, None, "generic"), (2, "aspirin or ibuprofen", vector, None, "comparison"), (3, "chunk 7 text", None, None, None), (4, "nothing", None, None, None), (5, "??", vector, None, None)]
    routes = {}
    for row in ef.retrieved_context(asked(spark, *rows), store).chunks.collect():
        routes.setdefault(row["query_id"], set()).add(row["route"])
    assert routes == {1: {"entity_first"}, 2: {"semantic_only"}, 3: {"text"}, 5: {"semantic_only"}}


def test_anchors_that_are_masked_or_alone_lead_nowhere(spark, store):
    question = asked(spark, (1, "what does aspirin treat", None, None, None), (2, "is the clinic open", None, None, None))
    masked = spark.createDataFrame([("e0",)], "entity_id string")
    assert ef.entity_first(question, store, masked=masked).chunks.count() == 0
    assert {row["query_id"] for row in ef.entity_first(question, store).chunks.collect()} == {1}  # one chunk is too few


def test_graphs_have_limits_of_their_own(spark):
    rows = spark.createDataFrame([(" MultiHopRAG ",), ("hotpotqa",), (None,)], "kg string")
    seeds, grounding = ef.by_graph(F.col("kg"), ef.SEED_LIMITS, ef.SEED_LIMIT), ef.by_graph(F.col("kg"), ef.LEAST_GROUNDINGS, ef.LEAST_GROUNDING)
    assert [tuple(row) for row in rows.select(seeds, grounding).collect()] == [(12, 0.20), (24, 0.30), (24, 0.25)]
