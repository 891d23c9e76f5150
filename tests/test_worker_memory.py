"""What workers hold doesn't follow the texts, quotes or questions that they get at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from loomgraph.operators import spans
from loomgraph.operators.blocks import Block, nearest
from loomgraph.operators.retrieve import best_of_chunks


def texts_and_names(spark):
    texts = ["Aspirin, or ASPIRIN.", "aspirins", "Big Apple and apple_pie", "big  apple", None, "", "x-ray (aspirin)\nbig apple.", "Éaspirin K2"]
    names = ["aspirin", "Apple", "big apple", "x-ray", "k2", "aspirin\n", "--", None]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), spark.createDataFrame([(f"e{k}", name) for k, name in enumerate(names)], "entity_id string, name string")


def test_links_without_quotes_are_those_with_quotes(spark):
    chunks, entities = texts_and_names(spark)
    told = sorted((row["chunk_id"], row["entity_id"]) for row in spans.mention_links(chunks, entities).collect())
    for most in (spans.BROADCAST_BYTES, 0):
        assert sorted(map(tuple, spans.mention_links(chunks, entities, most, quotes=False).collect())) == told
    assert {(0, "e0"), (2, "e1"), (2, "e2"), (6, "e3"), (7, "e4")} <= set(told) and (1, "e0") not in told


def test_names_of_one_word_need_no_worker(spark):
    chunks, entities = texts_and_names(spark)
    plan = lambda links: links._jdf.queryExecution().executedPlan().toString()
    single = entities.filter("entity_id IN ('e0', 'e1', 'e4')")
    assert "MapInArrow" not in plan(spans.mention_links(chunks, single, quotes=False))
    assert "MapInArrow" in plan(spans.mention_links(chunks, entities, quotes=False))


def test_a_batch_of_quotes_is_handed_on_in_pieces():
    ids = pa.array([7, 8, 9], pa.int64())
    found = [[("a", "x" * 6), ("b", "x" * 6)], [], [("c", "x" * 6)]]
    batches = list(spans.quote_batches(ids, found, held=10))
    assert [batch.num_rows for batch in batches] == [2, 1]
    assert [row for batch in batches for row in zip(batch["chunk_id"].to_pylist(), batch["name"].to_pylist(), strict=True)] == [(7, "a"), (7, "b"), (9, "c")]


def block(rng, n, scopes=None) -> Block:
    return Block(list(range(n)), rng.normal(size=(n, 8)).tobytes(), 8, scopes)


def test_products_of_two_blocks_are_never_held_whole():
    rng = np.random.default_rng(1)
    vectors, queries = block(rng, 3000), block(rng, 3000)
    tracemalloc.start()
    ids, found, scores = nearest(vectors, queries, 3, -np.inf, False, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20  # one matrix of them all has 72 MB
    whole = np.round(queries.vectors @ vectors.vectors.T, 9)
    best = np.argsort(-whole, axis=1, kind="stable")[:, :3]
    assert ids.tolist() == np.repeat(np.arange(3000), 3).tolist() and found.tolist() == best.ravel().tolist()
    assert np.allclose(scores, np.take_along_axis(whole, best, 1).ravel())


def test_the_best_of_chunks_are_the_same_in_slices():
    rng = np.random.default_rng(2)
    chunks, tokens = block(rng, 1500), block(rng, 1500, [f"q:{k % 5}" for k in range(1500)])
    chunks.ids = chunks.ids // 3
    queries, names, own, best = best_of_chunks(chunks, tokens)
    whole = (tokens.vectors @ chunks.vectors.T).reshape(1500, 500, 3).max(axis=2)
    assert np.allclose(best.reshape(1500, 500), whole) and own[:500].tolist() == list(range(500))
    assert queries[::500].tolist() == list(range(1500)) and names[::500].tolist() == [k % 5 for k in range(1500)]
