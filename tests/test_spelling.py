"""Names that few edits part, and walks over the cluster, meet all they should and little else."""

import random

import pytest

from loomgraph.operators import alike, context, graph, linking


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("shortened", [32, 5])
def test_duplicates_are_all_pairs_of_few_edits(spark, shortened, monkeypatch):
    monkeypatch.setattr(linking, "SHORTENED", shortened)
    draw = random.Random(3)
    names = ["", "a", "ab", "ba", "abc"] + ["".join(draw.choice("ab") for _ in range(draw.randrange(9))) for _ in range(60)] + [f"Customer#{n:06d}" for n in (1, 10, 12, 21, 120, 5000, 5001)]
    rows = [(f"n{i}", "T" if i % 3 else "U", name) for i, name in enumerate(names)]
    expected = {(a, b) for a, t, x in rows for b, u, y in rows if a < b and t == u and edits(x.lower(), y.lower()) < 3}
    found = [tuple(r) for r in linking.duplicate_nodes(spark.createDataFrame(rows, "node string, type string, name string")).collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_names_with_a_common_beginning_meet_only_near_ones(spark):
    draw = random.Random(6)
    rows = spark.createDataFrame([("T", f"Customer#{draw.randrange(10**9):09d}") for _ in range(300)], "type string, name string")
    assert linking._met_shortened(rows, 2).filter("x <> y").distinct().count() < 300  # by their first six characters 44,850 would


def test_names_of_the_same_letters_meet_only_near_ones(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(12))
    known = [word() for _ in range(300)]
    asked = [n[:6] + "z" + n[6:] for n in known[:100]] + [n[:-1] for n in known[100:200]]
    left, right = (spark.createDataFrame([(n,) for n in names], "name string") for names in (asked, known))
    found = alike.similar_names(left, right, 0.87)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a, b in zip(asked, known, strict=False)}
    assert "letter" not in plan_of(found)


def test_chunks_that_no_strong_entity_brings_are_not_scored(spark):
    chunks = spark.createDataFrame([(1, "c1", 0.6), (1, "c2", 0.4), (2, "c3", 0.2)], "query_id int, chunk_id string, cosine double")
    mentions = spark.createDataFrame([("c1", "x"), ("c1", "y"), ("c3", "y"), ("c4", "y"), ("c5", "x"), ("c5", "y")], "chunk_id string, entity_id string")
    walks = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.004), (2, "y", 0.002)], "query_id int, node string, score double")
    found = {(r["query_id"], r["chunk_id"]): round(r["score"], 6) for r in context.walked_chunks(chunks, mentions, walks).collect()}
    walk = (1 + 0.008) / 2 + 0.05
    assert found == {(1, "c1"): round(0.3 + 0.5 * walk, 6), (1, "c2"): 0.2, (1, "c5"): round(0.3 * walk, 6), (2, "c3"): 0.6}


def test_large_walks_gather_no_query_in_one_task(spark):
    nodes = spark.createDataFrame([(1, f"n{i}") for i in range(50)], "query_id int, node string")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i * 7 % 50}", 0.5) for i in range(50)], "query_id int, src string, dst string, confidence double")
    plans, kept = [], graph.cut
    graph.cut = lambda df: (plans.append(plan_of(df)), kept(df))[1]
    try:
        graph.personalized_pagerank(nodes, edges, nodes.limit(1), walked_edges=0).collect()
    finally:
        graph.cut = kept
    assert plans and not any("windowspecdefinition(query_id#" in line and ", src#" not in line for plan in plans for line in plan.splitlines() if "Window" in line)


def test_duplicates_send_nothing_through_the_driver(spark):
    names = spark.range(40).selectExpr("concat('n', id) AS node", "concat('T', id % 2) AS type", "concat('Customer#', lpad(string(id), 9, '0')) AS name")
    assert "Broadcast" not in linking.duplicate_nodes(names)._jdf.queryExecution().executedPlan().toString()
