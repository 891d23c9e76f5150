"""Near mentions and scoped edges by brute force, with questions dealt to more partitions, and no pair or second copy travelling."""

import random

from loomgraph.operators import scope

SCHEMA = "question_id long, entity_id string, passage int, position int"


def drawn():
    draw = random.Random(11)
    rows = [(draw.choice([1, 2, 3, None]), draw.choice(["a", "b", "c", "d", "e", None]), draw.choice([0, 1, None]), draw.choice([0, 1, 2, 5, 9, None])) for _ in range(60)]
    near = set()
    for q, a, g, p in rows:
        for q2, b, g2, p2 in rows:
            if None not in (q, a, p, b, p2) and q == q2 and (-1 if g is None else g) == (-1 if g2 is None else g2) and abs(p - p2) <= 1 and a != b:
                near.add((q, a, b))
    return rows, near


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_near_mentions_travel_once(spark, monkeypatch):
    monkeypatch.setattr(scope, "MENTIONS_EACH", 7, raising=False)
    rows, near = drawn()
    found = scope.near_mentions(spark.createDataFrame(rows, SCHEMA))
    assert shuffles(found) == 1
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == near


def test_scoped_edges_list_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(scope, "MENTIONS_EACH", 7, raising=False)
    rows, near = drawn()
    ends = [(q, a, b) for q in (1, 2, 3, None) for a in ("a", "b", "c", "f", None) for b in ("a", "b", "d", "e")]
    edges = [(f"e{k}", *end, confidence) for k, end in enumerate(ends) for confidence in (0.3, 0.5, 0.5, None)]
    found = scope.scoped_edges(spark.createDataFrame(edges, "edge_id string, question_id long, src string, dst string, confidence double"), spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["edge_id", "question_id", "src", "dst", "confidence"] and shuffles(found) == 1
    assert sorted(tuple(r) for r in found.collect()) == sorted(e for e in edges if e[4] == 0.5 and e[1:4] in near)
