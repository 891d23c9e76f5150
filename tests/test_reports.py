import zlib

import numpy as np
import pytest

from loomgraph.operators import report, scope, trust


def test_perturbation_by_hand(spark):
    rows = [(1, ["a", "b"], 0.5), (1, ["c"], 1.0), (2, ["x"], 1.0)]
    found = {r["query_id"]: r["instability"] for r in report.perturbation_stability(spark.createDataFrame(rows, "query_id long, edge_ids array<string>, weight double")).collect()}
    rng = np.random.default_rng(42 ^ zlib.crc32(b"1"))
    left = []
    for _ in range(16):
        n = max(1, round(rng.uniform(0.1, 0.4) * 3))
        gone = set(rng.choice(["a", "b", "c"], size=n, replace=False).tolist())
        left.append((0.5 * (not gone & {"a", "b"}) + 1.0 * ("c" not in gone)) / 1.5)
    assert found[1] == pytest.approx(1 - np.mean(left)) and found[2] == 1.0


def test_learned_certificate_is_trained_elsewhere(spark):
    rows = [(d * 100 + i, f"d{d}", i % 2 == 0, float(i % 2), 0.5, None) for d in range(2) for i in range(40)]
    frame = spark.createDataFrame(rows, "question_id long, dataset string, correct boolean, u1 double, u2 double, u3 double")
    found = {r["question_id"]: r["p_correct"] for r in report.learned_certificate(frame, ["u1", "u2", "u3"]).collect()}
    assert len(found) == 80 and all((p > 0.5) == (key % 2 == 0) and 0 <= p <= 1 for key, p in found.items())


def test_edges_without_places_fall_back(spark):
    edges = spark.createDataFrame([(1, "a", [1], [9], [7]), (1, "b", None, [2], [7]), (1, "c", [], [], [7]), (1, "d", [], None, []), (1, "e", [3], [2], [7])], "query_id int, edge_id string, positions array<int>, passages array<int>, question_ids array<int>")
    chunks = spark.createDataFrame([(1, 1, 2, 7)], "query_id int, position int, passage int, question_id int")
    assert sorted(r["edge_id"] for r in scope.supported_by_chunks(edges, chunks).collect()) == ["a", "b", "c", "d"]


def test_depth_matched_support_by_hand(spark):
    rows = [(1, "a", 1, 0.8, False, 2, 2), (1, "b", 2, 0.5, True, 1, 2), (1, "c", 3, 0.5, False, 2, 2), (1, "d", 4, 0.7, False, None, 2), (2, "a", 1, 0.1, False, 1, 1)]
    frame = spark.createDataFrame(rows, "query_id int, entity_id string, rank int, cosine double, surface boolean, length int, expected int")
    found = {r["query_id"]: (r["score"], r["null_reason"]) for r in trust.depth_matched_support(frame).collect()}
    assert found[1] == (pytest.approx(1 - (0.8 + 0.5 * 0.4) / 2.0), None) and found[2] == (0.5, "no_a_entities")


def test_hops_merge_once(spark):
    rows = [(1, "a", 2, 0.9), (1, "a", 1, 0.3), (1, "a", 1, 0.4), (1, "b", 2, 0.35), (1, "c", 3, 0.1)]
    found = [(r["chunk_id"], r["hop"], r["score"]) for r in report.merge_hops(spark.createDataFrame(rows, "query_id int, chunk_id string, hop int, score double"), 2).orderBy("rank").collect()]
    assert found == [("a", 1, 0.4), ("b", 2, 0.35)]


def test_learned_certificate_keeps_rows_without_dataset(spark):
    rows = [(d * 100 + i, f"d{d}" if d < 2 else None, i % 2 == 0, float(i % 2)) for d in range(3) for i in range(40)]
    frame = spark.createDataFrame(rows, "question_id long, dataset string, correct boolean, u1 double")
    found = {r["question_id"]: r["p_correct"] for r in report.learned_certificate(frame, ["u1"]).collect()}
    assert len(found) == 120 and all((p is None) == (key >= 200) for key, p in found.items())
