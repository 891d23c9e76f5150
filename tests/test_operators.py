import pytest
from pyspark.sql import functions as F

from loomgraph.operators import build, graph, retrieve, stats, uncertainty
from loomgraph.operators.chunking import fixed_windows, section_of


def test_confidence_ladder(spark):
    chunks = spark.createDataFrame([(1, "Aspirin treats pain. Other."), (2, "Aspirin here. Treats pain there."), (3, "aspirin"), (3, "pain"), (4, "aspirin"), (5, "nothing")], "group int, text string")
    triples = spark.createDataFrame([(i, "Aspirin", "pain", i) for i in range(1, 7)], "triple_id int, source string, target string, group int")
    found = {row["triple_id"]: row["confidence"] for row in build.triple_confidence(triples, chunks).collect()}
    assert found == {1: 1.0, 2: 0.7, 3: 0.4, 4: 0.3, 5: 0.1, 6: 0.5}


def test_pagerank_of_seeds(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "x")], "query_id int, node string")
    edges = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "a", 0.5), (1, "a", "a", 1.0)], "query_id int, src string, dst string, confidence double")
    seeds = spark.createDataFrame([(1, "a"), (2, "nowhere")], "query_id int, node string")
    scores = {(r["query_id"], r["node"]): r["score"] for r in graph.personalized_pagerank(nodes, edges, seeds).collect()}
    assert abs(scores[1, "a"] + scores[1, "b"] + scores[1, "c"] - 1) < 1e-12
    assert scores[1, "b"] > scores[1, "c"] == 0 and scores[2, "x"] == 0


def test_trails_keep_parallel_edges_apart(spark):
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "a", "b"), ("3", "b", "c")], "edge_id string, src string, dst string")
    seeds = spark.createDataFrame([(7, "a")], "query_id int, node string")
    paths = graph.expand_paths(seeds, edges, 2).collect()
    assert sorted("".join(p["edge_ids"]) for p in paths) == ["1", "12", "13", "2", "21", "23"]


def test_components_with_isolated_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40)], "src long, dst long")
    nodes = spark.range(0, 60).withColumnRenamed("id", "node")
    found = {r["node"]: r["component"] for r in graph.connected_components(nodes, edges).collect()}
    assert {found[i] for i in range(31)} == {0} and found[50] == found[40] == 40 and found[59] == 59


def test_auroc_leaves_out_nulls_and_one_class(spark):
    rows = spark.createDataFrame([("a", True, 0.9), ("a", False, 0.1), ("a", True, None), ("b", True, 0.3)], "g string, wrong boolean, u double")
    assert {r["g"]: r["auroc"] for r in stats.auroc(rows, ["g"]).collect()} == {"a": 1.0, "b": None}


def test_auroc_of_the_opposite(spark):
    rows = spark.createDataFrame([("a", i % 3 == 0, float(i % 7)) for i in range(40)], "g string, wrong boolean, u double")
    one, two = (stats.auroc(rows.withColumn("u", F.col("u") * sign), ["g"]).first()["auroc"] for sign in (1, -1))
    assert abs(one + two - 1) < 1e-12


def test_bootstrap_is_repeatable_on_any_partitioning(spark):
    rows = spark.createDataFrame([("a", i, i % 3 == 0, float(i * 37 % 101)) for i in range(60)], "g string, question_id long, wrong boolean, u double")
    one, two = (stats.bootstrap_auroc(rows.repartition(n), ["g"], draws=50).first() for n in (1, 5))
    assert one == two and 0 <= one["low"] <= one["median"] <= one["high"] <= 1


def test_generic_types_join_the_largest_bucket(spark):
    rows = spark.createDataFrame([("Cold", "Disease", "x"), ("cold", "Disease", None), ("the cold", "Weather", "y"), ("cold", "Concept", "z"), ("new", "Entity", None)], "name string, type string, description string")
    found = {(r["key"], r["bucket"]): r["mentions"] for r in build.harmonize_entities(rows).collect()}
    assert found == {("cold", "Disease"): 3, ("cold", "Weather"): 1, ("new", "Concept"): 1}


def test_vector_search_ties_and_empty_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in retrieve.vector_top_k(queries, vectors, 1).collect()] == [(1, 1)]
    assert retrieve.vector_top_k(queries.limit(0), vectors, 3).count() == 0
    assert retrieve.vector_top_k(queries, vectors.limit(0), 3).count() == 0


def test_relevance_gate_keeps_all_if_none_would_stay(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.2), (2, "c", 1, 0.1), (2, "d", 1, None)], "query_id int, chunk_id string, hops int, cosine double")
    assert sorted(r["chunk_id"] for r in retrieve.relevance_gate(rows).collect()) == ["a", "b", "d"]


def test_gumbel_sampling(spark):
    ranked = spark.createDataFrame([(1, str(i), i, 1.0 / i) for i in range(1, 40)], "query_id int, chunk_id string, rank int, score double")
    cold = [r["rank"] for r in retrieve.gumbel_top_k(ranked, 5).orderBy("rank").collect()]
    warm = [r["rank"] for r in retrieve.gumbel_top_k(ranked, 5, 1.0).orderBy("rank").collect()]
    assert cold == [1, 2, 3, 4, 5] and len(set(warm)) == 5 and max(warm) <= 15
    assert warm == [r["rank"] for r in retrieve.gumbel_top_k(ranked.repartition(7), 5, 1.0).orderBy("rank").collect()]


def test_lexical_clusters_are_greedy(spark):
    rows = spark.createDataFrame([(1, 1, "a b c"), (1, 2, "a b d"), (1, 3, "x"), (1, 4, None), (1, 5, "")], "question_id long, sample_id long, text string")
    assert [r["cluster"] for r in uncertainty.lexical_clusters(rows).orderBy("sample_id").collect()] == [0, 0, 1, 2, 2]


def test_spectral_metrics_bounds(spark):
    rows = spark.createDataFrame([(1, i, [1.0, 0.0], [0.0, 1.0]) for i in range(4)] + [(2, 1, [1.0, 0.0], [0.0, 1.0])], "question_id long, sample_id long, embedding array<double>, question_embedding array<double>")
    found = {r["question_id"]: r for r in uncertainty.spectral_metrics(rows).collect()}
    assert abs(found[1]["vn_entropy"]) < 1e-9 and found[2]["sd_uq"] == 0.5


def test_windows_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "abc")], "doc_id int, text string")
    found = [(r["doc_id"], r["chunk"]) for r in fixed_windows(docs, 4, 1).orderBy("doc_id", "position").collect()]
    assert found == [(1, "abcd"), (1, "defg"), (1, "ghij"), (3, "abc")]
    with pytest.raises(ValueError):
        fixed_windows(docs, 4, 4)


def test_sections_as_of(spark):
    headers = spark.createDataFrame([(1, 5, "Methods"), (1, 9, "Results")], "doc_id int, pos int, section string")
    positions = spark.createDataFrame([(1, 4), (1, 5), (1, 12)], "doc_id int, pos int")
    assert [r["section"] for r in section_of(positions, headers).orderBy("pos").collect()] == ["Preamble", "Methods", "Results"]


def test_symbolic_lookup_by_substrings(spark):
    asked = spark.createDataFrame([(1, "tell of myocardialinfarction"), (2, "neuro"), (3, "which glob clad words"), (4, "日本語の質問です")], "query_id long, question string")
    names = [("a", "infarction", None, None), ("b", "neurology", None, None), ("c", "hemoglobin ironclad", None, None), ("d", "日本語の", None, None), ("e", "unlike", "Neuro science", None), ("f", "unlike", None, ["x Glob Clad Words", "glob clad"]), ("g", "abc", "neuro", ["neuro"])]
    entities = spark.createDataFrame(names, "entity_id string, name string, source_title string, all_names array<string>")
    found = {(r["query_id"], r["entity_id"]) for r in retrieve.symbolic_lookup(asked, entities).collect()}
    assert found == {(1, "a"), (2, "b"), (3, "c"), (4, "d"), (2, "e"), (3, "f")}
    assert {(r["query_id"], r["entity_id"]) for r in retrieve.symbolic_lookup(asked, entities.select("entity_id", "name")).collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_walks_are_the_same_in_a_task_and_over_the_cluster(spark):
    import random

    rng = random.Random(2)
    nodes = [(q, f"n{k}") for q in range(6) for k in range(12)]
    edges = [(rng.randrange(6), f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice([0.4, 0.5, 0.9])) for _ in range(150)] + [(9, "n1", "n2", 0.5)]
    seeds = [(q, f"n{rng.randrange(12)}") for q in range(5) for _ in range(2)]
    tables = [spark.createDataFrame(nodes, "query_id long, node string"), spark.createDataFrame(edges, "query_id long, src string, dst string, confidence double"), spark.createDataFrame(seeds, "query_id long, node string")]
    found = [{(r["query_id"], r["node"]): round(r["score"], 12) for r in graph.personalized_pagerank(*tables, walked_edges=limit).collect()} for limit in (10**6, 0, 24)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(nodes) and sum(found[0].values()) > 3
