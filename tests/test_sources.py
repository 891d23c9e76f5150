import json

from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import match_ratio
from loomgraph.operators import linking, ontology
from loomgraph.sources import datasets, files, graphs
from loomgraph.streaming import progress, windows


def test_adapters(spark):
    raw = spark.createDataFrame([("1", "Is it?", ["a", "b"], "Yes ", "long")], "id string, QUESTION string, CONTEXTS array<string>, final_decision string, LONG_ANSWER string")
    row = datasets.ADAPTERS["pubmedqa"](raw).first()
    assert (row["answer"], row["task_type"], row["options"]["maybe"], row["contexts"]) == ("yes", "binary", "maybe", ["a", "b"])
    raw = spark.createDataFrame([("1", "Q", "w", "x", "y", "z", 3)], "id string, question string, opa string, opb string, opc string, opd string, cop int")
    assert datasets.ADAPTERS["medmcqa"](raw).first()["answer"] == "y"
    raw = spark.createDataFrame([("h", "Q", "yes", "comparison", [("T", ["One. ", "Two."])])], "_id string, question string, answer string, type string, context array<struct<title:string,sentences:array<string>>>")
    row = datasets.ADAPTERS["hotpotqa"](raw).first()
    assert (row["contexts"], row["context_titles"], row["task_type"]) == (["T. One. Two."], ["T"], "binary")
    raw = spark.createDataFrame([(None, "Q", {"0": "x", "1": "y"}, "", "1")], "id string, question string, options map<string,string>, answer string, answer_idx string")
    row = datasets.ADAPTERS["medqa"](raw).first()
    assert (row["answer"], row["options"]) == ("y", {"A": "x", "B": "y"}) and len(row["id"]) == 64
    raw = spark.createDataFrame([("m", "Q", ["s"], ["c1", "c2"], "c2")], "id string, query string, supports array<string>, candidates array<string>, answer string")
    record = datasets.ADAPTERS["medhop"](raw)
    assert record.first()["options"] == {"A": "c1", "B": "c2"} and "answer" not in datasets.inference(record).columns
    assert datasets.gold(record).first()["short_answer"] == "c2" and datasets.passages(record).first()["text"] == "s"
    raw = spark.createDataFrame([("2hop__1", "Q", "A", ["B"], [("T", "T is x"), ("U", "is y")])], "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title:string,paragraph_text:string>>")
    row = datasets.ADAPTERS["musique"](raw).first()
    assert row["contexts"] == ["T is x", "U. is y"] and row["aliases"] == ["B"]
    raw = spark.createDataFrame([("f", "Q", "factoid", ["x", "y"], "i", ["s"]), ("l", "Q", "list", ["x"], "i", ["s"])], "id string, body string, type string, exact_answer array<string>, ideal_answer string, snippets array<string>")
    rows = datasets.ADAPTERS["bioasq"](raw).collect()
    assert [(r["answer"], r["aliases"]) for r in rows] == [("x", ["y"])]


def test_delimited_files(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a|text|b\n1|hello|x\n2| |y\n3|bye|z\n")
    rows = files.read_delimited(spark, str(path), "text", delimiter="|").collect()
    assert [(r["id"], r["text"], r["metadata"]["a"]) for r in rows] == [("row_0", "hello", "1"), ("row_2", "bye", "3")]
    rows = files.read_delimited(spark, str(path), "text", id_column="a", delimiter="|", start_row=1, max_rows=2).collect()
    assert [r["id"] for r in rows] == ["3"]
    kinds = {r["path"].rsplit(".")[-1]: r["accepted"] for r in files.acceptable_files(spark, str(tmp_path)).collect()}
    assert kinds == {"csv": True}


def test_ontology_layouts(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"entity_types": [{"id": "drug_class"}, {"name": "Disease"}], "relationships": [{"type": "TREATS", "from": "drug_class", "to": "Disease"}]}))
    types, relations = files.read_ontology(spark, str(path))
    assert {(r["id"], r["label"]) for r in types.collect()} == {("drug_class", "Drug Class"), ("Disease", "Disease")}
    assert tuple(relations.first()) == ("TREATS", "Treats", "drug_class", "Disease")


def test_typing(spark):
    types = spark.createDataFrame([("Drug", "Medicine"), ("Disease", "Illness"), ("Thing", "Thing")], "id string, label string")
    names = spark.createDataFrame([("medicine",), ("Diseases",), ("zzz",), ("",)], "raw string")
    assert {r["raw"]: r["type_id"] for r in ontology.match_types(names, types).collect()} == {"medicine": "Drug", "Diseases": "Disease", "zzz": None}
    entities = spark.createDataFrame([("1", "aspirin", "drugs"), ("2", "illness", None), ("3", "disease", "qq"), ("4", "x", "qq")], "entity_id string, name string, type string")
    assert {r["entity_id"]: r["type_id"] for r in ontology.coerce_types(entities, types).collect()} == {"1": "Drug", "2": "Thing", "3": "Disease", "4": "Thing"}
    relations = spark.createDataFrame([("TREATS", "Treats", "Drug", "Disease"), ("RELATED_TO", "Related", None, None)], "id string, label string, domain string, range string")
    edges = spark.createDataFrame([("a", "treat", "Drug", "Disease"), ("b", "zzz", "Drug", "Disease")], "edge_id string, rel_type string, source_type string, target_type string")
    assert {r["edge_id"]: r["relation"] for r in ontology.canonical_relations(edges, relations).collect()} == {"a": "TREATS", "b": "RELATED_TO"}


def test_match_ratio(spark):
    frame = spark.createDataFrame([("abcd", "bcde"), ("x", None), ("", "")], "a string, b string")
    assert [r[0] for r in frame.select(match_ratio("a", "b")).collect()] == [0.75, None, 1.0]


def test_graph_store_is_idempotent(spark, tmp_path):
    nodes = spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "b"), ("m", "a")], "kg_name string, entity_id string")
    edges = spark.createDataFrame([("k", "a", "b", "R"), ("k", "a", "gone", "R")], "kg_name string, src string, dst string, rel_type string")
    for _ in range(2):
        graphs.write_graph(nodes, edges, str(tmp_path))
    found, links = graphs.read_graph(spark, str(tmp_path), "k")
    assert found.count() == 2 and [(r["src"], r["dst"]) for r in links.collect()] == [("a", "b")]
    graphs.write_graph(nodes.filter("kg_name = 'm'"), edges.limit(0), str(tmp_path))
    assert graphs.read_graph(spark, str(tmp_path), "k")[0].count() == 2


def test_synonyms_and_duplicates(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x", 1), (2, [0.99, 0.1], "x", 5), (3, [0.0, 1.0], "x", 9), (4, [1.0, 0.0], "y", 1)], "vec_id long, embedding array<double>, scope string, degree int")
    assert {r["vec_id"]: r["canonical"] for r in linking.synonym_clusters(rows).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}
    nodes = spark.createDataFrame([("1", "t", "kitten"), ("2", "t", "sitten"), ("3", "t", "kiten"), ("4", "u", "kitten"), ("5", "t", "wholly other")], "node string, type string, name string")
    assert {(r["a"], r["b"]) for r in linking.duplicate_nodes(nodes).collect()} == {("1", "2"), ("1", "3"), ("2", "3")}
    close = F.col("c")
    pairs = spark.createDataFrame([("tumour factor", "factor x", False), ("tumour factor", "tumour", True), ("ab", "abc", False), ("one", "One", True)], "a string, b string, c boolean")
    assert pairs.filter(linking.may_be_synonyms(F.col("a"), F.col("b")) != close).count() == 0


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 02:00:00", "b", 3.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "1 hour", "10 minutes")
    run = out.writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["n"], r["total"]) for r in spark.table("tumbled").collect()) == [(1, 3.0), (2, 3.0)]
    assert sorted(r["n"] for r in windows.sessions(events, "1 hour").collect()) == [1, 2]


def test_progress_keeps_the_last_lines(spark, tmp_path):
    spark.range(0, 50).selectExpr("id AS seq", "concat('line ', id) AS line").coalesce(1).write.json(str(tmp_path / "in"))
    last = progress.LastLines(5)
    stream = spark.readStream.schema("seq long, line string").json(str(tmp_path / "in"))
    run = progress.follow(stream, last, str(tmp_path / "check"), once=True)
    run.awaitTermination(60)
    assert [line for _, line in last.lines] == [f"line {i}" for i in range(45, 50)]


def test_synonyms_of_dense_groups_meet(spark):
    dense = [(i, [1.0, 0.0], "x", 0) for i in range(60)] + [(i, [0.75, 0.66], "x", 0) for i in range(60, 120)]
    link = [(120, [0.93, 0.37], "x", 1)]
    blobs = spark.createDataFrame(dense + link, "vec_id long, embedding array<double>, scope string, degree int")
    assert {r["canonical"] for r in linking.synonym_clusters(blobs, 0.9).collect()} == {120}


def test_duplicates_of_short_names(spark):
    names = {"1": "", "2": "a", "3": "xy", "4": "abc", "5": "abcd", "6": "xyzzy", "7": "zz"}
    nodes = spark.createDataFrame([(key, "t", name) for key, name in names.items()] + [("8", "u", "a")], "node string, type string, name string")
    found = {(r["a"], r["b"]) for r in linking.duplicate_nodes(nodes).collect()}
    assert found == {("1", "2"), ("1", "3"), ("1", "7"), ("2", "3"), ("2", "4"), ("2", "7"), ("3", "7"), ("4", "5")}
