"""Chunks, reports, corpora, graph files and links by worked cases."""

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import chunking, linking
from loomgraph.sources import corpora, files, graphs, reports

TEXT = "Alpha beta gamma.\n\nDelta epsilon zeta eta theta.\nIota kappa\n\n" + "x" * 30


def test_recursive_chunks():
    chunks = chunking.split_text(TEXT, 20, 6)
    assert chunks[:2] == ["Alpha beta gamma.", "Delta epsilon zeta"] and all(len(c) <= 20 for c in chunks)
    spans = chunking.located(TEXT, chunks)
    assert all(TEXT[a:b] == c for (a, b), c in zip(spans, chunks)) and [a for a, _ in spans] == sorted(a for a, _ in spans)
    assert chunking.split_text("a b c d e", 5, 3) == ["a b c", "c d", "d e"] and chunking.split_text("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"] and chunking.split_text(" \n ", 5, 0) == []
    assert chunking.located("ab", ["zz"]) == [(0, 2)]


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "Intro line\nMethods\nWe did it all here.\nResults:\nIt worked."), (2, None), (3, "  "), (4, "plain")], "doc_id long, text string")
    rows = chunking.recursive_chunks(docs, 12, 4).orderBy("doc_id", "position").collect()
    text = docs.first()["text"]
    assert {r["doc_id"] for r in rows} == {1, 4} and all(text[r["start_pos"] : r["end_pos"]] == r["chunk"] for r in rows if r["doc_id"] == 1)
    assert chunking.recursive_chunks(docs, 12, 4, most=1).count() == 2
    segments = chunking.section_segments(docs).orderBy("doc_id", "start").collect()
    assert [(s["section"], s["segment"].split("\n")[0]) for s in segments] == [("Preamble", "Intro line"), ("Methods", "Methods"), ("Results", "Results:"), ("Preamble", "plain")]
    found = chunking.sectioned_chunks(docs, 12, 4).filter("doc_id = 1").orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(len(found))) and all(text[r["start_pos"] : r["end_pos"]] == r["chunk"] for r in found)
    small = chunking.retrieval_chunks(spark.createDataFrame([("c", "y" * 100, 10)], "chunk_id string, chunk string, start_pos int"), size=1, overlap=500)
    assert [(r["start_pos"], len(r["chunk"])) for r in small.orderBy("local_index").collect()][0] == (10, 64)
    with pytest.raises(ValueError):
        chunking.recursive_chunks(docs, 5, 5)


def test_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    reports.write_template(spark, path, rows=[{"patient_id": "7", "sex": "F", "full_report_text": "word " * 40}])
    check = reports.check_reports(spark, path)
    assert check["is_valid"] and check["validation_errors"] == ["columns"] and check["field_mapping"]["sex"] == "sex"
    row = reports.read_reports(spark, path).first()
    assert (row["patient_id"], row["sections"], row["metadata"]) == ("7", {"sex": "F"}, {}) and row["text"].startswith("word")
    bad = reports.check_columns(spark, path, "nothing", "patient_id", "|")
    assert not bad["is_valid"] and len(bad["validation_errors"]) == 1
    assert reports.field_mapping(["Sex of patient", "patient sex", "SEX"], ["sex"]) == {"sex": "SEX"}


def test_corpora(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questions": [{"documents": ["http://x/pubmed/20", "9"], "snippets": [{"document": "http://x/pubmed/100"}]}, {"documents": ["none"], "snippets": []}]}')
    questions = corpora.read_records(spark, [str(tmp_path / "absent.json"), str(tmp_path / "q.json")], "questions")
    assert [r["pmid"] for r in corpora.referenced_pmids(questions).collect()] == ["9", "20", "100"]
    with pytest.raises(FileNotFoundError):
        corpora.first_existing(spark, [str(tmp_path / "absent.json")])
    (tmp_path / "a.xml").write_text(
        "<S><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='AIM'>one</AbstractText>"
        "<AbstractText>two</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID></PMID></MedlineCitation></PubmedArticle></S>"
    )
    assert [tuple(r) for r in corpora.read_abstracts(spark, str(tmp_path / "a.xml")).collect()] == [("5", "T", "AIM: one\ntwo")]
    context = spark.createDataFrame([([("T", [" a. ", "", "b"]), ("", ["c"])],), ([("T", ["a.", "b"]), ("U", [" "])],)], "context array<struct<title:string,sentences:array<string>>>")
    assert {tuple(r) for r in corpora.paragraph_corpus(context).collect()} == {("T", "T. a. b"), ("", "c"), ("U", "U.")}
    rows = spark.createDataFrame([("q", "r", "Completely", "completely"), ("q", "", "completely", "completely"), ("q", "r", "partially", "completely")], "Question string, Recommendation string, Plausible string, Answered string")
    assert corpora.ideal_records(rows).count() == 1


def test_owl(spark, tmp_path):
    (tmp_path / "o.owl").write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="http://x#Drug_class"><rdfs:comment>c</rdfs:comment></owl:Class><owl:Class rdf:about="http://x/Disease"><rdfs:label>Illness</rdfs:label></owl:Class>'
        '<owl:ObjectProperty rdf:about="http://x#treats"><rdfs:domain rdf:resource="http://x#Drug_class"/><rdfs:range rdf:resource="http://x/Disease"/></owl:ObjectProperty>'
        '<owl:DatatypeProperty rdf:about="http://x#dose"><rdfs:domain rdf:resource="http://x#Drug_class"/><rdfs:range rdf:resource="http://w#double"/><unit>mg</unit></owl:DatatypeProperty>'
        '<owl:DatatypeProperty rdf:about="http://x#since"><relationshipAttributeOf>treats</relationshipAttributeOf></owl:DatatypeProperty></rdf:RDF>'
    )
    types, relations, literal = corpora.read_owl(spark, str(tmp_path / "o.owl"))
    assert {tuple(r) for r in types.collect()} == {("Drug_class", "Drug Class", "c"), ("Disease", "Illness", None)}
    assert [tuple(r) for r in relations.collect()] == [("treats", "Treats", "Drug_class", "Disease")]
    assert {tuple(r) for r in literal.collect()} == {("Drug_class", "dose", "double", "mg", False), ("treats", "since", "string", None, True)}


def test_graph_files_and_runs(spark, tmp_path):
    nodes = spark.createDataFrame([("k", "a", "A"), ("k", "a", "B"), ("k", "b", "C")], "kg_name string, entity_id string, type string")
    edges = spark.createDataFrame([("k", "a", "b", "R", False, 0.4, [1, 3]), ("k", "a", "b", "R", False, 0.9, [1, 2]), ("k", "a", "b", "R", True, 0.5, [4])], "kg_name string, src string, dst string, rel_type string, negated boolean, confidence double, positions array<int>")
    graphs.write_graph(nodes, edges, str(tmp_path / "g"))
    own, rows = graphs.read_graph(spark, str(tmp_path / "g"), "k")
    assert {(r["entity_id"], r["type"]) for r in own.collect()} == {("a", "A"), ("b", "C")}
    assert {(r["negated"], r["confidence"], tuple(r["positions"]), r["copies"]) for r in rows.collect()} == {(False, 0.9, (1, 2, 3), 2), (True, 0.5, (4,), 1)}
    corpora.save_graph(nodes, edges, str(tmp_path / "j"))
    assert corpora.load_graph(spark, str(tmp_path / "j"))[1].count() == 3
    for run, n in (("r1", 3), ("r2", 1), ("r1", 2)):
        corpora.store_run(spark.range(n), str(tmp_path / "runs"), run)
    assert {tuple(r) for r in corpora.run_index(spark, str(tmp_path / "runs")).collect()} == {("r1", 2), ("r2", 1)}


def test_rows_are_numbered_without_gathering_them(spark):
    rows = spark.range(0, 100, 1, 7).repartition(5).withColumn("x", F.col("id"))
    assert sorted(r["_n"] for r in files._numbered(rows).collect()) == list(range(100))


def test_soft_links_and_bridges(spark):
    rows = [("1", "TP53 protein", "Gene"), ("2", "tp53", "Concept"), ("3", "TP53", "Drug"), ("4", "heart failure", "Disease"), ("5", "hf", "Disease"), ("6", "other", "Disease")]
    entities = spark.createDataFrame(rows, "entity_id string, name string, type string")
    found = {r["node"]: r["component"] for r in linking.softly_linked(entities).collect()}
    assert found == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "6"}
    apart = spark.createDataFrame([("1", "a"), ("3", "b"), ("4", "c")], "node string, component string")
    bridges = linking.component_bridges(apart, entities).collect()
    assert [(b["left"], b["right"], b["keys"], b["confidence"]) for b in bridges] == [("a", "b", ["tp53"], 0.95)]
    pairs = spark.createDataFrame([("heart attack", "attack"), ("heart failure", "hf"), ("color", "colour"), ("cat", "dog")], "a string, b string")
    assert [r[0] for r in pairs.select(linking.may_be_synonyms(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_library_lives_without_the_removable_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q)"
    assert importlib.util.find_spec("pyspark")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
