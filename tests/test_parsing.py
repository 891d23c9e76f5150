import json

from pyspark.sql import functions as F

from loomgraph.functions import parsing


def read(spark, *texts):
    rows = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "k int, t string")
    return [row["x"].asDict(True) for row in rows.select("k", parsing.extracted(F.col("t")).alias("x")).orderBy("k").collect()]


def test_objects_are_cut_at_their_own_brace(spark):
    texts = ['say {"a": "}\\"{", "b": {"c": 1}} and {more}', "{ {", "none", None, "```json\n{\"a\": 1}\n```", "```{}```", '{"a": "\\\\"} x', "} {"]
    rows = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "k int, t string").orderBy("k")
    assert [row[0] for row in rows.select(parsing.first_object(parsing.without_fences(F.col("t")))).collect()] == ['{"a": "}\\"{", "b": {"c": 1}}', None, None, None, '{"a": 1}', "{}", '{"a": "\\\\"}', None]


def test_extractions_are_normalised(spark):
    whole = {"entities": ["Aspirin", {"id": 5, "type": " "}, {"id": "x", "type": "Drug", "properties": {"name": "X", "description": "d"}}, {"type": "Drug"}, None, [1]], "relationships": [{"source": "a", "target": "b", "type": "T"}, {"source": 1, "target": "b"}, "r", {"source": "a"}]}
    found, bad, none, no_list = read(spark, json.dumps(whole), "[1, 2]", None, '{"entities": "x", "relationships": {"a": 1}}')
    assert [(e["id"], e["type"], e["name"], e["description"]) for e in found["entities"]] == [("Aspirin", "Concept", "Aspirin", "Concept: Aspirin"), ("5", "Concept", "5", "Concept: 5"), ("x", "Drug", "X", "d")]
    assert found["relationships"] == [{"source": "a", "target": "b", "type": "T"}]
    assert bad == none == no_list == {"entities": [], "relationships": []}


def test_broken_answers_give_the_arrays_that_can_be_read(spark):
    trailing = '{"entities": [{"id": "a",},], "relationships": [{"source": "a", "target": "a"},]}'
    cut = '{"entities": [{"id": "a"}], "relationships": [{"source": "a", "target": "b"}, {"sou'
    lost = '{"entities": [{"id": "a"}, {"id'
    found = read(spark, trailing, cut, lost)
    assert [[e["id"] for e in row["entities"]] for row in found] == [["a"], ["a"], []]
    assert [len(row["relationships"]) for row in found] == [1, 0, 0]
