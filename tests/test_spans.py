import random
import re

from loomgraph.operators import spans

RNG = random.Random(3)


def slow_spans(text, given, most=12):
    """By one regular expression for each form: no word character touches a name, whatever its case."""
    found = set()
    for name in dict.fromkeys(candidate.strip().lower() for candidate in given):
        own = []
        for form in spans.forms_of(name):
            own += [m.span() for m in re.finditer(rf"(?<!\w){re.escape(form)}(?!\w)", text, re.IGNORECASE)]
        found |= set(own[:most])
    return sorted(found)


def test_spans_are_those_of_regular_expressions():
    letters = ["a", "B", "ab", "é", "x1", "_", "-", " ", " ", ".", "(", "日"]
    for _ in range(400):
        text = "".join(RNG.choice(letters) for _ in range(RNG.randrange(1, 60)))
        names = ["".join(RNG.choice(letters) for _ in range(RNG.randrange(1, 6))) for _ in range(6)]
        names = [name for name in names if name.strip()]
        found = spans.candidate_spans(text, [("k", names), ("other", names[:1])])
        assert found["k"] == slow_spans(text, names), (text, names)
        assert found["other"] == slow_spans(text, names[:1])


def test_a_candidate_has_so_many_spans_and_no_more():
    assert len(spans.candidate_spans("a " * 40, [("k", ["a"])])["k"]) == 12
    assert spans.candidate_spans("a a a a", [("k", ["a a"])])["k"] == [(0, 3), (4, 7)]
    assert spans.candidate_spans("new_york New York", [("k", ["New York"])])["k"] == [(0, 8), (9, 17)]


def test_mentions_are_the_same_by_one_automaton_and_by_words(spark):
    words = ["Aspirin", "pain", "acid", "(x)", "beta-2", "go", "a.b"]
    names = sorted({" ".join(RNG.choice(words) for _ in range(RNG.randrange(1, 4))) for _ in range(40)})
    texts = [" ".join(RNG.choice([*words, "other", "Aspirins", "pain."]) for _ in range(30)) for _ in range(60)] + ["", None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    entities = spark.createDataFrame([(f"e{k}", name) for k, name in enumerate(names)] + [("twin", names[0]), ("none", None), ("blank", " - ")], "entity_id string, name string")
    one = sorted(map(tuple, spans.mention_links(chunks, entities).collect()))
    assert one == sorted(map(tuple, spans.mention_links(chunks, entities, broadcast_bytes=0).collect()))
    low = {f"e{k}": name.lower() for k, name in enumerate(names)} | {"twin": names[0].lower()}
    expected = {(k, e) for k, text in enumerate(texts) if text for e, name in low.items() if re.search(rf"(?<![a-z0-9]){re.escape(name)}(?![a-z0-9])", text.lower())}
    assert {(row[0], row[1]) for row in one} == expected and len(one) == len(expected)


def test_quote_is_the_first_sentence_that_holds_the_name(spark):
    chunks = spark.createDataFrame([(1, "Nothing here. It treats Pain! Pain again."), (2, "x" * 300 + " pain-free" + "y" * 300)], "chunk_id long, text string")
    entities = spark.createDataFrame([("p", "pain")], "entity_id string, name string")
    found = {row["chunk_id"]: row["quote"] for row in spans.mention_links(chunks, entities).collect()}
    assert found[1] == "It treats Pain!" and found[2].startswith("xxx") and len(found[2]) == 500


def grounded(spark, text, relations):
    chunks = spark.createDataFrame([(7, text, 5, 100)], "chunk_id long, text string, position int, start_pos int")
    entities = spark.createDataFrame([(7, "Metformin", ["Metformin", None, " "]), (7, "AMPK", ["AMPK", "kinase AMPK"])], "chunk_id long, entity_id string, names array<string>")
    table = spark.createDataFrame(relations, "chunk_id long, relation_id string, source string, target string, rel_type string, anchor_text string, condition string")
    named, told = spans.grounded_extraction(chunks, entities, table)
    return {row["entity_id"]: row for row in named.collect()}, {row["relation_id"]: row for row in told.collect()}


def test_extraction_is_grounded_by_exact_spans(spark):
    rows = [
        (7, "full", "Metformin", "AMPK", "INHIBITS", "inhibits", "diabetic patients"),
        (7, "spaced", "Metformin", "AMPK", "in-diabetic", None, None),
        (7, "partial", "metformin", "AMPK", "ACTIVATES", None, None),
        (7, "minimal", "Aspirin", "AMPK", "ACTIVATES", None, None),
        (7, "failed", "Aspirin", "Pain", "ACTIVATES", None, ""),
    ]
    entities, relations = grounded(spark, "Metformin inhibits AMPK in diabetic patients.", rows)
    first = entities["Metformin"]["anchor_spans"][0]
    assert (first["text"], first["start"], first["end"], first["chunk_position"], first["local_start"]) == ("Metformin", 100, 109, 5, 0)
    assert entities["AMPK"]["anchor_mention_count"] == 1
    assert {key: row["restoration_status"] for key, row in relations.items()} == {"full": "full", "spaced": "full", "partial": "partial", "minimal": "minimal", "failed": "failed"}
    assert relations["full"]["restoration_verified"] and not relations["partial"]["restoration_verified"]
    assert relations["full"]["grounding"]["condition"][0]["text"] == "diabetic patients" and relations["full"]["grounded_components"] == ["source", "relation", "target"]
    assert relations["failed"]["grounding"] == {} and relations["minimal"]["grounded_components"] == ["target"]


def test_blank_texts_ground_nothing(spark):
    entities, relations = grounded(spark, "  ", [(7, "r", "Metformin", "AMPK", "INHIBITS", None, None)])
    assert entities["AMPK"]["anchor_mention_count"] == 0 and relations["r"]["restoration_status"] == "failed"


def test_groundings_are_merged_part_by_part(spark):
    span = "struct<text:string,start:bigint,end:bigint,chunk_position:int,local_start:int,local_end:int>"
    a, b = ("a", 3, 4, 0, 3, 4), ("b", 1, 2, 0, 1, 2)
    rows = spark.createDataFrame([({"source": [a, b]}, {"source": [a], "target": [b]}), (None, {"relation": [a]}), (None, None)], f"x map<string,array<{span}>>, y map<string,array<{span}>>")
    found = [row[0] for row in rows.select(spans.merged_groundings(rows["x"], rows["y"])).collect()]
    assert [{key: [tuple(s) for s in value] for key, value in row.items()} for row in found] == [{"source": [b, a], "target": [b]}, {"relation": [a]}, {}]
