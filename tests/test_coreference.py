from pyspark.sql import functions as F

from loomgraph.operators import coreference as co

ENTITY = "document string, position int, place int, name string, type string, description string"


def told(spark, texts, rows):
    chunks = spark.createDataFrame([("d", k, text) for k, text in enumerate(texts)], "document string, position int, text string")
    found = co.resolved_chunks(chunks, spark.createDataFrame([("d", *row) for row in rows], ENTITY)).collect()
    return {row["position"]: row["resolved_text"] for row in found}


def test_demonstratives_give_way_to_what_was_spoken_of(spark):
    rows = [(0, 0, "amyotrophic lateral sclerosis", "Disease", None), (0, 1, "riluzole", "Drug", ""), (1, 0, "SOD1", "Gene", None)]
    texts = ["This disease starts here.", "This disease and THE  drug progress.", "This disease, the gene, the museum.", "This disease again; the allele.", "this disease"]
    assert told(spark, texts, rows) == {
        0: texts[0],  # nothing stands before it
        1: "amyotrophic lateral sclerosis and riluzole progress.",
        2: "amyotrophic lateral sclerosis, SOD1, SOD1.",  # a kind without a name takes the latest one
        3: "SOD1 again; SOD1.",  # two chunks back and no further
        4: texts[4],
    }


def test_descriptions_tell_kinds_and_names_are_taken_as_they_are(spark):
    rows = [(0, 0, "$1 \\x", "Thing", "an Enzyme of rats"), (0, 1, " ", "Disease", None)]
    assert told(spark, ["", "this protein, the rats", "the protein"], rows) == {0: "", 1: "$1 \\x, $1 \\x", 2: "the protein"}  # a phrase alone doesn't point back


def test_marker(spark):
    rows = spark.createDataFrame([("under these circumstances",), ("as stated earlier",), ("the control mice",), ("thistreatment",), (None,)], "t string")
    assert [row[0] for row in rows.select(co.points_back(F.col("t"))).collect()] == [True, True, True, False, False]
