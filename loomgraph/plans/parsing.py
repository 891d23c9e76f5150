"""Queries on what a model wrote for JSON: extractions made from turns of conversations and damaged in several ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import parsing
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table


def answers(spark, sf_dir):
    """Each turn's first two longer words as an extraction, whole, fenced, wrapped, with trailing commas, cut short or not JSON at all."""
    turns = read_table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), F.lit(0))
    rows = turns.select("conv_id", "turn", F.col("turn") % 6 + 6 * (F.col("conv_id") % 2), F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("a")), F.lit(' {"x')).alias("a"), F.coalesce(F.get(words, F.lit(1)), F.lit("b")).alias("b"), ((F.col("turn") + F.col("conv_id")) % 6).alias("damage"))
    quoted = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)
    a, b = quoted(F.col("a")), quoted(F.col("b"))
    comma = F.when(F.col("damage") == 3, " ,\n").otherwise("")
    entities = F.concat(F.lit('"entities": [{"id": '), a, F.lit(', "type": "Drug"}, '), b, F.lit(', {"name": "none"}, {"id": 7, "properties": {"name": "seven"}}, 3'), comma, F.lit("]"))
    relations = F.concat(F.lit('"relationships": [{"source": '), a, F.lit(', "target": '), b, F.lit(', "type": "TREATS"}, "bad", {"source": 5, "target": '), b, F.lit("}"), comma, F.lit("]"))
    whole = F.concat(F.lit("{"), entities, F.lit(", "), relations, F.lit("}"))
    told = (
        F.when(F.col("damage") == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(F.col("damage") == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" and {more}")))
        .when(F.col("damage") == 4, F.concat(F.lit("{"), entities, F.lit(', "relationships": [{"source": "x", "target": "y"}, {"source": ')))
        .when(F.col("damage") == 5, F.concat(F.lit("I can't say; "), F.col("b")))
        .otherwise(whole)
    )
    return rows.select("conv_id", "turn", told.alias("answer"))


@query("extracted_answers", r"""WITH t AS (SELECT conv_id, turn, (turn + conv_id) % 6 AS damage, coalesce(w[1], 'a') || ' {"x' AS a, coalesce(w[2], 'b') AS b FROM (SELECT conv_id, turn, regexp_extract_all(text, '\p{L}{4,}') AS w FROM conversations))
SELECT conv_id, turn, CASE WHEN damage = 5 THEN '' ELSE a || '/Drug/' || a || '|' || b || '/Concept/' || b || '|7/Concept/seven' END AS entities, CASE WHEN damage IN (4, 5) THEN '' ELSE a || '>TREATS>' || b END AS relations FROM t""")
def extracted_answers(spark, sf_dir):
    found = answers(spark, sf_dir).withColumn("x", parsing.extracted(F.col("answer")))
    joined = lambda array, sign, *names: F.array_join(F.transform(array, lambda e: F.concat_ws(sign, *(e[name] for name in names))), "|")
    return found.select("conv_id", "turn", joined("x.entities", "/", "id", "type", "name").alias("entities"), joined("x.relationships", ">", "source", "type", "target").alias("relations"))


@query("answer_objects", r"""WITH t AS (SELECT conv_id, turn, (turn + conv_id) % 6 AS damage, coalesce(w[1], 'a') || ' {"x' AS a FROM (SELECT conv_id, turn, regexp_extract_all(text, '\p{L}{4,}') AS w FROM conversations))
SELECT conv_id, turn, CASE WHEN damage < 3 THEN a END AS first_id FROM t""")
def answer_objects(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", "turn", F.get_json_object(parsing.model_object(F.col("answer")), "$.entities[0].id").alias("first_id"))
