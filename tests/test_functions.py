import uuid

from pyspark.sql import functions as F

from loomgraph.functions import answers as fa
from loomgraph.functions import text as ft
from loomgraph.functions.vectors import cosine


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} {kind}" for name, kind in ((n, {str: "string", int: "int", float: "double", list: "array<double>", type(None): "string"}[type(v)]) for n, v in values.items())))
    return frame.select(column.alias("x")).first()["x"]


def test_entity_key(spark):
    assert one(spark, ft.entity_key(F.col("a")), a="The  Tumor-Necrosis/Factor (TNF).") == "tumor_necrosis_factor_tnf"
    assert one(spark, ft.entity_key(F.col("a")), a=None) is None


def test_entity_names(spark):
    good = lambda name: one(spark, ft.is_entity_name(F.col("a")), a=name)
    assert good("aspirin") and good("IL-6") and good("p5")
    assert not (good("Treatment") or good("12") or good("--") or good("ab") or good("") or good(None))


def test_uuid5_is_the_standard_one(spark):
    assert one(spark, ft.uuid5(F.col("a")), a="aspirin:Drug") == str(uuid.uuid5(uuid.NAMESPACE_OID, "aspirin:Drug"))


def test_question_types(spark):
    kind = lambda question: one(spark, ft.question_type(F.col("a")), a=question)
    assert kind("Are both Alpha and Beta rivers?") == "comparison"
    assert kind("Which is older, Alpha Tower or Beta Tower?") == "comparison"
    assert kind("Who directed the film starring John Smith first?") == "bridge"
    assert kind("how many patients recovered") == "statistical"
    assert kind("explain this") == "semantic"
    assert kind("say hello") == "generic"


def test_relation_label(spark):
    label = ft.relation_label(F.col("t"), F.lit(True), F.col("c"), F.col("q"))
    assert one(spark, label, t="TREATS", c="in adults", q="20 mg") == "NOT TREATS [in adults] (20 mg)"
    assert one(spark, label, t="TREATS", c="at 20 MG", q="20 mg") == "NOT TREATS [at 20 MG]"


def test_confidence_words_and_numbers(spark):
    told = lambda value: one(spark, ft.confidence(F.col("a")), a=value)
    assert [told(v) for v in ("1.7", "-2", "0.4", "High", "n/a", "nan", None)] == [1.0, 0.0, 0.4, 0.8, 0.0, 0.0, 0.0]


def test_alias_rescues_answer(spark):
    golds = F.array(F.lit("United States"), F.lit("the USA"), F.lit(" "))
    assert one(spark, fa.exact_match(F.col("a"), golds), a="USA.") == 1.0
    assert one(spark, fa.token_f1(F.col("a"), golds), a="USA.") == 1.0
    assert one(spark, fa.token_f1(F.col("a"), F.array(F.lit("yes"))), a="yes it is") == 0.0
    assert one(spark, fa.exact_match(F.col("a"), F.array(F.lit(" "))), a="") == 0.0


def test_token_f1_counts_tokens(spark):
    assert abs(one(spark, fa.token_f1(F.col("a"), F.array(F.lit("x x y"))), a="x z") - 0.4) < 1e-9


def test_failures(spark):
    failed = lambda text, gold: one(spark, fa.is_generation_failure(F.col("a"), F.lit(gold)), a=text)
    assert failed("", "x") and failed("HTTP 429", "x") and failed("Insufficient information.", "x") and failed("It is not mentioned in the text", "x")
    assert not failed("Insufficient information", "insufficient information") and not failed("Paris", "x")


def test_support_gate(spark):
    gate = lambda s, g, c: one(spark, fa.support_gate(F.col("s"), F.col("g"), F.col("c")), s=s, g=g, c=c)
    assert gate(0.1, 0.2, 0.9) == "abstain" and gate(0.1, 0.9, 0.9) == "keep" and gate(0.1, float("nan"), 0.9) == "keep"


def test_cosine_of_odd_vectors(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0]) == 0.0
    assert abs(one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[2.0, 2.0]) - 1) < 1e-12


def test_sections(spark):
    from loomgraph.functions import passages as fp

    text = "Intro text\nABSTRACT:\nsome\n2.1 Materials and Methods\nmore\nResults and discussion"
    assert [tuple(h) for h in one(spark, fp.section_headers(F.col("a")), a=text)] == [(11, "Abstract"), (26, "Methods"), (57, "Results")]
    assert one(spark, fp.section_headers(F.col("a")), a="none") == []


def test_qualifiers_and_titles(spark):
    from loomgraph.functions import passages as fp

    assert one(spark, fp.qualifier_sentences(F.col("a"), 2), a="Patient one. Nothing. In vivo two! Control three?") == "In vivo two! Control three?"
    assert one(spark, fp.passage_title(F.col("a"), F.lit(True)), a="Title: Paris \nIt is. A city") == "Paris"
    assert one(spark, fp.passage_title(F.col("a"), F.lit(True)), a="Paris. A city") == "Paris"
    assert one(spark, fp.passage_title(F.col("a"), F.lit(False)), a="Paris. A city") is None
    assert one(spark, fp.title_variants(F.col("a")), a="The Cold (film)") == ["cold_film", "cold"]
    assert one(spark, fp.scope_key(F.col("a"), F.lit("q1"), F.lit(3)), a="d") == "d/q1/p3"
    assert one(spark, fp.scope_key(F.col("a"), F.lit("q1"), F.lit(3)), a=" ") is None


def test_wrappers_and_verdicts(spark):
    assert one(spark, fa.strip_wrapper(F.col("a")), a="Final answer: Paris. \nBecause") == "Paris"
    assert one(spark, fa.strip_wrapper(F.col("a")), a="Paris") == "Paris"
    verdict = lambda raw: one(spark, fa.guardrail_verdict(F.col("a")), a=raw)
    assert [verdict(v) for v in ('{"decision": "Keep"}', 'so {"decision":"retry"} ok', "I would keep it", "?", None)] == ["keep", "retry", "keep", "abstain", "abstain"]


def test_expected_text(spark):
    held = lambda hay, needle: one(spark, fa.token_coverage_match(F.col("a"), F.col("b")), a=hay, b=needle)
    assert held("It is New-York City!", "new york") and held("the big red house stands", "big red old house stands") and held("yes", "yes")
    assert not held("eyes", "yes") and not held("red house", "big red house") and not held("", "x")
    right = lambda p, g, task: one(spark, fa.answered_correctly(F.col("p"), F.col("g"), F.array(F.lit("the USA")), F.lit(task), F.lit(None).cast("boolean")), p=p, g=g)
    assert right("Yes, it is", "yes", "binary") and not right("No.", "yes", "binary") and right("in the USA", "America", "free_text")
