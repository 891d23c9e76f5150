"""Question-answering datasets as records: what a system may see, and the gold answers apart.

Each adapter takes a table of raw records (as ``spark.read.json`` gives them)
and returns (id, dataset, question, contexts, context_titles, options,
task_type, answer, long_answer, aliases). :func:`inference` and :func:`gold`
split them, so that no gold answer travels with a question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINARY = ["yes", "no"]


def _texts() -> Column:
    return F.array().cast("array<string>")


def _no_options() -> Column:
    return F.expr("CAST(map() AS MAP<STRING, STRING>)")


def _record(raw: DataFrame, dataset: str, **columns: Column) -> DataFrame:
    given = {
        "contexts": _texts(), "context_titles": _texts(), "options": _no_options(), "task_type": F.lit("free_text"),
        "answer": F.lit(None).cast("string"), "long_answer": F.lit(None).cast("string"), "aliases": _texts(),
    } | columns
    order = ["id", "dataset", "question", "contexts", "context_titles", "options", "task_type", "answer", "long_answer", "aliases"]
    given["dataset"] = F.lit(dataset)
    return raw.select(*[given[name].alias(name) for name in order])


def _stable_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws("||", *parts), 256)


def _options_of(letters: str, *names: str) -> Column:
    return F.create_map(*[item for letter, name in zip(letters, names, strict=True) for item in (F.lit(letter), F.col(name))])


def _is_binary(answer: str) -> Column:
    return F.lower(F.trim(F.col(answer))).isin(BINARY)


def _passages(context: str) -> tuple[Column, Column]:
    """Texts and titles of [title, sentences] pairs; a text is its title, a stop and its sentences."""
    joined = F.transform(F.col(context), lambda p: F.concat(p["title"], F.lit(". "), F.trim(F.array_join(p["sentences"], ""))))
    return joined, F.transform(F.col(context), lambda p: p["title"])


def pubmedqa(raw: DataFrame) -> DataFrame:
    """Raw: id, QUESTION, CONTEXTS, final_decision, LONG_ANSWER."""
    options = F.create_map(*[F.lit(x) for label in ("yes", "no", "maybe") for x in (label, label)])
    return _record(raw, "pubmedqa", id=F.col("id"), question=F.col("QUESTION"), contexts=F.col("CONTEXTS"), options=options, task_type=F.lit("binary"), answer=F.lower(F.trim("final_decision")), long_answer=F.col("LONG_ANSWER"))


def realmedqa(raw: DataFrame) -> DataFrame:
    """Raw: id, Question, Recommendation. The recommendation is gold, so there are no contexts."""
    key = F.coalesce("id", _stable_id("Question", "Recommendation"))
    return _record(raw, "realmedqa", id=key, question=F.col("Question"), answer=F.col("Recommendation"))


def bioasq(raw: DataFrame) -> DataFrame:
    """Raw: id, body, type, exact_answer (array of synonyms), ideal_answer, snippets (array of text). Only yesno and factoid stay."""
    yesno = F.col("type") == "yesno"
    first = F.get("exact_answer", F.lit(0))
    kept = raw.filter(F.col("type").isin("yesno", "factoid"))
    return _record(
        kept, "bioasq", id=F.col("id"), question=F.col("body"), contexts=F.col("snippets"),
        task_type=F.when(yesno, "binary").otherwise("free_text"), answer=F.when(yesno, F.lower(first)).otherwise(first),
        long_answer=F.col("ideal_answer"), aliases=F.when(yesno, _texts()).otherwise(F.slice("exact_answer", F.lit(2), F.greatest(F.lit(0), F.size("exact_answer") - 1))),
    )


def medqa(raw: DataFrame) -> DataFrame:
    """Raw: id, question, options (map), answer, answer_idx. Digits as option keys become letters; the answer's text goes before its index."""
    letters = F.transform_keys("options", lambda k, v: F.when(k.rlike(r"^\d+$"), F.char(k.cast("int") + 65)).otherwise(F.upper(k)))
    index = F.when(F.col("answer_idx").rlike(r"^\d+$"), F.char(F.col("answer_idx").cast("int") + 65)).otherwise(F.upper("answer_idx"))
    answer = F.coalesce(F.when(F.trim("answer") != "", F.col("answer")), F.element_at(letters, index))
    return _record(raw, "medqa", id=F.coalesce("id", _stable_id("question")), question=F.col("question"), options=letters, task_type=F.lit("mcq"), answer=answer)


def medmcqa(raw: DataFrame) -> DataFrame:
    """Raw: id, question, opa to opd, cop (from 1)."""
    options = _options_of("ABCD", "opa", "opb", "opc", "opd")
    return _record(raw, "medmcqa", id=F.col("id"), question=F.col("question"), options=options, task_type=F.lit("mcq"), answer=F.element_at(options, F.char(F.col("cop").cast("int") + 64)))


def mmlu(raw: DataFrame) -> DataFrame:
    """Raw: id, question, A to D, answer (a letter)."""
    options = _options_of("ABCD", "A", "B", "C", "D")
    return _record(raw, "mmlu", id=F.coalesce("id", _stable_id("question")), question=F.col("question"), options=options, task_type=F.lit("mcq"), answer=F.element_at(options, F.upper("answer")))


def hotpotqa(raw: DataFrame, dataset: str = "hotpotqa") -> DataFrame:
    """Raw: _id, question, answer, type, context (array of title and sentences)."""
    texts, titles = _passages("context")
    kind = F.when((F.col("type") == "comparison") & _is_binary("answer"), "binary").otherwise("free_text")
    return _record(raw, dataset, id=F.col("_id"), question=F.col("question"), contexts=texts, context_titles=titles, task_type=kind, answer=F.col("answer"))


def two_wiki(raw: DataFrame) -> DataFrame:
    """Raw: like hotpotqa, and answer_aliases."""
    texts, titles = _passages("context")
    kind = F.when(F.col("type").isin("comparison", "bridge_comparison") & _is_binary("answer"), "binary").otherwise("free_text")
    aliases = F.filter(F.coalesce("answer_aliases", _texts()), lambda alias: alias != F.col("answer"))
    return _record(raw, "2wikimultihopqa", id=F.col("_id"), question=F.col("question"), contexts=texts, context_titles=titles, task_type=kind, answer=F.col("answer"), aliases=aliases)


def musique(raw: DataFrame) -> DataFrame:
    """Raw: id, question, answer, answer_aliases, paragraphs (array of title and paragraph_text). A title goes before a text that doesn't begin with it."""
    text = lambda p: F.when(F.startswith(p["paragraph_text"], p["title"]), p["paragraph_text"]).otherwise(F.concat(p["title"], F.lit(". "), p["paragraph_text"]))
    return _record(
        raw, "musique", id=F.col("id"), question=F.col("question"), contexts=F.transform("paragraphs", text),
        context_titles=F.transform("paragraphs", lambda p: p["title"]), answer=F.col("answer"), aliases=F.coalesce("answer_aliases", _texts()),
    )


def medhop(raw: DataFrame) -> DataFrame:
    """Raw: id, query, supports, candidates, answer. Candidates are options A, B, C, ..."""
    letters = F.transform(F.sequence(F.lit(0), F.size("candidates") - 1), lambda i: F.char(i + 65))
    return _record(raw, "medhop", id=F.col("id"), question=F.col("query"), contexts=F.col("supports"), options=F.map_from_arrays(letters, "candidates"), task_type=F.lit("mcq"), answer=F.col("answer"))


def multihoprag(raw: DataFrame) -> DataFrame:
    """Raw: query, answer, evidence_list (array of title, source, fact)."""
    parts = F.transform("evidence_list", lambda e: F.array_join(F.filter(F.array(e["title"], e["source"], e["fact"]), lambda x: F.length(x) > 0), ". "))
    kind = F.when(_is_binary("answer"), "binary").otherwise("free_text")
    return _record(raw, "multihoprag", id=_stable_id("query"), question=F.col("query"), contexts=parts, context_titles=F.transform("evidence_list", lambda e: e["title"]), task_type=kind, answer=F.col("answer"))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pubmedqa": pubmedqa, "realmedqa": realmedqa, "bioasq": bioasq, "medqa": medqa, "medmcqa": medmcqa, "mmlu": mmlu,
    "hotpotqa": hotpotqa, "hotpotqa_fullwiki": lambda raw: hotpotqa(raw, "hotpotqa_fullwiki"), "2wikimultihopqa": two_wiki,
    "musique": musique, "medhop": medhop, "multihoprag": multihoprag,
}


def inference(records: DataFrame) -> DataFrame:
    """What a system may see of a question."""
    return records.select("id", "dataset", "question", "contexts", "context_titles", "options", "task_type")


def gold(records: DataFrame) -> DataFrame:
    return records.select("id", "dataset", F.col("answer").alias("short_answer"), "long_answer", "aliases")


def eval_records(asked: DataFrame, known: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Questions as a system sees them joined with their gold answers, by dataset and id; only the chosen ones (dataset, id), if told. Questions without a gold answer aren't evaluated."""
    joined = asked.join(known, ["dataset", "id"])
    return joined if chosen is None else joined.join(chosen.select("dataset", "id"), ["dataset", "id"], "left_semi")


def passages(records: DataFrame, per_question: bool = True) -> DataFrame:
    """(question_id, passage_index, title, text): contexts as passages; equal texts once a question, or once over all."""
    from loomgraph.operators.chunking import first_passages

    spread = records.select(F.col("id").alias("question_id"), "dataset", "context_titles", F.posexplode("contexts").alias("passage_index", "text"))
    titled = spread.withColumn("title", F.get("context_titles", F.col("passage_index"))).drop("context_titles")
    return first_passages(titled, ["question_id"] if per_question else ["dataset"], ["question_id", "passage_index"])


def hop_count(decomposition: Column, evidences: Column, facts: Column, key: Column) -> Column:
    """Steps of a decomposition, else evidences, else distinct supporting titles, else what the id begins with (``3hop``)."""
    some = lambda array: F.when(F.size(array) > 0, F.size(array))
    return F.coalesce(some(decomposition), some(evidences), some(F.array_distinct(facts)), F.regexp_extract(key, r"^(\d+)hop", 1).try_cast("int"))
