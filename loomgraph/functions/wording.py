"""Column functions that bring an answer to the form that a dataset's contract asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.answers import leading_label, strip_wrapper
from loomgraph.functions.text import let

# How a question that wants yes or no begins.
BINARY_OPENINGS = ["is ", "are ", "does ", "do ", "can ", "should ", "was ", "were ", "has ", "have ", "did "]

# What dates and counts look like, the most telling pattern first.
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_PATTERNS = [
    rf"\b{MONTH}\s+\d{{1,2}}(?:\s*(?:and|-)\s*\d{{1,2}})?(?:,)?\s+\d{{4}}\b",
    rf"\b\d{{1,2}}(?:\s*(?:and|-)\s*\d{{1,2}})?\s+{MONTH}\s+\d{{4}}\b",
    rf"\b{MONTH}\s+\d{{4}}\b",
    r"\b\d{4}\b",
]
NUMBER_PATTERN = r"(\b\d+(?:\.\d+)?(?:\s*%|\s*(?:mg|g|kg|ml|l|cm|mm|m|km|years?|months?|days?))?)(?:\W|$)"
NUMBER_WORD_PATTERN = r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten)\b"
CLUB_PATTERNS = [r"\s+football club\.?$", r"\s+f\.c\.?$", r"\s+fc\.?$"]
COPULA_PATTERN = r"^\s*(.+?)\s+(?:is|was|are|were|refers to|stands for)\b"

# Labels that a short answer may lead with, and datasets of short answers.
SHORT_LABELS = ["yes", "no", "maybe", "insufficient information"]
SHORT_ANSWER_DATASETS = ["hotpotqa", "2wikimultihopqa", "musique", "multihoprag"]


def _clean(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def _bare(text: Column) -> Column:
    """Without blanks and stops at the ends."""
    return F.regexp_replace(F.trim(text), r"^[ .]+|[ .]+$", "")


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda word: word != ""))


def first_line(text: Column) -> Column:
    """The first line that isn't blank; the text if none is."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda line: F.trim(line)), lambda line: line != "")
    return F.coalesce(F.get(lines, F.lit(0)), text)


def first_sentence(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, r"(?<=[.!?])\s+", 2), 1))


def asks_yes_or_no(question: Column) -> Column:
    low = F.lower(_clean(question))
    return F.exists(F.array(*map(F.lit, BINARY_OPENINGS)), lambda opening: F.startswith(low, opening))


def date_span(text: Column, question: Column) -> Column:
    """The longest (of equal ones the last) date of the most telling kind, if the question asks for one; else empty."""
    low = F.lower(_clean(question))
    asked = low.rlike(r"^when ") | low.rlike(r"(^what| what) (month|year|date)")

    def found(pattern: str) -> Column:
        dates = F.regexp_extract_all(_clean(text), F.lit(f"(?i){pattern}"), F.lit(0))
        return F.array_max(F.transform(dates, lambda d, i: F.struct(F.length(d).alias("n"), i.alias("i"), d.alias("d"))))["d"]

    return F.when(asked, F.coalesce(*[_bare(found(pattern)) for pattern in DATE_PATTERNS], F.lit(""))).otherwise(F.lit(""))


def number_span(text: Column, question: Column) -> Column:
    """The first count or measure, if the question asks how many or how much; else empty."""
    low = F.lower(_clean(question))
    asked = low.rlike("^how (many|much)") | low.rlike(" how (many|much) ")
    number = F.regexp_extract(_clean(text), f"(?i){NUMBER_PATTERN}", 1)
    word = F.regexp_extract(_clean(text), f"(?i){NUMBER_WORD_PATTERN}", 0)
    return F.when(asked, _bare(F.when(number != "", number).otherwise(word))).otherwise(F.lit(""))


def without_club(text: Column, question: Column) -> Column:
    """A club's name without FC and the like, if the question is about a club and the answer is short."""
    asked = F.contains(F.lower(_clean(question)), F.lit("club"))

    def cut(whole: Column) -> Column:
        bare = whole
        for pattern in CLUB_PATTERNS:
            bare = F.regexp_replace(bare, f"(?i){pattern}", "")
        short = F.when(asked & (_word_count(whole) <= 6), let(_bare(bare), lambda found: F.when(found != "", found)))
        return F.coalesce(short, whole)

    return let(_clean(text), cut)


def subject_before_copula(text: Column) -> Column:
    """What stands before is, was and the like, if it has at most eight words; else empty."""
    found = F.regexp_replace(F.trim(F.regexp_extract(_clean(text), f"(?i){COPULA_PATTERN}", 1)), r"^[ ,.;:]+|[ ,.;:]+$", "")
    return let(found, lambda subject: F.when(_word_count(subject).between(1, 8), subject).otherwise(F.lit("")))


def _first_given(*choices: Column) -> Column:
    """The first choice that isn't empty; each is worked out once."""
    return F.coalesce(F.get(F.filter(F.array(*choices), lambda choice: choice != ""), F.lit(0)), F.lit(""))


def _short_form(text: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """What ``body`` makes of an answer without its wrapper, its first line and that line's first sentence, each worked out once; a blank answer stays."""
    lined = lambda whole: let(first_line(whole), lambda line: let(first_sentence(line), lambda sentence: body(whole, line, sentence)))
    return let(strip_wrapper(text), lambda whole: F.when(whole == "", whole).otherwise(lined(whole)))


def multihop_answer(text: Column, question: Column, task: Column) -> Column:
    """A short answer to a question over several passages: a label, a date, a short first sentence, else the first line."""

    def short_form(whole: Column, line: Column, sentence: Column) -> Column:
        short = let(F.when(_word_count(sentence).between(1, 6), _bare(sentence)).otherwise(line), lambda found: without_club(found, question))
        label = F.when((task == "binary") | asks_yes_or_no(question), leading_label(whole, SHORT_LABELS)).otherwise(F.lit(""))
        return _first_given(label, date_span(whole, question), short)

    return _short_form(text, short_form)


def factoid_answer(text: Column, question: Column, task: Column) -> Column:
    """A fact: a label, a date, a count, the subject of its first sentence, its first clause or the first line."""

    def short_form(whole: Column, line: Column, sentence: Column) -> Column:
        label = F.when(task == "binary", leading_label(whole, SHORT_LABELS)).otherwise(F.lit(""))
        told = lambda clause: F.when(_word_count(clause).between(1, 8), _bare(clause)).when(_word_count(sentence).between(1, 8), _bare(sentence)).otherwise(line)
        short = let(F.trim(F.element_at(F.split(sentence, r"\s*[,:;]\s*", 2), 1)), told)
        return _first_given(label, date_span(whole, question), number_span(whole, question), subject_before_copula(sentence), short)

    return _short_form(text, short_form)


def recommendation_answer(text: Column) -> Column:
    """The first three sentences, or the refusal."""
    whole = strip_wrapper(text)
    sentences = F.filter(F.transform(F.split(whole, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.startswith(F.lower(whole), F.lit("insufficient information")), "Insufficient Information.").otherwise(F.array_join(F.slice(sentences, 1, 3), " "))


def contracted_answer(dataset: Column, task: Column, text: Column, question: Column) -> Column:
    """The answer as its dataset's contract has it; a label only where one is stated, free text as it is but for its wrapper."""
    given = F.struct(F.lower(_clean(dataset)).alias("name"), F.lower(_clean(task)).alias("kind"), _clean(text).alias("whole"), question.alias("question"))
    return let(given, _contracted)


def _contracted(given: Column) -> Column:
    name, kind, whole, question = (given[key] for key in ("name", "kind", "whole", "question"))
    labelled = lambda labels: _first_given(leading_label(whole, labels), whole)
    return (
        F.when(whole == "", whole)
        .when(name == "pubmedqa", labelled(["yes", "no", "maybe"]))
        .when((name == "bioasq") & (kind == "binary"), labelled(["yes", "no"]))
        .when(kind == "binary", labelled(SHORT_LABELS))
        .when(name.isin(SHORT_ANSWER_DATASETS), multihop_answer(whole, question, kind))
        .when(name == "bioasq", factoid_answer(whole, question, kind))
        .when(name == "realmedqa", recommendation_answer(whole))
        .otherwise(strip_wrapper(whole))
    )
