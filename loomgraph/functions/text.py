"""Column functions on names, questions and texts. All are native expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too general to be an entity of a graph.
GENERAL_WORDS = [
    "treatment", "treatments", "condition", "conditions", "outcome", "outcomes", "model", "models", "effect", "effects", "result", "results", "factor",
    "factors", "mechanism", "mechanisms", "response", "responses", "function", "functions", "role", "roles", "process", "processes", "level", "levels",
    "system", "systems", "study", "studies", "analysis", "analyses", "approach", "approaches", "method", "methods", "measure", "measures", "group",
    "groups", "sample", "samples", "data", "finding", "findings", "evidence", "activity", "activities", "expression", "expressions", "production",
    "change", "changes", "increase", "increases", "decrease", "decreases", "type", "types", "form", "forms", "stage", "stages", "state", "states", "case",
    "cases", "patient", "patients", "subject", "subjects", "participant", "participants", "control", "controls", "target", "targets", "interaction",
    "interactions", "pathway", "pathways", "network", "networks", "signal", "signals", "marker", "markers", "indicator", "indicators", "test", "tests",
    "assessment", "assessments", "evaluation", "evaluations", "trial", "trials", "experiment", "experiments", "observation", "observations", "report",
    "reports", "review", "reviews", "context", "information", "knowledge", "concept", "concepts", "feature", "features", "aspect", "aspects", "component",
    "components", "element", "elements", "structure", "structures", "property", "properties", "characteristic", "characteristics", "parameter",
    "parameters", "variable", "variables", "value", "values", "score", "scores", "rate", "rates", "ratio", "ratios", "index", "indices", "mean", "median",
    "range", "prevalence", "incidence", "frequency", "proportion", "percentage", "number", "amount", "quantity", "duration", "period", "time", "age",
    "size", "dose", "concentration", "threshold", "limit", "maximum", "minimum", "this", "that", "these", "those", "which", "what", "who", "when",
    "where", "how", "why", "other", "another", "same", "different", "various", "several", "many", "few", "all", "both", "each", "every", "some", "any",
    "no", "not", "yes",
]

# Question words and relations that don't ground a query.
QUERY_STOPWORDS = [
    "what", "which", "where", "when", "who", "whom", "whose", "why", "how", "does", "do", "did", "done", "have", "has", "had", "with", "from", "that",
    "this", "these", "those", "into", "about", "after", "before", "through", "there", "their", "them", "they", "would", "could", "should", "question",
    "answer", "answers", "company", "county", "state", "city", "country", "province", "league", "team", "film", "band", "album", "series", "season",
    "owner", "located", "founded", "born", "spouse", "husband", "wife", "plays", "performed", "performer",
]

# What makes a question statistical or semantic.
STATISTICAL_TERMS = [
    "statistic", "tendencies", "trend", "correlation", "rate", "incidence", "prevalence", "distribution", "frequency",
    "proportion", "percentage", "average", "mean", "median", "variance", "standard deviation", "regression", "p-value",
    "significance", "confidence interval", "sample size", "cohort", "meta-analysis", "epidemiology", "how many", "how much",
    "quantity", "number of", "count", "total", "sum",
]
SEMANTIC_TERMS = [
    "explain", "describe", "what is", "how does", "define", "meaning", "concept", "principle", "theory", "framework",
    "model", "interpretation", "understanding", "overview", "context", "background", "history", "development",
    "evolution", "mechanism", "process", "function",
]
# How a question that compares is worded.
COMPARISON_PATTERN = "|".join(
    [
        r"\b(are|do|did|were|is|have) both\b",
        r"\bboth\b.{1,60}\band\b",
        r"\band\b.{1,60}\bboth\b",
        r"\band\b.{1,80}\bshare\b",
        r"\bsame\b.{1,40}\b(breed|species|profession|nationality|type|genre|band|group)\b",
        r"^(in )?between\b",
    ]
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a column once and use it many times, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def entity_key(name: Column) -> Column:
    """The key under which spellings of one entity meet: lower case, no leading article, no punctuation, underscores."""
    steps = [(r"^(the|an|a|and|or) ", ""), (r"[,()\[\];:.]", ""), (r"[\-/]", "_")]
    text = reduce(lambda column, step: F.regexp_replace(column, *step), steps, squeeze(F.lower(name)))
    text = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "_"), "_+", "_")
    return F.regexp_replace(text, "^_|_$", "")


def is_entity_name(name: Column) -> Column:
    """True for names specific enough to be an entity; null counts as false."""
    text = F.trim(name)
    told = text.rlike("[A-Za-z0-9]") & ~text.rlike(r"^[\d\W_]+$") & ~F.lower(text).isin(GENERAL_WORDS)
    return F.coalesce(told & ((F.length(text) >= 3) | text.rlike(r"[\d\-.]")), F.lit(False))


def name_variants(name: Column) -> Column:
    """The name, its lower case, both with spaces and underscores swapped, and its key."""
    forms = F.array(name, F.lower(name), F.regexp_replace(name, "_", " "), F.regexp_replace(name, " ", "_"), entity_key(name))
    return F.array_distinct(F.filter(forms, lambda form: F.length(form) > 0))


def structural_text(text: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def content_tokens(text: Column) -> Column:
    """Distinct tokens of four letters or more that aren't question words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    return F.array_distinct(F.filter(found, lambda token: (F.length(token) >= 4) & ~F.array_contains(stop, token)))


def overlap_count(tokens: Column, *texts: Column) -> Column:
    """How many tokens occur as substrings of the texts."""
    hay = F.lower(F.concat_ws(" ", *texts))
    return F.size(F.filter(tokens, lambda token: F.contains(hay, token)))


def grounding_quality(tokens: Column, matched: Column) -> Column:
    """Matched tokens over all, at most 1; 0 without tokens."""
    n = F.size(tokens)
    return F.when(n > 0, F.least(F.lit(1.0), matched / n)).otherwise(F.lit(0.0))


def comparison_branches(question: Column) -> Column:
    """The two sides of an "A or B" question, those of four characters or more."""
    text = F.regexp_replace(F.trim(question), r"\?+$", "")
    at = F.regexp_instr(text, F.lit(r"(?i)\bor\b"))
    left = F.trim(F.substring_index(F.trim(text.substr(F.lit(1), at - 1)), ",", -1))
    left = F.trim(F.regexp_replace(left, r"(?i)^(which|what|who|where|when|whose|is|are|was|were|has|have|had|does|do|did)\s+", ""))
    right = F.trim(text.substr(at + 2, F.length(text)))
    sides = F.transform(F.array(left, right), lambda side: F.regexp_replace(side, r"^[ ,.;:]+|[ ,.;:]+$", ""))
    split = F.lower(text).contains(" or ") & (at > 0)
    return F.when(split, F.filter(sides, lambda side: F.length(side) >= 4)).otherwise(F.array().cast("array<string>"))


def question_type(question: Column) -> Column:
    """comparison, bridge, statistical, semantic or generic, by the first rule that holds."""
    low = F.regexp_replace(F.trim(F.lower(question)), r"\?+$", "")
    contains_any = lambda terms: reduce(lambda a, b: a | b, [F.contains(low, F.lit(term)) for term in terms])
    words = F.split(F.trim(F.regexp_replace(question, r"\s+", " ")), " ")
    later = F.slice(words, F.lit(2), F.size(words))
    names = F.size(F.filter(later, lambda word: word.rlike(r"^\p{Lu}\p{L}{2,}$")))
    return (
        F.when(low.rlike(COMPARISON_PATTERN) | (F.size(comparison_branches(question)) == 2), "comparison")
        .when(low.rlike("^(who|what|which|where|when|whose)") & (names >= 2), "bridge")
        .when(contains_any(STATISTICAL_TERMS), "statistical")
        .when(contains_any(SEMANTIC_TERMS), "semantic")
        .otherwise("generic")
    )


def retrieval_threshold(kind: Column) -> Column:
    """The similarity threshold of a question's type without entities in view."""
    return F.when(kind == "semantic", F.lit(0.10)).otherwise(F.lit(0.08))


def retrieval_limit(kind: Column) -> Column:
    """The most chunks asked for by a question of a type."""
    return F.when(kind == "statistical", 200).when(kind == "semantic", 15).otherwise(20)


def relation_label(kind: Column, negated: Column, condition: Column, quantity: Column) -> Column:
    """``NOT TYPE [condition] (quantity)``; a quantity that the condition tells already is left out."""
    given = lambda column: F.trim(F.coalesce(column, F.lit("")))
    name = F.when(given(kind) == "", "RELATED").otherwise(given(kind))
    tells = F.contains(F.lower(given(condition)), F.lower(given(quantity)))
    return F.concat(
        F.when(F.coalesce(negated, F.lit(False)), "NOT ").otherwise(""),
        name,
        F.when(given(condition) != "", F.concat(F.lit(" ["), given(condition), F.lit("]"))).otherwise(""),
        F.when((given(quantity) != "") & ~tells, F.concat(F.lit(" ("), given(quantity), F.lit(")"))).otherwise(""),
    )


def stable_seed(*parts: Column) -> Column:
    """The first eight bytes of the SHA-256 of the parts joined by ``||``, as a decimal."""
    return F.conv(F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


#: The namespace of object identifiers, as bytes.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """The version 5 UUID of a name in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12),
    )


# What words for confidence stand for.
SPOKEN_CONFIDENCE = {
    "demonstrated": 0.95, "supported": 0.85, "high": 0.8, "strong": 0.8, "suggested": 0.6, "moderate": 0.55,
    "hypothesized": 0.35, "hypothesis": 0.35, "speculative": 0.25, "weak": 0.2, "low": 0.2,
}


def confidence(value: Column) -> Column:
    """A number clamped to 0..1, or what a word stands for; else 0."""
    words = F.lower(F.trim(value.cast("string")))
    number = words.try_cast("double")
    spoken = reduce(lambda case, item: case.when(words == item[0], item[1]), list(SPOKEN_CONFIDENCE.items())[1:], F.when(words == "demonstrated", 0.95))
    clamped = F.when(number.isNotNull() & ~F.isnan(number), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(clamped, spoken, F.lit(0.0))


def shortened(text: Column, fewer: Column, most: int) -> Column:
    """The distinct texts that taking ``fewer`` characters (``most`` at most, and fewer than there are) out of a text leaves."""
    drop = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v))))
    out, left = F.when(fewer == 0, F.array(text)), F.array(text)
    for k in range(1, most + 1):
        left = F.array_distinct(F.flatten(F.transform(left, drop)))
        out = out.when(fewer == k, left)
    return out
