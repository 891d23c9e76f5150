"""Column functions on names and ids: keys of entities, identities of edges, paths, chunks and subsets, safe tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import entity_key, name_variants, structural_text

# Last words of a name that may be left out.
REMOVABLE_SUFFIXES = [
    "protein", "proteins", "gene", "genes", "kinase", "kinases", "receptor", "receptors", "complex", "complexes", "subunit",
    "subunits", "pathway", "pathways", "signaling", "signalling", "isoform", "isoforms",
]
#: Suffixes that are left out one after the other, at most; names don't have more of them.
MOST_SUFFIXES = 4

# Labels that stand for the store's own structure.
RESERVED_LABELS = ["Document", "Chunk", "Mention", "Entity", "__Entity__", "__KGDocument__", "Relationship", "Node", "Schema"]

# Confidence from which an edge is drawn in a colour.
EDGE_COLOURS = [(0.8, "#f1c40f"), (0.5, "#e67e22"), (0.3, "#95a5a6")]
PALE_COLOUR = "#555e68"


def ontology_key(name: Column) -> Column:
    """An ontology's id or label: lower case, white space and hyphens as single underscores, none at the ends."""
    joined = F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(name, F.lit("")))), r"[\s\-]+", "_"), "_+", "_")
    return F.regexp_replace(joined, "^_|_$", "")


def candidate_names(entity_id: Column, name: Column, *lists: Column) -> Column:
    """Id, name and the names of the lists in this order, each once, without blanks."""
    given = F.concat(F.array(entity_id, name), *[F.coalesce(names, F.array().cast("array<string>")) for names in lists])
    return F.array_distinct(F.filter(given, lambda n: F.length(F.trim(n)) > 0))


def _key_tokens(name: Column) -> Column:
    return F.filter(F.split(entity_key(name), r"[_\s]+"), lambda token: token != "")


def initialism(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda token: F.left(token, F.lit(1))), "")


def alias_keys(name: Column) -> Column:
    """Keys under which softly equal names meet, sorted: the name's, without what stands in parentheses at its end, without
    general last words, and the initials of each that has two words or more."""
    whole = F.trim(name)
    plain = F.trim(F.regexp_replace(whole, r"\s+\([^)]*\)\s*$", ""))
    suffixes = F.array(*map(F.lit, REMOVABLE_SUFFIXES))
    tokens = _key_tokens(whole)
    lengths = F.sequence(F.lit(1), F.lit(MOST_SUFFIXES))
    general = lambda t: F.array_contains(suffixes, t)
    cuts = F.transform(lengths, lambda k: F.when((F.size(tokens) > k) & F.forall(F.slice(tokens, F.greatest(F.lit(1), F.size(tokens) - k + 1), k), general), F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - k))))
    forms = F.concat(F.array(tokens), F.filter(cuts, lambda cut: cut.isNotNull()))
    initials = F.transform(F.filter(forms, lambda form: F.size(form) >= 2), initialism)
    shorter = F.transform(F.slice(forms, F.lit(2), F.lit(MOST_SUFFIXES)), lambda form: F.array_join(form, "_"))
    keys = F.concat(F.array(entity_key(whole), entity_key(plain)), initials, shorter)
    return F.when(whole != "", F.array_sort(F.array_distinct(F.filter(keys, lambda key: key != "")))).otherwise(F.array().cast("array<string>"))


def names_agree(left: Column, right: Column) -> Column:
    """Whether two names may be one entity's by their letters: equal or holding one another (four letters), sharing enough
    words or one with a digit, or one being the other's initials. Likeness of spelling is left to :func:`loomgraph.functions.fuzzy.match_ratio`."""
    x, y = entity_key(left), entity_key(right)
    a, b = _key_tokens(left), _key_tokens(right)
    shared = F.array_intersect(a, b)
    union = F.array_union(a, b)
    longest = F.coalesce(F.array_max(F.transform(shared, lambda t: F.length(t))), F.lit(0))
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    words = (longest >= 4) & (inside | (2 * F.size(shared) >= F.size(union)))
    digit = F.exists(shared, lambda t: t.rlike("[0-9]"))
    initials = ((F.size(a) == 1) & (x == initialism(b))) | ((F.size(b) == 1) & (y == initialism(a)))
    holds = ((F.length(x) >= 4) & F.contains(y, x)) | ((F.length(y) >= 4) & F.contains(x, y))
    return F.coalesce((x != "") & (y != "") & ((x == y) | holds | words | digit | initials), F.lit(False))


def appears_in(text: Column, names: Column) -> Column:
    """Whether any variant of three characters or more of the names stands in the text between word borders."""
    low = F.lower(text)
    variants = F.filter(F.transform(F.flatten(F.transform(names, name_variants)), lambda v: F.trim(F.lower(v))), lambda v: F.length(v) >= 3)
    pattern = lambda v: F.concat(F.lit(r"(?<![\w])\Q"), v, F.lit(r"\E(?![\w])"))
    return F.coalesce(F.exists(F.array_distinct(variants), lambda v: F.contains(low, v) & F.regexp_like(low, pattern(v))), F.lit(False))


def surface_forms(least: int, *names: Column) -> Column:
    """Structural forms of names (arrays) of ``least`` characters or more: most words first, then longest, then by letters."""
    forms = F.array_distinct(F.filter(F.transform(F.concat(*names), structural_text), lambda f: F.length(f) >= least))
    ranked = F.array_sort(F.transform(forms, lambda f: F.struct((-F.size(F.split(f, " "))).alias("w"), (-F.length(f)).alias("n"), f.alias("f"))))
    return F.transform(ranked, lambda r: r["f"])


def text_spans(text: Column, least: int, most_tokens: int = 8, most: int = 128) -> Column:
    """The whole structural text and its runs of up to eight words, ``least`` characters or more, the first ``most`` of them
    from left to right; most words first, then longest, then by letters."""
    whole = structural_text(text)
    tokens = F.split(whole, " ")
    n = F.size(tokens)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_tokens), n - i + 1)), lambda k: F.array_join(F.slice(tokens, i, k), " "))))
    first = F.slice(F.array_distinct(F.filter(F.concat(F.array(whole), runs), lambda s: F.length(s) >= least)), 1, most)
    ranked = F.array_sort(F.transform(first, lambda s: F.struct((-F.size(F.split(s, " "))).alias("w"), (-F.length(s)).alias("n"), s.alias("s"))))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.transform(ranked, lambda r: r["s"]))


def span_match(text: Column, spans: Column, forms: Column) -> Column:
    """How surely a text names an entity: 5 and more for a form that is a span, 4 and more for one inside the text, else 0.

    Forms come in their order of telling; the first that is a span decides. Likeness of spelling is scored apart.
    """
    weight = lambda f: F.least(F.size(F.split(f, " ")), F.lit(8)) * 0.2 + F.least(F.length(f), F.lit(64)) / 64.0
    exact = F.get(F.filter(forms, lambda f: F.array_contains(spans, f)), F.lit(0))
    inside = F.array_max(F.transform(F.filter(forms, lambda f: F.contains(structural_text(text), f)), lambda f: 4.0 + weight(f)))
    return F.coalesce(F.when(exact.isNotNull(), 5.0 + weight(exact)), inside, F.lit(0.0))


def chunk_identity(chunk_id: Column, element_id: Column, text: Column) -> Column:
    """The first that is given: id, element id, the text's first 80 characters."""
    given = lambda c: F.when(c != "", c)
    return F.coalesce(given(chunk_id), given(element_id), F.left(F.coalesce(text, F.lit("")), F.lit(80)))


def relation_identity(key: Column, source: Column, kind: Column, target: Column, negated: Column, condition: Column, quantity: Column) -> Column:
    """The edge's key, else its ends, type, polarity, condition and quantity in one string."""
    told = lambda c: F.trim(F.coalesce(c, F.lit("")))
    sign = F.when(F.coalesce(negated, F.lit(False)), "True").otherwise("False")
    parts = F.concat(source, F.lit("-"), kind, F.lit("-"), target, F.lit("-negated="), sign, F.lit("-condition="), told(condition), F.lit("-quantitative="), told(quantity))
    return F.coalesce(F.when(key != "", key), parts)


def state_relation_id(key: Column, source: Column, kind: Column, target: Column, negated: Column) -> Column:
    """The edge's key, else what is given of its ends, type and polarity, joined by ``::``."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(given(key), F.concat_ws("::", given(source), given(kind), given(target), F.concat(F.lit("neg="), F.when(F.coalesce(negated, F.lit(False)), "True").otherwise("False"))))


def state_path_id(nodes: Column, path: Column) -> Column:
    """The path's nodes joined by ``->``, else its text."""
    own = F.filter(nodes, lambda n: F.trim(n) != "")
    return F.when(F.size(own) > 0, F.array_join(own, "->")).otherwise(F.trim(F.coalesce(path, F.lit(""))))


def safe_label(kind: Column) -> Column:
    """A type as a label of the store: letters, digits and underscores; Concept where that fails or is a reserved word."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(kind, F.lit("")), "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.when(cut.rlike("^[A-Za-z][A-Za-z0-9_]{0,63}$") & ~cut.isin(RESERVED_LABELS), cut).otherwise("Concept")


def safe_token(value: Column) -> Column:
    """A token for file names; ``default`` for nothing."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[^a-zA-Z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(cut == "", "default").otherwise(cut)


def subset_id(dataset: Column, ids: Column, size: Column, seed: Column) -> Column:
    """``dataset__n<size>_seed<seed>_h<hash>``: the hash is of the ids in their order, the size ``all`` where null."""
    key = F.concat(F.lit("n"), F.coalesce(size.cast("string"), F.lit("all")), F.lit("_seed"), seed.cast("string"))
    return F.concat(safe_token(dataset), F.lit("__"), key, F.lit("_h"), F.left(F.sha1(F.array_join(ids, "\n")), F.lit(12)))


def edge_colour(confidence: Column) -> Column:
    """The colour of the bucket that an edge's confidence falls in; null without one."""
    bucket = reduce(lambda case, step: case.when(confidence >= step[0], step[1]), EDGE_COLOURS[1:], F.when(confidence >= EDGE_COLOURS[0][0], EDGE_COLOURS[0][1]))
    return F.coalesce(bucket, F.when(confidence.isNotNull(), PALE_COLOUR))


def node_width(value: Column, greatest: Column, base: float = 24.0) -> Column:
    """A node's width, growing with the root of its share of the greatest value; the base for nothing."""
    share = F.least(F.lit(1.0), value / greatest)
    return F.when((greatest > 0) & (value > 0), F.floor(base * (1 + 2.6 * F.sqrt(share)) + 0.5).cast("double")).otherwise(F.lit(base))


def view_name(name: Column) -> Column:
    """A name as a view looks it up: lower case, white space and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[_\s]+", " "))


def plain_properties(properties: Column) -> Column:
    """A map of properties without those that are null or not a number."""
    return F.map_filter(properties, lambda _, v: v.isNotNull() & ~F.lower(v).isin("nan", "inf", "-inf", "infinity", "-infinity"))
