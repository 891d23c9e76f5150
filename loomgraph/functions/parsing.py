"""Column functions that read what a model wrote for JSON, as far as it can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import let

#: The type of an entity that has none.
GENERIC_TYPE = "Concept"
EXTRACTION = "struct<entities:array<struct<id:string,type:string,name:string,description:string>>,relationships:array<struct<source:string,target:string,type:string>>>"


def without_fences(text: Column) -> Column:
    """The text without a fence around it, marked as JSON or not, and without white space at its ends."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\s+|\s+$", ""), r"^```(json)?", ""), r"```$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def first_object(text: Column) -> Column:
    """From the first opening brace to the one that closes it, braces in strings not counted; null if none closes it.

    The depth is a running sum over the characters; the state besides it is
    whether a string is open and whether the character before escapes this one.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        open_ = ~s["escaped"] & ~s["quoted"]
        depth = s["depth"] + F.when(open_ & (c == "{"), 1).when(open_ & (c == "}"), -1).otherwise(0)
        closed = open_ & (c == "}") & (depth == 0) & (s["end"] == 0)
        return F.struct(
            depth.alias("depth"), F.when(~s["escaped"] & (c == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (~s["escaped"] & (c == "\\")).alias("escaped"),
            (s["at"] + 1).alias("at"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"),
        )

    def cut(whole: Column) -> Column:
        end = F.aggregate(F.split(whole, ""), start, step, lambda s: s["end"])
        return F.when(end > 0, whole.substr(F.lit(1), end))

    at = F.instr(text, "{")
    return F.when(at > 0, let(text.substr(at, F.length(text)), cut))


def object_text(text: Column) -> Column:
    """What stands for an object in an answer: the first one that closes, else all from the first opening brace to the last closing one; null without both."""
    bare = without_fences(text)

    def widest(t: Column) -> Column:
        at, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((at > 0) & F.contains(t, F.lit("}")) & (last > at), t.substr(at, last - at + 1))

    return let(bare, lambda t: F.coalesce(first_object(t), widest(t)))


def is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",\s*([\]}])", "$1")


def recovered_array(text: Column, key: str) -> Column:
    """The array under a key of a broken object, up to the first closing bracket, as it is or without trailing commas; null if neither is JSON."""
    given = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*(\[.*?\])', 1)
    return F.when(given != "", let(given, lambda g: F.when(is_json(g), g).otherwise(let(without_trailing_commas(g), lambda c: F.when(is_json(c), c)))))


def model_object(text: Column) -> Column:
    """The object in a model's answer as JSON text; null if there is none that can be read."""
    return let(F.coalesce(object_text(text), F.lit("")), lambda found: F.when(is_json(found), found))


def _items(array: Column) -> Column:
    """A JSON array's elements, each as (kind, text): kind is object, string or other."""
    elements = F.coalesce(F.from_json(array, "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.schema_of_variant(v) == "STRING", "string").otherwise("other")
    return F.transform(F.filter(elements, lambda v: v.isNotNull()), lambda v: F.struct(kind(v).alias("kind"), v.alias("v")))


def _text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def extracted(text: Column, generic_type: str = GENERIC_TYPE) -> Column:
    """Entities and relationships of a model's answer (see EXTRACTION), both empty where nothing can be read.

    An answer whose object isn't JSON as a whole gives what its two arrays do by
    themselves. Entities are objects with an id, whatever its type, or names
    alone; a missing type is the generic one, a missing name the id, a missing
    description type and id. Relationships are objects whose ends are strings.
    Everything else is left out.
    """

    def read(both: Column) -> Column:
        entity = lambda id_, kind, name, about: F.struct(id_.alias("id"), kind.alias("type"), F.coalesce(name, id_).alias("name"), F.coalesce(about, F.concat(kind, F.lit(": "), id_)).alias("description"))
        none = F.lit(None).cast("string")
        kind_of = lambda v: F.coalesce(F.when(F.trim(_text_at(v, "$.type")) != "", _text_at(v, "$.type")), F.lit(generic_type))
        entities = F.transform(
            _items(both["entities"]),
            lambda item: F.when(item["kind"] == "string", entity(item["v"].cast("string"), F.lit(generic_type), none, none)).when(
                (item["kind"] == "object") & _text_at(item["v"], "$.id").isNotNull(), entity(_text_at(item["v"], "$.id"), kind_of(item["v"]), _text_at(item["v"], "$.properties.name"), _text_at(item["v"], "$.properties.description"))
            ),
        )
        is_text = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
        relations = F.transform(
            _items(both["relationships"]),
            lambda item: F.when(
                (item["kind"] == "object") & F.coalesce(is_text(item["v"], "$.source") & is_text(item["v"], "$.target"), F.lit(False)),
                F.struct(_text_at(item["v"], "$.source").alias("source"), _text_at(item["v"], "$.target").alias("target"), _text_at(item["v"], "$.type").alias("type")),
            ),
        )
        return F.struct(F.filter(entities, lambda e: e.isNotNull()).alias("entities"), F.filter(relations, lambda r: r.isNotNull()).alias("relationships"))

    def members(found: Column) -> Column:
        member = lambda key: F.when(is_json(found), F.get_json_object(found, f"$.{key}")).otherwise(recovered_array(found, key)).alias(key)
        return F.struct(member("entities"), member("relationships"))

    return let(let(F.coalesce(object_text(text), F.lit("")), members), read).cast(EXTRACTION)
