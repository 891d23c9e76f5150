"""Exact spans of names in texts, by an automaton over tokens, and what they ground.

A name stands in a text where it is found whatever its case and no word
character touches it. So names and texts are cut in the same way, into runs of
word characters and single other characters, and a name is a sequence of whole
tokens. All names of a text, or of a whole table, are found in one pass over its
tokens by an automaton (a trie whose nodes know the longest name's beginning
that ends where they do).
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.blocks import bound_batches
from loomgraph.operators.inventory import merged_spans, restoration_status

#: Spans of one candidate, at most.
MOST_SPANS = 12
#: Bytes of names up to which one automaton of all of them goes to every worker; it takes some 50 times as much.
BROADCAST_BYTES = 2 << 20
#: Characters of a quote, and of a text's beginning where no sentence holds the name.
QUOTE, HEAD = 500, 200
#: Characters of quotes that a worker holds before it hands them on.
QUOTES_HELD = 1 << 20

SPAN = "struct<text:string,start:bigint,end:bigint,chunk_position:int,local_start:int,local_end:int>"

_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")


class Tokens:
    """Cuts texts into runs of word characters and single other characters, in lower case."""

    def __init__(self, word: str = r"\w"):
        self.cut = re.compile(f"{word}+|(?s:.)")
        self.word = re.compile(word)

    def of(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def is_word(self, token: str) -> bool:
        return self.word.match(token) is not None


class Automaton:
    """All names in one pass: ``find`` gives (name's number, first token, end token) of each place, overlapping ones as well."""

    def __init__(self, names: Iterable[str], tokens: Tokens):
        self.tokens = tokens
        self.steps: list[dict[str, int]] = [{}]
        own: list[list[int]] = [[]]
        self.size: list[int] = []
        for number, name in enumerate(names):
            node, parts = 0, tokens.of(name.lower())
            self.size.append(len(parts))
            for part in parts:
                step = self.steps[node].get(part)
                if step is None:
                    step = self.steps[node][part] = len(self.steps)
                    self.steps.append({})
                    own.append([])
                node = step
            if parts:
                own[node].append(number)
        self.back = [0] * len(self.steps)
        self.ends: list[tuple[int, ...]] = [tuple(numbers) for numbers in own]
        queue = deque(self.steps[0].values())
        while queue:
            node = queue.popleft()
            for part, step in self.steps[node].items():
                queue.append(step)
                at = self.back[node]
                while at and part not in self.steps[at]:
                    at = self.back[at]
                self.back[step] = self.steps[at].get(part, 0)
                self.ends[step] += self.ends[self.back[step]]

    def find(self, parts: list[str]) -> Iterator[tuple[int, int, int]]:
        steps, back, ends, size, is_word = self.steps, self.back, self.ends, self.size, self.tokens.is_word
        node = 0
        for at, part in enumerate(parts):
            while node and part not in steps[node]:
                node = back[node]
            node = steps[node].get(part, 0)
            for number in ends[node]:
                first = at + 1 - size[number]
                if not is_word(parts[first]) and first and is_word(parts[first - 1]):
                    continue
                if not is_word(part) and at + 1 < len(parts) and is_word(parts[at + 1]):
                    continue
                yield number, first, at + 1


def forms_of(name: str) -> list[str]:
    """A name as given, with spaces for underscores and with underscores for spaces, each once; none for a blank one."""
    return list(dict.fromkeys(form for form in (name, name.replace("_", " "), name.replace(" ", "_")) if form.strip()))


def candidate_spans(text: str, keyed: list[tuple[str, list[str]]], most: int = MOST_SPANS) -> dict[str, list[tuple[int, int]]]:
    """The (start, end) of the candidates of each key in a text; each candidate, with all its forms, has ``most`` of them.

    Candidates that differ in case alone count once. Of one form no two spans
    overlap; different ones may.
    """
    names: dict[str, None] = {}
    for _, given in keyed:
        for name in given:
            for form in forms_of(name.strip()):
                names.setdefault(form.lower())
    tokens = Tokens()
    machine = Automaton(names, tokens)
    parts = tokens.of(text)
    starts = [0]
    for part in parts:
        starts.append(starts[-1] + len(part))
    places: dict[str, list[tuple[int, int]]] = {name: [] for name in names}
    listed = list(names)
    for number, first, end in machine.find([part.lower() for part in parts]):
        own = places[listed[number]]
        if not own or starts[first] >= own[-1][1]:
            own.append((starts[first], starts[end]))
    found: dict[str, list[tuple[int, int]]] = {}
    for key, given in keyed:
        spans: set[tuple[int, int]] = set()
        for name in dict.fromkeys(candidate.strip().lower() for candidate in given):
            own = [span for form in forms_of(name) for span in places[form.lower()]]
            spans.update(own[:most])
        found[key] = sorted(spans)
    return found


def anchor_spans(chunks: DataFrame, candidates: DataFrame, most: int = MOST_SPANS) -> DataFrame:
    """(chunk_id, key, spans): where the candidates (chunk_id, key, names) of a chunk's extraction stand in its text.

    Chunks are (chunk_id, text) and may have start_pos, the text's place in its
    document, and position. Spans are (text, start, end, chunk_position,
    local_start, local_end) by start and end. Keys without a span, blank texts and
    names that are null or blank give no row. A chunk's candidates meet its text
    as one row.
    """
    wanted = candidates.select("chunk_id", F.struct(F.col("key").cast("string").alias("key"), F.filter("names", lambda n: n.isNotNull() & (F.trim(n) != "")).alias("names")).alias("c")).filter(F.size("c.names") > 0)
    listed = wanted.groupBy("chunk_id").agg(F.collect_set("c").alias("wanted"))
    place = [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) if name in chunks.columns else F.lit(0).cast("long").alias(name) for name in ("start_pos", "position")]
    joined = chunks.filter(F.trim("text") != "").select("chunk_id", "text", *place).join(listed, "chunk_id").select("chunk_id", "text", "start_pos", "position", "wanted")
    kind = joined.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chunk_position", pa.int32()), ("local_start", pa.int32()), ("local_end", pa.int32())])
        for batch in batches:
            rows, keys, spans = [], [], []
            for at, (text, start, position, wanted) in enumerate(zip(*(column.to_pylist() for column in batch.columns[1:]), strict=True)):
                together: dict[str, list[str]] = {}
                for row in wanted:
                    together.setdefault(row["key"], []).extend(sorted(row["names"]))
                for key, own in candidate_spans(text, list(together.items()), most).items():
                    if own:
                        rows.append(at)
                        keys.append(key)
                        spans.append([{"text": text[a:b].strip(), "start": start + a, "end": start + b, "chunk_position": position, "local_start": a, "local_end": b} for a, b in own])
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(spans, pa.list_(span))], names=["chunk_id", "key", "spans"])

    return joined.mapInArrow(run, f"chunk_id {kind}, key string, spans array<{SPAN}>")


def merged_groundings(left: Column, right: Column) -> Column:
    """Two maps of component to spans as one: the spans of a component that both have are merged, each once, by place."""
    none = F.create_map().cast(f"map<string,array<{SPAN}>>")
    return F.map_zip_with(F.coalesce(left, none), F.coalesce(right, none), lambda _, a, b: merged_spans(a, b))


def grounded_components(grounding: Column) -> Column:
    """Those of source, relation and target that have spans, in this order."""
    parts = F.array(*map(F.lit, ("source", "relation", "target")))
    return F.filter(parts, lambda part: F.size(F.coalesce(grounding[part], F.array().cast(f"array<{SPAN}>"))) > 0)


def grounded_extraction(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chunk's extracted entities and relations with the spans that bear them out.

    ``entities`` is (chunk_id, entity_id, names), ``relations`` is (chunk_id,
    relation_id, source, target, rel_type) and may have anchor_text,
    description, condition, quantitative and an earlier ``grounding``, a map of
    component to spans. Gives the entities with anchor_spans and
    anchor_mention_count, and the relations with the merged grounding,
    grounded_components, restoration_status and restoration_verified. An end is
    borne out by the spans of the chunk's entity of that id and by its own name.
    """
    told = lambda name: F.col(name).cast("string") if name in relations.columns else F.lit(None).cast("string")
    spaced = F.translate(F.col("rel_type"), "_-", "  ")
    parts = {
        "source": F.array(F.col("source")),
        "target": F.array(F.col("target")),
        "relation": F.array(told("anchor_text"), told("description"), spaced, F.col("rel_type")),
        "condition": F.array(told("condition")),
        "quantitative": F.array(told("quantitative")),
    }
    key = lambda kind, value: F.concat(F.lit(f"{kind}:"), value.cast("string"))
    own = entities.select("chunk_id", key("entity", F.col("entity_id")).alias("key"), "names")
    listed = relations.select("chunk_id", F.explode(F.array(*(F.struct(key(part, F.col("relation_id")).alias("key"), names.alias("names")) for part, names in parts.items()))).alias("c")).select("chunk_id", "c.key", "c.names")
    found = anchor_spans(chunks, own.unionByName(listed))

    of_entities = found.filter(F.startswith("key", F.lit("entity:"))).select("chunk_id", F.substring("key", 8, 1 << 30).alias("entity_key"), F.col("spans").alias("anchor_spans"))
    named = entities.withColumn("entity_key", F.col("entity_id").cast("string")).join(of_entities, ["chunk_id", "entity_key"], "left").drop("entity_key")
    named = named.withColumn("anchor_mention_count", F.greatest(F.lit(0), F.size("anchor_spans")))

    ends = relations.select("chunk_id", F.col("relation_id").cast("string").alias("relation_key"), F.explode(F.array(*(F.struct(F.lit(end).alias("part"), F.col(end).cast("string").alias("entity_key")) for end in ("source", "target")))).alias("e"))
    by_entity = ends.select("chunk_id", "relation_key", "e.part", "e.entity_key").join(of_entities, ["chunk_id", "entity_key"]).select("chunk_id", "relation_key", "part", F.col("anchor_spans").alias("spans"))
    by_name = found.filter(~F.startswith("key", F.lit("entity:"))).select("chunk_id", F.regexp_extract("key", "(?s)^[a-z]+:(.*)$", 1).alias("relation_key"), F.substring_index("key", ":", 1).alias("part"), "spans")
    spans = by_entity.unionByName(by_name).groupBy("chunk_id", "relation_key", "part").agg(merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"))
    grounding = spans.groupBy("chunk_id", "relation_key").agg(F.map_from_entries(F.collect_list(F.struct("part", "spans"))).alias("found_grounding"))

    out = relations.withColumn("relation_key", F.col("relation_id").cast("string")).join(grounding, ["chunk_id", "relation_key"], "left").drop("relation_key")
    before = F.col("grounding") if "grounding" in relations.columns else F.lit(None).cast(f"map<string,array<{SPAN}>>")
    out = out.withColumn("grounding", merged_groundings(before, F.col("found_grounding"))).drop("found_grounding")
    out = out.withColumn("grounded_components", grounded_components(F.col("grounding")))
    status = restoration_status(*(F.array_contains("grounded_components", part) for part in ("source", "relation", "target")))
    return named, out.withColumn("restoration_status", status).withColumn("restoration_verified", F.col("restoration_status") == "full")


def quoted(text: str, sentences: list[tuple[str, str]], name: str) -> str:
    """The first sentence (as given, in lower case) that holds the name, else the text's beginning."""
    return next((own for own, low in sentences if name in low), text[:HEAD])[:QUOTE]


def _linked(text: str, machine: Automaton, names: list[str]) -> list[tuple[int, str]]:
    """(name's number, quote) of each name that stands in a text, in order of first place."""
    met = dict.fromkeys(number for number, _, _ in machine.find(machine.tokens.of(text.lower())))
    if not met:
        return []
    sentences = [(own, own.lower()) for own in _SENTENCE.split(text)]
    return [(number, quoted(text, sentences, names[number])) for number in met]


#: Letters and digits alone make a word where mentions are linked.
_PLAIN = r"[a-z0-9]"
_machines: dict[str, Automaton] = {}


def quote_batches(ids: pa.Array, found: Iterable[list[tuple[str, str]]], held: int = QUOTES_HELD) -> Iterator[pa.RecordBatch]:
    """(chunk_id, name, quote) of the names and quotes found in each text, handed on whenever ``held`` characters of quotes are there."""
    at: list[int] = []
    names: list[str] = []
    quotes: list[str] = []
    size = 0
    batch = lambda: pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(quotes, pa.string())], names=["chunk_id", "name", "quote"])
    for k, own in enumerate(found):
        for name, quote in own:
            at.append(k)
            names.append(name)
            quotes.append(quote)
            size += len(quote)
            if size >= held:
                yield batch()
                at, names, quotes, size = [], [], [], 0
    if at:
        yield batch()


def named_places(chunks: DataFrame, names: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, quotes: bool = True) -> DataFrame:
    """(chunk_id, name, quote): the names (name, in lower case, each once) that stand in a chunk's text, with the first sentence that holds each.

    A name needs a letter or digit, and no letter or digit may touch it. Names
    of ``broadcast_bytes`` in all go to every worker as one automaton. Of more,
    each chunk gets those whose first and last word it has, by joins on words,
    and an automaton of its own; the result is the same. Without ``quotes``
    names of one word are joined with the words of the chunks, and no worker is
    needed for them.
    """
    names = names.filter(F.col("name").rlike(_PLAIN))
    texts = chunks.filter(F.col("text").isNotNull()).select("chunk_id", "text")
    alone, bytes_of = F.col("name").rlike(rf"\A{_PLAIN}+\z"), F.octet_length("name") + 16
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"{_PLAIN}+"), F.lit(0))
    if not quotes:
        size, rest = names.agg(F.coalesce(F.sum(F.when(alone, bytes_of)), F.lit(0)), F.count_if(~alone)).first()
        single = F.broadcast(names.filter(alone)) if size <= broadcast_bytes else names.filter(alone)
        met = texts.select("chunk_id", F.explode(F.array_distinct(words(F.col("text")))).alias("name")).join(single, "name").select("chunk_id", "name")
        return met.unionByName(named_places(chunks, names.filter(~alone), broadcast_bytes).select("chunk_id", "name")) if rest else met

    bound_batches(chunks.sparkSession)
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    types = f"chunk_id {kind}, name string, quote string"
    size = names.agg(F.sum(bytes_of)).first()[0] or 0
    if size <= broadcast_bytes:
        shared = chunks.sparkSession.sparkContext.broadcast(sorted(row["name"] for row in names.collect()))
        own = uuid.uuid4().hex

        def all_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = shared.value
            if own not in _machines:
                _machines.clear()
                _machines[own] = Automaton(listed, Tokens(_PLAIN))
            machine = _machines[own]
            for batch in batches:
                yield from quote_batches(batch.column(0), ([(listed[number], quote) for number, quote in _linked(text.as_py(), machine, listed)] for text in batch.column(1)))

        return texts.mapInArrow(all_names, types)

    ends = names.select("name", words(F.col("name")).alias("w")).select("name", F.get("w", F.lit(0)).alias("word"), F.element_at("w", -1).alias("last"))
    wanted = ends.select(F.explode(F.array("word", "last")).alias("word")).distinct()
    spread = texts.select("chunk_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(wanted, "word", "left_semi")
    met = spread.join(ends, "word")
    met = met.filter(F.col("word") == F.col("last")).unionByName(met.filter(F.col("word") != F.col("last")).join(spread.withColumnRenamed("word", "last"), ["chunk_id", "last"]))
    listed = met.groupBy("chunk_id").agg(F.collect_set("name").alias("names"))

    def own_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(_PLAIN)
        for batch in batches:
            pairs = ((text.as_py(), names.as_py()) for text, names in zip(batch.column(1), batch.column(2), strict=True))
            yield from quote_batches(batch.column(0), ([(names[number], quote) for number, quote in _linked(text, Automaton(names, tokens), names)] for text, names in pairs))

    return texts.join(listed, "chunk_id").select("chunk_id", "text", "names").mapInArrow(own_names, types)


def mention_links(chunks: DataFrame, entities: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, quotes: bool = True) -> DataFrame:
    """(chunk_id, entity_id and, unless not wanted, quote): the entities (entity_id, name) whose name stands in a chunk, with the first sentence that holds it."""
    named = entities.select("entity_id", F.lower("name").alias("name")).filter(F.col("name").isNotNull()).distinct()
    return named_places(chunks, named.select("name").distinct(), broadcast_bytes, quotes).join(named, "name").select("chunk_id", "entity_id", *(["quote"] if quotes else []))
