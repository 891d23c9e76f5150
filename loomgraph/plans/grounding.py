"""Queries on exact spans and what they ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import spans
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table

#: Every document is given the words of one item, dealt out by its id, and where these stand in it.
PLACED = r"""n AS (SELECT count(*) AS n FROM benchmark),
ws AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, [x FOR x IN string_split(lower(text), ' ') IF regexp_matches(x, '^[a-z0-9]{4,}$')] AS w FROM benchmark),
g AS (SELECT doc_id, text, w FROM documents, n JOIN ws ON k = doc_id % n),
tok AS (
  SELECT doc_id, i, lower(t) AS t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS a, length(t) AS len
  FROM (SELECT doc_id, unnest(range(len(ts))) AS i, unnest(ts) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]') AS ts FROM documents WHERE trim(text) <> '')))"""


def placed(spark, sf_dir):
    """(doc_id, text, start_pos, position, w): documents with the words of their item."""
    items = read_table(spark, sf_dir, "benchmark")
    n = items.count()
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w.rlike("^[a-z0-9]{4,}$"))
    listed = items.select((F.row_number().over(spans.W.orderBy("item_id")) - 1).alias("k"), words.alias("w"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", (10 * F.col("doc_id")).alias("start_pos"), (F.col("doc_id") % 7).cast("int").alias("position"), (F.col("doc_id") % n).alias("k"))
    return docs.join(listed, "k")


def told(column: str):
    return F.md5(F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["local_start"].cast("string"), F.lower(s["text"]))), ","))


@query("exact_spans", f"""WITH {PLACED},
c AS (SELECT doc_id, unnest(w) AS name FROM g UNION SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w)) IF w[i] <> w[i + 1]]) FROM g),
p AS (
  SELECT c.doc_id, name, a, length(name) AS len FROM c JOIN tok ON tok.doc_id = c.doc_id AND t = name
  UNION ALL SELECT c.doc_id, name, x.a, length(name) FROM c JOIN tok x ON x.doc_id = c.doc_id AND x.t = split_part(name, ' ', 1) AND contains(name, ' ')
  JOIN tok y ON y.doc_id = c.doc_id AND y.i = x.i + 1 AND y.t = ' ' JOIN tok z ON z.doc_id = c.doc_id AND z.i = x.i + 2 AND z.t = split_part(name, ' ', 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY a) AS r FROM p)
SELECT doc_id AS chunk_id, name AS key, CAST(count(*) AS BIGINT) AS found, md5(string_agg((10 * doc_id + a) || ':' || (10 * doc_id + a + len) || ':' || a || ':' || name, ',' ORDER BY a)) AS digest FROM r WHERE r <= 12 GROUP BY doc_id, name""")  # fmt: skip
def exact_spans(spark, sf_dir):
    chunks = placed(spark, sf_dir)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 1)), lambda i: F.when(F.get("w", i - 1) != F.get("w", i), F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i))))
    names = F.array_distinct(F.concat("w", F.filter(pairs, lambda p: p.isNotNull())))
    candidates = chunks.select("chunk_id", F.explode(names).alias("key")).select("chunk_id", "key", F.array(F.initcap("key")).alias("names"))
    return spans.anchor_spans(chunks, candidates).select("chunk_id", "key", F.size("spans").cast("long").alias("found"), told("spans").alias("digest"))


def _extraction(spark, sf_dir):
    """Of each document: two entities and a relation between them, from the first words of its item, with an earlier grounding for every second one."""
    chunks = placed(spark, sf_dir).filter(F.size("w") >= 5)
    word = lambda k: F.get("w", F.lit(k - 1))
    entities = chunks.select("chunk_id", F.explode(F.array(F.struct(word(1).alias("id"), F.array(word(1), word(4)).alias("names")), F.struct(word(3).alias("id"), F.array(word(3)).alias("names")))).alias("e")).select("chunk_id", F.col("e.id").alias("entity_id"), "e.names")
    fields = {"text": F.lit("earlier"), "start": F.lit(0).cast("long"), "end": F.lit(1).cast("long"), "chunk_position": F.lit(0), "local_start": F.lit(0), "local_end": F.lit(1)}
    before = F.create_map(F.lit("target"), F.array(F.struct(*(value.alias(name) for name, value in fields.items()))))
    relations = chunks.select(
        "chunk_id", F.concat(F.lit("r"), F.col("chunk_id").cast("string")).alias("relation_id"), word(1).alias("source"), word(3).alias("target"), F.upper(word(2)).alias("rel_type"), word(5).alias("condition"),
        F.when(F.col("chunk_id") % 2 == 0, before).alias("grounding"),
    )
    return spans.grounded_extraction(chunks, entities, relations)


_GROUNDED = f"""WITH {PLACED},
e AS (SELECT doc_id, w FROM g WHERE len(w) >= 5 AND trim(text) <> ''),
c AS (
  SELECT doc_id, 'source' AS part, w[1] AS name FROM e UNION SELECT doc_id, 'source', w[4] FROM e UNION SELECT doc_id, 'source', w[3] FROM e WHERE w[1] = w[3]
  UNION SELECT doc_id, 'target', w[3] FROM e UNION SELECT doc_id, 'target', w[4] FROM e WHERE w[1] = w[3]
  UNION SELECT doc_id, 'relation', w[2] FROM e UNION SELECT doc_id, 'condition', w[5] FROM e),
p AS (SELECT c.doc_id, part, name, a, row_number() OVER (PARTITION BY c.doc_id, part, name ORDER BY a) AS r FROM c JOIN tok ON tok.doc_id = c.doc_id AND t = name),
s AS (
  SELECT DISTINCT doc_id, part, 10 * doc_id + a AS a, 10 * doc_id + a + length(name) AS b, a AS l, name FROM p WHERE r <= 12
  UNION ALL SELECT doc_id, 'target', 0, 1, 0, 'earlier' FROM g WHERE len(w) >= 5 AND doc_id % 2 = 0),"""


@query("grounded_relations", f"""{_GROUNDED}
m AS (SELECT doc_id, part, md5(string_agg(a || ':' || b || ':' || l || ':' || name, ',' ORDER BY a, b, name)) AS digest FROM s GROUP BY doc_id, part),
f AS (SELECT doc_id, max(digest) FILTER (part = 'source') AS source, max(digest) FILTER (part = 'relation') AS relation, max(digest) FILTER (part = 'target') AS target, max(digest) FILTER (part = 'condition') AS condition FROM m GROUP BY doc_id)
SELECT g.doc_id AS chunk_id, source AS source_spans, relation AS relation_spans, target AS target_spans, condition AS condition_spans,
       array_to_string([x FOR x IN [CASE WHEN source IS NOT NULL THEN 'source' END, CASE WHEN relation IS NOT NULL THEN 'relation' END, CASE WHEN target IS NOT NULL THEN 'target' END] IF x IS NOT NULL], ',') AS components,
       CASE WHEN source IS NOT NULL AND relation IS NOT NULL AND target IS NOT NULL THEN 'full' WHEN source IS NOT NULL AND target IS NOT NULL THEN 'partial'
            WHEN source IS NOT NULL OR relation IS NOT NULL OR target IS NOT NULL THEN 'minimal' ELSE 'failed' END AS restoration_status
FROM g LEFT JOIN f ON f.doc_id = g.doc_id WHERE len(w) >= 5""")  # fmt: skip
def grounded_relations(spark, sf_dir):
    out = _extraction(spark, sf_dir)[1]
    digests = [F.when(F.col("grounding")[part].isNotNull(), told(f"grounding.{part}")).alias(f"{part}_spans") for part in ("source", "relation", "target", "condition")]
    return out.select("chunk_id", *digests, F.array_join("grounded_components", ",").alias("components"), "restoration_status")


@query("grounded_entities", f"""WITH {PLACED},
e AS (SELECT doc_id, w FROM g WHERE len(w) >= 5),
c AS (SELECT doc_id, w[1] AS id, w[1] AS name FROM e UNION SELECT doc_id, w[1], w[4] FROM e UNION SELECT doc_id, w[3], w[3] FROM e),
p AS (SELECT c.doc_id, id, a, length(name) AS len, row_number() OVER (PARTITION BY c.doc_id, id, name ORDER BY a) AS r FROM c JOIN tok ON tok.doc_id = c.doc_id AND t = name),
k AS (SELECT doc_id, id, count(DISTINCT a * 1000 + len) AS n FROM p WHERE r <= 12 GROUP BY doc_id, id),
i AS (SELECT doc_id, unnest([w[1], w[3]]) AS id FROM e)
SELECT i.doc_id AS chunk_id, i.id AS entity_id, CAST(coalesce(n, 0) AS INTEGER) AS anchor_mention_count FROM i LEFT JOIN k ON k.doc_id = i.doc_id AND k.id = i.id""")  # fmt: skip
def grounded_entities(spark, sf_dir):
    return _extraction(spark, sf_dir)[0].select("chunk_id", "entity_id", "anchor_mention_count")
