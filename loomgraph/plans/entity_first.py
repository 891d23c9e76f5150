"""Queries from question to pruned context, over entities and edges drawn from the items' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.text import QUERY_STOPWORDS
from loomgraph.operators import entity_first, spans
from loomgraph.operators.stats import W
from loomgraph.plans.fixtures import walks_sql
from loomgraph.plans.registry import query
from loomgraph.sources.shared import stored
from loomgraph.sources.tables import read_table


def store_of(spark, sf_dir) -> entity_first.Store:
    """Words of five letters or more of all items are entities, neighbouring ones edges; documents are chunks."""
    items, docs, vectors = (read_table(spark, sf_dir, name) for name in ("benchmark", "documents", "embeddings"))
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w.rlike("^[a-z0-9]{5,}$"))
    listed = items.select("item_id", words.alias("w"))
    names = listed.select(F.explode("w").alias("name")).distinct().withColumn("number", (F.row_number().over(W.orderBy("name")) - 1).cast("long"))
    entities = names.join(vectors.select(F.col("vec_id").alias("number"), "embedding"), "number", "left").select(F.concat(F.lit("W:"), "name").alias("entity_id"), "name", "number", "embedding")
    entities = stored(entities, "fixture-entities")
    pairs = listed.filter(F.size("w") > 1).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    name = lambda at: F.concat(F.lit("W:"), F.get("w", at))
    edges = pairs.select(
        F.concat_ws(":", "item_id", "i").alias("edge_id"), name(F.col("i") - 1).alias("src"), name(F.col("i")).alias("dst"), F.lit("NEXT").alias("rel_type"),
        ((30 + 10 * ((F.col("item_id") + F.col("i")) % 7)) / 100.0).alias("confidence"), F.array((F.col("i") % 3).cast("int")).alias("positions"),
    )
    chunks = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document"), F.floor(F.col("doc_id") / 3).alias("passage"), (F.col("doc_id") % 3).cast("int").alias("position"), "embedding",
    )
    mentions = stored(spans.mention_links(chunks.select("chunk_id", "text"), entities, quotes=False), "fixture-mentions")
    return entity_first.Store(entities, edges, mentions, chunks)


def questions(spark, sf_dir):
    """Each item is a question; some have no vector, some compare, and graphs have names with limits of their own."""
    items, vectors = read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "embeddings")
    k = F.col("item_id")
    own = items.join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")
    return own.select(
        k.alias("query_id"), F.col("text").alias("question"), F.when(k % 5 < 3, F.col("embedding")).alias("embedding"),
        F.when(k % 3 == 0, "MultihopRAG").when(k % 3 == 1, "hotpotqa").alias("kg_name"), F.when(k % 7 == 6, "comparison").otherwise("generic").alias("kind"),
    )


_STOP = ", ".join(f"'{word}'" for word in QUERY_STOPWORDS if len(word) >= 4)


CONTEXT = rf"""ws AS (SELECT item_id, text, [x FOR x IN string_split(lower(text), ' ') IF regexp_matches(x, '^[a-z0-9]{{5,}}$')] AS w FROM benchmark),
nm AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS number FROM (SELECT DISTINCT unnest(w) AS name FROM ws)),
ents AS MATERIALIZED (SELECT 'W:' || name AS id, name, number, embedding AS vec FROM nm LEFT JOIN embeddings ON vec_id = number),
edg AS MATERIALIZED (
  SELECT item_id || ':' || i AS edge_id, 'W:' || w[i] AS src, 'W:' || w[i + 1] AS dst, (30 + 10 * ((item_id + i) % 7)) / 100.0::DOUBLE AS confidence, CAST(i % 3 AS INTEGER) AS position
  FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM ws)),
chk AS MATERIALIZED (SELECT doc_id AS c, text, doc_id // 3 AS passage, CAST(doc_id % 3 AS INTEGER) AS position, embedding AS vec FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
men AS MATERIALIZED (SELECT DISTINCT c, 'W:' || t AS id FROM (SELECT doc_id AS c, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) JOIN nm ON nm.name = t),
qs AS MATERIALIZED (
  SELECT item_id AS q, lower(trim(text)) AS low, text, CASE WHEN item_id % 5 < 3 THEN embedding END AS vec, CASE item_id % 3 WHEN 0 THEN 12 ELSE 30 END AS most, CASE item_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.25 END AS least, item_id % 7 = 6 AS compares,
         list_distinct([t FOR t IN regexp_extract_all(lower(text), '[a-z0-9]+') IF length(t) >= 4 AND t NOT IN ({_STOP})]) AS ts
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
sy AS (
  SELECT q, id, name, contains(low, name)::INT AS a, contains(name, low)::INT AS b, len([t FOR t IN ts IF contains(name, t)]) AS o FROM qs, ents WHERE NOT compares),
sym AS (SELECT * FROM sy WHERE a = 1 OR b = 1 OR o >= 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY a DESC, b DESC, o DESC, length(name) DESC, id) <= 40),
sp AS (SELECT id, 1.0::DOUBLE / count(*) AS s FROM men GROUP BY id),
ann AS (
  SELECT q, n.id, n.name, cos * coalesce(s, 1) AS score
  FROM (SELECT q, id, name, round(list_cosine_similarity(qs.vec::DOUBLE[], ents.vec::DOUBLE[]), 9) AS cos FROM qs JOIN ents ON qs.vec IS NOT NULL AND ents.vec IS NOT NULL WHERE NOT compares) n LEFT JOIN sp ON sp.id = n.id
  WHERE cos >= 0.55 QUALIFY row_number() OVER (PARTITION BY q ORDER BY cos DESC, number_of(n.id)) <= 15),
cand AS MATERIALIZED (
  SELECT coalesce(sym.q, ann.q) AS q, coalesce(sym.id, ann.id) AS id, coalesce(sym.name, ann.name) AS name, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(o, 0) AS o, coalesce(score, 0) AS score
  FROM sym FULL JOIN ann ON ann.q = sym.q AND ann.id = sym.id QUALIFY row_number() OVER (PARTITION BY coalesce(sym.q, ann.q) ORDER BY coalesce(a, 0) DESC, coalesce(b, 0) DESC, coalesce(o, 0) DESC, coalesce(score, 0) DESC, length(coalesce(sym.name, ann.name)) DESC, coalesce(sym.id, ann.id)) <= 12),
tld AS (SELECT cand.q, bool_or(a > 0 OR b > 0 OR o >= 2) AS told, string_agg(lower(name), ' ') AS hay FROM cand GROUP BY cand.q),
sure AS (SELECT tld.q FROM tld JOIN qs ON qs.q = tld.q WHERE told OR CASE WHEN len(ts) > 0 THEN least(1, len([t FOR t IN ts IF contains(hay, t)]) / len(ts)) ELSE 0 END >= least),
seed AS MATERIALIZED (SELECT cand.q, id AS node FROM cand JOIN sure ON sure.q = cand.q),
st AS MATERIALIZED (SELECT DISTINCT s, d FROM (SELECT src AS s, dst AS d FROM edg WHERE confidence >= 0.4 UNION ALL SELECT dst, src FROM edg WHERE confidence >= 0.4)),
h1 AS (SELECT DISTINCT q, node AS seed, d AS node FROM seed JOIN st ON s = node WHERE d <> node),
h2 AS (SELECT DISTINCT q, seed, d AS node FROM h1 JOIN st ON s = h1.node WHERE d <> seed),
nb AS (SELECT q, node, min(h) AS hops, count(DISTINCT seed) AS seeds FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2) x WHERE NOT EXISTS (SELECT 1 FROM seed y WHERE y.q = x.q AND y.node = x.node) GROUP BY q, node),
ent AS MATERIALIZED (
  SELECT q, node, 0 AS hops FROM seed UNION ALL
  SELECT q, node, hops FROM (SELECT nb.*, most, row_number() OVER (PARTITION BY nb.q ORDER BY seeds DESC, hops, node) AS r FROM nb JOIN qs ON qs.q = nb.q) WHERE r <= most),
among AS MATERIALIZED (SELECT x.q, edg.* FROM edg JOIN ent x ON x.node = src JOIN ent y ON y.q = x.q AND y.node = dst WHERE confidence >= 0.4),
{walks_sql()},
cc AS (
  SELECT q, m.c, count(*) AS links, min(hops) AS hops, any_value(position) AS position FROM men m JOIN ent ON ent.node = m.id JOIN chk ON chk.c = m.c GROUP BY q, m.c
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, any_value(position), m.c) <= 200),
c2 AS MATERIALIZED (SELECT * FROM cc QUALIFY count(*) OVER (PARTITION BY q) >= 2),
sc AS (
  SELECT c2.q, c2.c, round(least(1, avg(coalesce(share, CASE ent.hops WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END)) + 0.05 * (count(*) - 1)), 9) AS score
  FROM c2 JOIN men ON men.c = c2.c JOIN ent ON ent.q = c2.q AND ent.node = men.id LEFT JOIN walk ON walk.q = c2.q AND walk.node = men.id GROUP BY c2.q, c2.c),
gt AS (
  SELECT c2.*, sc.score, passage, CASE WHEN qs.vec IS NOT NULL AND chk.vec IS NOT NULL THEN round(list_cosine_similarity(qs.vec::DOUBLE[], chk.vec::DOUBLE[]), 9) END AS cos
  FROM c2 JOIN sc ON sc.q = c2.q AND sc.c = c2.c JOIN chk ON chk.c = c2.c JOIN qs ON qs.q = c2.q),
fn AS (SELECT *, hops = 0 OR cos IS NULL OR cos >= 0.3 AS fine FROM gt),
f2 AS (SELECT * FROM fn QUALIFY fine OR sum(fine::INT) OVER (PARTITION BY q) = 0),
cp AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY q, passage ORDER BY score DESC, links DESC, position, c) <= 2),
sel AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, links DESC, position, c) AS rank FROM cp QUALIFY rank <= 20)""".replace("number_of(n.id)", "(SELECT number FROM ents e WHERE e.id = n.id)")


@query("retrieved_context", f"""WITH {CONTEXT},
vf AS (
  SELECT qs.q, chk.c, round(list_cosine_similarity(qs.vec::DOUBLE[], chk.vec::DOUBLE[]), 9) AS score FROM qs JOIN chk ON qs.vec IS NOT NULL AND chk.vec IS NOT NULL WHERE qs.q NOT IN (SELECT q FROM sel)),
vk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM vf WHERE score >= 0.08 QUALIFY rank <= 20),
tx AS (SELECT q, list_distinct(regexp_extract_all(low, '[a-z0-9]{{3,}}')) AS x, regexp_extract_all(low, '[a-z0-9]{{3,}}') AS o FROM qs WHERE q NOT IN (SELECT q FROM sel) AND q NOT IN (SELECT q FROM vk)),
tp AS (SELECT q, (list_sort([list_position(o, e) FOR e IN x]))[:8] AS ps, o FROM tx),
tq AS (SELECT q, len(ps) AS n, unnest([o[p] FOR p IN ps]) AS term FROM tp),
tm AS (SELECT q, c, n, count(*) AS matched FROM tq JOIN chk ON contains(lower(text), term) GROUP BY q, c, n),
t2 AS (SELECT q, c, matched / n AS score, row_number() OVER (PARTITION BY q ORDER BY matched / n DESC, c) AS rank FROM tm QUALIFY rank <= 20)
SELECT q AS query_id, c AS chunk_id, 'entity_first' AS route, round(score, 6) AS score, CAST(hops AS INTEGER) AS hops, CAST(links AS BIGINT) AS links, CAST(rank AS INTEGER) AS rank FROM sel
UNION ALL SELECT q, c, 'semantic_only', round(score, 6), NULL, NULL, CAST(rank AS INTEGER) FROM vk UNION ALL SELECT q, c, 'text', round(score, 6), NULL, NULL, CAST(rank AS INTEGER) FROM t2""")  # fmt: skip
def retrieved_context(spark, sf_dir):
    found = entity_first.retrieved_context(questions(spark, sf_dir), store_of(spark, sf_dir))
    return found.chunks.withColumn("score", F.round("score", 6))


_RETAINED = "ret AS MATERIALIZED (SELECT DISTINCT sel.q, men.id AS node FROM sel JOIN men ON men.c = sel.c)"


@query("context_entities", f"""WITH {CONTEXT}, {_RETAINED}
SELECT ent.q AS query_id, ent.node AS entity_id, CAST(hops AS INTEGER) AS hops FROM ent JOIN ret ON ret.q = ent.q AND ret.node = ent.node""")
def context_entities(spark, sf_dir):
    asked = questions(spark, sf_dir).filter("kind <> 'comparison'")
    return entity_first.entity_first(asked, store_of(spark, sf_dir)).entities.select("query_id", "entity_id", "hops")


@query("context_relations", f"""WITH {CONTEXT}, {_RETAINED}, own AS (SELECT ent.q, ent.node FROM ent JOIN ret ON ret.q = ent.q AND ret.node = ent.node)
SELECT x.q AS query_id, edge_id, src, dst, confidence FROM edg JOIN own x ON x.node = src JOIN own y ON y.q = x.q AND y.node = dst
WHERE confidence >= 0.4 AND EXISTS (SELECT 1 FROM sel WHERE sel.q = x.q AND sel.position = edg.position)""")
def context_relations(spark, sf_dir):
    asked = questions(spark, sf_dir).filter("kind <> 'comparison'")
    return entity_first.entity_first(asked, store_of(spark, sf_dir)).edges.select("query_id", "edge_id", "src", "dst", "confidence")
