"""Queries on coreference: turns of conversations as chunks that point back to what earlier turns speak of."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import coreference as co
from loomgraph.plans.registry import query
from loomgraph.sources.tables import read_table

PHRASES = ["This disease stays. ", "These patients and the Drug ", "as described above, the gene of this  model ", "Nothing here. ", "The film, the city and THE MICE of this condition. "]
TYPES = ["Disease", "Drug", "Gene", "Thing", "Patient", "Film"]
DESCRIPTIONS = ["", "a small city", "some mice", "costs $1 and \\2"]


def chunks(spark, sf_dir):
    turn = F.col("turn")
    phrase = F.get(F.array(*map(F.lit, PHRASES)), ((turn + F.col("conv_id")) % len(PHRASES)).cast("int"))
    return read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), turn.alias("position"), F.concat(phrase, "text").alias("text"))


def entities(spark, sf_dir):
    """The first two longer words of every turn, with types and descriptions by turn; some turns have none."""
    k = F.col("conv_id") + F.col("turn")
    words = F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}{5,}"), F.lit(0)), 1, 2)
    rows = read_table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 4 > 0").select(F.col("conv_id").alias("document"), F.col("turn").alias("position"), k.alias("k"), F.posexplode(words).alias("place", "name"))
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    return rows.select("document", "position", "place", "name", pick(TYPES, F.col("k") + F.col("place")).alias("type"), pick(DESCRIPTIONS, F.col("k")).alias("description"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"


def _resolved_sql() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT d, p, f, place, name, '{kind}' AS kind FROM e WHERE type IN ({', '.join(map(repr, types))}) OR " + " OR ".join(f"contains(lower(description), '{word}')" for word in words) for kind, (types, words, _) in co.KINDS.items()
    )
    steps = "".join(
        f""",
r{k + 1} AS (SELECT r.*, CASE WHEN coalesce(n.name, latest) IS NOT NULL THEN regexp_replace(t, '{co.phrase_pattern(kind)}', coalesce(n.name, latest), 'g') ELSE t END AS u FROM r{k} r LEFT JOIN nk n ON n.d = r.d AND n.p = r.p AND n.kind = '{kind}'),
s{k + 1} AS (SELECT d, p, raw, latest, u AS t FROM r{k + 1})""".replace(f"FROM r{k} r", f"FROM s{k} r")
        for k, kind in enumerate(co.KINDS)
    )
    return rf"""WITH c AS (SELECT conv_id AS d, turn AS p, {_listed(PHRASES)}[(turn + conv_id) % {len(PHRASES)} + 1] || text AS t FROM conversations),
w AS (SELECT conv_id AS d, turn AS f, conv_id + turn AS k, regexp_extract_all(text, '\p{{L}}{{5,}}')[:2] AS ws FROM conversations WHERE (conv_id + turn) % 4 > 0),
x AS (SELECT d, f, k, unnest(range(len(ws))) AS place, unnest(ws) AS name FROM w),
e AS (SELECT d, f, unnest([f + 1, f + 2]) AS p, place, name, {_listed(TYPES)}[(k + place) % {len(TYPES)} + 1] AS type, {_listed(DESCRIPTIONS)}[k % {len(DESCRIPTIONS)} + 1] AS description FROM x),
la AS (SELECT d, p, arg_max(name, f * 10 + place) AS latest FROM e GROUP BY d, p),
ka AS ({kinds}),
nk AS (SELECT d, p, kind, arg_max(name, f * 10 + place) AS name FROM ka GROUP BY d, p, kind),
s0 AS (SELECT c.d, c.p, c.t AS raw, latest, c.t FROM c LEFT JOIN la ON la.d = c.d AND la.p = c.p){steps}
SELECT d AS document, p AS position, md5(CASE WHEN regexp_matches(raw, '{co.MARKERS}') AND latest IS NOT NULL THEN t ELSE raw END) AS resolved FROM s{len(co.KINDS)}"""


@query("resolved_chunks", _resolved_sql())
def resolved_chunks(spark, sf_dir):
    out = co.resolved_chunks(chunks(spark, sf_dir), entities(spark, sf_dir))
    return out.select("document", "position", F.md5("resolved_text").alias("resolved"))


@query("pointing_chunks", f"""SELECT conv_id AS document, turn AS position, regexp_matches({_listed(PHRASES)}[(turn + conv_id) % {len(PHRASES)} + 1] || text, '{co.MARKERS}') AS points FROM conversations""")
def pointing_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("document", "position", co.points_back(F.col("text")).alias("points"))
