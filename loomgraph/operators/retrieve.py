"""Vector, lexical and hybrid retrieval over tables of queries and chunks.

A query table has query_id; every cut is per query, with an id as tie-break.
Exact vector search scores all chunks in scope for every query, block against
block, with the best of a pair of blocks kept before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.text import content_tokens, overlap_count
from loomgraph.operators.blocks import Block, nearest, on_pairs, packed, paired, products
from loomgraph.sources.shared import cut

HOP_SCORES = {0: 1.0, 1: 0.8, 2: 0.6}


def top_per_query(scored: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col(rank) <= k)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = 0.08, same_scope: bool = False, exclude_self: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of each query by cosine, from ``threshold`` up.

    ``queries`` has (query_id, embedding) and ``vectors`` (vec_id, embedding);
    with ``same_scope`` both carry ``scope`` and must agree in it. Zero vectors
    score 0. Ties go to the lower id.
    """
    scope = "scope" if same_scope else None
    pairs = paired(packed(vectors, "vec_id", "embedding", scope), packed(queries, "query_id", "embedding", scope))
    scored = on_pairs(pairs, lambda rows, asked: nearest(rows, asked, k, threshold, exclude_self, same_scope), "query_id long, vec_id long, score double")
    return top_per_query(scored, k, F.desc("score"), F.col("vec_id"))


def scoped_span_search(queries: DataFrame, spans: DataFrame, parents: DataFrame, k: int, threshold: float = 0.08) -> DataFrame:
    """(query_id, chunk_id, score, rank, level): the nearest chunks of each query's scope by their spans, or by themselves where the scope has no spans.

    ``queries`` is (query_id, embedding, scope), ``spans`` (span_id, chunk_id,
    embedding, scope) and ``parents`` (chunk_id, embedding, scope). A chunk has
    the score of its best span; only queries whose scope has no span at all go
    to the chunks' own vectors. Ties go to the lower id.
    """
    scopes = spans.select("scope").distinct()
    by_spans, by_chunks = queries.join(scopes, "scope", "left_semi"), queries.join(scopes, "scope", "left_anti")
    own = spans.select(F.col("span_id").alias("vec_id"), "embedding", "scope")
    most = spans.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    met = vector_top_k(by_spans, own, k * most, threshold, same_scope=True).join(spans.select(F.col("span_id").alias("vec_id"), "chunk_id"), "vec_id")
    best = met.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).withColumn("level", F.lit("span"))
    whole = vector_top_k(by_chunks, parents.select(F.col("chunk_id").alias("vec_id"), "embedding", "scope"), k, threshold, same_scope=True)
    both = best.unionByName(whole.select("query_id", F.col("vec_id").alias("chunk_id"), "score", F.lit("chunk").alias("level")))
    return top_per_query(both, k, F.desc("score"), F.col("chunk_id"))


def _forest(close: np.ndarray, down: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from one member of each component of a matrix of pairs to its others."""
    open_down, open_across = close.any(axis=1), close.any(axis=0)
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for seed in np.flatnonzero(open_across).tolist():
        if not open_across[seed]:
            continue
        columns = np.array([seed])
        open_across[seed] = False
        while len(columns):
            lines = np.flatnonzero(close[:, columns].any(axis=1) & open_down)
            open_down[lines] = False
            columns = np.flatnonzero(close[lines].any(axis=0) & open_across)
            open_across[columns] = False
            own = np.concatenate((down[lines], across[columns]))
            own = own[own != across[seed]]
            src.append(np.full(len(own), across[seed]))
            dst.append(own)
    return np.concatenate(src), np.concatenate(dst)


def close_links(vectors: DataFrame, threshold: float, agree: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(src, dst): links that join vectors (vec_id, embedding, scope) of one scope into the components of all pairs with a cosine from ``threshold`` up.

    With ``agree``, vectors carry ``key`` as well, and the keys of a pair must
    agree; it is asked once for each two different keys of a pair of blocks that
    any close pair has. Every pair is scored, block against block; of the pairs
    of two blocks only a spanning forest is handed on, so links grow with the
    vectors, not with the pairs. A link needn't be a close pair itself, but joins
    two that close pairs connect.
    """
    scope = F.col("scope").cast("string")
    told = F.concat_ws("\x00", scope, F.coalesce("key", F.lit(""))) if agree else scope
    blocks = packed(vectors.filter(F.col("scope").isNotNull()).select("vec_id", "embedding", told.alias("scope")), "vec_id", "embedding", "scope")

    def allowed(close: np.ndarray, down: list[str], across: list[str]) -> np.ndarray:
        """The close pairs whose keys agree."""
        rows, at_row = np.unique(down, return_inverse=True)
        columns, at_column = np.unique(across, return_inverse=True)
        asked = np.zeros((len(rows), len(columns)), bool)
        i, j = np.nonzero(close)
        asked[at_row[i], at_column[j]] = True
        for x, y in zip(*np.nonzero(asked), strict=True):
            asked[x, y] = agree(str(rows[x]), str(columns[y]))
        return close & asked[at_row[:, None], at_column[None, :]]

    def links(left: Block, right: Block) -> list:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        sides = [[text.split("\x00", 1) for text in block.scopes.tolist()] for block in (left, right)]
        scopes = [np.array([parts[0] for parts in side], object) for side in sides]
        for scope in set(scopes[0].tolist()) & set(scopes[1].tolist()):
            mine, theirs = np.flatnonzero(scopes[0] == scope), np.flatnonzero(scopes[1] == scope)
            close = np.round(left.vectors[mine] @ right.vectors[theirs].T, 9) >= threshold
            if agree and close.any():
                close = allowed(close, [sides[0][k][1] for k in mine.tolist()], [sides[1][k][1] for k in theirs.tolist()])
            found.append(_forest(close, left.ids[mine], right.ids[theirs]))
        return [np.concatenate(side) if found else [] for side in (zip(*found, strict=True) if found else ((), ()))]

    return on_pairs(paired(blocks, blocks), links, "src long, dst long")


def term_hits(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, term): the lower-case terms of three letters or digits or more that a chunk's text holds, whatever its case.

    A term lies inside one run of letters and digits of the text. So the
    distinct runs of all chunks are matched with the terms once, by the first
    three characters at any place, and what fits is joined back to the chunks.
    Rows lie in their chunk's partition, so what counts them by chunk doesn't
    send them again.
    """
    runs = chunks.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("run"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda i: F.col("run").substr(i, F.lit(3))))
    spread = runs.select("run").distinct().select("run", F.explode(places).alias("gram"))
    wanted = terms.distinct().withColumn("gram", F.left("term", F.lit(3)))
    held = spread.join(wanted, "gram").filter(F.contains("run", "term")).select("run", "term")
    return runs.join(held, "run").select("chunk_id", "term").repartition("chunk_id").distinct()


def text_search(queries: DataFrame, chunks: DataFrame, k: int, most_terms: int = 8) -> DataFrame:
    """(query_id, chunk_id, matched, score, rank): the share of a query's first terms that a chunk contains.

    Terms are runs of three letters or digits or more, wherever they stand in a
    chunk, also inside longer words.
    """
    found = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]{3,}"), F.lit(0))
    terms = queries.select("query_id", F.slice(F.array_distinct(found), 1, most_terms).alias("terms")).filter(F.size("terms") > 0)
    asked = terms.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    matched = term_hits(asked.select("term"), chunks).join(asked, "term").groupBy("query_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("matched"))
    return top_per_query(matched.withColumn("score", F.col("matched") / F.col("n")), k, F.desc("score"), F.col("chunk_id"))


#: Characters by which names and questions meet.
NAME_GRAM = 4


def held_texts(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, hay): the needles that stand anywhere in the texts ``hay``; both distinct, blank needles in none.

    Texts are cut into all their runs of NAME_GRAM characters (and of as many as
    shorter needles have), and needles meet those that begin as they do.
    """
    wanted = needles.filter(F.length("needle") > 0).withColumn("gram", F.left("needle", F.lit(NAME_GRAM)))
    sizes = sorted(row[0] for row in wanted.select(F.length("gram")).distinct().collect())  # NAME_GRAM numbers at most
    runs_of = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("hay") - size + 1)), lambda i: F.col("hay").substr(i, F.lit(size)))
    grams = F.array_distinct(F.concat(*map(runs_of, sizes))) if sizes else F.array().cast("array<string>")
    return hay.select("hay", F.explode(grams).alias("gram")).join(wanted, "gram").filter(F.contains("hay", "needle")).select("needle", "hay").distinct()


def symbolic_lookup(queries: DataFrame, entities: DataFrame, k: int = 40) -> DataFrame:
    """Entities whose name is in the question, holds the question, or has two of its content tokens in it.

    Entities may carry source_title (four characters or more) and the arrays
    all_names and synonyms: an entity also matches if one of these is in the
    question or holds it. Order: name in question, question in name, token
    overlap, title, longer name, id. Names below four characters never match.

    Names and questions meet where the one begins as a run of four characters of
    the other does, so no name is held against every question. Of a question's
    tokens the one that most names hold isn't looked for: who has two has
    another. Blank questions match nothing.
    """
    asked = queries.select("query_id", F.lower(F.trim("question")).alias("q"), content_tokens(F.col("question")).alias("tokens"))
    title = F.lower("source_title") if "source_title" in entities.columns else F.lit(None).cast("string")
    others = [F.coalesce(F.transform(name, F.lower), F.array().cast("array<string>")) for name in ("all_names", "synonyms") if name in entities.columns]
    others = F.concat(*others) if others else F.array().cast("array<string>")
    named = entities.select("entity_id", F.lower("name").alias("name"), title.alias("title"), others.alias("others")).filter(F.length("name") >= 4)

    texts = asked.select(F.col("q").alias("hay")).distinct()
    labels = named.select("entity_id", F.explode(F.array_distinct(F.filter(F.concat(F.array("name", F.when(F.length("title") >= 4, F.col("title"))), "others"), lambda n: n.isNotNull()))).alias("label"))
    distinct = labels.select("label").distinct()
    within = held_texts(distinct.select(F.col("label").alias("needle")), texts).select(F.col("needle").alias("label"), F.col("hay").alias("q"))
    around = held_texts(texts.select(F.col("hay").alias("needle")), distinct.select(F.col("label").alias("hay"))).select(F.col("hay").alias("label"), F.col("needle").alias("q"))
    pairs = within.unionByName(around).distinct()
    met = pairs.join(labels, "label").join(asked.select("query_id", "q"), "q").select("query_id", "entity_id")

    tokens = asked.select("query_id", F.explode("tokens").alias("token"))
    holds = held_texts(tokens.select(F.col("token").alias("needle")).distinct(), named.select(F.col("name").alias("hay")).distinct()).select(F.col("needle").alias("token"), F.col("hay").alias("name"))
    often = holds.groupBy("token").agg(F.count(F.lit(1)).alias("names"))
    ranked = tokens.join(often, "token").withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("names"), "token")))
    rarer = ranked.filter("r > 1").select("query_id", "token").join(holds, "token").join(named.select("entity_id", "name"), "name").select("query_id", "entity_id")

    either = lambda text: F.contains(F.col("q"), text) | F.contains(text, F.col("q"))
    both = met.unionByName(rarer).distinct().join(asked, "query_id").join(named, "entity_id")
    scored = both.select(
        "query_id", "entity_id", "name",
        F.contains(F.col("q"), F.col("name")).cast("int").alias("in_question"),
        F.contains(F.col("name"), F.col("q")).cast("int").alias("holds_question"),
        overlap_count(F.col("tokens"), F.col("name")).alias("overlap"),
        F.coalesce((F.length("title") >= 4) & either(F.col("title")), F.lit(False)).cast("int").alias("in_title"),
        F.exists("others", lambda other: F.coalesce(either(other), F.lit(False))).alias("by_other"),
    ).filter("in_question = 1 OR holds_question = 1 OR overlap >= 2 OR in_title = 1 OR by_other")
    return top_per_query(scored, k, F.desc("in_question"), F.desc("holds_question"), F.desc("overlap"), F.desc("in_title"), F.desc(F.length("name")), F.col("entity_id")).drop("in_title", "by_other")


def chunk_scores(linked: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, links): mean of the linked entities' scores over the query's best, 0.05 more for each further link, at most 1."""
    scores = cut(scores)  # read twice
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    scaled = scores.join(best, "query_id").select("query_id", F.col("node").alias("entity_id"), F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("s"))
    joined = linked.join(scaled, ["query_id", "entity_id"])
    return joined.groupBy("query_id", "chunk_id").agg(F.least(F.lit(1.0), F.avg("s") + 0.05 * (F.count(F.lit(1)) - 1)).alias("score"), F.count(F.lit(1)).alias("links"))


def hop_score(hops: Column) -> Column:
    """1, 0.8 and 0.6 for 0, 1 and 2 hops, else 0.5; unknown counts as 2."""
    known = F.coalesce(hops, F.lit(2))
    return F.when(known == 0, 1.0).when(known == 1, 0.8).when(known == 2, 0.6).otherwise(0.5)


def passage_cap(scored: DataFrame, cap: int = 2) -> DataFrame:
    """At most ``cap`` chunks of a passage, by score, links and place."""
    order = W.partitionBy("query_id", "passage").orderBy(F.desc("score"), F.desc("links"), "position", "chunk_id")
    return scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")


def relevance_gate(chunks: DataFrame, least: float = 0.30) -> DataFrame:
    """Chunks reached by a hop need a cosine from ``least`` up, unknown ones stay; if none would stay, all do."""
    fine = (F.col("hops") == 0) | F.col("cosine").isNull() | (F.col("cosine") >= least)
    left = F.sum(fine.cast("int")).over(W.partitionBy("query_id"))
    return chunks.withColumn("_fine", fine).withColumn("_left", left).filter(F.col("_fine") | (F.col("_left") == 0)).drop("_fine", "_left")


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, rrf, support, score) from (query_id, list_id, chunk_id, rank, score)."""
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.countDistinct("list_id").alias("support"), F.max("score").alias("best"))
    return fused.withColumn("score", F.col("rrf") + 0.05 * F.least("support", F.lit(3)) + 0.01 * F.col("best")).drop("best")


def merge_contexts(primary: DataFrame, secondary: DataFrame, extra: int = 5, floor: float = 0.55, limit: int = 20) -> DataFrame:
    """The primary chunks and up to ``extra`` new ones of the secondary list, at a score of ``floor`` at least; the best ``limit``."""
    new = secondary.join(primary.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    new = top_per_query(new, extra, F.desc("score"), F.col("chunk_id"), rank="_r").drop("_r").withColumn("score", F.greatest("score", F.lit(floor)))
    both = primary.select("query_id", "chunk_id", "score").withColumn("origin", F.lit("primary")).unionByName(new.select("query_id", "chunk_id", "score").withColumn("origin", F.lit("secondary")))
    return top_per_query(both, limit, F.desc("score"), F.col("origin"), F.col("chunk_id"))


def max_sim(query_tokens: DataFrame, chunk_tokens: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): mean over the query's token vectors of the greatest dot product with the chunk's.

    Chunk tokens are (chunk_id, c_vec), of a shortlist if they carry query_id;
    query tokens are (query_id, q_token, q_vec). Without a shortlist every chunk
    meets every query token, block against block; for a search that doesn't, see
    :mod:`loomgraph.operators.late`.
    """
    from loomgraph.functions.vectors import dot

    if "query_id" in chunk_tokens.columns:
        pairs = chunk_tokens.join(query_tokens, "query_id")
        best = pairs.groupBy("query_id", "chunk_id", "q_token").agg(F.max(dot(F.col("q_vec"), F.col("c_vec"))).alias("best"))
    else:
        tokens = query_tokens.withColumn("scope", F.concat_ws(":", "query_id", "q_token"))
        blocks = paired(packed(chunk_tokens, "chunk_id", "c_vec", normalised=False), packed(tokens, "query_id", "q_vec", "scope", normalised=False))
        best = on_pairs(blocks, best_of_chunks, "query_id long, q_token long, chunk_id long, best double").groupBy("query_id", "chunk_id", "q_token").agg(F.max("best").alias("best"))
    return best.groupBy("query_id", "chunk_id").agg(F.avg("best").alias("score"))


def best_of_chunks(chunks: Block, tokens: Block) -> list:
    """(query_id, q_token, chunk_id, best): each query token's greatest product with the tokens of each chunk of a block."""
    order = np.argsort(chunks.ids, kind="stable")
    own, first = np.unique(chunks.ids[order], return_index=True)
    best = np.concatenate([np.maximum.reduceat(products(part, chunks)[:, order], first, axis=1) for part in tokens.slices(chunks)])
    names = np.array([int(scope.split(":")[1]) for scope in tokens.scopes], np.int64)
    return [np.repeat(tokens.ids, len(own)), np.repeat(names, len(own)), np.tile(own, len(tokens.ids)), best.ravel()]


def gumbel_top_k(ranked: DataFrame, k: int, temperature: float = 0.0, factor: int = 3, most: int = 200, seed: int = 42) -> DataFrame:
    """k of the best min(k * factor, most) chunks: by rank at temperature 0, else by score plus Gumbel noise; rank order is kept.

    The noise of a chunk is a hash of seed, query and chunk, so a run can be repeated on any partitioning.
    """
    if temperature <= 0:
        return ranked.filter(F.col("rank") <= k)
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("chunk_id").cast("string")))
    unit = (F.conv(F.substring(drawn, 1, 10), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 40))
    noisy = ranked.filter(F.col("rank") <= min(k * factor, most)).withColumn("_key", F.col("score") / temperature - F.log(-F.log(unit)))
    return top_per_query(noisy, k, F.desc("_key"), F.col("chunk_id"), rank="_r").drop("_r", "_key")
