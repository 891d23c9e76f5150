"""Reports over evaluated runs: headline accuracy, averages, ladders, prevalence, recalls and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.naming import span_match, surface_forms, text_spans
from loomgraph.functions.text import structural_text
from loomgraph.operators.alike import similar_names
from loomgraph.operators.retrieve import held_texts


def clean_headline(runs: DataFrame) -> DataFrame:
    """Runs with accuracy without failures as the headline where it is known and not 0; the raw one is kept beside it."""
    clean = lambda raw, own: F.when(F.coalesce(F.col(own), F.lit(0.0)) != 0, F.col(own)).otherwise(F.coalesce(F.col(raw), F.lit(0.0)))
    out = runs.withColumn("raw_1", F.coalesce("accuracy_1", F.lit(0.0))).withColumn("raw_2", F.coalesce("accuracy_2", F.lit(0.0)))
    return out.withColumn("accuracy_1", clean("raw_1", "clean_1")).withColumn("accuracy_2", clean("raw_2", "clean_2")).drop("clean_1", "clean_2")


def metric_averages(rows: DataFrame, keys: list[str], metrics: list[str], default: float = 0.0) -> DataFrame:
    """(keys, metric, mean, n): the mean of each metric over the rows that have it; ``default`` where none has."""
    spread = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*keys, "x.metric", "x.value")
    return spread.groupBy(*keys, "metric").agg(F.coalesce(F.avg("value"), F.lit(default)).alias("mean"), F.count("value").alias("n"))


def mean_of_means(rows: DataFrame, keys: list[str], inner: str, value: str) -> DataFrame:
    """(keys, mean, groups): the mean over ``inner`` of each one's own mean, so that each counts alike."""
    own = rows.groupBy(*keys, inner).agg(F.avg(value).alias("_m")).filter(F.col("_m").isNotNull())
    return own.groupBy(*keys).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("groups"))


def calm(entropy: Column, spread: Column, floor: float = 1e-9) -> Column:
    """Whether all samples agree and their spread is at its floor."""
    return F.coalesce((F.abs(entropy) < 1e-9) & (spread <= floor), F.lit(False))


def calm_ladder(rows: DataFrame, keys: list[str], loose: float = 0.51) -> DataFrame:
    """(keys, n_wrong, strict, unanimous, near): the share of wrong answers that are calm, by three nested definitions; null without wrong ones."""
    wrong = rows.filter(~F.col("correct"))
    share = lambda hit: F.avg(F.coalesce(hit, F.lit(False)).cast("double"))
    return wrong.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_wrong"),
        share(calm(F.col("entropy"), F.col("spread"))).alias("strict"),
        share(F.abs("entropy") < 1e-9).alias("unanimous"),
        share(F.col("entropy") <= loose).alias("near"),
    )


def prevalence(rows: DataFrame, keys: list[str], within: list[str], graph: bool = True) -> DataFrame:
    """How answers fall into calm and noisy errors, flagged or not, and correct ones that pass the certificate.

    Rows are (correct, entropy, spread, seu, gps); the certificate's bound on
    spread is the median of ``keys`` and ``within``. Without ``graph`` there is
    no gps, and it neither flags nor passes anything.
    """
    median = rows.groupBy(*keys, *within).agg(F.median("spread").alias("_median"))
    marked = rows.join(median, [*keys, *within])
    is_calm = calm(F.col("entropy"), F.col("spread"))
    flagged = F.coalesce(F.col("seu") > 0.5, F.lit(False)) | (F.lit(graph) & F.coalesce(F.col("gps") > 0.5, F.lit(True)))
    passed = F.coalesce((F.col("spread") <= F.col("_median")) & (F.col("seu") <= 0.5), F.lit(False)) & (F.lit(not graph) | F.coalesce(F.col("gps") <= 0.5, F.lit(False)))
    wrong, count = ~F.col("correct"), lambda c: F.sum(c.cast("long"))
    ratio = lambda up, down: F.when(down > 0, up / down)
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("answered"), count(wrong).alias("wrong"), count(wrong & is_calm).alias("calm_wrong"),
        ratio(count(wrong & is_calm), count(wrong)).alias("calm_share"), ratio(count(wrong & is_calm & flagged), count(wrong & is_calm)).alias("flagged_share"),
        ratio(count(wrong & ~is_calm), count(wrong)).alias("noisy_share"), ratio(count(~wrong & passed), count(~wrong)).alias("certified_share"),
    )


def rank_biserial(auroc: Column) -> Column:
    """2 AUROC - 1."""
    return 2 * auroc - 1


def answered_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, answered, failures, failure_rate)."""
    failures = F.sum(F.col("failed").cast("long"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - failures).alias("answered"), failures.alias("failures"), (failures / F.count(F.lit(1))).alias("failure_rate"))


def failure_odds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, odds_ratio): the odds that the first system fails over the second's, each cell raised by one half."""
    cell = lambda c: F.sum(c.cast("long")) + 0.5
    one, two = F.col("failed"), F.col("kg_failed")
    return rows.groupBy(*keys).agg(((cell(one) * cell(~two)) / (cell(~one) * cell(two))).alias("odds_ratio"))


def hopwise_wrong(rows: DataFrame) -> DataFrame:
    """Rows (n, accuracy) with n_wrong, the nearest whole number of wrong answers; halves go to the even one."""
    return rows.withColumn("n_wrong", F.bround(F.col("n") * (1 - F.col("accuracy")), 0).cast("long"))


def overlap_stability(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs, mean, median) of overlaps (jaccard)."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.avg("jaccard").alias("mean"), F.median("jaccard").alias("median"))


def correctness_class(first: Column, second: Column) -> Column:
    return F.when(first & second, "both_correct").when(first, "vanilla_only").when(second, "kg_only").otherwise("neither")


def fact_audit(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Recalls of supporting facts by class of correctness: (kind, n, in_graph, retrieved, reachable, all_retrieved).

    Facts are (question_id, in_graph, rank, reachable); retrieved means a rank
    up to 40. Each question counts once; one without facts has no recall.
    """
    hit = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    own = facts.groupBy("question_id").agg(hit(F.col("in_graph")).alias("g"), hit(F.col("rank") <= 40).alias("r"), hit(F.col("reachable")).alias("w"))
    met = classes.join(own, "question_id", "left")
    return met.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.avg("g").alias("in_graph"), F.avg("r").alias("retrieved"), F.avg("w").alias("reachable"), F.avg(F.coalesce(F.col("r") >= 1, F.lit(False)).cast("double")).alias("all_retrieved")
    )


def config_grid(spark, **axes: list) -> DataFrame:
    """Every combination of the values of the axes, with a name ``a=1,b=2``; the axes are what a study states, so the grid is small."""
    frames = [spark.createDataFrame([(value,) for value in values], [name]) for name, values in axes.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), frames)
    return grid.withColumn("name", F.concat_ws(",", *[F.concat(F.lit(f"{name}="), F.col(name).cast("string")) for name in axes]))


def seeded_subset(rows: DataFrame, keys: list[str], order: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each group, chosen by a hash of seed and id, with their place in the group's own order.

    The choice is the same on any partitioning and in any engine, and a larger
    n keeps what a smaller one has.
    """
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string")), 256)
    chosen = rows.withColumn("_d", F.row_number().over(W.partitionBy(*keys).orderBy(draw, order))).filter(F.col("_d") <= n)
    return chosen.drop("_d").withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def support_grid(answers: DataFrame, grid: DataFrame) -> DataFrame:
    """(tau, gamma, question_id, score): one less the weighed support of a question's answers (cosine, length) at each point of a small grid.

    Answers below tau don't count; a length of L weighs gamma ** (L - 1), none
    nothing. Null where no answer counts.
    """
    met = answers.join(F.broadcast(grid))  # a stated few points
    counts = F.col("cosine") >= F.col("tau")
    up = F.sum(F.when(counts, F.coalesce(F.col("cosine") * F.pow("gamma", F.col("length") - 1), F.lit(0.0))))
    down = F.sum(F.when(counts, F.col("cosine")))
    return met.groupBy("tau", "gamma", "question_id").agg(F.when(down > 0, 1 - up / down).alias("score"))


#: Ratio from which a span is a misspelled form of a name.
MISSPELLED = 0.92


def text_entities(texts: DataFrame, entities: DataFrame, least: int = 4, most: int = 5) -> DataFrame:
    """(text_id, entity_id, score, rank): the entities (entity_id, names) that a text names most surely.

    A form of a name that is one of the text's spans scores 5 and more, one that
    stands in the text, also inside a word, 4 and more, and one that is spelled
    like a span of about as many words 3 and the ratio. Texts and names meet by
    what they hold and by a join of similar spellings, not all with all.
    """
    asked = texts.withColumn("spans", text_spans(F.col("text"), least)).withColumn("hay", structural_text(F.col("text")))
    named = entities.select("entity_id", surface_forms(least, F.col("names")).alias("forms"))
    forms = named.select("entity_id", F.explode("forms").alias("needle"))
    held = held_texts(forms.select("needle").distinct(), asked.select("hay").distinct())
    met = held.join(asked.select("text_id", "hay"), "hay").join(forms, "needle").select("text_id", "entity_id").distinct()
    sure = met.join(asked, "text_id").join(named, "entity_id").withColumn("score", span_match(F.col("text"), F.col("spans"), F.col("forms"))).filter("score > 0").select("text_id", "entity_id", "score")

    spans = asked.select("text_id", F.posexplode("spans").alias("at", "span"))
    alike = similar_names(spans.select(F.col("span").alias("name")), forms.select(F.col("needle").alias("name")), MISSPELLED).filter(F.col("a") != F.col("b"))
    words = lambda name: F.size(F.split(name, " "))
    near = alike.filter(F.abs(words("a") - words("b")) <= 1).join(spans, F.col("a") == F.col("span"))
    first = near.groupBy("text_id", "b").agg(F.min_by("ratio", "at").alias("ratio"))
    like = first.join(forms, F.col("b") == F.col("needle")).groupBy("text_id", "entity_id").agg((3 + F.max("ratio")).alias("score"))

    scored = sure.unionByName(like).groupBy("text_id", "entity_id").agg(F.max("score").alias("score")).join(named, "entity_id")
    order = W.partitionBy("text_id").orderBy(F.desc("score"), F.desc(F.length(F.get("forms", F.lit(0)))), "entity_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("text_id", "entity_id", "score", "rank")


def answer_sources(asked: DataFrame, answered: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, entity_id, sources, null_reason): a question's answer entities with the question entities that may lead to them.

    An entity doesn't lead to itself. Without any, the reason: no_q_entities,
    no_a_entities or trivial_overlap.
    """
    q = asked.groupBy("question_id").agg(F.array_sort(F.collect_set("entity_id")).alias("q"))
    pairs = questions.join(q, "question_id", "left").join(answered, "question_id", "left")
    sources = F.filter("q", lambda x: x != F.col("entity_id"))
    rows = pairs.withColumn("sources", F.when(F.size(sources) > 0, sources))
    usable = F.max(F.col("sources").isNotNull().cast("int")).over(W.partitionBy("question_id"))
    reason = F.when(F.coalesce(F.size("q"), F.lit(0)) <= 0, "no_q_entities").when(F.col("entity_id").isNull(), "no_a_entities").when(usable == 0, "trivial_overlap")
    rows = rows.withColumn("null_reason", reason)
    kept = rows.filter(F.col("sources").isNotNull()).select("question_id", "entity_id", "sources", "null_reason")
    none = rows.filter(F.col("null_reason").isNotNull()).select("question_id", F.lit(None).cast(answered.schema["entity_id"].dataType).alias("entity_id"), F.lit(None).cast("array<string>").alias("sources"), "null_reason").distinct()
    return kept.unionByName(none)
