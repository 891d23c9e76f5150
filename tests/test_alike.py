import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import fuzzy
from loomgraph.operators import alike

RNG = random.Random(9)


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def word(letters, n):
    return "".join(RNG.choice(letters) for _ in range(n))


def test_ratios_are_those_of_matching_blocks():
    pairs = [(word("ab", RNG.randrange(9)), word("ab", RNG.randrange(9))) for _ in range(800)]
    pairs += [(word("abc é日🙂", RNG.randrange(40)), word("abc é日🙂", RNG.randrange(40))) for _ in range(300)] + [("a" * 300, "b" + "a" * 250)]
    found = fuzzy.matched_characters(pairs).tolist()
    for (a, b), n in zip(pairs, found, strict=True):
        assert n == sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), (a, b)


@pytest.mark.parametrize("least", [0.6, 0.8, 0.92])
def test_no_pair_of_similar_names_is_lost(spark, least):
    base = [word("abcdef", RNG.randrange(1, 14)) for _ in range(60)]

    def changed(text):
        at = RNG.randrange(len(text) + 1)
        return RNG.choice([text, text + "x", text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[::-1]])

    left, right = base, [changed(text) for text in base] + base[:20] + ["", "a"]
    frames = [spark.createDataFrame([(text,) for text in [*side, None]], "name string") for side in (left, right)]
    found = {(row["a"], row["b"]): row["ratio"] for row in alike.similar_names(*frames, least).collect()}
    expected = {(a, b): ratio(a, b) for a in left for b in right if a and b and ratio(a, b) >= least}
    assert found.keys() == expected.keys() and all(abs(found[pair] - expected[pair]) < 1e-12 for pair in found)


def key(text):
    return "_".join(text.lower().split())


def resolved(raw, entities):
    """By comparing with every entity."""
    raw = raw.strip()
    if not raw:
        return None
    variants = lambda n: {v.lower() for v in (n, n.replace("_", " "), n.replace(" ", "_"), key(n)) if v.strip()}
    direct, scores = [], {}
    for name, others in entities.items():
        forms = set().union(*(variants(n.strip()) for n in (name, *others)))
        if variants(raw) & forms:
            direct.append(name)
            continue
        best = 0.0
        for form in forms:
            a, b = key(raw), key(form)
            if a == b:
                best = 1.0
            elif a in b or b in a:
                best = max(best, 0.94 if min(len(a), len(b)) >= 4 else 0.0)
            else:
                x, y = set(a.split("_")), set(b.split("_"))
                best = max(best, ratio(a, b), 0.92 * len(x & y) / min(len(x), len(y)))
        scores[name] = best
    if direct:
        own = [name for name in direct if name.lower() == raw.lower()]
        return direct[0] if len(direct) == 1 else own[0] if own else None
    ranked = sorted(scores.items(), key=lambda item: (-item[1], item[0]))
    if not ranked or ranked[0][1] < 0.9:
        return None
    return ranked[0][0] if ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else 0.0) >= 0.03 - 1e-9 else None


def test_endpoints_mean_what_comparing_with_all_gives(spark):
    words = ["tumor", "necrosis", "factor", "alpha", "beta", "kinase", "tbk1", "il6", "receptor", "gene"]
    entities, ends, expected = [], [], {}
    for chunk in range(40):
        own = {" ".join(RNG.sample(words, RNG.randrange(1, 4))): [RNG.choice(words)] if RNG.random() < 0.2 else [] for _ in range(6)}
        entities += [(chunk, name, name, names) for name, names in own.items()]
        for name in own:
            raw = RNG.choice([name, name.upper(), name.replace(" ", "_"), name[:-1], name + "s", name.replace("a", "aa", 1), name.split()[0], " ", "nobody", f" {name} "])
            ends.append((chunk, raw))
            if (answer := resolved(raw, own)) is not None:
                expected[chunk, raw] = answer
    found = alike.resolved_endpoints(spark.createDataFrame(ends, "chunk_id int, raw string"), spark.createDataFrame(entities, "chunk_id int, entity_id string, name string, all_names array<string>"))
    rows = {(row["chunk_id"], row["raw"]): row["entity_id"] for row in found.collect()}
    assert rows == expected and len(rows) > 100


def test_end_names_that_no_key_stands_for(spark):
    names = spark.createDataFrame([("interleukin_six", "e1"), ("interleukin_sixx", "e2"), ("necrosis_factor", "e3")], "key string, entity_id string")
    edges = spark.createDataFrame([("interleukin six", "necrosis factors"), ("interleukin sixes", None), ("other", " ")], "source string, target string")
    assert {tuple(row) for row in alike.fuzzy_ends(edges, names).collect()} == {("necrosis factors", "e3")}


def test_null_ratio(spark):
    rows = spark.createDataFrame([("", ""), (None, "a"), ("ab", "ac")], "a string, b string").select(fuzzy.match_ratio(F.col("a"), F.col("b")))
    assert [row[0] for row in rows.collect()] == [1.0, None, 0.5]


def test_keys_agree_as_names_do(spark):
    from loomgraph.functions.text import entity_key
    from loomgraph.operators import linking

    words = ["tumor", "necrosis", "factor", "tnf", "il6", "a", "tumors", "b2"]
    pairs = [(" ".join(RNG.sample(words, RNG.randrange(0, 4))), " ".join(RNG.sample(words, RNG.randrange(1, 4)))) for _ in range(300)]
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", entity_key(F.col("a")).alias("x"), entity_key(F.col("b")).alias("y"), linking.may_be_synonyms(F.col("a"), F.col("b")).alias("agree"))
    for row in frame.collect():
        assert linking.keys_agree(row["x"], row["y"]) == row["agree"], row


def test_texts_name_entities_also_misspelled(spark):
    from loomgraph.operators import audit

    texts = spark.createDataFrame([(1, "Interleukin sixx treats it"), (2, "superinterleukins"), (3, "TBK1 kinases"), (4, "")], "text_id int, text string")
    names = [("a", ["interleukin six"]), ("b", ["interleukin"]), ("c", ["TBK1 kinase", "NAK"]), ("d", ["treats itt"])]
    found = audit.text_entities(texts, spark.createDataFrame(names, "entity_id string, names array<string>"))
    scores = {(row["text_id"], row["entity_id"]): row["score"] for row in found.collect()}
    assert scores.keys() == {(1, "a"), (1, "b"), (1, "d"), (2, "b"), (3, "c")}
    assert 4 < scores[1, "a"] < 5 and scores[1, "b"] > 5 and 4 < scores[3, "c"] < 5 and abs(scores[1, "d"] - 3 - ratio("treats it", "treats itt")) < 1e-9
