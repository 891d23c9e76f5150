"""Covering anchors: questions are dealt to as many partitions as states ask for, and greedy choice by hand agrees."""

import random

from loomgraph.operators import evidence


def by_hand(states, most):
    out = set()
    for question in {q for q, _, _ in states}:
        left = {(s, a) for q, s, seeds in states if q == question for a in seeds or [] if a and a.strip()}
        for turn in range(1, most + 1):
            if not left:
                break
            anchor = min({a for _, a in left}, key=lambda a: (-sum(x == a for _, x in left), a))
            held = {s for s, a in left if a == anchor}
            out.add((question, turn, anchor, len(held)))
            left = {(s, a) for s, a in left if s not in held}
    return out


def test_partitions_follow_states(spark, monkeypatch):
    draw = random.Random(3)
    states = [(draw.randrange(9), draw.randrange(5), [draw.choice(["a", "b", "c", "d", " ", None]) for _ in range(3)]) for _ in range(80)] + [(99, 1, None), (98, 1, [" "])]
    monkeypatch.setattr(evidence, "STATES_EACH", 10)
    rows = spark.createDataFrame(states, "question_id long, sample_id long, seeds array<string>")
    found = evidence.covering_anchors(rows, 3)
    assert found.rdd.getNumPartitions() == 9
    assert {tuple(r) for r in found.collect()} == by_hand(states, 3)
    assert {tuple(r) for r in evidence.dominant_anchors(rows).collect()} == {(q, a, n) for q, t, a, n in by_hand(states, 1)}
