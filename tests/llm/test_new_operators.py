"""Periodic runs, hard negatives and URL filters against brute force and on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import negatives, periods, urls

RNG = random.Random(11)


def slow_runs(words, least=24, repeats=3):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > a and i - a + q >= max(least, repeats * q):
                found.setdefault((a, i - a + q), q)
            i += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def some_words(letters, n):
    words = [RNG.randrange(letters) for _ in range(n)]
    if n and RNG.random() < 0.7:
        a, p = RNG.randrange(n), RNG.randrange(1, 9)
        words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return words


def test_lyndon_array_is_that_of_sorted_suffixes():
    for _ in range(400):
        w = some_words(RNG.choice([1, 2, 3]), RNG.randrange(1, 40))
        after, agree = periods.lyndon_array(w)
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
            assert after[i] == j
            if j < len(w):
                assert agree[i] == next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)


@pytest.mark.parametrize("least", [3, 9, 24])
def test_runs_are_those_of_brute_force(least):
    for _ in range(500):
        w = some_words(RNG.choice([1, 2, 3, 6]), RNG.randrange(0, 70))
        expected = slow_runs(w, least)
        assert sorted(periods.sweep(w, least)) == expected
        assert sorted(periods.text_runs([[b"other"], [str(v).encode() for v in w]], least)[1]) == expected


def test_comparisons_are_linear_in_the_words():
    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = "a", "b"
    while len(a) < 4000:
        a, b = a + b, a
    for w in ([1] * 4000, [ord(c) for c in a], [i % 7 for i in range(4000)], [RNG.randrange(2) for _ in range(4000)], ([1] * 50 + [2]) * 80):
        for order in (w, [-v for v in w]):
            Counted.seen = 0
            periods.lyndon_array([Counted(v) for v in order])
            assert Counted.seen <= 4 * len(w)


def test_periodic_runs_of_odd_rows(spark):
    loop = " ".join(["a b c"] * 12)
    long = " ".join(str(i % 977) for i in range(30_000))
    rows = [(None, None), (1, ""), (2, " \t\n "), (3, f"x {loop}  y"), (3, f"x {loop}  y"), (None, loop), (4, long), (5, "é 日本 " * 20), (6, "one"), (7, "a " * 23), (8, "a\x0b" * 24)]
    frame = spark.createDataFrame([(key, text, "x", "y", "z") for key, text in rows], "doc_id long, text string, runs string, carried string, `START` string")
    out = periods.periodic_runs(frame)
    assert out.columns == ["doc_id", "text", "carried", *periods.OUTPUT]
    found = out.collect()
    assert len(found) == len(rows)
    for row in found:
        words = (row["text"] or "").encode().split()
        expected = slow_runs(words) if len(words) < 1000 else [(0, 30_000, 977)]
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == expected and row["n_runs"] == len(expected)
        gone = {i for a, n, q in expected for i in range(a + q, a + n)}
        assert row["collapsed_text"].encode().split() == [w for i, w in enumerate(words) if i not in gone]
        if expected:
            best = max(expected, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            assert (row["start"], row["length"], row["period"]) == best and row["exponent_milli"] == 1000 * best[1] // best[2]
        else:
            assert row["start"] is row["length"] is row["period"] is row["exponent_milli"] is None
    texts = spark.createDataFrame([("k", loop)], "name string, body string")
    assert periods.periodic_runs(texts, "name", "body").select("name", "n_runs").collect()[0] == ("k", 1)
    assert periods.periodic_runs(frame.filter("false")).count() == 0


def mined(rows, positives=5, most=10):
    known = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [max(-negatives.MOST, min(negatives.MOST, math.floor(256 * x))) for x in vector])
        known[key] = min(known.get(key, own), own)
    out = set()
    clip = lambda v: max(-(2**63 - 1), min(2**63 - 1, v))
    for key, (label, v) in known.items():
        if key % 3:
            continue
        scores = {other: clip(sum(a * b for a, b in zip(v, w, strict=False))) for other, (_, w) in known.items() if other != key}
        order = sorted(scores, key=lambda other: (-scores[other], other))
        for p in [o for o in order if known[o][0] == label][:positives]:
            fits = [o for o in order if known[o][0] != label and 30 * scores[p] <= 100 * scores[o] <= 90 * scores[p]]
            out |= {(key, p, rank + 1, o, scores[p], scores[o]) for rank, o in enumerate(fits[:most])}
    return out


VECTORS = "vec_id long, embedding array<double>, label long, id string, score string, place string"


@pytest.mark.parametrize("blocks", [(16, 16), (64, 1024)])
def test_hard_negatives_are_those_of_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (4, 12))
    rows = [(k, (centres[k % 4] + rng.normal(0, 0.25, 12)).round(3).tolist(), 3 if k % 3 == 1 else k % 4) for k in range(400)]
    rows += [(400 + k, rows[0][1], k % 4) for k in range(60)]  # one vector that many rows have
    odd = [(500, None, 1), (501, [0.1] * 12, None), (None, [0.1] * 12, 1), (502, [math.nan] + [0.1] * 11, 1), (503, [math.inf] * 12, 2), (504, [None, 0.2], 2), (505, [], 1), (507, [0.3], 0), (510, [0.2] * 12, 1), (510, [0.2] * 12, 1), (510, [0.9] * 12, 0)]
    frame = spark.createDataFrame([(*row, "x", "y", "z") for row in rows + odd], VECTORS)
    found = negatives.hard_negatives(frame, F.col("id") % 3 == 0, row_block=blocks[0], anchor_block=blocks[1]).collect()
    expected = mined(rows + odd)
    assert len(found) == len(expected) > 1000 and {tuple(row) for row in found} == expected


def test_hard_negatives_of_huge_and_of_no_components(spark):
    huge = [(3, [1e300, -1e300], 0), (1, [1e300, 1.0], 0), (2, [3e15, -1e15], 1), (4, [4e14, 0.0], 1), (5, [1e15, 1e15], 1), (6, [0.0, 0.0], 2), (7, [0.0, 0.0], 2), (8, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*row, "x", "y", "z") for row in huge], VECTORS)
    assert {tuple(row) for row in negatives.hard_negatives(frame, F.col("id") % 3 == 0).collect()} == mined(huge)
    for none in (frame.filter("false"), frame.withColumn("embedding", F.array().cast("array<double>"))):
        found = {tuple(row) for row in negatives.hard_negatives(none, F.col("id") % 3 == 0).collect()}
        assert found == (mined([(key, [], label) for key, _, label in huge]) if none.count() else set())


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(8)
    for d in (1, 3, 40):
        x, y = (rng.integers(-300, 300, (n, d)) * (rng.random(d) ** 3 * 8).astype(np.int64) for n in (70, 30))
        axes = negatives.principal_axes((x.T @ x).astype(float))
        least = np.quantile(x @ y.T, 0.98, axis=0)
        i, j = negatives.survivors(negatives.Rotated(x, axes), slice(0, 70), negatives.Rotated(y, axes), least, np.ones((70, 30), bool))
        kept = np.zeros((70, 30), bool)
        kept[i, j] = True
        assert kept[x @ y.T >= least].all()
        assert (negatives.exact_products(x[i], y[j]) == (x @ y.T)[i, j]).all()


def slow_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(h.count("."), len(p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


@pytest.mark.parametrize("ranges", [1, 7])
def test_url_verdicts_are_those_of_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(urls, "BOUNDARY", 9 if ranges == 7 else 1024)
    hosts = [".".join(RNG.choice("ab") * RNG.choice([1, 1, 2]) for _ in range(RNG.randrange(1, 5))) for _ in range(40)]
    paths = ["", "/", *("/" + "/".join(RNG.choice(["x", "y", "xy"]) for _ in range(RNG.randrange(1, 4))) for _ in range(25))]
    rules = [(RNG.choice(hosts), RNG.choice(paths), RNG.choice(["allow", "block"])) for _ in range(120)]
    found = [None, "", "no scheme", "http://", "://", "http://a?q=://b", "HTTP://A.B/x#y", "http://a.\n/x\ny", "http://é.a/日", "http://a/" + "x/" * 20_000, "http://" + "a." * 3000 + "b/x", "x://a..b/x"]
    found += [f"https://{RNG.choice(hosts)}{RNG.choice(paths)}{RNG.choice(['', '?q', '#f', 'z'])}" for _ in range(500)] + ["https://a.b/x/y"] * 50
    frame = spark.createDataFrame([(k, url, "p", "q", "r") for k, url in enumerate(found)], "page_id long, url string, host string, page0 string, `depth` string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block"), ("b", "x", "block")], urls.RULES)
    out = urls.filter_urls(frame, table, ranges=ranges)
    assert out.columns == ["page_id", "url", "page0", "depth", *urls.OUTPUT]
    rows = out.collect()
    strictest = {}
    for h, p, v in rules:
        strictest[h, p] = max(v, strictest.get((h, p), v))
    rules = [(h, p, v) for (h, p), v in strictest.items()]
    assert {row["page_id"]: tuple(row[c] for c in urls.OUTPUT) for row in rows} == {k: slow_verdict(url, rules) for k, url in enumerate(found)} and len(rows) == len(found)


def test_url_filter_without_rules_or_pages(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], urls.RULES)
    assert [tuple(row) for row in urls.filter_urls(frame, none, default="block").collect()] == [(1, "http://a.b/c", "a.b", "/c", None, "block")]
    assert urls.filter_urls(frame.filter("false"), spark.createDataFrame(urls.PAGE_RULES, urls.RULES)).count() == 0
