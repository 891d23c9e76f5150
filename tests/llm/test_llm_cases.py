"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, language, lines, media, neardup, pack, periods, quality, substrings, tokens, toxicity
from loomgraph.llm.bitmap import hash_counters, repeated_hashes
from loomgraph.llm.graph import components
from loomgraph.llm.spans import Words, grams, window_minima

SCHEMA = "doc_id long, text string, n_words string, score string, kept string"
RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def words(n: int) -> str:
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


LONG = words(30_000)
BASE = words(120)
ODD = [(None, None), (1, ""), (2, " \t\n "), (3, LONG), (4, BASE), (5, BASE), (5, BASE), (None, BASE), (None, words(30)), (6, "one"), (7, "\x00\x1f é ß 🙂🙂 日本語 <|endoftext|>")]
BENCHMARK = "item_id long, text string"


def docs(spark, rows=ODD):
    return spark.createDataFrame([(key, text, "x", "y", "z") for key, text in rows], SCHEMA)


def run_all(spark, frame):
    items = spark.createDataFrame([(1, BASE), (2, "one"), (None, None)], BENCHMARK)
    yield "decontaminate", decontaminate.decontaminate(frame, items)
    yield "substrings", substrings.remove_substrings(frame)
    yield "lines", lines.remove_lines(frame)
    yield "tokens", tokens.count_tokens(frame)
    yield "neardup", neardup.near_duplicates(frame)
    yield "language", language.identify(frame, language.fit_languages(frame.withColumn("lang", F.lit("en")).select("lang", "text")))
    yield "quality", quality.score_quality(frame, None)
    yield "toxicity", toxicity.score_toxicity(frame, None)
    yield "periods", periods.periodic_runs(frame)


def test_every_operator_takes_odd_rows_and_clashing_names(spark):
    frame = docs(spark)
    for name, out in run_all(spark, frame):
        rows = out.collect()
        assert len(rows) == len(ODD), name
        assert len(set(map(str.lower, out.columns))) == len(out.columns), name
        by_row = {}
        for row in rows:  # equal rows have equal results
            key = (row["doc_id"], row["text"])
            assert by_row.setdefault(key, row) == row, name


def test_frequent_minimisers_change_no_result(spark, monkeypatch):
    from loomgraph.llm import runs

    shared = words(20)
    rows = [(k, " ".join([words(RNG.randrange(5, 30)), *shared.split()[k % 7 :], "w1 " * RNG.randrange(0, 40), words(10)])) for k in range(60)]
    frame = docs(spark, rows).repartition(8)
    found = []
    for frequent in (None, 1, 2):
        monkeypatch.setattr(runs, "FREQUENT", frequent)
        found.append(sorted(tuple(row) for row in substrings.remove_substrings(frame).select("doc_id", "n_removed", "kept_text").collect()))
    assert found[0] == found[1] == found[2] and sum(row[1] for row in found[0]) > 100


def test_frequent_hashes_are_found(spark):
    values = np.concatenate((np.arange(1, 2000, dtype=np.uint64) << np.uint64(40), np.full(3, 5, np.uint64) << np.uint64(50)))
    table = spark.range(0, 12, 1, 12)

    def hashes(batches):
        for batch in batches:
            for key in batch.column(0).to_pylist():
                yield values if key < 6 else values[-3:]

    found = repeated_hashes(table, hashes, 10_000, frequent=14)
    assert found.holds(values).all() and found.frequent.holds(values[-3:]).all() and found.frequent.holds(values[:-3]).mean() < 0.05


#: Names that operators use inside.
INSIDE = ["_text", "_n", "group_id", "_kid", "_th", "_null", "runs", "_id", "_hit", "_items", "_cls", "_own", "_n_words", "bucket", "blob", "w", "s", "v", "n", "cls", "nid", "at", "words", "label", "carried by the row"]


def test_every_operator_takes_any_other_column(spark):
    rows = [row for row in ODD if row[1] != LONG]
    frame = spark.createDataFrame([(*row, *INSIDE) for row in rows], "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in INSIDE))
    plain = dict(run_all(spark, frame.select("doc_id", "text")))
    for name, out in run_all(spark, frame):
        results = [c for c in plain[name].columns if c not in ("doc_id", "text")]
        kept = [c for c in INSIDE if c.lower() not in results]
        assert out.columns == ["doc_id", "text", *kept, *results], name
        found = out.collect()
        assert all(row[c] == c for row in found for c in kept), name
        got = sorted(repr(tuple(row[c] for c in plain[name].columns)) for row in found)
        assert got == sorted(repr(tuple(row)) for row in plain[name].collect()), name


def test_every_operator_takes_columns_of_other_names(spark):
    rows = [row for row in ODD if row[1] != LONG]
    frame = spark.createDataFrame([(*row, "x") for row in rows], "_id long, runs string, text string")
    items = spark.createDataFrame([(1, BASE), (2, "one"), (None, None)], "_hit long, _items string")
    for out in (
        decontaminate.decontaminate(frame, items, id_column="_id", text_column="runs", item_id_column="_hit", item_text_column="_items"),
        *(operator(frame, id_column="_id", text_column="runs") for operator in (substrings.remove_substrings, lines.remove_lines, neardup.near_duplicates)),
        quality.score_quality(frame, None, "runs"),
        toxicity.score_toxicity(frame, None, text_column="runs"),
        language.identify(frame, None, "runs"),
        tokens.count_tokens(frame, "runs"),
    ):
        assert out.columns[:3] == ["_id", "runs", "text"]
        assert sorted((row[0] is None, row[0] or 0, row[1] or "") for row in out.collect()) == sorted((key is None, key or 0, text or "") for key, text in rows)


def test_media_and_packing_take_odd_rows(spark):
    frame = docs(spark)
    stored = media.media_features(media.store_media(frame, f"/tmp/checkpoints/loomgraph/test-{random.random()}")).collect()
    expected = [media.to_payload(text)[1] for _, text in ODD]
    assert sorted(row["n_bytes"] for row in stored) == sorted(expected) and len({row["payload_sha256"] for row in stored}) == len({media.to_payload(text)[0] for _, text in ODD})
    packed = pack.pack_documents(frame).collect()
    assert sum(row["length"] for row in packed if row["doc_id"] in (1, 2, 6)) == sum(row["doc_tokens"] for row in packed if row["doc_id"] in (1, 2, 6) and row["start"] == 0)
    assert sum(row["start"] == 0 for row in packed) == len(ODD)


def test_every_operator_takes_an_empty_table(spark):
    for name, out in run_all(spark, docs(spark, [])):
        assert out.count() == 0, name
    assert pack.pack_documents(docs(spark, [])).count() == 0
    assert media.media_features(media.store_media(docs(spark, []), f"/tmp/checkpoints/loomgraph/test-{random.random()}")).count() == 0


@pytest.mark.parametrize("hot_key", [1, 32])
def test_near_duplicates_agree_with_all_pairs(spark, monkeypatch, hot_key):
    monkeypatch.setattr(neardup, "HOT_KEY", hot_key)
    monkeypatch.setattr(neardup, "PLACE", 2 if hot_key == 1 else neardup.PLACE)
    rows = []
    for g in range(12):
        base = [RNG.choice(VOCAB) for _ in range(RNG.choice([3, 5, 40, 150]))]
        for c in range(8):
            own = [RNG.choice(VOCAB) if RNG.random() < 0.008 * c else w for w in base]
            rows.append((g * 8 + c, " ".join(own).upper() if c == 3 else " ".join(own)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    sets = {}
    for key, text in rows:
        w = text.lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    group = {key: key for key in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[max(top(a), top(b))] = min(top(a), top(b))
    assert found == {key: (len(sets[key]), top(key)) for key in sets}


def test_signature_join_guarantees_pairs_under_its_distance():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 24, (1, neardup.VALUES), dtype=np.uint32)
    for _ in range(300):
        other = base.copy()
        at = rng.choice(neardup.VALUES, neardup.DISTANCE, replace=False)
        other[0, at] ^= 1
        one, two = neardup.signature_keys(base)[0], neardup.signature_keys(other)[0]
        assert (one == two).any()


def test_bounds_never_exclude_similar_sets(spark):
    for _ in range(50):
        a = np.unique(np.random.default_rng(RNG.randrange(1 << 30)).integers(0, 1 << 62, 300, dtype=np.uint64))
        b = np.concatenate((a[30:], a[:10] + np.uint64(1)))
        x, y = np.array(neardup.parity_sketch(a)), np.array(neardup.parity_sketch(np.unique(b)))
        differ = sum(int(v).bit_count() if v >= 0 else (int(v) + (1 << 64)).bit_count() for v in (x ^ y).tolist())
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_possible_pairs_are_those_of_the_whole_sketch(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
    rows = []
    for i in range(120):
        own = base.copy()
        k = rng.integers(0, 60)
        own[rng.choice(150, k, replace=False)] = rng.integers(0, 1 << 62, k, dtype=np.uint64)
        rows.append((i, 150, 150, neardup.parity_sketch(own)))
    able = spark.createDataFrame(rows, "nid long, n long, shared long, sketch array<long>")
    at = [(int(a), i, i // 2) for i in range(120) for a in rng.choice(50, 6, replace=False)]
    placed = spark.createDataFrame(at, "at long, nid long, root long")
    places = {i: {a for a, n, _ in at if n == i} for i in range(120)}
    sketch = {row[0]: np.array(row[3]).view(np.uint64) for row in rows}
    wanted = {(a, b) for a in sketch for b in sketch if a > b and a // 2 != b // 2 and places[a] & places[b] and 175 * int(np.bitwise_count(sketch[a] ^ sketch[b]).sum()) <= 25 * 300}
    for pairs in (neardup._pairs_of_few, neardup._pairs_of_many):
        assert {tuple(row) for row in pairs(placed, able).collect()} == wanted
    near = [tuple(row) for row in neardup._pairs_of_few(placed, able, nearest=True).collect()]
    assert set(near) <= wanted and len(near) <= len(at)
    for place in range(50):  # of the possible pairs of a place each class has its nearest to one that comes before it
        own = [n for n in places if place in places[n]]
        possible = {pair for pair in wanted if set(pair) <= set(own)}
        assert not possible or possible & set(near)


@pytest.mark.parametrize("task_links", [0, 1000])
def test_components_of_a_long_chain(spark, task_links):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (500, 400), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links, task_links=task_links).collect()}
    assert {found[i] for i in range(201)} == {0} and found[500] == found[400] == 400 and len(found) == 203
    assert components(links.limit(0), task_links=task_links).count() == 0


def test_rare_shingles_meet_in_similar_sets(spark):
    base = [RNG.choice(VOCAB) for _ in range(200)]
    rows = [(i, " ".join(RNG.choice(VOCAB) if RNG.random() < 0.01 * (i % 5) else w for w in base)) for i in range(60)]
    sets = {i: set(neardup.shingle_sets([text])[0].tolist()) for i, text in rows}
    rare = {}
    for row in neardup._rare_shingles(spark.createDataFrame(rows, "nid long, text string")).collect():
        rare.setdefault(row["nid"], set()).add(row["token"])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert rare[a] & rare[b]


def test_null_ids_never_take_words_from_others(spark):
    rows = {(r["doc_id"], r["text"]): r for r in substrings.remove_substrings(docs(spark)).collect()}
    assert rows[4, BASE]["n_removed"] == 0 and rows[5, BASE]["n_removed"] == 120 and rows[None, BASE]["n_removed"] == 120
    assert rows[None, ODD[8][1]]["n_removed"] == 0 and rows[3, LONG]["n_removed"] == 0


def test_substrings_within_one_document_stay(spark):
    text = words(20)
    rows = substrings.remove_substrings(docs(spark, [(1, f"{text} {text}"), (2, f"a {text[: text.rindex(' ')]} b")])).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in rows] == [0, 19] and rows[1]["kept_text"] == "a b"


def test_lines_of_repeated_runs(spark):
    run = "first line\n  second line\n\nthird line"
    rows = lines.remove_lines(docs(spark, [(2, f"own\n{run}\nlast"), (1, run), (3, "first line\nsecond line"), (4, "a\na\na\na\na")])).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in rows] == [run, "own\n\nlast", "first line\nsecond line", "a"]
    assert [r["n_removed_lines"] for r in rows] == [0, 3, 0, 4]


def test_lines_repeated_by_their_words(spark):
    long, a, b = words(60), words(6), words(6)
    rows = [(1, f"x\n{long}\ny"), (2, f"own\n {long}"), (3, f"{a}\n\n{b}\nz"), (4, f"u\n{a}\n{b}"), (5, f"{a}\nother"), (6, f"{long}\nshort end\nq"), (7, f"p\n{long}\nshort end"), (8, "")]
    found = lines.remove_lines(docs(spark, rows)).orderBy("doc_id").collect()
    assert [r["kept_text"] for r in found] == [rows[0][1], "own", rows[2][1], "u", rows[4][1], "short end\nq", "p", ""]
    alone = lines.remove_lines(docs(spark, [(1, f"{long}\n{long}\n{long}")])).collect()[0]
    assert (alone["kept_text"], alone["n_removed_lines"]) == (long, 2)


def test_short_items_and_borders(spark):
    items = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, words(9)), (3, "alpha"), (4, "...")], BENCHMARK)
    rows = decontaminate.decontaminate(docs(spark, [(1, "x ALPHA-beta gamma y"), (2, "alphabet"), (3, "Alpha")]), items).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in rows] == [(5, 3, 2), (1, 0, 0), (1, 1, 1)]


def test_repeated_hashes_are_all_held(spark):
    frame = spark.range(0, 2000, 1, 5).selectExpr("id % 1500 AS h")

    def hashes(batches):
        for batch in batches:
            yield (batch.column(0).to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    held = repeated_hashes(frame, hashes, 2000).holds((np.arange(1500, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    assert held[:500].all() and held[500:].mean() < 0.05


def test_counters_never_count_too_few(spark):
    frame = spark.range(0, 3000, 1, 5).selectExpr("CAST(sqrt(id) AS BIGINT) AS h")

    def hashes(batches):
        for batch in batches:
            yield (batch.column(0).to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    wanted = np.bincount(np.sqrt(np.arange(3000)).astype(int))
    found = hash_counters(frame, hashes, 3000).of((np.arange(len(wanted), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    assert (found >= wanted).all() and (found == wanted).mean() > 0.95


def test_word_arrays():
    found = Words([b"a bb\tccc", b"", b"\x0b bb a"])
    assert [found.buffer[s:e] for s, e in zip(found.starts, found.ends, strict=True)] == [b"a", b"bb", b"ccc", b"bb", b"a"]
    assert found.doc.tolist() == [0, 0, 0, 2, 2] and found.at.tolist() == [0, 1, 2, 0, 1]
    assert found.hash[1] == found.hash[3] and grams(found.hash, 9).size == 0
    values = np.random.default_rng(1).integers(0, 100, 50, dtype=np.uint64)
    for width in (1, 2, 3, 7, 10, 50, 60):
        assert window_minima(values, width).tolist() == [values[i : i + width].min() for i in range(len(values) - width + 1)]


@pytest.mark.parametrize("text", ["", "a", "a" * 3000, "ab " * 500, "  x \n\n y\t\t", "'s'll it's", "日本語 🙂", "<|endoftext|>a<|endoftext|>", "\x1c x \x85", "a  b", " lead", "tail ", "_x_ ² ½"])
def test_encoders_agree_with_the_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert tokens.TokenCounter(path).count([text, text]) == [len(ids)] * 2
    encoder = pack.PieceEncoder(path, entries=3)
    assert [np.frombuffer(own, "<u4").tolist() for own in encoder.encode(["x y", text, text])][1:] == [ids, ids]


def test_packing_fills_every_window():
    packer = pack.TierPacker((4, 8, 16), pool=20)
    sizes = [RNG.randrange(1, 60) for _ in range(300)]
    windows = [w for i, n in enumerate(sizes) for w in packer.add((i, n), bytes(4 * n))] + list(packer.finish())
    total = [sum(len(ids) // 4 for _, _, ids in pieces) for _, pieces in windows]
    assert total == [size for size, _ in windows] and sum(total) == sum(sizes) and all(n & (n - 1) == 0 for n in total)


def test_damaged_member_is_found_and_retried(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    media.store_media(docs(spark), path)
    reader = media.ArchiveReader(path, 4096, 1000, 3)
    parts = reader.partitions()
    read = media.read_member
    failures = {"left": 2}

    def flaky(file, offset):
        if failures["left"]:
            failures["left"] -= 1
            raise OSError("gone")
        return read(file, offset)

    monkeypatch.setattr(media, "read_member", flaky)
    keys = [key for part in parts for batch in reader.read(part) for key in batch.column(0).to_pylist()]
    assert len(keys) == len(ODD) and not failures["left"]
    victim = next((tmp_path / "archive").glob("*.lma"))
    data = bytearray(victim.read_bytes())
    data[media.HEADER.size + 3] ^= 255
    victim.write_bytes(bytes(data))
    monkeypatch.setattr(media, "read_member", read)
    with pytest.raises(ValueError):
        [list(reader.read(part)) for part in parts if part.name == victim.name]


def test_kneser_ney_sums_to_one():
    texts = ["the cat sat on the mat", "that hat is that"]
    codes, n = np.unique(language.text_grams(texts)[0], return_counts=True)
    alphabet = len(np.unique(codes & np.uint64(0xFFFF)))
    model = language.KneserNey(codes, n, alphabet)
    for context in np.unique(codes >> np.uint64(16))[:20]:
        every = (context << np.uint64(16)) | np.unique(codes & np.uint64(0xFFFF))
        assert abs(np.exp(model.log_prob(every)).sum() - 1) < 1e-9


def test_language_without_letters(spark):
    models = language.fit_languages(spark.createDataFrame([("en", "the quick brown fox " * 20), ("fr", "le renard brun rapide " * 20), (None, "x")], "lang string, text string"))
    rows = language.identify(spark.createDataFrame([(1, "the fox"), (2, "le renard"), (3, "12 !?"), (4, None)], "doc_id long, text string"), models).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["en", "fr", "und", "und"]


def test_every_language_and_4_gram_is_learned(spark):
    rows = [("hot", " ".join(RNG.choice(VOCAB) + RNG.choice("abcdefgh") * 2 for _ in range(3000))), ("rare", "zyx qvu jkz")] + [(f"l{i}", chr(0x4E00 + i) * 9) for i in range(210)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    texts = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    whole, small = language.fit_languages(frame), language.fit_languages(frame, max_ngrams=5)
    assert whole.languages == small.languages == sorted(name for name, _ in rows)
    found = [language.identify(texts, models).orderBy("doc_id").collect() for models in (whole, small)]
    assert found[0] == found[1] and [r["lang_pred"] for r in found[0]] == [name for name, _ in rows]


def test_language_limits_come_from_all_texts(spark):
    own = random.Random(11)
    rows = [("many", " ".join(own.choices(["alpha", "beta", "gamma", "delta", "xylo" + "qwz"[i % 3] * (i % 9)], k=20 + i % 50))) for i in range(3000)]
    rows += [("few", " ".join(own.choices(["uno", "dos", "tres", "cuatro", "cinco"], k=30))) for _ in range(5)] + [("few", "uno dos"), ("two", "ichi ni san " * 9), ("two", "shi go roku " * 9)]
    frame = spark.createDataFrame([*rows, *rows[:40], *rows[3000:3002] * 20, (None, "x" * 50), ("many", None)], "lang string, text string")
    models, other = language.fit_languages(frame), language.fit_languages(frame.repartition(3, "text"), max_ngrams=20)
    for k, name in enumerate(models.languages):
        entropy, counts = models.entropies(sorted({text for lang, text in rows if lang == name}))
        each = entropy[counts >= 40, k]
        assert models.limit[k] == (np.inf if name == "two" else pytest.approx(each.mean() + 6 * max(each.std(), 0.02), abs=1e-5))
    assert models.limit.tolist() == other.limit.tolist()
    found = language.identify(spark.createDataFrame([("uno dos tres cuatro " * 5,), ("unodos cuacincotreuat trosunco nidoscitre " * 5,)], "text string"), models).collect()
    assert [(r["lang_pred"], r["accepted"]) for r in found] == [("few", True), ("few", False)]


def test_quality_votes_by_neighbours():
    good = [words(60) for _ in range(60)]
    bad = [" | ".join(RNG.choice(VOCAB).upper() + "!!" for _ in range(60)) for _ in range(20)]
    model = quality.NeighbourVote(quality.text_counts(good + bad), np.array([1] * 60 + [0] * 20))
    scores = model.score([words(50), " | ".join(w.upper() + "!!" for w in VOCAB[:40]), ""])
    assert scores[0] > 0.9 and scores[1] < 0.1 and 0 <= scores[2] <= 1


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_through_fitted_models(spark):
    frame = docs(spark)
    labels = labelled(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, 0), (None, 1, 1), (6, None, None), (7, 0, 0), (99, 1, 1)])
    chain = toxicity.fit_toxicity(frame, labels)
    model = quality.fit_quality(quality.labelled_sample(frame, labels, "quality", F.lit(True)))
    for out in (toxicity.score_toxicity(frame, chain), quality.score_quality(frame, model)):
        rows = out.collect()
        by_text = {}
        assert len(rows) == len(ODD) and all(by_text.setdefault(row["text"] or "", row[-2:]) == row[-2:] for row in rows)
    for rows in ([], [(1, 1, 0), (3, 1, 0)]):
        assert toxicity.fit_toxicity(frame, labelled(spark, rows)) is None
    assert quality.fit_quality(quality.labelled_sample(frame, labelled(spark, []), "quality", F.lit(True))) is None
    one = quality.fit_quality(quality.labelled_sample(frame, labelled(spark, [(1, 1, 0), (4, 1, 0)]), "quality", F.lit(True)))
    assert {row["score"] for row in quality.score_quality(frame, one).collect()} == {1.0}


def test_samples_are_bounded_whatever_repeats(spark):
    frame = docs(spark, [(i % 2, f"text {i}") for i in range(500)])
    sample = quality.labelled_sample(frame, labelled(spark, [(0, 1, 0), (1, 0, 1), (1, 1, 0)]), "quality", F.lit(True), fit_rows=2).collect()
    assert sorted((row["doc_id"], row["label"]) for row in sample) == [(0, 1), (1, 1)]


def test_quality_is_the_vote_of_all_cosines():
    texts = [words(RNG.randrange(5, 60)) + ("!" * (i % 3)) for i in range(80)]
    model = quality.NeighbourVote(quality.text_counts(texts[:60]), np.array([i % 2 for i in range(60)]))
    for text, score in zip(texts, model.score(texts), strict=True):
        vector = quality.NeighbourVote._unit(model._weighted(quality.text_counts([text])) @ model.directions)[0]
        cosine = [round(float(sum(a * b for a, b in zip(vector.astype(float), row.astype(float)))), 5) for row in model.vectors]
        near = sorted(range(60), key=lambda i: (-cosine[i], i))[: quality.NEIGHBOURS]
        weight = {i: max(cosine[i], 0) ** quality.SHARPNESS for i in near}
        assert abs(score - sum(weight[i] * (i % 2) for i in near) / sum(weight.values())) < 2e-2
    near, values = quality.nearest(np.array([[1, 3, 3, 3, 2.0]]), 2)
    assert near.tolist() == [[1, 2]] and values.tolist() == [[3, 3]]


def test_language_models_are_kneser_ney():
    texts = ["the cat sat on the mat", "that hat is that", "a cat"]
    codes, n = np.unique(language.text_grams(texts)[0], return_counts=True)
    counts = dict(zip(codes.tolist(), n.tolist(), strict=True))
    alphabet = len({code & 0xFFFF for code in counts}) + 1
    model = language.KneserNey(codes, n, alphabet)

    def levels():
        level = counts
        for size in range(4, 1, -1):
            ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
            yield size, level, (ones / (ones + 2 * twos) if ones else 0.5)
            level = {short: sum(code & ((1 << 16 * (size - 1)) - 1) == short for code in level) for short in {code & ((1 << 16 * (size - 1)) - 1) for code in level}}
        yield 1, level, 0

    table = {size: (level, cut) for size, level, cut in levels()}

    def prob(code, size):
        level, cut = table[size]
        if size == 1:
            return 0.999 * level.get(code & 0xFFFF, 0) / sum(level.values()) + 0.001 / alphabet
        gram = code & ((1 << 16 * size) - 1)
        same = {g: v for g, v in level.items() if g >> 16 == gram >> 16}
        if not same:
            return prob(code, size - 1)
        return (max(same.get(gram, 0) - cut, 0) + cut * len(same) * prob(code, size - 1)) / sum(same.values())

    wanted = np.unique(language.text_grams([*texts, "the other cat hid"])[0])
    assert np.allclose(model.log_prob(wanted), [np.log(prob(code, 4)) for code in wanted.tolist()])


def test_toxicity_chain_predicts_unseen_rows_out_of_fold():
    def made(n, seed):
        rng = random.Random(seed)
        texts, labels = [], []
        for i in range(n):
            labels.append(int(i % 4 == 0))
            texts.append(" ".join([*(rng.choice(VOCAB) for _ in range(30)), *(["vile"] if i % 4 == 0 else [])]))
        return texts, np.array(labels)

    texts, labels = made(240, 1)
    chain = toxicity.ToxicityChain([toxicity.text_features(t) for t in texts], labels)
    more, truth = made(100, 2)
    assert np.mean((chain.probabilities(more)[:, -1] >= 0.5) == truth) >= 0.97
    assert np.mean((chain.unseen[:, -1] >= 0.5) == labels) >= 0.97
    noise = np.array([random.Random(i).randrange(2) for i in range(240)])  # labels that texts say nothing of can't be told unseen
    blind = toxicity.ToxicityChain([toxicity.text_features(" ".join(t.split()[:30])) for t in texts], noise)
    assert abs(np.mean((blind.unseen[:, -1] >= 0.5) == noise) - 0.5) < 0.12


def plain_chain(texts, labels, asked):
    """The chain worked out word by word with whole matrices: features, categories, folds and models."""
    import math
    import re

    def features(text):
        return {f for word in set(re.findall(r"[^\W\d_]+", text.lower())) for f in toxicity.word_features(word)}

    rows = [features(text) for text in texts]

    def view(seen):
        own = [(rows[i], labels[i]) for i in seen]
        n1, n0 = sum(y for _, y in own), sum(1 - y for _, y in own)
        told = {}
        for f in {f for row, _ in own for f in row}:
            one, zero = sum(f in row for row, y in own if y), sum(f in row for row, y in own if not y)
            a, b, c = (one + 0.5) / (n1 + 1), (zero + 0.5) / (n0 + 1), (one + zero + 0.5) / (n0 + n1 + 1)
            evidence = 2 * (one * math.log(a / c) + zero * math.log(b / c))
            if one + zero >= toxicity.LEAST_TEXTS and evidence >= toxicity.LEAST_EVIDENCE and a > b:
                told[f] = (evidence, math.log(a / b) >= toxicity.TYPICAL and f & 3 == 0)
        kept = sorted(sorted(told, key=lambda f: (-told[f][0], f))[: toxicity.MAX_FEATURES])
        found = [sum(told[f][1] for f in kept if f in row) for row in rows]
        several = np.median([found[i] for i in seen if labels[i]]) if n1 else 0
        targets = [[y * (k > 0) for y, k in zip(labels, found, strict=True)], [y * (k >= max(1, several)) for y, k in zip(labels, found, strict=True)], labels]
        return kept, np.array(targets, float)

    def matrix(kept, given):
        return np.array([[float(f in row) for f in kept] for row in given]).reshape(len(given), len(kept))

    def fit(x, width, y):
        n, share = len(y), np.mean(y)
        weight = np.array([0.5 / max(share, 1e-9) if v else 0.5 / max(1 - share, 1e-9) for v in y]) / n
        rate = 4.0 / max(1.0, min(x[:, :width].sum(axis=1).max(initial=0) + x.shape[1] - width + 1, 64))
        x = np.column_stack((x, np.ones(n)))
        here = ahead = np.zeros(x.shape[1])
        for step in range(250):
            slope = x.T @ (weight * (1 / (1 + np.exp(-x @ ahead)) - y))
            slope[:-1] += toxicity.PENALTY / math.sqrt(n) * ahead[:-1]
            after = ahead - rate * slope
            ahead, here = after + step / (step + 3) * (after - here), after
        return here

    said = lambda model, x: 1 / (1 + np.exp(-np.column_stack((x, np.ones(len(x)))) @ model))
    everyone = list(range(len(texts)))
    kept, targets = view(everyone)
    folds = [view([i for i in everyone if i % toxicity.FOLDS != fold]) for fold in range(toxicity.FOLDS)]
    before, out = np.zeros((len(texts), 0)), np.zeros((len(asked), 0))
    new = [features(text) for text in asked]
    for category in range(len(toxicity.CATEGORIES)):
        unseen = np.zeros(len(texts))
        for fold, (own, aims) in enumerate(folds):
            inside = [i for i in everyone if i % toxicity.FOLDS != fold]
            x = np.column_stack((matrix(own, rows), before))
            model = fit(x[inside], len(own), aims[category][inside])
            outside = [i for i in everyone if i % toxicity.FOLDS == fold]
            unseen[outside] = said(model, x[outside])
        model = fit(np.column_stack((matrix(kept, rows), before)), len(kept), targets[category])
        out = np.column_stack((out, said(model, np.column_stack((matrix(kept, new), out)))))
        before = np.column_stack((before, unseen))
    return out


def test_toxicity_chain_is_what_plain_matrices_give():
    rng = random.Random(21)
    vocab = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts, labels = [], []
    for i in range(72):
        label = int(rng.random() < 0.4)
        bad = rng.sample(["scum", "vermin", "filthy"], rng.randrange(1, 4)) if label else (["filthy"] if rng.random() < 0.1 else [])
        texts.append(" ".join([*rng.sample(vocab, 12), *bad]))
        labels.append(label)
    asked = [*texts[:10], "scum vermin", "", "wordaa filthy", "Vermins! scummy 12"]
    chain = toxicity.ToxicityChain([toxicity.text_features(text) for text in texts], np.array(labels))
    found, expected = chain.probabilities(asked), plain_chain(texts, labels, asked)
    assert np.allclose(found, expected, atol=1e-9) and found[10, -1] > 0.5 > found[11, -1]


def test_toxicity_chain_learns_marker_words():
    markers = ["vile", "rotten"]
    texts = [words(40) + (f" {RNG.choice(markers)} {words(5)}" if i % 4 == 0 else "") for i in range(200)]
    chain = toxicity.ToxicityChain([toxicity.text_features(t) for t in texts], np.array([int(i % 4 == 0) for i in range(200)]))
    p = chain.probabilities([f"{words(30)} vile", words(30), ""])
    assert p[0, -1] > 0.5 > p[1, -1] and p[2, -1] < 0.5 and p.shape == (3, 3)
