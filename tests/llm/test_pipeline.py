"""The corpus pipeline end to end, each stage against brute force on its own input."""

import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(500)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def words(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def made():
    """Clean, toxic, copied, nearly copied and contaminated documents, and odd ones; labels; benchmark."""
    rows = [(i, f"{words(40)}\n{words(30)}\n{words(25)}") for i in range(80)]
    rows += [(100 + i, f"{words(40)} vile {words(10)}") for i in range(40)]
    shared = words(12)
    rows += [(200 + i, f"{words(30)}\n{shared}\n{words(20)}") for i in range(6)]
    base = words(80).split()
    rows += [(300 + i, " ".join(base[:40] + [f"n{i}"] + base[41:])) for i in range(8)] + [(310, rows[0][1])]
    item = words(15)
    rows += [(400, f"{words(20)} {item} {words(9)}"), (401, f"{words(20)} {' '.join(item.split()[:9])} {words(9)}")]
    rows += [(500, None), (501, ""), (502, " \n\n "), (503, " ".join(f"z{i}" for i in range(4000))), (504, "one"), (504, "one")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(30)] + [(None, 1, 1), (503, None, None)]
    return rows, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows before, rows after) of each stage; rows are (doc_id, text)."""
    sf_dir = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = made()
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x") for k, t in rows], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    before = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or docs.columns == corpus_pipeline.COLUMNS
        after = [tuple(r) for r in docs.collect()] if last else [(r["doc_id"], r["text"]) for r in docs.collect()]
        found[name] = (before, after, docs.columns)
        before = after
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == docs.columns and whole.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
    return found


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = made()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    return sf_dir, spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows if k is not None and k < 10 or k in (500, 501, 504)], SCHEMA.rsplit(",", 1)[0])


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_any_other_column(spark, tables, name):
    sf_dir, docs = tables
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = stage(spark, docs, sf_dir)
    more = docs
    for other in ("_text", "runs", "_cls", "_n_words", "score", "kept_text", "carried by the row"):
        more = more.withColumn(other, docs["lang"])
    found = stage(spark, more, sf_dir)
    assert found.columns == plain.columns
    if name != "packing":  # sequences follow partitions
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def key(row):
    return (row[0], row[1] or "")


def test_toxic_documents_go(stages):
    before, after, _ = stages["toxicity"]
    assert sorted(after, key=key) == sorted((r for r in before if " vile " not in (r[1] or "")), key=key)


def brute_lines(rows):
    def spans(lines):
        out = {(i, i + 2) for i in range(len(lines) - 2)}
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                n = sum(len(x.split()) for x in lines[i : j + 1])
                if n >= 10 and (n - len(lines[j].split()) < 10 or n - len(lines[i].split()) < 10):
                    out.add((i, j))
        return out

    own = [(k, t, [x for x in (t or "").split("\n") if x.strip()]) for k, t in rows]
    first = {}
    for k, _, lines in own:
        stripped = [x.strip() for x in lines]
        for i, j in spans(stripped):
            run = tuple(stripped[i : j + 1])
            first[run] = min(first.get(run, (k, i)), (k, i))
    out = []
    for k, t, lines in own:
        stripped = [x.strip() for x in lines]
        gone = {x for i, j in spans(stripped) if first[tuple(stripped[i : j + 1])] < (k, i) for x in range(i, j + 1)}
        if t is None or not gone:
            out.append((k, t))
            continue
        at, left = -1, []
        for line in t.split("\n"):
            at += bool(line.strip())
            if not line.strip() or at not in gone:
                left.append(line)
        out.append((k, "\n".join(left)))
    return out


def test_repeated_lines_go(stages):
    before, after, _ = stages["line_removal"]
    assert sorted(after, key=key) == sorted(brute_lines(before), key=key)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_duplicates"]
    sets = {}
    for k, t in before:
        w = re.findall(r"[^ \t-\r]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(after, key=key) == sorted((r for r in before if top(r[0]) == r[0]), key=key)
    assert len(after) < len(before)


def test_contaminated_documents_go(stages):
    before, after, _ = stages["decontamination"]
    item = next(t for k, t in before if k == 400).split()[20:35]
    windows = {tuple(item[i : i + 10]) for i in range(6)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [(t or "").split()] for i in range(len(w) - 9))
    assert sorted(after, key=key) == sorted((r for r in before if not hit(r[1])), key=key)
    assert {400} == {r[0] for r in before} - {r[0] for r in after}


def test_each_id_is_packed_once(stages):
    before, after, columns = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [dict(zip(columns, row, strict=True)) for row in after]
    wanted, covered = defaultdict(int), defaultdict(int)
    for k, t in before:
        wanted[k] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    for row in rows:
        covered[row["doc_id"]] += row["length"]
    assert covered == wanted
    sizes = defaultdict(int)
    for row in rows:
        sizes[row["sequence_id"]] += row["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes.values())
