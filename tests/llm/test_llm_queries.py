"""The training-data queries against their SQL or against brute force, on the smallest tables."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from oracle import DATA, oracle_rows, spark_rows
from tokenizers import Tokenizer

from loomgraph.llm import media, registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def documents(spark):
    return {row["doc_id"]: row for row in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {key: library.encode(row["text"] or "", add_special_tokens=False).ids for key, row in documents.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == oracle_rows(ORACLES[name])


def test_media_reads_back_every_byte(spark, documents):
    rows = {row["doc_id"]: row for row in QUERIES["op1_media_columns"](spark, DATA).collect()}
    assert rows.keys() == documents.keys()
    for key, document in documents.items():
        payload, n_bytes = media.to_payload(document["text"])
        row = rows[key]
        assert (row["n_bytes"], row["payload_bytes"]) == (n_bytes, len(payload)) and len(payload) % 576 == 0
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-32:])
        assert row["media_sha256"] == hashlib.sha256(media.encode_png(payload)).hexdigest()


def test_token_counts_are_the_library_s(spark, documents, ids):
    for row in QUERIES["op4_count_tokens"](spark, DATA).collect():
        n = len(ids[row["doc_id"]])
        assert (row["n_tokens"], row["over_limit"]) == (n, n > 512) and row["n_bytes"] == len((documents[row["doc_id"]]["text"] or "").encode())


def test_packing_holds_each_id_once(spark, ids):
    rows = QUERIES["op5_pack_documents"](spark, DATA).collect()
    whole = {key: np.array([*own, 0], "<u4") for key, own in ids.items()}
    seen = {key: np.zeros(len(own), int) for key, own in whole.items()}
    sequences = {}
    for row in rows:
        own, a, n = whole[row["doc_id"]], row["start"], row["length"]
        assert row["doc_tokens"] == len(own) and row["ids_crc32"] == zlib.crc32(own[a : a + n].tobytes())
        seen[row["doc_id"]][a : a + n] += 1
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], n))
    assert all((times == 1).all() for times in seen.values())
    sizes = []
    for pieces in sequences.values():
        pieces.sort()
        assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        sizes.append(sum(n for _, n in pieces))
    assert max(sizes) <= 1024 and all(size & (size - 1) == 0 for size in sizes)  # no padding at all


def test_language_of_held_out_documents(spark, documents):
    rows = QUERIES["op2_identify_language"](spark, DATA).collect()
    assert len(rows) == len(documents)
    held = [row for row in rows if zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2]
    assert {row["doc_id"] for row in held} == {row["doc_id"] for row in rows if row["held_out"]}
    right = [row["lang_pred"] == documents[row["doc_id"]]["lang"] for row in held]
    assert np.mean(right) >= 0.95 and all(0 <= row["score"] <= 1 for row in rows)


def test_quality_scores(spark, documents):
    rows = QUERIES["op6_score_quality"](spark, DATA).collect()
    assert len(rows) == len(documents)
    for row in rows:
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)


def test_toxicity_finds_what_it_learned(spark):
    labels = {row["doc_id"]: row["toxic"] for row in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [row for row in QUERIES["op9_score_toxicity"](spark, DATA).collect() if row["doc_id"] in labels]
    clean = [row["toxic_pred"] for row in rows if labels[row["doc_id"]] == 0]
    mean = {label: np.mean([row["p_toxic"] for row in rows if labels[row["doc_id"]] == label]) for label in (0, 1)}
    assert mean[1] > 2 * mean[0] and any(row["toxic_pred"] for row in rows if labels[row["doc_id"]] == 1)
    assert np.mean(clean) <= 0.05 and all(0 <= row[f"p_{name}"] <= 1 for row in rows for name in ("marked", "dense", "toxic"))


def test_pipeline_works_on_what_its_stages_keep(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = set(documents)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        left = {row["doc_id"] for row in docs.select("doc_id").collect()}
        assert left <= kept and (k == len(corpus_pipeline.STAGES) - 1 or docs.columns == corpus_pipeline.COLUMNS)
        kept = left
    assert len(kept) > len(documents) // 2
