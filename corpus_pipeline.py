"""The corpus pipeline: toxicity, line removal, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``, whatever further
columns they are given; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, materialize, read_table
from loomgraph.llm.decontaminate import decontaminate
from loomgraph.llm.lines import remove_lines
from loomgraph.llm.neardup import near_duplicates
from loomgraph.llm.pack import pack_documents
from loomgraph.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go; the chain learns from the labels of those given.

    Null texts count as empty and stay, as all do where nothing was learned;
    repeated rows go or stay together.
    """
    chain = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, chain).filter(~F.col("toxic_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of lines go; n_chars follows the text. No document goes, though one may end up empty.

    Null texts stay null. Rows of one id leave each other alone; rows without
    an id come after all others.
    """
    kept = remove_lines(docs)
    text = F.col("kept_text").alias("text")
    length = F.when(F.col("n_removed_lines") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", text, "lang", "source", length.alias("n_chars")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id.

    Texts that are null or have no words are no one's duplicates and stay;
    repeated rows of the id that stays all do.
    """
    return near_duplicates(docs).filter("kept").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts hold none, and an empty benchmark nothing; repeated rows go or stay together.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences with their ids; a null text is one id long, and each repeated row is packed."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_removal", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Toxicity is a trained model, so no SQL gives these rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a later stage has replaced is removed."""
    docs = read_table(spark, sf_dir, "documents")
    before = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            discard(*before)
            before = [docs]
    return docs
