"""Graph tables on disk, partitioned by graph: written idempotently, read whole, sampled or cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import entity_key
from loomgraph.operators.graph import degrees


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write both tables by kg_name; what a graph had before is replaced, other graphs stay.

    A node is kept once: the one that sorts first of all its columns. An edge is
    its ends, type, polarity, condition and quantity, as far as there are such
    columns: edges of one identity are one, with the greatest confidence and
    the arrays' values of all, each once and sorted; of other columns the least
    value stays.
    """
    rest = _one_of(nodes, ["kg_name", "entity_id"])
    nodes = nodes.groupBy("kg_name", "entity_id").agg(*rest) if rest else nodes.distinct()
    keys = [name for name in ("kg_name", "src", "dst", "rel_type", "negated", "condition", "quantitative") if name in edges.columns]
    edges = edges.groupBy(*keys).agg(*[_merged(edges, name) for name in edges.columns if name not in keys], F.count(F.lit(1)).alias("copies"))
    for table, name in ((nodes, "nodes"), (edges, "edges")):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kg_name").parquet(f"{path}/{name}")


def write_corpus(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, path: str) -> None:
    """Write a graph's documents (kg_name, doc_id, ...), chunks (kg_name, doc_id, chunk_id, ...) and mentions (kg_name, chunk_id, entity_id) by kg_name.

    What a graph had before is replaced, other graphs stay. Each id is kept
    once, as the row that sorts first; chunks without their document and
    mentions without their chunk aren't written.
    """
    own = lambda rows, *keys: rows.groupBy(*keys).agg(*_one_of(rows, list(keys))) if len(rows.columns) > len(keys) else rows.distinct()
    documents = own(documents, "kg_name", "doc_id")
    chunks = own(chunks.join(documents.select("kg_name", "doc_id"), ["kg_name", "doc_id"], "left_semi"), "kg_name", "chunk_id")
    mentions = own(mentions.join(chunks.select("kg_name", "chunk_id"), ["kg_name", "chunk_id"], "left_semi"), "kg_name", "chunk_id", "entity_id")
    for table, name in ((documents, "documents"), (chunks, "chunks"), (mentions, "mentions")):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kg_name").parquet(f"{path}/{name}")


def read_corpus(spark: SparkSession, path: str, kg_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph's documents, chunks and mentions."""
    return tuple(spark.read.parquet(f"{path}/{name}").filter(F.col("kg_name") == kg_name) for name in ("documents", "chunks", "mentions"))


def delete_graph(spark: SparkSession, path: str, kg_name: str) -> list[str]:
    """Remove a graph's tables and keep the other graphs'; the tables that it was in. A graph that isn't there is in none."""
    gone = []
    for name in ("nodes", "edges", "documents", "chunks", "mentions"):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/kg_name={kg_name}")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True):
            gone.append(name)
    return gone


def graph_exists(spark: SparkSession, path: str, kg_name: str) -> bool:
    """Whether any table has rows of a graph."""
    folders = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/kg_name={kg_name}") for name in ("nodes", "documents")]
    return any(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) for folder in folders)


def without_nodes(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after the listed nodes (entity_id) are deleted with their edges and mentions."""
    left = nodes.join(gone, "entity_id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("entity_id").alias(end)), end, "left_anti")
    return left, edges, mentions.join(gone, "entity_id", "left_anti")


def merged_graphs(nodes: DataFrame, edges: DataFrame, into: str) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one of the name ``into``: nodes of one label and normalised name are one, edges follow them.

    ``nodes`` is (kg_name, entity_id, name, type), ``edges`` (kg_name, src, dst,
    rel_type, confidence). A merged node has the least id of its own, the names
    of all and the graphs that it comes from; equal edges are one, with the
    greatest confidence. Edges whose ends aren't there are left out, and so are
    loops that merging made.
    """
    keyed = nodes.withColumn("key", entity_key(F.col("name")))
    one = keyed.groupBy("type", "key").agg(F.min("entity_id").alias("entity_id"), F.min("name").alias("name"), F.array_sort(F.collect_set("name")).alias("all_names"), F.array_sort(F.collect_set("kg_name")).alias("graphs"))
    to = keyed.join(one.select("type", "key", F.col("entity_id").alias("canonical")), ["type", "key"]).select("kg_name", "entity_id", "canonical")
    ends = [to.select("kg_name", F.col("entity_id").alias(end), F.col("canonical").alias(f"{end}_to")) for end in ("src", "dst")]
    moved = edges.join(ends[0], ["kg_name", "src"]).join(ends[1], ["kg_name", "dst"]).filter((F.col("src_to") != F.col("dst_to")) | (F.col("src") == F.col("dst")))
    told = moved.groupBy(F.col("src_to").alias("src"), F.col("dst_to").alias("dst"), "rel_type").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("kg_name")).alias("graphs"))
    return one.drop("key").withColumn("kg_name", F.lit(into)), told.withColumn("kg_name", F.lit(into))


def scan_entities(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` entities of a graph by id and the edges between them, without documents and chunks."""
    kept = nodes.filter(~F.col("type").isin("Document", "Chunk", "Mention")).orderBy("entity_id").limit(most)
    return kept, edges_within(kept, edges)


def _one_of(rows: DataFrame, keys: list[str]) -> list:
    """The other columns of the row that sorts first; maps can't be sorted and are taken from any."""
    rest = [field for field in rows.schema.fields if field.name not in keys]
    sortable = [F.col(f.name) for f in rest if not f.dataType.simpleString().startswith("map")]
    return [F.min_by(f.name, F.struct(*sortable)).alias(f.name) for f in rest] if sortable else [F.any_value(f.name).alias(f.name) for f in rest]


def _merged(edges: DataFrame, name: str):
    if edges.schema[name].dataType.simpleString().startswith("array"):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return (F.max(name) if name == "confidence" else F.min(name)).alias(name)


def read_graph(spark: SparkSession, path: str, kg_name: str) -> tuple[DataFrame, DataFrame]:
    """A graph's nodes, and its edges whose ends are both there."""
    nodes, edges = (spark.read.parquet(f"{path}/{name}").filter(F.col("kg_name") == kg_name) for name in ("nodes", "edges"))
    return nodes, edges_within(nodes, edges)


def edges_within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("entity_id")
    return edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def sample_graph(nodes: DataFrame, edges: DataFrame, most: int = 500, share: int = 10) -> tuple[DataFrame, DataFrame]:
    """The nodes of greatest degree, a tenth of all and at most ``most``, and the edges between them. Ties go to the lower id."""
    n = min(most, max(1, nodes.count() // share))
    ranked = nodes.join(degrees(edges).withColumnRenamed("node", "entity_id").select("entity_id", "degree"), "entity_id", "left")
    best = ranked.withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "entity_id").limit(n)
    return best, edges_within(best, edges)


def without_document(chunks: DataFrame, mentions: DataFrame, entities: DataFrame, doc_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after a document is deleted: its chunks and mentions go, and entities that only it mentioned."""
    gone = chunks.filter(F.col("doc_id") == doc_id).select("chunk_id")
    left_chunks, left_mentions = chunks.join(gone, "chunk_id", "left_anti"), mentions.join(gone, "chunk_id", "left_anti")
    only = mentions.join(gone, "chunk_id", "left_semi").select("entity_id").distinct().join(left_mentions, "entity_id", "left_anti")
    return left_chunks, left_mentions, entities.join(only, "entity_id", "left_anti")
