"""Canonical JSON of nested rows, and hashes of tables that don't depend on the order of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Pieces that a digest is added up in, of so many hexadecimal digits.
PIECES, DIGITS = 8, 8


def sorted_fields(column: Column, kind: DataType) -> Column:
    """The column with the fields of all structs, and the keys of all maps, in order."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda field: field.name)
        return F.when(column.isNotNull(), F.struct(*(sorted_fields(column[field.name], field.dataType).alias(field.name) for field in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(column)) if not isinstance(kind.valueType, MapType) else F.map_entries(column)
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), sorted_fields(e["value"], kind.valueType).alias("value"))))
    return column


def canonical_json(rows: DataFrame, *columns: str) -> Column:
    """The columns (all, if none are named) of a row as JSON: keys in order at every depth, nulls told, no white space."""
    names = sorted(columns or rows.columns)
    fields = [sorted_fields(F.col(f"`{name}`"), rows.schema[name].dataType).alias(name) for name in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def table_digest(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, n, digest): of each group the hash of the multiset of ``text``, whatever the order and partitioning of its rows.

    Each row's SHA-256 is cut into pieces, which are added up apart, as
    aggregates that partitions merge; the digest is the hash of count and sums.
    """
    hashed = rows.select(*keys, F.sha2(text, 256).alias("h"))
    piece = lambda k: F.conv(F.substring("h", DIGITS * k + 1, DIGITS), 16, 10).cast("decimal(38,0)")
    added = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(piece(k)).alias(f"s{k}") for k in range(PIECES)))
    told = F.concat_ws("|", F.col("n").cast("string"), *(F.coalesce(F.col(f"s{k}"), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(PIECES)))
    return added.select(*keys, "n", F.sha2(told, 256).alias("digest"))


def content_hash(passages: DataFrame, contract: dict[str, str | bool | int]) -> DataFrame:
    """(content_hash, passages): the fingerprint of what a graph was built from (dataset, question_id, passage_index, text) and how.

    Texts count without white space at their ends. The contract is told in the
    order of its keys; a contract with a global corpus has no selection key.
    """
    told = dict(contract)
    if told.get("usesGlobalCorpus"):
        told["selectionKey"] = ""
    import json

    rows = passages.select(F.coalesce("dataset", F.lit("")).alias("dataset"), F.coalesce(F.col("question_id").cast("string"), F.lit("")).alias("question_id"), F.coalesce("passage_index", F.lit(0)).cast("int").alias("passage_index"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text"))
    digest = table_digest(rows, canonical_json(rows))
    whole = F.concat(F.lit(json.dumps(told, ensure_ascii=False, sort_keys=True, separators=(",", ":"))), F.lit("|"), "digest")
    return digest.select(F.sha2(whole, 256).alias("content_hash"), F.col("n").alias("passages"))


def schema_card(types: DataFrame, relations: DataFrame) -> DataFrame:
    """(classes, relationships, class_count, relationship_count, schema_hash) of an ontology's types (id, label) and relations (id, label, domain, range).

    The lists are sorted; an ontology is a small table by nature. The hash is of
    all columns of both tables, whatever the order of their rows.
    """
    one = types.agg(F.array_sort(F.collect_set("id")).alias("classes"), F.count(F.lit(1)).alias("class_count")).withColumn("k", F.lit(1))
    two = relations.agg(F.array_sort(F.collect_set("id")).alias("relationships"), F.count(F.lit(1)).alias("relationship_count")).withColumn("k", F.lit(1))
    digests = [table_digest(rows, canonical_json(rows)).select(F.col("digest").alias(name)).withColumn("k", F.lit(1)) for rows, name in ((types, "t"), (relations, "r"))]
    out = one.join(two, "k").join(digests[0], "k").join(digests[1], "k")
    return out.select("classes", "relationships", "class_count", "relationship_count", F.sha2(F.concat_ws("|", "t", "r"), 256).alias("schema_hash"))
