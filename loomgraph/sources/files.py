"""Readers of delimited, JSON and text files into records, and of ontologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EXTENSIONS = ["pdf", "txt", "csv", "json", "xml"]
MOST_BYTES = 50 << 20


def acceptable_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, accepted, reason) of files: by extension and size."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "length")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~kind.isin(EXTENSIONS), "extension").when(F.col("length") > MOST_BYTES, "size")
    return found.select("path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))


def read_delimited(spark: SparkSession, path: str, text_column: str, id_column: str | None = None, delimiter: str = ",", start_row: int = 0, max_rows: int | None = None) -> DataFrame:
    """(id, text, metadata): rows with text; the id is a column's value or row_n; other columns become a map.

    Rows are numbered in the order of the file, header not counted: each
    partition's rows by their place in it, after the rows of the partitions
    before, whose counts alone come together.
    """
    rows = spark.read.csv(path, header=True, sep=delimiter, multiLine=True, quote='"', escape='"')
    if text_column not in rows.columns:
        raise ValueError(f"no column {text_column}; there are {rows.columns}")
    names = list(rows.columns)
    if id_column is None or start_row or max_rows is not None:
        rows = _numbered(rows)
    else:
        rows = rows.withColumn("_n", F.lit(0))
    rows = rows.filter(F.col("_n") >= start_row)
    if max_rows is not None:
        rows = rows.filter(F.col("_n") < start_row + max_rows)
    others = [name for name in names if name not in (text_column, id_column)]
    pairs = [item for name in others for item in (F.lit(name), F.col(f"`{name}`"))]
    metadata = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    key = F.col(f"`{id_column}`") if id_column else F.concat(F.lit("row_"), F.col("_n").cast("string"))
    return rows.select(key.alias("id"), F.col(f"`{text_column}`").alias("text"), metadata.alias("metadata")).filter(F.trim("text") != "")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``_n``, their number from 0 in the order of the table."""
    placed = rows.withColumn("_m", F.monotonically_increasing_id())
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_b"))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("_n", F.col("_b") + at).drop("_m", "_p", "_b")


def read_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, label) of types and (id, label, domain, range) of relations, from either JSON layout."""
    item = "array<struct<id:string,name:string,type:string,label:string,`from`:string,`to`:string,domain:string,range:string>>"
    raw = spark.read.schema(f"classes {item}, entity_types {item}, relationships {item}, relationship_types {item}").json(path, multiLine=True)

    def listed(*columns: str) -> DataFrame:
        given = F.coalesce(*[F.when(F.size(c) > 0, F.col(c)) for c in columns])
        return raw.select(F.explode(given).alias("x")).select("x.*")

    def label(key: str):
        return F.coalesce("label", F.initcap(F.regexp_replace(key, "_", " ")))

    types = listed("classes", "entity_types").withColumn("id", F.coalesce("id", "name")).filter("id <> ''")
    relations = listed("relationships", "relationship_types").withColumn("id", F.coalesce("id", "name", "type")).filter("id <> ''")
    return types.select("id", label("id").alias("label")), relations.select("id", label("id").alias("label"), F.coalesce("from", "domain").alias("domain"), F.coalesce("to", "range").alias("range"))
