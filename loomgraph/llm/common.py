"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Used only where the session names no shared folder and its master is local, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/loomgraph"

#: Rows in one Arrow batch handed to Python; the bytes of a batch are bounded as well.
BATCH_ROWS = "1000"
BATCH_BYTES = str(4 << 20)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return LOCAL_SHARED_DIR


def new_shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage durably.

    A lost executor loses nothing of it, and what follows reads fixed rows.
    """
    path = new_shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables. Only for those that nothing reads any more but tables that are materialized themselves."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._shared_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python gets by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a column once and use it many times inside higher-order functions.

    A plain column that a lambda captures may be inlined into the lambda by the
    optimizer and evaluated for each element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a table; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def plain_columns(df: DataFrame, replaced: list[str]) -> list[Column]:
    """The columns of a table, without those that an operator is about to set."""
    gone = {name.lower() for name in replaced}
    return [F.col(f"`{name}`") for name in df.columns if name.lower() not in gone]


def with_fields(fields: list[StructField], more: str) -> StructType:
    """The schema of these fields, whatever their names, and of further ones in Spark's notation."""
    return StructType([*(StructField(field.name, field.dataType) for field in fields), *StructType.fromDDL(more).fields])


#: What an operator's rows carry beside id and text, as one column.
CARRIED = "carried by the row"
#: Names that no operator uses inside; rows with others travel as one column.
PLAIN = {"doc_id", "text", "lang", "source", "n_chars", "held_out"}


def keeping_columns(output: list[str]) -> Callable:
    """For an operator from documents to documents: it sees doc_id, text and, as one column, whatever else a row has.

    So no name of the input can meet one that the operator uses inside. Rows
    come back with the input's columns in their order, without those that have
    one of the ``output`` names (in any case), and then the output. Tables that
    have names of ``documents`` alone are handed on as they are.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)
        own_id = "id_column" in signature.parameters

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            bound = signature.bind(docs, *args, **options)
            bound.apply_defaults()
            names = bound.arguments
            asked = {"doc_id": names["id_column"], "text": names["text_column"]} if own_id else {"text": names["text_column"]}
            gone = {name.lower() for name in output}
            if all(inside == given for inside, given in asked.items()) and set(docs.columns) <= PLAIN:
                return operator(*bound.args, **bound.kwargs)
            used = {given.lower() for given in asked.values()}
            others = [name for name in docs.columns if name.lower() not in used | gone]
            columns = [F.col(f"`{given}`").alias(inside) for inside, given in asked.items()]
            if others:
                columns.append(F.struct(*(F.col(f"`{name}`") for name in others)).alias(CARRIED))
            names |= {next(iter(signature.parameters)): docs.select(*columns), "text_column": "text"}
            if own_id:
                names["id_column"] = "doc_id"
            found = operator(*bound.args, **bound.kwargs)
            back = {given.lower(): F.col(inside) for inside, given in asked.items()} | {name.lower(): F.col(f"`{CARRIED}`")[name] for name in others}
            own = [back[name.lower()].alias(name) for name in docs.columns if name.lower() not in gone]
            return found.select(*own, *(F.col(name) for name in output))

        return run

    return wrap


def labelled_ids(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row an id, with the greatest of its labels; rows without id or without a label of 0 or 1 are left out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def labelled_texts(docs: DataFrame, chosen: DataFrame, text_column: str) -> DataFrame:
    """(doc_id, label, text) of the chosen (doc_id, label): one row an id however often it occurs, its text of least hash."""
    own = docs.select("doc_id", F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    met = own.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text")))["text"].alias("text"))
