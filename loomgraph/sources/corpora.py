"""Loaders of question and passage corpora, graph files and run artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PMID_PATTERN = r"/pubmed/(\d+)"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first of some paths that is there."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths} is there")


def read_records(spark: SparkSession, paths: list[str], nested: str | None = None) -> DataFrame:
    """Records of the first file that is there: lines of JSON, a JSON array, or by ``nested`` an array inside one object; CSV by its ending."""
    path = first_existing(spark, paths)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    rows = spark.read.json(path, multiLine=not path.endswith(".jsonl"))
    return rows.select(F.explode(nested).alias("x")).select("x.*") if nested and nested in rows.columns else rows


def ideal_records(rows: DataFrame) -> DataFrame:
    """Records with a question and a recommendation that were judged completely plausible and completely answered."""
    fully = lambda name: F.lower(F.trim(F.col(name).cast("string"))) == "completely"
    given = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) != ""
    return rows.filter(fully("Plausible") & fully("Answered") & given("Question") & given("Recommendation"))


def pmid(url: Column) -> Column:
    """The PubMed id in a URL, or the text if it is a number; else null."""
    text = F.trim(F.coalesce(url, F.lit("")))
    found = F.regexp_extract(text, PMID_PATTERN, 1)
    return F.when(found != "", found).when(text.rlike(r"^\d+$"), text)


def referenced_pmids(questions: DataFrame) -> DataFrame:
    """(pmid): the PubMed ids that questions (documents, snippets.document) refer to, each once, in the order of numbers."""
    urls = F.concat(F.coalesce("documents", F.array().cast("array<string>")), F.coalesce("snippets.document", F.array().cast("array<string>")))
    found = questions.select(F.explode(urls).alias("url")).select(pmid(F.col("url")).alias("pmid")).filter("pmid IS NOT NULL").distinct()
    return found.orderBy(F.col("pmid").cast("decimal(20,0)"))


ARTICLES = """MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string,
    Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>>>"""


def read_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, text) of a PubMed article set: labelled parts of an abstract begin with their label. Articles without id or text are left out."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLES).load(path)
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    parts = F.transform(F.col("MedlineCitation.Article.Abstract.AbstractText"), lambda p: F.struct(flat(p["_Label"]).alias("l"), flat(p["_VALUE"]).alias("v")))
    told = F.transform(F.filter(parts, lambda p: p["v"] != ""), lambda p: F.when(p["l"] != "", F.concat(p["l"], F.lit(": "), p["v"])).otherwise(p["v"]))
    out = rows.select(flat(F.col("MedlineCitation.PMID")).alias("pmid"), flat(F.col("MedlineCitation.Article.ArticleTitle")).alias("title"), F.coalesce(F.array_join(told, "\n"), F.lit("")).alias("text"))
    return out.filter("pmid <> '' AND (title <> '' OR text <> '')").dropDuplicates(["pmid"])


def paragraph_corpus(questions: DataFrame) -> DataFrame:
    """(title, text) of the distinct paragraphs of questions (context: title and sentences): ``title. sentences``, blank ones left out."""
    each = questions.select(F.explode("context").alias("p")).select(F.trim("p.title").alias("title"), F.transform("p.sentences", lambda s: F.trim(s)).alias("s"))
    body = F.array_join(F.filter("s", lambda s: s != ""), " ")
    text = F.when(F.coalesce("title", F.lit("")) != "", F.trim(F.concat("title", F.lit(". "), body))).otherwise(body)
    return each.select(F.coalesce("title", F.lit("")).alias("title"), text.alias("text")).filter("text <> ''").distinct()


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables of JSON lines; what was there is replaced."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/relationships")


def load_graph(spark: SparkSession, path: str, node_schema: str | None = None, edge_schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of a saved graph."""
    read = lambda name, schema: (spark.read.schema(schema) if schema else spark.read).json(f"{path}/{name}")
    return read("nodes", node_schema), read("relationships", edge_schema)


def store_run(details: DataFrame, path: str, run_id: str) -> None:
    """A run's details by its id; a run that is stored again is replaced, others stay."""
    out = details.withColumn("run_id", F.lit(run_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/details")


def run_index(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, questions) of the runs that are stored."""
    return spark.read.parquet(f"{path}/details").groupBy("run_id").agg(F.count(F.lit(1)).alias("questions"))


OWL_CLASS = "`_rdf:about` string, `rdfs:label` string, `rdfs:comment` string"
OWL_PROPERTY = OWL_CLASS + ", `rdfs:domain` struct<`_rdf:resource`: string>, `rdfs:range` struct<`_rdf:resource`: string>, relationshipAttributeOf string, unit string, propertyType string"

# What a literal's type is called.
LITERAL_TYPES = {
    "string": "string", "integer": "integer", "int": "integer", "long": "integer", "decimal": "decimal", "float": "float",
    "double": "double", "date": "date", "dateTime": "datetime", "boolean": "boolean",
}


def local_name(uri: Column) -> Column:
    """What stands after the last ``#``, else after the last ``/``."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def read_owl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Types (id, label, description), relations (id, label, domain, range) and properties (owner, name, type, unit, of_relation) of an OWL file in RDF/XML.

    A literal property belongs to the relation that it names, else to its
    domain where that is a type. Elements without a URI are left out.
    """

    def listed(tag: str, schema: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).filter("`_rdf:about` <> ''")
        return rows.withColumn("id", local_name(F.col("`_rdf:about`"))).filter("id <> ''")

    label = F.coalesce(F.trim("`rdfs:label`"), F.initcap(F.regexp_replace("id", "_", " ")))
    resource = lambda name: local_name(F.col(f"`rdfs:{name}`.`_rdf:resource`"))
    types = listed("owl:Class", OWL_CLASS).select("id", label.alias("label"), F.trim("`rdfs:comment`").alias("description"))
    relations = listed("owl:ObjectProperty", OWL_PROPERTY).select("id", label.alias("label"), resource("domain").alias("domain"), resource("range").alias("range"))
    kinds = F.create_map(*[F.lit(x) for pair in LITERAL_TYPES.items() for x in pair])
    of = F.trim(F.coalesce("relationshipAttributeOf", F.lit("")))
    literal = listed("owl:DatatypeProperty", OWL_PROPERTY).select(
        F.when(of != "", of).otherwise(resource("domain")).alias("owner"), F.coalesce(F.trim("`rdfs:label`"), "id").alias("name"),
        F.coalesce("propertyType", kinds[resource("range")], F.lit("string")).alias("type"), F.trim("unit").alias("unit"), (of != "").alias("of_relation"),
    )
    own = literal.join(types.select(F.col("id").alias("owner")).distinct().withColumn("_known", F.lit(True)), "owner", "left")
    return types, relations, own.filter(F.col("of_relation") | F.col("_known")).drop("_known")
