"""Queries on what is read from files: the driver tables are written in a format to the shared folder and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import chunking
from loomgraph.plans import fixtures as fx
from loomgraph.plans.registry import query
from loomgraph.sources import corpora, files, graphs, reports
from loomgraph.sources.shared import new_path
from loomgraph.sources.tables import read_table


def as_csv(rows, path: str, delimiter: str = ",") -> str:
    options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.write.options(**options).csv(path)
    return path


@query("delimited_scan", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text, lang, source FROM documents WHERE trim(text) <> ''")
def delimited_scan(spark, sf_dir):
    path = as_csv(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), new_path(spark, "csv"), "|")
    rows = files.read_delimited(spark, path, "text", "doc_id", "|")
    return rows.select("id", F.md5("text").alias("text"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("column_check", """SELECT * FROM (VALUES ('both', TRUE, 4, 0), ('no_id', FALSE, 4, 1), ('neither', FALSE, 4, 2), ('wrong_delimiter', FALSE, 1, 1)) t(wanted, is_valid, columns, errors) WHERE EXISTS (SELECT 1 FROM documents)""")
def column_check(spark, sf_dir):
    path = as_csv(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), new_path(spark, "csv"))
    asked = {"both": ("text", "doc_id", ","), "no_id": ("text", "id", ","), "neither": ("body", "id", ","), "wrong_delimiter": ("text", None, "|")}
    found = [(name, reports.check_columns(spark, path, *wanted)) for name, wanted in asked.items()]
    return spark.createDataFrame([(name, row["is_valid"], row["num_columns"], len(row["validation_errors"])) for name, row in found], "wanted string, is_valid boolean, columns int, errors int")


def report_file(spark, sf_dir) -> str:
    """Documents as medical reports: all expected columns, most of them empty, and three more."""
    docs = read_table(spark, sf_dir, "documents")
    told = {"patient_id": F.col("doc_id").cast("string"), "full_report_text": F.col("text"), "chief_complaint": F.col("lang"), "social_history": F.when(F.col("doc_id") % 3 > 0, F.col("source"))}
    columns = [told.get(name, F.lit(None).cast("string")).alias(name.upper() if name == "chief_complaint" else name) for name in reports.REPORT_FIELDS if name != "full_report_text"]
    more = [F.col("n_chars").cast("string").alias("size"), F.lit("x").alias("ward"), F.lit(None).cast("string").alias("blank")]
    return as_csv(docs.select(*columns, *more, told["full_report_text"].alias("full_report_text")), new_path(spark, "reports"), "|")


@query("report_records", """SELECT CAST(doc_id AS VARCHAR) AS patient_id, md5(trim(text)) AS text, nullif(lang, '') AS complaint, CASE WHEN doc_id % 3 > 0 THEN source END AS social, CAST((lang <> '')::INT + (doc_id % 3 > 0)::INT AS INTEGER) AS sections, CAST(n_chars AS VARCHAR) AS size, 2 AS metadata FROM documents""")
def report_records(spark, sf_dir):
    rows = reports.read_reports(spark, report_file(spark, sf_dir))
    return rows.select("patient_id", F.md5("text").alias("text"), F.col("sections")["chief_complaint"].alias("complaint"), F.col("sections")["social_history"].alias("social"), F.size("sections").alias("sections"), F.col("metadata")["size"].alias("size"), F.size("metadata").alias("metadata"))


@query("report_check", "SELECT TRUE AS is_valid, 25 AS columns, CAST((avg(length(text)) < 100)::INT AS INTEGER) AS errors, 'full_report_text' AS text_field FROM documents")
def report_check(spark, sf_dir):
    row = reports.check_reports(spark, report_file(spark, sf_dir))
    return spark.createDataFrame([(row["is_valid"], row["num_columns"], len(row["validation_errors"]), row["field_mapping"]["full_report_text"])], "is_valid boolean, columns int, errors int, text_field string")


@query("report_template", """SELECT CAST(r_regionkey AS VARCHAR) AS patient_id, r_name AS text, CAST(0 AS INTEGER) AS sections FROM region""")
def report_template(spark, sf_dir):
    """One written report for each region; regions are few by nature, and the writer takes rows that a person fills in."""
    rows = [{"patient_id": str(row["r_regionkey"]), "full_report_text": row["r_name"]} for row in read_table(spark, sf_dir, "region").collect()]
    path = new_path(spark, "template")
    reports.write_template(spark, path, rows=rows)
    return reports.read_reports(spark, path).select("patient_id", "text", F.size("sections").alias("sections"))


@query("accepted_files", """SELECT kind, accepted, reason FROM (VALUES ('csv', TRUE, NULL), ('json', TRUE, NULL), ('parquet', FALSE, 'extension')) t(kind, accepted, reason) WHERE EXISTS (SELECT 1 FROM nation)""")
def accepted_files(spark, sf_dir):
    path = new_path(spark, "upload")
    nation = read_table(spark, sf_dir, "nation")
    nation.write.csv(f"{path}/a")
    nation.write.json(f"{path}/b")
    nation.write.parquet(f"{path}/c")
    found = files.acceptable_files(spark, f"{path}/*/part-*")
    return found.select(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), "accepted", "reason").distinct()


@query("json_corpus", "SELECT layout, conv_id, turn, role, md5(text) AS text FROM conversations, (VALUES ('lines'), ('nested')) t(layout)")
def json_corpus(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    path = new_path(spark, "corpus")
    rows.write.json(f"{path}.jsonl")
    rows.groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("records")).select("records").write.json(f"{path}-nested.jsonl")
    lines = corpora.read_records(spark, [f"{path}-missing.json", f"{path}.jsonl"]).withColumn("layout", F.lit("lines"))
    nested = corpora.read_records(spark, [f"{path}-nested.jsonl"], "records").withColumn("layout", F.lit("nested"))
    return lines.unionByName(nested).select("layout", "conv_id", "turn", "role", F.md5("text").alias("text"))


@query("ideal_records", """SELECT format, doc_id, md5(text) AS question FROM documents, (VALUES ('csv'), ('jsonl')) t(format) WHERE doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 > 0 AND trim(text) <> ''""")
def ideal_records(spark, sf_dir):
    judged = lambda k, yes: F.when(F.col("doc_id") % k == 0, yes).otherwise("Partly")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("Question"), F.when(F.col("doc_id") % 5 > 0, "advice").otherwise(" ").alias("Recommendation"), judged(2, "Completely").alias("Plausible"), judged(3, " completely ").alias("Answered"))
    path = new_path(spark, "ideal")
    as_csv(rows, f"{path}.csv")
    rows.write.json(f"{path}.jsonl")
    each = [corpora.ideal_records(corpora.read_records(spark, [f"{path}.{kind}"])).select(F.lit(kind).alias("format"), F.col("doc_id").cast("long").alias("doc_id"), F.md5("Question").alias("question")) for kind in ("csv", "jsonl")]
    return each[0].unionByName(each[1])


@query("article_abstracts", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N} .,]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS pmid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'About ' || doc_id END AS title, md5(CASE WHEN x = '' THEN '' WHEN doc_id % 2 = 0 THEN 'METHODS: ' || x || chr(10) || x ELSE x || chr(10) || x END) AS text FROM t WHERE x <> '' OR doc_id % 3 > 0""")  # fmt: skip
def article_abstracts(spark, sf_dir):
    text = F.regexp_replace("text", r"[^\p{L}\p{N} .,]", " ")
    part = lambda label: F.struct(label.alias("_Label"), text.alias("_VALUE"))
    abstract = F.struct(F.array(part(F.when(F.col("doc_id") % 2 == 0, "METHODS")), part(F.lit(None).cast("string"))).alias("AbstractText"))
    article = F.struct(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("About  "), F.col("doc_id").cast("string"))).alias("ArticleTitle"), abstract.alias("Abstract"))
    rows = read_table(spark, sf_dir, "documents").select(F.struct(F.col("doc_id").cast("string").alias("PMID"), article.alias("Article")).alias("MedlineCitation"))
    path = new_path(spark, "pubmed")
    rows.write.format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").save(path)
    return corpora.read_abstracts(spark, path).select("pmid", "title", F.md5("text").alias("text"))


@query("paragraph_corpus", r"""WITH p AS (SELECT trim(role) AS title, array_to_string([trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''], ' ') AS body FROM conversations)
SELECT DISTINCT title, md5(trim(title || '. ' || body)) AS text FROM p""")
def paragraph_corpus(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("role").alias("title"), F.split("text", "\n").alias("sentences")).alias("p"))
    path = f"{new_path(spark, 'questions')}.jsonl"
    turns.groupBy("conv_id").agg(F.collect_list("p").alias("context")).write.json(path)
    return corpora.paragraph_corpus(corpora.read_records(spark, [path])).select("title", F.md5("text").alias("text"))


@query("graph_files", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES} SELECT 'node' AS kind, entity_id AS a, name AS b, type AS c FROM entities UNION ALL SELECT 'edge', src, dst, rel_type FROM place_edges""")
def graph_files(spark, sf_dir):
    path = new_path(spark, "graph")
    corpora.save_graph(fx.entities(spark, sf_dir), fx.place_edges(spark, sf_dir), path)
    nodes, edges = corpora.load_graph(spark, path)
    told = lambda kind, rows, *names: rows.select(F.lit(kind).alias("kind"), *(F.col(name).alias(to) for name, to in zip(names, "abc", strict=True)))
    return told("node", nodes, "entity_id", "name", "type").unionByName(told("edge", edges, "src", "dst", "rel_type"))


@query("run_index", f"""WITH {fx.EVAL_ROWS} SELECT dataset AS run_id, CAST(count(*) AS BIGINT) AS questions FROM eval_rows WHERE dataset <> 'x' AND (hops > 1 OR dataset <> (SELECT min(dataset) FROM eval_rows)) GROUP BY dataset""")
def run_index(spark, sf_dir):
    """Each dataset's questions are a run; the first one is stored again with fewer."""
    rows = fx.eval_rows(spark, sf_dir).select("question_id", "dataset", "correct", "hops")
    path = new_path(spark, "runs")
    names = sorted(row[0] for row in rows.select("dataset").distinct().collect())  # one a source of documents
    for name in names:
        corpora.store_run(rows.filter(F.col("dataset") == name).drop("dataset"), path, name)
    corpora.store_run(rows.filter((F.col("dataset") == names[0]) & (F.col("hops") > 1)).drop("dataset"), path, names[0])
    return corpora.run_index(spark, path)


@query("ontology_scan", """SELECT 'type' AS kind, lower(replace(t, ' ', '_')) AS id, array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(t, ' ')], ' ') AS label, NULL AS domain, NULL AS range FROM (SELECT DISTINCT p_type AS t FROM part)
UNION ALL SELECT DISTINCT 'relation', 'MADE_BY_' || p_brand, 'Made as ' || p_brand, lower(replace(min(p_type), ' ', '_')), NULL FROM part GROUP BY p_brand""")  # fmt: skip
def ontology_scan(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    key = F.lower(F.translate("p_type", " ", "_"))
    types = part.select(key.alias("id")).distinct().agg(F.collect_list(F.struct("id")).alias("classes"))  # what kinds of parts there are is bounded
    made = part.groupBy("p_brand").agg(F.min(key).alias("d")).agg(F.collect_list(F.struct(F.concat(F.lit("MADE_BY_"), "p_brand").alias("type"), F.concat(F.lit("Made as "), "p_brand").alias("label"), F.col("d").alias("domain"))).alias("relationship_types"))
    path = new_path(spark, "ontology")
    types.withColumn("k", F.lit(1)).join(made.withColumn("k", F.lit(1)), "k").drop("k").coalesce(1).write.json(path)
    found, relations = files.read_ontology(spark, path)
    told = found.select(F.lit("type").alias("kind"), "id", "label", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("range"))
    return told.unionByName(relations.select(F.lit("relation").alias("kind"), "id", "label", "domain", "range"))


@query("owl_scan", """SELECT 'type' AS kind, 'T' || n_nationkey AS id, n_name AS label, NULL AS domain, NULL AS range FROM nation
UNION ALL SELECT 'relation', 'in_' || r_regionkey, 'In ' || r_regionkey, 'T' || min(n_nationkey), 'T' || max(n_nationkey) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
UNION ALL SELECT 'property', 'T' || n_nationkey, 'size', 'integer', NULL FROM nation""")  # fmt: skip
def owl_scan(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    path = new_path(spark, "owl")
    spaces = " ".join(f'xmlns:{name}="http://www.w3.org/{rest}#"' for name, rest in (("rdf", "1999/02/22-rdf-syntax-ns"), ("rdfs", "2000/01/rdf-schema"), ("owl", "2002/07/owl")))

    def write(rows, tag: str, about, *inner) -> None:
        """A file of its own for each kind of element; there are as many as nations."""
        element = F.concat(F.lit(f'<owl:{tag} rdf:about="http://example.org/o#'), about, F.lit('">'), *inner, F.lit(f"</owl:{tag}>"))
        whole = rows.agg(F.concat(F.lit(f"<rdf:RDF {spaces}>"), F.array_join(F.collect_list(element), "\n"), F.lit("</rdf:RDF>")))
        whole.write.text(f"{path}/{tag}")

    key = F.col("n_nationkey").cast("string")
    label = lambda text: F.concat(F.lit("<rdfs:label> "), text, F.lit("</rdfs:label>"))
    link = lambda name, uri: F.concat(F.lit(f'<rdfs:{name} rdf:resource="'), uri, F.lit('"/>'))
    type_of = lambda column: F.concat(F.lit("http://example.org/o#T"), column)
    write(nation, "Class", F.concat(F.lit("T"), key), label(F.col("n_name")), F.lit("<rdfs:comment>a nation</rdfs:comment>"))
    ends = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").cast("string").alias("r")).agg(F.min("n_nationkey").cast("string").alias("a"), F.max("n_nationkey").cast("string").alias("b"))
    write(ends, "ObjectProperty", F.concat(F.lit("in_"), "r"), link("domain", type_of(F.col("a"))), link("range", type_of(F.col("b"))))
    write(nation, "DatatypeProperty", F.concat(F.lit("size_"), key), label(F.lit("size")), link("domain", type_of(key)), link("range", F.lit("http://www.w3.org/2001/XMLSchema#integer")))
    types, relations, literals = corpora.read_owl(spark, f"{path}/*")
    none = F.lit(None).cast("string")
    out = types.select(F.lit("type").alias("kind"), "id", "label", none.alias("domain"), none.alias("range")).unionByName(relations.select(F.lit("relation").alias("kind"), "id", "label", "domain", "range"))
    return out.unionByName(literals.select(F.lit("property").alias("kind"), F.col("owner").alias("id"), F.col("name").alias("label"), F.col("type").alias("domain"), none.alias("range")))


def corpus_tables(spark, sf_dir):
    """Documents by their language as graphs, their lines as chunks, and the capitalised words of these as mentions."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("lang").alias("kg_name"), "doc_id", "source", "text").filter("lang IS NOT NULL")
    lines = docs.select("kg_name", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    chunks = lines.select("kg_name", "doc_id", F.concat_ws(":", "doc_id", "i").alias("chunk_id"), "line")
    mentions = chunks.select("kg_name", "chunk_id", F.explode(F.regexp_extract_all("line", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("entity_id"))
    return docs.drop("text"), chunks, mentions


_CORPUS = """l AS (SELECT lang, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE lang IS NOT NULL)),
m AS (SELECT DISTINCT lang, doc_id || ':' || i AS chunk_id, unnest(regexp_extract_all(line, '[A-Z][a-z]{3,}')) AS entity_id FROM l)"""


@query("corpus_tables", f"""WITH {_CORPUS} SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, source AS value FROM documents WHERE lang = 'en'
UNION ALL SELECT 'chunk', doc_id || ':' || i, md5(line) FROM l WHERE lang = 'en' UNION ALL SELECT 'mention', chunk_id, entity_id FROM m WHERE lang = 'en'""")
def corpus_tables_read(spark, sf_dir):
    """Written twice, the second time with chunks of a document that isn't there, and one graph read back."""
    docs, chunks, mentions = corpus_tables(spark, sf_dir)
    path = new_path(spark, "store")
    graphs.write_corpus(docs, chunks, mentions, path)
    lost = chunks.withColumn("doc_id", -1 - F.col("doc_id")).withColumn("chunk_id", F.concat(F.lit("lost:"), "chunk_id"))
    graphs.write_corpus(docs.union(docs), chunks.unionByName(lost), mentions, path)
    docs, chunks, mentions = graphs.read_corpus(spark, path, "en")
    told = lambda kind, rows, key, value: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), value.alias("value"))
    return told("document", docs, "doc_id", F.col("source")).unionByName(told("chunk", chunks, "chunk_id", F.md5("line"))).unionByName(told("mention", mentions, "chunk_id", F.col("entity_id")))


def named_graphs(spark, sf_dir):
    """Supply edges as graphs by their year's parity, with the nodes at their ends; parts of one name are several."""
    edges = fx.supply_edges(spark, sf_dir).withColumn("kg_name", F.concat(F.lit("g"), (F.col("question_id") % 3).cast("string"))).select("kg_name", "src", "dst", "rel_type", "confidence")
    ends = edges.select("kg_name", F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return ends.join(fx.entities(spark, sf_dir), "entity_id").select("kg_name", "entity_id", "name", "type"), edges


_NAMED = f"""{fx.ENTITIES}, {fx.SUPPLY_EDGES}, ed AS (SELECT 'g' || question_id % 3 AS kg, src, dst, rel_type, confidence FROM supply_edges),
nd AS (SELECT DISTINCT kg, entity_id, name, type FROM (SELECT kg, unnest([src, dst]) AS entity_id FROM ed) JOIN entities USING (entity_id))"""


@query("merged_graphs", f"""WITH {_NAMED}, k AS (SELECT *, regexp_replace(lower(trim(name)), '\\s+', '_', 'g') AS key FROM nd),
o AS (SELECT type, key, min(entity_id) AS id FROM k GROUP BY type, key), t AS (SELECT DISTINCT kg, entity_id, id FROM k JOIN o USING (type, key)),
mv AS (SELECT a.id AS src, b.id AS dst, rel_type, confidence, ed.kg FROM ed JOIN t a ON a.kg = ed.kg AND a.entity_id = src JOIN t b ON b.kg = ed.kg AND b.entity_id = dst WHERE a.id <> b.id OR src = dst)
SELECT src, dst, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(kg))), ',') AS graphs FROM mv GROUP BY src, dst, rel_type""")  # fmt: skip
def merged_graphs(spark, sf_dir):
    edges = graphs.merged_graphs(*named_graphs(spark, sf_dir), "all")[1]
    return edges.select("src", "dst", "confidence", F.array_join("graphs", ",").alias("graphs"))


@query("deleted_graph", f"""WITH {_NAMED} SELECT kg AS kg_name, CAST(count(*) AS BIGINT) AS nodes FROM nd WHERE kg <> 'g1' GROUP BY kg""")
def deleted_graph(spark, sf_dir):
    nodes, edges = named_graphs(spark, sf_dir)
    path = new_path(spark, "store")
    graphs.write_graph(nodes, edges, path)
    graphs.delete_graph(spark, path, "g1")
    return spark.read.parquet(f"{path}/nodes").groupBy("kg_name").agg(F.count(F.lit(1)).alias("nodes"))


@query("read_graph", f"""WITH {_NAMED} SELECT src, dst, max(confidence) AS confidence, CAST(count(*) AS BIGINT) AS copies FROM ed WHERE kg = 'g2' GROUP BY src, dst, rel_type""")
def read_graph(spark, sf_dir):
    path = new_path(spark, "store")
    graphs.write_graph(*named_graphs(spark, sf_dir), path)
    return graphs.read_graph(spark, path, "g2")[1].select("src", "dst", "confidence", "copies")


@query("scanned_entities", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES}, k AS (SELECT entity_id FROM entities WHERE type <> 'Part' ORDER BY entity_id LIMIT 100)
SELECT src, dst FROM place_edges WHERE src IN (SELECT entity_id FROM k) AND dst IN (SELECT entity_id FROM k) UNION ALL SELECT entity_id, NULL FROM k""")
def scanned_entities(spark, sf_dir):
    nodes, edges = graphs.scan_entities(fx.entities(spark, sf_dir).filter("type <> 'Part'"), fx.place_edges(spark, sf_dir), 100)
    return edges.select("src", "dst").unionByName(nodes.select(F.col("entity_id").alias("src"), F.lit(None).cast("string").alias("dst")))


@query("without_nodes", f"""WITH {fx.ENTITIES}, {fx.PLACE_EDGES}, g AS (SELECT 'N' || n_nationkey AS x FROM nation WHERE n_nationkey % 4 = 1)
SELECT src, dst FROM place_edges WHERE src NOT IN (SELECT x FROM g) AND dst NOT IN (SELECT x FROM g)""")
def without_nodes(spark, sf_dir):
    nodes = fx.entities(spark, sf_dir)
    gone = nodes.filter("type = 'Nation' AND CAST(substr(entity_id, 2) AS INT) % 4 = 1").select("entity_id")
    return graphs.without_nodes(nodes, fx.place_edges(spark, sf_dir), fx.mentions(spark, sf_dir), gone)[1].select("src", "dst")


SIZE, OVERLAP = 400, 80


def _in_place(chunk):
    """Whether a chunk of ``text`` stands there where it says."""
    return F.col("text").substr(chunk["start_pos"] + 1, chunk["end_pos"] - chunk["start_pos"]) == chunk["chunk"]


@query("recursive_chunks", r"""SELECT doc_id, TRUE AS in_place, TRUE AS short, TRUE AS ordered, TRUE AS numbered, CAST(length(text) - length(regexp_replace(text, '^\s+', '')) AS INTEGER) AS start,
CAST(len(list_distinct([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''])) AS BIGINT) AS words FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''""")  # fmt: skip
def recursive_chunks(spark, sf_dir):
    """What must hold of a text's chunks: they stand where they say, are no longer than asked unless one word is, keep their order, and hold all words and no others."""
    docs = read_table(spark, sf_dir, "documents").filter(F.trim("text") != "").select("doc_id", "text")
    met = chunking.chunk_lists(docs, F.array("text"), F.array(F.lit(0)), SIZE, OVERLAP).filter(F.size("chunks") > 0)
    chunks, before = F.col("chunks"), lambda i: F.get("chunks", i - 1)["start_pos"]
    short = F.forall(chunks, lambda c: (F.length(c["chunk"]) <= SIZE) | ~c["chunk"].rlike(r"\s"))
    rising = F.transform(chunks, lambda c, i: F.coalesce(c["start_pos"] > before(i), F.lit(True)))
    numbers = F.transform(chunks, lambda c, i: (c["position"] == i) & (c["total_chunks"] == F.size("chunks")))
    words = F.flatten(F.transform(chunks, lambda c: F.array_remove(F.split(c["chunk"], r"\s+"), "")))
    return met.select(
        "doc_id", F.forall(chunks, _in_place).alias("in_place"), short.alias("short"), F.forall(rising, lambda x: x).alias("ordered"), F.forall(numbers, lambda x: x).alias("numbered"),
        F.array_min("chunks.start_pos").alias("start"), F.size(F.array_distinct(words)).cast("long").alias("words"),
    )


@query("retrieval_chunks", r"""SELECT doc_id, TRUE AS in_place, TRUE AS inside, TRUE AS ids FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''""")
def retrieval_chunks(spark, sf_dir):
    """Smaller chunks stand in the document where they say, inside their parent, under the hash of parent, number and text."""
    docs = read_table(spark, sf_dir, "documents").filter(F.trim("text") != "").select("doc_id", "text")
    parents = chunking.chunk_lists(docs, F.array("text"), F.array(F.lit(0)), SIZE, OVERLAP)
    name = lambda c: F.concat_ws(":", "doc_id", c["position"])
    met = chunking.retrieval_lists(parents, name, 100, 20).filter(F.size("small") > 0)
    parent = lambda c: F.get("chunks", c["parent"])
    inside = F.forall("small", lambda c: (c["start_pos"] >= parent(c)["start_pos"]) & (c["end_pos"] <= parent(c)["end_pos"]))
    ids = F.forall("small", lambda c: c["chunk_id"] == F.sha1(F.concat_ws(":", name(parent(c)), c["local_index"].cast("string"), c["chunk"])))
    return met.select("doc_id", F.forall("small", _in_place).alias("in_place"), inside.alias("inside"), ids.alias("ids"))


def sectioned(spark, sf_dir):
    """Documents with two headings put between their thirds, lines of the text alone being no headings."""
    third = F.floor(F.length("text") / 3).cast("int")
    part = lambda k: F.translate(F.col("text").substr(third * k + 1, third if k < 2 else F.length("text")), "\n", " ")
    docs = read_table(spark, sf_dir, "documents").filter(F.length("text") >= 30)
    return docs.select("doc_id", F.concat(part(0), F.lit("\nMaterials and Methods:\n"), part(1), F.lit("\nResults and Discussion\n"), part(2)).alias("text"))


_SECTIONED = r"""t AS (SELECT doc_id, text AS x, CAST(length(text) // 3 AS INTEGER) AS n FROM documents WHERE length(text) >= 30),
p AS (SELECT doc_id, replace(substr(x, 1, n), chr(10), ' ') AS a, replace(substr(x, n + 1, n), chr(10), ' ') AS b, replace(substr(x, 2 * n + 1), chr(10), ' ') AS c FROM t),
s AS (SELECT doc_id, 'Preamble' AS section, 0 AS start, a || chr(10) AS seg FROM p UNION ALL SELECT doc_id, 'Methods', length(a) + 1, 'Materials and Methods:' || chr(10) || b || chr(10) FROM p
  UNION ALL SELECT doc_id, 'Results', length(a) + length(b) + 25, 'Results and Discussion' || chr(10) || c FROM p)"""


@query("section_segments", rf"""WITH {_SECTIONED} SELECT doc_id, section, CAST(start AS INTEGER) AS start, CAST(start + length(seg) AS INTEGER) AS end, md5(seg) AS segment FROM s WHERE regexp_replace(seg, '\s', '', 'g') <> ''""")
def section_segments(spark, sf_dir):
    return chunking.section_segments(sectioned(spark, sf_dir)).select("doc_id", "section", "start", "end", F.md5("segment").alias("segment"))


@query("sectioned_chunks", rf"""WITH {_SECTIONED} SELECT doc_id, section, TRUE AS in_place, TRUE AS inside, TRUE AS numbered FROM s WHERE regexp_replace(seg, '\s', '', 'g') <> ''""")
def sectioned_chunks(spark, sf_dir):
    docs = sectioned(spark, sf_dir)
    listed = chunking.sectioned_lists(docs, SIZE, OVERLAP)
    segment, starts = lambda c: F.get("segments", c["part"]), F.array_sort("chunks.start_pos")
    told = F.transform("chunks", lambda c: F.struct(
        c["part"].alias("part"), _in_place(c).alias("true"), ((c["start_pos"] >= segment(c)["start"]) & (c["end_pos"] <= segment(c)["end"])).alias("inside"),
        (F.get("starts", c["position"]) == c["start_pos"]).alias("numbered"),
    ))
    rows = listed.withColumn("starts", starts).select("doc_id", F.col("segments.section").alias("s"), told.alias("told"))
    rows = rows.select("doc_id", "told", F.posexplode("s").alias("part", "section")).withColumn("told", F.filter("told", lambda c: c["part"] == F.col("part")))
    flag = lambda name, of: F.forall("told", lambda c: c[of]).alias(name)
    return rows.filter(F.size("told") > 0).select("doc_id", "section", flag("in_place", "true"), flag("inside", "inside"), flag("numbered", "numbered"))
