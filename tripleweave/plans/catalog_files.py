"""Checked queries: file scans, archives, ingest, sinks and whole jobs.

The inputs are documents and files that Spark derives from the test tables, in the scratch folder.
"""

from __future__ import annotations

import gzip
import io
import sys
import warnings
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF, XSD, lex
from ..operators import aggregates as agg
from ..operators.forms import ask_form, construct_form, graph_form, select_form
from ..operators.modifiers import order_by, project
from ..operators.patterns import bgp, triple_pattern
from ..session import scratch_path
from ..sources import archives
from ..sources import ingest as ing
from ..sources.files import FILES_DDL, filter_files, match_glob, scan_files, scan_store, union_sources
from ..sources.split import ingest_rdfxml_split
from .catalog_results import orders
from .job import run_job
from .model import P, graph
from .registry import Tables, query
from .sinks import sink_csv, sink_json, sink_metadata, sink_tsv

cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- derived documents and files ----------------------------------------------------------------------

def escaped(c: Column) -> Column:
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(written))
    return c


def line_of(triples: DataFrame, graphs: bool = False) -> DataFrame:
    """``value``: one N-Triples (or N-Quads) line per triple."""
    o = F.col("o")
    dt = F.replace(o["dt"], F.lit("xsd:"), F.lit(XSD))
    literal = F.concat(F.lit('"'), escaped(o["value"]), F.lit('"'), F.when(o["dt"] == "xsd:string", "").otherwise(
        F.concat(F.lit("^^<"), dt, F.lit(">"))))
    obj = F.when(o["kind"] == "lit", literal).otherwise(F.concat(F.lit("<"), o["value"], F.lit(">")))
    g = F.when(F.col("g") != "", F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise(F.lit("")) if graphs else F.lit("")
    return triples.select(F.concat(F.lit("<"), F.col("s.value"), F.lit("> <"), F.col("p"), F.lit("> "), obj, g, F.lit(" .")).alias("value"))


def written(t: Tables, lines: DataFrame, ext: str, *by: str, **options: str) -> str:
    """Write lines as part files and give these the wanted suffix; returns the folder."""
    root = scratch_path(t.spark, "files")
    lines.write.options(**options).partitionBy(*by).text(root) if by else lines.write.options(**options).text(root)
    jpath = t.spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(root).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    found, parts = fs.listFiles(jpath(root), True), []
    while found.hasNext():
        parts.append(found.next().getPath())
    for p in parts:
        if p.getName().startswith("part-"):
            fs.rename(p, jpath(p.toString().replace(".txt", "." + ext, 1)))
    return root


def listed(t: Tables, root: str) -> list[str]:
    return [r["path"] for r in t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").collect()]


def customer_lines(t: Tables) -> DataFrame:
    return t("customer").select("c_mktsegment", F.concat_ws("|", "c_custkey", "c_name").alias("value"))


def per_folder(files: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", r"c_mktsegment=([^/]*)/", 1)
    body = F.col("content").cast("string")
    return files.groupBy(folder.alias("segment")).agg(
        F.sum(F.length("content")).alias("bytes"), F.sum(F.length(body) - F.length(F.replace(body, F.lit("\n")))).cast("bigint").alias("lines"))


SEGMENTS = """SELECT c_mktsegment AS segment, CAST({n} * sum(strlen(c_custkey || '|' || c_name) + 1) AS BIGINT) AS bytes,
              {n} * count(*) AS lines FROM customer GROUP BY c_mktsegment"""


def order_xml() -> Column:
    """One RDF/XML document per order."""
    head = (f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:c="urn:class/" xmlns:p="urn:p/"><c:order rdf:ID="_')
    return F.concat(F.lit(head), F.col("o_orderkey").cast("string"), F.lit('"><p:status>'), F.col("o_orderstatus"),
                    F.lit('</p:status><p:customer rdf:resource="urn:customer/'), F.col("o_custkey").cast("string"),
                    F.lit(f'"/>\n<p:total rdf:datatype="{XSD}decimal">'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
                    F.lit("</p:total></c:order></rdf:RDF>"))


def documents_of(df: DataFrame, key: str, ext: str, text: Column) -> DataFrame:
    """A files DataFrame with one document per row, spread like files of a scan would be."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    name = F.concat(F.col(key).cast("string"), F.lit("." + ext))
    return df.select(F.concat(F.lit("mem:/"), name).alias("path"), name.alias("filename"), text.cast("binary").alias("content"),
                     F.lit("tables").alias("source"))


ORDER_TRIPLES = """
    SELECT 'http://example.org/' || o_orderkey || '.xml#_' || o_orderkey AS subject,
           'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS predicate, 'urn:class/order' AS object FROM orders
    UNION ALL SELECT 'http://example.org/' || o_orderkey || '.xml#_' || o_orderkey, 'urn:p/status', o_orderstatus FROM orders
    UNION ALL SELECT 'http://example.org/' || o_orderkey || '.xml#_' || o_orderkey, 'urn:p/customer', 'urn:customer/' || o_custkey FROM orders
    UNION ALL SELECT 'http://example.org/' || o_orderkey || '.xml#_' || o_orderkey, 'urn:p/total',
              CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM orders"""


# --- sources ------------------------------------------------------------------------------------------

@query("scan_local_dir", SEGMENTS.format(n=1))
def _(t: Tables):
    return per_folder(scan_files(t.spark, written(t, customer_lines(t), "xml", "c_mktsegment")))


@query("scan_recursive", "SELECT 'deep' AS how, count(*) AS lines FROM customer UNION ALL SELECT 'flat', 0")
def _(t: Tables):
    root = written(t, customer_lines(t), "xml", "c_mktsegment")
    lines = lambda files, how: per_folder(files).agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).select(F.lit(how).alias("how"), "lines")
    return lines(scan_files(t.spark, root), "deep").union(lines(scan_files(t.spark, root, recursive=False), "flat"))


@query("scan_single_file", "SELECT 1 AS files, true AS same")
def _(t: Tables):
    root = written(t, customer_lines(t), "dat", "c_mktsegment")  # the name matches no pattern and needs none
    path = min(listed(t, root))
    one = scan_files(t.spark, path)
    lines = per_folder(one).agg(F.sum("lines").alias("lines"))
    direct = t.spark.read.text(path).agg(F.count(F.lit(1)).alias("direct"))
    found = one.agg(F.count("path").alias("files"), F.max(F.length("content") > 0).alias("filled"))
    same = lines.join(direct, F.col("lines") == F.col("direct"), "inner").select(F.lit(True).alias("same"))
    return found.join(same, F.col("filled") == F.col("same"), "left").select("files", F.col("same").isNotNull().alias("same"))


@query("scan_explicit_local", SEGMENTS.format(n=1))
def _(t: Tables):
    root = written(t, customer_lines(t), "dat", "c_mktsegment")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return per_folder(scan_files(t.spark, files=[*listed(t, root), root + "/missing.xml", root]))


@query("scan_explicit_plus_dir", SEGMENTS.format(n=2))
def _(t: Tables):
    root = written(t, customer_lines(t), "rdf", "c_mktsegment")
    return per_folder(scan_files(t.spark, root, files=listed(t, root)))


@query("scan_object_list", SEGMENTS.format(n=1))
def _(t: Tables):
    root = written(t, customer_lines(t), "xml", "c_mktsegment")
    parent, prefix = root.rsplit("/", 1)
    return per_folder(scan_store(t.spark, parent, prefix))


@query("scan_object_explicit", SEGMENTS.format(n=1))
def _(t: Tables):
    root = written(t, customer_lines(t), "xml", "c_mktsegment")
    parent, prefix = root.rsplit("/", 1)
    keys = [prefix + f.split(prefix, 1)[1] for f in listed(t, root)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the listing finds the same keys again; a key that is gone is skipped
        return per_folder(scan_store(t.spark, parent, prefix, files=[*keys, prefix + "/missing.xml"]))


@query("union_sources", SEGMENTS.format(n=2))
def _(t: Tables):
    root = written(t, customer_lines(t), "xml", "c_mktsegment")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return per_folder(union_sources(t.spark, lambda: scan_files(t.spark, root), lambda: scan_files(t.spark, root + "/none"),
                                        lambda: scan_files(t.spark, root, patterns=["part-*.xml"])))


def page_files(t: Tables) -> DataFrame:
    name = F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), -1)
    return t("pages").select(F.col("url").alias("path"), name.alias("filename"), F.col("html").cast("binary").alias("content"),
                             F.lit("pages").alias("source"))


PAGE_NAME = "split_part(regexp_replace(url, '[?#].*$', ''), '/', -1)"


@query("match_glob", rf"""
    SELECT url AS path, n LIKE '%.html' OR n LIKE '1__' AS some, true AS everything, regexp_matches(n, '^(.*[3-5]\.html|[3-5].*)$') AS class,
           regexp_matches(n, '^[^3-5].*$') AS negated, false AS malformed FROM (SELECT url, {PAGE_NAME} AS n FROM pages)""")
def _(t: Tables):
    f = F.col("filename")
    return page_files(t).select("path", match_glob(f, ["*.html", "1??", "[bad"]).alias("some"), match_glob(f, []).alias("everything"),
                                match_glob(f, ["*[3-5].html", "[3-5]*"]).alias("class"),
                                match_glob(f, ["[!3-5]*"]).alias("negated"), match_glob(f, ["[bad", "a***"]).alias("malformed"))


@query("filter_files", f"""
    SELECT url AS path, strlen(html) AS bytes FROM (SELECT url, html, {PAGE_NAME} AS n FROM pages)
    WHERE (n LIKE '%.html' OR n LIKE '_1%') AND NOT n LIKE '%5%'""")
def _(t: Tables):
    kept = filter_files(page_files(t), include=["*.html", "?1*"], exclude=["*5*", "__MACOSX/*"])
    return kept.select("path", F.length("content").cast("bigint").alias("bytes"))


# --- archives -----------------------------------------------------------------------------------------

def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few documents, as all of a batch are in memory with what is made of them."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _zip_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack every document into a zip of its own, with members that the default patterns take or leave."""
    for batch in _parts(batches):
        rows = batch.to_pylist()
        for r in rows:
            packed, data = io.BytesIO(), r["content"]
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(r["filename"], data)
                z.writestr("dir/" + r["filename"].replace(".xml", ".rdf"), data)
                z.writestr("notes.txt", b"no rdf")
                z.writestr("more.xml.gz", gzip.compress(data))
                z.writestr("empty/", b"")
            r.update(path=r["path"].replace(".xml", ".zip"), filename=r["filename"].replace(".xml", ".zip"), content=packed.getvalue())
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _gzip_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        rows = batch.to_pylist()
        for r in rows:
            r.update(path=r["path"] + ".gz", filename=r["filename"] + ".gz", content=gzip.compress(r["content"]))
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def order_documents(t: Tables) -> DataFrame:
    return documents_of(t("orders"), "o_orderkey", "xml", order_xml())


def member_rows(files: DataFrame) -> DataFrame:
    return files.select("path", "filename", F.md5("content").alias("digest"))


XML_SQL = f"""
    SELECT o_orderkey AS k, md5('<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:c="urn:class/" xmlns:p="urn:p/"><c:order rdf:ID="_' || o_orderkey
        || '"><p:status>' || o_orderstatus || '</p:status><p:customer rdf:resource="urn:customer/' || o_custkey || '"/>' || chr(10)
        || '<p:total rdf:datatype="{XSD}decimal">' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '</p:total></c:order></rdf:RDF>') AS digest
    FROM orders"""


@query("expand_zip", f"""
    SELECT 'mem:/' || k || '.zip:' || k || '.xml' AS path, k || '.xml' AS filename, digest FROM ({XML_SQL})
    UNION ALL SELECT 'mem:/' || k || '.zip:dir/' || k || '.rdf', k || '.rdf', digest FROM ({XML_SQL})""")
def _(t: Tables):
    packed = order_documents(t).mapInArrow(_zip_documents, FILES_DDL)
    return member_rows(archives.accepted(archives.expand_archives(packed)))


@query("expand_nested_gzip", f"""
    SELECT 'mem:/' || k || '.zip:more.xml.gz:decompressed' AS path, 'more.xml' AS filename, digest FROM ({XML_SQL})""")
def _(t: Tables):
    packed = order_documents(t).mapInArrow(_zip_documents, FILES_DDL)
    return member_rows(archives.accepted(archives.expand_archives(packed, patterns=["*.gz"])))


@query("expand_gzip", f"SELECT 'mem:/' || k || '.xml.gz:decompressed' AS path, k || '.xml' AS filename, digest FROM ({XML_SQL})")
def _(t: Tables):
    return member_rows(archives.accepted(archives.expand_archives(order_documents(t).mapInArrow(_gzip_documents, FILES_DDL))))


@query("expand_passthrough", f"SELECT 'mem:/' || k || '.xml' AS path, k || '.xml' AS filename, digest FROM ({XML_SQL})")
def _(t: Tables):
    return member_rows(archives.accepted(archives.expand_archives(order_documents(t), patterns=["*.rdf"])))


@query("corrupt_archives", "SELECT 'mem:/' || doc_id || '.zip' AS path, true AS failed FROM documents")
def _(t: Tables):
    broken = documents_of(t("documents"), "doc_id", "zip", F.col("text"))
    return archives.rejects(archives.expand_archives(broken)).select("path", F.col("error").isNotNull().alias("failed"))


# --- ingest -------------------------------------------------------------------------------------------

@query("detect_format", """
    SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'turtle' WHEN '2-HIGH' THEN 'ntriples' WHEN '3-MEDIUM' THEN 'nquads'
           WHEN '5-LOW' THEN 'trig' ELSE 'rdfxml' END AS format, count(*) AS n FROM orders GROUP BY 1""")
def _(t: Tables):
    ext = (F.when(F.col("o_orderpriority") == "1-URGENT", ".ttl").when(F.col("o_orderpriority") == "2-HIGH", ".nt")
           .when(F.col("o_orderpriority") == "3-MEDIUM", ".nq").when(F.col("o_orderpriority") == "5-LOW", ".trig")
           .when(F.col("o_orderstatus") == "F", ".XML").otherwise(".foo"))
    return t("orders").groupBy(ing.detect_format(F.concat(F.lit("x"), ext)).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("ingest_rdfxml", ORDER_TRIPLES)
def _(t: Tables):
    return graph_form(ing.ingest(order_documents(t)))


def _wrap_rdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the lines of a partition between the tags of an RDF root."""
    line = lambda text: pa.RecordBatch.from_pydict({"value": [text]})
    yield line(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:c="urn:class/" xmlns:p="urn:p/" xml:base="http://example.org/orders">')
    yield from batches
    yield line("</rdf:RDF>")


def order_files(t: Tables, n: int) -> str:
    """Folder of ``n`` RDF/XML files with all orders, four triples each."""
    text = lambda p, c: F.concat(F.lit(f"<p:{p}>"), F.col(c).cast("string"), F.lit(f"</p:{p}>\n"))
    node = F.concat(F.lit('<c:order rdf:ID="_'), F.col("o_orderkey").cast("string"), F.lit('">\n'), text("status", "o_orderstatus"),
                    text("priority", "o_orderpriority"), F.lit('<p:customer rdf:resource="urn:customer/'),
                    F.col("o_custkey").cast("string"), F.lit('"/>\n</c:order>'))
    lines = t("orders").repartition(n, "o_orderkey").select(node.alias("value")).mapInArrow(_wrap_rdf, "value string")
    return written(t, lines, "xml")


@query("ingest_rdfxml_split", """
    SELECT 'http://example.org/orders#_' || o_orderkey AS subject, 'urn:p/status' AS predicate, o_orderstatus AS object FROM orders
    UNION ALL SELECT 'http://example.org/orders#_' || o_orderkey, 'urn:p/priority', o_orderpriority FROM orders
    UNION ALL SELECT 'http://example.org/orders#_' || o_orderkey, 'urn:p/customer', 'urn:customer/' || o_custkey FROM orders
    UNION ALL SELECT 'http://example.org/orders#_' || o_orderkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:class/order' FROM orders""")
def _(t: Tables):
    return graph_form(ingest_rdfxml_split(t.spark, listed(t, order_files(t, 2))))


TEXT_TRIPLES = "SELECT 'urn:document/' || doc_id AS subject, 'urn:p/text' AS predicate, md5(text) AS object{g} FROM documents"


def text_triples(t: Tables) -> DataFrame:
    return graph(t).scan("urn:p/text")


@query("ingest_ntriples", TEXT_TRIPLES.format(g=""))
def _(t: Tables):
    root = written(t, line_of(text_triples(t)), "nt")
    return graph_form(ing.ingest_ntriples(t.spark, root)).withColumn("object", F.md5("object"))


@query("ingest_nquads", TEXT_TRIPLES.format(g=", 'urn:lang/' || lang AS g"))
def _(t: Tables):
    lang = graph(t).scan("urn:p/dlang").select(F.col("s.value").alias("k"), F.concat(F.lit("urn:lang/"), F.col("o.value")).alias("to"))
    quads = text_triples(t).join(lang, F.col("s.value") == F.col("k")).withColumn("g", F.col("to"))
    q = ing.ingest_nquads(t.spark, written(t, line_of(quads, graphs=True), "nq"))
    return q.select(lex(F.col("s")).alias("subject"), F.col("p").alias("predicate"), F.md5(lex(F.col("o"))).alias("object"), "g")


@query("ingest_line_documents", TEXT_TRIPLES.format(g=""))
def _(t: Tables):
    lines = line_of(text_triples(t)).withColumn("k", F.monotonically_increasing_id())
    return graph_form(ing.ingest(documents_of(lines, "k", "nt", F.col("value")))).withColumn("object", F.md5("object"))


TURTLE_SQL = """
    SELECT 'http://example.org/' || p_partkey || '.{ext}#it' AS subject, 'urn:p/name' AS predicate, p_name AS object{g} FROM part
    UNION ALL SELECT 'http://example.org/' || p_partkey || '.{ext}#it', 'urn:p/size', CAST(p_size AS VARCHAR){g} FROM part
    UNION ALL SELECT 'http://example.org/' || p_partkey || '.{ext}#it', 'urn:p/tag', p_brand{g} FROM part
    UNION ALL SELECT 'http://example.org/' || p_partkey || '.{ext}#it', 'urn:p/tag', p_type{g} FROM part"""


def part_turtle(block: Column | None = None) -> Column:
    body = F.concat(F.lit("<#it> p:name '"), F.col("p_name"), F.lit("' ; p:size "), F.col("p_size").cast("string"),
                    F.lit(' ;\n  p:tag """'), F.col("p_brand"), F.lit('""", "'), F.col("p_type"), F.lit('"@en . # done\n'))
    if block is not None:
        body = F.concat(block, F.lit(" { "), body, F.lit(" }"))
    return F.concat(F.lit("@prefix p: <urn:p/> .\n"), body)


@query("ingest_turtle", TURTLE_SQL.format(ext="ttl", g=""))
def _(t: Tables):
    return graph_form(ing.ingest(documents_of(t("part"), "p_partkey", "ttl", part_turtle())))


@query("ingest_trig", TURTLE_SQL.format(ext="trig", g=", 'urn:size/' || p_size AS g"))
def _(t: Tables):
    block = F.concat(F.lit("GRAPH <urn:size/"), F.col("p_size").cast("string"), F.lit(">"))
    q = ing.ingest(documents_of(t("part"), "p_partkey", "trig", part_turtle(block)))
    return q.select(lex(F.col("s")).alias("subject"), F.col("p").alias("predicate"), lex(F.col("o")).alias("object"), "g")


@query("resolve_base", """
    SELECT 'per_file' AS mode, 2 * count(*) AS subjects FROM customer UNION ALL SELECT 'shared', count(*) FROM customer""")
def _(t: Tables):
    def doc(attribute: str, ext: str):
        text = F.concat(F.lit(f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:p="urn:p/"><rdf:Description {attribute}_'), F.col("c_custkey").cast("string"),
                        F.lit('"><p:name>'), F.col("c_name"), F.lit("</p:name></rdf:Description></rdf:RDF>"))
        return documents_of(t("customer"), "c_custkey", ext, text)
    files = doc('rdf:ID="', "xml").unionByName(doc('rdf:about="#', "rdf"))
    count = lambda mode: ing.ingest(files, base_mode=mode).agg(F.countDistinct("s").alias("subjects")).select(F.lit(mode).alias("mode"), "subjects")
    return count("per_file").union(count("shared"))


def two_files(t: Tables) -> DataFrame:
    """Order statuses from file a, and again from file b together with the priorities."""
    g = graph(t)
    status, priority = g.scan("urn:p/status"), g.scan("urn:p/priority")
    return (status.withColumn("file", F.lit("a.nt")).unionByName(status.withColumn("file", F.lit("b.nt")))
            .unionByName(priority.withColumn("file", F.lit("b.nt"))))


@query("dedup_quads", """
    SELECT 'urn:order/' || o_orderkey AS subject, 'urn:p/status' AS predicate, o_orderstatus AS object FROM orders
    UNION ALL SELECT 'urn:order/' || o_orderkey, 'urn:p/priority', o_orderpriority FROM orders""")
def _(t: Tables):
    return graph_form(ing.dedup_quads(two_files(t)))


@query("load_stats", "SELECT 'a.nt' AS file, count(*) AS triples_loaded FROM orders UNION ALL SELECT 'b.nt', count(*) FROM orders UNION ALL SELECT 'c.nt', 0")
def _(t: Tables):
    files = t.spark.createDataFrame([("a.nt",), ("b.nt",), ("c.nt",)], "path string")
    return ing.load_stats(two_files(t), files)


@query("reject_policy", """
    SELECT 'mem:/' || o_orderkey || '.xml' AS file, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 4 END AS triples, o_orderstatus = 'P' AS bad FROM orders""")
def _(t: Tables):
    cut = F.when(F.col("o_orderstatus") == "P", F.replace(order_xml(), F.lit("</c:order>"))).otherwise(order_xml())
    q = ing.ingest(documents_of(t("orders"), "o_orderkey", "xml", cut), mode="reject")
    return q.groupBy("file").agg(F.count("s").alias("triples"), F.max(F.col("error").isNotNull()).alias("bad"))


@query("store_triples", "SELECT 'urn:p/status' AS p, count(*) AS n FROM orders UNION ALL SELECT 'urn:p/priority', count(*) FROM orders")
def _(t: Tables):
    stored = ing.store_triples(ing.dedup_quads(two_files(t)), scratch_path(t.spark, "triples"))
    count = lambda p: agg.group(triple_pattern(stored, "?s", p, "?o"), n=agg.count_star()).df.select(F.lit(p).alias("p"), "n")
    return count("urn:p/status").union(count("urn:p/priority"))


# --- sinks and jobs -----------------------------------------------------------------------------------

def document_rows(t: Tables) -> DataFrame:
    return select_form(bgp(graph(t), ("?d", P["text"], "?text"), ("?d", P["dlang"], "?lang")))


@query("sink_csv", "SELECT 'urn:document/' || doc_id AS d, md5(text) AS text, lang FROM documents")
def _(t: Tables):
    at = sink_csv(document_rows(t), scratch_path(t.spark, "csv"))
    back = t.spark.read.option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(at, schema="d string, text string, lang string")
    return back.where("d <> 'd'").withColumn("text", F.md5("text"))


@query("sink_csv_lines", '''
    SELECT 'customer,name' AS value UNION ALL SELECT 'urn:customer/' || c_custkey || ',"' || c_name || ', ""' || c_mktsegment || '"""' FROM customer''')
def _(t: Tables):
    a = bgp(graph(t), ("?customer", P["name"], "?n"), ("?customer", P["segment"], "?s"))
    named = select_form(a).select("customer", F.concat(F.col("n"), F.lit(', "'), F.col("s"), F.lit('"')).alias("name"))
    return t.spark.read.text(sink_csv(named, scratch_path(t.spark, "csv")))


@query("sink_json", "SELECT 'urn:document/' || doc_id AS d, md5(text) AS text, lang FROM documents")
def _(t: Tables):
    at = sink_json(document_rows(t), scratch_path(t.spark, "json"))
    return t.spark.read.schema("d string, text string, lang string").json(at).withColumn("text", F.md5("text"))


@query("sink_tsv", """
    SELECT 'o' || chr(9) || 'status' AS value UNION ALL SELECT 'urn:order/' || o_orderkey || chr(9) || o_orderstatus FROM orders""")
def _(t: Tables):
    return t.spark.read.text(sink_tsv(select_form(project(orders(t), "o", "status")), scratch_path(t.spark, "tsv")))


def document(t: Tables, at: str) -> DataFrame:
    """``value``: the lines of a written document."""
    return t.spark.read.text(at)


@query("sink_json_document", """
    SELECT '{' AS value, 1 AS n UNION ALL SELECT '  "type": "solutions",', 1 UNION ALL SELECT '  "variables": ["c", "name"],', 1
    UNION ALL SELECT '  "results": [', 1 UNION ALL SELECT '  ],', 1 UNION ALL SELECT '  "count": ' || count(*), 1 FROM customer
    UNION ALL SELECT '}', 1 UNION ALL SELECT 'rows without a comma', 1
    UNION ALL SELECT '{"c":"urn:customer/' || c_custkey || '","name":"' || c_name || '"}', 1 FROM customer""")
def _(t: Tables):
    rows = select_form(bgp(graph(t), ("?c", P["name"], "?name"), ("?c", P["segment"], "?s")), "c", "name")
    lines = document(t, sink_json(rows, scratch_path(t.spark, "json"), document=True))
    first = lines.where("startswith(value, '{\"')").select(F.lit("rows without a comma").alias("value"))
    return lines.select(F.regexp_replace("value", "^,", "").alias("value")).unionByName(first).groupBy("value").agg(
        F.count(F.lit(1)).cast("int").alias("n"))


@query("sink_csv_boolean", "SELECT 'result' AS value UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END FROM orders")
def _(t: Tables):
    return document(t, sink_csv(ask_form(orders(t)), scratch_path(t.spark, "csv")))


@query("sink_json_boolean", """
    SELECT '{' AS value UNION ALL SELECT '  "type": "boolean",' UNION ALL SELECT '}'
    UNION ALL SELECT '  "result": ' || CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END FROM orders""")
def _(t: Tables):
    return document(t, sink_json(ask_form(orders(t)), scratch_path(t.spark, "json")))


@query("sink_csv_graph", """
    SELECT 'subject,predicate,object' AS value UNION ALL SELECT 'urn:order/' || o_orderkey || ',urn:p/is,' || o_orderstatus FROM orders""")
def _(t: Tables):
    return document(t, sink_csv(construct_form(orders(t), [("?o", P["is"], "?status")]), scratch_path(t.spark, "csv")))


@query("sink_json_graph", """
    SELECT 'urn:order/' || o_orderkey AS subject, 'urn:p/is' AS predicate, o_orderstatus AS object FROM orders""")
def _(t: Tables):
    lines = document(t, sink_json(construct_form(orders(t), [("?o", P["is"], "?status")]), scratch_path(t.spark, "json"), document=True))
    rows = lines.select(F.regexp_replace("value", "^,", "").alias("value")).where("startswith(value, '{\"')")
    return rows.select(F.from_json("value", "subject string, predicate string, object string").alias("r")).select("r.*")


@query("sink_metadata", """
    SELECT 'files_loaded: 1' AS value UNION ALL SELECT 'result_count: ' || count(*) FROM orders
    UNION ALL SELECT 'triples_loaded: ' || 2 * count(*) FROM orders""")
def _(t: Tables):
    triples = ing.dedup_quads(two_files(t)).agg(F.count(F.lit(1)).alias("triples_loaded"), F.countDistinct("s").alias("result_count"))
    meta = triples.select(F.lit("job").alias("pipeline_name"), F.current_timestamp().alias("timestamp"), F.lit(1).cast("bigint").alias("files_loaded"),
                          "triples_loaded", F.lit(850).cast("bigint").alias("load_time_ms"), F.lit(7).cast("bigint").alias("query_time_ms"), "result_count")
    lines = t.spark.read.text(sink_metadata(meta, scratch_path(t.spark, "meta")))
    return lines.where(F.col("value").rlike("^(files_loaded|triples_loaded|result_count): "))


@query("run_job", "SELECT 'urn:customer/' || o_custkey AS c, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY o_custkey")
def _(t: Tables):
    root, out = written(t, line_of(graph(t).scan("urn:p/customer").unionByName(graph(t).scan("urn:p/status"))), "nt", compression="gzip"), scratch_path(t.spark, "out")
    spec = {"pipeline": {"name": "orders"}, "sources": [{"type": "local", "path": root, "patterns": ["*.gz"]}],
            "processors": [{"type": "unzip", "patterns": ["*.nt"]}, {"type": "filter", "include": ["part-*"]}],
            "output": {"dir": out, "formats": ["csv"], "metadata": True}}
    run_job(t.spark, spec, lambda q: select_form(order_by(agg.group(bgp(q, ("?o", P["customer"], "?c")), ["c"], n=agg.count_star()), "c")))
    return t.spark.read.text(f"{out}/*.csv").where("value <> 'c,n'").select(
        F.split("value", ",")[0].alias("c"), F.split("value", ",")[1].alias("n"))


@query("run_job_rdfxml", """
    SELECT 'urn:customer/' || o_custkey AS c, CAST(count(*) AS VARCHAR) AS n, (SELECT CAST(4 * count(*) AS BIGINT) FROM orders) AS triples
    FROM orders GROUP BY o_custkey""")
def _(t: Tables):
    """A whole job on its main format: two RDF/XML files, each cut into pieces."""
    out = scratch_path(t.spark, "out")
    spec = {"pipeline": {"name": "orders"}, "sources": [{"type": "local", "path": order_files(t, 2)}], "query": {"split_bytes": 1 << 16},
            "output": {"dir": out, "formats": ["csv"], "metadata": True}}
    meta = run_job(t.spark, spec, lambda q: select_form(order_by(agg.group(bgp(q, ("?o", P["customer"], "?c")), ["c"], n=agg.count_star()), "c")))
    return t.spark.read.text(f"{out}/*.csv").where("value <> 'c,n'").select(
        F.split("value", ",")[0].alias("c"), F.split("value", ",")[1].alias("n")).crossJoin(meta.select(F.col("triples_loaded").alias("triples")))
