"""RDF files to triples.

``ingest`` reads any mix of formats in one pass over the files.  RDF/XML, Turtle and TriG documents are parsed
by Python inside the tasks, a document at a time; N-Triples and N-Quads lines are parsed by Catalyst, and plain
files of these two can be read split by split (``ingest_ntriples``, ``ingest_nquads``).
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator, Sequence
from xml.parsers.expat import ExpatError

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import LANG_STRING, RDF, STRING, TERM_DDL, XSD, make
from ..operators.graph import StoredGraph, subject_key
from ..session import bound_batches
from . import rdfxml, turtle
from .rdfxml import RdfError

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE_IRI = "http://example.org/"
QUAD = ["s", "p", "o", "g"]
FLAT_DDL = ("sk string, sv string, p string, ok string, ov string, od string, ol string, g string, "
            "file string, line string, format string, error string")
FLAT_NAMES = [c.split()[0] for c in FLAT_DDL.split(", ")]
ARROW_SCHEMA = pa.schema([(n, pa.string()) for n in FLAT_NAMES])
BATCH_TRIPLES = 50_000
LINE_FORMATS = ("ntriples", "nquads")


def detect_format(filename: Column) -> Column:
    """Format by suffix, case-sensitive; anything unknown is RDF/XML."""
    return (F.when(filename.endswith(".ttl"), "turtle").when(filename.endswith(".nt"), "ntriples")
            .when(filename.endswith(".nq"), "nquads").when(filename.endswith(".trig"), "trig").otherwise("rdfxml"))


def resolve_base(filename: Column, base_iri: str = BASE_IRI, base_mode: str = "per_file") -> Column:
    """Base IRI of a document: ``base_iri + filename``, or one base for all files with ``base_mode="shared"``."""
    if base_mode not in ("per_file", "shared"):
        raise ValueError(f"unknown base_mode {base_mode!r}")
    return F.concat(F.lit(base_iri), filename) if base_mode == "per_file" else F.lit(base_iri)


class _Rows:
    """What the documents of a task gave so far: triples, and lines that Catalyst still has to parse (or errors)."""

    def __init__(self):
        self.triples: list[tuple] = []  # (subject, predicate, object, graph); terms are (kind, value, datatype, language)
        self.ends: list[tuple[str, int]] = []  # file and number of triples up to its end
        self.lines: list[tuple] = []  # (file, line, format, error)

    def end_file(self, file: str):
        if len(self.triples) > (self.ends[-1][1] if self.ends else 0):
            self.ends.append((file, len(self.triples)))

    def batches(self, file: str | None = None, least: int = 1) -> Iterator[pa.RecordBatch]:
        """Hand over what is there, if it is worth a batch; ``file`` is the one being read."""
        if len(self.triples) >= least:
            if file is not None:
                self.end_file(file)
            sk, sv, _, _ = zip(*[t[0] for t in self.triples])
            ok, ov, od, ol = zip(*[t[2] for t in self.triples])
            files, start = [], 0
            for name, end in self.ends:
                files.extend([name] * (end - start))
                start = end
            known = dict(sk=sk, sv=sv, p=[t[1] for t in self.triples], ok=ok, ov=ov, od=od, ol=ol,
                         g=[t[3] for t in self.triples], file=files)
            yield _batch(len(files), known)
            self.triples.clear()
            self.ends.clear()
        if len(self.lines) >= least:
            yield _batch(len(self.lines), dict(zip(("file", "line", "format", "error"), zip(*self.lines))))
            self.lines.clear()


def _batch(n: int, known: dict) -> pa.RecordBatch:
    none = pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays([pa.array(known[c], pa.string()) if c in known else none for c in FLAT_NAMES],
                                      schema=ARROW_SCHEMA)


def _document(rows: _Rows, file: str, data: bytes, fmt: str, base: str, part: str):
    """Read one document (or a part of one) into ``rows``; pauses often enough for the caller to empty them."""
    scope = hashlib.sha1(file.encode()).hexdigest()[:20]
    if fmt in LINE_FORMATS:
        text = data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        rows.lines.extend((file, line, fmt, None) for line in text.split("\n"))
    elif fmt == "rdfxml":
        yield from rdfxml.parse(data, base, scope, rows.triples.append, part)
    else:
        yield from turtle.parse(data, base, scope, rows.triples.append, graphs=fmt == "trig")


def _parser(failfast: bool, lines: bool = True):
    def parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            for file, data, fmt, base, part in zip(*[batch.column(i) for i in range(5)]):
                file, before = file.as_py(), len(rows.triples)
                try:
                    if not lines and fmt.as_py() in LINE_FORMATS:
                        raise RdfError("a line format, which lines=False rules out")
                    for _ in _document(rows, file, data.as_py(), fmt.as_py(), base.as_py(), part.as_py()):
                        if failfast and len(rows.triples) >= BATCH_TRIPLES:
                            yield from rows.batches(file)
                except (ExpatError, RdfError, UnicodeDecodeError, RecursionError) as e:
                    if failfast:
                        raise ValueError(f"{file}: {e}") from e
                    del rows.triples[before:]  # all of a document or none of it
                    rows.lines.append((file, None, None, str(e)))
                rows.end_file(file)
                yield from rows.batches(least=BATCH_TRIPLES)
        yield from rows.batches()
    return parse_files


def ingest(files: DataFrame, base_iri: str = BASE_IRI, base_mode: str = "per_file", mode: str = "failfast",
           lines: bool = True) -> DataFrame:
    """Triples ``s, p, o, g, file`` of all files, duplicates included.

    ``lines=False`` says that no file is N-Triples or N-Quads (one that is counts as broken): the plan then holds no
    line parser and runs faster.

    ``mode="failfast"`` ends the job at the first document that cannot be parsed and names it; with ``"reject"``
    such documents (lines, for N-Triples and N-Quads) become rows with an ``error`` and no triple.
    """
    if mode not in ("failfast", "reject"):
        raise ValueError(f"unknown mode {mode!r}")
    return parse_documents(files.select(
        "path", "content", detect_format(F.col("filename")).alias("format"),
        resolve_base(F.col("filename"), base_iri, base_mode).alias("base"), F.lit("").alias("part")), mode, lines)


def parse_documents(documents: DataFrame, mode: str, lines: bool = True) -> DataFrame:
    """Triples of ``path, content, format, base, part`` rows; ``part`` names a piece of a document, '' the whole."""
    bound_batches(documents.sparkSession)
    flat = documents.mapInArrow(_parser(mode == "failfast", lines), FLAT_DDL)
    if not lines:
        return _finish(flat, mode)
    flat = flat.where(F.col("line").isNull() | ~F.col("line").rlike(RX_BLANK))
    quads, is_line = F.col("format") == "nquads", F.col("line").isNotNull()
    rows = flat.withColumn("cut", F.when(is_line, cut_line(F.col("line"), True)))
    fields = line_fields(F.col("cut"), F.substring(F.sha1("file"), 1, 20))
    picked = [F.when(is_line, f).otherwise(F.col(n)).alias(n) for n, f in fields.items()]
    valid = F.when(quads, line_ok(F.col("line"), True)).otherwise(line_ok(F.col("line"), False))
    error = F.coalesce(F.col("error"), F.when(is_line & ~valid, F.concat(F.lit("bad line: "), "line")))
    return _finish(rows.select(*picked, "file", error.alias("error")), mode)


def _finish(rows: DataFrame, mode: str) -> DataFrame:
    s = make(F.col("sk"), F.col("sv"), F.lit(""), F.lit(""))
    o = make(F.col("ok"), F.col("ov"), F.col("od"), F.col("ol"))
    good = F.col("error").isNull()
    if mode == "failfast":  # as a filter, so that no column pruning can lose the check
        stop = F.raise_error(F.concat(F.col("file"), F.lit(": "), F.col("error"))).cast("boolean")
        return rows.where(F.when(good, True).otherwise(stop)).select(s.alias("s"), "p", o.alias("o"), "g", "file")
    return rows.select(F.when(good, s).alias("s"), F.when(good, F.col("p")).alias("p"), F.when(good, o).alias("o"),
                       F.when(good, F.col("g")).alias("g"), "file", "error")


# --- line formats, in Catalyst ------------------------------------------------------------------------

# The grammar of a line, as one pattern.  Possessive loops keep long literals off the Java stack.
RX_BLANK = r"^\s*(#.*)?$"
RX_NODE = r'(?:<([^<>"{}|^`\s]*+)>|_:([^\s<>"]+?))'
RX_TRIPLE = (r'^\s*' + RX_NODE + r'\s*<([^<>"{}|^`\s]*+)>\s*(?:<([^<>"{}|^`\s]*+)>|_:([^\s<>"]+?)|'
             r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^<>"\s]*+)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*+))?+)')
RX_END = r'\s*\.\s*(?:#.*)?$'
RX_LINE = {False: RX_TRIPLE + RX_END, True: RX_TRIPLE + r'\s*' + RX_NODE + "?" + RX_END}
SEP = "\u0001"


def _unescape(s: Column) -> Column:
    """N-Triples escapes: made JSON ones, then read as JSON; only for text that holds a backslash."""
    pairs = F.regexp_replace(s, r"\\\\", r"\\u005c")
    pieces = F.split(F.replace(pairs, F.lit("\\'"), F.lit("'")), r"\\U")
    astral = lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, 8)), "UTF-32"), F.substring(x, 9, 1 << 30))
    joined = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(astral(x))), "")
    body = F.concat(F.lit('{"v":"'), F.replace(F.replace(joined, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")), F.lit('"}'))
    return F.when(s.contains("\\"), F.from_json(body, "v string")["v"]).otherwise(s)


def line_ok(line: Column, quads: bool) -> Column:
    return line.rlike(RX_LINE[quads])


def cut_line(line: Column, quads: bool) -> Column:
    """The groups of a valid line as an array: matched once, cut apart at a control character, the literal text last.

    Keep the result in a column of its own: all fields are read from it.
    """
    groups = [1, 2, 3, 4, 5, 7, 8, *([9, 10] if quads else []), 6]
    return F.split(F.regexp_replace(line, RX_LINE[quads], SEP.join(f"${g}" for g in groups)), SEP, len(groups))


def line_fields(cut: Column, scope: Column, quads: bool = True) -> dict[str, Column]:
    """Flat term fields of a cut N-Triples or N-Quads line."""
    s_iri, s_blank, p, o_iri, o_blank, dt, tag = [F.get(cut, F.lit(i)) for i in range(7)]
    text = F.get(cut, F.lit(9 if quads else 7))
    g_iri, g_blank = F.get(cut, F.lit(7)), F.get(cut, F.lit(8))
    label = lambda x: F.concat(scope, F.lit("n"), x)
    literal = (o_iri == "") & (o_blank == "")
    short = (F.when(dt.startswith(XSD), F.concat(F.lit("xsd:"), F.substring(dt, len(XSD) + 1, 1 << 20)))
             .when(dt == RDF + "langString", LANG_STRING).otherwise(dt))
    return {
        "sk": F.when(s_iri != "", "iri").otherwise("bnode"),
        "sv": F.when(s_iri != "", _unescape(s_iri)).otherwise(label(s_blank)),
        "p": _unescape(p),
        "ok": F.when(literal, "lit").when(o_iri != "", "iri").otherwise("bnode"),
        "ov": F.when(literal, _unescape(text)).when(o_iri != "", _unescape(o_iri)).otherwise(label(o_blank)),
        "od": F.when(tag != "", LANG_STRING).when(dt != "", short).when(literal, STRING).otherwise(""),
        "ol": F.lower(tag),
        "g": F.lit("") if not quads else F.when(g_iri != "", _unescape(g_iri)).when(g_blank != "", F.concat(F.lit("_:"), label(g_blank))).otherwise(""),
    }


def ingest_lines(lines: DataFrame, quads: bool, mode: str = "failfast") -> DataFrame:
    """Triples of a DataFrame ``line, file`` of N-Triples (or N-Quads) lines; pure Catalyst, so any split works.

    The reader of lines may be :data:`.files.LINES` of any scan."""
    line = F.col("line")
    # Spark's text reader hands on bytes as they are
    error = F.when(~F.is_valid_utf8(line) | ~line_ok(line, quads), F.concat(F.lit("bad line: "), F.make_valid_utf8(line)))
    body = lines.where(~line.rlike(RX_BLANK)).withColumns({"error": error, "cut": cut_line(line, quads)})
    fields = line_fields(F.col("cut"), F.substring(F.sha1("file"), 1, 20), quads)
    return _finish(body.select(*[f.alias(n) for n, f in fields.items()], "file", "error"), mode)


def _text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text([paths] if isinstance(paths, str) else list(paths)).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def ingest_ntriples(spark: SparkSession, paths: str | Sequence[str], mode: str = "failfast") -> DataFrame:
    return ingest_lines(_text_lines(spark, paths), False, mode)


def ingest_nquads(spark: SparkSession, paths: str | Sequence[str], mode: str = "failfast") -> DataFrame:
    return ingest_lines(_text_lines(spark, paths), True, mode)


# --- quad sets ----------------------------------------------------------------------------------------

def accepted(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("error").isNull()).drop("error")


def rejected(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("error").isNotNull()).select("file", "error")


def dedup_quads(triples: DataFrame) -> DataFrame:
    """The quad set: equal quads of all files once."""
    return triples.select(*QUAD).dropDuplicates()


def load_stats(triples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Quads each file was the first to bring, files in path order; ``files`` adds those that brought none."""
    first = triples.groupBy(*QUAD).agg(F.min("file").alias("file"))
    stats = first.groupBy("file").agg(F.count(F.lit(1)).alias("triples_loaded"))
    if files is None:
        return stats
    names = files.select(F.col("path").alias("file")).distinct()
    return names.join(stats, "file", "left").select("file", F.coalesce("triples_loaded", F.lit(0)).alias("triples_loaded"))


def load_totals(triples: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files loaded and distinct quads loaded."""
    stats = load_stats(triples, files)
    return stats.agg(F.count(F.lit(1)).alias("files_loaded"), F.coalesce(F.sum("triples_loaded"), F.lit(0)).alias("triples_loaded"))


def store_triples(triples: DataFrame, path: str) -> DataFrame:
    """Write triples as parquet partitioned by predicate and return the stored table.

    A constant predicate then reads only its own folder.  The rebalance gives each task few predicates, and splits
    one that holds much of the data (``rdf:type``) over many tasks.
    """
    by_predicate(triples).write.partitionBy("p").parquet(path)
    return triples.sparkSession.read.schema(triples.schema).parquet(path).select(*triples.columns)


def by_predicate(triples: DataFrame) -> DataFrame:
    return triples.hint("rebalance", "p")


def store_by_subject(triples: DataFrame, path: str, buckets: int | None = None) -> StoredGraph:
    """Write triples as a table partitioned by predicate and bucketed by subject, and return it as a graph.

    Joins on subjects then need no shuffle.  Each bucket of a predicate is written by one task as one file, so ``buckets`` (the
    session's shuffle partitions by default) should grow with the data; ``rdf:type`` is divided like any other predicate."""
    spark = triples.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = triples.select(*QUAD, subject_key(F.col("s")).alias("k"))
    dealt = rows.repartition("p", F.expr(f"pmod(hash(k), {n})"))  # as the buckets are dealt
    name = f"tripleweave_{uuid.uuid4().hex}"
    dealt.write.format("parquet").partitionBy("p").bucketBy(n, "k").sortBy("k").option("path", path).saveAsTable(name)
    return StoredGraph(spark.table(name))


def open_by_subject(spark: SparkSession, path: str, buckets: int) -> StoredGraph:
    """A graph that :func:`store_by_subject` wrote, in another session."""
    name = f"tripleweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (s {TERM_DDL}, o {TERM_DDL}, g STRING, k STRING, p STRING) USING parquet PARTITIONED BY (p) "
              f"CLUSTERED BY (k) SORTED BY (k) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return StoredGraph(spark.table(name))
