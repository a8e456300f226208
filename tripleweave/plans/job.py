"""The job driver: sources -> processors -> ingest -> query -> sinks and run metadata."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import assign_graph
from ..operators.forms import default_query
from ..session import counted, in_order, rows_seen, scratch_path, scratch_scope, tune
from ..sources import archives, split
from ..sources.files import LINES, SIZED, Form, any_glob, filter_files, scan_azure, scan_files, scan_gcs, scan_s3, union_sources
from ..sources.ingest import BASE_IRI, LINE_FORMATS, QUAD, detect_format, ingest, ingest_lines, store_triples
from .sinks import META_DDL, sink_csv, sink_json, sink_metadata, sink_tsv

SCANS = {"local": scan_files, "s3": scan_s3, "azure": scan_azure, "gcs": scan_gcs}
SPLIT_BYTES = 32 << 20  # RDF/XML files from this size on are read in pieces
NAMES = 10_000  # files that turn out not to be divisible and are then read by name
SINKS = {"csv": sink_csv, "json": sink_json, "tsv": sink_tsv, "terminal": sink_tsv}


def _process(files: DataFrame, processors: list[dict], lines: Sequence[str] = ()) -> DataFrame:
    for i, step in enumerate(processors):
        options = {k: v for k, v in step.items() if k != "type"}
        if step["type"] == "unzip":
            # no later step takes an inflated text apart as an archive, so one of lines may come in pieces
            last = not any(later["type"] == "unzip" for later in processors[i + 1:])
            files = archives.accepted(archives.expand_archives(files, **options, lines=lines if last else ()))
        elif step["type"] == "filter":
            files = filter_files(files, **options)
        else:
            raise ValueError(f"unknown processor {step['type']!r}")
    return files


def _loader(spark: SparkSession, source: dict, form: Form) -> Callable[[], DataFrame]:
    options = {k: v for k, v in source.items() if k not in ("type", "graph")}
    return partial(SCANS[source["type"]], spark, **options, form=form)


def _divisible(processors: list[dict], fmt: str) -> Column:
    """Files that Spark can read in pieces: of this format by suffix, and no archives to a processor."""
    name = F.col("filename")
    archive = [p for step in processors for k in ("archive_patterns", "gzip_patterns") for p in step.get(k, ())]
    found = detect_format(name) == fmt
    if fmt == "rdfxml":  # the format of any other suffix, also of archives
        found = found & (name.endswith(".xml") | name.endswith(".rdf"))
    return found & ~any_glob(name, archive)


def _large_documents(files: DataFrame, texts: DataFrame, base: tuple[str, str]) -> DataFrame:
    """Triples of large RDF/XML files, given whole and as records: cut into pieces where they can be, else read whole.

    Only names of the latter come to the driver, where they choose the files to open; if there are more than ``NAMES``, a join does."""
    texts = split.records(texts)
    depths, found = split.block_sums(texts)
    triples = split.parse_pieces(split.cut_documents(texts, depths, found), *base)
    others = found.where("NOT (splittable AND whole)").select("file")
    names = [r["file"] for r in others.limit(NAMES + 1).collect()]
    if not names:
        return triples
    if len(names) <= NAMES:
        rest = files.where(F.col("path").isin(names))
    else:
        rest = files.join(others, F.col("path") == F.col("file"), "left_semi")
    return triples.unionByName(ingest(rest, *base, lines=False))


def load(spark: SparkSession, spec: dict) -> tuple[DataFrame, int, int] | None:
    """The stored quad set of a job with its file and quad counts; None if there are no files.

    Plain N-Triples and N-Quads files are read as text, so that many tasks share a large one, and so are RDF/XML files of
    ``split_bytes`` or more (None: none are).  All other files are parsed whole, once: their number is observed before the parser, the distinct quads
    while they are written.  Which reader takes a file is a filter on its name and size, so no list of files is made.
    """
    sources, processors = spec.get("sources", []), spec.get("processors", [])
    query = spec.get("query", {})
    base = query.get("base_iri", BASE_IRI), query.get("base_mode", "per_file")
    lines, least = query.get("lines", True), query.get("split_bytes", SPLIT_BYTES)
    readers = {fmt: (LINES, _divisible(processors, fmt)) for fmt in LINE_FORMATS if lines}
    if least is not None:
        readers["rdfxml"] = split.RECORDS, _divisible(processors, "rdfxml") & (F.col("size") >= least)
    names = [step for step in processors if step["type"] != "unzip"]  # an unzip step passes plain files on
    unzips = len(names) < len(processors)
    divided = 0
    by_graph: dict[str, list[dict]] = {}
    for s in sources:
        by_graph.setdefault(s.get("graph", ""), []).append(s)
    parts, counters = [], []
    for graph, members in by_graph.items():
        files = union_sources(spark, *[_loader(spark, s, SIZED) for s in members], form=SIZED)
        taken = reduce(Column.__or__, [pick for _, pick in readers.values()], F.lit(False))
        members_of = _process(files.where(~taken).drop("size"), processors, (".nt", ".nq") if lines else ())
        whole, seen = counted(members_of, archives.is_first(F.col("path")))
        whole = whole.withColumn("path", archives.whole_path(F.col("path")))
        counters.append((seen, members_of.where(archives.is_first(F.col("path")))))
        # line formats can only come out of archives now
        found = [ingest(whole, *base, lines=lines and unzips).select(*QUAD)]
        for fmt, (form, pick) in readers.items():
            # the files themselves are counted, without a look at their content; a reader without files is left out
            mine = _process(files.where(pick), names)
            n = mine.count()
            divided += n
            if not n:
                continue
            texts = _process(union_sources(spark, *[_loader(spark, s, form) for s in members], form=form).where(pick), names)
            if fmt == "rdfxml":
                triples = _large_documents(mine, texts, base)
            else:
                triples = ingest_lines(texts.select(F.col("text").cast("string").alias("line"), F.col("path").alias("file")), fmt == "nquads")
            found.append(triples.select(*QUAD))
        triples = reduce(DataFrame.unionByName, found)
        parts.append(assign_graph(triples, graph) if graph else triples)
    if not parts:
        return None
    quads, written = counted(reduce(DataFrame.unionByName, parts).dropDuplicates())
    stored = store_triples(quads, scratch_path(spark, "quads"))
    files_loaded, triples_loaded = divided + sum(rows_seen(*c) for c in counters), rows_seen(written, stored)
    if not files_loaded:
        return None
    return stored, files_loaded, triples_loaded


def run_job(spark: SparkSession, spec: dict, query: Callable[[DataFrame], DataFrame] = default_query) -> DataFrame:
    """Run a job given as a dict and return its one-row run metadata.

    ``spec`` holds ``pipeline: {name}``, ``sources: [{type, graph?, ...}]``, ``processors: [{type, ...}]``,
    ``query: {base_iri, base_mode, lines, split_bytes}`` and ``output: {dir, formats, metadata, prefix, document}``; the options of
    sources and processors are the arguments of the functions they name.  ``query`` maps the triples to the result.
    ``document`` makes JSON one document instead of lines.
    No files is a success without output.  A sink that fails is warned about.  Scratch tables are deleted at the end.
    """
    with scratch_scope(tune(spark)):
        return _run(spark, spec, query)


def _run(spark: SparkSession, spec: dict, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    name, out, at = spec.get("pipeline", {}).get("name", "default"), spec.get("output", {}), datetime.now(timezone.utc)
    start = time.monotonic()
    loaded = load(spark, spec)
    load_ms = int((time.monotonic() - start) * 1000)
    if loaded is None:
        warnings.warn("no files to load")
        return spark.createDataFrame([(name, at, 0, 0, load_ms, 0, 0)], META_DDL)
    triples, files_loaded, triples_loaded = loaded
    start = time.monotonic()
    result = in_order(query(triples))  # shared by the sinks, not lost with an executor, and still sorted
    count = result.count()
    query_ms = int((time.monotonic() - start) * 1000)
    meta = spark.createDataFrame([(name, at, files_loaded, triples_loaded, load_ms, query_ms, count)], META_DDL)
    prefix = out.get("prefix") or "results"
    options = {"json": {"document": out.get("document", False)}}
    writers = [partial(SINKS[f], result, out["dir"], prefix, at=at, **options.get(f, {}))
               for f in out.get("formats", ["csv"])] if "dir" in out else []
    if "dir" in out and out.get("metadata", True):
        writers.append(partial(sink_metadata, meta, out["dir"], prefix, at=at))
    for write in writers:
        try:
            write()
        except Exception as e:  # one failing sink does not lose the others
            warnings.warn(f"sink failed: {e}")
    return meta
