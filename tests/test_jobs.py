import csv
import gzip
import io
import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tripleweave.functions.terms import IRI
from tripleweave.operators.forms import select_form
from tripleweave.operators.modifiers import order_by
from tripleweave.operators.patterns import bgp, values
from tripleweave.plans import job
from tripleweave.plans.sinks import sink_csv, sink_json, sink_tsv
from tripleweave.session import scratch_root
from tripleweave.sources.ingest import ingest_ntriples

AT = datetime(2026, 3, 4, 12, 0, 1, tzinfo=timezone.utc)
CIM = "http://harbour.example/terms#"
MODEL = (f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:cim="{CIM}">' + "".join(
    f'<cim:Pier rdf:ID="_{n}"><cim:Place.title>Quay of {n}</cim:Place.title></cim:Pier>'
    for n in ("Tern", "Gull", "Heron")) + "</rdf:RDF>").encode()


def cells(spark, *texts):
    return select_form(values(spark, ["v", "w"], [(t, None) for t in texts]))


def whole(folder):
    """The document that the part files make up; a result of one row is one file."""
    parts = sorted(Path(folder).glob("part-*")) if Path(folder).is_dir() else [Path(folder)]
    return "".join(p.read_bytes().decode() for p in parts)


def names(q):
    return select_form(order_by(bgp(q, ("?s", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", IRI(CIM + "Pier")),
                                    ("?s", CIM + "Place.title", "?name")), "name"), "name")


def test_csv(spark, tmp_path):
    texts = ["plain", "a, b", 'say "x', "two\nlines", "cr\rhere", ""]
    at = sink_csv(cells(spark, *texts), str(tmp_path), at=AT)
    assert at == f"{tmp_path}/results_20260304_120001.csv"
    raw = whole(at)
    assert raw.startswith("v,w\n") and 'plain,\n' in raw and '"a, b",\n' in raw and '"say ""x",\n' in raw and "cr\rhere,\n" in raw
    assert sorted(r[0] for r in csv.reader(io.StringIO(raw.replace("\r", "~"))))[1:] == sorted(["plain", "a, b", 'say "x', "two\nlines", "cr~here", "v"])


def test_csv_keeps_empty_lines_and_order(spark, tmp_path):
    one = select_form(values(spark, ["x"], [(None,), ("b",), ("a",)]))
    assert sorted(whole(sink_csv(one, str(tmp_path), "one")).split("\n")) == ["", "", "a", "b", "x"]
    many = select_form(order_by(values(spark, ["x"], [(i,) for i in (5, 30, 1, 22, 9)]), "x"))
    folder = sink_csv(many, str(tmp_path), "many", at=AT)
    parts = sorted((tmp_path / "many_20260304_120001.csv").glob("part-*"))
    assert folder.endswith("many_20260304_120001.csv") and "".join(p.read_text() for p in parts) == "x\n1\n5\n9\n22\n30\n"


def test_csv_of_graph_and_boolean(spark, tmp_path):
    graph = spark.createDataFrame([("s", "p", "a,b")], "subject string, predicate string, object string")
    assert whole(sink_csv(graph, str(tmp_path), "g")) == 'subject,predicate,object\ns,p,"a,b"\n'
    assert whole(sink_csv(graph, str(tmp_path), "c", compat=True)) == "subject,predicate,object\ns,p,a,b\n"
    answer = spark.createDataFrame([(True,)], "result boolean")
    assert whole(sink_csv(answer, str(tmp_path), "b")) == "result\ntrue\n"
    assert json.loads(whole(sink_json(answer, str(tmp_path), "b"))) == {"type": "boolean", "result": True}


def test_json(spark, tmp_path):
    texts = ["c:\\dir", 'say "x', "line\nfeed"]
    doc = json.loads(whole(sink_json(cells(spark, *texts), str(tmp_path), document=True)))
    assert doc["type"] == "solutions" and doc["variables"] == ["v", "w"] and doc["count"] == 3
    assert sorted(r["v"] for r in doc["results"]) == sorted(texts) and all(r["w"] == "" for r in doc["results"])
    folder = sink_json(cells(spark, *texts), str(tmp_path), "lines", at=AT)
    lines = [json.loads(x) for p in (tmp_path / "lines_20260304_120001.json").glob("part-*") for x in p.read_text().splitlines()]
    assert folder.endswith(".json") and sorted(r["v"] for r in lines) == sorted(texts)
    graph = spark.createDataFrame([("s", "p", "o")], "subject string, predicate string, object string")
    assert json.loads(whole(sink_json(graph, str(tmp_path), "g", True))) == {
        "type": "graph", "triples": [{"subject": "s", "predicate": "p", "object": "o"}], "count": 1}
    empty = select_form(values(spark, ["x"], []))
    assert json.loads(whole(sink_json(empty, str(tmp_path), "e", True))) == {"type": "solutions", "variables": ["x"], "results": [], "count": 0}


def test_tsv(spark, tmp_path):
    assert whole(sink_tsv(cells(spark, "a,b"), str(tmp_path))) == "v\tw\na,b\t\n"


def test_sorted_document_of_many_parts(spark, tmp_path):
    """Rows of many partitions: one comma between any two, in the order of the sort, with their count."""
    df = spark.range(1000).repartition(7).withColumn("x", F.format_string("%04d", "id")).select("x").repartitionByRange(5, "x").sortWithinPartitions("x")
    folder = sink_json(df, str(tmp_path), "many", document=True)
    assert len(list(Path(folder).glob("part-*"))) == 7
    doc = json.loads(whole(folder))
    assert [r["x"] for r in doc["results"]] == [f"{i:04d}" for i in range(1000)] and doc["count"] == 1000


def test_job(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "model_EQ.xml").write_bytes(MODEL)
    (src / "again_EQ.xml.gz").write_bytes(gzip.compress(MODEL))
    (src / "border_BD_.xml").write_bytes(b"<broken")
    (src / "bad.gz").write_bytes(b"junk")
    spec = {"pipeline": {"name": "grid"}, "sources": [{"type": "local", "path": str(src), "patterns": ["*.xml", "*.gz"]}, {"type": "local", "path": "/none"}],
            "processors": [{"type": "unzip"}, {"type": "filter", "include": ["*.xml"], "exclude": ["*_BD_*"]}], "query": {"base_iri": "http://b/"},
            "output": {"dir": str(out), "formats": ["csv", "json", "nonsense"], "document": True, "prefix": "grid"}}
    with pytest.raises(KeyError):
        job.run_job(spark, spec, names)
    spec["output"]["formats"] = ["csv", "json", "tsv"]
    with pytest.warns(UserWarning, match="source failed"):
        meta = job.run_job(spark, spec, names).first()
    # both files have the same base name pattern but different names, so their subjects differ
    assert (meta["pipeline_name"], meta["files_loaded"], meta["triples_loaded"], meta["result_count"]) == ("grid", 2, 12, 6)
    files = sorted(p.name for p in out.iterdir() if not p.name.startswith("."))
    assert [f.rsplit(".", 1)[1] for f in files] == ["csv", "json", "metadata", "tsv"] and all(f.startswith("grid_") for f in files)
    assert whole(out / files[0]).splitlines() == ["name"] + [f"Quay of {n}" for n in ("Gull", "Gull", "Heron", "Heron", "Tern", "Tern")]
    written = dict(line.split(": ", 1) for line in (out / files[2]).read_text().splitlines())
    assert written["pipeline_name"] == "grid" and written["triples_loaded"] == "12" and written["result_count"] == "6"
    assert written["load_time_secs"] == f"{int(written['load_time_ms']) / 1000:.3f}"


def test_job_without_files_is_a_success(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.warns(UserWarning, match="no files"):
        meta = job.run_job(spark, {"sources": [{"type": "local", "path": str(tmp_path)}], "output": {"dir": str(out)}}).first()
    assert meta["files_loaded"] == 0 and not out.exists()


def test_job_reads_line_files_in_pieces(spark, tmp_path, rows):
    """Plain line files are divided, archives and documents are not; both give the same quads as whole files do."""
    line = lambda i: f'<urn:s/{i % 9}> <urn:p> "v {i}" .'
    (tmp_path / "a [1].nt").write_text("\n".join(map(line, range(40))) + "\n# a remark\n\n_:x <urn:p> _:x .\n")
    (tmp_path / "b.nq").write_text('<urn:s/1> <urn:p> "q" <urn:g> .\n')
    (tmp_path / "c.nt.gz").write_bytes(gzip.compress(line(99).encode()))
    (tmp_path / "d.xml").write_bytes(MODEL)
    (tmp_path / "skipped.nt").write_text("broken")
    spec = {"sources": [{"type": "local", "path": str(tmp_path), "patterns": ["*.nt", "*.nq", "*.gz", "*.xml"]}],
            "processors": [{"type": "unzip", "patterns": ["*.nt"]}, {"type": "filter", "exclude": ["skipped*"]}]}
    whole, files, quads = job.load(spark, spec)
    assert (files, quads) == (4, 40 + 1 + 1 + 1 + 6) and whole.where("g = 'urn:g'").count() == 1
    assert whole.where("s.kind = 'bnode'").select(F.col("s") == F.col("o")).first()[0]
    split, files, quads = job.load(spark, spec | {"query": {"split_bytes": 0}})
    assert (files, quads) == (4, 49) and rows(split.where("s.kind = 'iri'")) == rows(whole.where("s.kind = 'iri'"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert ingest_ntriples(spark, str(tmp_path / "a \\[1\\].nt")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "skipped.nt").write_bytes(b'<urn:s> <urn:p> "\xff" .')
    with pytest.raises(Exception, match="bad line"):
        job.load(spark, {"sources": spec["sources"], "processors": spec["processors"][:1]})


def test_job_reads_large_documents_in_pieces(spark, tmp_path, rows, monkeypatch):
    """Files from a size on are cut where they can be; those that cannot be cut are read whole, whatever their number."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.xml").write_bytes(MODEL)
    (tmp_path / "sub" / "c.rdf").write_bytes(MODEL.replace(b"</cim:Pier>", b"<!-- a > b --></cim:Pier>"))
    (tmp_path / "d.xml").write_bytes(b'<ex:order xmlns:ex="http://e/"><ex:x>1</ex:x></ex:order>')
    (tmp_path / "e.xml.gz").write_bytes(gzip.compress(MODEL))
    spec = {"sources": [{"type": "local", "path": str(tmp_path), "patterns": ["*.xml", "*.rdf", "*.gz"]}], "processors": [{"type": "unzip"}]}
    plain = lambda t: rows(t.where("s.kind = 'iri'"))
    want, files, quads = job.load(spark, spec | {"query": {"split_bytes": None}})
    assert (files, quads) == (4, 6 * 3 + 2)
    for least, names in ((0, 10), (100, 10), (0, 1)):
        monkeypatch.setattr(job, "NAMES", names)
        got, files, quads = job.load(spark, spec | {"query": {"split_bytes": least}})
        assert (files, quads) == (4, 6 * 3 + 2) and plain(got) == plain(want)
    (tmp_path / "d.xml").write_bytes(b"<open>")
    with pytest.raises(Exception, match="d.xml"):
        job.load(spark, spec | {"query": {"split_bytes": 0}})


def test_job_leaves_no_scratch_tables(spark, tmp_path):
    (tmp_path / "m.xml").write_bytes(MODEL)
    folder = Path(scratch_root(spark).removeprefix("file:")) / "tripleweave"
    before = set(folder.iterdir()) if folder.is_dir() else set()
    spec = {"sources": [{"type": "local", "path": str(tmp_path)}], "query": {"split_bytes": 0}, "output": {"dir": str(tmp_path / "out")}}
    assert job.run_job(spark, spec, names).first()["result_count"] == 3
    assert set(folder.iterdir()) == before


def test_job_fails_on_bad_data(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("not xml at all")
    with pytest.raises(Exception, match="bad.xml"):
        job.run_job(spark, {"sources": [{"type": "local", "path": str(tmp_path)}]})


def test_job_default_query_and_graphs(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "m.xml").write_bytes(MODEL)
    plain = job.run_job(spark, {"sources": [{"type": "local", "path": str(tmp_path)}]}).first()
    assert (plain["files_loaded"], plain["triples_loaded"], plain["result_count"]) == (2, 6, 6)  # same file name, same base
    spec = {"sources": [{"type": "local", "path": str(tmp_path / n), "graph": f"http://g/{n}"} for n in ("a", "b")]}
    per_graph = lambda q: q.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    meta = job.run_job(spark, spec, per_graph).first()
    assert (meta["files_loaded"], meta["triples_loaded"], meta["result_count"]) == (2, 12, 2)


def test_failing_sink_is_a_warning(spark, tmp_path, monkeypatch):
    (tmp_path / "m.xml").write_bytes(MODEL)
    monkeypatch.setitem(job.SINKS, "csv", lambda *a, **k: 1 / 0)
    spec = {"sources": [{"type": "local", "path": str(tmp_path)}], "output": {"dir": str(tmp_path / "out"), "formats": ["csv", "tsv"]}}
    with pytest.warns(UserWarning, match="sink failed"):
        job.run_job(spark, spec, names)
    assert sorted(p.suffix for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == [".metadata", ".tsv"]
