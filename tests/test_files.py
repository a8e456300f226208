import gzip
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripleweave.plans.catalog_files import _zip_documents
from tripleweave.plans.job import load
from tripleweave.sources import archives
from tripleweave.sources import files as fs
from tripleweave.sources.archives import accepted, expand_archives, rejects
from tripleweave.sources.files import FILES_DDL

XML = b"<rdf:RDF>hello world</rdf:RDF>"


def put(folder, *names, data=b"data"):
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_bytes(data)


def names(df):
    return sorted(r["filename"] for r in df.select("filename").collect())


def files_df(spark, *entries):
    return spark.createDataFrame([(f"p/{n}", n, bytearray(c), "test") for n, c in entries], fs.FILES_DDL)


@pytest.mark.parametrize("pattern,name,hit", [
    ("*.xml", "a.xml", True), ("*.xml", "a.XML", False), ("a?.xml", "ab.xml", True), ("[ab].rdf", "b.rdf", True),
    ("[!ab].rdf", "b.rdf", False), ("[a-c]*", "cd", True), ("*_EQ_*", "20260215T2300Z__DKE_EQ_001.xml", True),
    ("*_BD_*", "20260215T2300Z__DKE_EQ_001.xml", False), ("{a,b}.xml", "a.xml", False), ("a.xml", "abxml", False),
    ("[]]x", "]x", True), ("**", "any.thing", True)])
def test_glob(spark, pattern, name, hit):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(fs.match_glob(F.col("n"), [pattern])).first()[0] is hit


def test_glob_lists(spark):
    df = spark.createDataFrame([("a.txt",)], "n string")
    value = lambda c: df.select(c).first()[0]
    assert value(fs.match_glob(F.col("n"), [])) is True
    assert value(fs.match_glob(F.col("n"), ["[bad", "a***"])) is False
    assert value(fs.match_glob(F.col("n"))) is False
    assert fs.glob_regex("[") is None


def test_directory(spark, tmp_path):
    put(tmp_path, "a.xml", "b.xml", "c.txt", "subdir/nested.xml", "k=1/part.xml")
    assert names(fs.scan_files(spark, str(tmp_path))) == ["a.xml", "b.xml", "nested.xml", "part.xml"]
    assert names(fs.scan_files(spark, str(tmp_path), recursive=False)) == ["a.xml", "b.xml"]
    assert names(fs.scan_files(spark, str(tmp_path), patterns=[], recursive=False)) == ["a.xml", "b.xml", "c.txt"]
    assert names(fs.scan_files(spark, str(tmp_path), patterns=["[a]*", "*.txt"])) == ["a.xml", "c.txt"]
    row = fs.scan_files(spark, str(tmp_path), patterns=["c.*"]).first()
    assert row["content"] == b"data" and row["source"] == f"local:{tmp_path}" and row["path"].endswith("/c.txt")


def _opened(df):
    """Files that the scans of a collected plan opened."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().startswith("Scan"):
            total += plan.metrics().get("numFiles").get().value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_filters_on_names_and_sizes_open_no_other_file(spark, tmp_path):
    put(tmp_path, "a.xml", "b b+%41.nt", "sub/a.xml")
    put(tmp_path, "large.nt", data=b"x\n" * 900)
    scan = lambda form, **o: fs.scan_files(spark, str(tmp_path), patterns=[], form=form, **o)
    for form, column in ((fs.SIZED, "content"), (fs.LINES, "text"), (fs.Form(">", sized=True), "text")):
        assert _opened(scan(form).where(F.col("filename").endswith(".nt")).select(column)) == 2
        assert _opened(scan(form).where("size >= 1000").select(column)) == 1
        assert _opened(scan(form, recursive=False).select(column)) == 3
        one = scan(form).where(F.col("path").endswith("/b b+%41.nt"))
        assert _opened(one.select(column)) == 1 and one.first()["filename"] == "b b+%41.nt"
    assert scan(fs.LINES).where("filename = 'large.nt'").count() == 900


def test_many_explicit_names(spark, tmp_path):
    put(tmp_path, *[f"f{i}.dat" for i in range(40)])
    listed = [str(tmp_path / f"f{i}.dat") for i in range(45)]
    with pytest.warns(UserWarning, match="f44.dat"):
        assert len(names(fs.scan_files(spark, files=listed))) == 40


def test_single_and_explicit(spark, tmp_path):
    put(tmp_path, "a.xml", "odd.dat", "_hidden.xml", "sp ace.xml")
    assert names(fs.scan_files(spark, str(tmp_path / "odd.dat"))) == ["odd.dat"]
    listed = [str(tmp_path / n) for n in ("odd.dat", "gone.xml", "_hidden.xml")] + [str(tmp_path)]
    with pytest.warns(UserWarning) as seen:
        df = fs.scan_files(spark, files=listed)
    assert names(df) == ["odd.dat"] and len(seen) == 3
    assert df.first()["source"] == "local:[4 files]"
    both = fs.scan_files(spark, str(tmp_path), files=[str(tmp_path / "a.xml")])
    assert names(both) == ["a.xml", "a.xml", "sp ace.xml"]


def test_missing_path_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        fs.scan_files(spark, "/nonexistent/path/xyz")
    with pytest.warns(UserWarning):
        assert fs.scan_files(spark).isEmpty()


def test_object_store(spark, tmp_path):
    put(tmp_path, "data/a.xml", "data/sub/b.xml", "data/c.txt", "other/d.xml")
    root = f"file:{tmp_path}"
    keys = lambda df: sorted(r["path"] for r in df.select("path").collect())
    assert keys(fs.scan_store(spark, root, "data/")) == ["data/a.xml", "data/sub/b.xml"]
    assert keys(fs.scan_store(spark, root, files=["other/d.xml"])) == ["other/d.xml"]
    with pytest.warns(UserWarning):
        assert keys(fs.scan_store(spark, root, "data", files=["data/a.xml", "data/gone.xml"])) == ["data/a.xml", "data/sub/b.xml"]
    assert keys(fs.scan_store(spark, root)) == ["data/a.xml", "data/sub/b.xml", "other/d.xml"]
    assert fs.scan_store(spark, root, "nothing/here").isEmpty()


def test_cloud_names_and_settings(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(fs, "scan_store", lambda spark, root, prefix, files, patterns, source, form: calls.append((root, prefix, source)))
    fs.scan_s3(spark, "bkt", "in/", region="eu-west-1", endpoint="http://minio:9000")
    fs.scan_azure(spark, "acct", "box", "igm/", skip_signature=True)
    fs.scan_gcs(spark, "gb", files=["x.xml"], endpoint="http://unused",
                service_account_key='{"client_email": "a@b", "private_key_id": "7", "private_key": "k"}')
    assert calls == [("s3a://bkt", "in/", "s3://bkt/in/"), ("abfss://box@acct.dfs.core.windows.net", "igm/", "azure://box/igm/"),
                     ("gs://gb", "", "gs://gb/[1 files]")]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.bkt.endpoint") == "http://minio:9000"
    assert conf.get("fs.s3a.bucket.bkt.endpoint.region") == "eu-west-1"


def test_union_keeps_going(spark, tmp_path):
    put(tmp_path, "a.xml")
    with pytest.warns(UserWarning):
        df = fs.union_sources(spark, lambda: fs.scan_files(spark, "/none"), lambda: fs.scan_files(spark, str(tmp_path)))
    assert names(df) == ["a.xml"]
    assert fs.union_sources(spark).isEmpty()


def test_filter(spark):
    df = files_df(spark, *[(n, b"") for n in ("north.xml", "north_old.xml", "south.rdf", "south.zip", "readme")])
    assert names(fs.filter_files(df, ["north*", "*.rdf"], ["*_old.*"])) == ["north.xml", "south.rdf"]
    assert len(names(fs.filter_files(df))) == 5
    assert len(names(fs.filter_files(df, include=["[bad"]))) == 5  # no valid include pattern keeps everything


def test_archives(spark, tmp_path):
    packed = tmp_path / "x.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.xml", XML)
        z.writestr("dir/b.rdf", XML)
        z.writestr("c.txt", b"x")
        z.writestr("d.xml.gz", gzip.compress(XML))
        z.writestr("bad.xml.gz", b"no gzip")
        z.writestr("empty/", b"")
    df = files_df(spark, ("x.zip", packed.read_bytes()), ("test.xml.gz", gzip.compress(XML)), ("t.GZ", b"kept"),
                  ("y.txt.gz", gzip.compress(b"t")), ("plain.txt", b"plain"), ("bad.zip", os.urandom(99)), ("bad.gz", os.urandom(99)),
                  ("multi.xml.gzip", gzip.compress(b"one ") + gzip.compress(b"two")))
    out = expand_archives(df)
    got = {r["path"]: (r["filename"], bytes(r["content"])) for r in accepted(out).collect()}
    assert got == {"p/x.zip:a.xml": ("a.xml", XML), "p/x.zip:dir/b.rdf": ("b.rdf", XML), "p/test.xml.gz:decompressed": ("test.xml", XML),
                   "p/t.GZ": ("t.GZ", b"kept"), "p/plain.txt": ("plain.txt", b"plain"),
                   "p/multi.xml.gzip:decompressed": ("multi.xml", b"one two")}
    assert sorted(r["path"] for r in rejects(out).collect()) == ["p/bad.gz", "p/bad.zip"]
    deep = accepted(expand_archives(df.where("filename = 'x.zip'"), patterns=["*.gz"]))
    assert sorted((r["path"], r["filename"]) for r in deep.collect()) == [
        ("p/x.zip:bad.xml.gz", "bad.xml.gz"), ("p/x.zip:d.xml.gz:decompressed", "d.xml")]
    everything = accepted(expand_archives(df.where("filename = 'x.zip'"), patterns=[]))
    assert everything.count() == 5


def line_gz(spark, text: bytes, cut: int | None = None):
    return spark.createDataFrame([("mem:/a.nt.gz", "a.nt.gz", gzip.compress(text)[:cut], "t")], FILES_DDL)


def test_line_texts_come_in_pieces(spark):
    """An inflated text of lines was one value, however long."""
    text = b"".join(b"<s%d> <p> <o%d> .\n" % (i, i * i) for i in range(450_000))
    found = archives.expand_archives(line_gz(spark, text), patterns=["*.nt"], lines=(".nt",))
    rows = found.withColumns({"whole": archives.whole_path(F.col("path")), "first": archives.is_first(F.col("path"))}).collect()
    rows.sort(key=lambda r: int(r["path"].partition(archives.PIECE)[2] or 0))
    assert len(rows) > 2 and max(len(r["content"]) for r in rows) <= archives.PIECE_BYTES + (1 << 20)
    assert b"".join(r["content"] for r in rows) == text and all(r["content"].endswith(b"\n") for r in rows)
    assert {(r["whole"], r["filename"]) for r in rows} == {("mem:/a.nt.gz:decompressed", "a.nt")} and sum(r["first"] for r in rows) == 1
    whole = archives.expand_archives(line_gz(spark, text), patterns=["*.nt"]).collect()
    assert [(r["path"], bytes(r["content"])) for r in whole] == [("mem:/a.nt.gz:decompressed", text)]
    broken = archives.expand_archives(line_gz(spark, text, -9), patterns=["*.nt"], lines=(".nt",)).collect()
    assert [(r["path"], r["content"]) for r in broken] == [("mem:/a.nt.gz", None)] and broken[0]["error"].startswith("gzip: ")


def test_job_counts_files_not_pieces(spark, tmp_path):
    lines = b"".join(b"<urn:s%d> <urn:p> <urn:o%d> .\n" % (i, i * i) for i in range(300_000))
    (tmp_path / "a.nt.gz").write_bytes(gzip.compress(lines + b"_:x <urn:p> _:x ."))
    (tmp_path / "b.nt.gz").write_bytes(gzip.compress(b""))
    spec = {"sources": [{"type": "local", "path": str(tmp_path), "patterns": ["*.gz"]}], "processors": [{"type": "unzip", "patterns": ["*.nt"]}]}
    stored, files, triples = load(spark, spec)
    assert (files, triples, stored.count()) == (2, 300_001, 300_001)


def test_documents_are_packed_a_few_at_a_time():
    """All documents of a batch were in memory with all their archives."""
    rows = [{"path": f"mem:/{i}.xml", "filename": f"{i}.xml", "content": b"x", "source": "t"} for i in range(1200)]
    packed = list(_zip_documents(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [b.num_rows for b in packed] == [500, 500, 200]
    assert [r for b in packed for r in b["path"].to_pylist()] == [f"mem:/{i}.zip" for i in range(1200)]


def test_plain_names_are_not_decoded(spark, tmp_path):
    """Every record decoded the path of its file."""
    df = spark.createDataFrame([("file:/a+b/c.xml",), ("file:/a%20b+c%2Bd/%C3%A9.xml",)], "uri string").select(fs._plain(F.col("uri")).alias("path"))
    assert [r["path"] for r in df.collect()] == ["file:/a+b/c.xml", "file:/a b+c+d/\u00e9.xml"]
    assert "CASE WHEN" in df._jdf.queryExecution().optimizedPlan().toString()
