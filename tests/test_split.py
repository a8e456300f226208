import pytest
from pyspark.sql import functions as F

from tripleweave.functions.terms import lex
from tripleweave.sources import ingest as ing, split
from tripleweave.sources.files import scan_files

HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n<!-- made for a test -->\n<rdf:RDF xml:lang="en"\n  xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
        'xmlns:ex="http://example.org/">\n')


def model(n):
    body = "".join(
        f'  <ex:Line rdf:ID="_{i}" ex:tag="it\'s &quot;{i}&quot;">\n    <ex:name>L &lt;{i}&gt; é</ex:name>\n    <ex:to rdf:resource="#_{i + 1}"/>'
        f'<ex:in><ex:Box ex:w="{i}"><ex:h rdf:parseType="Resource"><ex:v>1</ex:v></ex:h></ex:Box></ex:in>\n  </ex:Line>\n'
        + (f'  <rdf:Description rdf:nodeID="shared"><ex:n>{i}</ex:n></rdf:Description><ex:Dot rdf:about="#d{i}"/>\n' if i % 3 == 0 else "")
        for i in range(n))
    return HEAD + body + "</rdf:RDF>\n"


def shape(t):
    """Triples without the labels of the blank nodes that parsing makes up."""
    plain = lambda c: F.when(c["value"].rlike("g(p[0-9c_]+x)?[0-9]+$") & (c["kind"] == "bnode"), F.lit("_")).otherwise(lex(c))
    return sorted(tuple(r) for r in t.select(plain(F.col("s")), "p", plain(F.col("o")), "o.lang", F.regexp_extract("file", "[^/]*$", 0)).collect())


@pytest.fixture
def settings(spark):
    """Sets options of the session for one test."""
    old = {}

    def put(**values):
        for k, v in values.items():
            k = {"block": "spark.sql.files.maxPartitionBytes", "open": "spark.sql.files.openCostInBytes",
                 "batch": "spark.sql.execution.arrow.maxRecordsPerBatch"}[k]
            old.setdefault(k, spark.conf.get(k))
            spark.conf.set(k, str(v))

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("batch,block,few", [(7, 900, 100_000), (10_000, 300, 100_000), (1, 1 << 20, 100_000), (5, 260, 100_000), (40, 500, 0)])
def test_pieces_give_the_same_triples(spark, tmp_path, settings, monkeypatch, batch, block, few):
    monkeypatch.setattr(split, "BROADCAST", few)
    (tmp_path / "a.xml").write_text(model(60))
    (tmp_path / "b b+.xml").write_text(model(5).replace("é", "\U0001F600"))
    want = ing.ingest(scan_files(spark, str(tmp_path)))
    settings(batch=batch, block=block, open=block)
    got = split.ingest_rdfxml_split(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b b+.xml")])
    assert shape(got) == shape(want)
    # every made-up blank node is still one node: as many as in the whole documents
    assert got.select("s").distinct().count() == want.select("s").distinct().count()


def test_a_child_over_many_blocks(spark, tmp_path, settings):
    """One child fills most blocks; remarks, blanks and the root's end stand at block ends."""
    big = '<ex:Big rdf:about="b">' + "".join(f"<ex:v>{i}</ex:v>" for i in range(200)) + "</ex:Big>"
    text = HEAD + "<!-- one -->" * 9 + model(3)[len(HEAD):-len("</rdf:RDF>\n")] + big + "<!-- two -->\n" * 9 + "<ex:C rdf:about='c'/></rdf:RDF>\n<!-- end -->\n"
    (tmp_path / "a.xml").write_text(text)
    want = shape(ing.ingest(scan_files(spark, str(tmp_path))))
    for block in (400, 450, 640, 1000):
        settings(block=block, open=block, batch=9)
        assert shape(split.ingest_rdfxml_split(spark, str(tmp_path / "a.xml"))) == want


def test_blocks_share_a_file(spark, tmp_path, settings):
    (tmp_path / "a.xml").write_text(model(300))
    settings(block=4000, open=4000)
    texts = split.records(split.RECORDS.read(spark, [str(tmp_path / "a.xml")], ""))
    depths, files = split.block_sums(texts)
    documents = split.cut_documents(texts, depths, files)
    blocks = -(-(tmp_path / "a.xml").stat().st_size // 4000)
    assert depths.count() == blocks > 10 and files.first()["splittable"]
    assert documents.where("part LIKE 'c%'").count() <= blocks < documents.count()
    assert texts.rdd.getNumPartitions() == blocks


def test_other_encodings(spark, tmp_path, settings):
    (tmp_path / "a.xml").write_bytes(model(20).replace("UTF-8", "ISO-8859-1").encode("latin-1"))
    settings(block=700, open=700)
    want = ing.ingest(scan_files(spark, str(tmp_path)))
    assert shape(split.ingest_rdfxml_split(spark, str(tmp_path / "a.xml"))) == shape(want)


def test_no_children(spark, tmp_path):
    (tmp_path / "a.xml").write_text(model(0))
    (tmp_path / "b.xml").write_text(HEAD.rstrip()[:-1] + "/>")
    assert split.ingest_rdfxml_split(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")]).count() == 0


@pytest.mark.parametrize("inner", ["<!-- a > b -->", "<ex:p><![CDATA[<x>]]></ex:p>", "<ex:p ex:q='a>b'/>", "<!-- <ex:q/> -->"])
def test_what_cannot_be_split_is_refused(spark, tmp_path, inner):
    (tmp_path / "a.xml").write_text(HEAD + f'<ex:C rdf:about="s">{inner}</ex:C></rdf:RDF>')
    with pytest.raises(Exception, match="cannot be split"):
        split.ingest_rdfxml_split(spark, str(tmp_path / "a.xml")).collect()


BODY = HEAD + '<ex:C rdf:about="s"><ex:p>x</ex:p></ex:C>'


@pytest.mark.parametrize("text", [
    BODY.replace("</ex:p>", "</ex:q>") + "</rdf:RDF>", BODY, BODY + "junk</rdf:RDF>", BODY + "</rdf:RDF><ex:D/>", BODY + "</rdf:RDF>junk",
    "not xml at all", HEAD, HEAD + '<ex:C rdf:about="s"><ex:p></rdf:RDF>'])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "a.xml").write_text(text)
    with pytest.raises(Exception, match="a.xml"):
        split.ingest_rdfxml_split(spark, str(tmp_path / "a.xml")).collect()


@pytest.mark.parametrize("body", ['<ex:order xmlns:ex="http://e/"><ex:x>1</ex:x><ex:y>2</ex:y></ex:order>',
                                  '<rdf:Seq xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Seq>'])
def test_a_root_that_is_a_node_is_refused(spark, tmp_path, body):
    (tmp_path / "a.xml").write_text(body)
    with pytest.raises(Exception, match="cannot be split"):
        split.ingest_rdfxml_split(spark, str(tmp_path / "a.xml")).collect()
