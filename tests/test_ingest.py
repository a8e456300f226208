import pytest
from pyspark.sql import functions as F

from tripleweave.functions.terms import lex
from tripleweave.operators.forms import graph_form
from tripleweave.sources import ingest as ing
from tripleweave.sources.files import FILES_DDL

EX = "http://example.org/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
HEAD = f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:ex="{EX}">'
CIM = "http://harbour.example/terms#"


def docs(spark, **contents):
    """``name__ext="text"`` as files."""
    return spark.createDataFrame([(f"mem:/{n}", n, bytearray(c.encode()), "test") for n, c in
                                  ((k.replace("__", "."), v) for k, v in contents.items())], FILES_DDL)


def quads(df):
    """Short form: subject, predicate and object without the namespaces; blank nodes by place."""
    short = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^" + EX, ""), "^" + RDF, "rdf:"), "^_:[0-9a-f]{20}", "_:")
    tag = F.when(F.col("o.lang") != "", F.concat(F.lit("@"), "o.lang")).when(
        F.col("o.dt").isin("", "xsd:string"), "").otherwise(F.concat(F.lit("^"), F.regexp_replace("o.dt", "^" + RDF, "rdf:")))
    return sorted(tuple(r) for r in df.select(short(lex(F.col("s"))), short(F.col("p")), F.concat(short(lex(F.col("o"))), tag), "g").collect())


def xml(spark, body, head=HEAD):
    return [q[:3] for q in quads(ing.ingest(docs(spark, f__xml=head + body + "</rdf:RDF>")))]


def test_named_nodes(spark):
    text = HEAD.replace("xmlns:ex", f'xmlns:cim="{CIM}" xmlns:ex') + "".join(
        f'<cim:Pier rdf:ID="_pier-{i}"><cim:Place.title>Quay of {n}</cim:Place.title></cim:Pier>'
        for i, n in enumerate(("Gull", "Heron", "Tern"), 1)) + (
        '<cim:Berth rdf:ID="_berth-9"><cim:Place.title>deep berth</cim:Place.title>'
        '<cim:Berth.depth>400</cim:Berth.depth></cim:Berth></rdf:RDF>')
    t = ing.ingest(docs(spark, EQ__xml=text))
    got = sorted(tuple(r) for r in graph_form(t).collect())
    assert len(got) == 9
    assert (EX + "EQ.xml#_pier-2", CIM + "Place.title", "Quay of Heron") in got
    assert (EX + "EQ.xml#_berth-9", RDF + "type", CIM + "Berth") in got


def test_node_forms(spark):
    assert xml(spark, '<rdf:Description rdf:about="thing"><ex:p>v</ex:p></rdf:Description>') == [("thing", "p", "v")]
    assert xml(spark, '<ex:C rdf:ID="x"/>') == [("f.xml#x", "rdf:type", "C")]
    assert xml(spark, '<rdf:Description rdf:nodeID="n"><ex:p rdf:nodeID="n"/></rdf:Description>') == [("_:nn", "p", "_:nn")]
    assert xml(spark, '<rdf:Description ex:a="1" rdf:about="#s" xml:lang="EN"/>') == [("f.xml#s", "a", "1@en")]
    assert xml(spark, '<rdf:Description rdf:about="s" rdf:type="http://t"/>') == [("s", "rdf:type", "http://t")]


def test_property_forms(spark):
    node = lambda inner: xml(spark, f'<rdf:Description rdf:about="s">{inner}</rdf:Description>')
    assert node('<ex:p rdf:resource="#o"/>') == [("s", "p", "f.xml#o")]
    assert node('<ex:p xml:lang="de-AT">Wort</ex:p>') == [("s", "p", "Wort@de-at")]
    assert node('<ex:p rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</ex:p>') == [("s", "p", "5^xsd:integer")]
    assert node("<ex:p></ex:p>") == [("s", "p", "")]
    assert node("<ex:p> a &amp; b <![CDATA[<c>]]></ex:p>") == [("s", "p", " a & b <c>")]
    assert node('<ex:p><ex:C rdf:about="o"><ex:q>1</ex:q></ex:C></ex:p>') == [("o", "q", "1"), ("o", "rdf:type", "C"), ("s", "p", "o")]
    assert node('<ex:p rdf:parseType="Resource"><ex:q>1</ex:q></ex:p>') == [("_:g1", "q", "1"), ("s", "p", "_:g1")]
    assert node('<ex:p ex:q="1"/>') == [("_:g1", "q", "1"), ("s", "p", "_:g1")]
    assert node('<ex:p rdf:parseType="Literal"><b>x</b> &lt;y</ex:p>') == [("s", "p", "<b>x</b> &lt;y^rdf:XMLLiteral")]
    assert node('<rdf:li>a</rdf:li><rdf:li>b</rdf:li>') == [("s", "rdf:_1", "a"), ("s", "rdf:_2", "b")]
    assert node('<ex:p rdf:parseType="Collection"/>') == [("s", "p", "rdf:nil")]
    assert node('<ex:p rdf:parseType="Collection"><rdf:Description rdf:about="a"/><rdf:Description rdf:about="b"/></ex:p>') == [
        ("_:g1", "rdf:first", "a"), ("_:g1", "rdf:rest", "_:g2"), ("_:g2", "rdf:first", "b"), ("_:g2", "rdf:rest", "rdf:nil"), ("s", "p", "_:g1")]
    assert node('<ex:p rdf:ID="r">v</ex:p>') == [
        ("f.xml#r", "rdf:object", "v"), ("f.xml#r", "rdf:predicate", "p"), ("f.xml#r", "rdf:subject", "s"),
        ("f.xml#r", "rdf:type", "rdf:Statement"), ("s", "p", "v")]


def test_base_and_language_scope(spark):
    head = HEAD.replace("<rdf:RDF", '<rdf:RDF xml:base="http://b.org/dir/doc" xml:lang="en"')
    assert xml(spark, '<rdf:Description rdf:about="../x"><ex:p xml:lang="">v</ex:p><ex:q>w</ex:q></rdf:Description>', head) == [
        ("http://b.org/x", "p", "v"), ("http://b.org/x", "q", "w@en")]
    assert xml(spark, '<rdf:Description rdf:ID="i"><ex:p rdf:resource=""/></rdf:Description>', head) == [
        ("http://b.org/dir/doc#i", "p", "http://b.org/dir/doc")]


def test_single_node_root_and_types(spark):
    t = ing.ingest(docs(spark, f__rdf=f'<ex:C xmlns:ex="{EX}" xmlns:rdf="{RDF}" rdf:about="s"/>'))
    assert [q[:3] for q in quads(t)] == [("s", "rdf:type", "C")]


@pytest.mark.parametrize("bad", [
    "not xml at all", HEAD, HEAD + "text</rdf:RDF>", HEAD + '<C/></rdf:RDF>',
    HEAD + '<ex:C rdf:ID="a"/><ex:C rdf:ID="a"/></rdf:RDF>',
    HEAD + '<ex:C><ex:p>x<ex:D/></ex:p></ex:C></rdf:RDF>'])
def test_rejects(spark, bad):
    with pytest.raises(Exception, match="bad.xml"):
        ing.ingest(docs(spark, bad__xml=bad)).count()
    good = HEAD + '<ex:C rdf:about="s"/></rdf:RDF>'
    t = ing.ingest(docs(spark, bad__xml=bad, good__xml=good), mode="reject")
    assert [r["file"] for r in ing.rejected(t).collect()] == ["mem:/bad.xml"]
    assert [r["file"] for r in ing.accepted(t).collect()] == ["mem:/good.xml"]


def test_formats(spark):
    df = spark.createDataFrame([(n,) for n in ("a.ttl", "a.nt", "a.nq", "a.trig", "a.xml", "a.rdf", "a.XML", "a.foo")], "n string")
    assert [r[0] for r in df.select(ing.detect_format(F.col("n"))).collect()] == [
        "turtle", "ntriples", "nquads", "trig", "rdfxml", "rdfxml", "rdfxml", "rdfxml"]


def test_base_modes(spark):
    a = HEAD + '<ex:C rdf:ID="_1"/></rdf:RDF>'
    b = HEAD + '<rdf:Description rdf:about="#_1"><ex:p>v</ex:p></rdf:Description></rdf:RDF>'
    files = docs(spark, A__xml=a, B__xml=b)
    subjects = lambda **k: ing.ingest(files, **k).select("s.value").distinct().count()
    assert subjects() == 2
    assert subjects(base_mode="shared") == 1
    with pytest.raises(ValueError):
        ing.ingest(files, base_mode="none")


LINES = r'''<http://example.org/a> <http://example.org/p> "q\"\\n\u00e9\U0001F600\t\\U0001F600" .
# a comment

_:x <http://example.org/p> _:y.x .
<http://example.org/a> <http://example.org/p> "v"@EN-us . # end
<http://example.org/a><http://example.org/p>"5"^^<http://www.w3.org/2001/XMLSchema#integer>.
<http://example.org/a> <http://example.org/p> "" .
<http://example.org/a> <http://example.org/p> "don\'t <http://x> @en ." .
'''


def test_line_formats(spark, tmp_path):
    (tmp_path / "t.nt").write_text(LINES)
    want = [("_:nx", "p", "_:ny.x", ""), ("a", "p", "", ""), ("a", "p", "5^xsd:integer", ""), ("a", "p", "don't <http://x> @en .", ""),
            ("a", "p", 'q"\\n\u00e9\U0001F600\t\\U0001F600', ""), ("a", "p", "v@en-us", "")]
    assert quads(ing.ingest_ntriples(spark, str(tmp_path / "t.nt"))) == sorted(want)
    assert quads(ing.ingest(docs(spark, t__nt=LINES))) == sorted(want)
    nq = "<http://example.org/a> <http://example.org/p> <http://example.org/b> <http://g> .\n<http://example.org/a> <http://example.org/p> \"x\" _:g .\n"
    (tmp_path / "t.nq").write_text(nq)
    want = [("a", "p", "b", "http://g"), ("a", "p", "x")]
    got = quads(ing.ingest_nquads(spark, str(tmp_path / "t.nq")))
    assert got[0] == want[0] and got[1][:3] == want[1] and got[1][3].startswith("_:")


@pytest.mark.parametrize("line", ["<http://a> <http://b> .", '<http://a> "b" <http://c> .', '<http://a> <http://b> "open .',
                                  "<http://a> <http://b> <http://c>", '"a" <http://b> <http://c> .',
                                  "<http://a> <http://b> <http://c> <http://g> ."])
def test_bad_lines(spark, line):
    lines = spark.createDataFrame([(line, "f")], "line string, file string")
    with pytest.raises(Exception, match="bad line"):
        ing.ingest_lines(lines, quads=False).count()
    t = ing.ingest_lines(lines, quads=False, mode="reject")
    assert ing.rejected(t).count() == 1 and ing.accepted(t).count() == 0


def test_long_literal_lines(spark):
    text = "x" * 200_000 + '\\"' * 20_000
    lines = spark.createDataFrame([(f'<http://a> <http://b> "{text}" .', "f")], "line string, file string")
    assert ing.ingest_lines(lines, quads=False).select(F.length("o.value")).first()[0] == 220_000


def turtle(spark, text):
    return [q[:3] for q in quads(ing.ingest(docs(spark, t__ttl="@prefix : <http://example.org/> .\n" + text)))]


def test_turtle(spark):
    assert turtle(spark, ":s a :C ; :p 'x', \"y\"@EN ; .") == [("s", "p", "x"), ("s", "p", "y@en"), ("s", "rdf:type", "C")]
    assert turtle(spark, ":s :p 1, -2.5, 1e3, true, \"z\"^^:t .") == [
        ("s", "p", "-2.5^xsd:decimal"), ("s", "p", "1^xsd:integer"), ("s", "p", "1e3^xsd:double"), ("s", "p", "true^xsd:boolean"),
        ("s", "p", f"z^{EX}t")]
    assert turtle(spark, ':s :p """a "quoted"\nline""" .') == [("s", "p", 'a "quoted"\nline')]
    assert turtle(spark, "PREFIX e: <http://e/>\nBASE <http://b/d>\n<#x> e:p\\~q <y> .") == [("http://b/d#x", "http://e/p~q", "http://b/y")]
    assert turtle(spark, "[] :p [ :q :o ] . [ :r 1 ] .") == [("_:g1", "p", "_:g2"), ("_:g2", "q", "o"), ("_:g3", "r", "1^xsd:integer")]
    assert turtle(spark, ":s :p (1 ()) .") == [("_:g1", "rdf:first", "1^xsd:integer"), ("_:g1", "rdf:rest", "_:g2"),
                                              ("_:g2", "rdf:first", "rdf:nil"), ("_:g2", "rdf:rest", "rdf:nil"), ("s", "p", "_:g1")]
    assert turtle(spark, "<< :s :p 1 >> :sure 0.9 .") == [(f"<<{EX}s {EX}p 1>>", "sure", "0.9^xsd:decimal")]
    assert turtle(spark, ":a.b :p :c. # comment .") == [("a.b", "p", "c")]


def test_trig(spark):
    text = "@prefix : <http://example.org/> .\n{ :s :p 1 } :g { :s :p 2 . :s :p 3 } GRAPH <http://h> { :s :p [] . }\n:s :p 4 ."
    got = quads(ing.ingest(docs(spark, t__trig=text)))
    assert [(q[2][:1], q[3]) for q in got] == [("1", ""), ("2", EX + "g"), ("3", EX + "g"), ("4", ""), ("_", "http://h")]


@pytest.mark.parametrize("bad", [":s :p", "x:s x:p x:o .", ":s :p \"open .", ":s :p 1 } ."])
def test_bad_turtle(spark, bad):
    with pytest.raises(Exception, match="t.ttl"):
        turtle(spark, bad)


def test_dedup_and_stats(spark):
    body = HEAD + '<rdf:Description rdf:about="s"><ex:p>v</ex:p>{}</rdf:Description></rdf:RDF>'
    files = docs(spark, a__xml=body.format(""), b__xml=body.format("<ex:q>w</ex:q>"), c__xml=HEAD + "</rdf:RDF>")
    t = ing.ingest(files)
    assert t.count() == 3 and ing.dedup_quads(t).count() == 2
    stats = {r["file"]: r["triples_loaded"] for r in ing.load_stats(t, files).collect()}
    assert stats == {"mem:/a.xml": 1, "mem:/b.xml": 1, "mem:/c.xml": 0}
    assert tuple(ing.load_totals(t, files).first()) == (3, 2)


def test_without_line_parser(spark):
    files = docs(spark, a__xml=HEAD + '<ex:C rdf:about="s"/></rdf:RDF>', b__nt=LINES)
    with pytest.raises(Exception, match="b.nt"):
        ing.ingest(files, lines=False).count()
    t = ing.ingest(files, mode="reject", lines=False)
    assert ing.accepted(t).count() == 1 and [r["file"] for r in ing.rejected(t).collect()] == ["mem:/b.nt"]


def test_blank_nodes_of_documents_stay_apart(spark):
    text = "_:x <http://example.org/p> 1 ."
    assert ing.ingest(docs(spark, a__ttl=text, b__ttl=text)).select("s").distinct().count() == 2
