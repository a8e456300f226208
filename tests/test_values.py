"""Scalars, ordering and aggregates on small tables of exact expectations."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tripleweave.functions import scalars as X
from tripleweave.functions.terms import IRI, TERM_DDL, Lit, Namespace, Term, lex, literal_term, num
from tripleweave.operators import aggregates as agg
from tripleweave.operators.forms import select_form
from tripleweave.operators.modifiers import desc, distinct, order_by, project, slice_
from tripleweave.operators.patterns import values

XSD = "http://www.w3.org/2001/XMLSchema#"


@pytest.fixture(scope="module")
def one(spark):
    """Evaluate an expression on constants; terms come back as their text."""
    def run(fn, *args):
        a = values(spark, [f"x{i}" for i in range(len(args))], [tuple(args)])
        c = fn(*[f"?x{i}" for i in range(len(args))])
        r = a.df.select(c.alias("r")).first()["r"]
        return r["value"] if hasattr(r, "asDict") else r
    return run


def t(v, dt=None, lang=""):
    return Lit(v, dt and "xsd:" + dt, lang)


@pytest.mark.parametrize("a,b,want", [
    (t(1), t("1.0", "decimal"), True), (t("1e0", "double"), t(1), True), (t("NaN", "double"), t("NaN", "double"), False),
    (t("a"), t("a"), True), (t("a"), t("a", lang="en"), False), (t("a"), t(1), False), (t("abc", "integer"), t(1), None),
    (t("true", "boolean"), t("1", "boolean"), True), (IRI("u"), IRI("u"), True), (IRI("u"), t("u"), False),
    (t("2024-01-01T00:00:00Z", "dateTime"), t("2024-01-01T01:00:00+01:00", "dateTime"), True),
    (Lit("x", "urn:dt"), Lit("x", "urn:dt"), True), (Lit("x", "urn:dt"), Lit("y", "urn:dt"), None), (None, t(1), None),
    (t("9007199254740993", "integer"), t("9007199254740992", "integer"), False)])
def test_equality(one, a, b, want):
    assert one(X.eq, a, b) is want
    assert one(X.ne, a, b) is (None if want is None else not want)


@pytest.mark.parametrize("a,b,want", [
    (t(9), t(10), True), (t("9"), t("10"), False), (t("400"), t(220), None), (t("1", "integer"), t("1.5", "double"), True),
    (t("NaN", "double"), t(1), False), (t("INF", "double"), t(1), False), (IRI("a"), IRI("b"), None), (t("a", lang="en"), t("b"), None),
    (t("false", "boolean"), t("true", "boolean"), True), (t("2024-01-01T00:00:00", "dateTime"), t("2024-01-01T00:00:00.1Z", "dateTime"), True)])
def test_less_than(one, a, b, want):
    assert one(X.lt, a, b) is want


@pytest.mark.parametrize("fn,a,b,want", [
    (X.add, t(1), t(2), "3"), (X.add, t(1), t("0.5", "decimal"), "1.5"), (X.add, t(1), t("0.5", "double"), "1.5"), (X.add, t("1"), t(2), None),
    (X.subtract, t(1), t("1.0", "decimal"), "0"), (X.multiply, t("0.1", "decimal"), t("0.1", "decimal"), "0.01"), (X.divide, t(1), t(4), "0.25"),
    (X.divide, t(1), t(0), None), (X.divide, t(1.0), t(0), "INF"), (X.divide, t(-1.0), t(0), "-INF"), (X.divide, t(0.0), t(0), "NaN"),
    (X.add, t("99999999999999999999", "integer"), t(1), None), (X.add, t("9223372036854775807", "integer"), t(1), "9223372036854775808")])
def test_arithmetic(one, fn, a, b, want):
    assert one(fn, a, b) == want


def test_nested_arithmetic(one):
    assert one(lambda a, b: X.divide(X.add(a, X.multiply(b, 3)), 2), t(1), t(2)) == "3.5"
    assert one(lambda a: X.gt(X.multiply(a, 2), 5), t(3)) is True
    assert one(lambda a: X.eq(X.add(a, 1), "4"), t(3)) is False


@pytest.mark.parametrize("fn,x,want", [
    (X.round_, t("2.5", "decimal"), "3"), (X.round_, t("-2.5", "decimal"), "-2"), (X.round_, t(-2.5), "-2.0"), (X.ceil, t("1.1", "decimal"), "2"),
    (X.floor, t("-1.1", "decimal"), "-2"), (X.abs_, t(-3), "3"), (X.abs_, t("x"), None), (X.floor, t("INF", "double"), "INF"), (X.negate, t(3), "-3")])
def test_rounding(one, fn, x, want):
    assert one(fn, x) == want


@pytest.mark.parametrize("x,want", [(t(""), False), (t("a"), True), (t(0), False), (t("NaN", "double"), False), (t("true", "boolean"), True),
                                    (t("abc", "integer"), False), (IRI("u"), None), (Lit("x", "urn:t"), None), (None, None)])
def test_ebv(one, x, want):
    assert one(X.ebv, x) is want


def test_strings(one):
    assert one(lambda s: X.substr(s, 0, 2), t("abc")) == "a"
    assert one(lambda s: X.substr(s, 2), t("abc")) == "bc"
    assert one(X.strlen, t("\U0001F600é")) == 2
    assert one(X.strlen, t(5)) is None
    assert one(X.strbefore, t("abc"), t("b")) == "a" and one(X.strbefore, t("abc"), t("x")) == "" and one(X.strafter, t("abc"), t("")) == "abc"
    assert one(lambda a, b: X.lang(X.strafter(a, b)), t("abc", lang="en"), t("b")) == "en"
    assert one(lambda a, b: X.lang(X.strafter(a, b)), t("abc", lang="en"), t("z")) == ""
    assert one(X.contains, t("abc", lang="en"), t("b", lang="en")) is True and one(X.contains, t("abc"), t("b", lang="en")) is None
    assert one(X.encode_for_uri, t("a b/ü~*+")) == "a%20b%2F%C3%BC~%2A%2B"
    assert one(lambda s: X.replace(s, "(b+)", "[$1]"), t("abbc")) == "a[bb]c"
    assert one(lambda s: X.regex(s, "^A", "i"), t("abc")) is True and one(lambda s: X.regex(s, "a.c", "q"), t("abc")) is False
    assert one(lambda a, b: X.lang(X.concat(a, b)), t("a", lang="en"), t("b", lang="en")) == "en"
    assert one(lambda a, b: X.lang(X.concat(a, b)), t("a", lang="en"), t("b")) == ""
    assert one(lambda s: X.langmatches(s, "de"), t("de-AT")) is True and one(lambda s: X.langmatches(s, "*"), t("")) is False
    assert one(lambda s: X.langmatches(s, "de"), t("den")) is False


def test_terms(one):
    assert one(X.datatype, t(1)) == XSD + "integer" and one(X.datatype, t("a")) == XSD + "string"
    assert one(X.datatype, IRI("u")) is None and one(X.lang, IRI("u")) is None
    assert one(X.str_, Term("bnode", "b")) is None and one(X.str_, IRI("u")) == "u"
    assert one(lambda x: X.iri(x, "http://b/"), t("rel")) == "http://b/rel" and one(lambda x: X.iri(x, "http://b/"), t("http://c")) == "http://c"
    assert one(X.is_numeric, t("abc", "integer")) is False and one(X.is_numeric, t("1")) is False and one(X.is_numeric, t("-1.5", "decimal")) is True
    assert Namespace("http://n#")["x"] == IRI("http://n#x")
    assert one(lambda x: X.coalesce(X.divide(x, 0), x, 5), t(2)) == "2"
    assert one(lambda x: X.if_(X.gt(x, 1), "yes", "no"), t(2)) == "yes" and one(lambda x: X.if_(X.gt(x, 1), "yes", "no"), t("s")) is None
    assert one(lambda x: X.in_(x, 1, "a"), t("a")) is True


@pytest.mark.parametrize("text,tz,duration,hour", [
    ("2024-03-05T23:10:01.5Z", "Z", "PT0S", 23), ("2024-03-05T23:10:01+05:30", "+05:30", "PT5H30M", 23), ("2024-03-05T01:10:01-10:00", "-10:00", "-PT10H", 1),
    ("2024-03-05T01:10:01-00:30", "-00:30", "-PT30M", 1), ("2024-03-05T01:10:01+00:00", "+00:00", "PT0S", 1), ("2024-03-05T01:10:01", "", None, 1),
    ("2024-03-05", None, None, None)])
def test_datetimes(one, text, tz, duration, hour):
    d = t(text, "dateTime")
    assert (one(X.tz, d), one(X.timezone, d), one(X.hours, d)) == (tz, duration, hour)
    if hour is not None:
        assert (one(X.year, d), one(X.month, d), one(X.day, d), one(X.minutes, d)) == (2024, 3, 5, 10)


@pytest.mark.parametrize("fn,x,want", [
    (X.xsd_decimal, t("400"), 400), (X.xsd_decimal, t("abc"), None), (X.xsd_decimal, t("1e3"), None), (X.xsd_decimal, t("4e2", "double"), 400),
    (X.xsd_decimal, t("true", "boolean"), 1), (X.xsd_integer, t("-7.9", "decimal"), -7), (X.xsd_integer, t("7.9"), None), (X.xsd_integer, t("7"), 7),
    (X.xsd_double, t("INF"), float("inf")), (X.xsd_double, t("Infinity"), None), (X.xsd_double, t("-INF", "double"), float("-inf")),
    (X.xsd_boolean, t("yes"), None), (X.xsd_boolean, t("1"), True), (X.xsd_boolean, t(0), False), (X.xsd_decimal, IRI("1"), None)])
def test_casts(one, fn, x, want):
    assert one(fn, x) == want


@pytest.mark.parametrize("x,strict", [(t("400"), None), (t("400", "integer"), 400.0), (t("4e2", "double"), 400.0), (t("abc"), None), (t("4.5", "integer"), None)])
def test_strict_numbers(one, x, strict):
    assert one(num, x) == strict


def test_ordering(spark):
    cells = [None, Term("bnode", "b"), IRI("u"), t("10", "integer"), t("9", "integer")]
    a = values(spark, ["x"], [(c,) for c in cells])
    got = [r[0] for r in select_form(order_by(a, "x")).collect()]
    assert got == ["", "_:b", "u", "9", "10"]
    assert [r[0] for r in select_form(order_by(a, desc("x"))).collect()] == got[::-1]
    assert [r[0] for r in select_form(slice_(order_by(a, "x"), limit=2, offset=3)).collect()] == ["9", "10"]
    two = values(spark, ["x", "y"], [(2, "b"), (1, "B"), (2, "a")])
    assert [tuple(r) for r in select_form(order_by(two, desc("x"), X.lcase("?y"))).collect()] == [("2", "a"), ("2", "b"), ("1", "B")]


def test_projection(spark, rows):
    a = values(spark, ["x", "y"], [(1, 2), (1, 2), (None, 2)])
    assert rows(select_form(distinct(a))) == [("", "2"), ("1", "2")]
    assert rows(select_form(project(a, "y", "nothing", z=X.add("?x", "?y")))) == [("2", "", ""), ("2", "", "3"), ("2", "", "3")]


def test_aggregates(spark, rows):
    a = values(spark, ["g", "x"], [("a", 1), ("a", t("2.5", "decimal")), ("a", None), ("b", 1.5), ("b", "text"), (None, 4), (None, 4)])
    out = agg.group(a, ["g"], n=agg.count("x"), all=agg.count_star(), s=agg.sum_("x"), m=agg.avg("x"), lo=agg.min_("x"), hi=agg.max_("x"),
                    d=agg.count_distinct("x"), c=agg.group_concat("x", sep="|"))
    assert rows(select_form(out, "g", "n", "all", "s", "m", "lo", "hi", "d", "c")) == [
        ("", "2", "2", "8", "4", "4", "4", "1", "4|4"), ("a", "2", "3", "3.5", "1.75", "1", "2.5", "2", "1|2.5"),
        ("b", "2", "2", "1.5", "1.5", "text", "1.5", "2", "1.5|text")]
    strict = agg.group(a, ["g"], strict_errors=True, s=agg.sum_("x"), hi=agg.max_("x"))
    assert rows(select_form(strict, "g", "s", "hi")) == [("", "8", "4"), ("a", "", ""), ("b", "", "1.5")]
    nothing = values(spark, ["x"], [])
    empty = agg.group(nothing, n=agg.count_star(), s=agg.sum_("x"), m=agg.avg("x"), hi=agg.max_("x"))
    assert rows(select_form(empty, "n", "s", "m", "hi")) == [("0", "0", "0", "")]
    pairs = values(spark, ["x", "y"], [(1, None), (1, None), (1, 2)])
    assert agg.group(pairs, n=agg.count_star(distinct=True)).df.first()[0] == 2
    having = agg.group(a, [("len", X.strlen("?g"))], having=F.col("n") > 2, n=agg.count_star())
    assert rows(having.df) == [(1, 5)]


def test_exact_constants_and_products(one):
    big = 9007199254740992
    assert one(lambda x: X.eq(x, big), t(str(big + 1), "integer")) is False and one(lambda x: X.gt(x, big), t(str(big + 1), "integer")) is True
    assert one(lambda x: X.in_(x, big, 5), t(str(big + 1), "integer")) is False and one(lambda x: X.eq(x, 1.5), t("1.5", "decimal")) is True
    d = lambda v: t(v, "decimal")
    assert one(X.multiply, d("0.0000000001"), t(1)) == "0.0000000001" and one(X.multiply, d("0.0000000001"), t(10**10)) in ("1", "1.0")
    assert one(X.multiply, t(3 * 10**9), t(3 * 10**9)) == str(9 * 10**18)
    assert one(X.multiply, d("0.0000000000000001"), d("0.0000000000000001")) is None  # digits beyond the 18th: unbound, not rounded
    assert one(X.divide, t(1), t(8)) == "0.125" and one(X.divide, d("0.0000000002"), d("0.0000000001")) in ("2", "2.0")
    assert one(X.negate, t(5)) == "-5" and one(lambda x: X.xsd_integer(x).cast("string"), t("12345678901234567890")) == "12345678901234567890"
    assert one(lambda x: X.xsd_integer(x).cast("string"), d("-2.9")) == "-2" and one(lambda x: X.concat(), t(1)) == ""


def test_literal_patterns(one):
    assert one(lambda s: X.regex(s, "a\\E.b", "q"), t("xa\\E.by")) is True and one(lambda s: X.regex(s, "a\\E.b", "q"), t("a\\Ezb")) is False
    assert one(lambda s: X.replace(s, "b", "$1\\", "q"), t("abc")) == "a$1\\c"
    assert one(lambda s: X.replace(s, "x*", "-"), t("abc")) is None  # it matches the empty string
    assert one(lambda s, n: X.substr(s, n, 2), t("hello"), t(2)) == "el" and one(lambda s, n: X.substr(s, n), t("hello"), t(4)) == "lo"
    assert one(X.langmatches, t("de-AT"), t("DE")) is True and one(X.langmatches, t(""), t("*")) is False


def test_sums_beyond_the_type(spark):
    a = values(spark, ["g", "x"], [(1, t(str(9 * 10**19), "integer")), (1, t(str(9 * 10**19), "integer")), (2, t("0.0000000001", "decimal")),
                                   (2, t("0.0000000003", "decimal")), (3, t(str(9 * 10**18), "integer")), (3, t(str(9 * 10**18), "integer"))])
    out = agg.group(a, ["g"], s=agg.sum_("x"), m=agg.avg("x"))
    got = {r["g"]: (r["s"], r["m"]) for r in out.df.selectExpr("g.value g", "s.value s", "m.value m").collect()}
    assert got["1"][0] is None and got["2"][1] == "0.0000000002" and float(got["3"][1]) == 9e18


def test_datatypes_and_tags_from_columns(spark):
    df = spark.createDataFrame([("1", "integer", "EN"), ("x", "", ""), ("y", None, None)], "v string, d string, t string")
    iri = X.iri(X.concat("http://www.w3.org/2001/XMLSchema#", literal_term(F.col("d"))))
    row = lambda c: [None if r[0] is None else tuple(r[0]) for r in df.select(c).collect()]
    text = literal_term(F.col("v"))
    assert row(X.strdt(text, iri)) == [("lit", "1", "xsd:integer", ""), ("lit", "x", "xsd:", ""), None]
    assert row(X.strdt(text, literal_term(F.col("d")))) == [None, None, None]
    assert row(X.strdt(text, IRI("urn:t"))) == [("lit", v, "urn:t", "") for v in "1xy"]
    assert row(X.strlang(text, literal_term(F.col("t")))) == [("lit", "1", "rdf:langString", "en"), None, None]
    assert row(X.strlang(text, "DE"))[0] == ("lit", "1", "rdf:langString", "de") and row(X.strlang(text, ""))[0] is None
    named = spark.createDataFrame([(IRI("urn:d").row, Lit("a").row)], f"d {TERM_DDL}, v {TERM_DDL}")
    assert tuple(named.select(X.strdt("?v", "?d")).first()[0]) == ("lit", "a", "urn:d", "")


def test_malformed_patterns_are_errors(spark):
    df = spark.createDataFrame([("abc", "b."), ("abc", "(["), ("abc", "x"), ("abc", None)], "v string, p string")
    text, pattern = literal_term(F.col("v")), literal_term(F.col("p"))
    one = lambda c: [r[0] for r in df.select(c).collect()]
    assert one(X.regex(text, pattern)) == [True, None, False, None]
    assert one(X.regex(text, "([")) == [None] * 4 and one(X.regex(text, "([", "q")) == [False] * 4 and one(X.regex(text, "A", "i")) == [True] * 4
    assert one(lex(X.replace(text, pattern, "-"))) == ["a-", None, "abc", None]
    assert one(lex(X.replace(text, "*", "-"))) == [None] * 4 and one(lex(X.replace(text, "c", "$", "q"))) == ["ab$"] * 4


def test_long_hashes_by_value(spark):
    texts = ["", "abc", "é日本🎉", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for name, f in (("sha384", X.sha384), ("sha512", X.sha512)):
        assert [r[0] for r in df.select(lex(f(literal_term(F.col("v"))))).collect()] == [getattr(hashlib, name)(t.encode()).hexdigest() for t in texts]
