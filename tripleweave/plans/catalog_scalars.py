"""Checked queries: scalar functions, in groups, over whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.terms import RDF_TYPE, Lit, lex, literal_term, num
from ..operators.modifiers import project
from ..operators.patterns import Solutions, bgp, optional
from .model import C, P, graph
from .registry import Tables, query


def out(solutions: Solutions, key: str, **cells: Column) -> DataFrame:
    """The key variable as text and native columns."""
    return solutions.df.select(lex(F.col(key)).alias("key"), *[c.alias(n) for n, c in cells.items()])


def parts(t: Tables) -> Solutions:
    return bgp(graph(t), ("?part", P["name"], "?name"), ("?part", P["brand"], "?brand"), ("?part", P["size"], "?size"),
               ("?part", P["price"], "?price"), ("?part", P["ptype"], "?type"))


def events(t: Tables) -> Solutions:
    return bgp(graph(t), ("?e", P["ts"], "?ts"), ("?e", P["etype"], "?type"), ("?e", P["value"], "?value"), ("?e", P["props"], "?props"))


def documents(t: Tables) -> Solutions:
    return bgp(graph(t), ("?d", P["text"], "?text"), ("?d", P["dlang"], "?dl"), ("?d", P["chars"], "?chars"))


def pages(t: Tables) -> Solutions:
    return bgp(graph(t), ("?p", P["url"], "?url"), ("?p", P["html"], "?html"))


PART = "'urn:part/' || p_partkey AS key"


@query("fn_logic", f"""
    SELECT {PART}, p_size > 25 OR p_name LIKE 'red%' AS a, p_size > 25 AND p_name LIKE 'red%' AS b, NOT p_size > 25 AS c,
           CASE WHEN p_size > 25 THEN true END AS err_or, CASE WHEN p_size <= 25 THEN false END AS err_and FROM part""")
def _(t: Tables):
    big, red = X.gt("?size", 25), X.strstarts("?name", "red")
    error = X.gt("?name", 1)  # a string against a number
    return out(parts(t), "part", a=X.or_(big, red), b=X.and_(big, red), c=X.not_(big), err_or=X.or_(error, big), err_and=X.and_(error, big))


@query("fn_ebv", """
    SELECT 'urn:label/' || doc_id AS key, toxic <> 0 AS n, true AS s, CAST(NULL AS BOOLEAN) AS i FROM labels""")
def _(t: Tables):
    a = bgp(graph(t), ("?l", P["toxic"], "?toxic"), ("?l", P["labels"], "?d"))
    return out(a, "l", n=X.ebv("?toxic"), s=X.ebv(X.str_("?d")), i=X.ebv("?d"))


@query("fn_equality", f"""
    SELECT {PART}, p_size = 25 AS num_const, p_size = p_retailprice AS num_num, p_name = p_brand AS str_str, p_name = 'red widget' AS str_const,
           false AS str_num, p_size <> 25 AS ne, CAST(NULL AS BOOLEAN) AS unknown, p_size <> p_retailprice AS differs FROM part""")
def _(t: Tables):
    odd = literal_term(F.col("name.value"), "urn:type/odd")
    return out(parts(t), "part", num_const=X.eq("?size", 25), num_num=X.eq("?size", "?price"), str_str=X.eq("?name", "?brand"),
               str_const=X.eq("?name", "red widget"), str_num=X.eq("?name", 3), ne=X.ne("?size", 25),
               unknown=X.eq(odd, "?brand"), differs=X.ne("?size", "?price"))


@query("fn_order_compare", f"""
    SELECT {PART}, p_size < 25 AS lt, p_size <= 25 AS le, p_size > p_retailprice / 40 AS gt, p_retailprice >= 950.5 AS ge,
           p_name < p_brand AS text_lt, CAST(NULL AS BOOLEAN) AS mixed FROM part""")
def _(t: Tables):
    return out(parts(t), "part", lt=X.lt("?size", 25), le=X.le("?size", 25), gt=X.gt("?size", X.divide("?price", 40)),
               ge=X.ge("?price", 950.5), text_lt=X.lt("?name", "?brand"), mixed=X.lt("?name", "?size"))


@query("fn_in", f"""
    SELECT {PART}, p_size IN (1, 2, 50) AS i, p_name NOT IN ('red widget', 'hot gear') AS ni,
           CASE WHEN p_size = 7 THEN true END AS with_error FROM part""")
def _(t: Tables):
    odd = Lit("x", "urn:type/odd")
    return out(parts(t), "part", i=X.in_("?size", 1, 2, 50.0), ni=X.not_in("?name", "red widget", "hot gear"), with_error=X.in_("?size", odd, 7))


@query("fn_bound_if_coalesce", """
    SELECT 'urn:document/' || d.doc_id AS key, l.quality IS NOT NULL AS b, CASE WHEN l.quality IS NULL THEN '' WHEN l.quality > 0
           THEN 'good' ELSE 'bad' END AS verdict, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t: Tables):
    g = graph(t)
    a = optional(bgp(g, ("?d", RDF_TYPE, C["document"])), project(bgp(g, ("?l", P["labels"], "?d"), ("?l", P["quality"], "?q")), "d", "q"))
    verdict = F.coalesce(lex(X.if_(X.gt("?q", 0), "good", "bad")), F.lit(""))
    return out(a, "d", b=X.bound("?q"), verdict=verdict, q=X.xsd_integer(X.coalesce("?q", -1)).cast("bigint"))


@query("fn_sameterm", f"SELECT {PART}, p_size = 25 AS same, false AS other_type, true AS value_eq FROM part")
def _(t: Tables):
    return out(parts(t), "part", same=X.sameterm("?size", 25), other_type=X.sameterm("?size", literal_term(F.col("size.value"), "xsd:decimal")),
               value_eq=X.eq("?size", literal_term(F.concat(F.col("size.value"), F.lit(".0")), "xsd:decimal")))


@query("fn_arithmetic", f"""
    SELECT {PART}, CAST(p_size + 3 AS VARCHAR) AS add_int, CAST(p_size * (p_size - 3) AS VARCHAR) AS mul_int, p_retailprice - p_size AS sub_double,
           round(p_retailprice / p_size, 6) AS div_double, round(p_size / 4.0, 6) AS div_int,
           CAST(-p_size AS VARCHAR) AS neg, CAST(NULL AS VARCHAR) AS div_zero, 'INF' AS div_zero_double, p_size / 2 AS half FROM part""")
def _(t: Tables):
    return out(parts(t), "part", add_int=lex(X.add("?size", 3)), mul_int=lex(X.multiply("?size", X.subtract("?size", 3))),
               sub_double=num(X.subtract("?price", "?size")), div_double=F.round(num(X.divide("?price", "?size")), 6),
               div_int=F.round(num(X.divide("?size", 4)), 6), neg=lex(X.negate("?size")), div_zero=lex(X.divide("?size", 0)),
               div_zero_double=lex(X.divide("?price", 0)), half=num(X.multiply("?size", 0.5)))


@query("fn_numeric_types", f"""
    SELECT {PART}, 'xsd:integer' AS ii, 'xsd:decimal' AS div_ii, 'xsd:double' AS id, 'xsd:decimal' AS i_dec FROM part""")
def _(t: Tables):
    dec = literal_term(F.lit("1.5"), "xsd:decimal")
    return out(parts(t), "part", ii=X.add("?size", 1)["dt"], div_ii=X.divide("?size", 2)["dt"], id=X.add("?size", "?price")["dt"],
               i_dec=X.multiply("?size", dec)["dt"])


@query("fn_rounding", """
    SELECT 'urn:event/' || event_id AS key, abs(value - 20) AS a, ceil(value) AS c, floor(value) AS f, floor(value + 0.5) AS r,
           floor(-value + 0.5) AS rn, -2.0 AS half_up FROM events""")
def _(t: Tables):
    return out(events(t), "e", a=num(X.abs_(X.subtract("?value", 20))), c=num(X.ceil("?value")), f=num(X.floor("?value")),
               r=num(X.round_("?value")), rn=num(X.round_(X.negate("?value"))), half_up=num(X.round_(-2.5)))


@query("fn_term_tests", f"""
    SELECT {PART}, true AS iri, false AS blank, false AS iri_lit, true AS lit, true AS numeric, false AS str_numeric, false AS bad_numeric FROM part""")
def _(t: Tables):
    bad = literal_term(F.col("name.value"), "xsd:integer")
    return out(parts(t), "part", iri=X.is_iri("?part"), blank=X.is_blank("?part"), iri_lit=X.is_literal("?part"), lit=X.is_literal("?name"),
               numeric=X.is_numeric("?size"), str_numeric=X.is_numeric("?name"), bad_numeric=X.is_numeric(bad))


@query("fn_term_parts", f"""
    SELECT {PART}, 'urn:part/' || p_partkey AS s, p_name AS s_lit, '' AS lang, 'en' AS tagged,
           'http://www.w3.org/2001/XMLSchema#integer' AS dt, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS dt_lang,
           'urn:new/' || p_brand AS iri, 'urn:type/x' AS strdt, true AS same_bnode FROM part""")
def _(t: Tables):
    tagged = X.strlang("?name", "EN")
    return out(parts(t), "part", s=lex(X.str_("?part")), s_lit=lex(X.str_("?name")), lang=lex(X.lang("?name")), tagged=lex(X.lang(tagged)),
               dt=lex(X.datatype("?size")), dt_lang=lex(X.datatype(tagged)), iri=lex(X.iri(X.concat("urn:new/", "?brand"))),
               strdt=lex(X.datatype(X.strdt("?name", "urn:type/x"))),
               same_bnode=X.sameterm(X.bnode("?name", F.col("part.value")), X.bnode("?name", F.col("part.value"))))


@query("fn_fresh_terms", "SELECT count(*) AS n, count(*) AS nodes, count(*) AS uuids, count(*) AS struuids, true AS shaped, true AS unit FROM part")
def _(t: Tables):
    # every row makes three new keys: dealt out first, as one scan task may hold very many rows of a small file
    rows = parts(t).df.select("part").repartition(max(64, int(t.spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    a = rows.select(X.bnode().alias("b"), X.uuid().alias("u"), X.struuid().alias("s"), X.rand().alias("r"))
    shape = F.col("u.value").rlike("^urn:uuid:[0-9a-f-]{36}$") & F.col("s.value").rlike("^[0-9a-f-]{36}$")
    return a.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("nodes"), F.countDistinct("u").alias("uuids"),
                 F.countDistinct("s").alias("struuids"), F.min(shape).alias("shaped"), F.min((F.col("r") >= 0) & (F.col("r") < 1)).alias("unit"))


DOC = "'urn:document/' || doc_id AS key"


@query("fn_strlen_case", f"SELECT {DOC}, length(text) AS n, md5(lower(text)) AS low, length(text) = n_chars AS agrees FROM documents")
def _(t: Tables):
    return out(documents(t), "d", n=X.strlen("?text").cast("bigint"), low=F.md5(lex(X.lcase("?text"))), agrees=X.strlen("?text") == X.xsd_integer("?chars"))


@query("fn_ucase", f"SELECT {PART}, upper(p_name) AS up, lower(p_brand) AS low FROM part")
def _(t: Tables):
    return out(parts(t), "part", up=lex(X.ucase("?name")), low=lex(X.lcase("?brand")))


@query("fn_substr", f"""
    SELECT {DOC}, substring(text, 3, 5) AS mid, substring(text, 1, 1) AS from_zero, md5(substring(text, 10)) AS rest, '' AS none FROM documents""")
def _(t: Tables):
    return out(documents(t), "d", mid=lex(X.substr("?text", 3, 5)), from_zero=lex(X.substr("?text", 0, 2)),
               rest=F.md5(lex(X.substr("?text", 10))), none=lex(X.substr("?text", -5, 3)))


@query("fn_string_tests", """
    SELECT 'urn:page/' || page_id AS key, starts_with(url, 'https://') AS starts, ends_with(url, '.html') AS ends,
           contains(html, '&amp;') AS has, contains(url, substring(url, 9, 4)) AS has_var FROM pages""")
def _(t: Tables):
    return out(pages(t), "p", starts=X.strstarts("?url", "https://"), ends=X.strends("?url", ".html"), has=X.contains("?html", "&amp;"),
               has_var=X.contains("?url", X.substr("?url", 9, 4)))


@query("fn_strbefore_after", """
    SELECT 'urn:page/' || page_id AS key, CASE WHEN instr(url, '?') > 0 THEN split_part(url, '?', 1) ELSE '' END AS before,
           CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS after, '' AS absent, url AS all_after FROM pages""")
def _(t: Tables):
    return out(pages(t), "p", before=lex(X.strbefore("?url", Lit("?"))),
               after=lex(X.strafter("?url", "://")), absent=lex(X.strbefore("?url", "\u0007")), all_after=lex(X.strafter("?url", "")))


@query("fn_encode_for_uri", "SELECT 'urn:page/' || page_id AS key, url_encode(url) AS url, md5(url_encode(html)) AS html FROM pages")
def _(t: Tables):
    return out(pages(t), "p", url=lex(X.encode_for_uri("?url")), html=F.md5(lex(X.encode_for_uri("?html"))))


@query("fn_concat", f"""
    SELECT {PART}, p_brand || ': ' || p_name AS plain, 'en' AS same_tag, '' AS mixed_tag FROM part""")
def _(t: Tables):
    en = X.strlang("?name", "en")
    return out(parts(t), "part", plain=lex(X.concat("?brand", ": ", "?name")), same_tag=X.concat(en, en)["lang"], mixed_tag=X.concat(en, "?brand")["lang"])


@query("fn_langmatches", f"""
    SELECT {DOC}, lang = 'de' AS de, true AS region, lang <> '' AS any_tag, contains(text, 'en') AS in_lang,
           CAST(NULL AS BOOLEAN) AS clash FROM documents""")
def _(t: Tables):
    a = documents(t)
    tagged = literal_term(F.col("text.value"), "rdf:langString", F.col("dl.value"))
    region = literal_term(F.concat(F.col("dl.value"), F.lit("-AT")))
    return out(a, "d", de=X.langmatches(X.lang(tagged), "DE"), region=X.or_(*[X.langmatches(region, x) for x in ("de", "en", "fr", "es")]),
               any_tag=X.langmatches(X.lang(tagged), "*"), in_lang=X.contains(tagged, "en"), clash=X.contains(tagged, X.strlang("en", "it")))


@query("fn_regex", """
    SELECT 'urn:page/' || page_id AS key, regexp_matches(url, '^https?://[a-z]+\\.') AS m, regexp_matches(url, 'EXAMPLE\\.(com|org)', 'i') AS mi,
           contains(url, '.html') AS q FROM pages""")
def _(t: Tables):
    return out(pages(t), "p", m=X.regex("?url", "^https?://[a-z]+\\."), mi=X.regex("?url", "EXAMPLE\\.(com|org)", "i"), q=X.regex("?url", ".html", "q"))


@query("fn_replace", """
    SELECT 'urn:page/' || page_id AS key, regexp_replace(url, '(\\w+)\\.example', '\\1.test', 'g') AS r,
           md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS bare, regexp_replace(url, 'HTTPS?', 'x', 'gi') AS ri FROM pages""")
def _(t: Tables):
    return out(pages(t), "p", r=lex(X.replace("?url", "(\\w+)\\.example", "$1.test")), bare=F.md5(lex(X.replace("?html", "<[^>]*>", ""))),
               ri=lex(X.replace("?url", "HTTPS?", "x", "i")))


@query("compare_large_constant", f"""
    SELECT {PART}, p_size = 26 AS eq, p_size > 26 AS gt, p_size <= 26 AS le, p_size IN (26, 3) AS among FROM part""")
def _(t: Tables):
    """Integers beyond 2^53, which doubles cannot tell apart."""
    base = 9007199254740992
    x = lambda: X.add("?size", base)
    return out(parts(t), "part", eq=X.eq(x(), base + 26), gt=X.gt(x(), base + 26), le=X.le(x(), base + 26), among=X.in_(x(), base + 26, base + 3))


@query("multiply_small", f"""
    SELECT {PART}, CAST(p_size AS VARCHAR) AS back, p_size / 8.0 AS eighth FROM part""")
def _(t: Tables):
    tiny, large = literal_term(F.lit("0.0000000001"), "xsd:decimal"), 10_000_000_000
    back = X.multiply(X.multiply("?size", tiny), large)
    return out(parts(t), "part", back=lex(back), eighth=num(X.divide(X.multiply("?size", tiny), literal_term(F.lit("0.0000000008"), "xsd:decimal"))))


@query("cast_long_integer", f"""
    SELECT {PART}, CAST(1234567890123456789012345678 + CAST(p_size AS HUGEINT) AS VARCHAR) AS whole FROM part""")
def _(t: Tables):
    text = X.concat("123456789012345678901234", X.str_(X.add("?size", 5678)))
    return out(parts(t), "part", whole=X.xsd_integer(text).cast("string"))


@query("column_arguments", f"""
    SELECT {PART}, substr(p_name, p_size, 3) AS piece, contains(p_name, p_brand) AS quoted,
           replace(p_name, substr(p_name, 1, 2), '$1') AS changed, true AS matches FROM part""")
def _(t: Tables):
    """SUBSTR, REGEX, REPLACE and LANGMATCHES with arguments that differ by row."""
    tag = X.concat("x", X.str_("?size"))
    return out(parts(t), "part", piece=lex(X.substr("?name", "?size", 3)), quoted=X.regex("?name", "?brand", "q"),
               changed=lex(X.replace("?name", X.substr("?name", 1, 2), "$1", "q")), matches=X.langmatches(tag, tag))


@query("fn_datetime_parts", """
    SELECT 'urn:event/' || event_id AS key, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi,
           microsecond(ts) / 1000000.0 AS s, '+02:00' AS tz, 'PT2H' AS timezone FROM events""")
def _(t: Tables):
    long = lambda c: c.cast("bigint")
    return out(events(t), "e", y=long(X.year("?ts")), m=long(X.month("?ts")), d=long(X.day("?ts")), h=long(X.hours("?ts")),
               mi=long(X.minutes("?ts")), s=X.seconds("?ts").cast("double"), tz=lex(X.tz("?ts")), timezone=lex(X.timezone("?ts")))


@query("fn_datetime_compare", """
    SELECT 'urn:event/' || event_id AS key, ts - INTERVAL 2 HOUR < TIMESTAMP '2024-01-10 00:00:00' AS early,
           epoch_us(ts - INTERVAL 2 HOUR) AS us, ts - INTERVAL 2 HOUR = TIMESTAMP '2024-01-10' AS same, true AS past FROM events""")
def _(t: Tables):
    at = Lit("2024-01-10T00:00:00Z", "xsd:dateTime")
    return out(events(t), "e", early=X.lt("?ts", at), us=F.unix_micros(X.xsd_datetime("?ts")), same=X.eq("?ts", at), past=X.xsd_datetime("?ts") < X.now())


@query("fn_hash", f"SELECT {DOC}, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _(t: Tables):
    return out(documents(t), "d", md5=lex(X.md5("?text")), sha1=lex(X.sha1("?text")), sha256=lex(X.sha256("?text")))


@query("fn_hash_long", f"SELECT {DOC}, 96 AS n384, 128 AS n512 FROM documents")
def _(t: Tables):
    size = lambda c: F.length(lex(c)).cast("bigint")
    return out(documents(t), "d", n384=size(X.sha384("?text")), n512=size(X.sha512("?text")))


@query("fn_casts", f"""
    SELECT {PART}, CAST(p_size AS DOUBLE) AS str_dec, CAST(NULL AS DOUBLE) AS bad_dec, CAST(trunc(p_retailprice) AS BIGINT) AS int_dbl,
           CAST(NULL AS BIGINT) AS int_text, p_size * 1.0 AS dbl, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS flt, p_size <> 0 AS bool_num,
           CAST(NULL AS BOOLEAN) AS bool_yes, true AS bool_one, CAST(p_size AS VARCHAR) AS s, CAST(NULL AS DOUBLE) AS exp_dec FROM part""")
def _(t: Tables):
    return out(parts(t), "part", str_dec=X.xsd_decimal(X.str_("?size")).cast("double"), bad_dec=X.xsd_decimal("?name").cast("double"),
               int_dbl=X.xsd_integer("?price").cast("bigint"), int_text=X.xsd_integer("?name").cast("bigint"), dbl=X.xsd_double("?size"), flt=X.xsd_float("?price").cast("double"),
               bool_num=X.xsd_boolean("?size"), bool_yes=X.xsd_boolean("yes"), bool_one=X.xsd_boolean("1"), s=lex(X.xsd_string("?size")),
               exp_dec=X.xsd_decimal("1e3").cast("double"))


@query("fn_cast_datetime", "SELECT 'urn:order/' || o_orderkey AS key, epoch_us(o_orderdate) AS us, true AS bad FROM orders")
def _(t: Tables):
    a = bgp(graph(t), ("?o", P["date"], "?d"), ("?o", P["status"], "?st"))
    return out(a, "o", us=F.unix_micros(X.xsd_datetime(X.str_("?d"))), bad=X.xsd_datetime("?st").isNull())
