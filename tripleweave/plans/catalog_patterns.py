"""Checked queries: graph patterns and property paths over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.terms import IRI, RDF_TYPE, Lit, instant, iri_term, lex, literal_term, num
from ..operators import aggregates as agg
from ..operators.diff import assign_graph
from ..operators.forms import ask_form, select_form
from ..operators.graph import FunctionalGraph
from ..operators.modifiers import desc, order_by, project, slice_
from ..operators.paths import Alt, Inv, Neg, Opt, Plus, Seq, Star, path
from ..operators.patterns import (
    Solutions, bgp, bind, cross_join, dataset, exists, exists_value, filter_, filter_bound, join, minus, not_exists,
    optional, triple_pattern, union, values,
)
from ..operators.ranges import range_join
from ..session import scratch_path
from ..sources.ingest import store_by_subject
from .model import C, P, graph
from .registry import Tables, query


def _iri(cls: str, column, name: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return iri_term(F.concat(F.lit(f"urn:{cls}/"), c.cast("string")), nullable=False).alias(name)


def show(a: Solutions, *names: str) -> DataFrame:
    return select_form(a, *names)


# --- the flagship: substations with regions and voltage levels, on customers, nations, regions and orders --------

def region_summary(t: Tables) -> Solutions:
    g = graph(t)
    region = optional(bgp(g, ("?nation", P["region"], "?region")), bgp(g, ("?region", P["name"], "?regionName")))
    nation = optional(bgp(g, ("?customer", P["nation"], "?nation")), bgp(g, ("?nation", P["name"], "?nationName")))
    orders = bgp(g, ("?order", RDF_TYPE, C["order"]), ("?order", P["customer"], "?customer"))
    totals = bind(bgp(g, ("?order", P["total"], "?raw")), "total", X.xsd_decimal("?raw"))
    a = bgp(g, ("?customer", RDF_TYPE, C["customer"]))
    a = optional(a, bgp(g, ("?customer", P["name"], "?customerName")))
    a = optional(a, optional(nation, region))
    a = optional(a, optional(orders, totals))
    a = agg.group(a, ["customer", "customerName", "nationName", "regionName"],
                  orderCount=agg.count_distinct("order"), maxTotal=agg.max_("total"))
    return order_by(a, X.lcase(X.str_("?customerName")))


@query("region_summary", """
    SELECT 'urn:customer/' || c_custkey AS customer, c_name AS "customerName", n_name AS "nationName", r_name AS "regionName",
           CAST(count(DISTINCT o_orderkey) AS VARCHAR) AS "orderCount",
           regexp_replace(CAST(CAST(max(o_totalprice) AS DOUBLE) AS VARCHAR), '\\.0$', '') AS "maxTotal"
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
         LEFT JOIN orders ON o_custkey = c_custkey
    GROUP BY c_custkey, c_name, n_name, r_name""")
def _(t: Tables):
    return show(region_summary(t), "customer", "customerName", "nationName", "regionName", "orderCount", "maxTotal")


# --- basic patterns -----------------------------------------------------------------------------------

@query("triple_pattern", """
    SELECT 'urn:order/' || o_orderkey AS o, o_orderstatus AS status FROM orders""")
def _(t: Tables):
    return show(triple_pattern(graph(t), "?o", P["status"], "?status"))


@query("triple_pattern_all", """
    SELECT 'urn:nation/' || n_nationkey AS s, 'urn:p/name' AS p, n_name AS o FROM nation WHERE n_name = 'NATION_7'
    UNION ALL SELECT 'urn:customer/' || c_custkey, 'urn:p/nation', 'urn:nation/7' FROM customer WHERE c_nationkey = 7
    UNION ALL SELECT 'urn:supplier/' || s_suppkey, 'urn:p/nation', 'urn:nation/7' FROM supplier WHERE s_nationkey = 7""")
def _(t: Tables):
    g = graph(t)
    refs = bind(triple_pattern(g, "?s", "?p", IRI("urn:nation/7")), "o", IRI("urn:nation/7"))
    names = bind(triple_pattern(g, "?s", "?p", Lit("NATION_7")), "o", Lit("NATION_7"))
    return show(union(refs, names), "s", "p", "o")


COUNTED = {  # predicates of the table graph that every row of a table has, by table
    "region": ["name"], "nation": ["name", "region"], "customer": ["name", "acctbal", "segment", "nation"],
    "supplier": ["name", "acctbal", "nation"], "part": ["name", "brand", "ptype", "size", "price"],
    "orders": ["status", "total", "date", "priority", "customer"],
    "lineitem": ["line", "quantity", "extended", "discount", "returnflag", "linestatus", "shipdate", "order", "part", "supplier"],
    "events": ["ts", "etype", "value", "props", "user"], "documents": ["text", "dlang", "dsource", "chars"], "pages": ["url", "html"],
    "labels": ["quality", "toxic", "labels"]}


@query("triple_pattern_open", "SELECT p, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT unnest([{', '.join(repr('urn:p/' + x) for x in names)}, '{RDF_TYPE}']) AS p, (SELECT count(*) FROM {table}) AS n"
    for table, names in COUNTED.items()) + ") GROUP BY p")
def _(t: Tables):
    """Three variables: every triple of every table, counted by predicate."""
    a = agg.group(triple_pattern(graph(t), "?s", "?p", "?o"), ["p"], n=agg.count_star())
    return a.df.select(lex(F.col("p")).alias("p"), "n")


@query("repeated_variable", """
    SELECT 'urn:customer/' || c_custkey AS x, count(*) AS n FROM customer JOIN orders ON o_orderkey = c_custkey AND o_custkey = c_custkey
    GROUP BY c_custkey""")
def _(t: Tables):
    # ?x likes ?x: an edge order key -> customer key in one namespace, matched with one variable in both places
    e = t("orders").select(_iri("customer", "o_orderkey", "s"), F.lit("urn:p/edge").alias("p"),
                           _iri("customer", "o_custkey", "o"), F.lit("").alias("g"))
    a = agg.group(triple_pattern(e, "?x", P["edge"], "?x"), ["x"], n=agg.count_star())
    return a.df.select(lex(F.col("x")).alias("x"), "n")


@query("bgp_join", """
    SELECT s_name AS "supplierName", n_name AS "nationName", r_name AS "regionName"
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables):
    return show(bgp(graph(t), ("?s", RDF_TYPE, C["supplier"]), ("?s", P["name"], "?supplierName"), ("?s", P["nation"], "?n"),
                    ("?n", P["name"], "?nationName"), ("?n", P["region"], "?r"), ("?r", P["name"], "?regionName")),
                "supplierName", "nationName", "regionName")


@query("bgp_fact_join", """
    SELECT n_name AS nation, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name""")
def _(t: Tables):
    a = bgp(graph(t), ("?l", P["order"], "?o"), ("?l", P["extended"], "?x"), ("?o", P["customer"], "?c"),
            ("?c", P["nation"], "?n"), ("?n", P["name"], "?nation"))
    a = bind(a, "amount", X.xsd_decimal("?x"))
    a = agg.group(a, ["nation"], n=agg.count_star(), revenue=agg.sum_("amount"))
    return a.df.select(lex(F.col("nation")).alias("nation"), "n", F.col("revenue").cast("double").alias("revenue"))


@query("join_hot_keys", """
    SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def _(t: Tables):
    g = graph(t)
    regions = bgp(g, ("?c", RDF_TYPE, C["customer"]), ("?c", P["nation"], "?n"), ("?n", P["region"], "?r"))  # five keys hold everything: all are hot
    a = join(regions, bgp(g, ("?r", P["name"], "?region")), hot_keys=True)
    a = agg.group(a, ["region"], n=agg.count_star())
    return a.df.select(lex(F.col("region")).alias("region"), "n")


@query("star_functional", """
    SELECT 'urn:part/' || p_partkey AS part, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_type = 'ECONOMY'""")
def _(t: Tables):
    g = graph(t)
    narrow = g.scan("urn:p/brand").unionByName(g.scan("urn:p/size")).unionByName(g.scan("urn:p/ptype"))
    fg = FunctionalGraph(narrow, ["urn:p/brand", "urn:p/size", "urn:p/ptype"])
    return show(bgp(fg, ("?part", P["brand"], "?brand"), ("?part", P["size"], "?size"), ("?part", P["ptype"], Lit("ECONOMY"))))


@query("cross_join", """
    SELECT 'urn:supplier/' || s_suppkey AS s, (SELECT count(*) FROM customer) AS customers FROM supplier""")
def _(t: Tables):
    g = graph(t)
    total = agg.group(bgp(g, ("?c", RDF_TYPE, C["customer"])), customers=agg.count_star())
    a = cross_join(bgp(g, ("?s", RDF_TYPE, C["supplier"])), total)
    return a.df.select(lex(F.col("s")).alias("s"), "customers")


@query("cross_join_tables", "SELECT s_name AS supplier, n_name AS nation FROM supplier CROSS JOIN nation")
def _(t: Tables):
    """Two tables without a bound on their rows: the product is dealt out by salts."""
    g = graph(t)
    names = lambda cls, v: project(bgp(g, ("?x", RDF_TYPE, C[cls]), ("?x", P["name"], v)), v)
    return show(cross_join(names("supplier", "?supplier"), names("nation", "?nation")))


@query("range_join", """
    SELECT 'urn:customer/' || c_custkey AS c, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high
    FROM customer JOIN orders ON o_totalprice > CAST(c_acctbal AS DECIMAL(18,2)) * 20
         AND o_totalprice <= CAST(c_acctbal AS DECIMAL(18,2)) * 20 + 500 GROUP BY c_custkey""")
def _(t: Tables):
    """Orders within a band of 500 above twenty times a customer's balance; no variable is shared."""
    g = graph(t)
    orders, customers = bgp(g, ("?o", P["total"], "?total")), bgp(g, ("?c", P["acctbal"], "?bal"), ("?c", RDF_TYPE, C["customer"]))
    low = X.multiply("?bal", 20)
    customers = bind(bind(customers, "low", low), "high", X.add("?low", 500))
    # numbers are read out of their terms once a row, not once a pair
    orders = project(bind(orders, "amount", X.xsd_decimal("?total")), "amount")
    customers = project(bind(bind(customers, "from", X.xsd_decimal("?low")), "to", X.xsd_decimal("?high")), "c", "from", "to")
    a = range_join(orders, customers, "?amount", "?from", "?to", on=(">", "<="))
    a = agg.group(a, ["c"], n=agg.count_star(), low=agg.min_("amount"), high=agg.max_("amount"))
    return a.df.select(lex(F.col("c")).alias("c"), "n", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


@query("range_join_dates", """
    SELECT o_orderpriority AS priority, l_returnflag AS flag, count(*) AS n FROM lineitem JOIN orders
    ON l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 1 DAY GROUP BY ALL""")
def _(t: Tables):
    """Line items shipped on the day that follows any order; one bound is a term, the other a native column."""
    g = graph(t)
    lines = bgp(g, ("?l", P["shipdate"], "?shipped"), ("?l", P["returnflag"], "?flag"))
    orders = bgp(g, ("?o", P["date"], "?date"), ("?o", P["priority"], "?priority"))
    orders = bind(orders, "until", instant("?date") + F.expr("INTERVAL 1 DAY"))
    # rows that no later step can tell apart meet as one: pairs grow with the dates and groups, and counts are multiplied
    lines = agg.group(lines, ["shipped", "flag"], lines=agg.count_star())
    orders = agg.group(orders, ["date", "until", "priority"], orders=agg.count_star())
    a = range_join(lines, orders, "?shipped", "?date", "?until", on=instant("?shipped") < F.col("until"))
    a = bind(a, "pairs", F.col("lines").cast("decimal(38,0)") * F.col("orders"))
    a = agg.group(a, ["priority", "flag"], n=agg.sum_("pairs"))
    return a.df.select(lex(F.col("priority")).alias("priority"), lex(F.col("flag")).alias("flag"), F.col("n").cast("bigint").alias("n"))


@query("star_stored", """
    SELECT 'urn:order/' || o_orderkey AS o, o_orderstatus AS status, o_orderpriority AS priority, c_name AS name
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t: Tables):
    """A star of three predicates over triples stored by subject, which needs no shuffle, and a chain from it."""
    g = graph(t)
    rows = [g.scan(P[p].value) for p in ("status", "priority", "customer")] + [g.scan(P["name"].value).where(F.col("s.value").startswith("urn:customer/"))]
    kept = store_by_subject(reduce(DataFrame.unionByName, rows), scratch_path(t.spark, "by-subject"), 8)
    return show(bgp(kept, ("?o", P["status"], "?status"), ("?o", P["priority"], "?priority"), ("?o", P["customer"], "?c"),
                    ("?c", P["name"], "?name")), "o", "status", "priority", "name")


# --- optional, compatible joins, set operators --------------------------------------------------------

@query("optional", """
    SELECT 'urn:order/' || o_orderkey AS o, coalesce(l_returnflag, '') AS flag, count(*) AS n
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(t: Tables):
    g = graph(t)
    a = optional(bgp(g, ("?o", RDF_TYPE, C["order"])), bgp(g, ("?l", P["order"], "?o"), ("?l", P["returnflag"], "?flag")))
    a = agg.group(a, ["o", "flag"], n=agg.count_star())
    return a.df.select(lex(F.col("o")).alias("o"), F.coalesce(lex(F.col("flag")), F.lit("")).alias("flag"), "n")


@query("optional_nested", """
    SELECT 'urn:supplier/' || s_suppkey AS s, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region
    FROM supplier LEFT JOIN (SELECT * FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'
                             WHERE n_name <> 'NATION_3') ON s_nationkey = n_nationkey""")
def _(t: Tables):
    g = graph(t)
    region = filter_(bgp(g, ("?n", P["region"], "?r"), ("?r", P["name"], "?region")), X.ne("?region", "ASIA"))
    nation = filter_(bgp(g, ("?s", P["nation"], "?n"), ("?n", P["name"], "?nation")), X.ne("?nation", "NATION_3"))
    a = optional(bgp(g, ("?s", RDF_TYPE, C["supplier"])), optional(nation, region))
    return show(a, "s", "nation", "region")


@query("optional_filter", """
    SELECT 'urn:customer/' || c_custkey AS c, coalesce('urn:order/' || o_orderkey, '') AS o
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 AND o_totalprice > c_acctbal * 50""")
def _(t: Tables):
    g = graph(t)
    a = bgp(g, ("?c", RDF_TYPE, C["customer"]), ("?c", P["acctbal"], "?bal"))
    b = bgp(g, ("?o", P["customer"], "?c"), ("?o", P["total"], "?total"))
    on = X.gt("?total", 400000) & X.gt("?total", X.multiply("?bal", 50))
    return show(optional(a, b, on), "c", "o")


@query("compat_join", """
    WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS v FROM customer),
         b AS (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 25 END AS v FROM orders)
    SELECT 'urn:customer/' || a.k AS c, 'urn:order/' || b.o AS o, coalesce('urn:nation/' || coalesce(a.v, b.v), '') AS v
    FROM a JOIN b ON a.k = b.k AND (a.v IS NULL OR b.v IS NULL OR a.v = b.v)""")
def _(t: Tables):
    a, b = _compat_sides(t)
    return show(join(a, b), "c", "o", "v")


def _compat_sides(t: Tables) -> tuple[Solutions, Solutions]:
    """Customers and orders that share a customer and a nation which either side may leave unbound."""
    g = graph(t)
    a = optional(bgp(g, ("?c", RDF_TYPE, C["customer"])),
                 project(filter_(bgp(g, ("?c", P["nation"], "?v"), ("?c", P["acctbal"], "?b")), X.gt("?b", 5000)), "c", "v"))
    b = bgp(g, ("?o", P["customer"], "?c"), ("?o", P["status"], "?st"))
    number = F.substring(F.col("o.value"), len("urn:order/") + 1, 20).cast("bigint") % 25
    nation = X.if_(X.ne("?st", "O"), X.iri(X.concat("urn:nation/", literal_term(number.cast("string")))), F.lit(None))
    return a, project(bind(b, "v", nation), "c", "o", "v")


@query("compat_optional", """
    WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS v FROM customer),
         b AS (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 25 END AS v FROM orders)
    SELECT 'urn:customer/' || a.k AS c, coalesce('urn:order/' || b.o, '') AS o,
           coalesce('urn:nation/' || coalesce(a.v, b.v), '') AS v
    FROM a LEFT JOIN b ON a.k = b.k AND (a.v IS NULL OR b.v IS NULL OR a.v = b.v)""")
def _(t: Tables):
    a, b = _compat_sides(t)
    return show(optional(a, b), "c", "o", "v")


@query("minus_unbound", """
    WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS v FROM customer),
         b AS (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 25 END AS v
               FROM orders WHERE o_orderstatus <> 'O')
    SELECT 'urn:customer/' || a.k AS c, coalesce('urn:nation/' || a.v, '') AS v FROM a
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND (a.v IS NULL OR b.v IS NULL OR a.v = b.v))""")
def _(t: Tables):
    a, b = _compat_sides(t)
    return show(minus(a, filter_bound(b, "v")), "c", "v")


@query("union", """
    SELECT 'urn:customer/' || c_custkey AS c, '' AS s, c_name AS name FROM customer WHERE c_nationkey = 7
    UNION ALL SELECT '', 'urn:supplier/' || s_suppkey, s_name FROM supplier WHERE s_nationkey = 7""")
def _(t: Tables):
    g = graph(t)
    part = lambda v: bgp(g, (v, P["nation"], IRI("urn:nation/7")), (v, P["name"], "?name"))
    a = filter_(part("?c"), X.strstarts(X.str_("?c"), "urn:customer/"))
    b = filter_(part("?s"), X.strstarts(X.str_("?s"), "urn:supplier/"))
    return show(union(a, b), "c", "s", "name")


@query("minus", """
    SELECT 'urn:order/' || o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def _(t: Tables):
    g = graph(t)
    return show(minus(bgp(g, ("?o", RDF_TYPE, C["order"])), bgp(g, ("?l", P["order"], "?o"))))


@query("minus_disjoint", "SELECT 'urn:region/' || r_regionkey AS r FROM region")
def _(t: Tables):
    g = graph(t)
    return show(minus(bgp(g, ("?r", RDF_TYPE, C["region"])), bgp(g, ("?x", P["nation"], "?y"))))


@query("filter", """
    SELECT 'urn:order/' || o_orderkey AS o FROM orders WHERE o_totalprice >= 220000 AND o_orderpriority <> '5-LOW'""")
def _(t: Tables):
    a = bgp(graph(t), ("?o", P["total"], "?total"), ("?o", P["priority"], "?pr"))
    return show(filter_(a, X.ge("?total", 220000) & X.ne("?pr", "5-LOW")), "o")


@query("filter_exists", """
    SELECT 'urn:supplier/' || s_suppkey AS s FROM supplier
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')""")
def _(t: Tables):
    g = graph(t)
    return show(exists(bgp(g, ("?s", RDF_TYPE, C["supplier"])),
                       bgp(g, ("?l", P["supplier"], "?s"), ("?l", P["returnflag"], Lit("R")))))


@query("filter_not_exists", """
    SELECT 'urn:customer/' || c_custkey AS c FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000 AND o_totalprice > 40 * c_acctbal)""")
def _(t: Tables):
    g = graph(t)
    b = bgp(g, ("?o", P["customer"], "?c"), ("?o", P["total"], "?total"))
    on = X.gt("?total", 300000) & X.gt("?total", X.multiply(40, "?bal"))
    return show(not_exists(bgp(g, ("?c", P["acctbal"], "?bal"), ("?c", RDF_TYPE, C["customer"])), b, on), "c")


@query("exists_value", """
    SELECT 'urn:customer/' || c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending
    FROM customer""")
def _(t: Tables):
    g = graph(t)
    a = exists_value(bgp(g, ("?c", RDF_TYPE, C["customer"])),
                     bgp(g, ("?o", P["customer"], "?c"), ("?o", P["status"], Lit("P"))), "pending")
    return a.df.select(lex(F.col("c")).alias("c"), "pending")


@query("bind", """
    SELECT 'urn:part/' || p_partkey AS part, p_brand || ' / ' || p_name AS label, p_size * 2 AS twice FROM part""")
def _(t: Tables):
    a = bgp(graph(t), ("?part", P["brand"], "?b"), ("?part", P["name"], "?n"), ("?part", P["size"], "?z"))
    a = bind(bind(a, "label", X.concat("?b", " / ", "?n")), "twice", X.multiply("?z", 2))
    return a.df.select(lex(F.col("part")).alias("part"), lex(F.col("label")).alias("label"),
                       X.xsd_integer("?twice").cast("bigint").alias("twice"))


@query("values", """
    SELECT 'urn:customer/' || c_custkey AS c, v.tag AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN (VALUES ('NATION_1', 'one'), ('NATION_2', 'two'), (NULL, 'any')) v(name, tag) ON v.name IS NULL OR v.name = n_name""")
def _(t: Tables):
    g = graph(t)
    wanted = values(t.spark, ["name", "tag"], [("NATION_1", "one"), ("NATION_2", "two"), (None, "any")])
    return show(join(bgp(g, ("?c", P["nation"], "?n"), ("?n", P["name"], "?name"), ("?c", RDF_TYPE, C["customer"])), wanted), "c", "tag")


@query("subselect", """
    SELECT 'urn:customer/' || c AS c, n_name AS nation, spend FROM (
        SELECT o_custkey AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders
        GROUP BY o_custkey ORDER BY spend DESC, c LIMIT 10)
    JOIN customer ON c_custkey = c JOIN nation ON n_nationkey = c_nationkey""")
def _(t: Tables):
    g = graph(t)
    spend = bind(bgp(g, ("?o", P["customer"], "?c"), ("?o", P["total"], "?t")), "amount", X.xsd_decimal("?t"))
    top = agg.group(spend, ["c"], spend=agg.sum_("amount"))
    top = slice_(order_by(top, desc("spend"), F.substring(F.col("c.value"), 14, 20).cast("bigint")), limit=10)
    a = join(bgp(g, ("?c", P["nation"], "?n"), ("?n", P["name"], "?nation")), project(top, "c", "spend"))
    return a.df.select(lex(F.col("c")).alias("c"), lex(F.col("nation")).alias("nation"), F.col("spend").cast("double").alias("spend"))


@query("theta_join", """
    SELECT 'urn:order/' || o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal * 30 < o_totalprice""")
def _(t: Tables):
    g = graph(t)
    a = join(bgp(g, ("?o", P["customer"], "?c"), ("?o", P["total"], "?total")), bgp(g, ("?c", P["acctbal"], "?bal")))
    return show(filter_(a, X.lt(X.multiply("?bal", 30), "?total")), "o")


def _six(a: Solutions, key: str, value: str) -> Solutions:
    """Six variables ``?v0 .. ?v5``; ``?vi`` is bound if bit i of the key column is set."""
    number = lambda v: F.substring_index(F.col(f"{v}.value"), "/", -1).cast("bigint")
    cells = {f"v{i}": X.if_((F.shiftright(number(key), i) % 2) == 1, literal_term(((number(value) + i) % 5).cast("string")), F.lit(None))
             for i in range(6)}
    return project(a, *a.vars, **cells)


SIX_SQL = ", ".join("CASE WHEN ({key} >> %d) %% 2 = 1 THEN CAST(({value} + %d) %% 5 AS VARCHAR) END AS v%d" % (i, i, i) for i in range(6))
SIX_SQL = (f"WITH a AS (SELECT c_custkey AS c, {SIX_SQL.format(key='c_custkey', value='c_custkey')} FROM customer), "
           f"b AS (SELECT o_custkey AS c, o_orderkey AS o, {SIX_SQL.format(key='o_orderkey', value='o_orderkey')} FROM orders) ")
SIX_ON = "a.c = b.c AND " + " AND ".join(f"coalesce(a.v{i} = b.v{i}, true)" for i in range(6))


@query("compat_join_six", SIX_SQL + f"""
    SELECT 'urn:customer/' || a.c AS c, 'urn:order/' || o AS o, {', '.join(f"coalesce(a.v{i}, b.v{i}, '') AS v{i}" for i in range(6))}
    FROM a JOIN b ON {SIX_ON}""")
def _(t: Tables):
    """Six variables that either side may leave unbound: 64 signatures each."""
    return show(join(*_six_sides(t)), "c", "o", *[f"v{i}" for i in range(6)])


def _six_sides(t: Tables) -> tuple[Solutions, Solutions]:
    g = graph(t)
    return (_six(bgp(g, ("?c", RDF_TYPE, C["customer"])), "c", "c"), _six(bgp(g, ("?o", P["customer"], "?c")), "o", "o"))


@query("minus_six", SIX_SQL + f"SELECT 'urn:customer/' || a.c AS c FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {SIX_ON})")
def _(t: Tables):
    return show(minus(*_six_sides(t)), "c")


# --- named graphs -------------------------------------------------------------------------------------

def _quads(t: Tables) -> DataFrame:
    """Customers' nations in graph a, suppliers' in graph b, nation names in the default graph."""
    tg = graph(t)
    nation = tg.scan("urn:p/nation")
    mine = lambda cls: nation.where(F.col("s.value").startswith(f"urn:{cls}/"))
    names = tg.scan("urn:p/name").where(F.col("s.value").startswith("urn:nation/"))
    return assign_graph(mine("customer"), "urn:g/a").unionByName(assign_graph(mine("supplier"), "urn:g/b")).unionByName(names)


@query("graph_const", """
    SELECT 'urn:supplier/' || s_suppkey AS s, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t: Tables):
    q = _quads(t)
    return show(join(bgp(q, ("?s", P["nation"], "?n"), g="urn:g/b"), bgp(q, ("?n", P["name"], "?name"))), "s", "name")


@query("graph_var", """
    SELECT 'urn:g/a' AS g, 'urn:nation/' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'urn:g/b', 'urn:nation/' || s_nationkey, count(*) FROM supplier GROUP BY s_nationkey""")
def _(t: Tables):
    a = agg.group(triple_pattern(_quads(t), "?s", P["nation"], "?n", "?g"), ["g", "n"], k=agg.count_star())
    return a.df.select(lex(F.col("g")).alias("g"), lex(F.col("n")).alias("n"), "k")


@query("from_dataset", """
    SELECT 'default' AS place, 'urn:customer/' || c_custkey AS s FROM customer
    UNION ALL SELECT 'default', 'urn:supplier/' || s_suppkey FROM supplier
    UNION ALL SELECT 'urn:g/b', 'urn:supplier/' || s_suppkey FROM supplier""")
def _(t: Tables):
    d = dataset(_quads(t), from_=["urn:g/a", "urn:g/b"], from_named=["urn:g/b"])
    a = bind(triple_pattern(d, "?s", "?p", "?n"), "place", Lit("default"))
    b = triple_pattern(d, "?s", "?p", "?n", "?place")
    return show(union(a, b), "place", "s")


# --- property paths -----------------------------------------------------------------------------------

@query("path_seq", """
    SELECT 'urn:order/' || o_orderkey AS o, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables):
    return show(path(graph(t), "?o", Seq(P["customer"], P["nation"], P["region"], P["name"]), "?region"))


@query("path_inverse", """
    SELECT 'urn:nation/' || n_nationkey AS n, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey""")
def _(t: Tables):
    a = path(graph(t), "?n", Seq(Inv(P["nation"]), Inv(P["customer"])), "?o")
    return agg.group(a, ["n"], k=agg.count_star()).df.select(lex(F.col("n")).alias("n"), "k")


@query("path_alt", """
    SELECT 'urn:nation/' || n_nationkey AS n, 'urn:region/' || n_regionkey AS x FROM nation
    UNION ALL SELECT 'urn:nation/' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'urn:customer/' || c_custkey, c_name FROM customer
    UNION ALL SELECT 'urn:supplier/' || s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'urn:part/' || p_partkey, p_name FROM part
    UNION ALL SELECT 'urn:region/' || r_regionkey, r_name FROM region""")
def _(t: Tables):
    return show(path(graph(t), "?n", Alt(P["region"], P["name"]), "?x"))


@query("path_negated", """
    SELECT 'urn:order/' || o_orderkey AS o, o_orderpriority AS x FROM orders
    UNION ALL SELECT 'urn:order/' || o_orderkey, 'urn:class/order' FROM orders
    UNION ALL SELECT 'urn:order/' || o_orderkey, 'urn:customer/' || o_custkey FROM orders
    UNION ALL SELECT 'urn:customer/' || o_custkey, 'urn:order/' || o_orderkey FROM orders
    UNION ALL SELECT 'urn:class/order', 'urn:order/' || o_orderkey FROM orders
    UNION ALL SELECT CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'urn:order/' || o_orderkey FROM orders""")
def _(t: Tables):
    g = graph(t)
    part = g.scan(P["customer"].value).unionByName(g.scan(P["priority"].value)).unionByName(g.scan(P["total"].value))
    part = part.unionByName(g.scan(RDF_TYPE).where(F.col("o.value") == "urn:class/order"))
    return show(path(part, "?o", Neg(P["total"], Inv(P["priority"])), "?x"))


@query("path_opt", """
    SELECT 'urn:nation/' || n_nationkey AS x, 'urn:region/' || n_regionkey AS y FROM nation
    UNION SELECT 'urn:nation/' || n_nationkey, 'urn:nation/' || n_nationkey FROM nation
    UNION SELECT 'urn:region/' || n_regionkey, 'urn:region/' || n_regionkey FROM nation""")
def _(t: Tables):
    return show(path(graph(t).scan(P["region"].value), "?x", Opt(P["region"]), "?y"))


def _tree(t: Tables) -> DataFrame:
    """Customer k leads to customer k // 2, and customer 0 to itself."""
    return t("customer").select(
        _iri("customer", "c_custkey", "s"), F.lit("urn:p/up").alias("p"),
        _iri("customer", F.expr("c_custkey div 2"), "o"), F.lit("").alias("g"))


TREE_SQL = "WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer), "


@query("path_plus", TREE_SQL + """
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT 'urn:customer/' || a AS x, 'urn:customer/' || b AS y FROM r""")
def _(t: Tables):
    return show(path(_tree(t), "?x", Plus(P["up"]), "?y"))


@query("path_star", TREE_SQL + """
    r AS (SELECT a, b FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT 'urn:customer/' || a AS x, 'urn:customer/' || b AS y FROM r""")
def _(t: Tables):
    return show(path(_tree(t), "?x", Star(P["up"]), "?y"))


CYCLE_SQL = """
    WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
    e AS (SELECT c_custkey AS a, (c_custkey + 7) % 31 + c_custkey // 31 * 31 AS b FROM customer),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT 'urn:customer/' || a AS x, 'urn:customer/' || b AS y FROM r"""


@query("path_plus_cycle", CYCLE_SQL)
def _(t: Tables):
    to = F.expr("(c_custkey + 7) % 31 + c_custkey div 31 * 31")
    e = t("customer").select(_iri("customer", "c_custkey", "s"), F.lit("urn:p/next").alias("p"),
                             _iri("customer", to, "o"), F.lit("").alias("g"))
    return show(path(e, "?x", Plus(P["next"]), "?y"))


MIXED_SQL = """
    WITH RECURSIVE e AS (
      SELECT c_custkey AS a, CASE WHEN c_custkey % 40 < 12 THEN c_custkey // 40 * 40 + (c_custkey % 40 + 5) % 12 ELSE c_custkey // 40 * 40 + c_custkey % 40 // 2 END AS b FROM customer
      UNION SELECT c_custkey, c_custkey + 13 FROM customer WHERE c_custkey % 40 < 27 AND c_custkey % 3 = 0
      UNION SELECT c_custkey, c_custkey + 40 FROM customer WHERE c_custkey % 80 = 3),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT 'urn:customer/' || a AS x, 'urn:customer/' || b AS y FROM r"""


@query("path_plus_mixed", MIXED_SQL)
def _(t: Tables):
    return show(path(_mixed(t), "?x", Plus(P["next"]), "?y"))


def _mixed(t: Tables) -> DataFrame:
    """Rings with trees that lead into them, branches that lead out and back in, and bridges between components."""
    k, c = "c_custkey", t("customer")
    edge = lambda df, to: df.select(_iri("customer", k, "s"), F.lit("urn:p/next").alias("p"), _iri("customer", F.expr(to), "o"), F.lit("").alias("g"))
    e = edge(c, f"if({k} % 40 < 12, {k} div 40 * 40 + ({k} % 40 + 5) % 12, {k} div 40 * 40 + {k} % 40 div 2)")
    return e.unionByName(edge(c.where(f"{k} % 40 < 27 AND {k} % 3 = 0"), f"{k} + 13")).unionByName(edge(c.where(f"{k} % 80 = 3"), f"{k} + 40"))


@query("path_plus_between", MIXED_SQL.replace("SELECT 'urn:customer/' || a AS x, 'urn:customer/' || b AS y FROM r", """
    SELECT 'there' AS way, EXISTS (SELECT 1 FROM r WHERE a = 39 AND b = 3) AS found UNION ALL
    SELECT 'back', EXISTS (SELECT 1 FROM r WHERE a = 3 AND b = 39) UNION ALL
    SELECT 'ring', EXISTS (SELECT 1 FROM r WHERE a = 7 AND b = 7)"""))
def _(t: Tables):
    """Both ends bound: frontiers from both of them meet."""
    e = _mixed(t)
    ask = lambda way, x, y: ask_form(path(e, IRI(f"urn:customer/{x}"), Plus(P["next"]), IRI(f"urn:customer/{y}"))).select(
        F.lit(way).alias("way"), F.col("result").alias("found"))
    return ask("there", 39, 3).unionByName(ask("back", 3, 39)).unionByName(ask("ring", 7, 7))


@query("path_star_from", TREE_SQL + """
    r AS (SELECT 0 AS a UNION SELECT e.a FROM r JOIN e ON r.a = e.b)
    SELECT 'urn:customer/' || a AS x FROM r""")
def _(t: Tables):
    return show(path(_tree(t), "?x", Star(P["up"]), IRI("urn:customer/0")))


@query("path_seq_star", TREE_SQL + """
    r AS (SELECT b AS a, b FROM e WHERE a = 7 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT DISTINCT 'urn:customer/' || b AS y FROM r""")
def _(t: Tables):
    """The closure starts from what the first step of the sequence reaches, not from every node."""
    return show(path(_tree(t), IRI("urn:customer/7"), Seq(P["up"], Star(P["up"])), "?y"))


@query("path_from_solutions", TREE_SQL + """
    w AS (SELECT c_custkey AS a, c_nationkey AS n FROM customer WHERE c_acctbal < 0),
    r AS (SELECT a, a AS b FROM (SELECT DISTINCT w.a FROM w WHERE w.a IN (SELECT a FROM e UNION SELECT b FROM e))
          UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT 'urn:customer/' || w.a AS c, 'urn:nation/' || n AS n, 'urn:customer/' || b AS y FROM w JOIN r ON w.a = r.a""")
def _(t: Tables):
    """A closure seeded by the solutions of a pattern."""
    a = bgp(graph(t), ("?c", P["nation"], "?n"), ("?c", P["acctbal"], "?b"))
    a = project(filter_(a, X.lt("?b", 0)), "c", "n")
    return show(join(a, path(_tree(t), "?c", Star(P["up"]), "?y", seeds=a)), "c", "n", "y")


# --- variables that may be unbound on both sides ------------------------------------------------------

def _urgent(t: Tables) -> Solutions:
    """Orders with ``?k``, bound for urgent ones only."""
    a = bgp(graph(t), ("?o", P["priority"], "?priority"))
    return project(a, "o", k=X.if_(X.eq("?priority", Lit("1-URGENT")), "?priority", F.lit(None)))


URGENT_SQL = """WITH a AS (SELECT 'urn:order/' || o_orderkey AS o, CASE WHEN o_orderpriority = '1-URGENT' THEN '1-URGENT' END AS k FROM orders),
    v(k, label) AS (VALUES ('1-URGENT', 'urgent'), (CAST(NULL AS VARCHAR), 'any'), ('2-HIGH', 'high')) """


def _priorities(t: Tables) -> Solutions:
    return values(t.spark, ["k", "label"], [("1-URGENT", "urgent"), (None, "any"), ("2-HIGH", "high")])


@query("compat_join_unsure", URGENT_SQL + """
    SELECT o, coalesce(a.k, v.k, '') AS k, label FROM a JOIN v ON a.k IS NULL OR v.k IS NULL OR a.k = v.k""")
def _(t: Tables):
    return show(join(_urgent(t), _priorities(t)), "o", "k", "label")


@query("exists_unsure", URGENT_SQL + """
    SELECT o FROM a WHERE EXISTS (SELECT 1 FROM v WHERE v.label <> 'any' AND (a.k IS NULL OR a.k = v.k) AND length(a.o) > length(v.label) + 9)""")
def _(t: Tables):
    sure = filter_(_priorities(t), X.ne("?label", Lit("any")))
    return show(exists(_urgent(t), sure, F.length(lex(F.col("o"))) > F.length(lex(F.col("label"))) + 9), "o")


@query("exists_value_unsure", URGENT_SQL + """
    SELECT o, EXISTS (SELECT 1 FROM v WHERE v.label = 'high' AND (a.k IS NULL OR a.k = v.k)) AS high FROM a""")
def _(t: Tables):
    a = exists_value(_urgent(t), filter_(_priorities(t), X.eq("?label", Lit("high"))), "high")
    return a.df.select(lex(F.col("o")).alias("o"), "high")
