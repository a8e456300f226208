"""The test tables as a graph."""

from __future__ import annotations

from functools import partial

from ..functions.terms import Namespace
from ..operators.graph import TableGraph, TableMap
from .registry import Tables

P = Namespace("urn:p/")
C = Namespace("urn:class/")


def money(c: str) -> str:
    return f"cast({c} as decimal(18,2))"


def stamp(c: str, offset: str = "") -> str:
    return f"concat(date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), '{offset}')"


def graph(t: Tables) -> TableGraph:
    """Key columns are unique; ``lineitem`` has none, its rows are identified by all their columns and differ."""
    def table(name, cls, key, literals, refs=(), distinct_rows=False):
        full = {f"urn:p/{p}": v for p, v in literals.items()}
        return TableMap(partial(t, name), cls, key, full, {f"urn:p/{p}": v for p, v in dict(refs).items()},
                        distinct_rows)

    return TableGraph([
        table("region", "region", "r_regionkey", {"name": ("r_name", "xsd:string")}),
        table("nation", "nation", "n_nationkey", {"name": ("n_name", "xsd:string")}, {"region": ("n_regionkey", "region")}),
        table("customer", "customer", "c_custkey",
              {"name": ("c_name", "xsd:string"), "acctbal": (money("c_acctbal"), "xsd:decimal"),
               "segment": ("c_mktsegment", "xsd:string")}, {"nation": ("c_nationkey", "nation")}),
        table("supplier", "supplier", "s_suppkey",
              {"name": ("s_name", "xsd:string"), "acctbal": (money("s_acctbal"), "xsd:decimal")},
              {"nation": ("s_nationkey", "nation")}),
        table("part", "part", "p_partkey",
              {"name": ("p_name", "xsd:string"), "brand": ("p_brand", "xsd:string"), "ptype": ("p_type", "xsd:string"),
               "size": ("p_size", "xsd:integer"), "price": ("p_retailprice", "xsd:double")}),
        table("orders", "order", "o_orderkey",
              {"status": ("o_orderstatus", "xsd:string"), "total": (money("o_totalprice"), "xsd:decimal"),
               "date": (stamp("o_orderdate"), "xsd:dateTime"), "priority": ("o_orderpriority", "xsd:string")},
              {"customer": ("o_custkey", "customer")}),
        table("lineitem", "lineitem", None,
              {"line": ("l_linenumber", "xsd:integer"), "quantity": ("l_quantity", "xsd:double"),
               "extended": (money("l_extendedprice"), "xsd:decimal"), "discount": (money("l_discount"), "xsd:decimal"),
               "returnflag": ("l_returnflag", "xsd:string"), "linestatus": ("l_linestatus", "xsd:string"),
               "shipdate": (stamp("l_shipdate"), "xsd:dateTime")},
              {"order": ("l_orderkey", "order"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier")},
              distinct_rows=True),
        table("events", "event", "event_id",
              {"ts": (stamp("ts", "+02:00"), "xsd:dateTime"), "etype": ("event_type", "xsd:string"),
               "value": ("value", "xsd:double"), "props": ("props", "xsd:string")}, {"user": ("user_id", "user")}),
        table("documents", "document", "doc_id",
              {"text": ("text", "xsd:string"), "dlang": ("lang", "xsd:string"), "dsource": ("source", "xsd:string"),
               "chars": ("n_chars", "xsd:integer")}),
        table("pages", "page", "page_id", {"url": ("url", "xsd:string"), "html": ("html", "xsd:string")}),
        table("labels", "label", "doc_id",
              {"quality": ("quality", "xsd:integer"), "toxic": ("toxic", "xsd:integer")}, {"labels": ("doc_id", "document")}),
    ])
