"""RDF terms as Spark struct columns.

A term is ``struct<kind, value, dt, lang>``; no field of a non-null term is ever NULL, and an unbound
variable is a NULL struct.  ``kind`` is ``iri``, ``bnode``, ``lit`` or ``triple``.  Datatypes from the
XML Schema namespace are stored with the ``xsd:`` prefix, which keeps rows short in shuffles.

Everything here builds Catalyst expressions; no Python runs per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM_DDL = "struct<kind:string,value:string,dt:string,lang:string>"
TERM_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "dt", "lang")])

# Namespaces and datatype names.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
STRING = "xsd:string"
LANG_STRING = "rdf:langString"
INTEGER_TYPES = (
    "xsd:integer", "xsd:int", "xsd:long", "xsd:short", "xsd:byte",
    "xsd:nonNegativeInteger", "xsd:positiveInteger", "xsd:nonPositiveInteger", "xsd:negativeInteger",
    "xsd:unsignedInt", "xsd:unsignedLong", "xsd:unsignedShort", "xsd:unsignedByte",
)
DECIMAL = "decimal(38,18)"

# Lexical forms of the XML Schema numeric types.
RX_INTEGER = r"^[+-]?[0-9]+$"
RX_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
RX_DOUBLE = r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$"
RX_DATETIME = r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
RX_OFFSET = r"(Z|[+-][0-9]{2}:[0-9]{2})$"
RX_LOCAL = r"^(-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)(?:Z|[+-][0-9]{2}:[0-9]{2})?$"


@dataclass(frozen=True)
class Term:
    """A constant term, used in patterns, templates, VALUES rows and expressions."""

    kind: str
    value: str
    dt: str = ""
    lang: str = ""

    @property
    def row(self) -> tuple[str, str, str, str]:
        return (self.kind, self.value, self.dt, self.lang)

    @property
    def col(self) -> Column:
        value = F.lit(self.value)
        return _viewed(make(F.lit(self.kind), value, F.lit(self.dt), F.lit(self.lang)), self.kind, value, self.dt, self.lang)


def IRI(value: str) -> Term:
    return Term("iri", value)


def Lit(value, dt: str | None = None, lang: str = "") -> Term:
    """A literal constant; Python numbers, booleans, decimals and datetimes get their XSD datatype."""
    if lang:
        return Term("lit", str(value), LANG_STRING, lang.lower())
    if dt is not None:
        return Term("lit", str(value), short_dt(dt))
    if isinstance(value, bool):
        return Term("lit", str(value).lower(), "xsd:boolean")
    if isinstance(value, int):
        return Term("lit", str(value), "xsd:integer")
    if isinstance(value, float):
        return Term("lit", repr(value), "xsd:double")
    if isinstance(value, Decimal):
        return Term("lit", format(value, "f"), "xsd:decimal")
    if isinstance(value, datetime):
        return Term("lit", value.isoformat(), "xsd:dateTime")
    return Term("lit", str(value), STRING)


class Namespace(str):
    """``CIM = Namespace("http://iec.ch/TC57/CIM100#"); CIM["Substation"]`` is an IRI constant."""

    def __getitem__(self, name):  # type: ignore[override]
        return IRI(str(self) + name)


def short_dt(dt: str) -> str:
    if dt.startswith(XSD):
        return "xsd:" + dt[len(XSD):]
    return LANG_STRING if dt == RDF + "langString" else dt


def make(kind: Column, value: Column, dt: Column, lang: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), dt.alias("dt"), lang.alias("lang"))


@dataclass(frozen=True)
class View:
    """The fields of a term, kept beside the Column that was built from them.

    A function applied to the result of another reads these instead of taking the struct apart again, and plain
    strings are fields known while the plan is built.  Spark does not share repeated parts of CASE branches, so
    this is what keeps nested expressions short.
    """

    kind: Column | str
    value: Column
    dt: Column | str
    lang: Column | str


@dataclass(frozen=True)
class Number:
    """The numeric views of a computed term: nested arithmetic skips its text form."""

    rank: Column
    exact: Column
    approx: Column


def _viewed(c: Column, kind, value, dt, lang, number: Number | None = None) -> Column:
    vars(c)["view"], vars(c)["number"] = View(kind, value, dt, lang), number
    return c


def view(x) -> View:
    c = term(x)
    return vars(c).get("view") or View(c["kind"], c["value"], c["dt"], c["lang"])


def number_views(x) -> Number | None:
    return vars(term(x)).get("number")


def col_of(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def among(x: Column | str, *names: str):
    """Whether a field is one of the names: a Python bool if that is known now."""
    return x in names if isinstance(x, str) else x.isin(*names)


def only_if(test, c: Column) -> Column:
    if test is True:
        return c
    return F.lit(None).cast("string") if test is False else F.when(test, c)


def when_bound(value: Column, t: Column) -> Column:
    """``t`` where ``value`` is known, otherwise unbound."""
    return F.when(value.isNotNull(), t)


def iri_term(value: Column, nullable: bool = True) -> Column:
    t = make(F.lit("iri"), value, F.lit(""), F.lit(""))
    return _viewed(when_bound(value, t) if nullable else t, "iri", value, "", "")


def bnode_term(label: Column, nullable: bool = False) -> Column:
    t = make(F.lit("bnode"), label, F.lit(""), F.lit(""))
    return _viewed(when_bound(label, t) if nullable else t, "bnode", label, "", "")


def literal_term(value: Column, dt: str | Column = STRING, lang: str | Column = "", nullable: bool = True,
                 number: Number | None = None) -> Column:
    dt = short_dt(dt) if isinstance(dt, str) else dt
    t = make(F.lit("lit"), value, col_of(dt), col_of(lang))
    return _viewed(when_bound(value, t) if nullable else t, "lit", value, dt, lang, number)


def term(x) -> Column:
    """A term column from ``"?var"``, a Column, a constant or a plain Python value (a literal)."""
    if isinstance(x, Column):
        return x
    if isinstance(x, Term):
        return x.col
    if isinstance(x, str) and x.startswith("?"):
        return F.col(x[1:])
    return Lit(x).col


def same_term(a: Column, b: Column, node: bool = False) -> Column:
    """Term identity, field by field, so that constant fields fold away and the rest are plain equi-join keys.

    ``node`` says that one side can only be an IRI or blank node: ``kind`` and ``value`` then decide alone.
    """
    cond = (a["value"] == b["value"]) & (a["kind"] == b["kind"])
    return cond if node else cond & (a["dt"] == b["dt"]) & (a["lang"] == b["lang"])


def same_columns(a: str, b: str, node: bool = False) -> Column:
    """:func:`same_term` of two named columns, as one SQL text: plans are built with fewer calls into the JVM."""
    fields = ("value", "kind") if node else ("value", "kind", "dt", "lang")
    return F.expr(" AND ".join(f"`{a}`.{f} = `{b}`.{f}" for f in fields))


# --- native Spark values <-> terms --------------------------------------------------------------------

def decimal_text(x: Column) -> Column:
    """Shortest plain notation of a decimal: no trailing zeros, no bare point."""
    return F.regexp_replace(x.cast("string"), r"\.0+$|(\.[0-9]*[1-9])0+$", "$1")


def double_text(x: Column) -> Column:
    return F.replace(x.cast("string"), F.lit("Infinity"), F.lit("INF"))


def native_term(c: Column, dtype: T.DataType) -> Column:
    """The literal a native Spark column stands for; term columns pass through."""
    if isinstance(dtype, T.StructType):
        return c
    if isinstance(dtype, T.BooleanType):
        return literal_term(c.cast("string"), "xsd:boolean")
    if isinstance(dtype, T.IntegralType):
        return literal_term(c.cast("string"), "xsd:integer")
    if isinstance(dtype, T.DecimalType):
        return literal_term(decimal_text(c), "xsd:decimal")
    if isinstance(dtype, T.FloatType):
        return literal_term(double_text(c), "xsd:float")
    if isinstance(dtype, T.DoubleType):
        return literal_term(double_text(c), "xsd:double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return literal_term(datetime_text(c), "xsd:dateTime")
    return literal_term(c.cast("string"))


def datetime_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def lex(x) -> Column:
    """Output form of a term: IRI bare, blank node ``_:x``, literal text only, quoted triple as stored."""
    v = view(x)
    if isinstance(v.kind, str):
        return F.concat(F.lit("_:"), v.value) if v.kind == "bnode" else v.value
    return F.when(v.kind == "bnode", F.concat(F.lit("_:"), v.value)).otherwise(v.value)


def native_lex(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return lex(c)
    if isinstance(dtype, T.DecimalType):
        return decimal_text(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return double_text(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return datetime_text(c)
    return c.cast("string")


def quoted_triple(s: Column, p: Column, o: Column) -> Column:
    """RDF-star triple as a term, ``<<s p o>>``."""
    text = F.concat(F.lit("<<"), lex(s), F.lit(" "), p, F.lit(" "), lex(o), F.lit(">>"))
    return when_bound(text, make(F.lit("triple"), text, F.lit(""), F.lit("")))


# --- typed views of a term ----------------------------------------------------------------------------
# These expressions mention each costly part once: Spark does not share repeated parts of CASE branches.

# Classes of datatypes that comparisons know.  10 and above are numeric, in promotion order.
NODE, TEXT, BOOLEAN, DATETIME, INTEGER_RANK, DECIMAL_RANK, FLOAT_RANK, DOUBLE_RANK = 0, 1, 3, 4, 10, 11, 12, 13
DT_CLASS = {
    "": NODE, STRING: TEXT, LANG_STRING: TEXT, "xsd:boolean": BOOLEAN, "xsd:dateTime": DATETIME,
    **dict.fromkeys(INTEGER_TYPES, INTEGER_RANK),
    "xsd:decimal": DECIMAL_RANK, "xsd:float": FLOAT_RANK, "xsd:double": DOUBLE_RANK,
}


def lookup(table: dict, key: Column) -> Column:
    """Value of a small constant table; NULL when the key is not in it."""
    cells = [repr(x) for kv in table.items() for x in kv]  # strings and numbers: Python's form is valid SQL
    return F.try_element_at(F.expr(f"map({', '.join(cells)})"), key)


def is_integer_type(dt: Column) -> Column:
    return F.array_contains(F.expr(f"array({', '.join(map(repr, INTEGER_TYPES))})"), dt)


def _class_in(table: dict[str, int], x) -> Column:
    views, v = number_views(x), view(x)
    if views:
        return views.rank
    if isinstance(v.dt, str):
        known = F.lit(table.get(v.dt)).cast("int")
        return known if isinstance(x, Term) else F.when(v.value.isNotNull(), known)
    return lookup(table, v.dt)


def dt_class(x) -> Column:
    """Class of a term's datatype; NULL for unbound terms and unknown datatypes."""
    return _class_in(DT_CLASS, x)


def numeric_rank(x) -> Column:
    """10 integer, 11 decimal, 12 float, 13 double; NULL when the datatype is not numeric."""
    return _class_in({dt: c for dt, c in DT_CLASS.items() if c >= INTEGER_RANK}, x)


def is_nan(x) -> Column:
    views = number_views(x)
    return F.isnan(views.approx) if views else view(x).value == "NaN"


# The datatype a numeric rank stands for.
RANK_DT = {INTEGER_RANK: "xsd:integer", DECIMAL_RANK: "xsd:decimal", FLOAT_RANK: "xsd:float", DOUBLE_RANK: "xsd:double"}


def rank_dt(rank: Column) -> Column:
    """Datatype of a :func:`numeric_rank`."""
    return lookup(RANK_DT, rank)


def parse_decimal(v: Column) -> Column:
    return F.when(v.rlike(RX_DECIMAL), v.try_cast(DECIMAL))


def parse_double(v: Column) -> Column:
    """Spark reads INF, -INF and NaN itself; the pattern keeps out its other spellings."""
    return F.when(v.rlike(RX_DOUBLE), v.try_cast("double"))


# Which lexical form belongs to which numeric datatypes.
EXACT_FORMS = (("xsd:decimal",), RX_DECIMAL), (INTEGER_TYPES, RX_INTEGER)
NUMERIC_FORMS = (("xsd:double", "xsd:float"), RX_DOUBLE), *EXACT_FORMS


def _number(x, forms, sql_type: str) -> Column:
    v = view(x)
    if isinstance(v.dt, str):
        form = next((form for types, form in forms if v.dt in types), None)
        valid = F.lit(False) if form is None else v.value.rlike(form)
    else:
        (first, form), *rest = forms
        valid = F.when(v.dt.isin(*first), v.value.rlike(form))
        for types, form in rest:
            valid = valid.when(is_integer_type(v.dt) if types is INTEGER_TYPES else v.dt.isin(*types), v.value.rlike(form))
    return F.when(valid, v.value.try_cast(sql_type))


def num(x) -> Column:
    """Numeric value as double, NULL unless the datatype is numeric and the text is valid for it."""
    views = number_views(x)
    return views.approx if views else _number(x, NUMERIC_FORMS, "double")


def exact_num(x) -> Column:
    """Integer and decimal terms as decimal(38,18), everything else NULL."""
    views = number_views(x)
    return views.exact if views else _number(x, EXACT_FORMS, DECIMAL)


def instant(x) -> Column:
    """``xsd:dateTime`` term as a timestamp; values without an offset count as UTC."""
    v = view(x)
    return parse_instant(only_if(among(v.dt, "xsd:dateTime"), v.value))


def parse_instant(v: Column) -> Column:
    # an offset and the line end that a pattern may leave out are in the last eight characters
    zoned = F.concat(v, F.when(F.substring(v, -8, 8).rlike(RX_OFFSET), "").otherwise(F.lit("Z")))
    return F.when(v.rlike(RX_DATETIME), zoned.try_cast("timestamp"))


def sort_keys(c: Column, dtype: T.DataType) -> list[Column]:
    """ORDER BY keys: unbound < blank node < IRI < literal; numbers by value, dateTimes by instant."""
    if not isinstance(dtype, T.StructType):
        return [c]
    rank = (F.when(c["kind"] == "bnode", 1).when(c["kind"] == "iri", 2)
            .when(c["kind"] == "lit", 3).when(c["kind"] == "triple", 4))
    return [rank, num(c), exact_num(c), instant(c), c["value"], c["dt"], c["lang"]]
