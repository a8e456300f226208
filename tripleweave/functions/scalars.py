"""SPARQL scalar expressions as Catalyst columns.

Arguments are ``"?var"`` names, term columns, constants (:class:`Term`) or plain Python values, which are
literals.  A SPARQL error is SQL NULL.  Functions whose SPARQL result is a string or a dynamically typed number return a
term; tests, lengths, dates parts and casts return native Spark columns, so that they stay cheap in
filters and aggregates.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import (
    BOOLEAN, DATETIME, DECIMAL, DECIMAL_RANK, DOUBLE_RANK, FLOAT_RANK, INTEGER_RANK, LANG_STRING, RANK_DT, RDF, RX_INTEGER,
    RX_LOCAL, RX_OFFSET, RX_DATETIME, STRING, TEXT, XSD, Number, Term, among, bnode_term, col_of, decimal_text, double_text,
    dt_class, exact_num, instant, iri_term, is_nan, literal_term, lookup, num, number_views, numeric_rank, only_if,
    parse_decimal, parse_double, parse_instant, rank_dt, same_term, short_dt, term, view,
)


# --- logic and comparison -----------------------------------------------------------------------------

def ebv(x) -> Column:
    """Effective boolean value; ill-formed numbers and booleans are false."""
    v, kind = view(x).value, dt_class(x)
    return (F.when(kind == BOOLEAN, v.isin("true", "1"))
            .when(kind == TEXT, v != "")
            .when(kind >= INTEGER_RANK, (v != "NaN") & (F.coalesce(num(x), F.lit(0.0)) != 0)))


def or_(*xs: Column) -> Column:
    return reduce(lambda a, b: a | b, xs)


def and_(*xs: Column) -> Column:
    return reduce(lambda a, b: a & b, xs)


def not_(x: Column) -> Column:
    return ~x


def _number_const(x):
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def _number_test(x, k, op) -> Column:
    """Comparison of a term with a Python number: exact for an int or Decimal and an exact term; NaN compares false."""
    floating = F.when(is_nan(x), F.lit(False)).otherwise(op(num(x), F.lit(float(k))))
    if isinstance(k, float):
        return floating
    return F.when(numeric_rank(x) <= DECIMAL_RANK, op(exact_num(x), F.lit(Decimal(k)))).otherwise(floating)


def _numbers(a, b, ca: Column, cb: Column, op) -> Column:
    return (F.when((ca <= DECIMAL_RANK) & (cb <= DECIMAL_RANK), op(exact_num(a), exact_num(b)))
            .when(is_nan(a) | is_nan(b), F.lit(False)).otherwise(op(num(a), num(b))))


def _compare(a, b, op) -> Column:
    """Ordered comparison by datatype; mixed or unordered kinds are an error."""
    a = term(a)
    if _number_const(b):
        return F.when(numeric_rank(a).isNotNull(), _number_test(a, b, op))
    b = term(b)
    ca, cb = dt_class(a), dt_class(b)
    numbers = F.when((ca >= INTEGER_RANK) & (cb >= INTEGER_RANK), _numbers(a, b, ca, cb, op))
    if number_views(a) or number_views(b):  # a computed number compares with numbers only
        return numbers
    va, vb = view(a), view(b)
    return (numbers
            .when((ca == TEXT) & (cb == TEXT), F.when(col_of(va.lang) == col_of(vb.lang), op(va.value, vb.value)))
            .when((ca == DATETIME) & (cb == DATETIME), op(instant(a), instant(b)))
            .when((ca == BOOLEAN) & (cb == BOOLEAN), op(boolean_value(a), boolean_value(b))))


def lt(a, b) -> Column:
    return _compare(a, b, lambda x, y: x < y)


def le(a, b) -> Column:
    return _compare(a, b, lambda x, y: x <= y)


def gt(a, b) -> Column:
    return _compare(a, b, lambda x, y: x > y)


def ge(a, b) -> Column:
    return _compare(a, b, lambda x, y: x >= y)


def boolean_value(x) -> Column:
    v = view(x)
    text = only_if(among(v.dt, "xsd:boolean"), v.value)
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def eq(a, b) -> Column:
    """Value equality (``=``): numbers by value, dateTimes by instant, strings and nodes by identity.

    Two different literals are an error when the datatype of one is unknown.
    """
    same = lambda x, y: x == y
    a = term(a)
    ca = dt_class(a)
    if _number_const(b):
        return F.when(ca >= INTEGER_RANK, _number_test(a, b, same)).when(ca.isNotNull(), F.lit(False))
    known_text = isinstance(b, Term) and b.dt in (STRING, "") or isinstance(b, str) and not b.startswith("?")
    b = term(b)
    cb = dt_class(b)
    if known_text:  # a node or plain string constant
        return F.when(sameterm(a, b), F.lit(True)).when(ca.isNotNull(), F.lit(False))
    numbers = F.when((ca >= INTEGER_RANK) & (cb >= INTEGER_RANK), _numbers(a, b, ca, cb, same))
    if number_views(a) or number_views(b):
        return numbers.when(ca.isNotNull() & cb.isNotNull(), F.lit(False))
    return (numbers
            .when((ca == DATETIME) & (cb == DATETIME), instant(a) == instant(b))
            .when((ca == BOOLEAN) & (cb == BOOLEAN), boolean_value(a) == boolean_value(b))
            .when(sameterm(a, b), F.lit(True))
            .when(ca.isNotNull() & cb.isNotNull(), F.lit(False)))


def ne(a, b) -> Column:
    return ~eq(a, b)


def in_(x, *options) -> Column:
    return or_(*[eq(x, o) for o in options]) if options else F.lit(False)


def not_in(x, *options) -> Column:
    return ~in_(x, *options)


def bound(x) -> Column:
    return term(x).isNotNull()


def if_(cond: Column, a, b) -> Column:
    return F.when(cond, term(a)).when(~cond, term(b))


def coalesce(*xs) -> Column:
    return F.coalesce(*[term(x) for x in xs])


def sameterm(a, b) -> Column:
    va, vb = view(a), view(b)
    pairs = [(va.kind, vb.kind), (va.dt, vb.dt), (va.lang, vb.lang)]
    tests = [col_of(x) == col_of(y) for x, y in pairs if not (isinstance(x, str) and isinstance(y, str) and x == y)]
    return and_(va.value == vb.value, *tests)


# --- arithmetic ---------------------------------------------------------------------------------------

def _arith(a, b, exact, approx, least_rank: int = INTEGER_RANK) -> Column:
    """Promote integer -> decimal -> float -> double by datatype and build the resulting literal."""
    a, b = term(a), term(b)
    ranks = {100 * x + y: max(x, y, least_rank) for x in RANK_DT for y in RANK_DT}
    pair = 100 * numeric_rank(a) + numeric_rank(b)  # NULL unless both are numbers
    of_rank = lambda *wanted: pair.isin([p for p, r in ranks.items() if r in wanted])
    is_exact, is_float = of_rank(INTEGER_RANK, DECIMAL_RANK), of_rank(FLOAT_RANK)
    whole, real = exact(exact_num(a), exact_num(b)), approx(num(a), num(b))
    rank = lookup(ranks, pair)
    value = (F.when(is_exact, decimal_text(whole)).when(is_float, double_text(real.cast("float")))
             .otherwise(double_text(real)))
    return literal_term(value, rank_dt(rank), number=Number(rank, F.when(is_exact, whole), real))


def add(a, b) -> Column:
    return _arith(a, b, lambda x, y: F.try_add(x, y).try_cast(DECIMAL), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _arith(a, b, lambda x, y: F.try_subtract(x, y).try_cast(DECIMAL), lambda x, y: x - y)


# Operand types whose exact product has 38 digits at most, 18 of them fractional: (precision, scale) of both sides.
PRODUCTS = (((19, 9), (18, 9)), ((19, 0), (18, 0)), ((18, 0), (19, 0)), ((18, 18), (19, 0)), ((19, 0), (18, 18)),
            ((28, 18), (9, 0)), ((9, 0), (28, 18)), ((28, 9), (9, 9)), ((9, 9), (28, 9)))
# The same for quotients: Spark gives these at least 18 fractional digits.
QUOTIENTS = (((38, 18), (19, 0)), ((19, 9), (18, 9)), ((19, 18), (19, 18)))


def _exactly(x: Column, y: Column, shapes, op) -> Column:
    """``op`` in the first pair of types that holds both operands without loss; NULL if none does."""
    def fit(v: Column, precision: int, scale: int) -> Column:
        narrow = v.try_cast(f"decimal({precision},{scale})")
        return F.when(narrow.cast(DECIMAL) == v, narrow)

    return F.coalesce(*[op(fit(x, *left), fit(y, *right)).try_cast(DECIMAL) for left, right in shapes])


def multiply(a, b) -> Column:
    return _arith(a, b, lambda x, y: _exactly(x, y, PRODUCTS, F.try_multiply), lambda x, y: x * y)


def divide(a, b) -> Column:
    """Integer / integer is a decimal of 18 fractional digits; an exact division by zero is an error, a floating one gives INF or NaN."""
    return _arith(a, b, lambda x, y: _exactly(x, y, QUOTIENTS, F.try_divide),
                  lambda x, y: F.when(y == 0, x * float("inf")).otherwise(F.try_divide(x, y)),
                  least_rank=DECIMAL_RANK)


def negate(a) -> Column:
    return _keep_type(a, lambda v: -v, lambda v: -v)


def _keep_type(x, exact, approx) -> Column:
    t = term(x)
    rank = numeric_rank(t)
    whole, real = exact(exact_num(t)).cast(DECIMAL), approx(num(t))
    value = (F.when(rank <= DECIMAL_RANK, decimal_text(whole)).when(rank == FLOAT_RANK, double_text(real.cast("float")))
             .when(rank == DOUBLE_RANK, double_text(real)))
    return literal_term(value, rank_dt(rank), number=Number(rank, whole, real))


def abs_(x) -> Column:
    return _keep_type(x, F.abs, F.abs)


def _finite(fn):
    """Floor and friends go through bigint in Spark: leave NaN, INF and values beyond 2**53 as they are."""
    return lambda v: F.when(F.abs(v) < 2.0**53, fn(v).cast("double")).otherwise(v)


def ceil(x) -> Column:
    return _keep_type(x, F.ceil, _finite(F.ceil))


def floor(x) -> Column:
    return _keep_type(x, F.floor, _finite(F.floor))


def round_(x) -> Column:
    """Halves go towards positive infinity."""
    return _keep_type(x, lambda v: F.floor(v + F.lit(0.5).cast("decimal(2,1)")), _finite(lambda v: F.floor(v + 0.5)))


def rand() -> Column:
    return F.rand()


# --- terms --------------------------------------------------------------------------------------------

def _of_kind(x, kind: str) -> Column:
    return term(x)["kind"] == kind


def is_iri(x) -> Column:
    return _of_kind(x, "iri")


def is_blank(x) -> Column:
    return _of_kind(x, "bnode")


def is_literal(x) -> Column:
    return _of_kind(x, "lit")


def is_numeric(x) -> Column:
    return F.when(term(x).isNotNull(), num(x).isNotNull())


def text(x) -> Column:
    """Native string behind STR(): NULL for blank nodes and quoted triples."""
    v = view(x)
    return only_if(among(v.kind, "iri", "lit"), v.value)


def str_(x) -> Column:
    return literal_term(text(x))


def _literal_field(x, field: Column | str) -> Column:
    v = view(x)
    return F.when(v.value.isNotNull() & (col_of(v.kind) == "lit"), col_of(field))


def lang(x) -> Column:
    return literal_term(_literal_field(x, view(x).lang))


def datatype(x) -> Column:
    dt = col_of(view(x).dt)
    full = (F.when(dt.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(dt, 5, 1 << 20)))
            .when(dt == LANG_STRING, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(dt))
    return iri_term(_literal_field(x, full))


def iri(x, base: str = "") -> Column:
    """IRI from a string; with ``base``, references without a scheme are appended to it."""
    v = text(x)
    if not base:
        return iri_term(v)
    return iri_term(F.concat(F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "").otherwise(base), v))


def bnode(label=None, row_key: Column | None = None) -> Column:
    """Blank node: fresh per row, or the same one for equal labels of one solution (``row_key``)."""
    if label is None:
        return bnode_term(F.replace(F.uuid(), F.lit("-")))
    key = F.concat(row_key if row_key is not None else F.lit(""), F.lit("\u0001"), text(label))
    return bnode_term(F.sha1(key), nullable=True)


def strdt(x, dt) -> Column:
    """Literal with a datatype, an IRI that may be a constant or an expression; anything else is an error, and so is a datatype
    whose literals have a language."""
    if isinstance(dt, Term) or _constant_text(dt):
        return literal_term(_simple(x), short_dt(dt.value if isinstance(dt, Term) else dt))
    name = only_if(among(view(dt).kind, "iri"), view(dt).value)
    short = F.when(F.startswith(name, F.lit(XSD)), F.concat(F.lit("xsd:"), F.substring(name, len(XSD) + 1, 1 << 20))).otherwise(name)
    good = name.isNotNull() & (name != RDF + "langString")
    return literal_term(F.when(good, _simple(x)), F.coalesce(short, F.lit("")))


def strlang(x, tag) -> Column:
    """Literal with a language tag, a string that may be a constant or an expression; an empty tag is an error."""
    if _constant_text(tag):
        return literal_term(_simple(x) if tag else F.lit(None).cast("string"), LANG_STRING, tag.lower())
    low = F.lower(_simple(tag))
    return literal_term(F.when(low != "", _simple(x)), LANG_STRING, F.coalesce(low, F.lit("")))


def _simple(x) -> Column:
    v = view(x)
    return only_if(among(v.dt, STRING), v.value)


def uuid() -> Column:
    return iri_term(F.concat(F.lit("urn:uuid:"), F.uuid()), nullable=False)


def struuid() -> Column:
    return literal_term(F.uuid(), nullable=False)


# --- strings ------------------------------------------------------------------------------------------

def _string(x) -> tuple[Column, Column | str, Column | str]:
    """Text, datatype and language of a string argument; the text is NULL for anything that is no string literal."""
    v = view(x)
    return only_if(among(v.dt, STRING, LANG_STRING), v.value), v.dt, v.lang


def strlen(x) -> Column:
    return F.length(_string(x)[0])


def _map_text(x, fn) -> Column:
    """A string function whose result keeps the language tag."""
    v, dt, tag = _string(x)
    return literal_term(fn(v), dt, tag)


def substr(x, start, length=None) -> Column:
    """1-based; a start below 1 shortens the piece as XPath ``substring`` does.  Both numbers may be terms or variables."""
    if not isinstance(start, int) or not isinstance(length, (int, type(None))):
        place = lambda n: F.lit(n) if isinstance(n, int) else xsd_integer(n).try_cast("int")
        begin = place(start)
        first = F.greatest(begin, F.lit(1)) + F.lit(0) * begin
        if length is None:
            return _map_text(x, lambda v: F.substring(v, first, F.length(v)))
        return _map_text(x, lambda v: F.substring(v, first, F.greatest(begin + place(length) - first, F.lit(0))))
    first = max(start, 1)
    size = (1 << 31) - 1 if length is None else max(start + length - first, 0)
    return _map_text(x, lambda v: F.substring(v, first, size))


def ucase(x) -> Column:
    return _map_text(x, F.upper)


def lcase(x) -> Column:
    return _map_text(x, F.lower)


def _compatible(a, b):
    """Argument compatibility: the second has no language tag, or that of the first."""
    if isinstance(b[2], str) and b[2] == "":
        return True
    return (col_of(b[2]) == "") | (col_of(a[2]) == col_of(b[2]))


def _test(a, b, fn) -> Column:
    sa, sb = _string(a), _string(b)
    test, ok = fn(sa[0], sb[0]), _compatible(sa, sb)
    return test if ok is True else F.when(ok, test)


def strstarts(a, b) -> Column:
    return _test(a, b, F.startswith)


def strends(a, b) -> Column:
    return _test(a, b, F.endswith)


def contains(a, b) -> Column:
    return _test(a, b, F.contains)


def _split_at(a, b, piece) -> Column:
    """Part of ``a`` beside the first ``b``, with the tag of ``a``; the plain empty string without a match."""
    sa, sb = _string(a), _string(b)
    s, x = sa[0], sb[0]
    found = F.position(x, s) > 0
    value = only_if(_compatible(sa, sb), F.when(found, piece(s, x)).when(~found, ""))
    if isinstance(sa[1], str) and sa[1] == STRING:
        return literal_term(value)
    return literal_term(value, F.when(found, col_of(sa[1])).otherwise(F.lit(STRING)),
                        F.when(found, col_of(sa[2])).otherwise(F.lit("")))


def strbefore(a, b) -> Column:
    return _split_at(a, b, lambda s, x: F.substring(s, F.lit(1), F.position(x, s) - 1))


def strafter(a, b) -> Column:
    return _split_at(a, b, lambda s, x: F.substring(s, F.position(x, s) + F.length(x), F.length(s)))


def encode_for_uri(x) -> Column:
    e = F.url_encode(_string(x)[0])
    for encoded, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        e = F.replace(e, F.lit(encoded), F.lit(wanted))
    return literal_term(e)


def concat(*xs) -> Column:
    """Keeps the language tag only when all arguments share it; no arguments give the empty string."""
    if not xs:
        return literal_term(F.lit(""))
    parts = [_string(x) for x in xs]
    value, tags = F.concat(*[p[0] for p in parts]), [p[2] for p in parts]
    if any(isinstance(t, str) and t == "" for t in tags):
        return literal_term(value)
    tag = F.when(and_(*[col_of(t) == col_of(tags[0]) for t in tags]), col_of(tags[0])).otherwise(F.lit(""))
    return literal_term(value, F.when(tag != "", LANG_STRING).otherwise(F.lit(STRING)), tag)


INTEGER = "decimal(38,0)"


def _constant_text(x) -> bool:
    """A Python string that names no variable."""
    return isinstance(x, str) and not x.startswith("?")


def _argument(x) -> Column:
    """A string argument that may be a constant, a variable or a term."""
    return F.lit(x) if _constant_text(x) else _string(x)[0]


def langmatches(tag, rng) -> Column:
    """``rng`` is a Python string, or a term or column for a range by row."""
    v = F.lower(_string(tag)[0])
    if not _constant_text(rng):
        low = F.lower(_string(rng)[0])
        return F.when(low == "*", v != "").otherwise((v == low) | F.startswith(v, F.concat(low, F.lit("-"))))
    if rng == "*":
        return v != ""
    low = rng.lower()
    return (v == low) | F.startswith(v, F.lit(low + "-"))


def _flagged(pattern: Column, flags: str) -> Column:
    if "q" in flags:  # literal text: an end of quoting inside it is quoted by itself
        pattern = F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    inline = "".join(f for f in flags if f in "ismx")
    return F.concat(F.lit(f"(?{inline})"), pattern) if inline else pattern


def _pattern(pattern, flags: str) -> Column:
    """A pattern with its flags; null where it is malformed, since the engine's own matching would end the job.

    A constant is tried once while the plan is built, patterns from data are tried row by row."""
    found = _flagged(_argument(pattern), flags)
    if not _constant_text(pattern):
        # the name of a function that compiles it; null if that raises
        return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), found).isNotNull(), found)
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern if "q" not in flags else "")
    except (IllegalArgumentException, Py4JJavaError):
        return F.lit(None).cast("string")
    return found


def regex(x, pattern, flags: str = "") -> Column:
    """Whether a string matches; a malformed pattern is an error."""
    return F.rlike(_string(x)[0], _pattern(pattern, flags))


def replace(x, pattern, by, flags: str = "") -> Column:
    """A pattern that is malformed or matches the empty string is an error; with flag ``q`` the replacement is literal text too."""
    found, new = _pattern(pattern, flags), _argument(by)
    if "q" in flags:
        new = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return _map_text(x, lambda v: F.when(~F.rlike(F.lit(""), found), F.regexp_replace(v, found, new)))


# --- dates and times ----------------------------------------------------------------------------------

def now() -> Column:
    return F.current_timestamp()


def _datetime_text(x) -> Column:
    v = view(x)
    return only_if(among(v.dt, "xsd:dateTime"), v.value)


def _local(x) -> Column:
    """Wall-clock time as written, whatever the offset or the session time zone."""
    return F.regexp_extract(_datetime_text(x), RX_LOCAL, 1).try_cast("timestamp_ntz")


def year(x) -> Column:
    return F.year(_local(x))


def month(x) -> Column:
    return F.month(_local(x))


def day(x) -> Column:
    return F.dayofmonth(_local(x))


def hours(x) -> Column:
    return F.hour(_local(x))


def minutes(x) -> Column:
    return F.minute(_local(x))


def seconds(x) -> Column:
    return F.extract(F.lit("SECOND"), _local(x))


def _offset(x) -> Column:
    v = _datetime_text(x)
    return F.when(v.rlike(RX_DATETIME), F.regexp_extract(v, RX_OFFSET, 1))


def tz(x) -> Column:
    return literal_term(_offset(x))


def timezone(x) -> Column:
    """Offset as ``xsd:dayTimeDuration``; no offset is an error."""
    # '+05:30' -> '+PT05H30M' -> 'PT5H30M'; '-00:30' -> '-PT30M'; 'Z' and '+00:00' -> 'PT0S'
    span = F.replace(_offset(x), F.lit("Z"), F.lit("+00:00"))
    for pattern, by in ((r"^([+-])(\d\d):(\d\d)$", "$1PT$2H$3M"), ("00[HM]", ""), ("(PT|H)0", "$1"), (r"^\+", ""), ("^-?PT$", "PT0S")):
        span = F.regexp_replace(span, pattern, by)
    return literal_term(F.nullif(span, F.lit("")), "xsd:dayTimeDuration")


# --- hashes -------------------------------------------------------------------------------------------

def md5(x) -> Column:
    return literal_term(F.md5(_simple(x)))


def sha1(x) -> Column:
    return literal_term(F.sha1(_simple(x)))


def sha256(x) -> Column:
    return literal_term(F.sha2(_simple(x), 256))


def sha384(x) -> Column:
    return literal_term(F.sha2(_simple(x), 384))


def sha512(x) -> Column:
    return literal_term(F.sha2(_simple(x), 512))


# --- casts: native results ----------------------------------------------------------------------------

def _from_literal(x) -> Column:
    v = view(x)
    return only_if(among(v.kind, "lit"), v.value)


def _real(x) -> Column:
    """Value of a float or double, NULL for other types."""
    v = view(x)
    return parse_double(only_if(among(v.dt, "xsd:double", "xsd:float"), v.value))


def xsd_decimal(x) -> Column:
    """Numbers and plain strings in decimal notation; booleans become 1 and 0."""
    plain = parse_decimal(_from_literal(x))
    known = view(x).dt
    if isinstance(known, str) and known in (STRING, "xsd:decimal", "xsd:integer"):
        return plain
    return F.coalesce(plain, _real(x).try_cast(DECIMAL), boolean_value(x).cast("int").cast(DECIMAL))


def xsd_integer(x) -> Column:
    """Numbers are truncated; strings must be integers.  38 digits; beyond that the result is unbound."""
    toward_zero = lambda d: F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).try_cast(INTEGER)
    # a double beyond 2**63 has no fraction
    of_real = lambda r: F.coalesce(r.try_cast("bigint").cast(INTEGER), F.when(F.abs(r) >= 2.0**63, r.try_cast(INTEGER)))
    views = number_views(x)
    if views:
        return F.coalesce(toward_zero(views.exact), of_real(views.approx))
    v, literal = view(x), _from_literal(x)
    decimal = toward_zero(parse_decimal(only_if(among(v.dt, "xsd:decimal"), v.value)))
    plain = F.when(literal.rlike(RX_INTEGER), literal.try_cast(INTEGER))
    return F.coalesce(plain, decimal, of_real(_real(x)), boolean_value(x).cast("int").cast(INTEGER))


def xsd_double(x) -> Column:
    return F.coalesce(parse_double(_from_literal(x)), boolean_value(x).cast("double"))


def xsd_float(x) -> Column:
    return xsd_double(x).cast("float")


def xsd_boolean(x) -> Column:
    v, n = _from_literal(x), num(x)
    return (F.when(n.isNotNull(), (n != 0) & ~F.isnan(n))
            .when(v.isin("true", "1"), True).when(v.isin("false", "0"), False))


def xsd_datetime(x) -> Column:
    return parse_instant(_from_literal(x))


def xsd_string(x) -> Column:
    return str_(x)
