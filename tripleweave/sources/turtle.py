"""Turtle and TriG reader for one document, used inside ingest tasks; terms as in :mod:`.rdfxml`."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

from .rdfxml import NIL, RDF_NS, TYPE, RdfError, blank_node, iri_node, resolve, short_datatype

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The token forms of the two languages.
TOKEN = re.compile(r'''
    (?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
  | (?P<string>"""(?:"{0,2}(?:[^"\\]|\\.))*"""|\'\'\'(?:'{0,2}(?:[^'\\]|\\.))*\'\'\'|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<bnode>_:\w(?:[\w.\-]*[\w\-])?)
  | (?P<double>[+-]?(?:[0-9]+\.[0-9]*|\.?[0-9]+)[eE][+-]?[0-9]+)
  | (?P<decimal>[+-]?[0-9]*\.[0-9]+)
  | (?P<integer>[+-]?[0-9]+)
  | (?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?#@%-]))?)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|<<|>>|[.;,()\[\]{}])
''', re.X | re.S)
SPACE = re.compile(r"(?:[ \t\r\n]+|#[^\n\r]*)*")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
ESCAPED = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m):
        code = m[1] or m[2]
        if code:
            return chr(int(code, 16))
        if m[3] not in ESCAPED:
            raise RdfError(f"unknown escape \\{m[3]}")
        return ESCAPED[m[3]]
    return ESCAPE.sub(one, text) if "\\" in text else text


def shown(t) -> str:
    return "_:" + t[1] if t[0] == "bnode" else t[1]


class Reader:
    """One document: a token cursor and a recursive descent over statements."""

    def __init__(self, text: str, base: str, scope: str, emit, graphs: bool):
        self.text, self.base, self.scope, self.emit, self.graphs = text, base, scope, emit, graphs
        self.prefixes: dict[str, str] = {}
        self.at, self.fresh_count, self.g = 0, 0, ""
        self.advance()

    def advance(self):
        self.at = SPACE.match(self.text, self.at).end()
        if self.at >= len(self.text):
            self.kind, self.token = "end", ""
            return
        m = TOKEN.match(self.text, self.at)
        if m is None:
            raise RdfError(f"unexpected text at offset {self.at}: {self.text[self.at:self.at + 20]!r}")
        self.kind, self.token, self.at = m.lastgroup, m[0], m.end()

    def take(self, token: str) -> bool:
        if self.token == token and self.kind == "mark":
            self.advance()
            return True
        return False

    def need(self, token: str):
        if not self.take(token):
            raise RdfError(f"expected {token!r}, found {self.token!r}")

    def fresh(self):
        self.fresh_count += 1
        return blank_node(f"{self.scope}g{self.fresh_count}")

    def statements(self):
        """Read everything; pauses after each statement."""
        while self.kind != "end":
            word = self.token.lower()
            if self.kind == "at" and word in ("@prefix", "@base") or self.kind == "word" and word in ("prefix", "base"):
                self.directive(word)
            elif self.graphs and self.kind == "word" and word == "graph":
                self.advance()
                self.block(shown(self.node()))
            elif self.graphs and self.token == "{":
                self.block("")
            else:
                opened = self.token == "["
                subject = self.node()
                if self.graphs and self.token == "{":
                    self.block(shown(subject))
                else:
                    if not (opened and self.token == "."):
                        self.predicates(subject)
                    self.need(".")
            yield

    def directive(self, word: str):
        dotted = word.startswith("@")
        self.advance()
        if word.endswith("prefix"):
            if self.kind != "name" or not self.token.endswith(":"):
                raise RdfError(f"expected a prefix, found {self.token!r}")
            prefix = self.token[:-1]
            self.advance()
            self.prefixes[prefix] = self.iri()[1]
        else:
            self.base = self.iri()[1]
        if dotted:
            self.need(".")

    def block(self, g: str):
        self.need("{")
        self.g = g
        while not self.take("}"):
            opened = self.token == "["
            subject = self.node()
            if not (opened and self.token in (".", "}")):
                self.predicates(subject)
            if self.token != "}":
                self.need(".")
        self.g = ""

    def predicates(self, subject):
        while True:
            if self.kind == "word" and self.token == "a":
                self.advance()
                p = TYPE
            else:
                p = self.iri()[1]
            while True:
                self.emit((subject, p, self.object(), self.g))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.token in (".", "]", "}") and self.kind == "mark":
                return

    def iri(self):
        kind, token = self.kind, self.token
        if kind == "iri":
            self.advance()
            return iri_node(resolve(self.base, _unescape(token[1:-1])))
        if kind == "name":
            prefix, _, local = token.partition(":")
            if prefix not in self.prefixes:
                raise RdfError(f"unknown prefix {prefix!r}")
            self.advance()
            return iri_node(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        raise RdfError(f"expected an IRI, found {token!r}")

    def node(self):
        if self.kind == "bnode":
            label = self.token[2:]
            self.advance()
            return blank_node(f"{self.scope}n{label}")
        if self.take("["):
            node = self.fresh()
            if not self.take("]"):
                self.predicates(node)
                self.need("]")
            return node
        if self.take("("):
            return self.collection()
        if self.take("<<"):
            s, p, o = self.node(), self.iri(), self.object()
            self.need(">>")
            return ("triple", f"<<{shown(s)} {shown(p)} {shown(o)}>>", "", "")
        return self.iri()

    def collection(self):
        items = []
        while not self.take(")"):
            items.append(self.object())
        cells = [self.fresh() for _ in items] + [NIL]
        for i, item in enumerate(items):
            self.emit((cells[i], RDF_NS + "first", item, self.g))
            self.emit((cells[i], RDF_NS + "rest", cells[i + 1], self.g))
        return cells[0]

    def object(self):
        kind, token = self.kind, self.token
        if kind == "string":
            width = 3 if token[:3] in ('"""', "\'\'\'") else 1
            text = _unescape(token[width:-width])
            self.advance()
            if self.kind == "at":
                tag = self.token[1:].lower()
                self.advance()
                return ("lit", text, "rdf:langString", tag)
            if self.take("^^"):
                return ("lit", text, short_datatype(self.iri()[1]), "")
            return ("lit", text, "xsd:string", "")
        if kind in ("integer", "decimal", "double"):
            self.advance()
            return ("lit", token, "xsd:" + kind, "")
        if kind == "word" and token in ("true", "false"):
            self.advance()
            return ("lit", token, "xsd:boolean", "")
        return self.node()


def parse(data: bytes, base: str, scope: str, emit, graphs: bool = False):
    """Parse one document; ``emit`` gets tuples as in :mod:`.rdfxml`.  Pauses after each statement."""
    yield from Reader(data.decode("utf-8"), base, scope, emit, graphs).statements()
