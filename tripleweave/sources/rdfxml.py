"""RDF/XML reader for one document, used inside ingest tasks.

The XML parser calls back on start, text and end; a stack of frames follows the striped syntax (node element,
property element, node element, ...).  Triples go to an ``emit`` callback as plain tuples ``(subject, predicate,
object, graph)`` whose terms are ``(kind, value, datatype, language)``.
"""

from __future__ import annotations

import re
import sys
from urllib.parse import urljoin
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the RDF/XML syntax.
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML_NS = "http://www.w3.org/XML/1998/namespace"
XSD_NS = "http://www.w3.org/2001/XMLSchema#"
ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
CHUNK = 1 << 20


class RdfError(ValueError):
    """A document that is no valid RDF."""


def resolve(base: str, ref: str) -> str:
    """IRI reference against a base; fragment-only references work for any scheme."""
    if ref[:1] == "#" or not ref:
        return base.split("#", 1)[0] + ref
    return ref if ABSOLUTE.match(ref) else urljoin(base, ref)


def short_datatype(dt: str) -> str:
    return "xsd:" + dt[len(XSD_NS):] if dt.startswith(XSD_NS) else dt


def iri_node(value: str):
    return ("iri", value, "", "")


def blank_node(label: str):
    return ("bnode", label, "", "")


TYPE, NIL, STATEMENT = RDF_NS + "type", iri_node(RDF_NS + "nil"), iri_node(RDF_NS + "Statement")


class Frame:
    """One open element.  ``role`` is doc, node, prop, list (parseType Collection), or xml (parseType Literal)."""

    __slots__ = ("role", "subject", "predicate", "object", "base", "lang", "datatype", "text", "count", "items", "reify")

    def __init__(self, role, base, lang, subject=None, predicate=None, datatype="", reify=None):
        self.role, self.base, self.lang, self.subject, self.predicate = role, base, lang, subject, predicate
        self.datatype, self.reify, self.object, self.text, self.count, self.items = datatype, reify, None, [], 0, []


def parse(data: bytes, base: str, scope: str, emit, part: str = ""):
    """Parse one document.  ``scope`` makes blank node labels unique, ``part`` those that a piece of a document makes up.

    A generator: it pauses after every chunk of input, so that the caller can pass on what was emitted so far.
    """
    stack = [Frame("doc", base, "")]
    state = {"fresh": 0, "depth": 0}
    ids: set[str] = set()
    names: dict[str, str] = {}
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def iri(name: str) -> str:
        if name not in names:
            ns, _, local = name.rpartition(" ")
            if not ns:
                raise RdfError(f"name without a namespace: {name}")
            names[name] = ns + local
        return names[name]

    def fresh():
        state["fresh"] += 1
        return blank_node(f"{scope}g{part}{state['fresh']}")

    def own_id(base: str, name: str):
        at = resolve(base, "#" + name)
        if at in ids:
            raise RdfError(f"rdf:ID used twice: {name}")
        ids.add(at)
        return iri_node(at)

    def split_attributes(attrs, top):
        """RDF syntax attributes by local name, property attributes, and the base and language in force."""
        rdf, props, base, lang = {}, [], top.base, top.lang
        for name, value in attrs.items():
            ns, _, local = name.rpartition(" ")
            if ns == RDF_NS and local in ("about", "ID", "nodeID", "resource", "parseType", "datatype"):
                rdf[local] = value
            elif ns == XML_NS:
                if local == "base":
                    base = resolve(top.base, value).split("#", 1)[0]
                elif local == "lang":
                    lang = value.lower()
            elif ns:
                props.append((ns + local, value))
        return rdf, props, base, lang

    def text_object(text, lang, datatype=""):
        return ("lit", text, datatype or ("rdf:langString" if lang else "xsd:string"), "" if datatype else lang)

    def property_attributes(subject, props, base, lang):
        for p, value in props:
            emit((subject, p, iri_node(resolve(base, value)) if p == TYPE else text_object(value, lang), ""))

    def start_node(name, attrs, top):
        rdf, props, base, lang = split_attributes(attrs, top)
        if "about" in rdf:
            subject = iri_node(resolve(base, rdf["about"]))
        elif "ID" in rdf:
            subject = own_id(base, rdf["ID"])
        elif "nodeID" in rdf:
            subject = blank_node(f"{scope}n{rdf['nodeID']}")
        else:
            subject = fresh()
        kind = iri(name)
        if kind != RDF_NS + "Description":
            emit((subject, TYPE, iri_node(kind), ""))
        property_attributes(subject, props, base, lang)
        if top.role == "list":
            top.items.append(subject)
        elif top.role == "prop":
            if top.object is not None:
                raise RdfError("a property element holds more than one node element")
            top.object = subject
        stack.append(Frame("node", base, lang, subject))

    def start_property(name, attrs, top):
        p = iri(name)
        if p == RDF_NS + "li":
            top.count += 1
            p = f"{RDF_NS}_{top.count}"
        if not attrs:  # the usual case: text or a nested node
            stack.append(Frame("prop", top.base, top.lang, top.subject, p))
            return
        rdf, props, base, lang = split_attributes(attrs, top)
        reify = own_id(base, rdf["ID"]) if "ID" in rdf else None
        datatype = short_datatype(resolve(base, rdf["datatype"])) if "datatype" in rdf else ""
        frame = Frame("prop", base, lang, top.subject, p, datatype, reify)
        how = rdf.get("parseType")
        if how == "Resource":
            node = fresh()
            finish(frame, node)
            frame = Frame("node", base, lang, node)
        elif how == "Collection":
            frame.role = "list"
        elif how is not None:
            frame.role, state["depth"] = "xml", 0
        elif "resource" in rdf or "nodeID" in rdf or props:
            frame.object = (iri_node(resolve(base, rdf["resource"])) if "resource" in rdf else
                            blank_node(f"{scope}n{rdf['nodeID']}") if "nodeID" in rdf else fresh())
            property_attributes(frame.object, props, base, lang)
        stack.append(frame)

    def finish(frame, obj):
        emit((frame.subject, frame.predicate, obj, ""))
        if frame.reify is not None:
            emit((frame.reify, TYPE, STATEMENT, ""))
            emit((frame.reify, RDF_NS + "subject", frame.subject, ""))
            emit((frame.reify, RDF_NS + "predicate", iri_node(frame.predicate), ""))
            emit((frame.reify, RDF_NS + "object", obj, ""))

    def end_property(frame):
        text = frame.text[0] if len(frame.text) == 1 else "".join(frame.text)
        if frame.role == "xml":
            finish(frame, ("lit", text, RDF_NS + "XMLLiteral", ""))
        elif frame.role == "list":
            cells = [fresh() for _ in frame.items] + [NIL]
            finish(frame, cells[0])
            for i, item in enumerate(frame.items):
                emit((cells[i], RDF_NS + "first", item, ""))
                emit((cells[i], RDF_NS + "rest", cells[i + 1], ""))
        elif frame.object is not None:
            if text.strip():
                raise RdfError(f"text beside a node in {frame.predicate}")
            finish(frame, frame.object)
        else:
            finish(frame, text_object(text, frame.lang, frame.datatype))

    def on_start(name, attrs):
        top = stack[-1]
        if top.role == "xml":
            ns, _, local = name.rpartition(" ")
            declared = f" xmlns={quoteattr(ns)}" if ns else ""
            written = "".join(f" {k.rpartition(' ')[2]}={quoteattr(v)}" for k, v in attrs.items())
            top.text.append(f"<{local}{declared}{written}>")
            state["depth"] += 1
        elif top.role == "node":
            start_property(name, attrs, top)
        elif top.role == "doc" and name == RDF_NS + " RDF":
            _, _, base, lang = split_attributes(attrs, top)
            stack.append(Frame("doc", base, lang))
        else:
            start_node(name, attrs, top)

    def on_text(text):
        top = stack[-1]
        if top.role == "prop":
            top.text.append(text)
        elif top.role == "xml":
            top.text.append(escape(text))
        elif text.strip():
            raise RdfError("text where an element was expected")

    def on_end(name):
        top = stack[-1]
        if top.role == "xml" and state["depth"]:
            state["depth"] -= 1
            top.text.append(f"</{name.rpartition(' ')[2]}>")
            return
        stack.pop()
        if top.predicate is not None:
            end_property(top)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = on_start, on_end, on_text
    view = memoryview(data)
    for at in range(0, max(len(data), 1), CHUNK):
        parser.Parse(bytes(view[at:at + CHUNK]), False)
        yield
    parser.Parse(b"", True)
    yield
