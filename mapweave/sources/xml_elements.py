"""Elements of XML documents under the strict lexical grammar.

The grammar is not XML's: entities stay as they are, an attribute needs a
value, single quotes count only where a tag has no double-quoted attribute, a
literal ``>`` ends a tag, and an element's body reaches to the first closing
tag of its name. One document is read in one go; documents are independent,
so a corpus scales by documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mapweave.functions.planar import Point
from mapweave.schema import ELEMENT, Element, Member

_ANY = r"[^\n\r  ]"
_OPEN = re.compile(rf"<([^ >/]+)({_ANY}*?)>")
_DOUBLE = re.compile(rf'([^ ]+?)="({_ANY}+?)"')
_SINGLE = re.compile(rf"([^ ]+?)='({_ANY}+?)'")
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", re.ASCII)
#: Deeper nesting holds nothing that is read.
_DEPTH = 4


@dataclass
class Tag:
    name: str
    attributes: dict[str, str]
    children: list[Tag] = field(default_factory=list)


def scan(text: str, start: int = 0, stop: int | None = None, depth: int = 0) -> list[Tag]:
    """The tags of a stretch of text, each with those of its body."""
    stop = len(text) if stop is None else stop
    out, at = [], start
    while at < stop and (m := _OPEN.search(text, at, stop)):
        name, inside = m[1], m[2].strip()
        tag = Tag(name, dict(_DOUBLE.findall(inside)) or dict(_SINGLE.findall(inside)))
        at = m.end()
        if not (inside.endswith("/") or name[0] in "?!"):
            # a body has at least one character
            end = text.find(f"</{name}>", at + 1, stop)
            if end >= 0:
                if depth < _DEPTH:
                    tag.children = scan(text, at, end, depth + 1)
                at = end + len(name) + 3
        out.append(tag)
    return out


def number(text: str | None) -> float | None:
    m = _NUMBER.match(text or "")
    return float(m[1]) if m else None


def _point(a: dict[str, str]) -> Point:
    lon, lat = a.get("lon"), a.get("lat")
    return number(lon), number(lat), f"{lon or ''},{lat or ''}"


def _texts(values: dict[str, str], deny: tuple[str, ...] = ()) -> dict[str, str]:
    return {k: json.dumps(v, ensure_ascii=False) for k, v in values.items() if k not in deny and not k.startswith("$")}


def _vertices(children: list[Tag], only: str | None = None) -> list[tuple[str | None, Point | None]]:
    out = []
    for c in children:
        if only and c.name != only:
            continue
        a = c.attributes
        if a.get("lon") and a.get("lat"):
            out.append((None, _point(a)))
        elif a.get("ref"):
            out.append((a["ref"], None))
    return out


def _member(tag: Tag) -> Member:
    a = tag.attributes
    kind, here = a.get("type"), bool(a.get("lat") and a.get("lon"))
    vertices = _vertices(tag.children)
    if any(at for _, at in vertices):
        vertices = [v for v in vertices if v[1]]
    node_here, way_here = kind == "node" and here, kind == "way" and bool(vertices)
    props = {}
    if node_here:
        # the type of a member isn't its own property; its empty tags are
        props = {"role": json.dumps(a.get("role", ""), ensure_ascii=False), **_texts(a, ("id", "type", "lat", "lon")), "tags": "{}"}
        if vertices:
            props["geometry" if vertices[0][1] else "nodes"] = json.dumps([ref for ref, _ in vertices] if vertices[0][0] else [c.attributes for c in tag.children if c.attributes.get("lat") and c.attributes.get("lon")])
    return Member(kind, a.get("ref"), a.get("role", ""), node_here or way_here, node_here, props, _point(a) if node_here else None, vertices if way_here else None)


def read_document(text: str) -> Iterator[Element]:
    """The nodes, ways and relations right below ``osm``, in document order."""
    found = [e for root in scan(text) if root.name == "osm" for e in root.children]
    for pos, e in enumerate(found):
        a = e.attributes
        tags = [(c.attributes.get("k"), c.attributes.get("v")) for c in e.children if c.name == "tag"]
        at = vertices = bounds = members = None
        if e.name == "node":
            own = _texts(a, ("id", "lat", "lon"))
            at = _point(a)
        elif e.name == "way":
            own = _texts(a, ("id",))
            vertices = _vertices(e.children, "nd")
        elif e.name == "relation":
            own = {}
            for c in e.children:
                if c.name == "bounds":
                    bounds = [number(c.attributes.get(k)) for k in ("minlon", "minlat", "maxlon", "maxlat")]
            members = [_member(c) for c in e.children if c.name == "member"]
        else:
            continue
        if tags:
            # a tag without a key or value still counts, but JSON has no place for it
            own |= {k: json.dumps(v, ensure_ascii=False) for k, v in tags if k is not None and v is not None}
            gone = {k for k, v in tags if v is None}
            own = {k: v for k, v in own.items() if k not in gone}
        yield Element(pos, e.name, a.get("id", "undefined"), bool(tags), [t for t in tags if t[0] is not None], own, at, vertices, bounds, members)


def properties(of: Element | Member) -> dict[str, str]:
    return of.props


def tags(of: Element) -> list[tuple[str, str | None]]:
    return of.tags


#: Elements that are held before they are handed on.
_ROWS = 10_000


def element_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and elements from those of (doc_id, payload); elements of many small documents share one."""
    for batch in batches:
        ids = batch.column("doc_id")
        at: list[int] = []
        held: list[Element] = []

        def made() -> pa.RecordBatch:
            columns = zip(*held, strict=True)  # noqa: B023
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], ["doc_id", *schema.names])  # noqa: B023

        for k, payload in enumerate(batch.column("payload")):
            for e in read_document(payload.as_py()):
                at.append(k)
                members = e.members and [m._replace(props=list(m.props.items())) for m in e.members]
                held.append(e._replace(props=list(e.props.items()), members=members))
                if len(held) == _ROWS:
                    yield made()
                    at, held = [], []
        if held:
            yield made()


def read_elements(documents: DataFrame) -> DataFrame:
    """(doc_id, payload) of XML documents -> doc_id and the columns of ELEMENT."""
    schema = to_arrow_schema(StructType.fromDDL(ELEMENT))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "payload").mapInArrow(lambda batches: element_batches(batches, schema), f"doc_id {kind}, {ELEMENT}")
