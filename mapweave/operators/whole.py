"""Whole documents to features: each document's text is read and converted in one pass, without a shuffle.

The rules are those of ``registry``, ``relations`` and ``features``, which deal
the elements of documents that are too large for a task. Properties are
written for elements that are kept, and points bound for ways that are drawn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import attrgetter, itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mapweave.functions import planar as P
from mapweave.functions.planar import Line, Point
from mapweave.functions.rules import area_of
from mapweave.operators.relations import below, cyclic
from mapweave.operators.stitch import chains, flatten
from mapweave.options import Options
from mapweave.sources import json_text, xml_elements
from mapweave.sources.documents import MALFORMED, with_format

ORD = "struct<pos:bigint,member:int,rank:int,i:int>"
FEATURES = f"ord {ORD}, type string, id string, bbox array<double>, properties string, geometry string, of_relation boolean, error string"
#: Rows and characters of results that are held before they are handed on.
_ROWS, _CHARACTERS = 10_000, 16_000_000
EMPTY = '{"type":"FeatureCollection","features":[]}'


class Feature(NamedTuple):
    ord: tuple[int, int, int, int]
    type: str
    id: str
    bbox: list | None
    properties: str
    geometry: str
    of_relation: bool


class _Instance:
    """An element, or a member that brings its own geometry, at its place (pos, member)."""

    __slots__ = ("at", "bounds", "first", "id", "inline", "members", "own", "place", "points", "tagged", "type", "vertices")

    def __init__(self, place, type_, id_, inline, tagged, own, at, vertices, bounds, members) -> None:
        self.place, self.type, self.id, self.inline, self.tagged = place, type_, id_, inline, tagged
        #: What properties and tags are made of.
        self.own = own
        self.at, self.vertices, self.bounds, self.members = at, vertices, bounds, members
        self.first, self.points = place, None


class Document:
    """The registry of one document and its features."""

    def __init__(self, reader, text: str, options: Options) -> None:
        self.options, self.reader = options, reader
        self.every: list[_Instance] = []
        self.inline: dict[tuple[int, int], _Instance] = {}
        self.won: dict[str, dict[str | None, _Instance]] = {"node": {}, "way": {}, "relation": {}}
        refs: dict[str, set[str]] = {"node": set(), "way": set(), "relation": set()}
        for e in reader.read_document(text):
            self._stand(_Instance((e.pos, 0), e.type, e.id, False, e.tagged, e, e.at, e.vertices, e.bounds, e.members))
            for i, m in enumerate(e.members or ()):
                if m is None:
                    continue
                if m.inline:
                    one = _Instance((e.pos, i + 1), m.type, "undefined" if m.ref is None else m.ref, True, m.tagged, m, m.at, m.vertices, None, None)
                    self.inline[one.place] = one
                    self._stand(one)
                elif m.ref is not None and m.type in refs:
                    refs[m.type].add(m.ref)
        nodes = refs["node"]
        for x in self.every:
            if x.type == "way" and x.vertices:
                nodes.update([v[0] for v in x.vertices if v[0] is not None])
        self.kept = [x for kind in self.won.values() for x in kind.values() if self._kept(x, refs)]

    def _stand(self, x: _Instance) -> None:
        self.every.append(x)
        kind = self.won[x.type]
        before = kind.get(x.id)
        if before is not None:
            x.first = before.first
        kind[x.id] = x

    def _kept(self, x: _Instance, refs: dict[str, set[str]]) -> bool:
        if not x.inline and x.id not in refs[x.type]:
            return True
        return x.tagged and self.options.tagged and not (x.type == "way" and self.options.exclude_ways)

    def points(self, way: _Instance) -> list[Point]:
        """The vertices of a way in order; nodes that don't exist drop out."""
        if way.points is None:
            nodes = self.won["node"]
            found = [at if ref is None else (nodes[ref].at if ref in nodes else None) for ref, at in way.vertices or ()]
            way.points = [p for p in found if p is not None]
        return way.points

    def own_parts(self, relation: _Instance) -> tuple[list[list[Point]], list[str]]:
        """The ways of a relation that exist, and the roles of all its way members."""
        ways, roles = [], []
        for i, m in enumerate(relation.members or ()):
            if m is not None and m.type == "way":
                roles.append(m.role)
                way = self.inline[(relation.place[0], i + 1)] if m.inline else self.won["way"].get(m.ref) if m.ref is not None else None
                if way is not None:
                    ways.append(self.points(way))
        return ways, roles

    def errors(self) -> list[str]:
        out = []
        self.edges = [
            {"from": x.id, "i": i, "ref": m.ref}
            for x in self.won["relation"].values()
            for i, m in enumerate(x.members or ())
            if m is not None and m.type == "relation" and m.ref is not None and m.ref in self.won["relation"]
        ]
        self.cycle = False
        if self.edges:
            try:
                cyclic(list(self.won["relation"]), self.edges)
            except ValueError as e:
                self.cycle = True
                out.append(str(e))
        if self.options.strict:
            out += [f"a null vertex in way {x.id}" for x in self.every if x.vertices and any(ref is None and at is None for ref, at in x.vertices)]
        return out

    def shapes(self, roots: list[_Instance]) -> Iterator[tuple[_Instance, str | None]]:
        """The relations with the geometry that each has, in order; none is made before it is asked for."""
        known = [] if self.cycle else [x.id for x in roots if x.id is not None]
        found = groupby(below(known, self.edges), itemgetter(0))
        for x in roots:
            yield x, None if self.cycle or x.id is None else self._shape([(path, *self.own_parts(self.won["relation"][id_])) for _, path, id_ in next(found)[1]])

    @staticmethod
    def _shape(parts: list[tuple[list[int], list[list[Point]], list[str]]]) -> str | None:
        """The geometry of a relation from the path, ways and roles of itself and of all below it."""
        # a relation's own roles alone choose between area and lines
        area = "outer" in parts[0][2]
        ways, roles = parts[0][1:] if len(parts) == 1 else flatten([{"path": p, "ways": w, "roles": r} for p, w, r in parts])
        if area:
            by_role = {role: [w for w, r in zip(ways, roles, strict=False) if r == role] for role in ("outer", "inner")}
            outers, inners = ([P.oriented(ring, turn) for ring in stitch(by_role[role]) if P.is_ring(ring)] for role, turn in (("outer", False), ("inner", True)))
            areas = [P.polygon_json(p) for p in P.polygons(outers, inners)]
            if areas:
                return P.geometry("Polygon", areas[0]) if len(areas) == 1 else P.geometry("MultiPolygon", "[" + ",".join(areas) + "]")
        elif lines := stitch(ways):
            return P.geometry("MultiLineString", P.polygon_json(lines))
        return None

    def bare(self) -> str | None:
        """The first geometry among those of ``features`` that relations bring; none behind it is made."""
        for x, shape in self.shapes(sorted([x for x in self.kept if x.type == "relation"], key=attrgetter("first"))):
            if shape is not None:
                return shape
            for _, _, _, at in self.nodes_of(x):
                return P.point_json(at)
        return None

    def nodes_of(self, relation: _Instance) -> Iterator[tuple[int, str, object, Point]]:
        """(i, id, own, at) of the node members that exist."""
        for i, m in enumerate(relation.members or ()):
            if m is None or m.type != "node":
                continue
            if m.inline:
                yield i, "undefined" if m.ref is None else m.ref, m, m.at
            elif m.ref is not None and m.ref in self.won["node"]:
                node = self.won["node"][m.ref]
                yield i, m.ref, node.own, node.at

    def _properties(self, kind: str, id_: str | None, own) -> tuple[str, str]:
        name = kind if id_ is None else f"{kind}/{id_}"
        props = self.reader.properties(own)
        first = "" if "id" in props else f'"id":{json_text.quoted(name)}'
        rest = ",".join([f"{json_text.quoted(k)}:{v}" for k, v in props.items() if v is not None])
        return name, "{" + first + ("," if first and rest else "") + rest + "}"

    def features(self) -> list[Feature]:
        """In the order of the document."""
        out = []
        for x in self.kept:
            pos, member = x.first
            if x.type == "node":
                out.append(Feature((pos, member, 1, 0), "node", *self._named(x.type, x.id, None, x.own, P.point_json(x.at)), False))
            elif x.type == "way":
                points = self.points(x)
                if len(points) > 1:
                    area = P.is_ring(points) and area_of(() if x.inline else self.reader.tags(x.own))
                    shape = P.geometry("Polygon", "[" + P.line_json(P.oriented(points, False)) + "]") if area else P.geometry("LineString", P.line_json(points))
                    out.append(Feature((pos, member, 1, 0), "way", *self._named(x.type, x.id, None, x.own, shape), False))
        for x, shape in self.shapes([x for x in self.kept if x.type == "relation"]):
            pos, member = x.first
            if shape is not None:
                out.append(Feature((pos, member, 1, 0), "relation", *self._named(x.type, x.id, x.bounds, x.own, shape), True))
            for i, id_, own, at in self.nodes_of(x):
                out.append(Feature((pos, member, 2, i), "node", *self._named("node", id_, None, own, P.point_json(at)), True))
        out.sort(key=lambda f: f.ord)
        return out

    def _named(self, kind: str, id_: str | None, bbox: list | None, own, shape: str) -> tuple:
        name, properties = self._properties(kind, id_, own)
        return name, bbox, properties, shape


def stitch(ways: list[list[Point]]) -> list[Line]:
    """The joined lines of ways, end to end."""
    ways = [w for w in ways if w]
    if len(ways) < 2:
        return ways
    out = []
    for run in chains([w[0][2] for w in ways], [w[-1][2] for w in ways]):
        line: Line = []
        for k, (i, turned) in enumerate(run):
            points = ways[i][::-1] if turned else ways[i]
            line += points[1:] if k else points
        out.append(line)
    return out


def read(text: str | None, format_: str, options: Options) -> tuple[Document | None, list[str]]:
    """A document and its errors; none where the text is no document."""
    if format_ not in ("json", "xml"):
        return None, []
    try:
        document = Document(json_text if format_ == "json" else xml_elements, text, options)
    except json_text.Malformed:
        return None, [MALFORMED]
    return document, document.errors()


def converted(text: str | None, format_: str, options: Options) -> tuple[list[Feature], list[str]]:
    """The features of a document and its errors."""
    document, errors = read(text, format_, options)
    return [] if document is None else document.features(), errors


def collection(text: str | None, format_: str, options: Options) -> tuple[str, str | None]:
    """(geojson, error) of a document."""
    document, errors = read(text, format_, options)
    if errors or document is None:
        return EMPTY, min(errors, default=None)
    bare = None if options.complete else document.bare()
    if bare is not None:
        return bare, None
    return '{"type":"FeatureCollection","features":[' + ",".join([_feature_json(f) for f in document.features()]) + "]}", None


def _feature_json(f: Feature) -> str:
    box = "" if f.bbox is None else ',"bbox":[' + ",".join(map(P.double, f.bbox)) + "]"
    return f'{{"type":"Feature","id":{json_text.quoted(f.id)}{box},"properties":{f.properties},"geometry":{f.geometry}}}'


def _mapped(documents: DataFrame, columns: str, of: Callable[[str | None, str], Iterator[tuple[tuple, int]]]) -> DataFrame:
    """The rows that ``of`` yields for each document, with their size, behind its doc_id."""
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            at, rows, held = [], [], 0

            def made() -> pa.RecordBatch:
                columns_ = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns_, schema, strict=True))], ["doc_id", *schema.names])  # noqa: B023

            for k, (payload, format_) in enumerate(zip(batch.column("payload"), batch.column("format"), strict=True)):
                for row, size in of(payload.as_py(), format_.as_py()):
                    at.append(k)
                    rows.append(row)
                    held += size
                    if len(rows) >= _ROWS or held >= _CHARACTERS:
                        yield made()
                        at, rows, held = [], [], 0
            if rows:
                yield made()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return with_format(documents).mapInArrow(run, f"doc_id {kind}, {columns}")


def features_and_errors(documents: DataFrame, options: Options) -> DataFrame:
    """One row per feature, and one with an error alone for each error of a document."""

    def of(text: str | None, format_: str) -> Iterator[tuple[tuple, int]]:
        features, errors = converted(text, format_, options)
        for f in features:
            yield (f.ord, f.type, json_text.encodable(f.id), f.bbox, json_text.encodable(f.properties), f.geometry, f.of_relation, None), len(f.properties) + len(f.geometry)
        for e in errors:
            yield (None,) * 7 + (json_text.encodable(e),), len(e)

    return _mapped(documents, FEATURES, of)


def to_collections(documents: DataFrame, options: Options) -> DataFrame:
    """doc_id, geojson, error: a row per document."""

    def of(text: str | None, format_: str) -> Iterator[tuple[tuple, int]]:
        geojson, error = collection(text, format_, options)
        yield (json_text.encodable(geojson), error and json_text.encodable(error)), len(geojson)

    return _mapped(documents, "geojson string, error string", of)
