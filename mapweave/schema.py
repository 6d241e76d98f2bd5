"""The tables that the operators pass on, as DDL.

Coordinates travel as points: ``x`` and ``y`` are doubles, ``key`` is the text
by which two points are the same when lines are stitched.
"""

from typing import Any, NamedTuple

POINT = "struct<x:double,y:double,key:string>"
#: A vertex of a way: a point, or the id of a node to look up.
VERTEX = f"struct<ref:string,at:{POINT}>"
TAG = "struct<k:string,v:string>"
#: Property values are JSON text, so numbers and nested values keep their type.
PROPS = "map<string,string>"
MEMBER = f"struct<type:string,ref:string,role:string,inline:boolean,tagged:boolean,props:{PROPS},at:{POINT},vertices:array<{VERTEX}>>"
ELEMENT = f"pos long, type string, id string, tagged boolean, tags array<{TAG}>, props {PROPS}, at {POINT}, vertices array<{VERTEX}>, bounds array<double>, members array<{MEMBER}>"
DOCUMENT = "doc_id string, payload string"


class Member(NamedTuple):
    """MEMBER in Python; points are tuples (x, y, key), vertices tuples (ref, at)."""

    type: str | None
    ref: str | None
    role: str
    inline: bool
    tagged: bool
    props: Any
    at: tuple | None
    vertices: list[tuple] | None


class Element(NamedTuple):
    """ELEMENT in Python."""

    pos: int
    type: str
    id: str | None
    tagged: bool
    tags: list[tuple] | None
    props: Any
    at: tuple | None
    vertices: list[tuple] | None
    bounds: list[float | None] | None
    members: list[Member | None] | None
