"""Elements of one JSON document in Python, by the rules of ``json_elements``.

Whole numbers keep their text. Property values are written as Spark's variants are:
keys in order, decimals without trailing zeros.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring

from mapweave.functions.planar import Point, double
from mapweave.schema import Element, Member
from mapweave.sources.xml_elements import number

_DENIED = {
    "node": {"id", "type", "tags", "lat", "lon"},
    "way": {"id", "type", "tags", "nodes", "geometry"},
    "relation": {"id", "type", "tags", "bounds", "members"},
    None: {"id", "type", "lat", "lon"},
}
_WHOLE_KEY = re.compile(r"(?:0|[1-9][0-9]{0,9})", re.ASCII)
_DOUBLE = re.compile(r"[\x00-\x20]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[dDfF]?[\x00-\x20]*", re.ASCII)
_CONTROL = re.compile(r"([\x0b\x0e\x0f\x1a-\x1f])")


class Malformed(ValueError):
    """A text that is no JSON."""


class Number(str):
    """The text of a number."""

    __slots__ = ()


def _no_number(text: str) -> None:
    raise Malformed(text)


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Malformed("a key is repeated")
    return out


def _float(text: str) -> str:
    """Numbers with a point or exponent are doubles; too large ones are texts."""
    out = double(float(text))
    return out.strip('"') if out[0] == '"' else Number(out)


_DECODER = json.JSONDecoder(parse_float=_float, parse_int=Number, parse_constant=_no_number, object_pairs_hook=_object)
_BLANK = re.compile(r"[ \t\n\r]*")


def encodable(text: str) -> str:
    """Halves of surrogate pairs have no UTF-8."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def quoted(text: str) -> str:
    """A text as a JSON string; hexadecimal digits are capitals, as Spark writes them."""
    if _CONTROL.search(text) is None:
        return encode_basestring(text)
    return '"' + "".join([f"\\u{ord(x):04X}" if _CONTROL.match(x) else encode_basestring(x)[1:-1] for x in _CONTROL.split(text)]) + '"'


def _plain(text: str) -> str:
    """A number's text as a variant of it is written."""
    if text.lstrip("-").isdigit():
        if len(text) < 21 and -(2**63) <= int(text) < 2**63:
            return str(int(text))
    elif "e" in text or "E" in text:
        return double(float(text))
    whole, _, part = text.lstrip("-").partition(".")
    if len((whole + part).lstrip("0")) > 38 or len(part) > 38:
        return double(float(text))
    part = part.rstrip("0")
    out = whole + ("." + part if part else "")
    return "-" + out if text[0] == "-" and out != "0" else out


def _ordered(keys) -> list[str]:
    return sorted(keys) if all(map(str.isascii, keys)) else sorted(keys, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def written(value) -> str:
    """A value as JSON text."""
    if type(value) is str:
        return quoted(value)
    if type(value) is Number:
        return _plain(value)
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if type(value) is list:
        return "[" + ",".join(map(written, value)) + "]"
    return "{" + ",".join([f"{quoted(k)}:{written(value[k])}" for k in _ordered(value)]) + "}"


def _text(value) -> str | None:
    """A value as a text: numbers and nested values are their own."""
    if type(value) is str or value is None:
        return value
    if type(value) is Number:
        return str(value)
    if type(value) is list:
        return "[" + ",".join([_inside(x) for x in value]) + "]"
    if type(value) is dict:
        return "{" + ",".join([f"{encode_basestring(k)}:{_inside(x)}" for k, x in value.items()]) + "}"
    return "true" if value else "false"


def _inside(value) -> str:
    return encode_basestring(value) if type(value) is str else "null" if value is None else _text(value)


def _number(value) -> float | None:
    return float(value) if type(value) is Number else number(_text(value))


def _point(lon, lat) -> Point:
    """Numbers are the same when their values are."""
    x, y = _number(lon), _number(lat)
    return x, y, (_text(lon) or "" if x is None else x, _text(lat) or "" if y is None else y)


def _vertices(e: dict) -> list[tuple[str | None, Point | None]] | None:
    geometry, nodes = e.get("geometry"), e.get("nodes")
    if type(geometry) is list:
        return [(None, _point(p.get("lon"), p.get("lat")) if type(p) is dict else None) for p in geometry]
    return [(_text(r), None) for r in nodes] if type(nodes) is list else None


def _nonzero(value) -> bool:
    """Truthy as a JavaScript number or text: absent, empty and zero are not."""
    text = _text(value)
    if not text:
        return False
    m = _DOUBLE.fullmatch(text)
    return not (m and float(m[1]) == 0)


def _member(m) -> Member | None:
    if type(m) is not dict:
        return None
    kind, lon, lat, tags = m.get("type"), m.get("lon"), m.get("lat"), m.get("tags")
    node_here = kind == "node" and _nonzero(lat) and _nonzero(lon)
    vertices = _vertices(m)
    role = _text(m.get("role"))
    return Member(kind, _text(m.get("ref")), "" if role is None else role, node_here or (kind == "way" and vertices is not None), node_here and tags is not None, m, _point(lon, lat) if node_here else None, vertices)


def read_document(text: str) -> Iterator[Element]:
    """The nodes, ways and relations of ``elements``; ``props`` is the object itself, from which ``properties`` and ``tags`` are made."""
    try:
        root, _ = _DECODER.raw_decode(text, _BLANK.match(text).end())
    except (ValueError, RecursionError) as e:
        raise Malformed(str(e)) from e
    elements = root.get("elements") if type(root) is dict else None
    for pos, e in enumerate(elements if type(elements) is list else ()):
        kind = e.get("type") if type(e) is dict else None
        if kind == "node":
            at, vertices, bounds, members = _point(e.get("lon"), e.get("lat")), None, None, None
        elif kind == "way":
            at, vertices, bounds, members = None, _vertices(e), None, None
        elif kind == "relation":
            b, m = e.get("bounds"), e.get("members")
            at, vertices = None, None
            bounds = [_number(b.get(k)) for k in ("minlon", "minlat", "maxlon", "maxlat")] if type(b) is dict else None
            members = [_member(x) for x in m] if type(m) is list else None
        else:
            continue
        yield Element(pos, kind, _text(e.get("id")), e.get("tags") is not None, None, e, at, vertices, bounds, members)


def properties(of: Element | Member) -> dict[str, str]:
    """Property values as JSON texts; those of tags stand over others."""
    e = of.props
    denied = _DENIED[of.type if type(of) is Element else None]
    over = e.get("tags")
    over = over if type(over) is dict else {}
    out = {k: written(e[k]) for k in _ordered(e) if k not in denied and k not in over}
    for k in _ordered(over):
        out[k] = written(over[k])
    return out


def tags(of: Element) -> list[tuple[str, str | None]]:
    """Tags in text order; integer-like keys come first, as in JavaScript objects."""
    own = of.props.get("tags")
    if type(own) is not dict:
        return []
    whole = sorted((k for k in own if _WHOLE_KEY.fullmatch(k)), key=int)
    return [(k, _text(own[k])) for k in (*whole, *(k for k in own if not _WHOLE_KEY.fullmatch(k)))]
