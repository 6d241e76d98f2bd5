"""Whole documents against features worked out by hand."""

import json

import pytest

from mapweave.api import convert, release, to_collections, to_features
from mapweave.sources.documents import from_objects
from mapweave.sources.sinks import _whole, compact, write_collections, write_feature_lines, write_feature_table

FULL = {"completeFeature": True}


def node(i, lon, lat, **more):
    return {"type": "node", "id": i, "lat": lat, "lon": lon, **more}


def way(i, nodes=None, **more):
    return {"type": "way", "id": i, **({"nodes": nodes} if nodes is not None else {}), **more}


def rel(i, *members, **more):
    return {"type": "relation", "id": i, "members": list(members), **more}


def m(kind, ref, role="", **more):
    return {"type": kind, "ref": ref, "role": role, **more}


def geo(*places):
    return [{"lon": x, "lat": y} for x, y in places]


SQUARE = ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
#: A closed way of four corners and its nodes, an area with a hole, five places along a street, two streets that meet.
KITE = [node(71, 10, 3), node(72, 12, 6), node(73, 10, 11), node(74, 8, 6), way(70, [71, 72, 73, 74, 71])]
KITE_AT = [[10, 3], [12, 6], [10, 11], [8, 6], [10, 3]]
LAKE = [
    rel(90, m("way", 91, "outer"), m("way", 92, "inner"), tags={"type": "multipolygon"}),
    way(91, [31, 32, 33, 34, 35, 31], tags={"natural": "water"}), way(92, [36, 37, 38, 36]),
    node(31, 20, 50), node(32, 29, 50), node(33, 31, 55), node(34, 25, 60), node(35, 19, 55), node(36, 23, 53), node(37, 24, 56), node(38, 26, 53.5),
]
LAKE_AT = {"type": "Polygon", "coordinates": [[[20, 50], [29, 50], [31, 55], [25, 60], [19, 55], [20, 50]], [[23, 53], [24, 56], [26, 53.5], [23, 53]]]}
STREET = [node(20 + k, 7 + 0.5 * k, 40 + k % 2) for k in range(5)]
STREET_AT = [[7 + 0.5 * k, 40 + k % 2] for k in range(5)]
MEETING = [*STREET[:3], way(55, [21, 20], tags={"highway": "service"}), way(56, [22, 21]), rel(57, m("way", 55), m("way", 56))]

#: name -> (document, options, expected [(id, type, coordinates)])
CASES = {
    "empty": ([], FULL, []),
    "node": ([node(31, -7.75, 62.5)], FULL, [("node/31", "Point", [-7.75, 62.5])]),
    "way before its nodes": ([way(8, [24, 20, 23]), *STREET], FULL, [("way/8", "LineString", [STREET_AT[4], STREET_AT[0], STREET_AT[3]]), ("node/21", "Point", STREET_AT[1]), ("node/22", "Point", STREET_AT[2])]),
    "missing node shortens": ([*STREET[:2], way(8, [20, 77, 21, 78])], FULL, [("way/8", "LineString", STREET_AT[:2])]),
    "closed but cliff": ([way(1, [2], geometry=geo((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), tags={"natural": "cliff"})], FULL, [("way/1", "LineString", [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]])]),
    "polygon with hole": (LAKE, FULL, [("relation/90", "Polygon", LAKE_AT["coordinates"])]),
    "ordered inline ways": ([*STREET, rel(61, m("way", 62, nodes=[21, 20]), m("way", 63, nodes=[21, 22]), m("way", 64, nodes=[24, 23]), m("way", 65, nodes=[22, 23]))], FULL, [("relation/61", "MultiLineString", [STREET_AT])]),
    "relation in relation": ([rel(82, m("relation", 81)), rel(81, m("way", 80, nodes=[22, 23, 24])), *STREET[2:]], FULL, [("relation/82", "MultiLineString", [STREET_AT[2:]])]),
    "own ways first": ([*STREET, rel(81, m("way", 80, nodes=[22, 23])), rel(82, m("relation", 81), m("way", 83, nodes=[20, 21, 22]))], FULL, [("node/24", "Point", STREET_AT[4]), ("relation/82", "MultiLineString", [STREET_AT[:4]])]),
    "reached twice counts twice": (
        [*STREET[:4], way(43, [20, 21]), way(44, [22, 21]), rel(45, m("way", 43)), rel(46, m("way", 44)), rel(47, m("relation", 46), m("relation", 45)), rel(48, m("relation", 47), m("relation", 46)), rel(49, m("way", 43, "x"), m("relation", 48))],
        FULL, [("node/23", "Point", STREET_AT[3]), ("relation/49", "MultiLineString", [[STREET_AT[2], STREET_AT[1], STREET_AT[0], STREET_AT[1], STREET_AT[2]]])],
    ),
    "roles shift": ([*KITE, rel(66, m("way", 69, "outer"), m("way", 70, "inner"))], FULL, [("relation/66", "Polygon", [KITE_AT])]),
    "inline then top": ([rel(1, m("way", 7, geometry=geo((0, 0), (1, 0)))), way(7, geometry=geo((5, 5), (6, 6)), tags={"a": "b"})], FULL, [("relation/1", "MultiLineString", [[[0, 0], [1, 0]]]), ("way/7", "LineString", [[5, 5], [6, 6]])]),
    "top then inline": ([way(7, geometry=geo((5, 5), (6, 6)), tags={"a": "b"}), rel(1, m("way", 7, geometry=geo((0, 0), (1, 0))))], {**FULL, "renderTagged": True, "excludeWay": False}, [("relation/1", "MultiLineString", [[[0, 0], [1, 0]]])]),
    "last rule wins, line": ([way(1, geometry=geo(*SQUARE), tags={"building": "yes", "highway": "residential"})], FULL, [("way/1", "LineString", [list(p) for p in SQUARE])]),
    "last rule wins, area": ([way(1, geometry=geo(*SQUARE), tags={"highway": "residential", "building": "yes"})], FULL, [("way/1", "Polygon", [[list(p) for p in SQUARE]])]),
    "clockwise is turned": ([way(1, geometry=geo(*SQUARE[::-1]), tags={"building": "yes"})], FULL, [("way/1", "Polygon", [[list(p) for p in SQUARE]])]),
    "no lookup at the head": ([rel(1, m("way", 1, geometry=geo((1, 0), (2, 0))), m("way", 2, geometry=geo((9, 9), (8, 8))), m("way", 3, geometry=geo((0, 0), (1, 0))))], FULL, [("relation/1", "MultiLineString", [[[1, 0], [2, 0]], [[9, 9], [8, 8]], [[0, 0], [1, 0]]])]),
    "touching rings merge": ([rel(1, m("way", 1, "outer", geometry=geo((0, 0), (1, 0), (1, 1), (0, 0))), m("way", 2, "outer", geometry=geo((0, 0), (-1, 0), (-1, -1), (0, 0))))], FULL, [("relation/1", "Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0], [-1, 0], [-1, -1], [0, 0]]])]),
    "two areas, one hole": (
        [rel(1, m("way", 1, "outer", geometry=geo(*SQUARE)), m("way", 2, "outer", geometry=geo((10, 0), (14, 0), (14, 4), (10, 4), (10, 0))), m("way", 3, "inner", geometry=geo((11, 1), (11, 2), (12, 2), (11, 1))), m("way", 4, "inner", geometry=geo((50, 50), (50, 51), (51, 51), (50, 50))))],
        FULL, [("relation/1", "MultiPolygon", [[[list(p) for p in SQUARE]], [[[10, 0], [14, 0], [14, 4], [10, 4], [10, 0]], [[11, 1], [11, 2], [12, 2], [11, 1]]]])],
    ),
    "node at zero isn't inline": ([rel(1, m("node", 5, lat=0, lon=10))], FULL, []),
    "tagged ways stay hidden": (MEETING, {**FULL, "renderTagged": True}, [("relation/57", "MultiLineString", [STREET_AT[:3]])]),
    "tagged ways shown": (MEETING, {**FULL, "renderTagged": True, "excludeWay": False}, [("way/55", "LineString", [STREET_AT[1], STREET_AT[0]]), ("relation/57", "MultiLineString", [STREET_AT[:3]])]),
    "open outer": ([rel(1, m("way", 1, "outer", geometry=geo((0, 0), (1, 0), (1, 1))))], FULL, []),
    "outers below make no area": ([rel(2, m("relation", 1)), rel(1, m("way", 1, "outer", geometry=geo(*SQUARE)))], FULL, [("relation/2", "MultiLineString", [[list(p) for p in SQUARE]])]),
    "numbers meet by value": ([rel(1, m("way", 1, geometry=[{"lon": 0, "lat": 0}, {"lon": 1.0, "lat": 0}]), m("way", 2, geometry=[{"lon": 1, "lat": 0}, {"lon": 2, "lat": 0}]))], FULL, [("relation/1", "MultiLineString", [[[0, 0], [1, 0], [2, 0]]])]),
    "unknown type": ([{"type": "area", "id": 1}], FULL, []),
    "repeated id, last stands": ([node(1, 0, 0, tags={"a": "1"}), node(2, 5, 5), node(1, 9, 9)], FULL, [("node/1", "Point", [9, 9]), ("node/2", "Point", [5, 5])]),
}


@pytest.fixture(scope="module")
def made(spark):
    """All cases of one set of options in one job, as a corpus: references never leave a document."""
    out = {}
    for options in {json.dumps(o, sort_keys=True) for _, o, _ in CASES.values()}:
        names = [n for n, (_, o, _) in CASES.items() if json.dumps(o, sort_keys=True) == options]
        docs = from_objects(spark, [{"elements": CASES[n][0]} for n in names])
        rows = to_collections(docs, json.loads(options)).collect()
        out |= {names[int(r["doc_id"])]: json.loads(compact(r["geojson"])) for r in rows}
    return out


@pytest.mark.parametrize("name", CASES)
def test_features(made, name):
    got = [(f["id"], f["geometry"]["type"], f["geometry"]["coordinates"]) for f in made[name]["features"]]
    assert got == CASES[name][2]


def test_bare_geometry(spark):
    assert convert(spark, {"elements": LAKE}) == LAKE_AT


def test_properties_keep_types_and_tags_win(spark):
    doc = {"elements": [node(1, 0, 0, version=3, user='a"b', tags={"version": "x", "name": "é"})]}
    assert convert(spark, doc, FULL)["features"][0]["properties"] == {"id": "node/1", "version": "x", "user": 'a"b', "name": "é"}


def test_bbox(spark):
    doc = {"elements": [rel(1, m("way", 1, geometry=geo((0, 0), (1, 1))), bounds={"minlat": 1, "minlon": 2, "maxlat": 3, "maxlon": 4.5})]}
    assert convert(spark, doc, FULL)["features"][0]["bbox"] == [2, 1, 4.5, 3]


LOOP = [rel("top", m("relation", "one")), rel("one", m("relation", "two")), rel("two", m("relation", "one"))]


def test_cycle_raises(spark):
    with pytest.raises(ValueError, match="contains itself"):
        convert(spark, {"elements": LOOP}, FULL)


def test_faults_stay_with_their_document(spark):
    clipped = {"elements": [way(5, geometry=[*geo((1, 2)), None, *geo((3, 4))])]}
    deep = {"elements": [*(rel(i, m("relation", i + 1)) for i in range(150)), rel(150, m("way", 9, geometry=geo((1, 1), (2, 2))))]}
    docs = from_objects(spark, [{"elements": LOOP}, {"elements": KITE}, clipped, deep])
    rows = [r for r in to_collections(docs, {**FULL, "strictGeometry": True}).orderBy("doc_id").collect()]
    assert ["contains itself" in (r["error"] or "") for r in rows] == [True, False, False, False]
    assert [r["error"] for r in rows[1:]] == [None, "a null vertex in way 5", None]
    empty = '{"type":"FeatureCollection","features":[]}'
    assert rows[0]["geojson"] == rows[2]["geojson"] == empty
    ids = [[f["id"] for f in json.loads(r["geojson"])["features"]] for r in rows]
    assert ids[1] == ["way/70"] and ids[3] == ["relation/0"]
    # elements dealt one by one give the same
    again = {r["doc_id"]: r["geojson"] for r in to_collections(docs, {**FULL, "strictGeometry": True, "byDocument": False}).collect()}
    assert again == {r["doc_id"]: r["geojson"] for r in rows}


def test_sinks(spark, tmp_path):
    features = to_features(from_objects(spark, [{"elements": KITE}, {"elements": LAKE}]), FULL)
    write_feature_lines(features, str(tmp_path / "lines"))
    write_feature_table(features, str(tmp_path / "table"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert {x["id"]: x["geometry"] for x in map(_whole, lines)} == {"way/70": {"type": "LineString", "coordinates": KITE_AT}, "relation/90": LAKE_AT}
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {"way/70", "relation/90"}
    write_collections(to_collections(from_objects(spark, [{"elements": KITE}]), FULL), str(tmp_path / "collections"))
    assert [json.loads(r[0])["features"][0]["id"] for r in spark.read.text(str(tmp_path / "collections")).collect()] == ["way/70"]
    release(features)


XML = {
    "single quotes": ("<osm><node id='31' lat='62.5' lon='-7.75'/></osm>", [("node/31", {"id": "node/31"}, [-7.75, 62.5])]),
    "empty attribute": ('<osm><node id="1" lat="1" lon="2"><tag k="note" v=""/></node></osm>', [("node/1", {"id": "node/1"}, [2, 1])]),
    "entity stays": ('<osm><node id="1" lat="1" lon="2"><tag k="n" v="A &#38; B"/></node></osm>', [("node/1", {"id": "node/1", "n": "A &#38; B"}, [2, 1])]),
    "empty body swallows": ('<osm><node id="1" lat="1" lon="2"></node><node id="3" lat="1" lon="2"></node></osm>', [("node/1", {"id": "node/1"}, [2, 1])]),
    "foreign root": ('<osmChange><create><node id="1" lat="1" lon="2"/></create></osmChange>', []),
    "unclosed root": ('<osm><node id="1" lat="1" lon="2"/>', []),
    "byte order mark": ('﻿<?xml version="1.0"?>\n<osm><node id="1" lat="1" lon="2" version="1"/></osm>', [("node/1", {"id": "node/1", "version": "1"}, [2, 1])]),
    "not a document": ("hello", []),
    "JSON without elements": ('{"a":1}', []),
    "text keys": ('<osm><relation id="1"><member type="way" ref="1" role=""><nd lon="0" lat="0"/><nd lon="1.0" lat="0"/></member><member type="way" ref="2" role=""><nd lon="1.00" lat="0"/><nd lon="2" lat="0"/></member></relation></osm>', [("relation/1", {"id": "relation/1"}, [[[0, 0], [1, 0]], [[1, 0], [2, 0]]])]),
    "inline node": ('<osm><relation id="1"><member type="node" ref="7" role="label" lat="1" lon="2"/></relation></osm>', [("node/7", {"id": "node/7", "ref": "7", "role": "label", "tags": {}}, [2, 1])]),
}


@pytest.fixture(scope="module")
def made_xml(spark):
    names = list(XML)
    rows = to_collections(from_objects(spark, [XML[n][0] for n in names]), FULL).collect()
    return {names[int(r["doc_id"])]: json.loads(compact(r["geojson"])) for r in rows}


@pytest.mark.parametrize("name", XML)
def test_xml(made_xml, name):
    assert [(f["id"], f["properties"], f["geometry"]["coordinates"]) for f in made_xml[name]["features"]] == XML[name][1]


def test_malformed_json(spark):
    rows = {r["doc_id"]: r for r in to_collections(from_objects(spark, ["{bad", '{"elements":[]}']), FULL).collect()}
    assert [r["error"] for _, r in sorted(rows.items())] == ["malformed JSON", None]
    with pytest.raises(ValueError, match="malformed JSON"):
        convert(spark, "{bad", FULL)


def test_command_line(tmp_path, spark):
    from mapweave.cli import main

    (tmp_path / "in.osm").write_text('<osm><node id="1" lat="1" lon="2"/></osm>', encoding="utf-8")
    assert main([str(tmp_path / "in.osm"), str(tmp_path / "out.json")]) == 0
    assert (tmp_path / "out.json").read_text() == '{"type":"FeatureCollection","features":[{"type":"Feature","id":"node/1","properties":{"id":"node/1"},"geometry":{"type":"Point","coordinates":[2,1]}}]}\n'
    assert main([str(tmp_path / "absent"), str(tmp_path / "out.json")]) == 1


def test_arriving_files(tmp_path, spark):
    from mapweave.streaming.files import convert_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.osm").write_text('<osm><node id="1" lat="1" lon="2"/></osm>', encoding="utf-8")
    convert_arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), FULL).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and '"node/1"' in rows[0]["geojson"]
