"""Documents converted whole against their elements dealt one by one."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mapweave.api import to_collections, to_features
from mapweave.functions.planar import double
from mapweave.functions.rules import area_of, is_area
from mapweave.operators import whole
from mapweave.options import Options
from mapweave.plans import twins
from mapweave.sources.documents import from_objects

FULL = {"completeFeature": True}
SHOWN = {**FULL, "renderTagged": True, "excludeWay": False}


def some_json(seed: int) -> str:
    """A document of few ids, so that elements repeat, refer to each other and to what isn't there."""
    r = random.Random(seed)
    value = lambda: r.choice([0, 1, 2, 1.0, 2.5, -3, "1", "2.50", "x", "", None, 1e8, 1e-5, True])
    place = lambda: {"lon": r.choice([0, 1, 2, 3, 4.5, "1"]), "lat": r.choice([0, 1, 2, 3])} if r.random() < 0.95 else r.choice([None, {}, {"lon": "x", "lat": 1}])
    tags = lambda: {k: r.choice(["yes", "cliff", "services", "a\"b", "é\u0001\u001f", "A \\u001f"]) for k in r.sample(["building", "highway", "natural", "name", "12", "3", "id", "version"], r.randrange(4))}

    def line() -> dict:
        n = r.randrange(6)
        if r.random() < 0.5:
            ring = [place() for _ in range(n)]
            return {"geometry": ring + ring[:1] * r.randrange(2)}
        ring = [r.randrange(5) for _ in range(n)]
        return {"nodes": ring + ring[:1] * r.randrange(2)} if r.random() < 0.9 else {}

    def member() -> dict:
        kind = r.choice(["node", "way", "way", "relation", "area"])
        out = {"type": kind, "ref": r.randrange(5) if kind != "relation" else r.randrange(3, 6)}
        if r.random() < 0.7:
            out["role"] = r.choice(["outer", "inner", "", "x"])
        if kind == "way":
            out |= line() if r.random() < 0.6 else {}
        elif kind == "node" and r.random() < 0.6:
            out |= {**(place() or {}), "user": value()} if r.random() < 0.9 else {"lat": value(), "lon": value()}
            out |= {"tags": tags()} if r.random() < 0.5 else {}
        if r.random() < 0.05:
            del out["ref"]
        return out

    elements = []
    for _ in range(r.randrange(9)):
        kind = r.choice(["node", "node", "way", "way", "relation", "note"])
        one = {"type": kind, "id": r.randrange(6) if r.random() < 0.97 else None}
        if r.random() < 0.5:
            one["tags"] = tags()
        if r.random() < 0.3:
            one |= {"version": value(), "z": {"b": value(), "a": [value(), 1.50]}}
        if kind == "node":
            one |= place() or {}
        elif kind == "way":
            one |= line()
        elif kind == "relation":
            one["members"] = [member() for _ in range(r.randrange(5))]
            one |= {"bounds": {"minlat": 1, "minlon": 2.5, "maxlat": "3"}} if r.random() < 0.3 else {}
        elements.append(one)
    return json.dumps({"elements": elements}, ensure_ascii=r.random() < 0.5)


ODD = [
    '{"elements":[{"type":"node","id":1,"lon":1,"lat":2,"a":-0,"b":-0.0,"c":1.500,"d":1e3,"e":123456789012345678901234567890,"f":1E-7,"g":100.0,"h":12345678901234567890123456789012345678901.5}]}',
    '{"elements":[{"type":"node","id":1.50,"lon":1e0,"lat":"2 m","\\u00e9":1,"B":2,"a":"/\\u007f\\u000b\\b","\\ud83d\\ude00":"\\ud83d\\ude00"}]}',
    '{"elements":[5,null,"x",[],{"type":5},{"id":3},{"type":"node"},{"type":"way","nodes":[]},{"type":"relation"},{"type":"relation","id":1,"members":[null,3,{"type":"way"}]}]}',
    '{"elements":{"type":"node"}}', '{"elements":null}', "{}", "{bad", '{"elements":[}', '{"elements":[]', "﻿ {\"elements\":[]}", '{"a":1,"a":2,"elements":[]}', "[]", "", "x",
    '{"elements":[{"type":"relation","id":1,"members":[{"type":"relation","ref":2}]},{"type":"relation","id":2,"members":[{"type":"relation","ref":1},{"type":"way","ref":3,"geometry":[{"lon":1,"lat":1},{"lon":2,"lat":1}]}]},{"type":"node","id":4,"lon":1,"lat":1}]}',
    '<osm><node id="1" lat="1" lon="2"/><way id="3"><nd ref="1"/><nd lat="1" lon="x"/><nd ref="9"/><tag k="a" v="&amp;"/></way><relation id="4"><bounds minlat="1"/><member type="way" ref="3" role="outer"/><member type="node" ref="1" role="r"/><member type="node" ref="8" role="q" lat="3" lon="4"><nd ref="1"/></member></relation></osm>',
]


@pytest.mark.parametrize("options", [FULL, {}, SHOWN, {**SHOWN, "strictGeometry": True}], ids=["full", "bare", "shown", "strict"])
def test_same_as_by_elements(spark, options):
    texts = [*ODD, *map(some_json, range(300))]
    docs = from_objects(spark, texts)
    got = {r["doc_id"]: (r["geojson"], r["error"]) for r in to_collections(docs, options).collect()}
    want = {r["doc_id"]: (r["geojson"], r["error"]) for r in to_collections(docs, {**options, "byDocument": False}).collect()}
    differ = {texts[int(k)]: (got[k], want[k]) for k in want if got[k] != want[k] and "contains itself" not in (want[k][1] or "")}
    assert len(got) == len(texts) and not differ
    assert all("contains itself" in got[k][1] for k in want if "contains itself" in (want[k][1] or ""))


def test_features_same_as_by_elements(spark):
    docs = from_objects(spark, [*ODD, *map(some_json, range(300, 500))])
    got, want = (to_features(docs, {**SHOWN, "byDocument": b}) for b in (True, False))
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("x", [0.0, -0.0, 1.0, 9999999.5, 1e7, 1.25e7, 0.001, 0.00025, -1.5e-9, 1e22, 1.7976931348623157e308, 4.9e-324, float("inf")])
def test_double_as_spark_writes_it(spark, x):
    assert double(x) == spark.createDataFrame([([x],)], "x array<double>").select(F.to_json("x")).first()[0][1:-1]


@pytest.mark.parametrize("tags", [[], [("area", None)], [("highway", None)], [("natural", None)], [("natural", "wood"), ("name", "x")], [("building", "yes"), ("man_made", "pipeline")], [("waterway", "dam")]])
def test_area_of(spark, tags):
    assert area_of(tags) is spark.createDataFrame([(tags,)], "t array<struct<k:string,v:string>>").select(is_area(F.col("t"))).first()[0]


def exchanges(rows) -> int:
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


#: Queries on documents, and the exchanges that making their documents takes.
WHOLE = {"bare_geometry": 1, "super_relations": 1, "convert_xml": 1, "xml_relations": 1, "inline_members": 1, "convert_relations": 1, "polygons_with_holes": 0, "tagged_features": 1, "first_geometry": 1, "convert_documents": 1}


@pytest.mark.parametrize("name", WHOLE)
def test_documents_are_converted_where_they_are(spark, name):
    assert exchanges(twins.QUERIES[name](spark, "/root/testdata/sf0.001")) == WHOLE[name]


def test_no_geometry_is_made_behind_the_first(monkeypatch):
    """The first relation has none, of the others one is enough; a document may have many thousand."""
    made, stitch = [], whole.stitch
    monkeypatch.setattr(whole, "stitch", lambda ways: made.append(len(ways)) or stitch(ways))
    line = {"type": "way", "ref": 1, "role": "", "geometry": [{"lon": 1, "lat": 2}, {"lon": 3, "lat": 4}]}
    text = json.dumps({"elements": [{"type": "relation", "id": i, "members": [line] * (i > 0)} for i in range(9)]})
    assert whole.collection(text, "json", Options()) == ('{"type":"MultiLineString","coordinates":[[[1.0,2.0],[3.0,4.0]]]}', None)
    assert made == [0, 1]


def test_first_geometry_deals_numbers(spark):
    """Events are dealt to all tasks, few bytes or many, and become text behind the exchange."""
    plan = twins.QUERIES["first_geometry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchange, below = plan[plan.index("Exchange hashpartitioning") :].split("\n", 1)
    assert "(user_id" in exchange and "REPARTITION_BY_NUM" in exchange
    assert "ToJson" not in below and "collect_list" not in below


def test_first_geometry_of_odd_rows(spark, tmp_path):
    """Unknown users and values, ids that repeat or are negative, users with no line, one user with many events."""
    rows = [(3, None, 60.0), (2, None, 70.0), (5, 1, 60.0), (5, 1, 10.0), (6, 1, 90.0), (7, 2, None), (8, 2, 50.0), (-205, 3, float("nan")), (1, 4, None), *((i, 9, 50.0 + i // 2900) for i in range(3000, 0, -1))]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = twins.QUERIES["first_geometry"](spark, str(tmp_path)).collect()
    want = duckdb.execute(twins.ORACLE_SQL["first_geometry"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 6
