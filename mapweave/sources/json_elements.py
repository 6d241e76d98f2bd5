"""Elements of JSON documents, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.geometry import parse_float
from mapweave.functions.text import without_keys
from mapweave.schema import MEMBER, POINT, PROPS, TAG, VERTEX

_PLACE = "struct<lat:string,lon:string>"
_TYPED = (
    "type string, id string, lat string, lon string, tags string, nodes array<string>,"
    f" geometry array<{_PLACE}>, bounds struct<minlat:string,minlon:string,maxlat:string,maxlon:string>, members array<string>"
)
_TYPED_MEMBER = f"type string, ref string, role string, lat string, lon string, tags string, nodes array<string>, geometry array<{_PLACE}>"


def _object(text: Column) -> Column:
    """A JSON object as a map of JSON texts."""
    values = F.try_parse_json(text).try_cast("map<string,variant>")
    return F.coalesce(F.transform_values(values, lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))), F.create_map().cast(PROPS))


def point(lon: Column, lat: Column) -> Column:
    """Numbers are the same when their values are: the key is the double's own text."""
    x, y = parse_float(lon), parse_float(lat)
    key = F.concat_ws(",", F.coalesce((x + 0.0).cast("string"), lon, F.lit("")), F.coalesce((y + 0.0).cast("string"), lat, F.lit("")))
    return F.struct(x.alias("x"), y.alias("y"), key.alias("key")).cast(POINT)


def _refs(ids: Column) -> Column:
    return F.transform(ids, lambda r: F.struct(r.alias("ref"), F.lit(None).cast(POINT).alias("at"))).cast(f"array<{VERTEX}>")


def _places(geometry: Column) -> Column:
    return F.transform(geometry, lambda g: F.struct(F.lit(None).cast("string").alias("ref"), F.when(g.isNotNull(), point(g["lon"], g["lat"])).alias("at"))).cast(f"array<{VERTEX}>")


def _tags(text: Column) -> Column:
    """Tags in text order; integer-like keys come first, as in JavaScript objects."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    whole = F.filter(entries, lambda e: e["key"].rlike("^(?:0|[1-9][0-9]{0,9})$"))
    other = F.filter(entries, lambda e: ~e["key"].rlike("^(?:0|[1-9][0-9]{0,9})$"))
    ordered = F.concat(F.sort_array(F.transform(whole, lambda e: F.struct(e["key"].cast("long").alias("n"), e["key"].alias("k"), e["value"].alias("v")))), F.transform(other, lambda e: F.struct(F.lit(0).cast("long").alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.transform(ordered, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))).cast(f"array<{TAG}>")


def _nonzero(text: Column) -> Column:
    """Truthy as a JavaScript number or text: absent, empty and zero are not."""
    return F.coalesce(text != "", F.lit(False)) & ~F.coalesce(text.try_cast("double") == 0, F.lit(False))


def _member(raw: Column) -> Column:
    m = F.from_json(raw, _TYPED_MEMBER)

    def build(m: Column) -> Column:
        node_here = (m["type"] == "node") & _nonzero(m["lat"]) & _nonzero(m["lon"])
        way_here = (m["type"] == "way") & (m["geometry"].isNotNull() | m["nodes"].isNotNull())
        own = without_keys(_object(raw), F.array(F.lit("id"), F.lit("type"), F.lit("lat"), F.lit("lon")))
        tags = F.when(m["tags"].isNotNull(), _object(m["tags"])).otherwise(F.create_map().cast(PROPS))
        return F.struct(
            m["type"].alias("type"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role"), (node_here | way_here).alias("inline"),
            (node_here & m["tags"].isNotNull()).alias("tagged"),
            F.when(node_here, F.map_concat(without_keys(own, F.map_keys(tags)), tags)).otherwise(F.create_map().cast(PROPS)).alias("props"),
            F.when(node_here, point(m["lon"], m["lat"])).alias("at"),
            F.when(m["geometry"].isNotNull(), _places(m["geometry"])).otherwise(_refs(m["nodes"])).alias("vertices"),
        ).cast(MEMBER)

    return F.element_at(F.transform(F.array(m), build), 1)


def read_elements(documents: DataFrame) -> DataFrame:
    """(doc_id, payload) of JSON documents -> doc_id and the columns of ELEMENT."""
    raw = documents.select("doc_id", F.posexplode(F.from_json("payload", "elements array<string>")["elements"]).alias("pos", "raw"))
    rows = raw.select("doc_id", F.col("pos").cast("long").alias("pos"), "raw", F.from_json("raw", _TYPED).alias("e")).where(F.col("e.type").isin("node", "way", "relation"))
    deny = F.when(F.col("e.type") == "node", F.array(*map(F.lit, ("id", "type", "tags", "lat", "lon")))).when(F.col("e.type") == "way", F.array(*map(F.lit, ("id", "type", "tags", "nodes", "geometry")))).otherwise(F.array(*map(F.lit, ("id", "type", "tags", "bounds", "members"))))
    tags = F.when(F.col("e.tags").isNotNull(), _object(F.col("e.tags"))).otherwise(F.create_map().cast(PROPS))
    rows = rows.select("doc_id", "pos", "e", "raw", without_keys(_object(F.col("raw")), deny).alias("own"), tags.alias("over"))
    b = F.col("e.bounds")
    return rows.select(
        "doc_id", "pos", F.col("e.type").alias("type"), F.col("e.id").alias("id"), F.col("e.tags").isNotNull().alias("tagged"), _tags(F.col("e.tags")).alias("tags"),
        F.map_concat(without_keys(F.col("own"), F.map_keys("over")), F.col("over")).alias("props"),
        F.when(F.col("e.type") == "node", point(F.col("e.lon"), F.col("e.lat"))).alias("at"),
        F.when(F.col("e.type") == "way", F.when(F.col("e.geometry").isNotNull(), _places(F.col("e.geometry"))).otherwise(_refs(F.col("e.nodes")))).alias("vertices"),
        F.when((F.col("e.type") == "relation") & b.isNotNull(), F.array(*(parse_float(b[k]) for k in ("minlon", "minlat", "maxlon", "maxlat")))).alias("bounds"),
        F.when(F.col("e.type") == "relation", F.transform("e.members", _member)).alias("members"),
    )


def readable(payload: Column) -> Column:
    """Whether a JSON document can be parsed at all."""
    return F.try_parse_json(payload).isNotNull()
