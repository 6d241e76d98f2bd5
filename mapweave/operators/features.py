"""From elements to features, and from features to one GeoJSON text per document."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import geometry as G
from mapweave.functions.rules import is_area
from mapweave.functions.text import json_object, json_string, merged
from mapweave.operators import registry as R
from mapweave.operators.relations import expand, geometry_json, relation_nodes, relation_shapes
from mapweave.options import Options

#: Inside a relation's place: its area or lines, then its node members.
OWN, MEMBERS = 1, 2


def properties(kind: Column, id_: Column, props: Column) -> Column:
    own = F.create_map(F.lit("id"), json_string(F.concat_ws("/", kind, id_)))
    return json_object(merged(own, F.coalesce(props, F.create_map().cast("map<string,string>"))))


def place(ord_: Column, rank: int, member: Column | None = None) -> Column:
    return F.struct(ord_.getField("pos").alias("pos"), ord_.getField("member").alias("member"), F.lit(rank).alias("rank"), (F.lit(0) if member is None else member).alias("i"))


def point_json(at: Column) -> Column:
    """A node always has a place in its feature; what is no number becomes null."""
    return geometry_json("Point", F.array(at["x"], at["y"]))


def way_json(points: Column, tags: Column) -> Column:
    ring = G.points(points)
    area = is_area(tags) & G.is_ring(ring)
    return F.when(area, geometry_json("Polygon", F.array(G.oriented(ring, False)))).otherwise(geometry_json("LineString", ring))


def _relation_features(kept: DataFrame, won: DataFrame, bound: DataFrame, tree: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<double>")
    shapes = relation_shapes(tree, won, bound)
    relations = kept.where("type = 'relation'").join(shapes, ["doc_id", "id"]).select("doc_id", place(F.col("ord"), OWN).alias("ord"), "type", "id", F.col("bounds").alias("bbox"), "props", "geometry")
    points = relation_nodes(kept, won)
    points = points.select("doc_id", place(F.col("ord"), MEMBERS, F.col("i")).alias("ord"), F.lit("node").alias("type"), "id", none.alias("bbox"), "props", point_json(F.col("at")).alias("geometry"))
    return relations.unionByName(points)


FEATURE = ("doc_id", "ord", "type", "id", "bbox", "properties", "geometry", "of_relation")


def features_and_errors(elements: DataFrame, options: Options | dict | None = None) -> DataFrame:
    """The columns of FEATURE, one row per feature, and ``error``: a document that can't be converted has a row with nothing else.

    All keys hold doc_id, so with ``by_document`` one exchange serves every
    join and aggregate that follows; without it each deals its own key, as
    documents need that are too large for a task. Skipped elements fall away
    before any geometry is built for them. No job runs while this is planned.
    """
    o = Options.of(options)
    if o.by_document:
        elements = elements.repartition(int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    # read several times; what a lost executor held is computed again
    elements = elements.persist(StorageLevel.MEMORY_AND_DISK)
    every = R.instances(elements)
    won = R.registry(every).persist(StorageLevel.MEMORY_AND_DISK)
    kept = R.with_references(won, R.references(every)).where(R.is_kept(o))
    bound = R.bind_ways(every, won).persist(StorageLevel.MEMORY_AND_DISK)
    none = F.lit(None).cast("array<double>")
    nodes = kept.where("type = 'node'").select("doc_id", place(F.col("ord"), OWN).alias("ord"), "type", "id", none.alias("bbox"), "props", point_json(F.col("at")).alias("geometry"))
    ways = kept.where("type = 'way'").join(bound, ["doc_id", "reg"]).where(F.size("points") > 1)
    ways = ways.select("doc_id", place(F.col("ord"), OWN).alias("ord"), "type", "id", none.alias("bbox"), "props", way_json(F.col("points"), F.col("tags")).alias("geometry"))
    out = nodes.unionByName(ways).withColumn("of_relation", F.lit(False))
    tree = expand(kept, won)
    out = out.unionByName(_relation_features(kept, won, bound, tree).withColumn("of_relation", F.lit(True)))
    out = out.select("doc_id", "ord", "type", F.concat_ws("/", "type", "id").alias("id"), "bbox", properties(F.col("type"), F.col("id"), F.col("props")).alias("properties"), "geometry", "of_relation")
    errors = tree.where("error is not null").select("doc_id", "error")
    if o.strict:
        clipped = every.where(F.exists("vertices", lambda v: v["ref"].isNull() & v["at"].isNull()))
        errors = errors.unionByName(clipped.select("doc_id", F.concat(F.lit("a null vertex in way "), "id").alias("error")))
    made = out.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
    made._mapweave_held = (elements, won, bound)
    return made


def release(rows: DataFrame) -> None:
    """Give back what features (or what was made of them) hold in memory, once they have been used."""
    for held in getattr(rows, "_mapweave_held", ()):
        held.unpersist()


def to_features(elements: DataFrame, options: Options | dict | None = None) -> DataFrame:
    """doc_id, ord, type, id (type/id), bbox, properties and geometry (JSON texts), one row per feature.

    Relations of a document in which one contains itself have no features.
    """
    made = features_and_errors(elements, options)
    out = made.where("error is null").select(*FEATURE)
    out._mapweave_held = made._mapweave_held
    return out


def feature_json() -> Column:
    box = F.when(F.col("bbox").isNotNull(), F.concat(F.lit(',"bbox":'), F.to_json("bbox"))).otherwise(F.lit(""))
    return F.concat(F.lit('{"type":"Feature","id":'), json_string(F.col("id")), box, F.lit(',"properties":'), F.col("properties"), F.lit(',"geometry":'), F.col("geometry"), F.lit("}"))


def to_collections(documents: DataFrame, features: DataFrame, options: Options | dict | None = None) -> DataFrame:
    """(doc_id, geojson, error): a FeatureCollection per document, also where there are no features or an error.

    Unless the options ask for all features, the first feature of the first
    kept relation that has one stands alone, as a bare geometry.
    """
    o = Options.of(options)
    error = F.col("error") if "error" in features.columns else F.lit(None).cast("string")
    rows = features.select("doc_id", F.when(error.isNull(), F.struct("ord", feature_json().alias("json"))).alias("f"), F.when(F.col("of_relation"), F.struct("ord", "geometry")).alias("bare"), error.alias("error"))
    grouped = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("f")).alias("f"), F.min("bare").alias("bare"), F.min("error").alias("error"))
    body = F.coalesce(F.when(F.col("error").isNull(), F.array_join(F.transform("f", lambda f: f["json"]), ",")), F.lit(""))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}"))
    text = whole if o.complete else F.coalesce(F.when(F.col("error").isNull(), F.col("bare.geometry")), whole)
    return documents.select("doc_id").join(grouped, "doc_id", "left").select("doc_id", text.alias("geojson"), "error")
