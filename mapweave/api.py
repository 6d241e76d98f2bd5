"""The engine's entry points."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators import features as features_
from mapweave.operators import whole
from mapweave.operators.features import release
from mapweave.options import Options
from mapweave.sources.documents import error, from_objects, read_documents, to_elements, with_format
from mapweave.sources.sinks import compact

__all__ = ["convert", "read_documents", "release", "to_collections", "to_elements", "to_features"]


def to_features(documents: DataFrame, options: Options | Mapping | None = None) -> DataFrame:
    """(doc_id, payload) -> one row per feature; ``release`` gives back what they hold in memory."""
    o = Options.of(options)
    if o.by_document:
        return whole.features_and_errors(documents, o).where("error is null").select(*features_.FEATURE)
    return features_.to_features(to_elements(documents), o)


def to_collections(documents: DataFrame, options: Options | Mapping | None = None) -> DataFrame:
    """(doc_id, payload) -> doc_id, geojson, error; a document that can't be converted has an error and no features, and stops no other."""
    o = Options.of(options)
    if o.by_document:
        return whole.to_collections(documents, o)
    features = features_.features_and_errors(to_elements(documents), o)
    made = features_.to_collections(documents, features, o).withColumnRenamed("error", "found")
    wrong = with_format(documents).select("doc_id", error(F.col("format"), F.col("payload")).alias("error"))
    out = made.join(wrong, "doc_id").select("doc_id", "geojson", F.coalesce("error", "found").alias("error"))
    out._mapweave_held = features._mapweave_held
    return out


def convert(spark: SparkSession, document: str | Mapping, options: Options | Mapping | None = None) -> dict:
    """One text or parsed object -> a FeatureCollection or a bare geometry. Malformed JSON and cyclic relations raise ValueError."""
    made = to_collections(from_objects(spark, [document]), options)
    row = made.first()
    release(made)
    if row["error"]:
        raise ValueError(row["error"])
    return json.loads(compact(row["geojson"]))
