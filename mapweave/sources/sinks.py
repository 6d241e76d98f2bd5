"""Where features go: a text per document, or one line per feature."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.operators.features import feature_json


def compact(geojson: str) -> str:
    """GeoJSON with whole numbers written as such, as JavaScript does."""
    return json.dumps(_whole(json.loads(geojson)), ensure_ascii=False, separators=(",", ":"))


def _whole(x):
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e21:
        return int(x)
    if isinstance(x, list):
        return [_whole(y) for y in x]
    return {k: _whole(v) for k, v in x.items()} if isinstance(x, dict) else x


def write_collections(collections: DataFrame, path: str) -> None:
    """One line per document."""
    collections.select(F.col("geojson").alias("value")).write.text(path)


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Line-delimited features, in parallel; the order within a document isn't kept."""
    features.select(feature_json().alias("value")).write.text(path)


def write_feature_table(features: DataFrame, path: str) -> None:
    features.drop("of_relation").write.parquet(path)
