"""JSON text as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, 2, F.length(whole) - 2)


def json_object(values: Column) -> Column:
    """A JSON object from a map of JSON texts; null texts drop out."""
    entries = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull())
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def without_keys(values: Column, keys: Column) -> Column:
    """A map less some keys; a null map is empty."""
    return F.map_filter(F.coalesce(values, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(keys, k))


def merged(props: Column, over: Column) -> Column:
    """Both maps; where keys meet, the second's values stand."""
    return F.map_concat(without_keys(props, F.map_keys(over)), over)
