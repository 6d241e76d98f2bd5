"""Which reader a document needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that JavaScript trims.
LEADING_BLANK = r"^[\s\x0B   -     　﻿]+"


def detect_format(payload: Column) -> Column:
    """xml, json or invalid; a text with ``<osm`` anywhere is XML."""
    return F.when(payload.contains("<osm"), F.lit("xml")).when(F.regexp_replace(payload, LEADING_BLANK, "").startswith("{"), F.lit("json")).otherwise(F.lit("invalid"))
