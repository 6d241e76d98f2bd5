"""Documents: one row each, from files, texts or parsed objects."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.schema import DOCUMENT
from mapweave.sources import json_elements, xml_elements
from mapweave.sources.detect import detect_format

MALFORMED = "malformed JSON"


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as (doc_id, payload); doc_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("payload"))


def from_objects(spark: SparkSession, objects: Iterable[str | Mapping]) -> DataFrame:
    """Texts, or parsed JSON objects with ``elements``; neither is changed. doc_id counts from 0."""
    rows = [(f"{i:012d}", x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for i, x in enumerate(objects)]
    return spark.createDataFrame(rows, DOCUMENT)


def with_format(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "payload", detect_format(F.coalesce("payload", F.lit(""))).alias("format"))


def error(format_: Column, payload: Column) -> Column:
    """Why a document can't be read, or null."""
    return F.when((format_ == "json") & ~json_elements.readable(payload), F.lit(MALFORMED))


def to_elements(documents: DataFrame) -> DataFrame:
    """The elements of all documents; invalid and malformed documents have none."""
    rows = with_format(documents)
    json_rows = json_elements.read_elements(rows.where("format = 'json'"))
    return json_rows.unionByName(xml_elements.read_elements(rows.where("format = 'xml'")))
