"""Conversion of files as they arrive."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mapweave.api import release, to_collections
from mapweave.options import Options


def read_arriving(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("doc_id"), F.col("value").alias("payload"))


def convert_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, options: Options | Mapping | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch of documents becomes rows (doc_id, geojson, error) under ``out``; documents are independent, so no state is kept.

    A batch that is run again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = to_collections(batch, options)
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")
        release(made)

    return read_arriving(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
