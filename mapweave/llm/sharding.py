"""Sharding by weighted rendezvous hashing of stable record keys.

Each (key, shard) pair has its own hash; a key belongs to the shard of the
largest weight / -ln(hash). A key's choice among the old shards never
changes when one is added, so rows move only into the new one.

The law is ``key``: key and shards alone decide. Rows with one key go to one
shard; equal texts under different keys may part. A null key hashes as a null
key. A null text has no bytes. Repeated rows are rows of their own. Slots
count rows of a shard from 0; inside a shard they follow a hash bucket and
then the key.

Slots are numbered per (shard, bucket) and shifted by the count of earlier
buckets, so no task holds a whole shard; the number of buckets follows the
row count and the table of offsets is one row per (shard, bucket). Rows that
are repeated very often are dealt over buckets of their own: which of several
equal rows gets which slot makes no difference, so the result doesn't depend
on how the input is split.

Defined results: an empty table gives an empty result; a text of any length
counts whole; rows that tie (equal keys) follow the hash of their text; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import computed, stage

ROWS_PER_BUCKET = 50_000
#: Offsets are broadcast below this many rows.
MOST_OFFSETS = 100_000


def score(key: Column, shard: Column, weight: Column) -> Column:
    """weight / -ln(hash); the hash has 53 bits in (0, 1)."""
    unit = (F.shiftrightunsigned(F.xxhash64(key.cast("string"), shard), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return weight / -F.ln(unit)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct<score, shard> of a key's shard, by one expression over an array of weights: any number of shards makes the same plan."""
    held = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_max(F.transform(held, lambda w, i: F.struct(score(key, i, w).alias("score"), i.alias("shard"))))


def assign_shards(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    weights = list(weights or [1.0] * n_shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("_hash"))
    rows = computed(
        rows, ("doc_id", "_hash"),
        size=(F.octet_length("_text") + F.lit(8)).cast("long"),
        text_crc32=F.crc32(F.encode("_text", "UTF-8")),
        best=rendezvous(F.col("doc_id"), weights),
        new=score(F.col("doc_id"), F.lit(len(weights)), F.lit(float(new_weight))),
    )
    # a new shard takes the keys that it scores higher than all others; nothing else moves
    grown = F.when(F.col("new") > F.col("best.score"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    rows = stage(rows.select("doc_id", "size", "text_crc32", "_hash", F.col("best.shard").alias("shard"), grown.alias("grown_shard"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt")), "sharded")
    buckets = max(16, -(-rows.count() // (len(weights) * ROWS_PER_BUCKET)))
    often = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_BUCKET)
    often = F.broadcast(often.select("_hash", F.col("_hash").alias("often"), F.ceil(F.col("n") / ROWS_PER_BUCKET).alias("parts")))
    part = F.when(F.col("often").isNotNull(), F.pmod("_salt", "parts")).otherwise(F.lit(0))
    rows = rows.join(often, "_hash", "left").withColumn("bucket", F.struct(F.pmod("_hash", F.lit(buckets)).alias("at"), "often", part.alias("part")))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "_hash", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    same = (numbered["shard"] == offsets["shard"]) & numbered["bucket"].eqNullSafe(offsets["bucket"])
    return numbered.join(F.broadcast(offsets) if buckets * len(weights) < MOST_OFFSETS else offsets, same).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), numbered["shard"], (F.col("offset") + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )
