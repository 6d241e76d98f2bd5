"""A corpus in five stages: quality rules, near-dedup, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in
the columns of ``documents``; the last returns packed pieces. A stage's result
is written and read again before the next one starts.

Defined results: a null or empty text has too few words and goes with the
quality rules; texts of any length are taken whole; of rows with equal id and
words one stays; rows with a null doc_id are judged by their text alone, and
of near copies among them one stays; ties go to the smallest doc_id; an empty
table passes all stages and gives an empty result; columns beyond ``COLUMNS``
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontaminate, near_dedup, packing, pii, quality_rules
from mapweave.llm.common import stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned rules keep."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_rules.judge(docs, labels, keep=COLUMNS).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates; of rows that repeat it and its words, one."""
    return near_dedup.without_duplicates(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the words that are hit go."""
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_contamination(docs, benchmark, keep=COLUMNS, cut=True).where(~decontaminate.contaminated())
    return found.select(*COLUMNS[:4], _n_chars(F.size("spans") > 0))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in angle brackets."""
    found = pii.find_pii(docs, keep=COLUMNS)
    return found.select("doc_id", pii.redact("text", "spans").alias("text"), "lang", "source", "n_chars", "spans").select(*COLUMNS[:4], _n_chars(F.size("spans") > 0))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


def _n_chars(changed):
    return F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: No stage but the benchmark's windows is expressible in SQL: rules are learned, links need hashing, ids a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
