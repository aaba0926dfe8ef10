"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns, but for
the last one, the columns of ``documents``. ``run`` writes every stage's result
to the shared folder and reads it again for the next.

Nulls: a null text counts as empty, is no copy of anything but other empty
texts, and is packed as its closing token. Rows without id go through every
stage like others: they are scored, compared by their texts, judged and packed.
Rows that repeat an id are judged by their texts where texts decide (toxicity,
exact copies) and together where documents do. Ties go to the smallest id. Very
long texts are used whole and cut into pieces in packing only. A table without
rows gives no sequences. Further columns of any name reach the last stage as
they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canvass.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from canvass.llm.common import stored, table


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity network rejects."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each class of near-duplicates."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_language),
    ("exact_dedup", without_copies),
    ("minhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]
#: The network and the signatures have no SQL form; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
