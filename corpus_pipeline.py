"""A training corpus from ``documents``: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes an empty table and gives none or no rows; null texts and texts without
letters go in the first. Rows with equal ids are documents of their own but for near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm.common import stored
from placebook.llm.langid import held_out, identify, train
from placebook.llm.linededup import line_dedup
from placebook.llm.minhash import near_duplicates
from placebook.llm.mixing import curriculum_mix, in_training_order
from placebook.llm.packing import pack_in_order


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model knows; null texts and texts without letters go, too."""
    found = identify(docs, train(docs, ~held_out()))
    return found.filter(~F.col("rejected")).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of 50 words or more; documents of which nothing is left go.

    ``n_chars`` is that of the new text.
    """
    cut = line_dedup(docs).filter((F.col("removed_lines") == 0) | (F.trim("text") != ""))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8); those without an id all stay."""
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").unionByName(docs.filter("doc_id is null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, range-sorted by training position.

    Besides the columns of documents each row has its ``position`` in 0..1 and the number
    of the ``copy``, from 0, which packing goes by.
    """
    return in_training_order(curriculum_mix(docs)).select(*docs.columns, "position", "copy")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their token ids and places in sequences of 2048 tokens, which follow the training order."""
    return pack_in_order(docs, "position", ("copy",))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has no language models, tokenizers or packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage leaves is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
