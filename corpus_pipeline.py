"""Corpus pipeline: documents to packed training sequences.

Each stage takes all documents that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again for the next one. Null columns, empty texts, repeated rows and empty tables are handled as
the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm import langid, ngram, pack, pii, rules
from tramline.llm.common import table
from tramline.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules with proven cutoffs."""
    stats = rules.statistics(docs.withColumn("_body", F.col("text")))
    path = scratch_path(spark, "rules")
    stats.write.parquet(path)
    kept = rules.judge(spark.read.schema(stats.schema).parquet(path), table(spark, sf_dir, "labels")).filter("kept")
    return kept.withColumnRenamed("_body", "text").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Documents whose language is recognised with a score of ``least`` or more."""
    model = langid.fit(docs)
    found = langid.predict(docs.withColumn("_body", F.col("text")), model)
    return found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= least)).withColumnRenamed("_body", "text").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with Jaccard 0.8 or more, the one of smallest id.

    Equal rows that repeat an id become one; rows without an id stay.
    """
    first = ngram.join(docs, k=5, num=4, den=5).filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.join(first, "doc_id", "left_semi").withColumn("_h", F.xxhash64("text", "lang", "source"))
    same = Window.partitionBy("doc_id").orderBy("_h")
    once = known.withColumn("_again", F.lag("_h").over(same) == F.col("_h")).filter("_again is null or not _again")
    return once.select(docs.columns).union(docs.filter("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by labels; n_chars follows the new text."""
    return pii.masked(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack.pack(docs, pack.loader(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: shingle components, learned models and token ids have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
