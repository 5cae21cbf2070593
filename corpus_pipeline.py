"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``docs``; where a stage changes texts, ``n_chars`` follows.

1. language_id: documents without a recognisable language go; a missing ``lang`` is filled in.
2. quality_rules: documents that fail the base rules or are depleted go; lines above the limit are removed.
3. near_dedup: one document of each group of near copies stays, the one with the least id.
4. pii: personal data gets surrogates.
5. packing: the tokens of all documents in sequences of at most 2,048.

Empty input passes through as empty output. What each stage does with nulls, ties and repeated rows is said with its
operator.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm import bestfit_pack, lang_rank, line_quality, pii_surrogate, simhash_dedup
from siftstone.llm.common import checkpoint_dir, ready, table

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` in the columns of ``docs``, with the lengths of its texts."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    found = lang_rank.predict(docs, lang_rank.learn(docs, "text", "lang", "doc_id"))
    kept = found.where(F.col("lang_pred") != "und").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return _like(docs, line_quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash_dedup.keep_first(docs).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, pii_surrogate.replace(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return bestfit_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
