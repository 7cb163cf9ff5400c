"""A corpus pipeline of five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
each result as Parquet to the shared work folder and rereads it for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, pii, toxicity
from tidemark.llm.common import materialize
from tidemark.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't call toxic; it learns from all labelled rows, sampled.

    Null and empty texts stay (the intercept alone calls nothing toxic where toxic rows
    are the fewer); equal texts go or stay together; an empty table stays empty.
    """
    scored = toxicity.fit_and_score(docs, table(spark, sf_dir, "labels"), out="__toxic")
    return scored.where(F.col("__toxic") < 0.5).drop("__toxic")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the least by id; see :func:`neardup.first_of_class`.

    Rows without an id stay; of rows equal in all columns one stays; a different text
    under an id that occurs twice is judged by itself; an empty table stays empty.
    """
    return neardup.first_of_class(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates instead of personal data; ``n_chars`` follows the new text.

    All rows stay; null and empty texts are as they were; equal texts stay equal.
    """
    out = pii.checked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are drawn, by output shard in shuffled order.

    A null text has no words and is taken like its block; a null source is the last one.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to; a null text has no ids, copies have equal digests."""
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_class),
    ("pii", hide_private),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL has no means for these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
