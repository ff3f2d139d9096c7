"""From documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourse.llm import keep, mix, pack, quality
from raincourse.llm.queries import QUERIES, tokenizer
from raincourse.session import new_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among ``docs``.

    Null and empty texts are scored by the classifier's bias; without usable labels every score is 0.5
    and all documents stay. Repeated rows stay or go together; an empty table stays empty.
    """
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select("row.*")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per text: the one with the largest doc_id; of rows that repeat id and text, one."""
    return keep.keep_one_copy(docs, f"digest_index_{spark.range(1).select(F.uuid()).first()[0].replace('-', '')}")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, 0.8): the one with the least doc_id; texts without words all stay."""
    return keep.keep_one_of_near(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A text without words has no size and is taken as often as its place in its source says; a null source is a
    source of its own; repeated rows are drawn one by one; an empty table stays empty.
    """
    return mix.emit_copies(mix.mixed(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens.

    A null or empty text is its end token alone; repeated rows are packed each; an empty table gives no piece.
    """
    return pack.pack(pack.cut(docs, tokenizer("word_bpe_49k.json")))


STAGES = [("quality", keep_good), ("exact_dedup", keep_one_copy), ("near_dedup", keep_one_of_near), ("mix", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES["pipeline"] = run
