"""A training corpus from raw documents: five stages, each on everything its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  A runner may write each stage's rows and read them again as the next one's docs; ``run`` does so by
checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, mixing, pii, quality, shingles
from ledgerline.llm.common import by_place, durable, own_columns, place_of, table
from ledgerline.llm.registry import tokenizer_path

#: A document is kept if its quality score is at least this.
QUALITY = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of what is there.

    Null and empty texts are scored like any other; without labels of both classes all documents stay (score 0.5);
    repeated rows go or stay together; an empty table stays empty; columns of any name stay.
    """
    labels = own_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality"])
    network = quality.fit(docs, labels)
    scored = quality.score(by_place(docs).withColumnRenamed(place_of(docs, "text"), "text"), network, "quality")
    return scored.filter(F.col("quality") >= QUALITY).drop("quality").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates; five-word shingles, Jaccard 0.8): the smallest id.

    Texts that are null or have no word are one group; rows with a null id all stay; of repeated rows of an id one
    stays; an empty table stays empty; columns of any name stay.
    """
    return shingles.representatives(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; n_chars, where there is one, follows the new text.

    Null texts stay null (with their n_chars); every row stays; repeated rows are rewritten alike; an empty table stays
    empty; columns of any other name stay.
    """
    new = pii.pseudonymise(docs, count=None)
    if "n_chars" not in docs.columns:
        return new
    n, text = place_of(docs, "n_chars"), F.col(place_of(docs, "text"))
    counted = F.when(text.isNull(), F.col(n)).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return by_place(new).withColumn(n, counted).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their target weights.

    A null source is a source of its own; documents without words come as often as their source is taken whole;
    repeated rows share what is due to them; an empty table stays empty; columns of any name stay.
    """
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the token ids of every document of the mix with the text that they decode to.

    A null text has 0 tokens; repeated rows are encoded alike; an empty table gives no rows.
    """
    return bpe.encode(own_columns(docs, ["doc_id", "lang", "source", "text"]), tokenizer_path()).drop("text")


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: A trained classifier and a tokenizer can't be put in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
