"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame. All but the last return the columns of
documents; ``run`` writes each result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bpe import bpe_encode
from tallyforge.llm.common import free_name, materialize, table
from tallyforge.llm.langid import keep_identified
from tallyforge.llm.line_dedup import line_dedup
from tallyforge.llm.mixing import mixed_rows
from tallyforge.llm.ngram_join import ngram_join
from tallyforge.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go.

    Texts without a letter (null, empty) go. Repeated rows share a fate, all columns are kept, an empty table gives no rows.
    """
    ship(spark)
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows; n_chars, if there is one, follows the text.

    A document that loses all its lines stays, with an empty text; a null text stays null. Of equal windows the first by
    doc_id (null first), then text, stays; rows that repeat doc_id and text keep the same lines. Other columns, whatever their
    names, are kept as they are. An empty table gives no rows.
    """
    ship(spark)
    cut = line_dedup(docs, with_counts=False)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest doc_id, then the smallest text hash.

    Rows are told apart by doc_id and text, so of rows that share a doc_id each is kept or dropped by its own text, and of rows
    that repeat both one stays. Texts without a word (null, empty) and rows without a doc_id
    are near nothing and all stay. All columns are kept. An empty table gives no rows.
    """
    ship(spark)
    key, of_doc, of_text, times = (free_name(docs, f"__{name}") for name in ("key", "doc", "text", "times"))
    rows = ngram_join(docs, with_keys=True).filter("class_key is not null").groupBy("doc_id", "text_key", "class_key").agg(F.count("*").alias("n"))
    rows = materialize(rows, "rows")
    stays = rows.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("stays"))
    judged = rows.join(stays, "class_key").withColumn("kept", F.struct("doc_id", "text_key") == F.col("stays"))
    # how often a row that isn't to stay as it is stays: not at all, or once where it is repeated
    changed = judged.filter("not kept or n > 1").select(F.col("doc_id").alias(of_doc), F.col("text_key").alias(of_text), F.col("kept").cast("int").alias(times))
    keyed = docs.withColumn(key, F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16))
    found = keyed.join(changed, (F.col("doc_id").cast("long") == F.col(of_doc)) & (F.col(key) == F.col(of_text)), "left")
    repeated = found.filter(F.col(times) == 1).dropDuplicates([of_doc, of_text])
    return found.filter(F.col(times).isNull()).unionByName(repeated).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, each as often as it takes them.

    A null source is a source of its own; documents without a word, which add nothing to a mix, are taken as their hash
    decides. Rows that repeat doc_id and text are taken together. All columns are kept. An empty table gives no rows.
    """
    ship(spark)
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row, with its decoded bytes' digest.

    A null or empty text has no ids; repeated rows give repeated rows; an empty table gives none.
    """
    ship(spark)
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Similarity by sampling, the seeded choice of documents and BPE merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
