"""A corpus pipeline: language id, near-duplicates, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it back for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, langid, mixing, neardup
from quantloom.llm.common import dropped, read, stored
from quantloom.llm.registry import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; those without a letter (or null) go.

    Rows without id or label teach nothing but are judged; repeated rows stay; columns of any names come back as
    they were. Without a labelled text nothing is known, so nothing stays.
    """
    learned = docs.where(~langid.held_out() & F.col("doc_id").isNotNull())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kept = langid.predict(rows, langid.train(learned)).where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.80 or more).

    Texts without words are linked with nothing; of rows of one id the first by hash stays, rows without one are
    documents of their own.
    """
    return neardup.deduplicated(docs, percent=80, width=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: sources at their target weights, none more than twice.

    Documents without words are not taken; a null source is a source, last in order.
    """
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the bytes they decode to, a row a document of the mix; null text as empty."""
    import public_tokenizers

    return bpe.encode_digests(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language id", identified), ("near-duplicates", deduplicated), ("mixing", mixed), ("byte-level BPE", tokenized)]

#: SQL can express neither learned profiles nor the tokenizer; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
