"""A training-corpus pipeline of five stages over ``documents``.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.

1. language ID: texts without a letter and texts of ambiguous language go
2. exact dedup: of equal texts the row with the largest doc_id stays
3. MinHash near-dedup: the smallest doc_id of each class stays
4. mixing: every row as often as the mix takes it (rows with no copy go)
5. best-fit packing: token pieces and their places in sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hpfunnel.llm import exact_dedup, langid, mixing, near_dedup, packing
from hpfunnel.llm.common import quoted, table, written
from hpfunnel.llm.queries import word_vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects ``und`` (null texts, texts without a letter) and ambiguous languages.

    The model learns from this stage's own input.  If nothing can be learnt
    from it (no labels, or only held-out rows), texts with a letter stay.
    """
    row = F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row")
    model = langid.train(docs)
    found = langid.identify(docs.select(row, quoted("text").alias("text")), model)
    if model.langs:
        kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    else:
        kept = found.filter(langid.lettered("text"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z the row with the largest doc_id stays, one of repeated rows; null is an empty text."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the smallest doc_id stays; texts without words are one class."""
    return near_dedup.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; a null source is a source of its own."""
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's tokens and their places; a null or empty text is its closing token alone."""
    return packing.pack(packing.tokenize(docs, word_vocabulary())).drop("ids")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]

#: SQL cannot express the learnt, iterative and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents`` after all stages."""
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages on ``docs``, written after each; an empty table gives an empty result."""
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k + 1}")
    return docs
