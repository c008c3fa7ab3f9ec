"""Five stages over documents, each written as Parquet and read back as the next one's input.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import op2_sentencepiece, op3_toxicity, op4_jaccard, op5_pii, op8_decontaminate
from kinfold.llm.common import cut, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't call toxic."""
    return op3_toxicity.keep_clean(docs, op3_toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 80 %): the one with the smallest doc_id."""
    return op4_jaccard.keep_one(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that hardly have anything else go."""
    return op8_decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    return op5_pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their number and digests."""
    return op2_sentencepiece.encode(docs, op2_sentencepiece.model_path(), with_ids=True)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("pii", pii), ("tokens", tokens)]

#: SQL can express neither the learned lexicon nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
