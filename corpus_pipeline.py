"""Corpus pipeline over the training-data operators.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. ``run`` applies them to the documents table.

1. quality rules: documents that fail the base rules or a learned cutoff go;
2. SimHash near-duplicates: of every class the document with the smallest id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. personal data: spans are replaced by their kind, n_chars is counted anew;
5. SentencePiece: token ids of the text, and whether decoding them gives the text back.

All stages take nulls in any column, empty and very long texts, repeated rows and tables without rows, and
carry columns that ``documents`` has besides its own, whatever their names, unchanged (the last stage replaces
columns named like its own results).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import decontaminate, pii, quality_rules, simhash, unigram
from evalspark.llm.common import read, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and their group's cutoffs. Null and empty texts have too few words and
    go; null lang and source are groups of their own; repeated rows are judged each."""
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of SimHash links: that of the smallest id; of equal rows one stays. Texts without
    words are one class; rows without an id cannot be named and stay."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text holds no benchmark item. Null and empty texts hold none and stay, as all do with an
    empty benchmark; repeated rows and rows without an id are judged by their text."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and n_chars counted anew; a null text stays as ``pii.redact`` leaves it."""
    return pii.redact(docs)


def tokenise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, n_tokens and round_trip; null and empty texts have no ids."""
    return unigram.encode(docs, check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", tokenise_stage),
]

#: Sketches, the latent index and the Viterbi paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, f"pipeline-{name}")
    return docs
