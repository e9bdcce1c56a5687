"""A corpus pipeline in five stages, from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last keep the columns of documents. ``run`` writes
each stage's rows as Parquet into the shared folder and reads them back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import dedup, langid, packing, secrets, toxicity
from citeweave.llm._shared import discard, materialize, read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, does not reject.

    Null and empty texts have the score of no evidence and stay; rows are judged each
    for itself, so repeated rows and those without an id fare like others, and nothing is
    ranked. All columns are handed on; an empty table gives an empty one.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language of the corpus explains; those without a letter, gibberish and unknown scripts go.

    Null and empty texts have no letter and go. Rows are judged each for itself, as in
    the stage before; where no language can be learned, nothing stays.
    """
    return langid.with_language(docs, langid.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Texts without words and rows without an id all stay. Rows that repeat an id are
    judged by their words; of rows of the same id and words one stays.
    """
    return dedup.without_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut out of their texts; null texts stay null, n_chars follows the text, repeated rows stay alike."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in sequences of at most 4096 tokens.

    Null and empty texts are documents of the closing token alone. Repeated rows are
    packed each for itself; an empty table gives no pieces; of columns only doc_id and text count.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: The classifiers, signatures and token vocabularies have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, before, sf_dir), f"stage-{name}")
        discard(before)
        before = docs
    # the last stage has written its pieces when it returns, so its input is not read again
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
