"""The stages of the corpus pipeline. Each reads what its predecessor kept and, but for the last, returns the columns of documents.

Cases, in all stages: a null text is an empty one; rows without a doc_id are documents like others; repeated rows are separate
documents until near-duplicates go; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from permlab.llm import decontaminate, mixing, simhash, tokens, toxicity
from permlab.llm.common import staged, table


def vocabulary() -> str:
    """Where the public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Its files hold the documents in training order."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes and reads token files in the order of the files of docs, that is in training order."""
    return tokens.token_table(docs, vocabulary(), order=tokens.file_order(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token ids", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifiers, fingerprints and the tokenizer aren't in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None
