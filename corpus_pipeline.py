"""Cleaning and encoding of a corpus: toxicity, near-duplicates, benchmark decontamination, PII, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafield.llm import decontaminate, pii, sentencepiece_codec, simhash
from stratafield.llm import toxicity as tox
from stratafield.llm.common import apart, materialize, table, tokenizer_path

MODEL = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.7; the lexicon is learnt from labelled documents of the input."""
    return tox.drop_toxic(docs, tox.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words are benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for private data; n_chars is that of the new text."""
    key = pii.session_key(spark)
    done = apart(docs, ["text"], lambda held, text: pii.pseudonymise(held, key, text))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, ids (with the end id), the text decoded from them and n_tokens of each document."""
    coded = sentencepiece_codec.code(docs.select("doc_id", "text"), tokenizer_path(MODEL))
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("private_data", private_data), ("encoding", encoding)]
#: SQL can express neither the stages nor their composition; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
