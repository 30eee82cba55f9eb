"""Corpus pipeline: toxicity filter, near-dedup, masking of personal data, mixing, token encoding.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, all but the last
with the columns of ``documents`` (doc_id, text, lang, source, n_chars). Nulls, empty texts, repeated rows
and empty tables behave as the called operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, mixing, pii, simhash, toxicity
from nearfield.llm.common import shared, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; trained on the labelled rows among ``docs``."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8 of five-word shingles."""
    return simhash.keep_one(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    masked = pii.mask_documents(docs, ["doc_id", "lang", "source"])
    return masked.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: a row for each pass over a document."""
    mixed = mixing.mixed_documents(docs)
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: No SQL expresses the learned stages; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared(docs)
    return docs
