"""Corpus preparation in five stages over ``documents``.

Quality classifier, near-dedup, benchmark decontamination, masking of personal
data, and byte-level BPE.  Each stage reads all that its predecessor kept and
writes Parquet to the shared folder; the first four return the columns of
``documents``.

Defined results: a null or empty text is scored, deduplicated (all of them are one class), searched, and
encoded as a text without words; very long texts are processed whole; a score of 0.5 is kept; of a class of near
copies the record of smallest id stays, and repeated rows are one record; extra columns, whatever their
names, are carried to the masking stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, minhash, pii, quality
from siltstone.llm.common import stored
from siltstone.llm.queries import byte_vocabulary, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    return quality.keep_good(docs, labels)


def keep_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of at least 0.8 (5-word shingles); candidates by op9's fingerprints and min-hashes."""
    return minhash.keep_one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.mask_pii(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return masked if length is None else masked.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.tokenize(docs, byte_vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_unique),
    ("decontamination", keep_uncontaminated),
    ("pii", mask_personal),
    ("bpe", encode),
]

#: Fingerprints, trained models and BPE have no SQL form; tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
