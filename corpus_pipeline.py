"""From raw documents to token ids: quality, near-dedup, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, all columns as they were whatever
their names; the last gives digests of their tokens. Texts of any length are read whole; repeated rows
and null ids are rows like others; an empty table passes through every stage. Null and empty texts go at
the first stage, and where they meet a later one they are empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import byte_bpe, mixing, pii, quality, queries, simhash
from glyphmill.llm.common import release, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what importance resampling rejects."""
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each SimHash component: three words and two bits, the measure of the operator's query."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, disguised or not, by the name of its kind."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf's share of the token budget; a document used in two epochs gives two rows."""
    return mixing.mixed_documents(docs, **queries.mix_options())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return byte_bpe.round_trip(docs, queries.tokenizer_file("byte_bpe_50k.json").decode())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The quality model, the fingerprints and the encoder are beyond SQL; tests/llm/test_pipeline.py holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.split()[0])
        release(before)
    return docs
