"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents; the last returns pieces of sequences with their token ids.

Null texts have no words, so the first stage rejects them, with all other texts of fewer than ten words. Documents with
null ids, null sources or other null columns pass like any other. Of repeated rows one stays; extra columns, whatever their names,
are kept until the last stage; of an empty table nothing is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import common, mixing, packing, pii, quality, simhash
from spanwise.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go; ids and other columns do not matter."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, null ids last; of repeated rows one."""
    return simhash.deduplicate(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars, if there, follows the new text. Null texts stay null.

    The key is the session's spark.spanwise.pii.key, or one drawn for the session."""
    made = pii.replaced_in(docs, pii.session_key(spark))
    if "n_chars" not in docs.columns:
        return made
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them: 0 to 3 times. Null sources are one source."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents as pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids.

    A null or empty text would be the end's id alone; repeated rows are packed each."""
    return packing.packed_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("pseudonyms", pseudonyms),
    ("mixture", mixture), ("packing", packed),
]

#: No SQL: SimHash needs XXH64 and packing a tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.session_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
