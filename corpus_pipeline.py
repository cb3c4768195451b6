"""From raw documents to token ids: quality rules, exact and near deduplication, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared
folder and reads it again as the next one's docs.  All stages but the last return the columns of documents, and
other columns that the docs have, whatever their names, unchanged.

Defined cases, by stage.  Null and empty texts: quality rejects them (under 50 words); exact takes them as equal and keeps
one; near keeps each, as they are linked with nothing; mixing may draw them as it
balances documents too, and they add no words; tokens gives no ids.  A null doc_id is a row like any other (near: all rows with a null id and one text are one).  Ties: exact keeps the
longest original text, then the smallest doc_id; near the smallest doc_id.  Repeated rows: exact and near keep one; quality,
mixing and tokens treat each row alike.  Very long texts are worked on whole.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyard.llm.byte_bpe import bpe_documents
from tallyard.llm.common import stored
from tallyard.llm.exact_dedup import deduplicate
from tallyard.llm.mixing import mixed
from tallyard.llm.near_dedup import deduplicate_near
from tallyard.llm.quality_rules import fit_field, keep_quality
from tallyard.llm.queries import BYTE_RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    return keep_quality(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one stays."""
    return deduplicate_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0, 1 or 2 times) as the mix takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per taken document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return bpe_documents(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing to target weights", mixing), ("byte-level BPE", tokens)]

#: SQL can express neither the line field nor the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return docs
