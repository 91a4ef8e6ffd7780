"""The corpus pipeline: toxic documents go, of near copies one stays, secrets are masked, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
``docs``, further ones and those that clash with an operator's own names too. An empty table passes all stages as such. Texts of
any length go through whole. ``run`` writes what a stage keeps and reads it again, so no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import encode_documents
from ledgerloom.llm.common import bounded_batches, id_remainder, stage_table
from ledgerloom.llm.partenum import drop_near_copies
from ledgerloom.llm.raking import sample
from ledgerloom.llm.secrets import mask_secrets
from ledgerloom.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a model of the labelled documents rejects. Null and empty texts score as the model's bias; repeated rows score alike; a null id is never a label's."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train(docs, labels, id_remainder("doc_id", 5) != 0))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that share 0.8 of their five-word shingles: the least id's, of its rows the one of the least hash; of fully equal rows one. Null, empty and wordless texts are linked with nothing and stay."""
    bounded_batches(spark)
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts. A null text stays null; ``n_chars``, where there is one, follows the masked text (null for null)."""
    bounded_batches(spark)
    masked = mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents towards flatter shares of sources, languages and topics. Nulls are levels of their own; the draw goes by id, so rows of one id stay or go together."""
    bounded_batches(spark)
    return sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add token ids; a null text has those of the empty one, none."""
    bounded_batches(spark)
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: Training, components and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
