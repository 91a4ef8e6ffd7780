"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.audio import audio_report
from ledgerloom.llm.bpe import token_report
from ledgerloom.llm.common import documents
from ledgerloom.llm.context_mixing import score_report
from ledgerloom.llm.langid import language_report
from ledgerloom.llm.middle import MIDDLE_SQL, middle_report
from ledgerloom.llm.partenum import Threshold, jaccard_components
from ledgerloom.llm.prefix_trie import TRIE_SQL, conversation_trie
from ledgerloom.llm.quality import QUALITY_SQL, quality_report
from ledgerloom.llm.raking import mixed
from ledgerloom.llm.secrets import secret_report
from ledgerloom.llm.sharding import SHARD_SQL, shard_names
from ledgerloom.llm.simhash import fingerprint_report
from ledgerloom.llm.toxicity import toxicity_report


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_names(documents(spark, sf_dir))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_report(documents(spark, sf_dir))


def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_report(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), size=3, threshold=Threshold(90), second=3)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_report(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": SHARD_SQL, "op11_prefix_trie": TRIE_SQL, "op12_quality_rules": QUALITY_SQL, "op13_fill_in_middle": MIDDLE_SQL}
