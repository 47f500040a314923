"""The registered queries: each operator on its whole table, with the contract's parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, store
from .chat import conversation_digests, prefix_target_examples
from .common import checkpointed, fold, table
from .decontaminate import contamination
from .divergence import source_divergence
from .exact_dedup import exact_duplicates
from .language import identify_languages
from .licences import scan_licences
from .merkle import manifest
from .mixing import mix
from .near_dup import near_duplicates
from .oracles import ORACLES  # noqa: F401
from .pii import personal_data
from .quality import quality_scores
from .tokens import token_counts


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("matches")


def op5_near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with store.scratch(spark) as uri:  # the model goes when the scores are there
        model = kneser_ney.fit(docs.where(fold(F.col("doc_id"), 5) != 1), "text", uri)
        return checkpointed(kneser_ney.score(docs, model))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversation_digests(prefix_target_examples(turns.unionByName(probe)))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_ALL = (op1_mix_sources, op2_token_counts, op3_language_id, op4_licence_scan, op5_near_dup_join, op6_decontaminate, op7_quality, op8_exact_dedup, op9_lm_scores, op10_chat_format, op11_personal_data, op12_source_divergence, op13_merkle_manifest)
QUERIES = {f.__name__: f for f in _ALL}
