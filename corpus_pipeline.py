"""From raw documents to a training mix: each stage filters or repeats what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import table
from cairn.llm.decontaminate import drop_contaminated
from cairn.llm.exact_dedup import drop_exact_duplicates
from cairn.llm.language import keep_identified
from cairn.llm.mixing import mixed_documents
from cairn.llm.near_dup import drop_near_duplicates
from cairn.llm.store import remove, scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known stay, with all their columns. Null, empty and letterless texts go; repeated rows go or
    stay alike; ids and other columns may be null; an empty table gives no rows."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays (a null one only if there is no other; of rows that repeat an
    id too, one). Null counts as empty; texts are compared whole; an empty table gives no rows."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays. Texts without words are linked with nothing and stay, null
    ones too; rows of one id with other texts are told apart; an empty table gives no rows."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go. Null and empty texts and null ids stay if they are clean, repeated
    rows alike; an empty benchmark or table takes nothing away."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share asks for, with mix_copy and mix_words. A null source is a source; texts
    without words go, as they add nothing to a mix; an empty table gives no rows."""
    return mixed_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("mixture", mixture)]

#: SQL can't express the first stage's network; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet in the shared folder and read again.

    A stage's table goes when the next one is there; the last one's stays, the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = scratch_path(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(before)
        before = path
    return docs
