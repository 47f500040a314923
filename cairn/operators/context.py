"""Traditions, cited sources, labelled contexts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def list_traditions(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Traditions with an active chunk, sorted."""
    live = chunks.where("is_active").select("source_id")
    return sources.where("tradition is not null").join(live, "source_id", "left_semi").select("tradition").distinct().orderBy("tradition")


def admin_traditions(sources: DataFrame) -> DataFrame:
    return sources.where("tradition is not null").select("tradition").distinct().orderBy("tradition")


def cited_sources(hits: DataFrame) -> DataFrame:
    """One row per question and source, in the order of first appearance."""
    first = F.min_by(F.struct("url", "title", "tradition", "author_position"), "position").alias("s")
    one = hits.groupBy("question_id", "source_id").agg(F.min("position").alias("first"), first)
    w = Window.partitionBy("question_id").orderBy("first")
    return one.select("question_id", "source_id", F.row_number().over(w).alias("cite_no"), "s.*")


def format_context(hits: DataFrame) -> DataFrame:
    """question_id, context: excerpts in blocks by source, each with one header, in order of appearance."""
    title, tradition = F.col("title"), F.col("tradition")
    suffix = F.when((title != "") & (tradition != ""), F.concat(F.lit(" ("), tradition, F.lit(")"))).otherwise("")
    header = F.concat(F.lit("["), T.source_label(title, tradition), suffix, F.lit(": "), F.col("url"), F.lit("]"))
    tags = F.nullif(T.provenance_label(F.col("author_position"), F.col("text_role"), F.col("era"), F.col("known_bias_flags")), F.lit(""))
    head = F.concat_ws("\n", header, F.concat(F.lit("Provenance: "), tags))
    texts = lambda c: F.transform(F.array_sort(c), lambda x: x["text"])  # noqa: E731  at most k hits a question
    rows = hits.select("question_id", "source_id", "position", "chunk_text", head.alias("head"))
    blocks = rows.groupBy("question_id", "source_id").agg(F.min("position").alias("first"), F.min_by("head", "position").alias("head"), F.collect_list(F.struct("position", F.col("chunk_text").alias("text"))).alias("parts"))
    block = F.concat_ws("\n", F.concat(F.array("head"), texts(F.col("parts"))))
    return blocks.select("question_id", F.struct("first", block.alias("text")).alias("b")).groupBy("question_id").agg(F.array_join(texts(F.collect_list("b")), "\n\n").alias("context"))


def prompt_rows(questions: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """question_id, messages: the caller's system text, then excerpts and question."""
    user = F.concat(F.lit("Excerpts:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return questions.join(contexts, "question_id").select("question_id", F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))
