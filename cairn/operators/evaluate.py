"""Recall of retrieval against truth, and side-by-side comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import nearest

KS = (1, 3, 5)


def rank_all(questions: DataFrame, chunks: DataFrame, k: int = max(KS)) -> DataFrame:
    """question_id, chunk_id, similarity, rank: by descending similarity, without a threshold, to the largest k asked for."""
    found = nearest(questions, chunks, k=k, threshold=None, by_tradition=False)
    return found.select("question_id", "chunk_id", (1 - F.col("distance")).alias("similarity"), F.col("place").alias("rank"))


def recall_at_k(ranked: DataFrame, truth: DataFrame, questions: DataFrame, ks: tuple[int, ...] = KS, encoders: tuple[str, ...] = ()) -> DataFrame:
    """k, hits, n, recall: share of questions with a true chunk in the first k. Questions without a hit count in n."""
    keys = ["encoder"] if encoders else []
    best = ranked.join(truth, ["question_id", "chunk_id"], "left_semi").groupBy(*keys, "question_id").agg(F.min("rank").alias("best"))
    asked = questions.select("question_id")
    if encoders:
        asked = asked.withColumn("encoder", F.explode(F.array(*map(F.lit, encoders))))
    rows = asked.join(best, [*keys, "question_id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.sum(F.when(F.col("best") <= F.col("k"), 1).otherwise(0))
    return rows.groupBy(*keys, "k").agg(hit.alias("hits"), F.count("*").alias("n"), F.try_divide(hit, F.count("*")).alias("recall"))


def compare_encoders(ranked: dict[str, DataFrame], truth: DataFrame, questions: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall_at_k() of several rankings, by encoder."""
    both = None
    for name, df in ranked.items():
        own = df.select(F.lit(name).alias("encoder"), "question_id", "chunk_id", "rank")
        both = own if both is None else both.unionByName(own)
    return recall_at_k(both, truth, questions, ks, tuple(ranked))


def compare_answers(grounded: DataFrame, stock: DataFrame) -> DataFrame:
    """Each grounded answer beside the stock answer or its error; a missing stock answer drops nothing."""
    return grounded.join(stock.select("question_id", F.col("answer").alias("stock_answer"), F.col("error").alias("stock_error")), "question_id", "left")


def probe_sources(hits: DataFrame) -> DataFrame:
    """Distinct sources of each probe, sorted."""
    return hits.select("question_id", "source_id", "title", "author_position").distinct().orderBy("question_id", "source_id")
