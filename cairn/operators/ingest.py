"""Ingest of a batch of fetched payloads: extract, chunk, diff, embed what is new, refresh sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diff as D
from ..sources.tables import scratch, staged
from .chunk import chunk
from .embed import Encoder, embed_new, hashed_words
from .extract import extract, fetch_outcome


@dataclass(frozen=True)
class Ingested:
    sources: DataFrame
    chunks: DataFrame  # the next snapshot
    diff: DataFrame
    results: DataFrame  # source_id, changed, error
    fresh: DataFrame  # the rows that the snapshot gets


def ingest(sources: DataFrame, chunks: DataFrame, fetched: DataFrame, with_embeddings: bool = True, staging: str | None = None, factory: Callable[[], Encoder] = hashed_words, **selectors) -> Ingested:
    """One atomic step: sources that failed keep their rows but for the outcome; unchanged content is not chunked again,
    and only new chunks are embedded. A source fails alone: by its status, in extraction, or as one of its chunks has no
    vector; the results have the reason, the others go on.

    In the folder `staging`, texts and new chunks are written once and read by the results, none of which then extracts,
    chunks or embeds for itself. The results are read from there, so the folder (a new one in the shared folder, if none
    is named) can go only when they have been written.
    """
    staging = staging or scratch(sources.sparkSession)
    keep = lambda df, name: staged(df, f"{staging}/{name}")
    if with_embeddings and "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    f = fetched.withColumn("outcome", fetch_outcome(F.col("status_code")))
    texts = extract(f.where("outcome = 'fetched'"), **selectors)
    joined = f.join(texts.withColumnsRenamed({"title": "inferred_title", "error": "extract_error"}), "source_id", "left")
    outcome = F.when((F.col("outcome") == "fetched") & F.col("text").isNull(), "failed").otherwise(F.col("outcome"))
    done = joined.select("source_id", outcome.alias("outcome"), "etag", "last_modified", "inferred_title", "text", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.coalesce("extract_error", F.when(F.col("outcome") == "failed", F.concat(F.lit("HTTP status "), F.col("status_code").cast("string")))).alias("error"))
    done = keep(done, "texts")
    changed = done.where("outcome = 'fetched'").join(D.refresh_validators(sources, done).where("changed").select("source_id"), "source_id", "left_semi")
    incoming = keep(D.hashed_chunks(chunk(changed, "source_id", "text")), "chunks")
    existing = chunks.where("is_active").join(changed.select("source_id"), "source_id", "left_semi")
    state = keep(D.diff_chunks(existing, incoming), "diff")
    incoming = incoming.join(state.where("state = 'new'"), ["source_id", "chunk_hash"], "left_semi")
    if with_embeddings:
        incoming = keep(embed_new(incoming, errors="embed_error", factory=factory), "embedded")
        bad = keep(incoming.where("embed_error is not null").groupBy("source_id").agg(F.min("embed_error").alias("embed_error")), "failed")
        done = done.join(bad, "source_id", "left").withColumns({"outcome": F.when(F.col("embed_error").isNull(), F.col("outcome")).otherwise("failed"), "error": F.coalesce("error", "embed_error")}).drop("embed_error")
        incoming, state = (x.join(bad.select("source_id"), "source_id", "left_anti") for x in (incoming.drop("embed_error"), state))
    after = D.refresh_validators(sources, done)
    results = done.join(after.select("source_id", "changed"), "source_id").select("source_id", "changed", F.when(F.col("outcome") == "failed", F.col("error")).alias("error"))
    return Ingested(after.drop("changed"), D.apply_diff(chunks, state, incoming), state, results, D.new_rows(chunks, state, incoming))
