"""Content hashes, chunk diffs and their application to snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Changes of so many chunks are broadcast to the scan of a snapshot.
BROADCAST_ROWS = 500_000


def content_unchanged(previous: Column, current: Column) -> Column:
    return F.coalesce(previous == current, F.lit(False))


def hashed_chunks(chunks: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Adds chunk_hash and drops repeats inside a source; equal chunks of two sources both stay."""
    first = F.min(F.struct("chunk_no", "chunk_text")).alias("c")
    return chunks.withColumn("chunk_hash", T.hash_text(F.col("chunk_text"))).groupBy(source_id, "chunk_hash").agg(first).select(source_id, "chunk_hash", "c.chunk_no", "c.chunk_text")


def diff_chunks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """source_id, chunk_hash, state (new, stale, unchanged): one full outer join on hashes, texts stay out of it."""
    old = existing.select("source_id", "chunk_hash").distinct().withColumn("old", F.lit(True))
    new = incoming.select("source_id", "chunk_hash").distinct().withColumn("new", F.lit(True))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "stale").otherwise("unchanged")
    return old.join(new, ["source_id", "chunk_hash"], "full_outer").select("source_id", "chunk_hash", state.alias("state"))


def title_backfill(title: Column, inferred: Column) -> Column:
    return F.coalesce(title, F.nullif(inferred, F.lit("")))


def _near(diff: DataFrame, limit: int) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts sides that have a row for each change at most, if the changes, counted, are within the limit."""
    few = diff.where("state <> 'unchanged'").count() <= limit
    return lambda df: F.broadcast(df) if few else df


def new_rows(chunks: DataFrame, diff: DataFrame, incoming: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of the new chunks, active, with the snapshot's columns that they have. Ids are hashes of source, chunk and the
    number of rows that the source's chunk had before: a chunk that returns is a new row."""
    near, keys = _near(diff, limit), ["source_id", "chunk_hash"]
    new = near(diff.where("state = 'new'").select(*keys))
    before = chunks.select(*keys).join(new, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("before"))
    fresh = incoming.join(new, keys, "left_semi").join(near(before), keys, "left")
    made = fresh.select(F.xxhash64("source_id", "chunk_hash", F.coalesce("before", F.lit(0))).alias("chunk_id"), *keys, F.lit(True).alias("is_active"), *[c for c in chunks.columns if c in incoming.columns and c not in ("chunk_id", "source_id", "chunk_hash", "is_active")])
    return made.select(*[c for c in chunks.columns if c in made.columns])


def apply_diff(chunks: DataFrame, diff: DataFrame, incoming: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The next chunk snapshot. Stale active rows turn inactive, new chunks come in as rows of their own, all else stays.

    The diff is read several times, so it had better be stored. Its changes are counted: up to `limit` they go to the scan
    of the snapshot, whose rows, with texts and vectors, are then not shuffled.
    """
    stale = diff.where("state = 'stale'").select("source_id", "chunk_hash", F.lit(True).alias("gone"))
    kept = chunks.join(_near(diff, limit)(stale), ["source_id", "chunk_hash"], "left").withColumn("is_active", F.col("is_active") & F.col("gone").isNull()).select(*chunks.columns)
    return kept.unionByName(new_rows(chunks, diff, incoming, limit), allowMissingColumns=True)


def refresh_validators(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """fetched: source_id, outcome, content_hash, etag, last_modified, inferred_title. Changed content sets the hash and
    both validators, the same content only the validators; anything not fetched leaves the row alone."""
    f = fetched.select("source_id", *[F.col(c).alias(f"f_{c}") for c in ("outcome", "content_hash", "etag", "last_modified", "inferred_title")])
    got = F.coalesce(F.col("f_outcome") == "fetched", F.lit(False))
    same = content_unchanged(F.col("content_hash"), F.col("f_content_hash"))
    out = sources.join(f, "source_id", "left")
    return out.select(
        *[c for c in sources.columns if c not in ("title", "content_hash", "etag", "last_modified")],
        F.when(got, title_backfill(F.col("title"), F.col("f_inferred_title"))).otherwise(F.col("title")).alias("title"),
        F.when(got & ~same, F.col("f_content_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        *[F.when(got, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c) for c in ("etag", "last_modified")],
        (got & ~same).alias("changed"),
    )
