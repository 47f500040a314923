"""Source catalogue, registration, patches and crawl jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def list_sources(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources with their counts of active chunks, newest first. Chunks are counted before the join."""
    counts = chunks.where("is_active").groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    return sources.join(counts, "source_id", "left").fillna(0, ["chunk_count"]).orderBy(F.desc("created_at"), F.desc("source_id"))


def chunk_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, chunk_count: active chunks of each source, 0 without any."""
    counts = chunks.where("is_active").groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    return sources.select("source_id").join(counts, "source_id", "left").fillna(0, ["chunk_count"])


def chunk_count(chunks: DataFrame, source_id: int) -> DataFrame:
    return chunks.where(F.col("is_active") & (F.col("source_id") == source_id)).agg(F.count("*").alias("chunk_count"))


def register_sources(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a URL that is known, or came earlier in the batch, is rejected."""
    first = incoming.groupBy("url").agg(F.min_by(F.struct(*incoming.columns), "request_id").alias("r")).select("r.*")
    accepted = first.join(existing.select("url"), "url", "left_anti")
    rejected = incoming.join(accepted.select("request_id"), "request_id", "left_anti")
    return accepted.withColumns({"status": F.lit("pending"), "chunk_count": F.lit(0).cast("long")}), rejected


def apply_patches(sources: DataFrame, patches: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(patched, rejected). A patch is a map: a field that is present changes, to null too; absent ones stay."""
    out = sources.join(patches.select("source_id", "patch"), "source_id", "left")
    has = lambda f: F.coalesce(F.map_contains_key("patch", F.lit(f)), F.lit(False))
    changed = {f: F.when(has(f), F.try_element_at("patch", F.lit(f))).otherwise(F.col(f)) for f in fields}
    return out.withColumns(changed).drop("patch"), patches.join(sources.select("source_id"), "source_id", "left_anti")


def request_rescrape(sources: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(sources with the asked ones pending, pending job rows)."""
    asked = ids.select("source_id").distinct().withColumn("asked", F.lit(True))
    after = sources.join(asked, "source_id", "left").withColumn("status", F.when(F.col("asked"), "pending").otherwise(F.col("status"))).drop("asked")
    jobs = sources.join(asked, "source_id", "left_semi").select("source_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), now.alias("created_at"))
    return after, jobs


def pending_batch(sources: DataFrame, n: int) -> DataFrame:
    """The first n pending sources, oldest first."""
    return sources.where("status = 'pending'").orderBy("created_at", "source_id").limit(n)


def job_outcomes(sources: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """results: source_id, changed, error. (sources after, job rows)."""
    r = results.select("source_id", "changed", "error", F.lit(True).alias("ran"))
    after = sources.join(r, "source_id", "left")
    ok = F.col("error").isNull()
    after = after.withColumns(
        {
            "status": F.when(F.col("ran"), F.when(ok, "completed").otherwise("failed")).otherwise(F.col("status")),
            "last_checked_at": F.when(F.col("ran"), now).otherwise(F.col("last_checked_at")),
            "last_scraped_at": F.when(F.col("ran") & ok & F.col("changed"), now).otherwise(F.col("last_scraped_at")),
        }
    ).drop("changed", "error", "ran")
    jobs = results.select("source_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.lit(1).alias("attempts"), now.alias("finished_at"), F.col("error").alias("error_message"))
    return after, jobs


def overdue_jobs(jobs: DataFrame, now: Column, limit_s: int = V.JOB_LIMIT_S) -> DataFrame:
    """Jobs after the watchdog: what has run longer than the limit has failed."""
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(limit_s)))
    late = F.coalesce(late, F.lit(False))
    return jobs.withColumns(
        {
            "status": F.when(late, "failed").otherwise(F.col("status")),
            "finished_at": F.when(late, now).otherwise(F.col("finished_at")),
            "error_message": F.when(late, f"worker watchdog timeout after {limit_s}s").otherwise(F.col("error_message")),
        }
    )
