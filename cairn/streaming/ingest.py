"""Streaming ingest: micro-batches through the batch operators, or keyed state per source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.catalog import job_outcomes
from ..operators.chunk import chunk_hashes
from ..operators.embed import Encoder, hashed_words
from ..operators.ingest import ingest
from ..sources import log, tables


def log_tables(sources: DataFrame, chunks: DataFrame) -> tuple[log.Table, log.Table]:
    """The two tables that a streaming ingest keeps."""
    kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return log.Table("sources", ("source_id",), kinds(sources)), log.Table("chunks", ("source_id", "chunk_hash"), kinds(chunks), "is_active")


def with_ingest_columns(sources: DataFrame, chunks: DataFrame, with_embeddings: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both tables with all columns that a streaming ingest fills."""
    if with_embeddings and "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    for c, kind in (("status", "string"), ("last_checked_at", "timestamp"), ("last_scraped_at", "timestamp"), ("landed_at", "timestamp")):
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(None).cast(kind))
    return sources, chunks


def stream_ingest(spark: SparkSession, landing: str, state: str, checkpoint: str, sources: DataFrame, chunks: DataFrame, trigger: dict | None = None, compact_every: int = 16, now: Column | None = None, with_embeddings: bool = True, factory: Callable[[], Encoder] = hashed_words, **selectors) -> StreamingQuery:
    """Ingests landed payloads in micro-batches.

    Sources and chunks are one log in `state` (sources/log.py): a batch appends new chunks, tombstones of stale ones and
    the rows of its own sources, and then becomes one version of both; what it writes grows with what has landed. After
    every `compact_every` batches the log is compacted. Each source that ran gets its job's status and times, and a row
    in state/jobs. A batch's version is its id plus one, and all that it writes is replaced if it runs again. Version 0 is
    what was there at the start.

    Of several payloads of a source in one batch the one that landed last counts. A payload that landed before the one
    that the source's row is from (landed_at) changes nothing; it is a row of state/late.
    """
    sources, chunks = with_ingest_columns(sources, chunks, with_embeddings)
    of_sources, of_chunks = log_tables(sources, chunks)
    clock = F.current_timestamp() if now is None else now

    def step(batch: DataFrame, batch_id: int) -> None:
        staging, version = f"{state}/staging/batch={batch_id}", batch_id + 1
        if log.current(spark, state) is None:
            log.create(state, {of_sources: sources, of_chunks: chunks})
        landed = tables.staged(tables.newest_payloads(batch), f"{staging}/landed")
        mine = log.read(spark, state, of_sources, batch_id, landed)
        mine = tables.staged(mine, f"{staging}/sources")
        seen = landed.join(mine.select("source_id", F.col("landed_at").alias("seen_at")), "source_id", "left")
        late = F.coalesce(F.col("landed_at") < F.col("seen_at"), F.lit(False))
        seen.where(late).select("source_id", "landed_at").write.mode("overwrite").parquet(f"{state}/late/batch={batch_id}")
        last = seen.where(~late).drop("seen_at")
        own = log.read(spark, state, of_chunks, batch_id, last)
        out = ingest(mine, own, last.drop("landed_at"), with_embeddings, staging, factory, **selectors)
        results = tables.staged(out.results, f"{state}/results/batch={batch_id}")
        after, jobs = job_outcomes(out.sources, results, clock)
        read = results.where("error is null").select("source_id")  # a failure says nothing of how old the content is
        when = last.join(read, "source_id", "left_semi").select("source_id", F.col("landed_at").alias("came_at"))
        after = after.join(when, "source_id", "left").withColumn("landed_at", F.coalesce("came_at", "landed_at")).drop("came_at")
        log.write_rows(after.select(*[F.col(f.name).cast(f.dataType) for f in sources.schema]), state, of_sources, version)
        missing = {c: F.lit(None).cast(chunks.schema[c].dataType) for c in chunks.columns if c not in out.fresh.columns}
        log.write_rows(out.fresh.withColumns(missing).select(*chunks.columns), state, of_chunks, version)
        log.write_gone(out.diff.where("state = 'stale'"), state, of_chunks, version)
        jobs.write.mode("overwrite").parquet(f"{state}/jobs/batch={batch_id}")
        log.commit(spark, state, version)
        if version % compact_every == 0:
            log.compact(spark, state, [of_sources, of_chunks])
        tables.remove(spark, staging)

    stream = tables.read_fetched(spark, landing, stream=True)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def incoming_hashes(texts: DataFrame) -> DataFrame:
    """source_id, content_hash, hashes: what the stateful diff reads of each (source_id, text), batch or stream."""
    known = texts.where("text is not null").withColumn("both", F.struct("source_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash")))
    return chunk_hashes(known, "both", "text").select("both.source_id", "both.content_hash", "hashes")


DIFF = "source_id long, chunk_hash string, state string"


#: Map state is kept by this store only.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChunkDiff(StatefulProcessor):
    """Per source: the content hash in one value, the active chunk hashes as a map's keys. A payload reads the keys and
    writes those that come or go; hashes that stay are not written again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.content = handle.getValueState("content", "content_hash string")
        self.active = handle.getMapState("active", "chunk_hash string", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        content = self.content.get()[0] if self.content.exists() else None
        before, was = None, content
        for f in rows:
            out = []
            for new_content, hashes in zip(f["content_hash"], f["hashes"], strict=True):
                if new_content == content:
                    continue
                if before is None:
                    before = {k[0] for k in self.active.keys()} if content is not None else set()
                fresh = set(hashes if hashes is not None else [])
                out += [(key[0], h, s) for s, hs in (("new", fresh - before), ("stale", before - fresh), ("unchanged", fresh & before)) for h in sorted(hs)]
                for h in fresh - before:
                    self.active.updateValue((h,), (True,))
                for h in before - fresh:
                    self.active.removeKey((h,))
                content, before = new_content, fresh
            yield pd.DataFrame(out, columns=["source_id", "chunk_hash", "state"])
        if content != was:
            self.content.update((content,))


def stream_diff(hashes: DataFrame) -> DataFrame:
    """A stream of (source_id, content_hash, hashes) to chunk diffs against the state of each source, which has no end of life.

    Spark keeps map state in RocksDB: the session's state store is set to it, for this and later streams.
    """
    hashes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return hashes.groupBy("source_id").transformWithStateInPandas(ChunkDiff(), DIFF, "Append", "None")


__all__ = ["stream_ingest", "stream_diff", "incoming_hashes", "log_tables", "with_ingest_columns"]
