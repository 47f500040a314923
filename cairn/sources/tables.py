"""Reading landed payloads and snapshots, and writing them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCHED = "source_id long, source_type string, url string, status_code int, raw string, etag string, last_modified string"


def read_fetched(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed payloads as a table or a stream: the declared columns and landed_at, the time that a payload carries with it
    or else the one at which its file came."""
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(f"{FETCHED}, landed_at timestamp").parquet(path)
    return rows.withColumn("landed_at", F.coalesce("landed_at", "_metadata.file_modification_time"))


def newest_payloads(fetched: DataFrame) -> DataFrame:
    """One payload a source, the one that landed last. Equal times go by the date that the server gave, then by etag and content."""
    day = F.regexp_extract("last_modified", r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    order = F.struct("landed_at", F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss")), "etag", F.xxhash64("raw", "status_code", "last_modified"))
    return fetched.groupBy("source_id").agg(F.max_by(F.struct(*fetched.columns), order).alias("f")).select("f.*")


def scratch(spark: SparkSession) -> str:
    """URI of a new folder in the folder that the cluster shares (spark.checkpoint.dir), or in a local one where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{root.rstrip('/')}/cairn-{uuid.uuid4().hex}" if root else f"file://{tempfile.mkdtemp(prefix='cairn-')}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows once and reads them from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this engine made, wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def active_chunks(chunks: DataFrame, source_ids: DataFrame | None = None) -> DataFrame:
    live = chunks.where(F.col("is_active").cast("boolean"))  # a partition column reads as text
    return live if source_ids is None else live.join(source_ids.select("source_id"), "source_id", "left_semi")


def write_snapshot(df: DataFrame, root: str, version: int, partition_by: tuple[str, ...] = ()) -> str:
    """Writes root/v=N whole, and then says in root/_current that it is the newest. A directory that is read is never overwritten."""
    spark, path = df.sparkSession, f"{root}/v={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/_versions")
    return path


def current_version(spark: SparkSession, root: str) -> int | None:
    try:
        return spark.read.parquet(f"{root}/_versions").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest snapshot, None before the first."""
    version = current_version(spark, root)
    return None if version is None else spark.read.parquet(f"{root}/v={version}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_entities(entities: DataFrame, path: str) -> None:
    """New credibility entities, one row a key: what lookup_entities() has computed for misses."""
    append(entities.where("not cached").drop("cached", "request_id"), path)


def append_messages(responses: DataFrame, path: str) -> None:
    """Only users who are logged in leave a history."""
    append(responses.where("user_id is not null"), path)
