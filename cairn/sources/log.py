"""Tables as logs: appended rows and tombstones by version, merged by the reader, compacted into a new base now and then.

A folder holds several tables that change together:

    root/<table>/base/v=B        all rows as of version B
    root/<table>/rows/v=N        rows that version N has added (or put in place of those with the same key)
    root/<table>/gone/v=N        keys whose rows of versions before N are no longer active
    root/_log/<N>.<B>            version N is whole, and is base B with the rows and tombstones after B

A version counts for all tables at once, when its empty file is in `_log`: what a reader sees of them belongs together.
Writing a version again (a batch that runs again) replaces its files. What a version writes grows with its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import remove

#: Keys of changed rows up to so many are broadcast to the scan of the base; more are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Table:
    """A table of a log: rows of a key either replace the one before (`active` is None), or stay, and turn inactive by tombstones."""

    name: str
    key: tuple[str, ...]
    schema: str
    active: str | None = None


def _path(spark: SparkSession, uri: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, uri: str) -> list[str]:
    at, fs = _path(spark, uri)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def committed(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(version, base) of every whole version that is kept, in order."""
    return sorted(tuple(map(int, n.split("."))) for n in _names(spark, f"{root}/_log") if n.replace(".", "").isdigit())


def current(spark: SparkSession, root: str) -> int | None:
    """The newest whole version; None before the first."""
    known = committed(spark, root)
    return known[-1][0] if known else None


def commit(spark: SparkSession, root: str, version: int, base: int | None = None) -> None:
    """Makes a version whole. Its base is that of the version before, unless named."""
    if base is None:
        base = max(b for v, b in committed(spark, root) if v < version)
    at, fs = _path(spark, f"{root}/_log/{version}.{base}")
    fs.create(at, True).close()


def create(root: str, tables: dict[Table, DataFrame]) -> None:
    """Version 0: the rows that there are at the start."""
    for t, df in tables.items():
        _write_base(df, root, t, 0)
        spark = df.sparkSession
    commit(spark, root, 0, 0)


def _write_base(df: DataFrame, root: str, t: Table, version: int) -> None:
    """Files of a size that adaptive execution picks, by ranges of the key, so that a reader of some keys skips most and a
    busy first key spans several."""
    df.repartitionByRange(*t.key).sortWithinPartitions(*t.key).write.mode("overwrite").parquet(f"{root}/{t.name}/base/v={version}")


def write_rows(df: DataFrame, root: str, t: Table, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{t.name}/rows/v={version}")


def write_gone(keys: DataFrame, root: str, t: Table, version: int) -> None:
    keys.select(*t.key).write.mode("overwrite").parquet(f"{root}/{t.name}/gone/v={version}")


def _deltas(spark: SparkSession, root: str, t: Table, kind: str, schema: str, base: int, version: int) -> DataFrame:
    """Rows or tombstones of the versions after the base, with their version as __v."""
    folder = f"{root}/{t.name}/{kind}"
    there = sorted(v for v in (int(n[2:]) for n in _names(spark, folder) if n.startswith("v=")) if base < v <= version)
    if not there:
        return spark.createDataFrame([], f"{schema}, __v int")
    reader = spark.read.schema(f"{schema}, v int").option("basePath", folder)
    return reader.parquet(*[f"{folder}/v={v}" for v in there]).withColumnRenamed("v", "__v")


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def read(spark: SparkSession, root: str, t: Table, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """A version's rows (the newest one's by default); of those whose first key column is in `only`, if that is given.

    Keys that changed after the base are counted and broadcast to its scan, so the base isn't shuffled; beyond the limit
    they are joined by shuffle.
    """
    known = committed(spark, root)
    if version is None:
        version = known[-1][0]
    bases = [b for v, b in known if v == version]
    if not bases:
        raise ValueError(f"{root} has no version {version}")
    base = bases[-1]
    rows = spark.read.schema(t.schema).parquet(f"{root}/{t.name}/base/v={base}").withColumn("__v", F.lit(base))
    late = _deltas(spark, root, t, "rows", t.schema, base, version)
    if only is not None:
        wanted = _near(only.select(t.key[0]).distinct())
        rows, late = (x.join(wanted, t.key[0], "left_semi") for x in (rows, late))
    columns = spark.createDataFrame([], t.schema).columns
    if t.active is None:
        newest = late.groupBy(*t.key).agg(F.max_by(F.struct(*columns), "__v").alias("r"))
        old = rows.join(_near(newest.select(*t.key)), list(t.key), "left_anti")
        return old.select(*columns).unionByName(newest.select("r.*"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], t.schema).select(*t.key).schema)
    gone = _deltas(spark, root, t, "gone", kinds, base, version).groupBy(*t.key).agg(F.max("__v").alias("__gone"))
    seen = rows.unionByName(late).join(_near(gone), list(t.key), "left")
    live = F.col(t.active) & F.coalesce(F.col("__gone") <= F.col("__v"), F.lit(True))
    return seen.withColumn(t.active, live).select(*columns)


def compact(spark: SparkSession, root: str, tables: list[Table], keep: int = 2) -> int:
    """Writes the newest version as a base, makes it count, and removes what the last `keep` versions don't need.

    A reader that has begun on one of those versions isn't disturbed: no file that is read is written anew.
    """
    version = current(spark, root)
    if (version, version) not in committed(spark, root):
        for t in tables:
            _write_base(read(spark, root, t, version), root, t, version)
        commit(spark, root, version, version)
    known = committed(spark, root)
    kept = sorted({v for v, _ in known})[-keep:]
    needed = [x for x in known if x[0] in kept]
    for v, b in known:
        if v not in kept:
            remove(spark, f"{root}/_log/{v}.{b}")
    first = min(b for _, b in needed)
    for t in tables:
        for kind in ("rows", "gone", "base"):
            for v in (int(n[2:]) for n in _names(spark, f"{root}/{t.name}/{kind}") if n.startswith("v=")):
                if (kind == "base" and v not in {b for _, b in needed}) or (kind != "base" and v <= first):
                    remove(spark, f"{root}/{t.name}/{kind}/v={v}")
    return version
