"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White-space runs and the two kinds of words that the operators count.
SPACE = r"[\x20\x09-\x0D]+"
NONSPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = {c: c + 32 for c in range(65, 91)}
_ALNUM = re.compile(ALNUM)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_az(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def tidied(run: Callable) -> Callable:
    """A task function after which its Python worker, which Spark keeps for later tasks, returns freed memory to the machine."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def alnum_words(text: str) -> list[str]:
    return _ALNUM.findall(lower_az(text))


def space_words(text: str) -> list[bytes]:
    """Lower-cased words as UTF-8. bytes.split() splits at exactly the six characters of SPACE."""
    return text.encode("utf-8", "replace").lower().split()


def text_blocks(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive slices of at most `limit` bytes of text, or of one text that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of space_words() in some texts, each word's place among them, and the texts' numbers of words.

    Arrow splits and encodes whole batches; Python sees a distinct word once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # blanks at a text's ends leave empty words
    upto = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)]
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), np.diff(upto[split.offsets.to_numpy()])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the cluster's shared folder (spark.checkpoint.dir); a local one is set only where none is."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="cairn-shared-")


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores more if the columns have it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcasts a side whose counted rows are within the limit; a larger one is left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df
