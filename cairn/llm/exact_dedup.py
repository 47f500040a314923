"""Grace hash deduplication over whole texts."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_broadcast, checkpointed, tidied

#: Bytes of text that one task holds in its table before it partitions to files.
TABLE_BYTES = 48 << 20
#: Rows to drop, up to which their ids and digests are broadcast to the texts.
BROADCAST_ROWS = 200_000
#: Repeats of one row that are made at a time.
_REPEATS = 1 << 16
_FAN = 16
_HEAD = struct.Struct("<QqqBI")


class TextTable:
    """Open addressing with linear probing; entries are equal only if their complete bytes are."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.best: list[int | None] = []
        self.count: list[int] = []
        self.bytes = 0

    def _slot(self, h: int, text: bytes) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (e := slots[i]) >= 0 and not (self.hashes[e] == h and self.texts[e] == text):
            i = (i + 1) & mask
        return i

    def add(self, h: int, text: bytes, doc_id: int | None, n: int) -> None:
        i = self._slot(h, text)
        e = self.slots[i]
        if e >= 0:
            self.count[e] += n
            if doc_id is not None and (self.best[e] is None or doc_id < self.best[e]):
                self.best[e] = doc_id
            return
        self.slots[i] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.best.append(doc_id)
        self.count.append(n)
        self.bytes += len(text) + 120
        if 2 * len(self.texts) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for k, x in enumerate(self.hashes):
                i, mask = x & (len(self.slots) - 1), len(self.slots) - 1
                while self.slots[i] >= 0:
                    i = (i + 1) & mask
                self.slots[i] = k

    def rows(self) -> Iterator[tuple[int, bytes, int | None, int]]:
        return zip(self.hashes, self.texts, self.best, self.count, strict=True)


def _spilled(path: str) -> Iterator[tuple[int, bytes, int | None, int]]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            h, doc_id, n, known, size = _HEAD.unpack(head)
            yield h, f.read(size), doc_id if known else None, n


def grace_groups(rows: Iterable[tuple[int, bytes, int | None, int]], folder: str, limit: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[int, bytes, int | None, int]]:
    """(hash, text, id, n) rows to one row for each distinct text: smallest id, summed n.

    Rows go into one table until it holds `limit` bytes; then it and all later rows are dealt
    to files by four more bits of the hash, and each file is treated in the same way.
    """
    table, files, paths = TextTable(), None, []

    def spill(h: int, text: bytes, doc_id: int | None, n: int) -> None:
        f = files[(h >> (60 - 4 * level)) & (_FAN - 1)]
        f.write(_HEAD.pack(h, doc_id or 0, n, doc_id is not None, len(text)))
        f.write(text)

    for row in rows:
        if files is not None:
            spill(*row)
            continue
        table.add(*row)
        if table.bytes > limit and level < 15:
            paths = [os.path.join(folder, f"{level}-{os.urandom(6).hex()}") for _ in range(_FAN)]
            files = [open(p, "wb") for p in paths]  # noqa: SIM115
            for kept in table.rows():
                spill(*kept)
            table = TextTable()
    if files is None:
        yield from table.rows()
        return
    for f in files:
        f.close()
    for p in paths:
        yield from grace_groups(_spilled(p), folder, limit, level + 1)
        os.unlink(p)


def _hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")


def _task(final: bool, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, bytes, int | None, int]]:
            for b in batches:
                texts, ids, counts = b.column("content"), b.column("best"), b.column("n")
                for i in range(b.num_rows):
                    text = texts[i].as_py()
                    yield _hash(text), text, ids[i].as_py(), counts[i].as_py()

        def out(rows: list) -> pa.RecordBatch:
            h, texts, ids, n = zip(*rows, strict=True)
            if final:
                return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["digest", "best", "n"])
            return pa.RecordBatch.from_arrays([pa.array([x - (x >> 63 << 64) for x in h], pa.int64()), pa.array(texts, pa.binary()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["h", "content", "best", "n"])

        with tempfile.TemporaryDirectory() as folder:
            ready, size = [], 0
            for row in grace_groups(rows(), folder, limit):
                ready.append(row)
                size += len(row[1])
                if size > 4 << 20 or len(ready) >= 4000:
                    yield out(ready)
                    ready, size = [], 0
            if ready:
                yield out(ready)

    return run


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ").cast("binary")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each white-space run became one space; a null text
    counts as empty. Each scan task first merges its own copies, so a group of any size sends
    one text per task; the merged texts are dealt by hash and merged again in Grace tables that
    compare complete texts. The rows then meet their group by digest, in a join of short rows
    that Spark may split where a group is hot.

    A null doc_id sorts after all others; a group of only null ids has a null keep_id. Of
    repeated rows (same id, same text) exactly one is kept; however often a row is repeated, its
    repeats are made in blocks. Texts of any length are compared whole, one at a time where they
    are longer than a table. An empty table gives no rows; other columns are not read, so their
    names don't matter.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("best"), _normal(F.col(text)).alias("content"))
    merged = plain.withColumn("n", F.lit(1).cast("long")).mapInArrow(tidied(_task(False, table_bytes)), "h long, content binary, best long, n long")
    groups = merged.repartition("h").select("content", "best", "n").mapInArrow(tidied(_task(True, table_bytes)), "digest string, best long, n long")
    # repeated rows are counted, not windowed, so that a third of all rows may be one repeated row
    rows = plain.select("best", F.sha2("content", 256).alias("digest")).groupBy("digest", "best").agg(F.count("*").alias("same"))
    joined = rows.join(groups.select("digest", F.col("best").alias("keep_id"), F.col("n").alias("group_size")), "digest")
    # the row that may be kept first, then the repeats
    kept = F.struct(F.col("best").eqNullSafe(F.col("keep_id")).alias("kept"), F.lit(1).cast("long").alias("rows"))
    last = F.ceil((F.col("same") - 1) / _REPEATS)
    more = F.transform(F.sequence(F.lit(1).cast("long"), last), lambda k: F.struct(F.lit(False).alias("kept"), F.least(F.lit(_REPEATS), F.col("same") - 1 - (k - 1) * _REPEATS).alias("rows")))
    blocks = joined.select("*", F.explode(F.when(F.col("same") > 1, F.concat(F.array(kept), more)).otherwise(F.array(kept))).alias("b"))
    each = blocks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("b.rows"))))
    return each.select(F.col("best").alias("doc_id"), "keep_id", "group_size", F.col("b.kept").alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names. Of repeated rows (same id and text) one stays; a
    null text equals an empty one, a null id sorts last; an empty table gives no rows. Texts of any length are kept as they
    are, and go through no further shuffle unless more than BROADCAST_ROWS rows are dropped."""
    found = exact_duplicates(docs, doc_id, text)
    judged = checkpointed(found.groupBy("doc_id", F.col("text_sha256").alias("digest")).agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"))
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("own_id"), F.sha2(_normal(F.col(text)), 256).alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))
    away, again = judged.where("not stays"), judged.where("stays")
    kept, n = whole.join(bounded_broadcast(away, away.count(), BROADCAST_ROWS), same, "left_anti"), again.count()
    if n:
        side = bounded_broadcast(again, n, BROADCAST_ROWS)
        one = kept.join(side, same, "left_semi").groupBy("own_id", "own").agg(F.first("row").alias("row"))
        kept = kept.join(side, same, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")
