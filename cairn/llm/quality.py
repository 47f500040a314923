"""A quality classifier from compression with two zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, checkpointed, fold

#: Bytes of a text that are compressed at a time.
BLOCK = 256
#: Labelled documents that the fit chooses up to this many a class are broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float
    level: int

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """With the good and the bad dictionary."""
        return [zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]

    def scorer(self):
        if not self.good or not self.bad:
            return lambda data: self.prior
        good, bad = self.compressors()
        return lambda data: _sigmoid(self.slope * _difference(good, bad, data) + self.offset) if data else self.prior


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _difference(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, data: bytes) -> float:
    """Sizes under the bad and the good dictionary, as a share of their sum: above 0 if the good one fits better.

    A text is compressed block by block, so that a long one doesn't become its own dictionary.
    """
    g = b = 0
    for block in blocks(data):
        g += len(good.compress(block))
        b += len(bad.compress(block))
    return (b - g) / (b + g)


def blocks(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        trained = zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to choose from: all of it is the dictionary
        trained = b""
    return trained or b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton's method on one feature and a constant, with a small ridge."""
    scale = x.std() or 1.0
    a = np.stack([(x - x.mean()) / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def chosen_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, quality, n: at most `per_class` labelled documents of each class outside the held-out fold, the first by hash."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    first = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    return first[0].unionByName(first[1]).select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit("third")), F.lit(3)).alias("third"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int, per_dictionary: int, dict_bytes: int, level: int) -> CompressionModel:
    """Dictionaries from two thirds of the chosen texts, the calibration from the other third.

    A dictionary learns from at most `per_dictionary` blocks of its class, the first by hash of all blocks of the whole
    texts. The third's whole texts are compressed in tasks, and only their size differences come here. Of texts that
    repeat an id, the smallest counts. Without texts of both classes the score is constant: the share of the class there
    is, or a half.
    """
    chosen = checkpointed(chosen_labels(labels, per_class))
    side = bounded_broadcast(chosen, 2 * per_class, BROADCAST_ROWS)
    data = F.encode(F.col("text").cast("string"), "UTF-8")
    texts = docs.where(F.octet_length("text") > 0).select("doc_id", "text").join(side, "doc_id").groupBy("doc_id", "quality", "third").agg(F.min("text").alias("text"))
    texts = checkpointed(texts.select("doc_id", "quality", "third", data.alias("data")))
    n = {(r["quality"], r["own"]): r["n"] for r in texts.groupBy("quality", (F.col("third") == 0).alias("own")).agg(F.count("*").alias("n")).collect()}
    size = [n.get((q, True), 0) + n.get((q, False), 0) for q in (0, 1)]
    prior = (size[1] + 1) / (sum(size) + 2)
    if min(n.get((q, own), 0) for q in (0, 1) for own in (True, False)) == 0:
        return CompressionModel(b"", b"", 0.0, 0.0, prior, level)
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / BLOCK).cast("int"))
    cut = texts.where("third > 0").select("doc_id", "quality", F.posexplode(F.transform(starts, lambda k: F.substring(F.col("data"), k * BLOCK + 1, F.lit(BLOCK)))).alias("no", "block"))
    first = [cut.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id", "no"), "doc_id", "no").limit(per_dictionary).select("block").collect() for q in (0, 1)]  # bounded by per_dictionary
    bad, good = (_dictionary([bytes(r["block"]) for r in rows], dict_bytes) for rows in first)
    model = CompressionModel(good, bad, 1.0, 0.0, prior, level)

    def differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([_difference(*compressors, x.as_py()) for x in b.column("data")], pa.float64())], ["doc_id", "quality", "x"])

    third = texts.where("third = 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "data")
    rows = sorted(map(tuple, third.mapInArrow(differences, "doc_id long, quality int, x double").collect()))  # at most 2 * per_class numbers
    slope, offset = _logistic(np.array([x for _, _, x in rows]), np.array([float(q) for _, q, _ in rows]))
    return CompressionModel(good, bad, slope, offset, prior, level)


def scored(docs: DataFrame, model: CompressionModel, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of each whole text under a model."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            s = np.array([of((x.as_py() or "").encode("utf-8", "replace")) for x in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = 2500, per_dictionary: int = 20_000, dict_bytes: int = 16 << 10, level: int = 1, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Two dictionaries are built from labelled texts outside the held-out fold; every whole text
    is compressed with both, in blocks, and the difference of sizes over their sum goes through a logistic
    curve fitted on training texts that the dictionaries have not seen. The fit chooses at most
    `per_class` whole texts of a class, and `per_dictionary` of their blocks for a dictionary.

    Null and empty texts score the share of good texts in training. Labels that are null, not 0
    or 1, or contradict each other are not learned from; without two classes the score is
    constant. Repeated rows each get their score; texts of any length are scored whole; an empty
    table gives no rows; extra columns are not read.
    """
    return scored(docs, fit(docs.select("doc_id", "text"), labels, per_class, per_dictionary, dict_bytes, level), threshold)
