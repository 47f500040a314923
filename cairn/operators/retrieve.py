"""Exact cosine retrieval for a table of questions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import scratch, staged

#: Questions of about one tile; so many may go to every task. Chunks of about one tile.
QUESTION_BLOCK, CHUNK_BLOCK = 16_000, 40_000
#: Hits of so many rows are broadcast to the scans of texts and sources.
BROADCAST_HITS = 200_000
#: Clusters that chunks are filed under, and vectors that their centres are fitted on.
CLUSTERS, CENTRE_SAMPLE = 256, 20_000
#: Distances that a task holds at a time.
CELLS = 4_000_000
#: Questions or chunks that are passed on and multiplied as one stack, where a tile is not larger.
STACK = 4_000


def active(chunks: DataFrame) -> DataFrame:
    return chunks.where("is_active")


def _vectors(column: pa.ListArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that are not null, not zero and of the dimension, and which rows they are."""
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == dimension)
    if not len(rows) or not dimension:
        return np.zeros((0, dimension)), np.zeros(0, np.int64)
    m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    length = np.linalg.norm(m, axis=1)
    good = length > 0  # not for vectors with a null either
    return m[good] / length[good, None], rows[good]


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k smallest finite values, ties by id."""
    rounded = d.round(12)
    edge = np.partition(rounded, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
    i, j = np.nonzero((rounded <= edge) & np.isfinite(rounded))
    order = np.lexsort((ids[j], rounded[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


_HITS = "question_id long, chunk_id long, source_id long, distance double"


@dataclass(frozen=True)
class Asked:
    """Questions as unit vectors."""

    vectors: np.ndarray
    ids: np.ndarray
    traditions: np.ndarray

    @staticmethod
    def of(table: pa.Table, dimension: int) -> Asked:
        column = table.column("asked").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32()))
        q, at = _vectors(column, dimension)
        plain = lambda c: np.array(table.column(c).to_pylist(), dtype=object)[at]
        return Asked(q, plain("question_id"), plain("wanted"))


def _hits(asked: Asked, chunks: pa.RecordBatch | pa.Table, dimension: int, k: int, threshold: float | None, by_tradition: bool, cells: int) -> Iterator[pa.RecordBatch]:
    """The k best of some chunks for each question, `cells` distances at a time."""
    column = chunks.column("embedding")
    c, rows = _vectors(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, dimension)
    if not len(c) or not len(asked.vectors):
        return
    chunk, source = (chunks.column(n).to_numpy()[rows] for n in ("chunk_id", "source_id"))
    own = np.array(chunks.column("tradition").to_pylist(), dtype=object)[rows] if by_tradition else None
    strip = max(1, cells // len(c))
    for s in range(0, len(asked.vectors), strip):
        d = 1 - asked.vectors[s : s + strip] @ c.T
        if by_tradition:
            wanted = asked.traditions[s : s + strip]
            for t in set(wanted) - {None}:
                d[np.ix_(wanted == t, own != t)] = np.inf
        if threshold is not None:
            # a margin for rounding; the exact cut is made after the join of all tasks
            d[d > threshold + 1e-9] = np.inf
        i, j = _best(d, chunk, k)
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[s + i].tolist(), pa.int64()), pa.array(chunk[j], pa.int64()), pa.array(source[j], pa.int64()), pa.array(d[i, j])], ["question_id", "chunk_id", "source_id", "distance"])


def _asked(questions: DataFrame, by_tradition: bool) -> tuple[DataFrame, int, int]:
    """question_id, asked, wanted (vector and tradition) of the questions, their number, and the one dimension of their vectors.
    The names are not those of chunks, which may be the same table: a cogroup would take columns of one origin for one."""
    ordered = questions.select("question_id", F.col("embedding").alias("asked"), (F.col("tradition") if by_tradition else F.lit(None).cast("string")).alias("wanted"))
    size = F.nullif(F.size(F.coalesce("asked", F.array().cast("array<float>"))), F.lit(0))
    n, least, dimension = ordered.agg(F.count("*"), F.min(size), F.max(size)).first()
    if least != dimension:
        raise ValueError(f"questions have vectors of {least} and of {dimension} dimensions")
    return ordered, n, dimension or 0


def _multiplied(questions: DataFrame, chunks: DataFrame, tile: list[str], dimension: int, k: int, threshold: float | None, by_tradition: bool, cells: int) -> DataFrame:
    """Products of the questions and chunks of each tile, which both have in the columns `tile`: one task a tile."""

    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found = list(_hits(Asked.of(q, dimension), c, dimension, k, threshold, by_tradition, cells)) if len(q) and len(c) else []
        kind = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.int64()), ("source_id", pa.int64()), ("distance", pa.float64())])
        return pa.Table.from_batches(found, kind)

    return questions.groupBy(*tile).cogroup(chunks.groupBy(*tile)).applyInArrow(run, _HITS)


def _first(found: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """The k best of what the tiles have found."""
    if threshold is not None:
        found = found.where(F.round("distance", 9) <= threshold)
    w = Window.partitionBy("question_id").orderBy(F.round("distance", 12), "chunk_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _stacks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """The rows of each batch of a task as stacks of up to `size` rows: an Arrow stream a stack, in the column `name`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, b.schema) as w:
                    w.write_batch(b.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], [name])

    return rows.mapInArrow(run, f"{name} binary")


def _merged(found: list[pa.RecordBatch], k: int) -> list[pa.RecordBatch]:
    """The k best hits of each question in one batch, ties by chunk."""
    t = pa.Table.from_batches(found).combine_chunks()
    q, c, d = (t.column(n).to_numpy() for n in ("question_id", "chunk_id", "distance"))
    order = np.lexsort((c, d.round(12), q))
    place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    return t.take(pa.array(order[place < k])).combine_chunks().to_batches()


def _every_pair(questions: DataFrame, chunks: DataFrame, dimension: int, k: int, threshold: float | None, by_tradition: bool, cells: int) -> DataFrame:
    """Products of all stacks of questions (`asked`) with all of chunks (`filed`), of each task the k best of a question.

    A cross join by pairs of partitions, each of which reads its two from where the stacks are stored: no copy of a row is
    written, however many pairs there are. A task has the pairs of one stack of questions one after the other.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asked, found = None, None, []
        for b in batches:
            for x, y in zip(b.column("asked"), b.column("filed"), strict=True):
                if last is None or not last.equals(x.as_buffer()):
                    yield from found
                    last, found = pa.py_buffer(x.as_py()), []
                    asked = Asked.of(pa.ipc.open_stream(last).read_all(), dimension)
                new = [h for h in _hits(asked, pa.ipc.open_stream(y.as_buffer()).read_all(), dimension, k, threshold, by_tradition, cells) if h.num_rows]
                found = _merged(found + new, k) if new else found
        yield from found

    return questions.hint("shuffle_replicate_nl").crossJoin(chunks).mapInArrow(run, _HITS)


def nearest(questions: DataFrame, chunks: DataFrame, k: int = V.TOP_K, threshold: float | None = V.RELEVANCE, by_tradition: bool = True, block: int = QUESTION_BLOCK, cells: int = CELLS, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """question_id, chunk_id, source_id, distance, place: the k nearest chunks of each question, ties by chunk_id.

    Up to `block` questions, counted first, go to the tasks that scan the chunks, which are then not shuffled. More are a
    table of tiles: stacks of up to `block` questions and of up to `chunk_block` chunks (STACK rows where that is more, or
    passing them on would take longer than the products) are stored once, and each task multiplies all of its stacks of
    questions with all of its stacks of chunks, `cells` distances at a time, so that no question passes through the driver
    and the disk holds either table once, however many tiles there are. A task passes only its own k best on, of which
    the best are kept. A question's tradition, if not null, must equal the chunk's exactly.

    Questions' vectors have one dimension, or it is an error; null, empty and zero vectors have
    no hits. Chunks whose vector is null, zero or of another dimension are no hits, in whatever
    order they come.
    """
    base = chunks.select("chunk_id", "source_id", "embedding", *(["tradition"] if by_tradition else []))
    ordered, n, dimension = _asked(questions, by_tradition)
    if n <= block:
        sent = chunks.sparkSession.sparkContext.broadcast(Asked.of(ordered.toArrow(), dimension))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _hits(sent.value, b, dimension, k, threshold, by_tradition, cells)

        return _first(base.mapInArrow(run, _HITS), k, threshold)
    folder = scratch(chunks.sparkSession)
    q = staged(_stacks(ordered, max(block, STACK), "asked"), f"{folder}/questions")
    c = staged(_stacks(base, max(chunk_block, STACK), "filed"), f"{folder}/chunks")
    return _first(_every_pair(q, c, dimension, k, threshold, by_tradition, cells), k, threshold)


def fit_centres(chunks: DataFrame, clusters: int = CLUSTERS, sample: int = CENTRE_SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centres of the chunks' directions: spherical k-means in numpy over about `sample` vectors, chosen by hash."""
    n = chunks.count()
    some = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // sample))) == 0).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(2 * sample).select("embedding").toArrow()
    column = some.column("embedding").combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float32()))
    sizes = pc.list_value_length(column).drop_null().to_numpy(zero_copy_only=False)
    v, _ = _vectors(column, int(np.bincount(sizes).argmax()) if len(sizes) else 0)
    centres = v[:: max(1, len(v) // clusters)][:clusters]
    for _ in range(rounds if len(v) else 0):
        near = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), centres)
    return centres


def filed(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds `cluster` and `gap`, the nearest centre and the distance of the unit vectors. Vectors that can't be hits go."""
    sent, kind = chunks.sparkSession.sparkContext.broadcast(centres), chunks.schema.fields

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            v, rows = _vectors(b.column("embedding"), m.shape[1])
            if len(v):
                near = v @ m.T
                at = near.argmax(1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(v)), at]))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, pa.array(at, pa.int32()), pa.array(gap)], [*b.schema.names, "cluster", "gap"])

    return chunks.mapInArrow(run, StructType([*kind, StructField("cluster", IntegerType()), StructField("gap", DoubleType())]))


def clusters_to_ask(questions: DataFrame, sizes: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """The questions with the clusters and tiles in which a hit may be.

    On unit vectors a cosine distance t is a chord of sqrt(2 t). A chunk at `gap` from its centre is at least |gap - g| from a
    question at g from that centre, so a cluster whose gaps are all further than the chord from g has no hit.
    """
    rows = sizes.select("cluster", "least", "most", "tiles").toArrow()  # a row a cluster
    sent = questions.sparkSession.sparkContext.broadcast((centres, *[rows.column(c).to_numpy() for c in rows.column_names]))
    reach = np.sqrt(2 * max(threshold, 0)) + 1e-6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cluster, least, most, tiles = sent.value
        for b in batches:
            v, at = _vectors(b.column("asked"), m.shape[1])
            if not len(v) or not len(cluster):
                continue
            g = np.sqrt(np.maximum(0, 2 - 2 * v @ m[cluster].T))
            i, j = np.nonzero((g <= most + reach) & (g >= least - reach))
            again = np.repeat(np.arange(len(i)), tiles[j])
            tile = np.arange(len(again)) - np.repeat(np.cumsum(tiles[j]) - tiles[j], tiles[j])
            out = b.take(pa.array(at[i[again]]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cluster[j[again]], pa.int32()), pa.array(tile, pa.int32())], [*out.schema.names, "cluster", "tile"])

    return questions.mapInArrow(run, StructType([*questions.schema.fields, StructField("cluster", IntegerType()), StructField("tile", IntegerType())]))


def nearest_pruned(questions: DataFrame, chunks: DataFrame, centres: np.ndarray, k: int = V.TOP_K, threshold: float = V.RELEVANCE, by_tradition: bool = True, cells: int = CELLS, chunk_block: int = CHUNK_BLOCK, filing: DataFrame | None = None) -> DataFrame:
    """The rows of nearest(), found in the clusters that may hold a hit within the threshold. Exact for any centres.

    Each chunk is filed under its nearest centre (`filing`: what filed() has given and was stored), a cluster of many
    chunks in several tiles. A question goes only to the tiles of clusters that its bounds don't rule out, and only these
    are multiplied.
    """
    ordered, _, dimension = _asked(questions, by_tradition)
    base = chunks.select("chunk_id", "source_id", "embedding", *(["tradition"] if by_tradition else []))
    if not len(centres) or centres.shape[1] != dimension:  # no chunk of the questions' dimension was in the sample
        return nearest(questions, chunks, k, threshold, by_tradition, cells=cells, chunk_block=chunk_block)
    files = filed(base, centres) if filing is None else filing
    sizes = files.groupBy("cluster").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.ceil(F.count("*") / chunk_block).cast("int").alias("tiles"))
    tiled = files.join(F.broadcast(sizes.select("cluster", "tiles")), "cluster").withColumn("tile", F.pmod(F.xxhash64("chunk_id"), F.col("tiles")).cast("int")).drop("tiles", "gap")
    asked = clusters_to_ask(ordered, sizes, centres, threshold)
    return _first(_multiplied(asked, tiled, ["cluster", "tile"], dimension, k, threshold, by_tradition, cells), k, threshold)


def by_provenance(hits: DataFrame) -> DataFrame:
    """Adds `position`: a stable order by provenance tier, then by place. Never drops a hit."""
    w = Window.partitionBy("question_id").orderBy(T.provenance_rank(F.col("author_position")), "place")
    return hits.withColumn("position", F.row_number().over(w))


def with_texts(hits: DataFrame, chunks: DataFrame, most: int, limit: int = BROADCAST_HITS) -> DataFrame:
    """Hits (at most `most` rows) with the texts of their chunks, without a shuffle of texts that aren't hit.

    Few hits are broadcast to the scan of the texts. Of more, which are then stored once, the distinct ids are, and only the
    texts that they leave are shuffled; where even ids are too many, that is what a shuffle of all texts is for.
    """
    texts = chunks.select("chunk_id", "chunk_text")
    if most <= limit:
        return texts.join(F.broadcast(hits), "chunk_id")
    hits = staged(hits, scratch(hits.sparkSession))
    ids = hits.select("chunk_id").distinct()
    near = texts.join(F.broadcast(ids), "chunk_id", "left_semi") if ids.count() <= 20 * limit else texts
    return near.join(hits, "chunk_id")


def retrieve(questions: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = V.TOP_K, threshold: float | None = V.RELEVANCE, centres: np.ndarray | None = None, limit: int = BROADCAST_HITS) -> DataFrame:
    """Active chunks within the threshold, the k nearest of each question, with their sources, by provenance.

    Sources and texts join after the top k, when few rows are left, and are not shuffled for it (see with_texts); only the
    tradition, which decides what may be a hit, comes before. With `centres`, clusters that can't hold a hit are skipped.
    """
    live = active(chunks).join(sources.select("source_id", "tradition"), "source_id")
    hits = nearest(questions, live, k, threshold) if centres is None or threshold is None else nearest_pruned(questions, live, centres, k, threshold)
    most = questions.count() * k
    known = sources.join(F.broadcast(hits), "source_id") if most <= limit else hits.join(sources, "source_id")
    return by_provenance(with_texts(known, chunks, most, limit))


def refuse(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, refused, answer: questions without a hit get the fixed refusal, others a null answer for a model to fill."""
    answered = hits.select("question_id").distinct().withColumn("hit", F.lit(True))
    refused = F.col("hit").isNull()
    return questions.select("question_id").join(answered, "question_id", "left").select("question_id", refused.alias("refused"), F.when(refused, V.REFUSAL).alias("answer"))
