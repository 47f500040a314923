"""Encoders over text columns, and vector scalars."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(dimension: int = V.DIMENSION) -> Encoder:
    """The default encoder: signed hashed bag of lower-cased words, L2-normalised. Any other factory can take its place.

    Words are coded in Arrow and hashed once each; vectors are sums over the pairs of text and place.
    """
    known: dict[str, int] = {}

    def place(w: str) -> int:
        """A word's place, and the bit that is its sign."""
        if len(known) > 200_000:
            known.clear()
        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:4])
        known[w] = out = 2 * (h % dimension) + (h >> 16 & 1)
        return out

    def encode(texts: list[str]) -> np.ndarray:
        words = list(map(str.split, map(str.lower, texts)))
        coded = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        of_word = np.array([known[w] if w in known else place(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(words)))
        sums = np.bincount(row * dimension + of_word // 2, of_word % 2 * 2 - 1, len(texts) * dimension).reshape(len(texts), dimension)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        return sums / np.where(norm == 0, 1, norm)

    return encode


_EMBEDDED = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())])


def _vectors(encoder: Encoder, texts: list[str]) -> pa.StructArray:
    """Vectors and errors. Where a batch fails, its halves are encoded, so that only the texts that fail have none."""
    try:
        m = np.ascontiguousarray(encoder(texts), "f4")
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
        return pa.StructArray.from_arrays([vectors, pa.nulls(len(texts), pa.string())], fields=list(_EMBEDDED))
    except Exception as e:
        if len(texts) == 1:
            return pa.array([{"vector": None, "error": f"{type(e).__name__}: {e}"}], _EMBEDDED)
    half = len(texts) // 2
    return pa.concat_arrays([_vectors(encoder, texts[:half]), _vectors(encoder, texts[half:])])


def embed(df: DataFrame, text: str, to: str = "embedding", factory: Callable[[], Encoder] = hashed_words, is_query: bool = False, batch: int = 500, errors: str | None = None) -> DataFrame:
    """Adds an array<float> column. The encoder is made once in a Python worker; the key stays in the row, so order is no matter.

    With `errors`, that column says why a text has no vector (null where it has one). Without, a text that the encoder
    fails on ends the query.
    """

    @F.arrow_udf("struct<vector:array<float>,error:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = factory()
        for s in parts:
            texts = s.fill_null("").to_pylist()
            done = [_vectors(encoder, texts[k : k + batch]) for k in range(0, len(texts), batch)]
            yield pa.concat_arrays(done) if done else pa.array([], _EMBEDDED)

    free = "__embedded"
    out = df.withColumn(free, run(T.query_text(F.col(text)) if is_query else F.col(text)))
    failed = F.col(f"{free}.error")
    if errors is None:
        return out.withColumn(to, F.when(failed.isNull(), F.col(f"{free}.vector")).otherwise(F.raise_error(failed).cast("array<float>"))).drop(free)
    return out.withColumns({to: F.col(f"{free}.vector"), errors: failed}).drop(free)


def embed_new(chunks: DataFrame, errors: str | None = None, **how) -> DataFrame:
    """Embeds each distinct chunk_hash once and joins the vectors (and errors, if named) back."""
    distinct = chunks.groupBy("chunk_hash").agg(F.min("chunk_text").alias("chunk_text"))
    vectors = embed(distinct, "chunk_text", errors=errors, **how).drop("chunk_text")
    return chunks.join(vectors, "chunk_hash")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """v / |v|; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 same, 1 orthogonal, 2 opposite; null for a null or zero vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))
