"""Word-bounded chunks of documents: a fold over word counts, then slices of the word array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..functions.arrays import let, scan

_SPANS = "array<struct<start:int,len:int>>"
#: How a unit of words joins the span before it: if there is room, never, or with an overlap where there is none.
_PACK, _OPEN, _FLOW = 0, 1, 2


def _units(paras: Column, size: int) -> Column:
    """Paragraphs as units (n: words, m: mode). One of more than `size` words is a unit a sentence and closes the span before
    it; so does the paragraph after it."""
    unit = lambda n, m: F.struct(n.cast("int").alias("n"), F.lit(m).alias("m") if isinstance(m, int) else m.alias("m"))

    def of(p: Column, i: Column) -> Column:
        after_long = F.coalesce(F.try_element_at(paras, F.nullif(i, F.lit(0)))["n"] > size, F.lit(False))
        sentences = F.transform(p["s"], lambda c, k: unit(c, F.when(k == 0, _OPEN).otherwise(_FLOW)))
        return F.when(p["n"] > size, sentences).otherwise(F.array(unit(p["n"], F.when(after_long, _OPEN).otherwise(_PACK))))

    return F.flatten(F.transform(paras, of))


def chunk_spans(size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP, paras: Column | None = None) -> Column:
    """(start, len) word spans of paragraphs (n: words, s: words of each sentence), from the column `paras` by default.

    Paragraphs fill a span of at most `size` words. A longer one closes it and is filled by
    sentences, each new span beginning with the last `overlap` words of the one before; a
    sentence is never cut.
    """
    if size <= 0:
        raise ValueError("size must be above 0")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    int_ = lambda c: c.cast("int")

    def step(z: Column, u: Column) -> Column:
        full = z["len"] + u["n"] > size
        shared = F.when((u["m"] == _FLOW) & full, F.least(F.lit(overlap), z["len"])).otherwise(0)
        closes = (z["len"] > 0) & ((u["m"] == _OPEN) | full)
        closed = F.when(closes, F.array(F.struct(z["start"].alias("start"), z["len"].alias("len")))).otherwise(F.array().cast(_SPANS))
        begins = closes | (z["len"] == 0)
        now = F.struct(int_(F.when(begins, z["start"] + z["len"] - shared).otherwise(z["start"])).alias("start"), int_(F.when(begins, shared + u["n"]).otherwise(z["len"] + u["n"])).alias("len"))
        return F.struct(now.alias("s"), closed.alias("out"))

    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"))
    last = lambda z: F.when(z["s"]["len"] > 0, F.concat(z["out"], F.array(z["s"]))).otherwise(z["out"])
    return let(F.col("paras") if paras is None else paras, lambda p: let(scan(_units(p, size), none, step, "out", _SPANS), last))


def paragraph_counts(text: Column) -> Column:
    count = lambda c: F.size(T.word_tokens(c))
    return F.transform(T.split_paragraphs(text), lambda p: F.struct(count(p).alias("n"), F.transform(T.split_sentences(p), count).alias("s")))


def chunk_texts(text: Column, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """The chunks of a text as an array, in time linear in the text: words and spans are made once a row."""
    spans = chunk_spans(size, overlap, paragraph_counts(text))
    cut = lambda words: F.transform(spans, lambda s: F.array_join(F.slice(words, s["start"] + 1, s["len"]), " "))
    return let(T.word_tokens(text), cut)


def chunk_hashes(df: DataFrame, key: str, text: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """key, hashes: each document's distinct chunk hashes as an array, without an aggregation (so for streams, too)."""
    hashes = F.transform(chunk_texts(F.col(text), size, overlap), lambda c: F.sha2(c.cast("binary"), 256))
    return df.select(F.col(key), F.array_distinct(hashes).alias("hashes"))


def chunk(df: DataFrame, key: str, text: str, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_no (from 0), chunk_text. Every chunk is a slice of the document's words; blank texts have none. Texts are
    cut before the rows are made, which then carry the key and the chunk alone."""
    return df.select(F.col(key), F.posexplode(chunk_texts(F.col(text), size, overlap)).alias("chunk_no", "chunk_text"))
