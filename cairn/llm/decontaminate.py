"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, checkpointed

WINDOW = 13
#: Benchmark-side rows up to this many, and of so many bytes, are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(text: Column) -> Column:
    """A-Z in lower case; lower() would change letters beyond ASCII too, so only all-ASCII texts get it."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _AZ, _az))


def word_array(text: Column) -> Column:
    """Words of letters, digits and everything beyond ASCII, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(lower_az(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), "")


def _fits(df: DataFrame, column: Column, limit: int) -> bool:
    """Whether the rows, and the bytes of their one column of text, may be broadcast."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(column))).first()
    return n <= limit and (size or 0) <= BROADCAST_BYTES


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("words", word_array(F.col(text)))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, gram: every window of `window` words; an item of fewer words is one window."""
    items = _words(benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text").where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at") + 1, window).alias("gram")).distinct()


def rarest_words(docs_words: DataFrame, grams: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Adds to each distinct gram its rarest word in the documents, and where the gram has it first."""
    vocabulary = checkpointed(grams.select(F.explode("gram").alias("word")).distinct())
    side = F.broadcast(vocabulary) if _fits(vocabulary, F.col("word"), limit) else vocabulary
    seen = docs_words.select(F.explode("words").alias("word")).join(side, "word", "left_semi").groupBy("word").agg(F.count("*").alias("freq"))
    terms = grams.select("gram", F.posexplode("gram").alias("offset", "word")).join(seen, "word", "left")
    rarest = F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "word", "offset")).alias("r")
    # a word that no document has leaves its gram without candidates
    return terms.groupBy("gram").agg(rarest).where("r.freq > 0").select("gram", F.size("gram").alias("len"), "r.word", "r.offset")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = 20, limit: int = BROADCAST_ROWS, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Every benchmark window is a set of positioned words that a document must contain whole, so
    one prefix word is enough: its rarest over all documents. Documents' words are joined to
    these words; length and position bounds drop places where the window would not fit, and the
    words around a place are compared with the window exactly. Hit words are the union of the
    verified spans.

    Null text has no words; it is not contaminated. A null doc_id is an id. Rows that repeat an
    id and text each get the same result; the same id with another text is judged apart. An
    empty benchmark hits nothing; a null item_id counts as an item named by an empty string. An
    empty table gives no rows. Texts of any length are read whole. Extra columns are not read. `keyed` adds the hash of id and text that tells rows apart.
    """
    base = _words(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    grams = checkpointed(benchmark_windows(benchmark, window=window))
    anchors = checkpointed(rarest_words(base, grams.select("gram").distinct(), limit))
    small = _fits(anchors, F.array_join("gram", " "), limit)
    near = F.broadcast(anchors) if small else anchors
    placed = base.select("doc_id", "key", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("len") <= F.col("n"))
    same = F.slice("words", F.col("pos") - F.col("offset") + 1, F.col("len")) == F.col("gram")
    if small:
        spans = placed.join(near, "word").where(fits & same)
    else:  # only positions are shuffled; the words of documents with candidates are read again
        found = placed.drop("words").join(near, "word").where(fits)
        spans = found.join(base.select("doc_id", "key", "words").withColumnsRenamed({"doc_id": "own_id", "key": "own"}), (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).where(same)
    spans = checkpointed(spans.select("doc_id", "key", (F.col("pos") - F.col("offset")).alias("at"), "len", "gram"))  # read twice below
    by_doc = Window.partitionBy("doc_id", "key")
    so_far = F.max(F.col("at") + F.col("len")).over(by_doc.orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.greatest(F.col("at"), F.coalesce(so_far, F.lit(0))))
    hits = spans.select("doc_id", "key", "at", "len").withColumn("fresh", fresh).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"))
    items = grams.select("gram", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    items = F.broadcast(items) if small and _fits(grams, F.array_join("gram", " "), limit) else items
    held = spans.select("doc_id", "key", "gram").distinct().join(items, "gram").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = held.withColumnsRenamed({"doc_id": "held_id", "key": "held"})
    found = hits.join(held, (F.col("key") == F.col("held")) & F.col("doc_id").eqNullSafe(F.col("held_id"))).select(F.col("doc_id").alias("own_id"), F.col("key").alias("own"), "n_hit", "items")
    all_docs = base.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    out = all_docs.join(found, (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(*["key"] * keyed, "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names.

    Rows are judged by id and text: of rows that repeat an id with other texts each is judged on its own, a row that
    repeats both stays or goes with the other. Null texts have no words and stay, as do rows with null ids that are clean;
    an empty table gives no rows. Texts of any length are judged whole.
    """
    found = contamination(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark, keyed=True).where("contaminated").select("doc_id", "key").distinct()
    bad = checkpointed(found)
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("own_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("own"))
    same = (F.col("own") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
    return whole.join(bounded_broadcast(bad, bad.count(), BROADCAST_ROWS), same, "left_anti").select("row.*")
