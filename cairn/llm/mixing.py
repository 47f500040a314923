"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NONSPACE, SPACE, bounded_broadcast, checkpointed, free_name

#: Sources up to this many go out as a broadcast table; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Hex digits that a step of the search for a source's boundary adds, and rows up to which a bucket is put in order.
_BUCKET_HEX, EDGE_ROWS = 3, 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NONSPACE)), F.lit(0)).cast("long")


def ranked_sources(sums: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds each source's weight by its place in code-point order, null last, without one task that sorts all."""
    dealt = checkpointed(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = dealt.groupBy("part").agg(F.count("*").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("offset")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return dealt.join(offsets.drop("rows"), "part").withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))).drop("part", "offset")


def water_fill(sources: DataFrame, budget: float, epochs: float) -> DataFrame:
    """Adds `target`: shares of the budget by weight, clamped at epochs times a source's size.

    A round clamps the sources whose share is above their cap and deals the rest of the budget
    to the others by weight, until no share is above. Only two sums leave Spark in a round.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    level, clamped = None, F.lit(False)
    while True:
        left = sources.where(~clamped).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
        held = sources.where(clamped).agg(F.sum(cap).alias("c")).first()["c"] or 0.0
        if not left["n"]:
            break
        fresh = max(0.0, budget - held) / left["w"]
        if fresh == level:
            break
        level = fresh
        clamped = F.col("weight") * F.lit(level) > cap
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def _marked(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mark.alias("mark"))


def _passing(sums: DataFrame) -> DataFrame:
    """The bucket of each source in which the running sum of words, from `base` on, passes the quota."""
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("own").orderBy("bucket"))
    found = sums.withColumn("upto", upto).where((F.col("upto") - F.col("words") <= F.col("quota")) & (F.col("quota") < F.col("upto")))
    return found.select("own", "quota", F.col("bucket").alias("edge"), (F.col("upto") - F.col("words")).alias("base"), "held")


def _boundaries(rows: DataFrame, first: DataFrame, n: int, most: int) -> DataFrame:
    """own, edge, base: the hash bucket of each source that the quota ends in, with at most `most` rows.

    A bucket of more rows is counted again by three digits more, so that a source of any size leaves few rows to be put in
    order. Only rows of equal ids, which share all digits, can't be told apart.
    """
    found, digits = checkpointed(first), _BUCKET_HEX
    while digits + _BUCKET_HEX <= 32 and (found.agg(F.max("held")).first()[0] or 0) > most:
        digits += _BUCKET_HEX
        wide = bounded_broadcast(found.where(F.col("held") > most).drop("held"), n, BROADCAST_SOURCES)
        inside = rows.join(wide, F.col("source").eqNullSafe(F.col("own")) & F.col("mark").startswith(F.col("edge")))
        sums = inside.groupBy("own", "quota", "base", F.substring("mark", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("held"))
        found = checkpointed(found.where(F.col("held") <= most).unionByName(_passing(sums)))
    return found.select(F.col("own").alias("edge_source"), "edge", "base")


def mixing_plan(rows: DataFrame, weights: tuple[int, ...], share: float, epochs: int, edge_rows: int = EDGE_ROWS) -> tuple[DataFrame, int]:
    """One row per source: own, source_size, target, whole, quota, edge, base; and their number.

    `whole` is how often all of a source is taken, `quota` the words of the last, partial round;
    the round's running sum of words passes the quota in the hash bucket `edge`, before which it
    is at `base`.
    """
    by_bucket = rows.groupBy("source", F.substring("mark", 1, _BUCKET_HEX).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("held"))
    filled = checkpointed(ranked_sources(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights))  # a row per source, read in each round
    total = filled.agg(F.sum("source_size").alias("t"), F.count("*").alias("n")).first()
    budget = (total["t"] or 0) * Fraction(str(share))
    filled = water_fill(filled, float(budget), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("quota", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    quotas = filled.select("source", "quota", F.lit(0).cast("long").alias("base"))
    first = by_bucket.withColumnRenamed("source", "own").join(bounded_broadcast(quotas, total["n"], BROADCAST_SOURCES), F.col("own").eqNullSafe(F.col("source")))
    edge = _boundaries(rows, _passing(first), total["n"], edge_rows)
    plan = filled.join(bounded_broadcast(edge, total["n"], BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return plan.drop("edge_source", "weight").withColumnRenamed("source", "own"), total["n"]


def _with_share(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """Adds the plan's columns and `again`, the words that the partial round takes of each row."""
    full = rows.join(bounded_broadcast(plan, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    full = full.withColumn("bucket", F.substr("mark", F.lit(1), F.length("edge")))  # null, as `edge` is, where no row passes the quota
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    away = full.where(~at_edge).withColumn("again", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0).cast("long"))
    order = Window.partitionBy("source").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("base") + F.sum("size").over(order) - F.col("size")
    near = full.where(at_edge).withColumn("again", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - before)).cast("long"))
    return away.unionByName(near)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix-1", edge_rows: int = EDGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, whole, taken.

    `share` times all words are dealt to the sources by weight (see water_fill). A source's
    documents are read in a seeded hash order: each is taken `whole` times and then once more
    until the target is met; the document at the boundary gives only its first words, so that a
    source's taken words are its target, rounded down. Sums by source and hash bucket find the
    boundary, in finer buckets until one has at most `edge_rows` rows; only these are put in order.

    Null text has size 0; a null source is a source, the last in order; null ids hash as an
    empty string. Repeated rows count each time. Whole texts are counted, of any length. An
    empty table gives no rows; extra columns are not read.
    """
    rows = checkpointed(_marked(docs, doc_id, text, source, seed).drop("row"))  # two passes over these short rows, one over the texts
    out = _with_share(rows, *mixing_plan(rows, weights, share, epochs, edge_rows))
    return out.select("doc_id", "size", "source", "source_size", "target", "whole", (F.col("whole") * F.col("size") + F.col("again")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: str = "mix-1", edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The mix itself: each row of `docs` once for each time it is taken, with mix_copy (from 1) and mix_words; where the
    rows have such columns, they stay and the mix's names get an underscore more.

    A partial copy, one at most for each source, has only its first mix_words words as text,
    joined by blanks. Rows without words, and those that the mix leaves out, are not there.
    Texts are not shuffled: the plan by source comes to them.

    A null id is an id like others, a null source a source, a null text has no words. Rows that are the same in id and text
    are each taken as the mix takes them, ties in its order going to either. Texts of any length are cut whole. An empty
    table gives no rows.
    """
    rows = _marked(docs, doc_id, text, source, seed)
    plan, n = mixing_plan(checkpointed(rows.drop("row")), weights, share, epochs, edge_rows)
    copies = F.sequence(F.lit(1).cast("long"), F.col("whole") + (F.col("again") > 0).cast("long"))
    taken = _with_share(rows, plan, n).where((F.col("size") > 0) & (F.col("whole") + F.col("again") > 0)).withColumn("copy", F.explode(copies))
    words = F.when(F.col("copy") <= F.col("whole"), F.col("size")).otherwise(F.col("again"))
    first = F.array_join(F.slice(F.array_remove(F.split(F.col(f"row.{text}"), SPACE), ""), F.lit(1), words.cast("int")), " ")
    row = F.when(words < F.col("size"), F.col("row").withField(text, first)).otherwise(F.col("row"))
    names = [free_name(x, docs.columns) for x in ("mix_copy", "mix_words")]
    return taken.select(row.alias("row"), F.col("copy").alias("mix_copy"), words.alias("mix_words")).select("row.*", F.col("mix_copy").alias(names[0]), F.col("mix_words").alias(names[1]))
