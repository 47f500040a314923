"""Audit of how far sources of a language diverge in their words, by bitmaps of terms with the same count."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .common import bounded_broadcast, checkpointed, text_blocks, tidied

MIN_DOCS, TOP = 30, 50
#: Terms of a block (a few words of 64 bits), sources of a tile, bytes of text that a task counts at a time.
BLOCK, TILE, TEXT_BYTES = 1024, 64, 8 << 20
#: Tables of groups up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
_BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_COUNTED = "lang string, source string, term string, count long, docs long"


def counted_terms(batches: Iterable[pa.RecordBatch], limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Counts and documents of the terms of each group in a block of texts; a group also has a row without a term."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        at = 0
        for texts in text_blocks(batch.column("text"), limit):
            rows = table.slice(at, len(texts)).combine_chunks()
            at += len(texts)
            groups = rows.group_by(["lang", "source"]).aggregate([])
            yield from pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.nulls(len(groups), pa.string()), "count": np.zeros(len(groups), np.int64), "docs": np.zeros(len(groups), np.int64)}).to_batches()
            split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _BREAK, " "))
            terms = split.flatten()
            of = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
            full = pc.greater(pc.binary_length(terms), 0).to_numpy(zero_copy_only=False)
            coded = terms.filter(pa.array(full)).dictionary_encode()
            if not len(coded):
                continue
            # each (text, term) once, with its count; then each (group, term)
            n = len(coded.dictionary)
            both, counts = np.unique(of[full].astype(np.int64) * n + coded.indices.to_numpy(), return_counts=True)
            by = pa.table({"lang": rows["lang"].take(pa.array(both // n)), "source": rows["source"].take(pa.array(both // n)), "code": both % n, "count": counts})
            by = by.group_by(["lang", "source", "code"]).aggregate([("count", "sum"), ("count", "count")])
            yield from pa.table({"lang": by["lang"], "source": by["source"], "term": coded.dictionary.take(by["code"].combine_chunks()), "count": by["count_sum"], "docs": by["count_count"]}).to_batches(max_chunksize=50_000)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals, which hold every product."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, under = F.lit(1_000_000_000).cast("decimal(10,0)") * wide(count + 5), wide(total + 5 * terms)
    return F.call_function("div", top, under) + 1


def kept_terms(counts: DataFrame, least: int = MIN_DOCS, block: int = BLOCK) -> DataFrame:
    """lang, term, lang_count, block, bit: terms of enough documents, filed by size of count so that a block's counts are alike.

    A class of counts (those with as many binary digits) is dealt to blocks by hash; only a block is put in order.
    """
    totals = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= least)
    kept = checkpointed(totals.select("lang", "term", "lang_count", F.floor(F.log2("lang_count")).cast("int").alias("class")))
    blocks = kept.groupBy("lang", "class").agg(F.ceil(F.count("*") / block).alias("blocks"))
    filed = kept.join(bounded_broadcast(blocks, blocks.count(), BROADCAST_ROWS), ["lang", "class"]).withColumn("part", F.pmod(F.xxhash64("term"), "blocks"))
    order = Window.partitionBy("lang", "class", "part").orderBy(F.desc("lang_count"), "term")
    return filed.select("lang", "term", "lang_count", F.concat_ws(".", "class", "part").alias("block"), (F.row_number().over(order) - 1).alias("bit"))


def joint_values(key: tuple, table: pa.Table, width: int) -> pa.Table:
    """Sums of |p - q| over the terms of a block, for each pair of sources of two tiles (of `width` sources).

    With n_ab the terms that have count a in one group and b in the other (AND, popcount), the cells of zeros are what is
    left of rows, columns and the block: the sum is size f_00 + sum_a n_a (f_a0 - f_00) + sum_b n_b (f_0b - f_00)
    + sum_ab n_ab (f_ab - f_a0 - f_0b + f_00).
    """
    low, high = key[2].as_py(), key[3].as_py()
    column = lambda c, t: table.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(t)
    word, no, p, zero, mask, size = column("word", "i8"), column("no", "i8"), column("p", "i8"), column("zero", "i8"), column("mask", "i8").view("u8"), column("size", "i8")
    heads = table.column("word").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    ids, first = np.unique(no[heads], return_index=True)
    none, terms = zero[heads][first], int(size[heads][0])
    rows = np.flatnonzero(~heads)
    rows = rows[np.lexsort((no[rows], word[rows]))]
    word, p, mask, at = word[rows], p[rows], mask[rows], np.searchsorted(ids, no[rows])
    apart = np.abs(none[:, None] - none[None, :])  # f_00
    total = terms * apart
    many = np.bitwise_count(mask).astype(np.int64)
    for i in range(len(ids)):  # marginals: counts of i where the other has none
        own = at == i
        gain = (many[own, None] * (np.abs(p[own, None] - none[None, :]) - apart[i][None, :])).sum(0)
        total[i] += gain
        total[:, i] += gain
    starts = np.r_[np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), len(word)] if len(word) else np.zeros(1, int)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        w, q, m = at[a:b], p[a:b], mask[a:b]
        cut = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(w)], strict=True):
            i = w[s]
            joint = np.bitwise_count(m[s:e, None] & m[None, :]).astype(np.int64)
            f = np.abs(q[s:e, None] - q[None, :]) - np.abs(q[s:e, None] - none[w][None, :]) - np.abs(none[i] - q[None, :]) + apart[i, w][None, :]
            np.add.at(total[i], w, (joint * f).sum(0))
    x, y = np.meshgrid(np.arange(len(ids)), np.arange(len(ids)), indexing="ij")
    tile = ids // width
    wanted = (ids[x] < ids[y]) & (tile[x] == low) & (tile[y] == high)
    return pa.table({"lang": pa.array([key[0].as_py()] * int(wanted.sum()), pa.string()), "one": ids[x[wanted]], "two": ids[y[wanted]], "value": total[x[wanted], y[wanted]]})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE, limit: int = TEXT_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: of each (lang, source), its distance to each other source of the language
    (part `pair`) and the `top` terms that it has more of than the language (part `term`).

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in at least `least`
    documents. A count's share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)) with N the kept terms' sum and V their
    number; a pair's value is the sum of |p - q| over all kept terms, a term's is p - q against the whole language.

    Texts are counted in Arrow blocks and summed before the shuffle. Of each group, the terms of a block that have the same
    count are a bitmap; tasks take (language, block, two tiles of sources) and get each pair's joint cells by AND and
    popcount, with zeros by complement. So a hot language is many tasks, and a hot source is a bitmap like the others.
    The result has a row for each pair of sources of a language, as asked for.

    Null text, lang and source are empty strings. Groups without terms take part (all counts are 0); a language that
    keeps no term gives pairs of value 0 and no terms. Ties go by item in UTF-8 order. Repeated rows count each time. An
    empty table gives no rows. A text is counted whole, in memory that grows with the longest one. Extra columns are not
    read.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    with store.scratch(docs.sparkSession) as uri:  # the counts go when the result is there
        return checkpointed(_divergence(plain, least, top, block, tile, limit, lambda df, name: _written(df, f"{uri}/{name}")))


def _written(df: DataFrame, path: str) -> DataFrame:
    """The rows in a compressed table of the shared folder."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _divergence(plain: DataFrame, least: int, top: int, block: int, tile: int, limit: int, written: Callable) -> DataFrame:
    counts = written(plain.mapInArrow(tidied(lambda batches: counted_terms(batches, limit)), _COUNTED).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    terms = checkpointed(kept_terms(counts, least, block))
    sized = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    held = written(counts.where("term is not null").select("lang", "source", "term", "count").join(terms, ["lang", "term"]), "held")
    sums = held.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(sized, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), (F.row_number().over(by_name) - 1).cast("long").alias("no"))
    zero = F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    groups = checkpointed(groups.withColumn("zero", zero))
    near = lambda df: bounded_broadcast(df, n_groups, BROADCAST_ROWS)
    n_groups = groups.count()
    rated = held.join(near(groups), ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms")))

    bits = F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))")
    bitmaps = rated.groupBy("lang", "block", (F.col("bit") / 64).cast("long").alias("word"), "no", "count").agg(bits.alias("mask"), F.first("p").alias("p"))
    sizes = terms.groupBy("lang", "block").agg(F.count("*").alias("size"))
    heads = groups.join(sizes, "lang", "left").select("lang", F.coalesce("block", F.lit("")).alias("block"), F.lit(None).cast("long").alias("word"), "no", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("mask"), "zero", F.coalesce("size", F.lit(0)).alias("size"))
    rows = heads.unionByName(bitmaps.drop("count"), allowMissingColumns=True)
    tiles = groups.groupBy("lang").agg(F.floor(F.max("no") / tile).alias("last"))
    mine = F.floor(F.col("no") / tile)
    dealt = rows.join(near(tiles), "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.withColumns({"low": F.least(mine, F.col("other")), "high": F.greatest(mine, F.col("other"))}).drop("other", "last")
    pairs = dealt.groupBy("lang", "block", "low", "high").applyInArrow(lambda key, table: joint_values(key, table, tile), "lang string, one long, two long, value long").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("one").alias("no"), F.col("two").alias("item_no")), F.struct(F.col("two").alias("no"), F.col("one").alias("item_no")))).alias("p"), "value").select("lang", "p.*", "value")
    names = groups.select("lang", "no", "source")
    pair = both.join(near(names), ["lang", "no"]).join(near(names.select("lang", F.col("no").alias("item_no"), F.col("source").alias("item"))), ["lang", "item_no"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    of_lang = rated.withColumn("q", _share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))).where("p > q")
    term = of_lang.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", order)
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
