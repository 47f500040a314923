"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .common import bounded_broadcast, checkpointed, coded_words, text_blocks, tidied

#: N-grams that a task holds before it deals them out (or 8 a range, if that is more), and bytes of text that it takes at a time.
BLOCK, TEXT_BYTES = 1_000_000, 2_000_000
#: Bytes of text for each range of n-gram hashes; there are two ranges a shuffle partition at least.
BUCKET_BYTES = 128 << 20
#: Turns that only link groups, and how many n-grams of a document each looks at. The product is complete without them.
STAR_TURNS, STAR_GRAMS = 2, 4
#: Postings of one n-gram that are multiplied in place; more are cut into blocks of so many, and pairs of blocks dealt out.
HEAVY = 4_096
#: Pairs that are looked at in one step.
_STEP = 1_000_000
#: Rows to drop, up to which their ids and hashes are broadcast to the texts.
BROADCAST_ROWS = 200_000
_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes (64 bits) of each whole text. A block's distinct words are hashed once."""
    words, at, sizes = coded_words(texts)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)[at]

    def rolled(width: int, starts: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), width, np.uint64)
        for k in range(width):
            out *= _K
            out += h[starts + k]
            out ^= out >> np.uint64(29)
        out *= _M
        out ^= out >> np.uint64(32)
        return out

    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)  # n-grams that end within their text
    for k in range(1, n):
        inside[(ends - k)[sizes >= k]] = False
    every = rolled(n, np.flatnonzero(inside))
    cuts = np.cumsum(np.maximum(sizes - n + 1, 0))
    short = {k: iter(rolled(k, (ends - k)[sizes == k])) for k in range(1, n)}
    return [np.unique(every[e - (s - n + 1) : e]) if s >= n else np.array([next(short[s])], np.uint64) if s else np.empty(0, np.uint64) for s, e in zip(sizes.tolist(), cuts.tolist(), strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """Sorted hashes byte by byte, high bytes first: these are nearly constant and compress in the shuffle."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _bucket_edges(buckets: int) -> np.ndarray:
    return (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)


def _deal(n: int, buckets: int):
    edges, block = _bucket_edges(buckets), max(BLOCK, 8 * buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x, count = np.unique(np.concatenate(held), return_counts=True)  # a frequent n-gram goes out once
            cuts = np.r_[0, np.searchsorted(x, edges), len(x)]
            full = np.flatnonzero(np.diff(cuts))
            parts = [slice(cuts[k], cuts[k + 1]) for k in full]
            planes, counts = [_planes(x[p]) for p in parts], [count[p].astype(np.uint32).tobytes() for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(planes, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "hashes", "counts"])

        for b in batches:
            for texts in text_blocks(b.column(0), TEXT_BYTES):
                held += shingle_sets(texts, n)
                size = sum(map(len, held))
                if size > block:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _shared_ngrams(uri: str):
    """A bucket's n-grams that more than one document has, with their counts, to sorted arrays in the store."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: int, hashes: list[np.ndarray], counts: list[np.ndarray]) -> int:
            x, n = np.concatenate(hashes), np.concatenate(counts)
            order = np.argsort(x)
            x, n = x[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])[: len(x)]
            n = np.add.reduceat(n, first) if len(x) else n
            more = n > 1
            store.save(uri, f"{bucket}.hash", x[first[more]])
            store.save(uri, f"{bucket}.count", np.minimum(n[more], 2**32 - 1).astype(np.uint32))
            return int(more.sum())

        bucket, hashes, counts, kept = None, [], [], 0
        for b in batches:
            for k, data, count in zip(*b.columns, strict=True):
                if k.as_py() != bucket:
                    if hashes:
                        kept += close(bucket, hashes, counts)
                    bucket, hashes, counts = k.as_py(), [], []
                hashes.append(_unplanes(data.as_py()))
                counts.append(np.frombuffer(count.as_py(), np.uint32))
        if hashes:
            kept += close(bucket, hashes, counts)
        yield pa.RecordBatch.from_arrays([pa.array([kept], pa.int64())], ["kept"])

    return run


def _prefixes(n: int, buckets: int, uri: str, percent: int):
    edges = _bucket_edges(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = store.Opened(lambda k: (store.load(uri, f"{k}.hash", "u8"), store.load(uri, f"{k}.count", "u4")), 2)
        seen: set[bytes] = set()  # sets of which this task has sent the n-grams
        part_no = TaskContext.get().taskAttemptId()  # a task that runs again may see its rows in another order

        def counts(x: np.ndarray) -> np.ndarray:
            """How many documents have each of the sorted n-grams, of which one is in hand."""
            out = np.ones(len(x), np.uint32)
            cuts = np.r_[0, np.searchsorted(x, edges), len(x)]
            for k in np.flatnonzero(np.diff(cuts)):
                keys, count = shared(k)
                at, there = store.lookup(keys, x[cuts[k] : cuts[k + 1]])
                out[cuts[k] : cuts[k + 1]][there] = count[at[there]]
            return out

        def prefix(x: np.ndarray, df: np.ndarray) -> tuple[int, np.ndarray | None]:
            """How many of a set's n-grams no other document has; and, after these, the first by count and hash."""
            width, alone = len(x) - -(-percent * len(x) // 100) + 1, int(np.count_nonzero(df == 1))
            if alone >= width:
                return alone, None
            return alone, x[np.argsort(df, kind="stable")[alone:width]].view(np.int64)

        def rows(texts: pa.Array) -> list[list]:
            """n, key, n-grams of its own, prefix and place of each text's set. Several texts' n-grams are looked up at once."""
            every = shingle_sets(texts, n)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if len(x) else None for x in every]
            fresh = []
            for i, key in enumerate(keys):
                if len(seen) > 200_000:
                    seen.clear()
                if key is not None and key not in seen:
                    seen.add(key)
                    fresh.append(i)
            alone, found, at = ([None] * len(texts) for _ in range(3))
            if fresh:
                grams, back = np.unique(np.concatenate([every[i] for i in fresh]), return_inverse=True)
                df = counts(grams)[back]
                ends = np.cumsum([len(every[i]) for i in fresh])
                for i, e in zip(fresh, ends, strict=True):
                    alone[i], found[i] = prefix(every[i], df[e - len(every[i]) : e])
                    if found[i] is not None:
                        at[i] = sets.append(every[i])
            return [[len(x) for x in every], keys, alone, found, at]

        with store.Writer(uri, f"{part_no}.sets") as sets:
            for b in batches:
                begun = 0
                for texts in text_blocks(b.column("text"), TEXT_BYTES):
                    sizes, keys, alone, found, at = rows(texts)
                    ids, marks = (b.column(c).slice(begun, len(texts)) for c in ("doc_id", "mark"))
                    begun += len(texts)
                    yield pa.RecordBatch.from_arrays([ids, marks, pa.array(sizes, pa.int32()), pa.array(keys, pa.string()), pa.array(alone, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array([part_no] * len(sizes), pa.int64()), pa.array(at, pa.int64())], ["doc_id", "mark", "n", "key", "alone", "prefix", "part", "at"])

    return run


def _fixed(column: pa.Array) -> np.ndarray:
    """A column of strings of 32 characters."""
    at = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], "S32", len(column), at).copy()


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    """n-gram, size and place of the n-gram in its document's order, document, component."""
    return [*(b.column(c).to_numpy().astype(np.int64) for c in ("gram", "n", "pos")), _fixed(b.column("key")), _fixed(b.column("comp"))]


def _pairs(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """A block of the incidence matrix times another one's transpose: (a, b, common, last_a, last_b), how many n-grams two
    documents have in common here, and the places of the last of these in both orders.

    Of two documents that of smaller size (then key) comes from `a`, which is in order of n-gram and size. Pairs are not
    formed where sizes and places leave too little room for a link, should this be their first n-gram in common: since
    room falls along both orders, those formed are the first ones that a pair has in common.
    """
    (ga, na, pa_, ka, ca), (gb, nb, pb, kb, cb) = a, b
    if not len(ga) or not len(gb):
        return
    grams = np.unique(np.r_[ga, gb])
    wide = int(max(na.max(), nb.max())) + 2
    place = np.searchsorted(grams, ga) * wide + na
    # the sizes that a row of b goes with: by the ratio of sizes, and by the room that it leaves itself
    most = np.minimum(nb, (nb - pb) * (100 + percent) // percent - nb)
    base = np.searchsorted(grams, gb) * wide
    low = np.searchsorted(place, base + -(-percent * nb // 100))
    count = np.maximum(np.searchsorted(place, base + np.maximum(most, 0), "right") - low, 0)
    names, at = np.unique(np.r_[ka, kb], return_inverse=True)
    comp = np.unique(np.r_[ca, cb], return_inverse=True)[1]
    ends, begun = np.cumsum(count), 0
    while begun < len(count):
        stop = max(begun + 1, int(np.searchsorted(ends, (ends[begun - 1] if begun else 0) + _STEP, "right")))
        part = count[begun:stop]
        j = np.repeat(np.arange(begun, stop), part)
        i = np.repeat(low[begun:stop] - (np.cumsum(part) - part), part) + np.arange(len(j))
        begun = stop
        x, y = at[i], at[len(ga) + j]
        ok = (comp[i] != comp[len(ga) + j]) & ((na[i] < nb[j]) | (x < y)) & ((na[i] - pa_[i]) * (100 + percent) >= percent * (na[i] + nb[j]))
        if not ok.any():
            continue
        x, y, lx, ly = x[ok], y[ok], pa_[i[ok]], pb[j[ok]]
        swap = x > y
        x, y, lx, ly = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ly, lx), np.where(swap, lx, ly)
        by = np.argsort(x * len(names) + y, kind="stable")
        x, y = x[by], y[by]
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        keys = [pa.array(names[k[first]].astype("U32")) for k in (x, y)]
        counts = [np.diff(np.r_[first, len(by)]), np.maximum.reduceat(lx[by], first), np.maximum.reduceat(ly[by], first)]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in counts)], ["a", "b", "common", "last_a", "last_b"])


_PAIRS = "a string, b string, common long, last_a long, last_b long"


def _multiply(percent: int):
    """Postings in order of n-gram and size to pairs, many n-grams at a time. Of an n-gram's rows only those outside its
    most frequent component are paired with all others: in a large group of copies few are left."""

    def of_whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, comp = np.unique(rows[0], return_inverse=True)[1], np.unique(rows[4], return_inverse=True)[1]
        wide = int(comp.max()) + 1
        code, n = np.unique(gram * wide + comp, return_counts=True)
        by = np.lexsort((n, code // wide))
        top = by[np.r_[np.flatnonzero(np.diff(code[by] // wide)), len(by) - 1]]  # each n-gram's most frequent one
        most = comp == (code[top] % wide)[gram]
        main, other = ([c[keep] for c in rows] for keep in (most, ~most))
        for a, b in ((other, other), (main, other), (other, main)):
            yield from _pairs(a, b, percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(_columns(b))
            size += b.num_rows
            if size > 100_000:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = size - int(np.argmax(rows[0][::-1] != rows[0][-1])) if (rows[0] != rows[0][-1]).any() else 0
                if last:
                    yield from of_whole([c[:last] for c in rows])
                held, size = [[c[last:] for c in rows]], size - last
        if size:
            yield from of_whole([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _multiply_blocks(percent: int):
    """Rows of blocks of frequent n-grams, each block's own rows (`mine`) before those that meet it, to pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, []
        for b in batches:
            ids, mine = b.column("block").to_numpy(), b.column("mine").to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]) | (mine[1:] != mine[:-1])) + 1, len(ids)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                rows = _columns(b.slice(s, e - s))
                if ids[s] != block:
                    block, own = ids[s], []
                if mine[s]:
                    own.append(rows)
                elif own:
                    own = [[np.concatenate(c) for c in zip(*own, strict=True)]]
                    yield from _pairs(own[0], rows, percent)

    return run


def _band(n: Column) -> Column:
    """Sizes in bands of a tenth."""
    return F.floor(F.log(n) / F.log(F.lit(1.1)))


def _product(postings: DataFrame, labels: DataFrame | None, percent: int, heavy: int, uri: str) -> DataFrame:
    """(a, b, common, last_a, last_b) of pairs of documents in different components.

    An n-gram's postings are multiplied in one task if there are at most `heavy` of them. Those of others are cut by size
    band, large component and a hash of the document into blocks of about as many, each to be multiplied with the postings
    that its sizes allow; postings of a large component don't meet blocks of the same. Where more than 64 blocks' rows
    meet a block, they are split, too, and the block is repeated. So no task holds more than a block, nor all of an n-gram.
    """
    counts = written(postings.groupBy("gram").count().where(F.col("count") > heavy), uri)
    n = counts.count()
    light, parts = postings, []
    if n:
        light = postings.join(bounded_broadcast(counts, n, BROADCAST_ROWS), "gram", "left_anti")
        rows = postings.join(bounded_broadcast(counts, n, BROADCAST_ROWS), "gram").withColumn("band", _band(F.col("n")))
        if labels is None:
            rows = rows.withColumn("large", F.lit(None).cast("string"))
        else:
            large = labels.groupBy("comp").count().where(F.col("count") > heavy).select("comp", F.col("comp").alias("large"))
            rows = rows.join(large, "comp", "left")
        rows = written(rows, uri)
        split = F.ceil(F.col("count") / (64 * heavy))
        blocks = written(rows.groupBy("gram", "band", "large").agg(F.ceil(F.count("*") / heavy).alias("blocks"), F.first("count").alias("all")), uri)
        side = bounded_broadcast(blocks.select("gram", "band", F.col("large").alias("of"), "blocks"), blocks.count(), BROADCAST_ROWS)
        number = lambda c, salt, again: F.xxhash64("gram", "band", c, salt, again)
        again = lambda: F.explode(F.sequence(F.lit(0).cast("long"), split - 1))
        salt = F.pmod(F.xxhash64("key"), F.col("blocks"))
        own = rows.join(side, ["gram", "band"]).where(F.col("large").eqNullSafe(F.col("of")))
        own = own.withColumn("salt", salt).withColumn("again", again()).select(number("of", "salt", "again").alias("block"), F.lit(True).alias("mine"), "gram", "n", "pos", "key", "comp")
        most = F.least("n", F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n"))
        least = F.ceil(F.col("n") * percent / 100)
        bands = F.explode(F.when(most >= least, F.sequence(_band(least) - 1, _band(most) + 1)))  # one more for rounding
        met = rows.withColumn("band", bands).join(side, ["gram", "band"]).where(F.col("large").isNull() | F.col("of").isNull() | (F.col("large") != F.col("of")))
        met = met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("again", F.pmod(F.xxhash64("key", F.lit(1)), split))
        met = met.select(number("of", "salt", "again").alias("block"), F.lit(False).alias("mine"), "gram", "n", "pos", "key", "comp")
        both = own.unionByName(met).repartition("block").sortWithinPartitions("block", F.desc("mine"), "n")
        parts.append(both.mapInArrow(tidied(_multiply_blocks(percent)), _PAIRS))
    light = light.repartition("gram").sortWithinPartitions("gram", "n").select("gram", "n", "pos", "key", "comp")
    found = light.mapInArrow(tidied(_multiply(percent)), _PAIRS)
    for p in parts:
        found = found.unionByName(p)
    return found.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("last_a").alias("last_a"), F.max("last_b").alias("last_b"))


def _star(postings: DataFrame, turn: int) -> DataFrame:
    """(a, b): each document with the best leading document of its n-grams. An n-gram's documents of one size band are led
    by the one with the smallest share of n-grams of its own: of a text and its changed copies, that is the text."""
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3)) + F.lit(turn / STAR_TURNS)).alias("band")
    rows = postings.select("*", band)
    lead = rows.groupBy("gram", "band").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "key", "comp")).alias("l"), F.count("*").alias("rows")).where("rows > 1")
    met = rows.join(lead.select("gram", "band", "l"), ["gram", "band"]).where(F.col("comp") != F.col("l.comp"))
    pairs = met.groupBy("key", F.col("l.key").alias("lead")).count()
    best = pairs.groupBy("key").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    return best.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def written(df: DataFrame, uri: str) -> DataFrame:
    """Cuts lineage by a table in the folder. Unlike a checkpoint's, its size is known to the planner; over many turns
    the estimates that checkpoints pass on would grow without end."""
    path = f"{uri}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, uri: str) -> DataFrame:
    """(key, comp) of every key in `edges` (a, b): its component's smallest key, by min-label steps and pointer jumps."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), uri)
    label = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("comp")), uri)
    moved = True
    while moved:
        near = both.join(label.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("m"))
        step = label.join(near, "key").select("key", "comp", F.least("comp", "m").alias("low"))
        # the label of one's label is at least as small
        jump = step.join(label.select(F.col("key").alias("low"), F.col("comp").alias("far")), "low", "left")
        after = written(jump.select("key", "comp", F.least("low", F.coalesce("far", "low")).alias("new")), uri)
        moved = not after.where("new <> comp").isEmpty()
        label = after.select("key", F.col("new").alias("comp"))
    return label


def _verify(uri: str, percent: int):
    """Pairs with the places of their whole sets, to the pairs that are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = store.Reader(uri, "u8")
        for b in batches:
            r = b.to_pydict()
            keep = []
            for p, i, m, q, j, n in zip(*(r[c] for c in ("part_a", "at_a", "n_a", "part_b", "at_b", "n_b")), strict=True):
                x, y = sets(f"{p}.sets", i, m), sets(f"{q}.sets", j, n)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (m + n - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(docs: DataFrame, doc_id: str, text: str, ngram: int, percent: int, heavy: int, uri: str) -> DataFrame:
    """doc_id, mark (a hash of the text), n, comp of each document: its component's smallest set key, null without n-grams."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, size // BUCKET_BYTES)
    dealt = rows.select("text").mapInArrow(tidied(_deal(ngram, buckets)), "bucket int, hashes binary, counts binary")
    dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_shared_ngrams(uri)), "kept long").agg(F.sum("kept")).collect()
    made = written(rows.mapInArrow(tidied(_prefixes(ngram, buckets, uri, percent)), "doc_id long, mark long, n int, key string, alone int, prefix array<long>, part long, at long"), uri)
    # a task sends a set once, but several tasks may send the same set
    sent = made.where("at is not null").groupBy("key").agg(F.min(F.struct("part", "at", "n", "alone", "prefix")).alias("s")).select("key", "s.*")
    sent = written(sent, uri)
    sides = [sent.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("part", "at", "n"))) for x in "ab"]
    links, labels = None, None
    for turn in range(STAR_TURNS + 1):
        at = sent.withColumn("comp", F.col("key")) if labels is None else sent.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        if turn < STAR_TURNS:
            # a few n-grams of each document, by a hash that all have in common
            few = F.slice(F.array_sort(F.transform("prefix", lambda g: F.struct(F.xxhash64(g, F.lit(turn)).alias("h"), g.alias("g")))), 1, STAR_GRAMS)
            pairs = _star(at.select("key", "n", "comp", F.col("alone").alias("pos"), F.explode(F.transform(few, lambda x: x["g"])).alias("gram")), turn)
            pairs = pairs.join(sides[0], "a").join(sides[1], "b")
        else:
            postings = at.select("key", "n", "comp", "alone", F.posexplode("prefix").alias("after", "gram")).select("gram", "n", (F.col("alone") + F.col("after")).alias("pos"), "key", "comp")
            pairs = _product(postings, labels, percent, heavy, uri).join(sides[0], "a").join(sides[1], "b")
            # what is counted, and all that can come after the last n-gram counted, against the overlap of a link
            room = F.least(F.col("n_a") - F.col("last_a"), F.col("n_b") - F.col("last_b")) - 1
            pairs = pairs.where((F.col("common") + room) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b")))
        pairs = pairs.select("a", "part_a", "at_a", "n_a", "b", "part_b", "at_b", "n_b")
        found = written(pairs.mapInArrow(tidied(_verify(uri, percent)), "a string, b string"), uri)
        links = found if links is None else links.union(found)
        if labels is None or not found.isEmpty():
            labels = connected(links, uri)
    labels = labels.withColumnRenamed("key", "own")
    return made.join(labels, F.col("key") == F.col("own"), "left").select("doc_id", "mark", "n", F.coalesce("comp", "key").alias("comp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = 5, percent: int = 75, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    1. Documents' n-grams are dealt by hash range and counted; those that several documents
       have go into sorted arrays in the shared folder.
    2. A document's n-grams are put in order by count; of these only the first
       n - ceil(percent * n / 100) + 1 can hold the first n-gram that a linked pair shares.
       Those that occur elsewhere are the document's row in the sparse incidence matrix.
       Documents with the same n-gram set are one row.
    3. The matrix, blocked by n-gram, is multiplied with its transpose: for each pair, common
       n-grams are counted. A pair whose count, with all the room that is left after the last
       n-gram counted in both orders, is below the overlap that its sizes ask of a link is
       discarded. The others are verified on their whole sets.
    4. Before that product, a few turns try a document only with the leading document of a few
       of its n-grams: this links a large group through few pairs. The product then forms
       every pair whose ends are still in different components, so no link between components
       is lost.

    Words are maximal runs of non-space, A-Z lower-cased; with fewer than `ngram` words the
    whole sequence is one n-gram. Null or empty texts have no n-grams and their own doc_id as
    component. Null ids are ignored in minima; a component of only null ids has a null id.
    Rows that repeat an id are documents of their own. Whole texts are read, of any length, one
    at a time where longer than a block; an empty table gives no rows. Extra columns are not
    read, so their names don't matter.

    The n-gram of many documents is multiplied in blocks (see _product). A large component is
    one key in the joins on component labels; the other side has one row for it, so that
    adaptive execution may split the key, and label minima are combined before the shuffle.
    """
    with store.scratch(docs.sparkSession) as uri:
        found = _linked(docs, doc_id, text, ngram, percent, heavy, uri)
        least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("comp", "of")
        out = found.join(least, F.col("comp") == F.col("of"), "left")
        return checkpointed(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id (null last), then of the
    smallest hash of its text, so that rows that repeat an id are told apart. Of rows that repeat id and text one stays.
    Null and empty texts are linked with nothing and stay, repeated or not; an empty table gives no rows. Texts go through
    no shuffle unless more than BROADCAST_ROWS rows are dropped."""
    with store.scratch(docs.sparkSession) as uri:
        found = _linked(docs, doc_id, text, 5, 75, HEAVY, uri).where("comp is not null")
        rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
        lead = found.groupBy("comp").agg(F.min(rank).alias("lead")).withColumnRenamed("comp", "of")
        rows = found.groupBy("comp", "doc_id", "mark").agg(F.count("*").alias("rows")).join(lead, F.col("comp") == F.col("of"))
        judged = checkpointed(rows.select("doc_id", "mark", "rows", rank.eqNullSafe(F.col("lead")).alias("stays")))
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("own_id"), F.xxhash64(F.col(text).cast("string")).alias("own"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark"))
    away, again = judged.where("not stays"), judged.where("stays and rows > 1")
    kept = whole.join(bounded_broadcast(away, away.count(), BROADCAST_ROWS), same, "left_anti")
    n = again.count()
    if n:
        side = bounded_broadcast(again, n, BROADCAST_ROWS)
        one = kept.join(side, same, "left_semi").groupBy("own_id", "own").agg(F.first("row").alias("row"))
        kept = kept.join(side, same, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")
