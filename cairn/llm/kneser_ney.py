"""Interpolated modified Kneser-Ney bigrams or trigrams: counted in Spark, kept as sorted arrays, mapped by workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .common import coded_words, fold, text_blocks, tidied

#: The token after the last word. No word of non-space characters is empty.
END = b""
#: Bytes of text that are tokenized at a time, words or n-grams that a task holds before it deals them out (n-grams: 8 a shard, if that is more), and tokens of a shard.
BLOCK, FLUSH, SHARD_TOKENS = 4 << 20, 4_000_000, 8_000_000
#: Counts from here on are kept apart, in full.
MANY = 255
_RUNS = "shard int, size int, columns array<binary>"


def tokenized(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens (END is the last one), each text's tokens as places among them, and the texts' numbers of tokens."""
    words, at, sizes = coded_words(texts)
    sizes = sizes + 1
    out = np.full(sizes.sum(), len(words), np.int64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(sizes) - 1] = True
    out[~last] = at
    return [*words, END], out, sizes


def _hashes(words: list[bytes]) -> np.ndarray:
    """Rows of two 64-bit hashes."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in words]), ">u8").astype(np.uint64).reshape(-1, 2)


def mix(code: np.ndarray, left: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hash of a bigram's code, or of a trigram: the code of its last two tokens, and the first."""
    x = code.copy()
    for more in (np.asarray(left).astype(np.uint64) + np.uint64(1), np.uint64(0)):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> np.uint64(33)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(33)
        x ^= more * np.uint64(0x9E3779B97F4A7C15)
    return x


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges a 64-bit hash is in, by its upper half."""
    return (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes."""
    return pa.compress(np.ascontiguousarray(x.view("u1").reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, size: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = pa.decompress(data, size * width, "zstd", asbytes=True)
    return np.frombuffer(raw, "u1").reshape(width, size).T.copy().view(dtype).ravel()


def _deal(shard: np.ndarray, shards: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows in the order of the key to one compressed run for each shard: the key's steps, then the columns."""
    by = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.uint32), kind="stable")
    key, columns = key[by], [c[by] for c in columns]
    cuts = np.searchsorted(shard[by], np.arange(shards + 1, dtype=shard.dtype))
    full = np.flatnonzero(np.diff(cuts))
    for k in range(0, len(full), 64):
        rows = []
        for f in full[k : k + 64]:
            c = slice(cuts[f], cuts[f + 1])
            rows.append((int(f), int(cuts[f + 1] - cuts[f]), [_pack(np.diff(key[c], prepend=np.uint64(0))), *(_pack(x[c]) for x in columns)]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.binary())), strict=True)], ["shard", "size", "columns"])


def _totals(level: int, sums: np.ndarray) -> pa.RecordBatch:
    """Sums of a whole level, as a run of a shard of their own below zero."""
    return pa.RecordBatch.from_arrays([pa.array([-level], pa.int32()), pa.array([len(sums)], pa.int32()), pa.array([[_pack(sums.astype(np.int64))]], pa.list_(pa.binary()))], ["shard", "size", "columns"])


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("shard", "size", "columns")), strict=True)


def _read(size: int, columns: list[bytes], dtypes: str) -> list[np.ndarray]:
    key, *rest = (_unpack(x, size, f"{t[0]}{t[1]}") for x, t in zip(columns, zip(dtypes[::2], dtypes[1::2], strict=True), strict=True))
    return [np.cumsum(key, dtype=np.uint64), *rest]


def _by_shard(runs: Iterable[tuple[int, int, list[bytes]]], dtypes: str) -> Iterator[tuple[int, list]]:
    """Each shard with its columns; sums of whole levels, below zero, come through as they are."""
    shard, held = None, []
    for own, size, columns in runs:
        if shard is not None and own != shard:
            yield shard, [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        shard = own
        if own < 0:
            yield own, [size, columns]
            shard = None
        else:
            held.append(_read(size, columns, dtypes))
    if shard is not None:
        yield shard, [np.concatenate(c) for c in zip(*held, strict=True)]


def _merged(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, with the columns' sums in 64 bits."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return [key[first], *(np.add.reduceat(c[order].astype(np.int64), first) if len(first) else c.astype(np.int64) for c in columns)]


class _Outbox:
    """Rows of keys and counts on their way to the next level: merged, and dealt when there are `flush` numbers in them."""

    def __init__(self, shards: int, shard_of, flush: int):
        self.shards, self.shard_of, self.flush = shards, shard_of, flush
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append([key, *columns])
        self.size += len(key) * (1 + len(columns))
        if self.size > self.flush:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            key, *columns = _merged(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
            self.held, self.size = [], 0
            yield from _deal(self.shard_of(key), self.shards, key, *columns)


# --- words


def _count_words(parts: int, flush: int, block: int):
    """Training texts to runs of (hash, second hash, count) by hash range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def merge() -> list[np.ndarray]:
            h, other, n = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, other, n = h[order], other[order], n[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])])
            return [h[first], other[first], np.add.reduceat(n, first)]

        for b in batches:
            for texts in text_blocks(b.column(0), block):
                words, at, _ = tokenized(texts)
                n = np.bincount(at, minlength=len(words))
                both = _hashes(words)
                held.append([both[:, 0], both[:, 1].astype(np.uint32), n])
                size += len(n)
                if size > flush:
                    held = [merge()]
                    size = len(held[0][0])
                    if size > flush // 2:
                        yield from _deal(_range_of(held[0][0], parts), parts, *held[0])
                        held, size = [], 0
        if held:
            held = [merge()]
            yield from _deal(_range_of(held[0][0], parts), parts, *held[0])

    return run


def _save_words(uri: str):
    """Sorted words of each hash range to its arrays. Words of one hash stand side by side, told apart by the second hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (h, other, n) in _by_shard(_runs(batches), "u8u4i8"):
            order = np.lexsort((other, h))
            h, other, n = h[order], other[order], n[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])])
            h, other, n = h[first], other[first], np.add.reduceat(n, first)
            store.save(uri, f"words.{part}.hash", h)
            store.save(uri, f"words.{part}.other", other)
            store.save(uri, f"words.{part}.count", n)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "words", "tokens"])

    return run


class Vocabulary:
    """Words to ids, their places among all word hashes, through the sorted arrays of all ranges."""

    def __init__(self, uri: str, parts: int, offsets: tuple[int, ...]):
        self.uri, self.parts, self.offsets = uri, parts, offsets
        self.arrays = store.Opened(lambda k: tuple(store.load(uri, f"words.{k}.{what}", t) for what, t in (("hash", "u8"), ("other", "u4"), ("count", "i8"))), 3)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct words; -1 and 0 if no training text has the word."""
        both = _hashes(words)
        h, other = both[:, 0], both[:, 1].astype(np.uint32)
        ids, n = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        cuts = np.searchsorted(_range_of(h[order], self.parts), np.arange(self.parts + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cuts)):
            keys, others, counts = self.arrays(k)
            mine = order[cuts[k] : cuts[k + 1]]
            at, there = store.lookup(keys, h[mine])
            while (next_ := np.flatnonzero(there)[others[at[there]] != other[mine[there]]]).size:  # words of one hash
                at[next_] += 1
                there[next_] = at[next_] < len(keys)
                at[~there] = 0
                there[next_] &= keys[at[next_]] == h[mine[next_]]
            ids[mine[there]] = self.offsets[k] + at[there]
            n[mine[there]] = counts[at[there]]
        return ids, n


# --- n-grams


def _before(at: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token: `start` at a text's first."""
    out = np.r_[start, at[:-1]]
    out[first] = start
    return out


def _count_ngrams(uri: str, parts: int, offsets: tuple[int, ...], shards: int, order: int, flush: int, block: int):
    """Training texts to merged runs by the hash of the whole n-gram.

    A code is the id of the token before the last, then the last; in a trigram model, `left` is the id before them. The
    id after all words' stands for a text's start, the next one for what is before the start: a text's first word has a
    context of one token in every order.
    """
    start = offsets[-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(uri, parts, offsets)
        held: list[np.ndarray] = []
        lefts: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            code = np.concatenate(held)
            if order == 2:
                code.sort()
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                n, code = np.diff(np.r_[first, len(code)]).astype(np.uint32), code[first]
                yield from _deal(_range_of(mix(code), shards), shards, code, n)
                return
            left = np.concatenate(lefts)
            by = np.lexsort((left, code))
            code, left = code[by], left[by]
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (left[1:] != left[:-1])])
            n, code, left = np.diff(np.r_[first, len(code)]).astype(np.uint32), code[first], left[first]
            yield from _deal(_range_of(mix(code, left), shards), shards, code, left, n)

        for b in batches:
            for texts in text_blocks(b.column(0), block):
                words, at, sizes = tokenized(texts)
                ids = vocabulary(words)[0][at]
                first = np.cumsum(sizes) - sizes
                context = _before(ids, first, start)
                held.append(context.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
                if order == 3:
                    lefts.append(_before(context, first, start + 1).astype(np.uint32))
                size += len(ids)
                if size > flush:
                    yield from out()
                    held, lefts, size = [], [], 0
        if size:
            yield from out()

    return run


def _counts_of_counts(n: np.ndarray) -> np.ndarray:
    return np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.int64)


def _save_counts(uri: str, name: str, code: np.ndarray, n: np.ndarray, dense: bool = False) -> None:
    """Rows of counts in a byte each; rows with a larger one are also kept in 64 bits. Dense codes are 0, 1, 2 and so on."""
    many = (n >= MANY).any(1)
    if not dense:
        store.save(uri, f"{name}.code", code)
    store.save(uri, f"{name}.few", np.minimum(n, MANY).astype(np.uint8).ravel())
    store.save(uri, f"{name}.many_code", code[many])
    store.save(uri, f"{name}.many", n[many].astype(np.int64).ravel())


def _save_trigram_counts(uri: str, shard: int, key: np.ndarray, code: np.ndarray, left: np.ndarray, n: np.ndarray) -> None:
    """Counts by key; trigrams that share their key with others are kept once more, whole."""
    first = np.r_[True, key[1:] != key[:-1]][: len(key)]
    shared = ~first | ~np.r_[first[1:], True][: len(key)]
    _save_counts(uri, f"trigrams.{shard}", key[first], n[first, None])
    if shared.any():
        store.save(uri, f"trigrams.{shard}.shared", np.stack([key, code, left, n.astype(np.uint64)])[:, shared].ravel())


class Counts:
    """What _save_counts() has saved in each shard, by code."""

    def __init__(self, uri: str, name: str, shards: int, width: int, dense: bool = False):
        self.uri, self.name, self.shards, self.width, self.dense = uri, name, shards, width, dense
        self.opened = store.Opened(self._open, 4)

    def _open(self, k: int) -> tuple[np.ndarray | None, ...]:
        read = lambda what, t: store.load(self.uri, f"{self.name}.{k}.{what}", t)
        return None if self.dense else read("code", "u8"), read("few", "u1").reshape(-1, self.width), read("many_code", "u8"), read("many", "i8").reshape(-1, self.width)

    def __call__(self, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A row of counts for each code in its own shard; zeros where there is none."""
        out = np.zeros((len(code), self.width), np.int64)
        order = np.argsort(own.astype(np.uint16 if self.shards < 1 << 16 else np.uint32), kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.shards + 1, dtype=own.dtype))
        for k in np.flatnonzero(np.diff(cuts)):
            keys, few, many_keys, many = self.opened(k)
            mine = order[cuts[k] : cuts[k + 1]]
            if self.dense:
                out[mine] = few[code[mine].astype(np.int64)]
            else:
                at, there = store.lookup(keys, code[mine])
                mine = mine[there]
                out[mine] = few[at[there]]
            large = mine[(out[mine] == MANY).any(1)]
            if len(large):
                out[large] = many[store.lookup(many_keys, code[large].astype(np.uint64))[0]]
        return out


def _context_sums(context: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Contexts in order: how often they occur and how many tokens follow once, twice, more often. `context` is in order."""
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    return [context[first], *(np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2))]


def _save_trigrams(uri: str, start: int, shards: int, flush: int):
    """Runs of trigrams to each shard's arrays; on to the bigrams go how many tokens come before each (but for those at a
    text's start, which count as often as they occur), and its sums as a context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, out = np.zeros(4, np.int64), _Outbox(shards, lambda code: _range_of(mix(code), shards), 2 * flush)
        for shard, (code, left, n) in _by_shard(_runs(batches), "u8u4u4"):
            key, left = mix(code, left), left.astype(np.uint64)
            by = np.lexsort((left, code, key))
            key, code, left, n = key[by], code[by], left[by], n[by].astype(np.int64)
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (code[1:] != code[:-1]) | (left[1:] != left[:-1])])
            key, code, left, n = key[first], code[first], left[first], np.add.reduceat(n, first)
            whole = left <= start
            _save_trigram_counts(uri, shard, key[whole], code[whole], left[whole], n[whole])
            totals += _counts_of_counts(n[whole])
            context = (left << np.uint64(32) | code >> np.uint64(32))[whole]
            by = np.argsort(context, kind="stable")
            sums = _context_sums(context[by], n[whole][by]) if len(context) else [context, *[np.zeros(0, np.int64)] * 4]
            none, one = np.zeros(len(code), np.int64), np.zeros(len(sums[0]), np.int64)
            yield from out.add(np.r_[code, sums[0]], np.r_[np.where(whole, 1, n), one], *(np.r_[none, x] for x in sums[1:]))
        yield from out.rest()
        if totals.any():
            yield _totals(3, totals)

    return run


def _save_bigrams(uri: str, order: int, width: int, ranges: int, flush: int):
    """Runs of bigrams to each shard's arrays; on to the tokens go how many contexts each has, and its sums as a context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, out = np.zeros(4, np.int64), _Outbox(ranges, lambda token: token // np.uint64(width), 2 * flush)
        for shard, columns in _by_shard(_runs(batches), "u8u4" if order == 2 else "u8" + "i8" * 5):
            if shard < 0:
                yield _totals(-shard, _unpack(columns[1][0], columns[0], "i8"))
                continue
            code, n, *sums = _merged(*columns)
            _save_counts(uri, f"bigrams.{shard}", code, np.stack([n, *sums], 1))
            totals += _counts_of_counts(n)
            context, *of_context = _context_sums(code >> np.uint64(32), n)
            token, contexts = np.unique(code & np.uint64(2**32 - 1), return_counts=True)
            none, zero = np.zeros(len(context), np.int64), np.zeros(len(token), np.int64)
            yield from out.add(np.r_[context, token], np.r_[none, contexts], *(np.r_[x, zero] for x in of_context))
        yield from out.rest()
        if totals.any():
            yield _totals(2, totals)

    return run


def _save_tokens(uri: str, width: int, start: int):
    """Runs of token statistics added up by id, one range of ids at a time: seen, c, n1, n2, n3. To the driver go sums over all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, 6), np.int64)
        part, stats = None, None

        def close() -> None:
            seen = stats[: max(0, min(width, start - part * width)), 0]  # that of a text's start is no token
            sums[1] += [*_counts_of_counts(seen), seen.sum(), (seen > 2).sum()]
            _save_counts(uri, f"ids.{part}", np.arange(width, dtype=np.uint64), stats, dense=True)

        for own, size, columns in _runs(batches):
            if own < 0:
                sums[-own, :4] += _unpack(columns[0], size, "i8")
                continue
            if own != part:
                if part is not None:
                    close()
                part, stats = own, np.zeros((width, 5), np.int64)
            key, *rest = _read(size, columns, "u8" + "i8" * 5)
            stats[key.astype(np.int64) - part * width] += np.stack(rest, 1)
        if part is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int32()), *(pa.array(sums[1:, k]) for k in range(6))], ["level", *(f"x{k}" for k in range(6))])

    return run


def discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n >= 3, d[2], np.where(n >= 2, d[1], np.where(n >= 1, d[0], 0.0)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; 0.5, 1 and 1.5 where the counts of counts don't give any between 0 and 1, 2, 3."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), raw, strict=True))


@dataclass(frozen=True)
class NgramModel:
    uri: str
    parts: int
    offsets: tuple[int, ...]  # where each hash range's ids begin; the last is the number of words, and the id of a text's start
    shards: int
    width: int
    total: int  # training tokens
    contexts: int  # sum of all tokens' numbers of contexts
    unk: float  # lowest-order probability of an unknown token
    d: tuple[tuple[float, float, float], ...]  # discounts by order
    order: int = 2

    @property
    def words(self) -> int:
        return self.offsets[-1]


def fit(train: DataFrame, text: str, uri: str, width: int = 1 << 17, order: int = 2, flush: int = FLUSH, block: int = BLOCK) -> NgramModel:
    """Counts the n-grams (`order` 2 or 3) of all of `train` and leaves the model's arrays in the folder `uri`.

    Tasks count words by hash, then n-grams of word ids, and send merged, compressed runs. N-grams are dealt by the hash
    of the whole n-gram, so that a frequent context is spread; what it sums up to goes on, by its own hash or id, level by
    level. Only sizes and sums over all come to the driver. Counts have 64 bits. Words have 96-bit keys and trigrams that
    share a 64-bit key are told apart. More than 2^32 - 2 distinct words are an error. Without rows, every token is unknown.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    parts = max(1, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = train.select(F.col(text).cast("string").alias("text"))
    dealt = lambda runs: runs.repartition("shard").sortWithinPartitions("shard")
    words = dealt(texts.mapInArrow(tidied(_count_words(parts, flush, block)), _RUNS)).mapInArrow(tidied(_save_words(uri)), "part int, words long, tokens long").collect()
    sizes = [0] * parts
    for r in words:
        sizes[r["part"]] = r["words"]
    offsets = (0, *np.cumsum(sizes).tolist())
    start, total = offsets[-1], sum(r["tokens"] for r in words)
    if start + 2 >= 2**32:
        raise ValueError(f"{start} distinct words: an n-gram's code has 32 bits for each")
    # rows of trigrams and of what they send on take about four times the memory
    shards, width = max(parts, -(-total // (SHARD_TOKENS if order == 2 else SHARD_TOKENS // 4))), min(width, start // parts + 1)
    flush = max(flush, 8 * shards)
    ranges = start // width + 1
    runs = dealt(texts.mapInArrow(tidied(_count_ngrams(uri, parts, offsets, shards, order, flush, block)), _RUNS))
    if order == 3:
        runs = dealt(runs.mapInArrow(tidied(_save_trigrams(uri, start, shards, flush)), _RUNS))
    runs = dealt(runs.mapInArrow(tidied(_save_bigrams(uri, order, width, ranges, flush)), _RUNS))
    sums = runs.mapInArrow(tidied(_save_tokens(uri, width, start)), "level int, " + ", ".join(f"x{k} long" for k in range(6)))
    found = {r[0]: [x or 0 for x in r[1:]] for r in sums.groupBy("level").agg(*(F.sum(f"x{k}").alias(f"x{k}") for k in range(6))).collect()}
    d = tuple(discounts(*found.get(k, [0] * 4)[:4]) for k in range(1, order + 1))
    n1, n2, _, _, contexts, more = found.get(1, [0] * 6)
    gamma = (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * more) / contexts if contexts else 1.0
    return NgramModel(uri, parts, offsets, shards, width, total, contexts or 1, gamma / (start + 1), d, order)


# --- scores


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and each one's place among them."""
    order = np.argsort(code)
    new = np.r_[True, code[order][1:] != code[order][:-1]]
    back = np.empty(len(code), np.int64)
    back[order] = np.cumsum(new) - 1
    return code[order][new], back


def _back_off(sums: np.ndarray, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts' counts and the weights that they leave to the lower order: 1 if never seen."""
    c = sums[:, 0]
    return c, np.where(c > 0, sums[:, 1:] @ np.array(d) / np.where(c > 0, c, 1), 1.0)


class Scorer:
    """Scores blocks of texts; each distinct token, bigram and trigram of a block is looked up once."""

    def __init__(self, model: NgramModel):
        self.model = model
        self.vocabulary = Vocabulary(model.uri, model.parts, model.offsets)
        self.tokens = Counts(model.uri, "ids", model.words // model.width + 1, 5, dense=True)
        self.bigrams = Counts(model.uri, "bigrams", model.shards, 1 if model.order == 2 else 5)
        self.trigrams = Counts(model.uri, "trigrams", model.shards, 1)
        self.shared = store.Opened(lambda k: store.load(model.uri, f"trigrams.{k}.shared", "u8").reshape(4, -1))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """n_tokens, n_known, base and model log10 probability of each text."""
        model, high = self.model, np.uint64(32)
        words, at, sizes = tokenized(texts)
        first = np.cumsum(sizes) - sizes
        ids, n = self.vocabulary(words)
        base = np.log10((n + 0.5) / (model.total + 0.5 * (model.words + 1)))
        ids = np.r_[ids, model.words]  # the last place stands for a text's start
        stats = np.zeros((len(ids), 5))  # seen, c, n1, n2, n3
        known = np.flatnonzero(ids >= 0) if model.total else []
        stats[known] = self.tokens(ids[known] % model.width, ids[known] // model.width)
        low = np.maximum(stats[:-1, 0] - discount(stats[:-1, 0], model.d[0]), 0) / model.contexts + model.unk
        c, back = _back_off(stats[:, 1:], model.d[1])
        pair, pair_at = _distinct(_before(at, first, len(words)).astype(np.uint64) << high | at.astype(np.uint64))
        a, b = (pair >> high).astype(np.int64), (pair & np.uint64(2**32 - 1)).astype(np.int64)
        p = back[a] * low[b]
        both = np.flatnonzero((c[a] > 0) & (ids[b] >= 0))
        code = ids[a[both]].astype(np.uint64) << high | ids[b[both]].astype(np.uint64)
        found = np.zeros((len(pair), self.bigrams.width), np.int64)
        found[both] = self.bigrams(code, _range_of(mix(code), model.shards))
        n2 = found[both, 0]
        p[both] += np.maximum(n2 - discount(n2, model.d[1]), 0) / c[a[both]]
        p, p_at = (p, pair_at) if model.order == 2 else self._trigrams(p, pair_at, first, ids, a, b, found[:, 1:])
        add = lambda x: np.add.reduceat(x, first)
        return [sizes, add((n > 0)[at].astype(np.int64)), add(base[at]), add(np.log10(p)[p_at])]

    def _trigrams(self, p: np.ndarray, pair_at: np.ndarray, first: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bigram probabilities interpolated with the trigrams' where their context, the bigram before, was seen."""
        c, back = _back_off(sums.astype(float), self.model.d[2])
        c, back = np.r_[c, 0.0], np.r_[back, 1.0]  # at a text's start there is no bigram before
        both, both_at = _distinct(_before(pair_at, first, len(a)).astype(np.uint64) << np.uint64(32) | pair_at.astype(np.uint64))
        before, own = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(2**32 - 1)).astype(np.int64)
        out = back[before] * p[own]
        seen = np.flatnonzero((c[before] > 0) & (ids[b[own]] >= 0))
        x, y = before[seen], own[seen]
        code, left = ids[a[y]].astype(np.uint64) << np.uint64(32) | ids[b[y]].astype(np.uint64), ids[a[x]].astype(np.uint64)
        key = mix(code, left)
        own = _range_of(key, self.model.shards)
        n = self.trigrams(key, own)[:, 0]
        for k in np.unique(own):
            keys, codes, lefts, counts = self.shared(int(k))
            for i in np.flatnonzero((own == k) & np.isin(key, keys)) if keys.size else ():  # one of some that share a key
                n[i] = counts[(keys == key[i]) & (codes == code[i]) & (lefts == left[i])].sum()
        out[seen] += np.maximum(n - discount(n, self.model.d[2]), 0) / c[x]
        return out, both_at


def _score(model: NgramModel, block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            at = 0
            for texts in text_blocks(b.column("text"), block):
                part = b.slice(at, len(texts))
                at += len(texts)
                n, known, base, own = score(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total), pa.int64()), pa.array(base), pa.array(own)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: NgramModel, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone. Tokens that no training text has share the
    lowest order's uniform part. Contexts never seen pass all weight down. Sums are over whole
    texts of any length, a text at a time where it is longer than a block; repeated rows and ids
    each get their scores; an empty table gives no rows; extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(F.col(doc_id), 5) == 1).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidied(_score(model, block)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
