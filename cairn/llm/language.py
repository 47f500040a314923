"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, tidied

#: Bytes of a window; every window starts from a state of zeros. Byte 256 is padding.
SPAN = 128
#: Bytes of a piece to learn from, and groups by hash that a language's texts and pieces are chosen in.
TRAIN_SPAN, SALTS = 64, 64
#: Probabilities (positions, labels and windows) that are held at a time.
CELLS = 16_000_000
PAD = 256
UNDETERMINED = "und"
_ROWS = 2048


def _letters(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def windows(data: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings to padded windows (rows of `span` bytes), and the string that each row comes from."""
    counts = [-(-len(d) // span) for d in data]
    out = np.full((sum(counts), span), PAD, np.int16)
    flat, at = out.reshape(-1), 0
    for d, n in zip(data, counts, strict=True):
        flat[at : at + len(d)] = np.frombuffer(d, np.uint8)
        at += n * span
    return out, np.repeat(np.arange(len(data)), counts)


class Direction:
    """One direction's gated recurrent unit. The table holds, by byte, what it adds to gates z, r and candidate n."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.params = [rng.normal(0, 0.3, (3 * hidden, PAD + 1)).astype("f4"), rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype("f4")]

    def run(self, x: np.ndarray, keep: bool = False) -> Iterator[tuple]:
        """States for x (time, row), in place unless kept; `keep` also yields what the backward pass needs."""
        table, u = self.params
        k, rows = self.hidden, x.shape[1]
        h = np.zeros((k, rows), "f4")
        a, g, n, d = (np.empty((m * k, rows), "f4") for m in (3, 3, 1, 1))
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            zr = a[: 2 * k]
            zr += g[: 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            np.multiply(zr[k:], g[2 * k :], out=n)
            n += a[2 * k :]
            np.tanh(n, out=n)
            if keep:
                old = h.copy()
            np.subtract(h, n, out=d)
            d *= zr[:k]
            np.add(d, n, out=h)
            yield (h.copy(), old, zr.copy(), n.copy(), g[2 * k :].copy()) if keep else (h,)

    def back(self, x: np.ndarray, kept: list[tuple], dh_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the table and the recurrent weights, by backpropagation through time."""
        _, u = self.params
        k = self.hidden
        du, dh, da = np.zeros_like(u), np.zeros_like(kept[0][0]), np.empty((len(x), 3 * k, x.shape[1]), "f4")
        for t in range(len(x) - 1, -1, -1):
            _, old, zr, n, gn = kept[t]
            z, r = zr[:k], zr[k:]
            dh = dh + dh_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            da[t, :k] = dh * (old - n) * z * (1 - z)
            da[t, k : 2 * k] = dn * gn * r * (1 - r)
            da[t, 2 * k :] = dn
            dg = da[t].copy()
            dg[2 * k :] *= r
            du += dg @ old.T
            dh = dh * z + u.T @ dg
        flat = x.ravel()
        dtable = np.stack([np.bincount(flat, row.ravel(), PAD + 1) for row in da.transpose(1, 0, 2)]).astype("f4")
        return [dtable, du]


@dataclass
class ByteTagger:
    """Both directions and a linear layer that labels each position."""

    labels: list[str]
    forward: Direction
    backward: Direction
    out: list[np.ndarray]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Sums over each window's own bytes of the label probabilities at each position."""
        x = np.ascontiguousarray(rows.T)
        vf, vb, bias = self.out
        logits = np.empty((len(x), len(self.labels), x.shape[1]), "f4")
        for t, (h,) in enumerate(self.forward.run(x)):
            np.matmul(vf, h, out=logits[t])
        for t, (h,) in enumerate(self.backward.run(x[::-1])):
            logits[len(x) - 1 - t] += vb @ h
        logits += bias[:, None]
        np.exp(np.minimum(logits, 60), out=logits)
        scale = logits.sum(1)
        np.divide(x != PAD, scale, out=scale)
        logits *= scale[:, None]
        return logits.sum(0).T


def train(data: list[bytes], labels: list[str], hidden: int = 8, span: int = TRAIN_SPAN, batch: int = 256, steps: int = 400, rate: float = 0.02, seed: int = 7) -> ByteTagger | None:
    """Fits the network on random windows, languages in equal parts, to label each byte with its text's language."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = ByteTagger(names, Direction(hidden, rng), Direction(hidden, rng), [rng.normal(0, 0.3, (len(names), hidden)).astype("f4") for _ in range(2)] + [np.zeros(len(names), "f4")])
    if len(names) == 1:
        return net
    of = {name: [] for name in names}
    for d, y in zip(data, labels, strict=True):
        of[y].append(d)
    pools = [windows(of[name], span)[0] for name in names]
    batch = max(8, min(batch, CELLS // (span * len(names))))  # with very many languages a step sees fewer windows
    params = [*net.forward.params, *net.backward.params, *net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        x = np.stack([pools[k][rng.integers(len(pools[k]))] for k in y]).T.astype(np.int64)
        kf, kb = list(net.forward.run(x, True)), list(net.backward.run(x[::-1], True))
        hf, hb = np.stack([k[0] for k in kf]), np.stack([k[0] for k in kb])[::-1]
        vf, vb, bias = net.out
        logits = vf @ hf + vb @ hb + bias[:, None]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own = (x != PAD)[:, None, :]
        d = p
        d[:, y, np.arange(batch)] -= 1
        d = (d * own / max(1, own.sum())).astype("f4")
        # the last axes are (label, row): summed over time and rows
        dvf, dvb = np.einsum("tlb,thb->lh", d, hf, optimize=True), np.einsum("tlb,thb->lh", d, hb, optimize=True)
        grads = net.forward.back(x, kf, vf.T @ d) + net.backward.back(x[::-1], kb, (vb.T @ d)[::-1]) + [dvf, dvb, d.sum((0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p_, g, a, b in zip(params, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p_ -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def _first_by_hash(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about `most` rows of each key: the first of each of SALTS groups (fewer for few rows) by `mark`, so that a
    frequent key is many groups. `mark` is a hash."""
    salts = min(SALTS, most)
    order = Window.partitionBy(key, F.pmod("mark", F.lit(salts))).orderBy("mark", "data")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= -(-most // salts)).drop("place")


def training_sample(docs: DataFrame, pieces: int, per_language: int, per_network: int, least: int = 8) -> tuple[list[bytes], list[str]]:
    """Pieces of TRAIN_SPAN bytes of training texts, and their languages.

    All languages share `pieces`: each has about as many of them as any other, `per_network` at most and `least` at least,
    taken from whole texts that are chosen by hash, `per_language` at most. So every language that a training text has can
    be predicted, and what reaches the driver grows with the number of languages only, by a few pieces each.
    """
    rows = docs.where((F.octet_length("text") > 0) & F.col("lang").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    languages = rows.select("lang").distinct().count()
    each = max(least, min(per_network, pieces // max(1, languages)))
    chosen = _first_by_hash(rows.select("lang", F.xxhash64("doc_id", "text").alias("mark"), F.encode("text", "UTF-8").alias("data")), "lang", min(per_language, each))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / TRAIN_SPAN).cast("int"))
    cut = chosen.select("lang", "mark", F.posexplode(F.transform(starts, lambda k: F.substring(F.col("data"), k * TRAIN_SPAN + 1, F.lit(TRAIN_SPAN)))).alias("no", "data"))
    taken = _first_by_hash(cut.select("lang", F.xxhash64("mark", "no").alias("mark"), "data"), "lang", each)
    found = sorted((r["lang"], r["mark"], bytes(r["data"])) for r in taken.collect())
    return [d for _, _, d in found], [y for y, _, _ in found]


def _labelled(net: ByteTagger | None, batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Batches cut to a few MB of text, with each row's label and score."""

    def of(data: list[bytes]) -> tuple[list[str], np.ndarray]:
        known = [i for i, d in enumerate(data) if d] if net else []
        sums = np.zeros((len(data), len(net.labels) if net else 1))
        rows, owner = windows([data[i] for i in known], SPAN)
        some = max(16, min(_ROWS, CELLS // (SPAN * sums.shape[1])))
        for k in range(0, len(rows), some):
            np.add.at(sums, np.asarray(known)[owner[k : k + some]], net.probabilities(rows[k : k + some]))
        label = [net.labels[b] if d and net else UNDETERMINED for b, d in zip(sums.argmax(1), data, strict=True)]
        return label, np.minimum(1.0, sums.max(1) / np.array([max(1, len(d)) for d in data]))

    for b in batches:
        texts, data, begun, size = b.column(text), [], 0, 0
        for i in range(b.num_rows):
            t = texts[i].as_py()
            data.append(t.encode("utf-8", "replace") if _letters(t) else b"")
            size += len(data[-1])
            if size > 2_000_000 or i == b.num_rows - 1:
                yield b.slice(begun, len(data)), *of(data)
                data, begun, size = [], i + 1, 0


def labelled(docs: DataFrame, net: ByteTagger | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each whole text by a network."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, label, score in _labelled(net, batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(label, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, pieces: int = 200_000, per_language: int = 300, per_network: int = 8000, hidden: int = 8, steps: int = 400) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The network labels every byte of every whole text, in windows of SPAN bytes that both
    directions read; a document's probabilities are the means over its bytes. It learns from a
    bounded sample of whole texts outside the held-out fold (see training_sample); the language
    column serves as the target of training and nowhere else.

    A text that is null, empty or has no letter is `und` with score 0, as is every text if there
    is nothing to learn from. Repeated rows each get their label; texts of any length are labelled
    whole; an empty table gives no rows; extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    return labelled(docs, train(*training_sample(docs, pieces, per_language, per_network), hidden=hidden, steps=steps))


def keep_identified(docs: DataFrame, least: float = 0.4, pieces: int = 200_000, per_language: int = 300, per_network: int = 8000, hidden: int = 8, steps: int = 400) -> DataFrame:
    """The rows whose language the network tells with at least the score `least`, with all their columns, in one pass.

    Null, empty and letterless texts go, as do all if there is nothing to learn from. Each row is judged by its whole text
    alone, repeated ones alike; ids and other columns may be null or have any name. An empty table gives no rows.
    """
    net = train(*training_sample(docs.select("doc_id", "text", "lang"), pieces, per_language, per_network), hidden=hidden, steps=steps)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, label, score in _labelled(net, batches, "text"):
            yield part.filter(pa.array([y != UNDETERMINED and s >= least for y, s in zip(label, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
