"""The training-data operators: SQL, brute force, round trips, held-out accuracy, and odd rows."""

from __future__ import annotations

import hashlib
import importlib.util
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, same  # noqa: E402

from cairn.llm import chat, common, decontaminate, exact_dedup, kneser_ney, language, licences, mixing, near_dup, quality, queries, store, tokens  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty, blank, letterless and repeated texts, repeated rows, names that operators use inside.
ODD = [
    (1, "The old gods sing. The old gods sing.", "en", "a", 1),
    (2, "The  old gods\tsing. The old gods sing.", "en", "a", 1),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, "  \n ", "fr", "c", 3),
    (6, "12 34 !!", "fr", "c", 8),
    (7, "Élan vital, ÉLAN <s>[INST] x [/INST]</s> \\", "fr", None, 9),
    (7, "Élan vital, ÉLAN <s>[INST] x [/INST]</s> \\", "fr", None, 9),
    (8, "word " * 30_000, "en", "a", 150_000),
    (None, "a null id", "en", "a", 9),
    (None, None, None, None, None),
    (9, "All rights reserved. cc by all rights reserved", "en", "b", 1),
    (10, "x", "en", "b", 1),
]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, DOC)
    for c in ("size", "key", "n", "best", "content", "words", "row", "own", "mark", "h"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, small, con, name):
    same(queries.QUERIES[name](spark, small), queries.ORACLES[name], con)


def docs_of(spark, folder):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- 1 mixing


def fill(sizes, weights, share, epochs):
    """Water-filling round by round."""
    budget, clamped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in clamped]
        left = budget - sum(epochs * sizes[s] for s in clamped)
        target = {s: left * weights[s] / sum(weights[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > epochs * sizes[s]}
        if not over:
            return target | {s: float(epochs * sizes[s]) for s in clamped}
        clamped |= over


def test_mixing_follows_the_rounds(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a", "b", "b", "b", "Z", "é", None]), 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    names = [*sorted(s for s in sizes if s is not None), None]
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5, 2)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOC)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_boundary_of_a_hot_source_is_searched_in_finer_buckets(spark):
    """One source with nearly all rows, and ids that many rows share: the same mix, and few rows to put in order."""
    ids = F.when(F.col("id") % 50 == 0, 7).otherwise(F.col("id"))
    source = F.when(F.col("id") % 9 == 0, "b").when(F.col("id") % 10 < 9, "a")
    df = spark.range(60_000).select(ids.alias("doc_id"), source.alias("source"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 5).cast("int")), " ").alias("text"))
    result = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert result(mixing.mix(df, edge_rows=1)) == result(mixing.mix(df, edge_rows=10**9))
    words = lambda df: sorted((r["doc_id"], r["mix_copy"], r["mix_words"]) for r in df.select("doc_id", "mix_copy", "mix_words").collect())
    assert words(mixing.mixed_documents(df, edge_rows=1)) == words(mixing.mixed_documents(df, edge_rows=10**9))
    rows = common.checkpointed(mixing._marked(df, "doc_id", "text", "source", "mix-1").drop("row"))
    edges = {r["own"]: r["edge"] for r in mixing.mixing_plan(rows, (5, 2, 1), 1.5, 2, edge_rows=4)[0].collect() if r["edge"]}
    assert edges and any(len(e) > 3 for e in edges.values())
    held = {s: sum(r["source"] == s and r["mark"].startswith(e) for r in rows.collect()) for s, e in edges.items()}
    assert all(n <= 4 for n in held.values()), held


def test_mixed_documents_are_the_mix(spark):
    df = odd(spark)
    mixed = mixing.mixed_documents(df).collect()
    want, got = Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r["source"]] += r["taken"]
    for r in mixed:
        assert len(r["text"].split()) == r["mix_words"] and r["size"] == "clash"
        got[r["source"]] += r["mix_words"]
    assert +want == got
    assert mixing.mixed_documents(odd(spark, [])).count() == 0 and mixing.mix(odd(spark, [])).count() == 0


def test_mixed_documents_keep_columns_of_the_mixs_names(spark):
    df = odd(spark).withColumns({c: F.lit("clash") for c in ("mix_copy", "MIX_WORDS", "copy", "again", "bucket")})
    got = mixing.mixed_documents(df)
    assert got.columns == [*df.columns, "mix_copy_", "mix_words_"]
    assert {r["mix_copy"] for r in got.collect()} == {"clash"} and got.agg(F.min("mix_copy_")).first()[0] == 1


def test_mixing_without_broadcast(spark, monkeypatch):
    df = odd(spark)
    before = sorted(map(tuple, mixing.mix(df).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=repr) == before


# --- 2 token counts


@pytest.fixture(scope="module")
def pieces():
    return tokens.piece_scores(f"{tokens.TOKENIZERS}/{tokens.PIECES}")


def library(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    low = min(s for _, s in pieces)
    vocabulary = [("<unk>", low), *((f"<0x{b:02X}>", low) for b in range(256)), *pieces]
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


def test_counts_are_the_librarys(spark, small, pieces):
    t, counter = library(pieces), tokens.UnigramCounter(pieces)
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "a\n\nb\n", "\n", "▁x▁", "日本語 text ☃☃", "a\tb\r\nc", "x" * 300] + ["".join(rng.choice("ab eé☃\n th▁") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [x for _, x, _ in docs_of(spark, small)[:150] if x]
    for x in texts:
        assert counter(x)[0] == len(t.encode(x).ids), x


def test_ties_go_to_the_earliest_start():
    counter = tokens.UnigramCounter([("▁a", -1.0), ("b", -1.0), ("▁", -1.0), ("ab", -1.0), ("▁ab", -2.0), ("a", -9.0)])
    assert counter.segment("▁ab") == (1, -2.0)
    for word in ("▁ab", "▁abab", "▁aab", "▁b☃b"):
        assert counter.segment(word)[1] == pytest.approx(max(paths(counter, word)))


def test_runs_of_blanks_are_segmented_whole(spark, pieces):
    """As the unigram model over the text in one piece, with the query's vocabulary."""
    from tokenizers import pre_tokenizers

    t, counter = library(pieces), tokens.UnigramCounter(pieces, split=False)
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    code = "if x:" + " " * 16 + "return"
    assert counter(code) == (6, -1000030049)
    assert [r[1:] for r in tokens.token_counts(odd(spark, [(1, code, "en", "a", 1)])).collect()] == [(6, -1000030049)]
    rng = random.Random(7)
    texts = [" " * n + "a" + " " * n for n in range(40)] + ["a.  B\n    c\n\n  ", "\n  x", "   ", " ▁ x"]
    texts += ["".join(rng.choice(["a", "the", "☃", "\n", ":", " ", "  ", " " * 5, " " * 17]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for x in texts:
        whole = x.replace(" ", "▁")
        whole = whole if whole[:1] in ("", "▁") else "▁" + whole
        assert counter(x) == counter.segment(whole) and counter(x)[0] == len(t.encode(x).ids), x


def test_a_very_long_word_takes_little_memory(pieces):
    import tracemalloc

    rng = random.Random(6)
    word = "".join(rng.choice("abcde/+é日") for _ in range(200_000))
    counter = tokens.UnigramCounter(pieces, split=False)
    tracemalloc.start()
    n, score = counter(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(word) and not counter.count
    best, count = [0.0], [0]  # all positions kept
    by = dict(pieces)
    text, longest = "▁" + word, max(map(len, by))
    for e in range(1, len(text) + 1):
        found = [(best[s] + by[text[s:e]], count[s] + 1) for s in range(max(0, e - longest), e) if text[s:e] in by]
        if text[e - 1] not in by:
            found.append((best[e - 1] + counter.unknown, count[e - 1] + len(text[e - 1].encode())))
        top = max(f[0] for f in found)
        best.append(top)
        count.append(next(f[1] for f in found if f[0] == top))
    assert (n, score) == (count[-1], best[-1])


def test_pieces_over_a_cut_are_refused():
    for bad in ("a▁b", "▁▁a▁", "a\n", "\n▁"):
        with pytest.raises(ValueError):
            tokens.UnigramCounter([("a", -1.0), (bad, -1.0)])


def paths(counter, word):
    known = {}
    for end, (size, score) in counter.automaton.iter(word):
        known[end + 1 - size, end + 1] = score
    best = {0: [0.0]}
    for e in range(1, len(word) + 1):
        best[e] = [x + s for (a, b), s in known.items() if b == e for x in best[a]]
        if (e - 1, e) not in known:
            best[e] += [x + counter.unknown for x in best[e - 1]]
    return best[len(word)]


def test_token_counts_of_odd_rows(spark, pieces):
    rows = tokens.token_counts(odd(spark)).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    assert tokens.token_counts(odd(spark, [])).count() == 0


# --- 3 language


def test_language_held_out_accuracy(spark, small):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_language_id"](spark, small).collect()}
    docs = docs_of(spark, small)
    assert len(rows) == len(docs)
    assert all(rows[i]["held_out"] == (crc(i, 3) == 1) and 0 <= rows[i]["score"] <= 1 for i, _, _ in docs)
    held = [rows[i]["lang_pred"] == y for i, _, y in docs if rows[i]["held_out"]]
    assert np.mean(held) > 0.95


def test_language_of_odd_rows(spark):
    rows = language.identify_languages(odd(spark), steps=5).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {3, 4, 5, 6, None}
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "fr"}
    kept = language.keep_identified(odd(spark), least=0.0, steps=5)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 7, 7, 8, 9, 10] and kept.columns == odd(spark).columns
    assert language.identify_languages(odd(spark, [])).count() == 0
    untaught = language.identify_languages(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(1)
    d = language.Direction(3, rng)
    x = rng.integers(0, 4, (5, 2))
    target = rng.normal(size=(5, 3, 2))
    loss = lambda: float(sum((h * target[t]).sum() for t, (h,) in enumerate(d.run(x))))
    kept = list(d.run(x, True))
    grads = d.back(x, kept, target.astype("f4"))
    for p, g in zip(d.params, grads, strict=True):
        for at in ((0, 1), (4, 2), (8, 0), (3, 2)):
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            slope = (up - loss()) / 2e-2
            p[at] = old
            assert slope == pytest.approx(float(g[at]), abs=2e-2)


def test_labels_are_those_of_the_network_byte_by_byte(spark):
    """A fixed network, its gates written out for one byte at a time."""
    net = language.train([b"the gods sing", b"le vent du nord", b"der wind"] * 3, ["en", "fr", "de"] * 3, hidden=3, steps=20)
    texts = ["the north wind", "", "été " * 50, "x", "12"]
    sigma = lambda v: 1 / (1 + np.exp(-v.astype(float)))

    def states(d, data):
        (table, u), k, h, out = d.params, d.hidden, np.zeros(d.hidden), []
        for c in data:
            a, g = table[:, c], u @ h
            z, r = sigma(a[:k] + g[:k]), sigma(a[k : 2 * k] + g[k : 2 * k])
            n = np.tanh(a[2 * k :] + r * g[2 * k :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    def whole(data):
        total = np.zeros(3)
        for at in range(0, len(data), language.SPAN):
            part = data[at : at + language.SPAN]
            pad = [language.PAD] * (language.SPAN - len(part))
            f, b = states(net.forward, part), states(net.backward, [*pad, *part[::-1]])[len(pad) :][::-1]
            for x, y in zip(f, b, strict=True):
                e = np.exp(net.out[0] @ x + net.out[1] @ y + net.out[2])
                total += e / e.sum()
        return total / len(data)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.labelled(df, net).collect():
        t = texts[r["doc_id"]]
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            p = whole(t.encode())
            assert r["lang_pred"] == net.labels[p.argmax()] and r["score"] == pytest.approx(p.max(), abs=1e-4)


def test_language_sample_is_bounded_and_of_whole_texts(spark):
    rows = [(3 * i, "a" * 6400 + "z" * 64, "en" if i % 9 else "fr", None, 0) for i in range(900)] + [(3 * i, "q", "de", None, 0) for i in range(3)]
    data, labels = language.training_sample(odd(spark, rows), 100_000, 70, 640)
    assert set(labels) == {"en", "fr", "de"} and labels.count("en") <= 640 and {len(d) for d in data} == {64, 1}
    assert b"z" * 64 in data


def test_no_language_is_too_rare_to_be_learnt(spark):
    """250 languages, some of one text: all share the sample and all can be predicted."""
    ids = (i for i in range(10_000) if crc(i, 3) != 1)
    rows = [(next(ids), f"word{k} " * 40, f"l{k:03}", None, 0) for k in range(250) for _ in range(1 + 30 * (k == 0))]
    data, labels = language.training_sample(odd(spark, rows), 2_000, 300, 8000)
    count = Counter(labels)
    assert len(count) == 250 and max(count.values()) <= 8 and len(data) <= 2_000
    assert len(language.train(data, labels, steps=2).labels) == 250
    assert language.identify_languages(odd(spark, rows), steps=2).count() == len(rows)


# --- 4 licences


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_licence_base_is_brute_force(spark, small):
    got = {r["doc_id"]: r for r in licences.scan_licences(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    some = 0
    for i, text, _ in docs_of(spark, small):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", common.lower_az(text))
        found = [(p, label) for phrase, label in licences.BASE_PHRASES.items() for p in places(words, phrase.split())]
        r = got[i]
        starts = [p for p, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        some += bool(found)
    assert some > 3


def test_all_labels_are_brute_force(spark):
    rng = random.Random(8)
    words = sorted({w for t in licences.templates() for w in t.words})
    texts = []
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            new = list(rng.choice(licences.templates()).words)
            for _ in range(rng.choice([0, 0, 1, 4])):
                new[rng.randrange(len(new))] = rng.choice(words)
            text += new[rng.choice([0, 0, 0, 3]) : rng.choice([None, None, -2])] + [rng.choice(words)]
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter()
    for r in licences.scan_licences(df).collect():
        w = texts[r["doc_id"]].split()
        found = []
        for t in licences.templates():
            for s in range(-len(t.words), len(w)):
                if all(s + q >= 0 and tuple(w[s + q : s + q + len(k)]) == k for q, k in t.keys):
                    share = sum(0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(t.words)) / len(t.words)
                    if t.base or share >= 0.6:
                        found.append((s, t.label, share))
        assert sorted((m["start"], m["label"], m["share"]) for m in r["matches"]) == sorted(found)
        assert r["labels"] == ",".join(sorted({x for _, x, _ in found})) and r["score"] == max([x for *_, x in found], default=0)
        seen.update(x for _, x, _ in found)
    assert set(seen) == {t.label for t in licences.templates()}


def test_licence_notices_and_odd_rows(spark):
    texts = ["Released under the MIT License.", "the word MIT, License", "This work is licensed under the GNU General Public License, version 3.", "mit release", "Licensed under CC BY-NC 4.0 CC BY, cc by", None]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["mit", "", "gpl,gpl-3", "", "cc-by,cc-by-nc-4", ""]
    assert (got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == (3, 2, 9)
    assert got[5]["n_words"] == 0 and got[5]["first_word"] is None
    rows = licences.scan_licences(odd(spark)).collect()
    assert len(rows) == len(ODD) and next(r for r in rows if r["doc_id"] == 9)["n_base"] == 3
    assert licences.scan_licences(odd(spark, [])).count() == 0


# --- 5 near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", common.lower_az(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    for i, j in {(i, j) for g in by.values() for i in g for j in g if i < j}:
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_rows(spark, rows, **how):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, **how).collect()), key=repr)


@pytest.mark.parametrize("seed, heavy, stars", [(0, 4096, 2), (1, 3, 2), (2, 3, 0), (3, 1, 1)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, seed, heavy, stars):
    """With and without blocks of frequent n-grams and the turns that only save work."""
    monkeypatch.setattr(near_dup, "STAR_TURNS", stars)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(30)]
    rows = []
    for base in range(6):
        text = [word() for _ in range(rng.randint(1, 90))] + passage * (base % 2)
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1, 2])
            rows.append(" ".join(copy))
    rows += ["", None, "a b", "A  b", "a b c", " ".join(passage), " ".join(passage[:-3]), " ".join(passage[2:])]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1)) + [(None, "a b"), (3, "x y z"), (3, "x y z"), (None, None)]
    assert near_rows(spark, rows, heavy=heavy) == components(rows)


def test_texts_of_one_template_that_are_not_linked(spark, monkeypatch):
    """No pair of these is a link, and all n-grams of the template are in all texts."""
    monkeypatch.setattr(near_dup, "STAR_TURNS", 0)
    template = [f"t{i}" for i in range(84)]
    rows = [(k, " ".join(template + [f"d{k}x{i}" for i in range(25)])) for k in range(400)]
    assert near_rows(spark, rows, heavy=50) == near_rows(spark, rows) == [(k, 105, k) for k in sorted(range(400), key=lambda k: repr((k, 105, k)))]


def test_counts_discard_pairs(spark):
    """Blocks of the matrix give each pair its count and last places once, whichever way they are cut."""
    rng = random.Random(4)
    rows = [(k, sorted(rng.sample(range(60), rng.randint(3, 14))), rng.randint(15, 20)) for k in range(40)]
    name = lambda k: f"{k:032d}"
    postings = spark.createDataFrame([(g, n, p, name(k), name(k % 30)) for k, grams, n in rows for p, g in enumerate(grams)], "gram long, n int, pos int, key string, comp string")
    labels = spark.createDataFrame([(name(k), name(k % 30)) for k in range(40)], "key string, comp string")
    want = {}
    for k, x, n in rows:
        for j, y, m in rows:
            both = [(x.index(g), y.index(g)) for g in x if g in y]
            both = [(a, b) for a, b in both if min(n - a, m - b) * 175 >= 75 * (n + m)]
            if k < j and k % 30 != j % 30 and both and 4 * min(n, m) >= 3 * max(n, m):
                want[name(k), name(j)] = (len(both), both[-1][0], both[-1][1])
    for heavy in (1000, 4, 1):
        with store.scratch(spark) as uri:
            got = near_dup._product(postings, labels, 75, heavy, uri).collect()
        assert {(r["a"], r["b"]): (r["common"], r["last_a"], r["last_b"]) for r in got} == want and want


def test_two_attempts_of_a_task_keep_their_sets_apart(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(9 + k)) for k in range(12)]
    grams = near_dup.shingle_sets(near_dup.pa.array(texts), 5)
    every, uri = np.unique(np.concatenate(grams)), f"file://{tmp_path}"
    store.save(uri, "0.hash", every)
    store.save(uri, "0.count", np.full(len(every), 2, np.uint32))
    seen = []
    for order in (texts, texts[::-1]):
        rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(order)], "doc_id long, mark long, text string").coalesce(1)
        seen += rows.mapInArrow(near_dup._prefixes(5, 1, uri, 75), "doc_id long, mark long, n int, key string, alone int, prefix array<long>, part long, at long").collect()
    sets = store.Reader(uri, "u8")
    assert len(seen) == 2 * len(texts)
    for r in seen:
        assert hashlib.blake2b(sets(f"{r.part}.sets", r["at"], r.n).tobytes(), digest_size=16).hexdigest() == r.key


def test_near_rows_of_one_id_are_told_apart(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (3, a + " more"), (3, "another text of its own"), (4, None), (4, None), (5, "x y"), (5, "x y"), (None, a + " less"), (None, "free"), (6, "p q r"), (6, "P q r")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).withColumns({c: F.lit("clash") for c in ("mark", "own", "row", "stays", "own_id")})
    for limit in (near_dup.BROADCAST_ROWS, 0):
        near_dup.BROADCAST_ROWS, before = limit, near_dup.BROADCAST_ROWS
        kept = near_dup.drop_near_duplicates(df)
        near_dup.BROADCAST_ROWS = before
        assert kept.columns == df.columns
        got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=repr)
        assert got == sorted([(1, a), (3, "another text of its own"), (4, ""), (4, ""), (5, "x y"), (None, "free"), (6, "p q r")], key=repr)
    assert near_dup.drop_near_duplicates(df.limit(0)).count() == 0


def test_a_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[8 * k : 8 * k + 100])) for k in range(30)]
    want = components(rows)
    assert {c for _, _, c in want} == {71}
    assert near_rows(spark, rows) == want


def test_the_edge_of_the_bound(spark):
    # 24 of 32 shingles in common: exactly 75 %; and one less
    a = " ".join(f"a{i}" for i in range(32))
    b = " ".join([f"a{i}" for i in range(28)] + [f"b{i}" for i in range(4)])
    c = " ".join([f"a{i}" for i in range(27)] + [f"c{i}" for i in range(5)])
    for rows in ([(1, a), (2, b)], [(1, a), (2, c)], [(5, a), (6, " ".join(a.split()[:25]))], [(5, a), (6, " ".join(a.split()[:24]))]):
        assert near_rows(spark, rows) == components(rows)


def test_near_duplicates_keep_one(spark):
    kept = near_dup.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10, None}
    assert near_dup.near_duplicates(odd(spark, [])).count() == 0


# --- 6 decontamination


def test_decontamination_without_broadcast_and_odd_rows(spark):
    items = spark.createDataFrame([(1, "All rights reserved"), (2, "the old gods sing the old gods sing x x x x x x x"), (3, None), (4, "!!"), (None, "cc by"), (5, " ".join(f"q{i}" for i in range(40)))], "item_id long, text string")
    rows = [*ODD, (11, "z " * 5 + " ".join(f"Q{i}" for i in range(3, 30)), "en", "a", 0), (12, " ".join(f"q{i}" for i in range(12)), "en", "a", 0)]
    df = odd(spark, rows)
    got = sorted(map(tuple, decontaminate.contamination(df, items).collect()), key=repr)
    assert sorted(map(tuple, decontaminate.contamination(df, items, limit=0).collect()), key=repr) == got
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert by[9][1:4] == (8, 8, 2) and by[9][4] == hashlib.sha256(b",1").hexdigest() and by[9][5]
    assert by[11][1:4] == (32, 27, 1) and by[12][2] == 0 and by[3][1:4] == (0, 0, 0) and not by[3][5]
    df = df.withColumns({c: F.lit("clash") for c in ("__key", "own_id", "n_words")})
    kept = decontaminate.drop_contaminated(df, items)
    assert kept.columns == df.columns and {r["__key"] for r in kept.collect()} == {"clash"} and kept.count() == len(rows) - 2
    assert decontaminate.contamination(df, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd(spark, []), items).count() == 0


# --- 7 quality


def test_quality_held_out(spark, small):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert all(r["held_out"] == (crc(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())


def test_quality_of_a_fixed_model_is_brute_force(spark):
    import zstandard

    model = quality.CompressionModel(b"the gods sing " * 40, b"buy now cheap " * 40, 9.0, -0.5, 0.25, 1)
    size = lambda d, x: len(zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
    for r, (i, text, *_) in zip(sorted(quality.scored(odd(spark), model, 0.3).collect(), key=lambda r: repr(r["doc_id"])), sorted(ODD, key=lambda r: repr(r[0])), strict=True):
        data = (text or "").encode()
        parts = [data[k : k + 256] for k in range(0, len(data), 256)]
        g, b = (sum(size(d, x) for x in parts) for d in (model.good, model.bad))
        if i is not None:
            assert r["score"] == pytest.approx(1 / (1 + math.exp(-(9 * (b - g) / (b + g) - 0.5))) if data else 0.25)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_quality_learns_from_whole_texts_and_one_row_an_id(spark):
    rows = [(i, ("x" * 10_000 + " gods sing of old" * 900) if i % 2 else "buy cheap pills now " * 20, "en", "a", 0) for i in range(1, 60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    df = odd(spark, rows + [(1, "a repeat", "en", "a", 0)] * 50)
    model = quality.fit(df.select("doc_id", "text"), labels, 20, 100_000, 16 << 10, 1)
    assert model.good and model.bad and b"gods" in model.good
    held = {r["doc_id"]: r for r in quality.scored(df, model, 0.3).collect()}
    assert held[2]["score"] < 0.5


def test_quality_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd(spark), none).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.5}
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 0), (1, 0, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd(spark), some).count() == len(ODD)
    assert quality.quality_scores(odd(spark, []), some).count() == 0


# --- 8 exact dedup


def brute_dedup(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        stay = True
        for d in sorted(ids, key=lambda i: (i is None, i)):
            out.append((d, keep, len(ids), stay, hashlib.sha256(t.encode()).hexdigest()))
            stay = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [exact_dedup.TABLE_BYTES, 200])
def test_exact_dedup_with_and_without_spilling(spark, limit):
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, f"text {rng.randint(0, 60)}" + " " * rng.randint(1, 2)) for i in range(400)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC).repartition(3)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(df, table_bytes=limit).collect()), key=repr)
    assert got == brute_dedup(rows)


def test_a_row_that_is_repeated_very_often(spark):
    many = spark.range(1_000_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a  b").alias("text"))
    rest = spark.createDataFrame([(7, "a b"), (None, "a\tb"), (8, "c")], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(many.unionByName(rest)).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(5, 5, 1_000_002, True, 1), (5, 5, 1_000_002, False, 999_999), (7, 5, 1_000_002, False, 1), (None, 5, 1_000_002, False, 1), (8, 8, 1, True, 1)], key=repr)
    kept = exact_dedup.drop_exact_duplicates(many.limit(1000).unionByName(rest).withColumns({c: F.lit("clash") for c in ("__own", "own", "row", "digest", "stays")}))
    assert sorted((r["doc_id"], r["__own"]) for r in kept.collect()) == [(5, "clash"), (8, "clash")]


def test_grace_recursion_with_colliding_hashes(tmp_path):
    rng = random.Random(2)
    rows = [(h << 60 | 7, f"{rng.randint(0, 90)}".encode(), i, 1) for i, h in ((i, rng.choice([0, 0, 0, 5])) for i in range(500))]
    got = {(h, t): (i, n) for h, t, i, n in exact_dedup.grace_groups(iter(rows), str(tmp_path), 500)}
    want = {}
    for h, t, i, _ in rows:
        a, n = want.get((h, t), (i, 0))
        want[h, t] = (min(a, i), n + 1)
    assert got == want and not list(tmp_path.iterdir())


def test_exact_dedup_keeps_one_of_each(spark):
    kept = exact_dedup.drop_exact_duplicates(odd(spark))
    for limit in (exact_dedup.BROADCAST_ROWS, 0):
        exact_dedup.BROADCAST_ROWS, before = limit, exact_dedup.BROADCAST_ROWS
        kept = exact_dedup.drop_exact_duplicates(odd(spark))
        exact_dedup.BROADCAST_ROWS = before
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8, 9, 10]
    assert exact_dedup.exact_duplicates(odd(spark, [])).count() == 0


# --- 9 language model


def lm_tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", common.lower_az(text or "").encode()), b""]


def reference_model(texts):
    """Interpolated modified Kneser-Ney bigrams over token tuples."""
    pairs, ctx = Counter(), Counter()
    for t in texts:
        w = lm_tokens(t)
        pairs.update(zip([None, *w[:-1]], w, strict=True))
    for (h, _), n in pairs.items():
        ctx[h] += n
    coc = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    seen = Counter(w for _, w in pairs)
    d, e = kneser_ney.discounts(*coc(pairs)), kneser_ney.discounts(*coc(seen))
    cut = lambda n, x: 0 if n == 0 else x[min(n, 3) - 1]
    total = sum(seen.values())
    gamma = sum(cut(n, e) for n in seen.values()) / total
    back = defaultdict(float)
    for (h, _), n in pairs.items():
        back[h] += cut(n, d) / ctx[h]

    def p(h, w):
        low = max(seen[w] - cut(seen[w], e), 0) / total + gamma / (len(seen) + 1)
        if not ctx[h]:
            return low
        n = pairs[h, w]
        return max(n - cut(n, d), 0) / ctx[h] + back[h] * low

    return p, Counter(w for t in texts for w in lm_tokens(t)), seen


def test_scores_are_the_reference_models(spark, small):
    docs = docs_of(spark, small)
    p, counts, seen = reference_model([t for i, t, _ in docs if crc(i, 5) != 1])
    n, v = sum(counts.values()), len(counts)
    assert sum(p(b"the", w) for w in seen) + p(b"the", None) == pytest.approx(1)
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_lm_scores"](spark, small).collect()}
    for i, t, _ in docs:
        w, r = lm_tokens(t), rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i, 5) == 1, len(w), sum(x in counts for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip([None, *w[:-1]], w, strict=True)), rel=1e-9)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("rows", [ODD, []])
def test_lm_of_odd_rows(spark, rows):
    with store.scratch(spark) as uri:
        df = odd(spark, rows)
        df = df.withColumns({c: F.lit("clash") for c in ("held_out", "score", "shard", "n_tokens")})
        model = kneser_ney.fit(df.where("doc_id < 9"), "text", uri, width=4)
        got = kneser_ney.score(df, model).collect()
    assert len(got) == len(rows) and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_of_frequent_words_and_many_flushes(spark, monkeypatch, order):
    """Counts beyond a byte, runs from many flushes, blocks of a text each."""
    rng = random.Random(9)
    texts = ["of " * 700 + "the", *(" ".join(rng.choice(["of", "the", "x", "y", f"w{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    p, _ = reference_trigrams(texts) if order == 3 else reference_model(texts)[::2]
    with store.scratch(spark) as uri:
        got = {r["doc_id"]: r["score"] for r in kneser_ney.score(df, kneser_ney.fit(df, "text", uri, width=7, order=order, flush=50, block=40), block=40).collect()}
    for i, t in enumerate(texts):
        w = [None, *lm_tokens(t)]
        want = [p(tuple(w[max(0, k - 2) : k + 1])) if order == 3 else p(w[k - 1], w[k]) for k in range(1, len(w))]
        assert got[i] == pytest.approx(sum(map(math.log10, want)), rel=1e-9)


def test_few_mapped_files_give_the_same_scores(spark, monkeypatch):
    """A task that may map fewer files than the model has maps those in use anew."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(40)) for _ in range(50)]
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 100)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    with store.scratch(spark) as uri:
        model = kneser_ney.fit(df, "text", uri, width=7, order=3, flush=500)
        block = kneser_ney.pa.array(texts)
        many = kneser_ney.Scorer(model)
        want = many(block)
        monkeypatch.setattr(store, "MAPS", 8)
        few = kneser_ney.Scorer(model)
        got = few(block)
    assert model.shards > 10 and len(many.bigrams.opened.held) == model.shards and len(few.bigrams.opened.held) == 2
    assert all((x == y).all() for x, y in zip(want, got, strict=True))


def test_the_arrays_used_last_stay_open(monkeypatch):
    monkeypatch.setattr(store, "MAPS", 2)
    read = []
    opened = store.Opened(lambda k: read.append(k) or [k])
    assert [opened(k) for k in "abacab"] == [[k] for k in "abacab"]
    assert read == ["a", "b", "c", "b"] and list(opened.held) == ["a", "b"]


def in_process(task, batches):
    """A task's runs, in order of shards, as the shuffle gives them to one task."""
    rows = sorted((r for b in task(batches) for r in b.to_pylist()), key=lambda r: r["shard"])
    return [kneser_ney.pa.RecordBatch.from_pylist(rows, kneser_ney.pa.schema([("shard", "int32"), ("size", "int32"), ("columns", kneser_ney.pa.list_(kneser_ney.pa.binary()))]))] if rows else []


def fit_in_process(texts, uri, order):
    K = kneser_ney
    batch = K.pa.RecordBatch.from_pydict({"text": texts})
    words = [r for b in K._save_words(uri)(in_process(K._count_words(1, 10**6, 10**6), [batch])) for r in b.to_pylist()]
    offsets = (0, words[0]["words"])
    runs = in_process(K._count_ngrams(uri, 1, offsets, 2, order, 10**6, 10**6), [batch])
    if order == 3:
        runs = in_process(K._save_trigrams(uri, offsets[-1], 2, 10**6), runs)
    runs = in_process(K._save_bigrams(uri, order, 1000, 1, 10**6), runs)
    found = {r["level"]: [r[f"x{k}"] for k in range(6)] for b in K._save_tokens(uri, 1000, offsets[-1])(runs) for r in b.to_pylist()}
    d = tuple(K.discounts(*found[k][:4]) for k in range(1, order + 1))
    n1, n2, _, _, contexts, more = found[1]
    gamma = (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * more) / contexts
    return K.NgramModel(uri, 1, offsets, 2, 1000, words[0]["tokens"], contexts, gamma / (offsets[-1] + 1), d, order)


@pytest.mark.parametrize("order", [2, 3])
def test_equal_hashes_give_the_same_scores(tmp_path, monkeypatch, order):
    """All words of one 64-bit hash, and all trigrams of one key: the scores are those of distinct ones."""
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    asked = kneser_ney.pa.array([*texts, "a b z z a", "", "z"])
    results = []
    for k in range(2):
        if k:
            own, mixed = kneser_ney._hashes, kneser_ney.mix
            monkeypatch.setattr(kneser_ney, "_hashes", lambda w: own(w) * np.array([0, 1], np.uint64) + np.array([7, 0], np.uint64))
            monkeypatch.setattr(kneser_ney, "mix", lambda code, left=None: mixed(code) if left is None else (code & np.uint64(1)) << np.uint64(63))
        (tmp_path / str(k)).mkdir()
        model = fit_in_process(texts, f"file://{tmp_path}/{k}", order)
        results.append(kneser_ney.Scorer(model)(asked))
    assert all(np.allclose(x, y, rtol=1e-12) for x, y in zip(*results, strict=True))
    p, _ = reference_trigrams(texts) if order == 3 else (None, None)
    if p:
        want = [sum(math.log10(p(tuple(([None, *lm_tokens(t)])[max(0, i - 2) : i + 1]))) for i in range(1, len(lm_tokens(t)) + 1)) for t in texts[:5]]
        assert np.allclose(results[1][3][:5], want)


def test_too_many_words_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "_save_words", lambda uri: lambda batches: iter([kneser_ney.pa.RecordBatch.from_pydict({"part": [0], "words": [2**32 - 2], "tokens": [5]}, kneser_ney.pa.schema([("part", "int32"), ("words", "int64"), ("tokens", "int64")]))]))
    with pytest.raises(ValueError, match="distinct words"):
        kneser_ney.fit(spark.createDataFrame([("a",)], "text string"), "text", "")


def reference_trigrams(texts):
    """Interpolated modified Kneser-Ney trigrams. A bigram counts the tokens before it; one at a text's start, its occurrences."""
    tri, starts = Counter(), Counter()
    for t in texts:
        w = [None, *lm_tokens(t)]
        starts[None, w[1]] += 1
        tri.update(zip(w, w[1:], w[2:]))
    pairs = Counter((b, c) for _, b, c in tri) + starts
    coc = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    cut = lambda n, x: 0 if n == 0 else x[min(n, 3) - 1]
    seen = Counter(c for _, c in pairs)
    levels = []
    for grams in (tri, pairs, Counter({(w,): n for w, n in seen.items()})):
        d, total, back = kneser_ney.discounts(*coc(grams)), Counter(), defaultdict(float)
        for g, n in grams.items():
            total[g[:-1]] += n
            back[g[:-1]] += cut(n, d)
        levels.append((grams, d, total, back))

    def p(g):
        if not g:
            return 1 / (len(seen) + 1)
        grams, d, total, back = levels[3 - len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        return max(grams[g] - cut(grams[g], d), 0) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p, seen


def test_trigram_scores_are_the_reference_models(spark, small):
    docs = docs_of(spark, small)[:60] + [(10**6, "a b", ""), (10**6 + 1, "", ""), (10**6 + 2, "zzz unseen the of the of", "")]
    train = docs[:40] + docs[-3:-1]
    p, seen = reference_trigrams([t for _, t, _ in train])
    assert sum(p((b"of", b"the", w)) for w in seen) + p((b"of", b"the", b"?")) == pytest.approx(1)
    df = lambda rows: spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    with store.scratch(spark) as uri:
        model = kneser_ney.fit(df(train), "text", uri, width=1000, order=3)
        got = {r["doc_id"]: r["score"] for r in kneser_ney.score(df(docs), model).collect()}
    for i, t, _ in docs:
        w = [None, *lm_tokens(t)]
        assert got[i] == pytest.approx(sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w))), rel=1e-9)
    with pytest.raises(ValueError):
        kneser_ney.fit(df(train), "text", "", order=4)


@pytest.mark.parametrize("rows", [ODD, []])
def test_trigrams_of_odd_rows(spark, rows):
    with store.scratch(spark) as uri:
        model = kneser_ney.fit(odd(spark, rows).where("doc_id < 9"), "text", uri, width=4, order=3)
        got = kneser_ney.score(odd(spark, rows), model).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) for r in got)


# --- 10 chat


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "<\\s>", "\\\\<s>\\n", "[[INST]]<<s></s>", "a\nb", "<", "["])
def test_escapes_are_reversible(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and not re.search(r"</?s>|\[/?INST\]", e)
    for role in ("user", "assistant", "sys\n[INST]\\n", ""):
        turn, a, b = chat.format_turn(role, text)
        assert list(chat.parse_turns(turn * 2)) == [(role, text)] * 2
        assert chat.unescape(turn[a:b]) == (text if role == "assistant" else "")


def test_examples_and_odd_turns(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", None), (1, 2, "assistant", "A<s>"), (1, 3, "user", "U"), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (None, 0, None, "x"), (2, None, "assistant", "B"), (2, None, "assistant", "B")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    ex = chat.prefix_target_examples(df)
    whole = chat.whole_examples(ex).where("conv_id = 1").orderBy("example").collect()
    assert [x["formatted"][: len(whole[0]["formatted"])] == whole[0]["formatted"] for x in whole] == [True] * 3
    assert [chat.unescape(x["formatted"][x["loss_start"] : x["loss_end"]]) if x["loss_start"] is not None else None for x in whole] == ["A<s>", "", None]
    assert [list(chat.parse_turns(x["formatted"][: x["context_chars"]])) for x in whole[:2]] == [[("system", "S"), ("user", "")], [("system", "S"), ("user", ""), ("assistant", "A<s>"), ("user", "U")]]
    got = {r["conv_id"]: r for r in chat.conversation_digests(ex).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\nS\nuser\n\nassistant\nA<s>\nuser\nU\nassistant\n\nuser\ntail\n").hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["formatted_chars"]) == (6, 4, len(whole[2]["formatted"]))
    assert got[2]["loss_sha256"] == hashlib.sha256(b"BB").hexdigest() and got[None]["n_turns"] == 1
    assert chat.prefix_target_examples(df.limit(0)).count() == 0


def test_many_turns_without_a_reply(spark):
    """Long runs go out in several rows, in time that grows with the turns; digests are the same however they are cut."""
    turns = spark.range(200_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 199_990, "assistant").otherwise("user").alias("role"), F.lit("t").alias("text"))
    cut = chat.prefix_target_examples(turns, piece_chars=1000)
    assert cut.count() > 1000 and cut.where("loss_start is not null").count() == 1
    assert chat.conversation_digests(cut).collect() == chat.conversation_digests(chat.prefix_target_examples(turns)).collect()
    few = chat.prefix_target_examples(turns.where("turn > 199980"), piece_chars=20)
    reply = next(r for r in chat.whole_examples(few).collect() if r["loss_start"] is not None)
    assert [r for r, _ in chat.parse_turns(reply["formatted"][: reply["context_chars"]])] == ["user"] * 9


def test_an_example_with_another_context_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, "user", "U"), (1, 1, "assistant", "A")], "conv_id long, turn long, role string, text string")
    bad = chat.prefix_target_examples(df).withColumn("context_chars", F.col("context_chars") - 1)
    with pytest.raises(Exception, match="differ from its turns"):
        chat.conversation_digests(bad).collect()


CHAT = "conv_id long, turn long, role string, text string"


def chat_turns(spark):
    """Conversations of all shapes, one with many replies, one without an id."""
    rng = random.Random(10)
    rows = [(c, i, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice([None, "", "</s>[INST] ok [/INST]", "\\", "é[", "x" * 30])) for c, n in [(1, 1), (2, 9), (3, 120), (None, 40)] for i in range(n)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return rows, spark.createDataFrame(rows, CHAT)


def test_every_example_holds_its_whole_context(spark):
    rows, df = chat_turns(spark)
    want = {}
    for conv in (None, 1, 2, 3):
        said = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        ends = [i for i, (r, _) in enumerate(said) if r == "assistant"] + ([len(said)] if said[-1][0] != "assistant" else [])
        want |= {(conv, k): said[: i + 1] for k, i in enumerate(ends)}
    got = chat.prefix_target_examples(df).collect()
    assert {(x["conv_id"], x["example"]): list(chat.parse_turns(x["piece"])) for x in got} == want and len(got) == len(want)
    for x in got:
        reply = [] if x["loss_start"] is None else [("assistant", chat.unescape(x["piece"][x["loss_start"] : x["loss_end"]]))]
        assert list(chat.parse_turns(x["piece"][: x["context_chars"]])) + reply == want[x["conv_id"], x["example"]]


@pytest.mark.parametrize("piece_chars, share_chars", [(1, 1 << 20), (50, 100), (1 << 20, 1)])
def test_examples_in_several_rows_and_tasks_are_the_same(spark, piece_chars, share_chars):
    _, df = chat_turns(spark)
    plain, cut = chat.prefix_target_examples(df), chat.prefix_target_examples(df, piece_chars, share_chars)
    assert (cut.where("parts > 1").count() > 0) == (share_chars < 1000) and (cut.where("row > 0").count() > 0) == (piece_chars < 1000)
    a, b = (sorted(chat.whole_examples(x).collect(), key=str) for x in (plain, cut))
    assert a == b
    a, b = (sorted(chat.conversation_digests(x).collect(), key=str) for x in (plain, cut))
    assert a == b and len(a) == 4


@pytest.mark.parametrize("change", ["replace(piece, 'U1', 'V1')", "replace(piece, '[INST]user\\nU1[/INST]', '')", "replace(piece, '[INST]', ' [INST]')"])
def test_a_changed_context_is_an_error(spark, change):
    """The context of a later example, whose other turns and last reply are as they were."""
    df = spark.createDataFrame([(1, 0, "user", "U1"), (1, 1, "assistant", "A"), (1, 2, "user", "U2"), (1, 3, "assistant", "B")], CHAT)
    bad = chat.prefix_target_examples(df).withColumn("piece", F.when(F.col("example") == 1, F.expr(change)).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="differ from its turns"):
        chat.conversation_digests(bad).collect()


# --- pipeline


def test_pipeline_stages_are_brute_force(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, small).toArrow())
        rows, was = docs.collect(), before.collect()
        seen[name] = (was, rows)
        if name != "mixture":
            assert docs.columns == columns
    was, rows = seen["language"]
    assert {r["doc_id"] for r in was} - {r["doc_id"] for r in rows} <= {r["doc_id"] for r in was if len(r["text"] or "") < 40}
    was, rows = seen["exact"]
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _, _, kept, _ in brute_dedup([(r["doc_id"], r["text"]) for r in was]) if kept)
    was, rows = seen["near"]
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, _, c in components([(r["doc_id"], r["text"]) for r in was]) if d == c)
    was, rows = seen["decontaminate"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", common.lower_az(t or ""))
    grams = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if (w := words(r["text"])) for i in range(max(1, len(w) - 12))}
    bad = set()
    for r in was:
        w = words(r["text"])
        hit = {i + k for i in range(len(w)) for n in {len(g) for g in grams} if tuple(w[i : i + n]) in grams and i + n <= len(w) for k in range(n)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(r["doc_id"])
    assert bad and {r["doc_id"] for r in rows} == {r["doc_id"] for r in was} - bad
    was, rows = seen["mixture"]
    size = Counter()
    for r in was:
        size[r["source"]] += len((r["text"] or "").split())
    want = fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}, 1.5, 2)
    got = Counter()
    for r in rows:
        got[r["source"]] += r["mix_words"]
    assert all(abs(got[s] - want[s]) <= 1 for s in size)


def test_filters_of_empty_tables(spark):
    none = odd(spark, [])
    assert language.keep_identified(none).count() == 0 and language.keep_identified(none).columns == none.columns
    kept = exact_dedup.drop_exact_duplicates(none)
    assert kept.count() == 0 and kept.columns == none.columns


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_of_odd_and_empty_tables(spark, tmp_path, small, rows):
    """Extra columns with clashing names stay to the end; only the last stage's table is left behind."""
    import corpus_pipeline as P

    odd(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    root = Path(common.shared_root(spark).removeprefix("file://"))
    before = set(root.glob("cairn-*"))
    out = P.run(spark, str(tmp_path))
    assert set(odd(spark, rows).columns) < set(out.columns) and {"mix_copy", "mix_words"} <= set(out.columns)
    assert out.count() >= (len(rows) > 0) and {r["size"] for r in out.collect()} <= {"clash"}
    left = [sorted(x.name for x in f.iterdir()) for f in set(root.glob("cairn-*")) - before if f.is_dir()]
    assert ["4-mixture"] in left and not any(n.startswith(("0-", "1-", "2-", "3-")) for names in left for n in names)


def test_the_rest_does_without_this_subpackage():
    root = Path(__file__).resolve().parents[2]
    for f in root.glob("cairn/**/*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
    assert importlib.util.find_spec("corpus_pipeline")
