import unicodedata

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


ODD = ["", " ", "a", " a b\n", "a\xa0b", "\x1ca\x1d b\x85c", " x ", "one\ttwo\x0bthree", None]


def test_strip_and_words_are_pythons(spark):
    got = values(spark, ODD, T.strip(F.col("t")), T.word_tokens(F.col("t")))
    assert got == [(None, None) if t is None else (t.strip(), t.split()) for t in ODD]


@pytest.mark.parametrize("raw, want", [("norse", "Norse"), (" Norse ", "Norse"), ("NORSE", "Norse"), ("indo-european", "Indo-European"), ("old   norse", "Old Norse"), ("o'brien", "O'Brien"), ("   ", None), (None, None)])
def test_normalize_tradition(spark, raw, want):
    assert values(spark, [raw], T.normalize_tradition(F.col("t"))) == [(want,)]


NAMES = ["Max Müller", "  David   Frawley ", "Śrī Aurobindo!", "J.R.R. Tolkien", "李白", "Ø", "Ångström-Łódź", ""]


def key(s):
    import re

    bare = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", bare.lower()).strip()


def test_entity_key(spark):
    assert [r[0] for r in values(spark, NAMES, T.entity_key(F.col("t")))] == [key(n) for n in NAMES]


def test_entity_key_fallback_takes_ligatures(spark):
    names = [*NAMES, "ﬁeld Œuvre", None]
    assert [r[0] for r in values(spark, names, T.entity_key_any(F.col("t")))] == [None if n is None else key(n) for n in names]


def test_keys_of_all_names_are_exact(spark):
    from cairn.operators import credibility

    names = [*NAMES, "ﬁeld Œuvre", "Ｐｌａｔｏ", "Ｈｏｍｅｒ", "Ｈｏｍｅｒ", "Henry Ⅷ", "x² ½", "Kelvin \u212a", "e\u0301 a\u20ddb", "İ", "ſt", None]
    requests = spark.createDataFrame(list(enumerate(names)), "request_id int, display_name string")
    want = {i: None if n is None else key(n) for i, n in enumerate(names)}
    assert {r["request_id"]: r["normalized_key"] for r in T.with_entity_key(requests).collect()} == want
    cache = spark.createDataFrame([("plato",)], "normalized_key string")
    got = credibility.lookup_entities(requests, cache).collect()
    assert [r["display_name"] for r in got if r["cached"]] == ["Ｐｌａｔｏ"]
    first = {k: i for i, k in reversed(want.items()) if k != "plato"}
    assert sorted(r["request_id"] for r in got if not r["cached"]) == sorted(first.values())


def test_sentences_and_paragraphs(spark):
    t = "One. Two!  Three?\nFour 3.5 end\n \n  Last. "
    assert values(spark, [t], T.split_paragraphs(F.col("t")), T.split_sentences(F.lit("One. Two!  Three?\nFour 3.5 end"))) == [(["One. Two!  Three?\nFour 3.5 end", "Last."], ["One.", "Two!", "Three?", "Four 3.5 end"])]


def test_labels(spark):
    rows = spark.createDataFrame([("T", "Norse", "indigenous_scholar", None, "pre_colonial", "old"), ("", "Norse", None, None, None, ""), (None, "", None, "tertiary_summary", None, None), (None, None, None, None, None, "x")], "t string, tr string, p string, r string, e string, f string")
    got = rows.select(T.source_label(F.col("t"), F.col("tr")), T.provenance_label(F.col("p"), F.col("r"), F.col("e"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("T", "indigenous scholar, pre colonial, flagged: old"), ("an untitled Norse source", ""), ("an untitled source", "tertiary summary"), ("an untitled source", "flagged: x")]


def test_violations(spark):
    df = spark.createDataFrame([("x" * 2049, None, "bronze", ""), ("u", "y" * 255, None, "n"), ("", "y" * 256, "contemporary", "z" * 256)], "url string, title string, era string, display_name string")
    got = df.select(T.violations({c: F.col(c) for c in df.columns})).collect()
    assert [r[0] for r in got] == [["url", "era", "display_name"], [], ["url", "title", "display_name"]]
