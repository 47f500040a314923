import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators.chunk import chunk, chunk_hashes, chunk_spans


def by_words(text, size, overlap):
    """The chunker on lists of words."""
    out, now = [], []

    def close():
        if now:
            out.append(" ".join(now))
        now.clear()

    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        words = p.split()
        if len(words) > size:
            close()
            for s in re.split(r"(?<=[.!?])\s+", p):
                w = s.split()
                if now and len(now) + len(w) > size:
                    out.append(" ".join(now))
                    now[:] = now[-overlap:] if overlap else []
                now += w
            close()
            continue
        if len(now) + len(words) > size:
            close()
        now += words
    close()
    return out


def chunks(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [[] for _ in texts]
    for r in chunk(df, "i", "t", size, overlap).orderBy("i", "chunk_no").collect():
        assert r["chunk_no"] == len(got[r["i"]])
        got[r["i"]].append(r["chunk_text"])
    return got


@pytest.mark.parametrize("size, overlap", [(50, 10), (14, 2), (3, 1), (15, 3), (5, 0), (220, 40)])
def test_same_as_word_lists(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", "  \n\n ", "one", "a b c.\n\nd e"]
    for _ in range(60):
        texts.append("".join(rng.choice(["w", "word", "x."]) + rng.choice([" ", " ", "  ", "\n", "! ", ". ", "\n\n", "\n \n"]) for _ in range(rng.randint(0, 120))))
    assert chunks(spark, texts, size, overlap) == [by_words(t, size, overlap) for t in texts]


def test_overlap_is_the_tail(spark):
    text = " ".join(f"w{i}." for i in range(30))
    a, b, *_ = chunks(spark, [text], 10, 4)[0]
    assert a.split()[-4:] == b.split()[:4]


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, 10), (5, -1)])
def test_bad_parameters(size, overlap):
    with pytest.raises(ValueError):
        chunk_spans(size, overlap)


def test_time_grows_with_the_text(spark):
    """Four times the words take about four times as long, in chunks and in hashes."""
    def seconds(n, cut):
        df = spark.range(1).select(F.lit(1).alias("i"), F.expr(f"array_join(transform(sequence(1, {n}), x -> concat('w', x % 1000, if(x % 7 = 0, '.', ''), if(x % 5000 = 0, '\n\n', ''))), ' ')").alias("t"))
        df = spark.createDataFrame(df.collect(), df.schema)
        began = time.time()
        cut(df)
        return time.time() - began

    for cut in (lambda df: chunk(df, "i", "t", 20, 5).agg(F.sum(F.length("chunk_text"))).collect(), lambda df: chunk_hashes(df, "i", "t", 20, 5).select(F.size("hashes"), F.sha2(F.array_join("hashes", ""), 256)).collect()):
        seconds(40_000, cut)
        small = seconds(80_000, cut)
        assert seconds(320_000, cut) < 8 * small + 1


def test_spans_of_many_blocks(spark):
    """More units than a block of the fold holds, of both kinds."""
    rng = random.Random(5)
    text = "\n\n".join(" ".join(rng.choice(["w", "v.", "u"]) for _ in range(rng.choice([1, 3, 9, 40]))) for _ in range(900))
    assert chunks(spark, [text], 12, 3) == [by_words(text, 12, 3)]
