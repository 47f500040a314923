"""Cases with hand-written results for extraction, diff, retrieval, credibility, crawl and history."""

import datetime as dt
import urllib.robotparser

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog as G
from cairn.operators import context as C
from cairn.operators import crawl as J
from cairn.operators import credibility as I
from cairn.operators import diff as D
from cairn.operators import embed as E
from cairn.operators import evaluate as K
from cairn.operators import extract as X
from cairn.operators import history as H
from cairn.operators import retrieve as R


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


BOOK = "Title: A Book\n  and its subtitle\nAuthor: X\n*** START OF THE BOOK ***\n\nBody text.\nMore.\n\n*** END OF THE BOOK ***\nlicence"


@pytest.mark.parametrize("raw, body", [(BOOK, "Body text.\nMore."), ("no markers ", "no markers"), ("x *** START OF", "x *** START OF"), ("*** END OF x\n*** START OF y\nz", ""), ("*** START OF y\nz", "z"), (None, None)])
def test_plaintext_body(spark, raw, body):
    assert one(spark, raw, X.plaintext_body) == body


@pytest.mark.parametrize("raw, title", [(BOOK, "A Book"), ("Title:\n  Next line\n", "Next line"), ("nothing", None), ("*** START OF\nTitle: late", None), ("A\nTitle:   \n", None)])
def test_plaintext_title(spark, raw, title):
    assert one(spark, raw, X.plaintext_title) == title


PAGE = """<html><h1 id="firstHeading"> The <i>Edda</i> </h1><div id="mw-content-text"><style>x{}</style><p>One <b>two</b> three</p>
<table><tr><td>no</td></tr></table><sup class="reference big">[1]</sup><sup>2</sup><div class="navbox x">no<div>no</div></div> <p>  four<br>five </p></div><p>after</p></html>"""


def test_page_text_leaves_noise_out(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>no content</p>"), (3, None)], "id long, html string")
    rows = {r["id"]: r for r in X.page_text(df, "id", "html", "#mw-content-text", "#firstHeading").collect()}
    assert rows[1]["text"] == "One\ntwo\nthree\n2\nfour\nfive"
    assert rows[1]["title"] == "TheEdda"
    assert rows[2]["text"] is None and rows[2]["error"] and rows[3]["error"]


CUT = "<h1>Bread &amp; wine &amp</h1><article><script>a &amp b</script><p>x&amp;lt; &lt y &#38; &#38 &notit; &copy;&amp</p></article>"


def test_page_text_with_closed_references_only(spark):
    df = spark.createDataFrame([(1, CUT), (2, None)], "id long, html string")
    read = lambda **more: {r["id"]: r for r in X.page_text(df, "id", "html", "article", "h1", (), **more).collect()}
    got = read(closed_only=True)
    assert (got[1]["title"], got[1]["text"]) == ("Bread & wine &amp", "a &amp b\nx&lt; &lt y & &#38 &notit; ©&amp")
    assert got[2]["error"] == "no content element"
    plain = read()  # as HTML has it
    assert (plain[1]["title"], plain[1]["text"]) == ("Bread & wine &", "a &amp b\nx&lt; < y & & ¬it; ©&")


@pytest.fixture
def cut_pages(tmp_path):
    """The smallest tables, with pages whose headings are cut in a character reference."""
    from pathlib import Path

    import duckdb

    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if p.name != "pages.parquet":
            (tmp_path / p.name).symlink_to(p)
    cuts = ["x &amp", "x &amp; y &lt", "&#x27", "&", "&am", "&amp;amp", "x &quot;&quot"]
    pages = " UNION ALL ".join(f"SELECT {i} AS page_id, 'http://a.org/{i}' AS url, '<nav>n</nav><article><h1>{t}</h1><p>{t}; {t}<br>{t}</p></article>' AS html" for i, t in enumerate(cuts))
    duckdb.connect().execute(f"COPY (SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM ({pages})) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["page_text", "extract"])
def test_cut_references_as_in_the_sql(spark, cut_pages, name):
    from compare import connect, same

    from cairn.plans import catalogue

    same(catalogue.QUERIES[name](spark, cut_pages), catalogue.ORACLES[name], connect(cut_pages))


def test_catalog_link_and_outcome(spark):
    df = spark.createDataFrame([("https://x.org/a.txt/", ""), ("https://x.org/e/1", '<a class="b" href="/f/1.txt.utf-8">t</a>'), ("https://x.org/e/1", "<a href='x'>")], "u string, h string")
    assert [r[0] for r in df.select(X.catalog_text_link(F.col("u"), F.col("h"))).collect()] == ["https://x.org/a.txt/", "https://x.org/f/1.txt.utf-8", None]
    codes = spark.createDataFrame([(200,), (204,), (304,), (404,), (None,)], "c int")
    assert [r[0] for r in codes.select(X.fetch_outcome(F.col("c"))).collect()] == ["fetched", "fetched", "unchanged", "failed", "failed"]


def test_extract_gives_every_source_a_row(spark):
    rows = [(1, "gutenberg_text", BOOK), (2, "wikipedia", PAGE), (3, "manual_upload", "x"), (4, None, "x"), (5, "wikisource", "<p>")]
    got = {r["source_id"]: r for r in X.extract(spark.createDataFrame(rows, "source_id long, source_type string, raw string")).collect()}
    assert got[1]["title"] == "A Book" and got[2]["title"] == "TheEdda"
    assert all(got[i]["error"] and got[i]["text"] is None for i in (3, 4, 5))


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, source_id long, chunk_hash string, chunk_text string, is_active boolean")


def test_diff_states_and_reactivation(spark):
    chunks = chunk_rows(spark, [(1, 1, "a", "A", True), (2, 1, "b", "B", True), (3, 1, "c", "C", False), (4, 2, "a", "A", True)])
    new = spark.createDataFrame([(1, "a", "A"), (1, "c", "C"), (1, "d", "D")], "source_id long, chunk_hash string, chunk_text string")
    diff = D.diff_chunks(chunks.where("is_active and source_id = 1"), new)
    assert {(r["chunk_hash"], r["state"]) for r in diff.collect()} == {("a", "unchanged"), ("b", "stale"), ("c", "new"), ("d", "new")}
    after = D.apply_diff(chunks, diff, new).collect()
    assert sorted((r["source_id"], r["chunk_hash"], r["is_active"]) for r in after) == [(1, "a", True), (1, "b", False), (1, "c", False), (1, "c", True), (1, "d", True), (2, "a", True)]
    assert len({r["chunk_id"] for r in after}) == 6


def test_validators(spark):
    s = spark.createDataFrame([(1, None, "h", "e", "m"), (2, "T", "h", "e", "m"), (3, None, None, None, None), (4, None, "h", "e", "m")], "source_id long, title string, content_hash string, etag string, last_modified string")
    f = spark.createDataFrame([(1, "fetched", "h", "e2", None, "New"), (2, "fetched", "h2", "e2", "m2", "New"), (3, "fetched", "h", None, None, ""), (4, "unchanged", None, None, None, None)], "source_id long, outcome string, content_hash string, etag string, last_modified string, inferred_title string")
    got = {r["source_id"]: r.asDict() for r in D.refresh_validators(s, f).collect()}
    assert got[1] == {"source_id": 1, "title": "New", "content_hash": "h", "etag": "e2", "last_modified": None, "changed": False}
    assert got[2]["title"] == "T" and got[2]["content_hash"] == "h2" and got[2]["changed"]
    assert got[3]["title"] is None and got[3]["changed"]
    assert got[4]["etag"] == "e" and not got[4]["changed"]


def test_encoder(spark):
    df = spark.createDataFrame([(1, "the old gods"), (2, "the old gods sing"), (3, "tax law"), (4, ""), (5, None)], "i int, t string")
    v = {r["i"]: r["embedding"] for r in E.embed(df, "t").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert len(v[1]) == 384 and cos(v[1], v[2]) > cos(v[1], v[3]) and not any(v[4]) and not any(v[5])
    q = E.embed(df, "t", is_query=True).where("i = 1").first()["embedding"]
    prefixed = E.embed(df.withColumn("t", F.concat(F.lit("Represent this sentence for searching relevant passages: "), "t")), "t").where("i = 1").first()["embedding"]
    assert q == prefixed != v[1]


def test_cosine_of_zero_and_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(E.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 2.0, None, None]


SOURCES = [(1, "u1", "One", "Greek", "western_academic", None, None, None), (2, "u2", None, "Norse", "indigenous_scholar", "primary_translation", None, "flag"), (3, "u3", "Three", None, "indigenous_primary_text", None, "contemporary", None)]
SOURCE = "source_id long, url string, title string, tradition string, author_position string, text_role string, era string, known_bias_flags string"


def corpus(spark):
    sources = spark.createDataFrame(SOURCES, SOURCE)
    vec = lambda x: [x, (1 - x * x) ** 0.5]
    rows = [(10, 1, "a", vec(1.0), True), (11, 1, "b", vec(0.9), True), (12, 2, "c", vec(0.8), True), (13, 3, "d", vec(0.7), True), (14, 3, "e", vec(1.0), False), (15, 3, "f", vec(0.1), True), (16, 2, "g", None, True)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_id long, chunk_text string, embedding array<float>, is_active boolean")
    questions = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], "Norse"), (3, [1.0, 0.0], "norse"), (4, [0.0, 0.0], None)], "question_id long, embedding array<float>, tradition string")
    return questions, chunks, sources


def test_retrieve(spark):
    q, c, s = corpus(spark)
    hits = R.retrieve(q, c, s, k=3).orderBy("question_id", "position").collect()
    assert [(r["question_id"], r["chunk_id"], r["place"]) for r in hits] == [(1, 12, 3), (1, 10, 1), (1, 11, 2), (2, 12, 1)]
    again = R.nearest(q, R.active(c).join(s.select("source_id", "tradition"), "source_id"), k=3, block=1)
    assert {(r["question_id"], r["chunk_id"]) for r in again.collect()} == {(1, 10), (1, 11), (1, 12), (2, 12)}
    refused = {r["question_id"]: r["refused"] for r in R.refuse(q, R.retrieve(q, c, s)).collect()}
    assert refused == {1: False, 2: False, 3: True, 4: True}


def test_dimensions_of_vectors(spark):
    chunks = [(1, 1, [1.0, 0.0], None), (2, 1, [1.0, 0.0, 0.0], None), (3, 1, [0.6, 0.8], None), (4, 1, [0.0, 0.0], None), (5, 1, [], None)]
    kind = "chunk_id long, source_id long, embedding array<float>, tradition string"
    q = spark.createDataFrame([(7, [1.0, 0.0], None), (8, None, None)], "question_id long, embedding array<float>, tradition string")
    for rows in (chunks, chunks[::-1]):
        got = R.nearest(q, spark.createDataFrame(rows, kind).coalesce(1), k=3, threshold=None).collect()
        assert sorted((r["question_id"], r["chunk_id"], r["place"]) for r in got) == [(7, 1, 1), (7, 3, 2)]
    with pytest.raises(ValueError, match="dimensions"):
        R.nearest(q.unionByName(spark.createDataFrame([(9, [1.0], None)], q.schema)), spark.createDataFrame(chunks, kind))


def test_strips_of_distances_give_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 7, rng.integers(-1, 2, 4).astype(float).tolist(), None) for i in range(300)]
    c = spark.createDataFrame(rows, "chunk_id long, source_id long, embedding array<float>, tradition string")
    q = c.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("question_id"), "embedding", "tradition")
    got = {(r["question_id"], r["place"]): r["chunk_id"] for r in R.nearest(q, c, k=4, threshold=None, cells=700).collect()}
    m = np.array([r[2] for r in rows])
    for i in range(0, 300, 10):
        ok = np.flatnonzero(np.linalg.norm(m, axis=1) > 0)
        if not m[i].any():
            continue
        d = (1 - m[ok] @ m[i] / np.linalg.norm(m[ok], axis=1) / np.linalg.norm(m[i])).round(9)
        best = ok[np.lexsort((ok, d))][:4]
        assert [got[i, p] for p in range(1, 5)] == best.tolist()


def clustered(spark, n=4000):
    """Vectors around 20 directions, some null, zero or of another dimension."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 16))
    v = middle[np.arange(n) % 20] + 0.1 * rng.normal(size=(n, 16))
    rows = [(i, i % 9, None if i % 400 == 7 else [0.0] * 16 if i % 400 == 8 else [1.0] if i % 400 == 9 else v[i].tolist(), ("a", "b", None)[i % 3]) for i in range(n)]
    c = spark.createDataFrame(rows, "chunk_id long, source_id long, embedding array<float>, tradition string")
    q = c.where("chunk_id % 50 = 1").select(F.col("chunk_id").alias("question_id"), "embedding", F.when(F.col("chunk_id") % 2 == 0, F.col("tradition")).alias("tradition"))
    return q, c


def test_tiles_and_clusters_give_the_same_hits(spark):
    q, c = clustered(spark)
    rows = lambda df: sorted((r["question_id"], r["chunk_id"], r["place"], round(r["distance"], 9)) for r in df.collect())
    want = rows(R.nearest(q, c, k=4, threshold=0.02))
    assert len({r[0] for r in want}) > 70
    assert rows(R.nearest(q, c, k=4, threshold=0.02, block=7, chunk_block=500)) == want
    assert rows(R.nearest(q, c, k=4, threshold=None, block=7, chunk_block=500)) == rows(R.nearest(q, c, k=4, threshold=None))
    centres = R.fit_centres(c, clusters=32, sample=1000)
    assert rows(R.nearest_pruned(q, c, centres, k=4, threshold=0.02, chunk_block=90)) == want
    assert rows(R.nearest_pruned(q, c, centres[:1], k=4, threshold=0.02)) == want
    assert rows(R.nearest_pruned(q, c, R.fit_centres(c.limit(0)), k=4, threshold=0.02)) == want
    assert rows(R.nearest_pruned(q.limit(0), c, centres)) == rows(R.nearest(q.limit(0), c, block=-1)) == []
    # most products are skipped
    files = R.filed(c, centres)
    sizes = files.groupBy("cluster").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.lit(1).alias("tiles"), F.count("*").alias("n"))
    asked = R.clusters_to_ask(R._asked(q, True)[0], sizes, centres, 0.02).join(sizes.select("cluster", "n"), "cluster").agg(F.sum("n")).first()[0]
    assert asked < 0.3 * q.count() * c.count()


def test_many_questions_stay_off_the_driver(spark, monkeypatch):
    q, c = clustered(spark)
    of = R.Asked.of
    calls = []
    monkeypatch.setattr(R.Asked, "of", staticmethod(lambda *a: calls.append(1) or of(*a)))
    assert R.nearest(q, c, block=7).count() > 0 and not calls  # called in tasks only
    assert R.nearest(q, c).count() > 0 and calls


def test_tiles_are_stored_once_however_many(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    q, c = clustered(spark)
    rows = lambda df: sorted((r["question_id"], r["chunk_id"], r["place"], round(r["distance"], 9)) for r in df.collect())
    want = rows(R.nearest(q, c, k=4, threshold=0.02))
    monkeypatch.setattr(R, "STACK", 1, raising=False)
    for block in (3, 40):
        monkeypatch.setattr(R, "scratch", lambda _, b=block: f"{tmp_path}/{b}")
        found = R.nearest(q, c, k=4, threshold=0.02, block=block, chunk_block=10 * block)
        assert rows(found) == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "CoGroup" not in plan
        for part, table, size in (("questions", q, block), ("chunks", c, 10 * block)):
            stored = [pa.ipc.open_stream(bytes(r[0])).read_all().num_rows for r in spark.read.parquet(f"{tmp_path}/{block}/{part}").collect()]
            assert sum(stored) == table.count() and max(stored) <= size and len(stored) > 1


def test_texts_that_are_not_hit_are_not_shuffled(spark, tmp_path):
    q, c, s = corpus(spark)
    c.write.parquet(f"{tmp_path}/c")
    c = spark.read.parquet(f"{tmp_path}/c")
    hits = R.nearest(q, R.active(c).join(s.select("source_id", "tradition"), "source_id"), k=3).join(s, "source_id")
    want = sorted((r["question_id"], r["chunk_id"], r["chunk_text"]) for r in R.with_texts(hits, c, 12).collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (12, 10**9):
            found = R.with_texts(hits, c, most)
            assert sorted((r["question_id"], r["chunk_id"], r["chunk_text"]) for r in found.collect()) == want
            plan = found._jdf.queryExecution().optimizedPlan().toString() if most > 12 else found._jdf.queryExecution().sparkPlan().toString()
            assert "LeftSemi" in plan if most > 12 else "BroadcastHashJoin" in plan and "chunk_text" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_applying_a_diff_leaves_the_snapshot_where_it_is(spark, tmp_path):
    kind = "chunk_id long, source_id long, chunk_hash string, chunk_text string, is_active boolean"
    spark.createDataFrame([(i, i % 5, f"h{i}", "t", i % 4 > 0) for i in range(40)], kind).write.parquet(f"{tmp_path}/c")
    chunks = spark.read.parquet(f"{tmp_path}/c")
    diff = spark.createDataFrame([(1, "h1", "stale"), (2, "h2", "unchanged"), (0, "h0", "new"), (1, "x", "new")], "source_id long, chunk_hash string, state string")
    incoming = spark.createDataFrame([(0, "h0", "t0"), (1, "x", "tx"), (2, "h2", "t2")], "source_id long, chunk_hash string, chunk_text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near, far = D.apply_diff(chunks, diff, incoming), D.apply_diff(chunks, diff, incoming, limit=0)
        assert rows(near) == rows(far) and near.count() == 42
        assert {tuple(r)[1:] for r in near.where("source_id = 1 and chunk_hash in ('h1', 'x') or chunk_hash = 'h0'").collect()} == {(1, "h1", "t", False), (1, "x", "tx", True), (0, "h0", "t", False), (0, "h0", "t0", True)}
        kept = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Union")[1].split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in kept(near) and "Exchange hashpartitioning" not in kept(near)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize(
    "wanted, text",
    [
        ("#c", "one two three"),
        ("div p", "two"),
        ("div > p", "three"),
        ("main .x p", "two"),
        ("main > .x > p", None),
        ("article, p", "two"),
        ("section.x.y", "two"),
        ("div#c > p.last", "three"),
        ("* > em", "one"),
        ("body em", None),
    ],
)
def test_selectors(wanted, text):
    html = "<main id=m><div id=c><em>one</em><br><section class='y x'><p>two</p></section><p class='last'>three</p></div></main>"
    found = X._pick(html, (wanted, ()))[0]
    assert (" ".join(found) if found is not None else None) == text


def test_wrong_selectors_are_errors(spark):
    for wrong in ("", "a,", "> a", "a >", "a[href]", "a:hover", "a > > b"):
        with pytest.raises(ValueError, match="selector"):
            X.selector(wrong)
    with pytest.raises(ValueError, match="selector"):
        X.page_text(spark.createDataFrame([(1, "")], "k int, h string"), "k", "h", "a[b]", "h1")
    assert X._pick("<p>a<sup class=reference>1</sup><table><tr><td>x</table>b</p>", ("p", X.NOISE), ("table td", ())) == [["a", "b"], ["x"]]


def test_links_are_resolved_as_urls(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b/c.html", "https://h.org", "http://h.org/", "http://h.org/a/?q=/x/y#f/g"]
    links = ["x.txt", "/r/x.txt", "../x.txt", "../../../x.txt", "./x/./y.txt", "//o.org/x.txt", "http://z.org/../x.txt", "?f=x.txt", "d/../x.txt?q=../a", "x.txt#a/b", "mailto:x.txt"]
    df = spark.createDataFrame([(b, h) for b in bases for h in links], "b string, h string").select("b", "h", X.resolve_link(F.col("b"), F.col("h")).alias("u"))
    assert {(r["b"], r["h"]): r["u"] for r in df.collect()} == {(b, h): urljoin(b, h) for b in bases for h in links}


def test_repeated_urls_stay(spark):
    urls = spark.createDataFrame([("http://a.org/x", 1), ("http://a.org/x", 1), (None, 2)], "url string, n int")
    robots = spark.createDataFrame([("http://a.org", "User-agent: *\nDisallow: /x")], "origin string, body string")
    assert sorted((r["n"], r["allowed"]) for r in J.robots_filter(urls, robots, "bot").collect()) == [(1, False), (1, False), (2, True)]


def test_context_groups_by_source(spark):
    q, c, s = corpus(spark)
    hits = R.retrieve(q, c, s, k=3)
    text = {r["question_id"]: r["context"] for r in C.format_context(hits).collect()}
    assert text[1] == "[an untitled Norse source: u2]\nProvenance: indigenous scholar, primary translation, flagged: flag\nc\n\n[One (Greek): u1]\nProvenance: western academic\na\nb"
    assert [(r["source_id"], r["cite_no"]) for r in C.cited_sources(hits).where("question_id = 1").orderBy("cite_no").collect()] == [(2, 1), (1, 2)]
    assert [r[0] for r in C.list_traditions(s, c).collect()] == ["Greek", "Norse"]


def test_recall(spark):
    q, c, _ = corpus(spark)
    ranked = K.rank_all(q, R.active(c))
    truth = spark.createDataFrame([(1, 11), (2, 15)], "question_id long, chunk_id long")
    assert {r["k"]: (r["hits"], r["n"]) for r in K.recall_at_k(ranked, truth, q).collect()} == {1: (0, 4), 3: (1, 4), 5: (2, 4)}


def test_catalogue(spark):
    old = spark.createDataFrame([("a",)], "url string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "request_id long, url string")
    ok, no = G.register_sources(old, new)
    assert sorted(r["request_id"] for r in ok.collect()) == [2, 4] and sorted(r["request_id"] for r in no.collect()) == [1, 3]
    s = spark.createDataFrame([(1, "T", "e"), (2, "T", "e")], "source_id long, title string, era string")
    p = spark.createDataFrame([(1, {"title": None}), (9, {"title": "x"})], "source_id long, patch map<string,string>")
    done, bad = G.apply_patches(s, p, ("title", "era"))
    assert sorted(tuple(r) for r in done.select("source_id", "title", "era").collect()) == [(1, None, "e"), (2, "T", "e")]
    assert [r["source_id"] for r in bad.collect()] == [9]


def test_job_outcomes_and_watchdog(spark):
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([(i, "scraping", None, None) for i in (1, 2, 3, 4)], "source_id long, status string, last_checked_at timestamp_ntz, last_scraped_at timestamp_ntz")
    r = spark.createDataFrame([(1, True, None), (2, False, None), (3, None, "boom")], "source_id long, changed boolean, error string")
    now = F.lit(t).cast("timestamp_ntz")
    after, jobs = G.job_outcomes(s, r, now)
    assert {x["source_id"]: (x["status"], x["last_checked_at"], x["last_scraped_at"]) for x in after.collect()} == {1: ("completed", t, t), 2: ("completed", t, None), 3: ("failed", t, None), 4: ("scraping", None, None)}
    assert {x["source_id"]: (x["status"], x["attempts"], x["error_message"]) for x in jobs.collect()}[3] == ("failed", 1, "boom")
    runs = spark.createDataFrame([(1, "running", t - dt.timedelta(seconds=301), None, None), (2, "running", t - dt.timedelta(seconds=300), None, None), (3, "completed", t - dt.timedelta(days=1), t, None)], "job_id long, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")
    got = {x["job_id"]: (x["status"], x["error_message"]) for x in G.overdue_jobs(runs, now).collect()}
    assert got == {1: ("failed", "worker watchdog timeout after 300s"), 2: ("running", None), 3: ("completed", None)}


def test_history(spark):
    c = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 8, 3)], "conversation_id long, user_id long, created_at long")
    m = spark.createDataFrame([(1, 1, "q1", 1, [5, 4, 9]), (1, 2, "q2", 2, []), (3, 3, "q3", 1, None)], "conversation_id long, message_id long, question string, created_at long, cited_source_ids array<bigint>")
    got = H.list_conversations(c, m, F.lit(7)).collect()
    assert [(r["conversation_id"], r["message_count"], r["last_question"]) for r in got] == [(2, 0, None), (1, 2, "q2")]
    assert H.conversation_detail(c, m, 3, 7).count() == 0 and H.conversation_detail(c, m, 1, 7).count() == 2
    s = spark.createDataFrame([(4, "u4", None), (5, "u5", "T")], "source_id long, url string, title string")
    cited = {r["message_id"]: [x["source_id"] for x in r["sources"]] for r in H.hydrate_sources(m, s).collect()}
    assert cited == {1: [5, 4], 2: [], 3: []}


def test_facts_and_rules(spark):
    rows = [(1, '{"practice_lineage":"x","tradition_engagement":true,"extra":1}', "Norse"), (2, '{"tradition_engagement":false,"practice_lineage":"x"}', "Norse"), (3, '{"tradition_engagement":"yes","born_within_tradition_context":true}', "Norse"), (4, "nope", "Norse"), (5, '{"practice_lineage":"","tradition_engagement":true}', "")]
    df = spark.createDataFrame(rows, "i long, p string, t string")
    facts = df.join(I.extract_facts(df, "i", "p", "t"), "i")
    got = {r["i"]: r for r in facts.select("i", "facts", "error", I.suggest_epistemic_basis(F.col("facts")).alias("b"), I.suggest_origin(F.col("facts")).alias("o"), I.suggested_values(F.lit("author"), F.col("facts"), F.col("t")).alias("s"), I.suggested_values(F.lit("institution"), F.col("facts"), F.col("t")).alias("n"), I.pasted_provenance(F.col("facts")).alias("p")).collect()}
    assert len(got[1]["facts"]) == 10 and "extra" not in got[1]["facts"] and len(got[5]["facts"]) == 8
    assert got[4]["facts"] is None and got[4]["error"]
    assert [got[i]["b"]["value"] for i in (1, 2, 3, 5)] == ["lived_practice", "textual_study_only", "mixed", "unknown"]
    assert got[1]["b"]["based_on_facts"] == ["practice_lineage", "tradition_engagement"]
    assert [got[i]["o"]["value"] for i in (1, 3)] == ["unknown", "indigenous_born"]
    assert set(got[1]["s"]) == {"author_epistemic_basis", "author_origin"} and set(got[5]["s"]) == {"author_epistemic_basis"} and got[1]["n"] == {}
    assert got[1]["p"] == {"practice_lineage": "admin_text", "tradition_engagement": "admin_text"}


def test_attributed_facts_need_a_whole_number(spark):
    p = [(1, '{"facts":{"occupation":{"value":"s","source":1},"birth_year":{"value":1,"source":"1"},"death_year":{"value":1,"source":1.0},"birth_region":{"value":null,"source":1},"practice_lineage":{"value":"v","source":true},"practice_regions":{"value":"v","source":3}}}'), (2, "{}"), (3, "x")]
    r = spark.createDataFrame([(1, 1, "u1"), (1, 2, "u2")], "i long, idx int, url string")
    got = I.extract_attributed_facts(spark.createDataFrame(p, "i long, p string"), r, "i", "p").collect()
    assert {(x["i"], x["fact"]): (x["value"], x["url"]) for x in got if x["value"]} == {(1, "occupation"): ('"s"', "u1"), (1, "practice_lineage"): ('"v"', "u1")}
    assert len(got) == 24


def test_lookup_first_request_wins(spark):
    q = spark.createDataFrame([(1, "Max Müller"), (2, "max muller!"), (3, "David F."), (4, "david f")], "request_id long, display_name string")
    cache = spark.createDataFrame([("max muller",)], "normalized_key string")
    assert {(r["request_id"], r["cached"]) for r in I.lookup_entities(q, cache).collect()} == {(1, True), (2, True), (3, False)}


@pytest.mark.parametrize("name", ["lookup_entities", "append_entities", "lookup_facts", "lookup_suggestions"])
def test_no_side_of_a_lookup_is_broadcast(spark, small, monkeypatch, name):
    """A cache of 25 rows for each one that is read, whose files say that it is small."""
    from cairn.plans import catalogue
    from cairn.sources import tables

    plans = []
    write = lambda f: lambda df, path: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or f(df, path)
    monkeypatch.setattr(I, "staged", write(tables.staged), raising=False)
    monkeypatch.setattr(tables, "append", write(tables.append))
    plans.append(catalogue.QUERIES[name](spark, small)._jdf.queryExecution().sparkPlan().toString())
    joins = [x for p in plans for x in p.splitlines() if "Join " in x and ("normalized_key" in x or "request_id" in x)]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_search_results_and_excerpts(spark):
    df = spark.createDataFrame([(1, '{"results":[{"url":"a","title":"t","content":"c"},{"url":"b"}]}'), (2, '{"results":[]}'), (3, "{}")], "i long, p string")
    r = I.search_results(df, "i", "p")
    assert [(x["i"], x["idx"], x["content"], x["error"]) for x in r.orderBy("i", "idx").collect()] == [(1, 1, "c", None), (1, 2, "", None), (2, None, None, "no search results"), (3, None, None, "no search results")]
    assert I.excerpt_block(r, "i").collect()[0]["excerpts"] == "[Result 1] URL: a\nc\n\n[Result 2] URL: b\n"


ROBOTS = ["User-agent: *\nDisallow: /private\nAllow: /\n", "User-agent: CairnBot\nDisallow: /a%20b\n\nUser-agent: *\nDisallow: /\n", "User-agent: x\nUser-agent: cairnbot\nAllow: /private/ok\nDisallow: /private # c\n", "", None, "Disallow: /\n"]


def test_robots_like_the_standard_parser(spark):
    urls = [f"https://h{i}.org{p}" for i in range(len(ROBOTS)) for p in ("", "/", "/private", "/private/ok", "/a b", "/a%20b/c", "/x?private")]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    robots = spark.createDataFrame([(f"https://h{i}.org", b) for i, b in enumerate(ROBOTS)], "origin string, body string")
    got = {r["url"]: r["allowed"] for r in J.robots_filter(df, robots, "cairnbot/1.0").collect()}
    for u in urls:
        p = urllib.robotparser.RobotFileParser()
        p.parse((ROBOTS[int(u[9])] or "").splitlines())
        p.modified()
        assert got[u] == p.can_fetch("cairnbot/1.0", u), u


def test_a_busy_origin_is_many_tasks(spark):
    df = spark.createDataFrame([(f"http://a.org/{i % 7}/{i}",) for i in range(500)] + [("http://b.org/1/x",), (None,), ("http://c.org/1/x",)], "url string")
    body = "User-agent: *\nAllow: /1/1\nDisallow: /1\nDisallow: /2/\nAllow: /\nDisallow: /3"
    robots = spark.createDataFrame([("http://a.org", body), ("http://b.org", body), ("http://d.org", body)], "origin string, body string")
    want = {r["url"]: r["allowed"] for r in J.robots_filter(df, robots, "bot").collect()}
    assert want["http://a.org/1/15"] and not want["http://a.org/1/8"] and not want["http://b.org/1/x"] and want["http://c.org/1/x"] and want[None] and not want["http://a.org/2/9"] and want["http://a.org/3/10"]
    assert {r["url"]: r["allowed"] for r in J.robots_filter(df, robots, "bot", block=20).collect()} == want and len(want) == 503


def test_one_host_at_one_time_is_many_tasks(spark):
    """All requests of one host in the same second: blocks of bounded rows, slots an interval apart."""
    df = spark.range(2000).selectExpr("'h' as host", "timestamp'2024-01-01 00:00:00' as ts", "cast(id * 7919 % 2000 as long) as i").repartition(5)
    out = J.throttle(df, "host", "ts", "i", interval_s=2.0, block=50)
    first = 1704067200_000_000
    assert [(r["i"], r["slot_us"]) for r in out.orderBy("i").collect()] == [(k, first + k * 2_000_000) for k in range(2000)]


def test_throttle_is_waiting_one_by_one(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 2], base + dt.timedelta(seconds=(i * i) % 17 / 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, host string, ts timestamp_ntz")
    got = {r["i"]: r["slot_us"] for r in J.throttle(df, "host", "ts", "i").collect()}
    assert {r["i"]: r["slot_us"] for r in J.throttle(df, "host", "ts", "i", block=3).collect()} == got
    last = {}
    for i, host, t in sorted(rows, key=lambda r: (r[2], r[0])):
        us = round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        last[host] = max(us, last.get(host, -(10**18)) + 2_000_000)
        assert got[i] == last[host]


def test_attempts_and_headers(spark):
    a = spark.createDataFrame([(1, 1, 429), (1, 2, 404), (1, 3, 200), (2, 1, 500), (2, 2, 200), (3, 1, 429), (3, 2, 404)], "request_id long, tier int, status_code int")
    assert {(r["request_id"], r["tier"], r["status_code"]) for r in J.resolve_attempts(a).collect()} == {(1, 3, 200), (2, 1, 500), (3, 2, 404)}
    h = spark.createDataFrame([("e", None), ("", "m"), (None, None)], "e string, m string").select(J.conditional_headers(F.col("e"), F.col("m")))
    assert [r[0] for r in h.collect()] == [{"If-None-Match": "e"}, {"If-Modified-Since": "m"}, {}]
