import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.functions import vocabulary as V
from cairn.operators import credibility as I
from cairn.operators.embed import embed, hashed_words
from cairn.operators.ingest import ingest
from cairn.sources import log, tables
from cairn.streaming import ingest as S


def book(text):
    return f"Title: T\n{V.BOOK_START} X\n{text}\n{V.BOOK_END}"


LANDED = [(1, "gutenberg_text", "u", 200, book("One two."), "e1", "m1"), (2, "gutenberg_text", "u", 500, None, None, None), (3, "manual_upload", "u", 200, "x", None, None), (4, "gutenberg_text", "u", 304, None, None, None)]


def tables_of(spark):
    sources = spark.createDataFrame([(i, None, None, None, None) for i in range(1, 6)], "source_id long, title string, content_hash string, etag string, last_modified string")
    chunks = spark.createDataFrame([(9, 1, "old", "old", True), (8, 4, "x", "x", True)], "chunk_id long, source_id long, chunk_hash string, chunk_text string, is_active boolean")
    return sources, chunks


def test_batch_ingest(spark):
    sources, chunks = tables_of(spark)
    out = ingest(sources, chunks, spark.createDataFrame(LANDED, tables.FETCHED), with_embeddings=True)
    vector = {r["chunk_text"]: r["embedding"] for r in out.chunks.collect()}
    assert vector["x"] is None and vector["One two."] == hashed_words()(["One two."])[0].astype("f4").tolist()
    assert {(r["source_id"], r["chunk_text"], r["is_active"]) for r in out.chunks.collect()} == {(1, "old", False), (1, "One two.", True), (4, "x", True)}
    got = {r["source_id"]: (r["changed"], r["error"]) for r in out.results.collect()}
    assert got[1] == (True, None) and got[4] == (False, None)
    assert got[2] == (False, "HTTP status 500") and "manual_upload" in got[3][1]
    # the same content again changes nothing
    again = ingest(out.sources, out.chunks, spark.createDataFrame(LANDED[:1], tables.FETCHED))
    assert again.results.first()["changed"] is False and again.diff.count() == 0


def kept(spark, sources, chunks, state, name):
    of = {t.name: t for t in S.log_tables(*S.with_ingest_columns(sources, chunks))}
    return log.read(spark, state, of[name])


def test_stream_equals_batch(spark, tmp_path):
    sources, chunks = tables_of(spark)
    spark.createDataFrame(LANDED, tables.FETCHED).coalesce(1).write.parquet(f"{tmp_path}/landing")
    q = S.stream_ingest(spark, f"{tmp_path}/landing", f"{tmp_path}/state", f"{tmp_path}/check", sources, chunks)
    q.awaitTermination(120)
    want = ingest(sources, chunks, spark.createDataFrame(LANDED, tables.FETCHED))
    key = lambda df: sorted(map(tuple, df.select("source_id", "chunk_hash", "is_active").collect()))
    assert key(kept(spark, sources, chunks, f"{tmp_path}/state", "chunks")) == key(want.chunks)
    assert log.current(spark, f"{tmp_path}/state") == 1


def land(spark, path, rows):
    spark.createDataFrame(rows, tables.FETCHED + ", landed_at timestamp").coalesce(1).write.mode("append").parquet(f"{path}/landing")


def test_stream_batches_write_what_they_change(spark, tmp_path):
    sources, chunks = tables_of(spark)
    many = spark.range(1000, 21000).selectExpr("id as chunk_id", "id as source_id", "sha2(cast(id as string), 256) as chunk_hash", "repeat('word ', 20) as chunk_text", "true as is_active")
    chunks = chunks.unionByName(many)
    state = f"{tmp_path}/state"

    def written():
        return sum(f.stat().st_size for f in (tmp_path / "state").rglob("*.parquet"))

    sizes = []
    for n, (key, text) in enumerate([(1, "First text."), (2, "Other text."), (1, "Second text."), (1, "First text.")]):
        land(spark, tmp_path, [(key, "gutenberg_text", "u", 200, book(text), f"e{n}", "m", None)])
        S.stream_ingest(spark, f"{tmp_path}/landing", state, f"{tmp_path}/check", sources, chunks).awaitTermination(120)
        sizes.append(written())
    base = sum(f.stat().st_size for f in (tmp_path / "state/chunks/base").rglob("*.parquet"))
    assert base > 200_000 and max(b - a for a, b in zip(sizes, sizes[1:], strict=False)) < 60_000  # none copies the table
    assert spark.read.parquet(f"{state}/chunks/rows/v=3").count() == 1 and spark.read.parquet(f"{state}/chunks/gone/v=3").count() == 1
    rows = lambda: sorted((r["source_id"], r["chunk_text"], r["is_active"], r["embedding"] is not None) for r in kept(spark, sources, chunks, state, "chunks").where("source_id < 1000").collect())
    before = rows()
    assert before == [(1, "First text.", False, True), (1, "First text.", True, True), (1, "Second text.", False, True), (1, "old", False, False), (2, "Other text.", True, True), (4, "x", True, False)]
    after = {r["source_id"]: r for r in kept(spark, sources, chunks, state, "sources").collect()}
    assert len(after) == 5 and after[1]["status"] == "completed" and after[1]["last_scraped_at"] and after[1]["etag"] == "e3" and after[3]["status"] is None
    assert spark.read.parquet(f"{state}/jobs").count() == 4 and not list((tmp_path / "state/staging").glob("*"))
    # compacted: the same rows, without the deltas; a second time it does nothing
    of = list(S.log_tables(*S.with_ingest_columns(sources, chunks)))
    assert log.compact(spark, state, of, keep=1) == 4 and log.committed(spark, state) == [(4, 0), (4, 4)]
    assert rows() == before and kept(spark, sources, chunks, state, "chunks").count() == 20006
    log.compact(spark, state, of, keep=1)
    land(spark, tmp_path, [(2, "gutenberg_text", "u", 200, book("Third text."), "e", "m", None)])
    S.stream_ingest(spark, f"{tmp_path}/landing", state, f"{tmp_path}/check", sources, chunks, compact_every=1).awaitTermination(120)
    assert log.current(spark, state) == 5 and (2, "Other text.", False, True) in rows() and (2, "Third text.", True, True) in rows()
    log.compact(spark, state, of, keep=1)
    assert not list((tmp_path / "state/chunks/rows").glob("v=[1-4]"))


def test_reader_sees_one_version_of_both_tables(spark, tmp_path):
    sources, chunks = tables_of(spark)
    of = S.log_tables(*S.with_ingest_columns(sources, chunks))
    first = dict(zip(of, S.with_ingest_columns(sources, chunks), strict=True))
    root = f"{tmp_path}/log"
    assert log.current(spark, root) is None
    log.create(root, first)
    log.write_rows(first[of[1]].limit(1).withColumn("source_id", F.lit(7).cast("long")), root, of[1], 1)  # written, not committed
    assert log.read(spark, root, of[1]).where("source_id = 7").count() == 0
    log.commit(spark, root, 1)
    assert log.read(spark, root, of[1]).where("source_id = 7").count() == 1
    assert log.read(spark, root, of[1], version=0).count() == 2 and log.read(spark, root, of[0]).count() == 5
    log.write_gone(log.read(spark, root, of[1]).limit(0), root, of[1], 2)
    log.commit(spark, root, 2)
    log.commit(spark, root, 2)  # a batch that runs again
    assert log.current(spark, root) == 2 and log.read(spark, root, of[1]).count() == 3


def test_last_payload_by_landing_time(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    page = lambda k, text, modified, d: (k, "gutenberg_text", "u", 200, book(text), None, modified, at(d))
    rows = [page(1, "New.", "Tue, 02 Jan 2024 00:00:00 GMT", 9), page(1, "Old.", "Wed, 31 Jan 2024 00:00:00 GMT", 8), page(2, "Late date.", "Mon, 08 Jan 2024 00:00:00 GMT", 8), page(2, "Early date.", "Tue, 02 Jan 2024 00:00:00 GMT", 8), page(3, "One.", None, 8)]
    got = tables.newest_payloads(spark.createDataFrame(rows, tables.FETCHED + ", landed_at timestamp"))
    assert {r["source_id"]: r["raw"] for r in got.collect()} == {1: book("New."), 2: book("Late date."), 3: book("One.")}
    # across batches: an older payload that comes later changes nothing, a failure doesn't make content newer
    sources, chunks = tables_of(spark)
    for batch in ([page(1, "Now.", None, 9), (2, "gutenberg_text", "u", 500, None, None, None, at(9))], [page(1, "Before.", None, 8), page(2, "Before.", None, 8)]):
        land(spark, tmp_path, batch)
        S.stream_ingest(spark, f"{tmp_path}/landing", f"{tmp_path}/state", f"{tmp_path}/check", sources, chunks).awaitTermination(120)
    active = kept(spark, sources, chunks, f"{tmp_path}/state", "chunks").where("is_active")
    assert {(r["source_id"], r["chunk_text"]) for r in active.collect()} == {(1, "Now."), (2, "Before."), (4, "x")}
    assert [r["source_id"] for r in spark.read.parquet(f"{tmp_path}/state/late").collect()] == [1]


def test_sources_fail_alone(spark, tmp_path):
    def moody():
        inner = hashed_words()

        def encode(texts):
            if any("boom" in t for t in texts):
                raise ValueError("no vector for it")
            return inner(texts)

        return encode

    sources, chunks = tables_of(spark)
    land(spark, tmp_path, [(k, "gutenberg_text", "u", 200, book(t), "e", "m", None) for k, t in [(1, "Some boom."), (2, "Fine."), (3, "Fine too.")]])
    S.stream_ingest(spark, f"{tmp_path}/landing", f"{tmp_path}/state", f"{tmp_path}/check", sources, chunks, factory=moody).awaitTermination(120)
    after = {r["source_id"]: r for r in kept(spark, sources, chunks, f"{tmp_path}/state", "sources").collect()}
    assert [after[k]["status"] for k in (1, 2, 3)] == ["failed", "completed", "completed"]
    assert after[1]["content_hash"] is None and after[1]["etag"] is None and after[2]["content_hash"]
    errors = {r["source_id"]: r["error_message"] for r in spark.read.parquet(f"{tmp_path}/state/jobs").collect()}
    assert "no vector for it" in errors[1] and errors[2] is None
    rows = {(r["source_id"], r["chunk_text"], r["is_active"]) for r in kept(spark, sources, chunks, f"{tmp_path}/state", "chunks").collect()}
    assert rows == {(1, "old", True), (4, "x", True), (2, "Fine.", True), (3, "Fine too.", True)}
    with pytest.raises(Exception, match="no vector"):
        embed(spark.createDataFrame([("boom",)], "t string"), "t", factory=moody).collect()


def test_a_page_that_the_parser_fails_on_fails_alone(spark, monkeypatch):
    from cairn.operators import extract as X

    def picky(html, *wanted):
        if "bad" in html:
            raise RuntimeError("odd page")
        return [["body"], None]

    monkeypatch.setattr(X, "_pick", picky)
    pages = pd.DataFrame({"k": [1, 2], "html": ["bad", "good"]})
    made = list(X.page_rows([pages], "c", "h", ()))[0]
    assert made["text"].tolist() == [None, "body"] and made["error"].tolist() == ["RuntimeError: odd page", None]


def test_entities_are_appended_once(spark, tmp_path):
    q = spark.createDataFrame([(1, "author", "Max Müller", "Norse", '{"occupation":"s"}', None), (2, "author", "max muller!", None, None, None)], "request_id long, entity_type string, display_name string, tradition string, pasted string, found string")
    none = spark.createDataFrame([], "entity_type string, display_name string, normalized_key string, facts map<string,string>, fact_provenance map<string,string>, suggested_values map<string,string>").withColumn("suggested_values", F.lit(None).cast(f"map<string,{I.SUGGESTION}>"))
    tables.append_entities(I.lookup_entities(q, none), f"{tmp_path}/e")
    stored = spark.read.parquet(f"{tmp_path}/e")
    first = stored.collect()
    assert len(first) == 1 and first[0]["facts"]["occupation"] == '"s"' and first[0]["fact_provenance"] == {"occupation": "admin_text"} and set(first[0]["suggested_values"]) == {"author_epistemic_basis", "author_origin"}
    again = I.lookup_entities(q, stored)
    assert {(r["request_id"], r["cached"], r["display_name"]) for r in again.collect()} == {(1, True, "Max Müller"), (2, True, "Max Müller")}
    tables.append_entities(again, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 1


def test_stateful_diff_over_two_batches(spark, tmp_path):
    first = spark.createDataFrame([(1, "c1", ["a", "b"]), (2, "c", ["x"])], "source_id long, content_hash string, hashes array<string>")
    second = spark.createDataFrame([(1, "c2", ["b", "d"]), (2, "c", ["x"])], first.schema)
    landing = f"{tmp_path}/hashes"
    first.coalesce(1).write.parquet(landing)

    def drain():
        stream = S.stream_diff(spark.readStream.schema(first.schema).parquet(landing))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination(120)

    drain()
    second.coalesce(1).write.mode("append").parquet(landing)
    drain()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted([(1, "a", "new"), (1, "b", "new"), (2, "x", "new"), (1, "b", "unchanged"), (1, "d", "new"), (1, "a", "stale")])
    # another start from the checkpoint: state is a value and a hash each
    third = [(1, "c3", None), (2, "c2", ["x", "y"]), (3, "c", [])]
    spark.createDataFrame(third, first.schema).coalesce(1).write.mode("append").parquet(landing)
    drain()
    more = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert sorted(set(more) - set(got)) == [(1, "b", "stale"), (1, "d", "stale"), (2, "x", "unchanged"), (2, "y", "new")]
    kept = spark.read.format("statestore").option("stateVarName", "active").load(f"{tmp_path}/c")
    assert {(r["key"][0], r["user_map_key"][0]) for r in kept.collect()} == {(2, "x"), (2, "y")}


def test_snapshots_and_active_scan(spark, tmp_path):
    root = f"{tmp_path}/snap"
    assert tables.read_snapshot(spark, root) is None
    df = spark.createDataFrame([(1, True), (2, False)], "source_id long, is_active boolean")
    tables.write_snapshot(df, root, 1, ("is_active",))
    tables.write_snapshot(df.where("source_id = 1"), root, 2)
    assert tables.read_snapshot(spark, root).count() == 1
    assert [r[0] for r in tables.active_chunks(spark.read.parquet(f"{root}/v=1")).select("source_id").collect()] == [1]
    assert tables.active_chunks(df, spark.createDataFrame([(2,)], "source_id long")).count() == 0
    tables.append_messages(spark.createDataFrame([(None, "q"), (1, "q")], "user_id long, question string"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 1


def test_read_fetched_has_the_declared_schema(spark, tmp_path):
    spark.createDataFrame(LANDED, tables.FETCHED).write.parquet(f"{tmp_path}/l")
    got = tables.read_fetched(spark, f"{tmp_path}/l")
    assert got.columns == [*[c.split()[0] for c in tables.FETCHED.split(", ")], "landed_at"] and got.where("landed_at is null").count() == 0
    assert tables.read_fetched(spark, f"{tmp_path}/l", stream=True).isStreaming
