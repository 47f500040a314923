"""Queries of retrieval, context and evaluation (R, E, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import context as C
from ..operators import embed as E
from ..operators import evaluate as K
from ..operators import retrieve as R
from .registry import Registry
from .views import table, view

query = Registry()
_THREE = ("v_sources", "v_chunks", "v_questions")


def _three(spark, sf):
    return [view(spark, sf, v) for v in ("v_questions", "v_chunks", "v_sources")]


def _hits_sql(k: int = 5, threshold: float = 0.8) -> str:
    """CTEs up to `hits`: the top k in provenance order."""
    return f"""WITH scored AS (SELECT q.question_id, c.chunk_id, c.source_id, c.chunk_text, list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS distance
  FROM v_questions q, v_chunks c JOIN v_sources s ON s.source_id = c.source_id WHERE c.is_active AND (q.tradition IS NULL OR q.tradition = s.tradition)),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(distance, 12), chunk_id) AS place FROM scored WHERE round(distance, 9) <= {threshold}),
hits AS (SELECT t.*, s.* EXCLUDE (source_id), row_number() OVER (PARTITION BY question_id ORDER BY CASE s.author_position WHEN 'indigenous_primary_text' THEN 0 WHEN 'indigenous_scholar' THEN 1 ELSE 2 END, place) AS position
  FROM top t JOIN v_sources s ON s.source_id = t.source_id WHERE place <= {k})
"""


def _hits(spark, sf, threshold: float = 0.8):
    return R.retrieve(*_three(spark, sf), threshold=threshold)


_SHOWN = ("question_id", "chunk_id", "source_id", "chunk_text", "url", "title", "tradition", "author_position", "place", "position")
_SHOWN_SQL = "SELECT question_id, chunk_id, source_id, chunk_text, url, title, tradition, author_position, place, position, round(distance, 6) AS distance FROM hits"


@query(_hits_sql() + _SHOWN_SQL, *_THREE)
def retrieve(spark, sf):
    return _hits(spark, sf).select(*_SHOWN, F.round("distance", 6).alias("distance"))


@query(_hits_sql(threshold=0.65) + _SHOWN_SQL, *_THREE)
def retrieve_threshold(spark, sf):
    return _hits(spark, sf, 0.65).select(*_SHOWN, F.round("distance", 6).alias("distance"))


@query(_hits_sql(threshold=0.65) + _SHOWN_SQL, *_THREE)
def retrieve_pruned(spark, sf):
    """The rows of retrieve_threshold, by way of the clusters that may hold a hit."""
    questions, chunks, sources = _three(spark, sf)
    hits = R.retrieve(questions, chunks, sources, threshold=0.65, centres=R.fit_centres(R.active(chunks), clusters=32))
    return hits.select(*_SHOWN, F.round("distance", 6).alias("distance"))


@query(_hits_sql() + _SHOWN_SQL, *_THREE)
def retrieve_tiled(spark, sf):
    """The rows of retrieve, with questions and chunks as tiles, as for more questions than a task may hold."""
    questions, chunks, sources = _three(spark, sf)
    live = R.active(chunks).join(sources.select("source_id", "tradition"), "source_id")
    hits = R.nearest(questions, live, threshold=0.8, block=5, chunk_block=100)
    found = R.by_provenance(R.with_texts(hits.join(sources, "source_id"), chunks, 5 * questions.count()))
    return found.select(*_SHOWN, F.round("distance", 6).alias("distance"))


@query("SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(E.cosine_distance(F.col("embedding"), F.col("next")), 6).alias("distance"))


@query("SELECT chunk_id, source_id FROM v_chunks WHERE is_active", "v_chunks")
def active_chunks(spark, sf):
    return R.active(view(spark, sf, "v_chunks")).select("chunk_id", "source_id")


def _refusal_sql(threshold: float) -> str:
    return _hits_sql(threshold=threshold) + f"""SELECT question_id, h.question_id IS NULL AS refused, CASE WHEN h.question_id IS NULL THEN '{V.REFUSAL.replace("'", "''")}' END AS answer
FROM v_questions LEFT JOIN (SELECT DISTINCT question_id FROM hits) h USING (question_id)"""


@query(_refusal_sql(V.RELEVANCE), *_THREE)
def refuse_all(spark, sf):
    return R.refuse(view(spark, sf, "v_questions"), _hits(spark, sf, V.RELEVANCE))


@query(_refusal_sql(0.65), *_THREE)
def refuse_some(spark, sf):
    return R.refuse(view(spark, sf, "v_questions"), _hits(spark, sf, 0.65))


@query("SELECT DISTINCT tradition FROM v_sources s WHERE tradition IS NOT NULL AND EXISTS (SELECT 1 FROM v_chunks c WHERE c.is_active AND c.source_id = s.source_id)", "v_sources", "v_chunks")
def list_traditions(spark, sf):
    return C.list_traditions(view(spark, sf, "v_sources"), view(spark, sf, "v_chunks"))


@query("SELECT DISTINCT tradition FROM v_sources WHERE tradition IS NOT NULL", "v_sources")
def admin_traditions(spark, sf):
    return C.admin_traditions(view(spark, sf, "v_sources"))


@query(
    _hits_sql() + """SELECT question_id, source_id, row_number() OVER (PARTITION BY question_id ORDER BY first) AS cite_no, url, title, tradition, author_position FROM
(SELECT question_id, source_id, min(position) AS first, any_value(url) AS url, any_value(title) AS title, any_value(tradition) AS tradition, any_value(author_position) AS author_position FROM hits GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY question_id, source_id"),
    *_THREE,
)
def cited_sources(spark, sf):
    return C.cited_sources(_hits(spark, sf))


_LABEL = "coalesce(nullif(title, ''), CASE WHEN tradition <> '' THEN 'an untitled ' || tradition || ' source' END, 'an untitled source')"
_TAGS = "concat_ws(', ', nullif(replace(author_position, '_', ' '), ''), nullif(replace(text_role, '_', ' '), ''), nullif(replace(era, '_', ' '), ''), 'flagged: ' || nullif(known_bias_flags, ''))"
_CONTEXT = f""", heads AS (SELECT *, concat_ws(chr(10), '[' || {_LABEL} || CASE WHEN title <> '' AND tradition <> '' THEN ' (' || tradition || ')' ELSE '' END || ': ' || url || ']', 'Provenance: ' || nullif({_TAGS}, '')) AS head FROM hits),
blocks AS (SELECT question_id, source_id, min(position) AS first, arg_min(head, position) || chr(10) || string_agg(chunk_text, chr(10) ORDER BY position) AS block FROM heads GROUP BY question_id, source_id),
contexts AS (SELECT question_id, string_agg(block, chr(10) || chr(10) ORDER BY first) AS context FROM blocks GROUP BY question_id)
"""


@query(_hits_sql() + _CONTEXT + "SELECT question_id, context FROM contexts", *_THREE)
def format_context(spark, sf):
    return C.format_context(_hits(spark, sf))


@query(_hits_sql() + _CONTEXT + "SELECT question_id, 'system' AS role_0, 'Answer from the excerpts.' AS content_0, 'user' AS role_1, 'Excerpts:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question AS content_1 FROM contexts JOIN v_questions USING (question_id)", *_THREE)
def prompt_rows(spark, sf):
    rows = C.prompt_rows(view(spark, sf, "v_questions"), C.format_context(_hits(spark, sf)), "Answer from the excerpts.")
    return rows.select("question_id", *[F.col("messages")[i][f].alias(f"{f}_{i}") for i in (0, 1) for f in ("role", "content")])


@query(_hits_sql() + "SELECT DISTINCT question_id, source_id, title, author_position FROM hits", *_THREE)
def probe_sources(spark, sf):
    return K.probe_sources(_hits(spark, sf))


@query("SELECT vec_id, i - 1 AS at, round(embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(E.l2_normalize(F.col("embedding"))).alias("at", "x"))
    return e.select("vec_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


def _encoded_sql(key: str, text: str, source: str) -> str:
    """Nonzero components of the default encoder's vectors: words hashed to a place and a sign, sums over their norm."""
    words = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> '')".format(text)
    h = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)"
    return f"""WITH w AS (SELECT {key}, unnest({words}) AS w FROM {source}), h AS (SELECT {key}, {h} AS h FROM w),
s AS (SELECT {key}, h % {V.DIMENSION} AS place, CAST(sum(CASE WHEN h & 65536 > 0 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM h GROUP BY {key}, h % {V.DIMENSION})
SELECT {key}, place, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE), 6) AS x FROM s WHERE x <> 0"""


def _components(df, *key):
    """A row for each component that isn't 0."""
    parts = F.transform("embedding", lambda v, i: F.struct(i.cast("long").alias("place"), v.alias("v")))
    rows = df.select(*key, F.explode(F.filter(parts, lambda p: p["v"] != 0)).alias("p"))
    return rows.select(*key, "p.place", F.round(F.col("p.v").cast("double"), 6).alias("x"))


@query(_encoded_sql("doc_id", "text", "documents"))
def embed_documents(spark, sf):
    return _components(E.embed(table(spark, sf, "documents").select("doc_id", "text"), "text"), "doc_id")


@query(_encoded_sql("conversation_id, message_id", f"'{V.QUERY_PREFIX}' || question", "v_messages"), "v_messages")
def embed_questions(spark, sf):
    return _components(E.embed(view(spark, sf, "v_messages").select("conversation_id", "message_id", "question"), "question", is_query=True), "conversation_id", "message_id")


_RANKED = """WITH ranked AS (SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY round(1 - similarity, 12), chunk_id) AS rank FROM
  (SELECT q.question_id, c.chunk_id, 1 - list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS similarity FROM v_questions q, v_chunks c))
"""
_RECALL = """SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN best <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n, round(sum(CASE WHEN best <= k THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS recall
FROM (SELECT q.question_id, min(r.rank) AS best FROM v_questions q LEFT JOIN (SELECT r.* FROM {0} r JOIN v_truth t ON t.question_id = r.question_id AND t.chunk_id = r.chunk_id) r ON r.question_id = q.question_id GROUP BY q.question_id), (SELECT unnest([1, 3, 5]) AS k) GROUP BY k"""


@query(_RANKED + "SELECT question_id, chunk_id, rank, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 5", "v_chunks", "v_questions")
def rank_all(spark, sf):
    return K.rank_all(view(spark, sf, "v_questions"), view(spark, sf, "v_chunks")).select("question_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(_RANKED + _RECALL.format("ranked"), "v_chunks", "v_questions", "v_truth")
def recall_at_k(spark, sf):
    q = view(spark, sf, "v_questions")
    out = K.recall_at_k(K.rank_all(q, view(spark, sf, "v_chunks")), view(spark, sf, "v_truth"), q)
    return out.withColumn("recall", F.round("recall", 6))


@query(_hits_sql() + ", ranked AS (SELECT question_id, chunk_id, position AS rank FROM hits) " + _RECALL.format("ranked"), *_THREE, "v_truth")
def recall_production(spark, sf):
    out = K.recall_at_k(_hits(spark, sf).withColumnRenamed("position", "rank"), view(spark, sf, "v_truth"), view(spark, sf, "v_questions"))
    return out.withColumn("recall", F.round("recall", 6))


_HALF = _RANKED + """, half AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 12), chunk_id) AS rank FROM
  (SELECT q.question_id, c.chunk_id, list_cosine_distance(q.embedding[1:32]::DOUBLE[], c.embedding[1:32]::DOUBLE[]) AS d FROM v_questions q, v_chunks c))
"""


@query(_HALF + f"SELECT 'half' AS encoder, * FROM ({_RECALL.format('half')}) UNION ALL SELECT 'whole', * FROM ({_RECALL.format('ranked')})".replace("FROM half r", "FROM (SELECT * FROM half WHERE rank <= 5) r").replace("FROM ranked r", "FROM (SELECT * FROM ranked WHERE rank <= 5) r"), "v_chunks", "v_questions", "v_truth")
def compare_encoders(spark, sf):
    q, c, _ = _three(spark, sf)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    out = K.compare_encoders({"whole": K.rank_all(q, c), "half": K.rank_all(half(q), half(c))}, view(spark, sf, "v_truth"), q)
    return out.withColumn("recall", F.round("recall", 6))


@query(
    _refusal_sql(0.65).replace("SELECT question_id, h.question_id IS NULL AS refused", ", grounded AS (SELECT question_id, h.question_id IS NULL AS refused").rstrip() + """)
SELECT g.question_id, g.refused, g.answer, CASE WHEN e.event_type <> 'error' THEN 'stock ' || e.event_type END AS stock_answer, CASE WHEN e.event_type = 'error' THEN 'status 404' END AS stock_error
FROM grounded g LEFT JOIN (SELECT * FROM events WHERE event_type <> 'signup') e ON e.event_id = g.question_id""",
    *_THREE,
)
def compare_answers(spark, sf):
    grounded = R.refuse(view(spark, sf, "v_questions"), _hits(spark, sf, 0.65))
    failed = F.col("event_type") == "error"
    stock = table(spark, sf, "events").where("event_type <> 'signup'").select(F.col("event_id").alias("question_id"), F.when(~failed, F.concat(F.lit("stock "), "event_type")).alias("answer"), F.when(failed, "status 404").alias("error"))
    return K.compare_answers(grounded, stock)


@query("SELECT source_id, CASE author_position WHEN 'indigenous_primary_text' THEN 0 WHEN 'indigenous_scholar' THEN 1 ELSE 2 END AS tier FROM v_sources", "v_sources")
def provenance_rank(spark, sf):
    return view(spark, sf, "v_sources").select("source_id", T.provenance_rank(F.col("author_position")).alias("tier"))


@query(f"SELECT source_id, {_LABEL} AS label FROM v_sources", "v_sources")
def source_label(spark, sf):
    return view(spark, sf, "v_sources").select("source_id", T.source_label(F.col("title"), F.col("tradition")).alias("label"))


@query(f"SELECT source_id, {_TAGS} AS label FROM v_sources", "v_sources")
def provenance_label(spark, sf):
    c = F.col
    return view(spark, sf, "v_sources").select("source_id", T.provenance_label(c("author_position"), c("text_role"), c("era"), c("known_bias_flags")).alias("label"))


@query(f"SELECT conversation_id, message_id, '{V.QUERY_PREFIX}' || question AS query_text FROM v_messages", "v_messages")
def query_text(spark, sf):
    return view(spark, sf, "v_messages").select("conversation_id", "message_id", T.query_text(F.col("question")).alias("query_text"))


QUERIES, ORACLES = query.queries, query.oracles
