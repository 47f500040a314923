"""Derived tables in SQL that Spark and DuckDB both run: each query and its SQL start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # one source per document
    "v_sources": """
SELECT doc_id AS source_id, concat('https://', source, '.example.org/', CAST(doc_id AS STRING)) AS url,
       CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('Title ', CAST(doc_id AS STRING)) END AS title,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE upper(lang) END AS tradition,
       CASE doc_id % 7 WHEN 0 THEN 'indigenous_primary_text' WHEN 1 THEN 'indigenous_scholar' WHEN 2 THEN 'colonial_administrator'
            WHEN 3 THEN 'missionary' WHEN 4 THEN 'western_academic' WHEN 5 THEN 'unknown_compiler' END AS author_position,
       CASE doc_id % 5 WHEN 0 THEN 'pre_colonial' WHEN 1 THEN 'colonial_era' WHEN 2 THEN 'post_independence' WHEN 3 THEN 'contemporary' END AS era,
       CASE doc_id % 4 WHEN 0 THEN 'primary_translation' WHEN 1 THEN 'secondary_commentary' WHEN 2 THEN 'tertiary_summary' END AS text_role,
       CASE WHEN doc_id % 9 = 0 THEN 'outsider framing' END AS known_bias_flags
FROM {documents}""",
    # several chunks per source, one in ten inactive, questions' own vectors among them
    "v_chunks": """
SELECT vec_id AS chunk_id, vec_id - vec_id % 3 AS source_id, concat('Excerpt ', CAST(vec_id AS STRING)) AS chunk_text, embedding, label, vec_id % 10 <> 0 AS is_active
FROM {embeddings}""",
    # every vector whose id is divisible by 50 asks all others; every third of them has a tradition
    "v_questions": """
SELECT vec_id AS question_id, embedding, concat('Question ', CAST(vec_id AS STRING), '?') AS question, CASE WHEN vec_id % 3 = 0 THEN 'EN' END AS tradition FROM {embeddings} WHERE vec_id % 50 = 0""",
    # a question's true chunks share its label and its hundred of ids
    "v_truth": """
SELECT q.vec_id AS question_id, c.vec_id AS chunk_id FROM {embeddings} q JOIN {embeddings} c ON q.label = c.label AND q.vec_id <> c.vec_id AND q.vec_id - q.vec_id % 100 = c.vec_id - c.vec_id % 100 WHERE q.vec_id % 50 = 0""",
    # a second revision: some new, some edited, some gone
    "v_revision": """
SELECT doc_id AS source_id, doc_id % 5 <> 0 AS in_old, doc_id % 7 <> 0 AS in_new, text AS old_text,
       CASE WHEN doc_id % 3 = 0 THEN concat(text, ' Revised closing words.') ELSE text END AS new_text FROM {documents}""",
    "v_paragraphs": "SELECT doc_id, replace(text, chr(10), concat(chr(10), chr(10))) AS text FROM {documents}",
    # sources with crawl columns; times from the events
    "v_catalog": """
SELECT d.doc_id AS source_id, concat('https://', d.source, '.example.org/', CAST(d.doc_id AS STRING)) AS url,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE concat('Title ', CAST(d.doc_id AS STRING)) END AS title, upper(d.lang) AS tradition,
       CASE e.event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'scraping' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, e.ts AS created_at,
       CASE WHEN d.doc_id % 2 = 0 THEN e.ts END AS last_checked_at, CASE WHEN d.doc_id % 6 = 0 THEN e.ts END AS last_scraped_at,
       CASE WHEN d.doc_id % 3 = 0 THEN concat('"', CAST(d.n_chars AS STRING), '"') WHEN d.doc_id % 3 = 1 THEN '' END AS etag,
       CASE WHEN d.doc_id % 2 = 0 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS last_modified
FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id""",
    # job runs: sources without a view event ran, a part of them failed
    "v_results": """
SELECT doc_id AS source_id, doc_id % 2 = 0 AS changed, CASE WHEN doc_id % 9 = 0 THEN 'boom' END AS error FROM {documents} JOIN {events} ON event_id = doc_id WHERE event_type <> 'view'""",
    "v_jobs": """
SELECT event_id AS job_id, user_id AS source_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
       ts AS started_at, CASE WHEN event_type IN ('error', 'signup') THEN ts END AS finished_at, CASE WHEN event_type = 'error' THEN 'boom' END AS error_message FROM {events}""",
    # each user turn with the assistant turn after it
    "v_messages": """
SELECT u.conv_id AS conversation_id, u.turn AS message_id, u.turn AS created_at, u.text AS question, a.text AS answer, u.conv_id % 10 AS user_id
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "v_threads": "SELECT conv_id AS conversation_id, conv_id % 10 AS user_id, max(conv_id) AS created_at FROM {conversations} GROUP BY conv_id",
    "v_responses": """
SELECT u.conv_id * 100 + u.turn AS request_id, CASE WHEN u.conv_id % 4 = 1 THEN NULL ELSE u.conv_id END AS conversation_id,
       CASE WHEN u.conv_id % 5 = 0 THEN NULL WHEN u.conv_id % 7 = 0 THEN 77 ELSE u.conv_id % 10 END AS user_id, u.text AS question, 'answer' AS answer, false AS refused
FROM {conversations} u WHERE u.role = 'user'""",
    # provider attempts; the host is also the throttle key
    "v_attempts": """
SELECT event_id, user_id AS request_id, ts, event_id AS tier, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'error' THEN 404 WHEN 'signup' THEN 500 ELSE 304 END AS status_code,
       concat(event_type, '.example.org') AS host FROM {events}""",
    "v_fact_json": """
SELECT c_custkey AS entity_id, c_name AS display_name,
       CASE c_custkey % 5
         WHEN 0 THEN '{{"facts":{{"birth_year":{{"value":1823,"source":1}},"occupation":{{"value":"scholar","source":2}}}}}}'
         WHEN 1 THEN '{{"facts":{{"birth_year":{{"value":1823,"source":99}}}}}}'
         WHEN 2 THEN '{{"facts":{{"occupation":{{"value":"scholar"}}}}}}'
         WHEN 3 THEN '{{"facts":{{"tradition_engagement":{{"value":false,"source":1}}}}}}'
         ELSE '{{"facts":{{"practice_lineage":{{"value":"taught","source":"1"}}}}}}' END AS payload FROM {customer}""",
    "v_plain_json": """
SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'author' ELSE 'institution' END AS entity_type, c_name AS display_name,
       CASE WHEN c_custkey % 3 = 0 THEN 'Norse' WHEN c_custkey % 3 = 1 THEN '' END AS tradition,
       CASE c_custkey % 6
         WHEN 0 THEN '{{"birth_year":1823,"occupation":"scholar","extra":1,"tradition_engagement":true}}'
         WHEN 1 THEN '{{"practice_lineage":"taught by elders","birth_region":null}}'
         WHEN 2 THEN '{{"tradition_engagement":false,"born_within_tradition_context":false}}'
         WHEN 3 THEN 'not json'
         WHEN 4 THEN '{{"practice_lineage":"x","tradition_engagement":true,"born_within_tradition_context":true}}'
         ELSE '{{}}' END AS payload FROM {customer}""",
    "v_search_json": """
SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN '{{"results":[]}}'
       ELSE concat('{{"results":[{{"url":"https://a.example.org/', CAST(c_custkey AS STRING), '","title":"A","content":"alpha"}},{{"url":"https://b.example.org"}}]}}') END AS payload FROM {customer}""",
    "v_lookups": """
SELECT o_orderkey AS request_id, concat('Dr. É', c.c_name, '  Müller-', CAST(c.c_nationkey AS STRING)) AS display_name FROM {orders} JOIN {customer} c ON o_custkey = c.c_custkey""",
    # each second key that is asked for is stored, with facts of its own
    "v_entities": """
SELECT 'institution' AS entity_type, concat('Stored ', CAST(c_custkey AS STRING)) AS display_name, concat('dr ecustomer ', CAST(c_custkey AS STRING)) AS stored_key, CAST(c_acctbal AS STRING) AS balance FROM {customer} WHERE c_acctbal > 0""",
    # books: every second document gets a title line, every third no end marker
    "v_books": """
SELECT doc_id AS source_id, concat(CASE WHEN doc_id % 2 = 0 THEN concat('Title: Book ', CAST(doc_id AS STRING), chr(10), '   and more', chr(10)) ELSE concat('Preface', chr(10)) END,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('*** START OF THE BOOK ***', chr(10), ' ') END, text,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(chr(10), '*** END OF THE BOOK ***', chr(10), 'licence') END) AS raw FROM {documents}""",
}

_NEEDS = {v: [t for t in TABLES if "{" + t + "}" in sql] for v, sql in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in _NEEDS[name]})


def with_views(body: str, *names: str) -> str:
    """The same views as leading WITH parts of a DuckDB statement."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        raise ValueError("put recursive parts into a subquery")
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body
