"""Queries of catalogue, history, credibility and crawl (G, H, I, J, F9-F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import catalog as G
from ..operators import crawl as J
from ..operators import credibility as I
from ..operators import history as H
from ..sources import tables
from .registry import Registry
from .views import table, view

query = Registry()
_NOW = "2024-01-20 00:00:00"


def _now():
    return F.expr(f"TIMESTAMP_NTZ'{_NOW}'")


# --- catalogue and jobs


@query(
    "SELECT c.source_id, c.url, c.title, c.status, c.created_at, coalesce(n, 0) AS chunk_count FROM v_catalog c LEFT JOIN (SELECT source_id, count(*) AS n FROM v_chunks WHERE is_active GROUP BY source_id) USING (source_id)",
    "v_catalog", "v_chunks",
)
def list_sources(spark, sf):
    return G.list_sources(view(spark, sf, "v_catalog"), view(spark, sf, "v_chunks")).select("source_id", "url", "title", "status", "created_at", "chunk_count")


@query("SELECT s.source_id, coalesce(n, 0) AS chunk_count FROM v_sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM v_chunks WHERE is_active GROUP BY source_id) USING (source_id)", "v_sources", "v_chunks")
def chunk_count(spark, sf):
    return G.chunk_counts(view(spark, sf, "v_sources"), view(spark, sf, "v_chunks"))


_ASKED = "SELECT event_id AS request_id, concat('https://src', CAST(user_id % 21 AS STRING), '.example.org/', CAST(user_id AS STRING)) AS url FROM {events}"
_ASKED_SQL = """WITH asked AS (SELECT event_id AS request_id, concat('https://src', CAST(user_id % 21 AS STRING), '.example.org/', CAST(user_id AS STRING)) AS url FROM events),
m AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY request_id) = 1 AND NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.url = asked.url) AS ok FROM asked)
"""


def _registered(spark, sf):
    return G.register_sources(view(spark, sf, "v_sources"), spark.sql(_ASKED, events=table(spark, sf, "events")))


@query(_ASKED_SQL + "SELECT request_id, url, 'pending' AS status, CAST(0 AS BIGINT) AS chunk_count FROM m WHERE ok", "v_sources")
def register_sources(spark, sf):
    return _registered(spark, sf)[0].select("request_id", "url", "status", "chunk_count")


@query(_ASKED_SQL + "SELECT request_id, url FROM m WHERE NOT ok", "v_sources")
def register_rejected(spark, sf):
    return _registered(spark, sf)[1].select("request_id", "url")


def _patched(spark, sf):
    s = view(spark, sf, "v_sources")
    title = F.create_map(F.lit("title"), F.when(F.col("doc_id") % 2 == 0, "Patched"))
    both = F.map_concat(title, F.create_map(F.lit("era"), F.lit("contemporary")))
    patches = table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("source_id"), F.when(F.col("doc_id") % 9 == 0, both).otherwise(title).alias("patch"))
    return G.apply_patches(s, patches, ("title", "era", "tradition"))


_PATCH = "WITH p AS (SELECT doc_id * 2 AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'Patched' END AS title, doc_id % 9 = 0 AS both FROM documents) "


@query(_PATCH + "SELECT s.source_id, CASE WHEN p.source_id IS NULL THEN s.title ELSE p.title END AS title, CASE WHEN p.both THEN 'contemporary' ELSE s.era END AS era, s.tradition FROM v_sources s LEFT JOIN p USING (source_id)", "v_sources")
def apply_patches(spark, sf):
    return _patched(spark, sf)[0].select("source_id", "title", "era", "tradition")


@query(_PATCH + "SELECT source_id FROM p WHERE source_id NOT IN (SELECT source_id FROM v_sources)", "v_sources")
def patches_rejected(spark, sf):
    return _patched(spark, sf)[1].select("source_id")


def _rescraped(spark, sf):
    ids = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("source_id"))
    return G.request_rescrape(view(spark, sf, "v_catalog"), ids, _now())


@query("SELECT source_id, CASE WHEN source_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'pending' ELSE status END AS status FROM v_catalog", "v_catalog")
def request_rescrape(spark, sf):
    return _rescraped(spark, sf)[0].select("source_id", "status")


@query(f"SELECT source_id, 'pending' AS status, 0 AS attempts, TIMESTAMP '{_NOW}' AS created_at FROM v_catalog WHERE source_id IN (SELECT user_id FROM events WHERE event_type = 'error')", "v_catalog")
def rescrape_jobs(spark, sf):
    return _rescraped(spark, sf)[1]


@query("SELECT source_id, url, created_at FROM v_catalog WHERE status = 'pending' ORDER BY created_at, source_id LIMIT 10", "v_catalog")
def pending_batch(spark, sf):
    return G.pending_batch(view(spark, sf, "v_catalog"), 10).select("source_id", "url", "created_at")


@query(
    f"""SELECT c.source_id, CASE WHEN r.source_id IS NULL THEN c.status WHEN r.error IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN r.source_id IS NULL THEN c.last_checked_at ELSE TIMESTAMP '{_NOW}' END AS last_checked_at,
CASE WHEN r.error IS NULL AND r.changed THEN TIMESTAMP '{_NOW}' ELSE c.last_scraped_at END AS last_scraped_at FROM v_catalog c LEFT JOIN v_results r USING (source_id)""",
    "v_catalog", "v_results",
)
def job_outcomes(spark, sf):
    return G.job_outcomes(view(spark, sf, "v_catalog"), view(spark, sf, "v_results"), _now())[0].select("source_id", "status", "last_checked_at", "last_scraped_at")


@query(f"SELECT source_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, 1 AS attempts, TIMESTAMP '{_NOW}' AS finished_at, error AS error_message FROM v_results", "v_results")
def job_rows(spark, sf):
    return G.job_outcomes(view(spark, sf, "v_catalog"), view(spark, sf, "v_results"), _now())[1]


@query(
    f"""SELECT job_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN TIMESTAMP '{_NOW}' ELSE finished_at END AS finished_at, CASE WHEN late THEN 'worker watchdog timeout after {V.JOB_LIMIT_S}s' ELSE error_message END AS error_message
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '{_NOW}' - INTERVAL {V.JOB_LIMIT_S} SECOND AS late FROM v_jobs)""",
    "v_jobs",
)
def overdue_jobs(spark, sf):
    return G.overdue_jobs(view(spark, sf, "v_jobs"), _now()).select("job_id", "status", "finished_at", "error_message")


# --- history


@query(
    """SELECT t.conversation_id, t.user_id, t.created_at, coalesce(n, 0) AS message_count, last_question FROM v_threads t LEFT JOIN
(SELECT conversation_id, count(*) AS n, arg_max(question, message_id) AS last_question FROM v_messages GROUP BY conversation_id) USING (conversation_id) WHERE user_id IS NOT NULL""",
    "v_threads", "v_messages",
)
def list_conversations(spark, sf):
    return H.list_conversations(view(spark, sf, "v_threads"), view(spark, sf, "v_messages"), F.col("user_id")).select("conversation_id", "user_id", "created_at", "message_count", "last_question")


@query(
    "SELECT conversation_id, message_id, question, answer FROM v_messages m WHERE EXISTS (SELECT 1 FROM v_threads t WHERE t.conversation_id = m.conversation_id AND t.user_id = t.conversation_id % 7)",
    "v_threads", "v_messages",
)
def conversation_detail(spark, sf):
    """Every conversation is asked for, some by a user whose it isn't."""
    threads = view(spark, sf, "v_threads")
    asked = threads.select("conversation_id", (F.col("conversation_id") % 7).alias("user_id"))
    return H.conversation_details(threads, view(spark, sf, "v_messages"), asked).select("conversation_id", "message_id", "question", "answer")


@query(
    """SELECT m.conversation_id, m.message_id, coalesce(string_agg(s.source_id || '|' || s.url || '|' || coalesce(s.title, ''), ';' ORDER BY i.at), '') AS sources FROM v_messages m
LEFT JOIN (SELECT conversation_id, message_id, unnest([conversation_id % 60, message_id, 999999999]) AS source_id, unnest([0, 1, 2]) AS at FROM v_messages WHERE message_id % 4 = 0) i USING (conversation_id, message_id)
LEFT JOIN v_sources s ON s.source_id = i.source_id GROUP BY m.conversation_id, m.message_id""",
    "v_messages", "v_sources",
)
def hydrate_sources(spark, sf):
    cited = F.when(F.col("message_id") % 4 == 0, F.array(F.col("conversation_id") % 60, "message_id", F.lit(999999999).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = H.hydrate_sources(view(spark, sf, "v_messages").withColumn("cited_source_ids", cited), view(spark, sf, "v_sources"))
    one = F.transform("sources", lambda s: F.concat(s["source_id"].cast("string"), F.lit("|"), s["url"], F.lit("|"), F.coalesce(s["title"], F.lit(""))))
    return out.select("conversation_id", "message_id", F.array_join(one, ";").alias("sources"))


def _persisted(spark, sf):
    r = view(spark, sf, "v_responses").withColumn("cited_source_ids", F.array().cast("array<bigint>"))
    return H.persist_responses(view(spark, sf, "v_threads"), r)


@query(
    """SELECT request_id, CASE WHEN conversation_id IS NULL THEN -1 ELSE conversation_id END AS conversation_id, user_id, question FROM v_responses r
WHERE user_id IS NOT NULL AND (conversation_id IS NULL OR EXISTS (SELECT 1 FROM v_threads t WHERE t.conversation_id = r.conversation_id AND t.user_id = r.user_id))""",
    "v_responses", "v_threads",
)
def persist_responses(spark, sf):
    kept = _persisted(spark, sf)[0]
    opened = view(spark, sf, "v_responses").where("conversation_id is null").select("request_id", F.lit(-1).alias("new"))
    return kept.join(opened, "request_id", "left").select("request_id", F.coalesce("new", "conversation_id").alias("conversation_id"), "user_id", "question")


@query(
    "SELECT request_id, conversation_id, user_id FROM v_responses r WHERE user_id IS NOT NULL AND conversation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_threads t WHERE t.conversation_id = r.conversation_id AND t.user_id = r.user_id)",
    "v_responses", "v_threads",
)
def persist_rejected(spark, sf):
    return _persisted(spark, sf)[1]


@query("SELECT request_id, user_id, question FROM v_responses WHERE user_id IS NOT NULL", "v_responses")
def append_messages(spark, sf):
    """Responses through the sink of messages, and read again: anonymous ones leave nothing."""
    path = f"{tables.scratch(spark)}/messages"
    tables.append_messages(view(spark, sf, "v_responses"), path)
    return spark.read.parquet(path).select("request_id", "user_id", "question")


# --- credibility


@query("SELECT entity_id, CASE WHEN entity_type = 'institution' THEN display_name || ' history publisher institution' ELSE display_name || ' biography' END AS query FROM v_plain_json", "v_plain_json")
def search_query(spark, sf):
    return view(spark, sf, "v_plain_json").select("entity_id", T.search_query(F.col("entity_type"), F.col("display_name")).alias("query"))


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(repr(n) for n in names) + "]"


_FACT_ROWS = f"""WITH facts AS (SELECT *, nullif(CASE WHEN json_valid(payload) THEN CAST(json_extract(payload, '$.' || fact) AS VARCHAR) END, 'null') AS value FROM
  (SELECT *, unnest(CASE WHEN tradition <> '' THEN {_list(V.FACT_KEYS + V.TRADITION_FACT_KEYS)} ELSE {_list(V.FACT_KEYS)} END) AS fact FROM v_plain_json))
"""


def _facts(spark, sf):
    rows = view(spark, sf, "v_plain_json")
    return rows.join(I.extract_facts(rows, "entity_id", "payload", "tradition"), "entity_id")


@query(_FACT_ROWS + "SELECT entity_id, fact, value FROM facts WHERE json_valid(payload)", "v_plain_json")
def extract_facts(spark, sf):
    return _facts(spark, sf).select("entity_id", F.explode("facts").alias("fact", "value"))


@query("SELECT entity_id, CASE WHEN NOT json_valid(payload) THEN 'not valid JSON' END AS error FROM v_plain_json", "v_plain_json")
def extract_errors(spark, sf):
    return _facts(spark, sf).select("entity_id", "error")


@query(
    f"""SELECT entity_id, fact, CASE WHEN value IS NOT NULL AND url IS NOT NULL THEN value END AS value, CASE WHEN value IS NOT NULL THEN url END AS url FROM
(SELECT entity_id, fact, nullif(CAST(json_extract(payload, '$.facts.' || fact || '.value') AS VARCHAR), 'null') AS value,
   CASE WHEN json_type(payload, '$.facts.' || fact || '.source') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(payload, '$.facts.' || fact || '.source') AS BIGINT) IN (1, 2) THEN 'https://r' || json_extract(payload, '$.facts.' || fact || '.source') || '.example.org' END AS url
 FROM (SELECT *, unnest({_list(V.FACT_KEYS + V.TRADITION_FACT_KEYS)}) AS fact FROM v_fact_json))""",
    "v_fact_json",
)
def extract_attributed_facts(spark, sf):
    rows = view(spark, sf, "v_fact_json")
    results = rows.select("entity_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx")).withColumn("url", F.concat(F.lit("https://r"), F.col("idx").cast("string"), F.lit(".example.org")))
    return I.extract_attributed_facts(rows, results, "entity_id", "payload", True)


@query(_FACT_ROWS + "SELECT entity_id, fact, 'admin_text' AS provenance FROM facts WHERE value IS NOT NULL", "v_plain_json")
def pasted_provenance(spark, sf):
    return _facts(spark, sf).select("entity_id", F.explode(I.pasted_provenance(F.col("facts"))).alias("fact", "provenance"))


_WIDE = _FACT_ROWS + """, w AS (SELECT entity_id, any_value(entity_type) AS entity_type, any_value(tradition) AS tradition, max(CASE WHEN fact = 'practice_lineage' THEN value END) AS l, max(CASE WHEN fact = 'tradition_engagement' THEN value END) AS e,
  max(CASE WHEN fact = 'born_within_tradition_context' THEN value END) AS b FROM facts GROUP BY entity_id)
"""
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_BASIS = f"""CASE WHEN e = 'false' THEN 'textual_study_only|' || {_Q(V.REASON_NO_ENGAGEMENT)} || '|tradition_engagement'
  WHEN l IS NOT NULL AND l <> '""' THEN 'lived_practice|' || {_Q(V.REASON_LINEAGE)} || '|practice_lineage' || CASE WHEN e IS NOT NULL THEN ',tradition_engagement' ELSE '' END
  WHEN e IS NOT NULL THEN 'mixed|' || {_Q(V.REASON_ENGAGEMENT)} || '|tradition_engagement' ELSE 'unknown|' || {_Q(V.REASON_NO_BASIS)} || '|' END"""
_ORIGIN = f"""CASE b WHEN 'true' THEN 'indigenous_born|' || {_Q(V.REASON_BORN_INSIDE)} || '|born_within_tradition_context' WHEN 'false' THEN 'foreign_born|' || {_Q(V.REASON_BORN_OUTSIDE)} || '|born_within_tradition_context'
  ELSE 'unknown|' || {_Q(V.REASON_NO_ORIGIN)} || '|' END"""


def _flat(c):
    return F.concat_ws("|", c["value"], c["reasoning"], F.array_join(c["based_on_facts"], ","))


@query(_WIDE + f"SELECT entity_id, {_BASIS} AS basis FROM w", "v_plain_json")
def suggest_epistemic_basis(spark, sf):
    return _facts(spark, sf).select("entity_id", I.suggest_epistemic_basis(F.col("facts")).alias("s")).select("entity_id", _flat(F.col("s")).alias("basis"))


@query(_WIDE + f"SELECT entity_id, {_ORIGIN} AS origin FROM w", "v_plain_json")
def suggest_origin(spark, sf):
    return _facts(spark, sf).select("entity_id", I.suggest_origin(F.col("facts")).alias("s")).select("entity_id", _flat(F.col("s")).alias("origin"))


@query(
    _WIDE + f"""SELECT entity_id, 'author_epistemic_basis' AS field, {_BASIS} AS suggestion FROM w WHERE entity_type = 'author'
UNION ALL SELECT entity_id, 'author_origin', {_ORIGIN} FROM w WHERE entity_type = 'author' AND tradition <> ''""",
    "v_plain_json",
)
def suggested_values(spark, sf):
    s = I.suggested_values(F.col("entity_type"), F.col("facts"), F.col("tradition"))
    return _facts(spark, sf).select("entity_id", F.explode(s).alias("field", "s")).select("entity_id", "field", _flat(F.col("s")).alias("suggestion"))


_LOOKED = f"""WITH k AS (SELECT *, trim(regexp_replace(lower(strip_accents(display_name)), '[^a-z0-9]+', ' ', 'g')) AS normalized_key FROM v_lookups),
c AS (SELECT *, stored_key || ' muller ' || n AS normalized_key, '"' || balance || '"' AS balance_json FROM v_entities, (SELECT unnest(range(25)) AS n)),
m AS (SELECT *, CASE WHEN request_id % 3 = 0 THEN 'institution' ELSE 'author' END AS entity_type, CASE WHEN request_id % 2 = 0 THEN 'Norse' END AS tradition FROM
  (SELECT *, row_number() OVER (PARTITION BY normalized_key ORDER BY request_id) AS no FROM k WHERE normalized_key NOT IN (SELECT normalized_key FROM c)) WHERE no = 1)
"""
_PASTED = '{"occupation":"scholar","practice_lineage":"taught"}'
_FOUND = '{"facts":{"occupation":{"value":"poet","source":1},"tradition_engagement":{"value":true,"source":2},"birth_year":{"value":1,"source":9}}}'


def _looked(spark, sf):
    """Hits with facts of their own, misses with a pasted text (every fifth) or search results."""
    q = view(spark, sf, "v_lookups").withColumns(
        {
            "entity_type": F.when(F.col("request_id") % 3 == 0, "institution").otherwise("author"),
            "tradition": F.when(F.col("request_id") % 2 == 0, "Norse"),
            "pasted": F.when(F.col("request_id") % 5 == 0, _PASTED),
            "found": F.lit(_FOUND),
        }
    )
    results = q.select("request_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx")).withColumn("url", F.concat(F.lit("u"), F.col("idx").cast("string")))
    stored = view(spark, sf, "v_entities").select("*", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
    stored = stored.withColumns(
        {
            "normalized_key": F.concat("stored_key", F.lit(" muller "), F.col("n").cast("string")),
            "facts": F.create_map(F.lit("balance"), F.concat(F.lit('"'), "balance", F.lit('"'))),
            "fact_provenance": F.create_map(F.lit("balance"), F.lit("stored")),
            "suggested_values": F.create_map().cast(f"map<string,{I.SUGGESTION}>"),
        }
    )
    return I.lookup_entities(q, stored, results)


@query(
    _LOOKED + """SELECT k.request_id, true AS cached, k.normalized_key, c.entity_type, c.display_name FROM k JOIN c USING (normalized_key)
UNION ALL SELECT request_id, false, normalized_key, entity_type, display_name FROM m""",
    "v_lookups", "v_entities",
)
def lookup_entities(spark, sf):
    return _looked(spark, sf).select("request_id", "cached", "normalized_key", "entity_type", "display_name")


@query(_LOOKED + "SELECT normalized_key, entity_type, display_name FROM m", "v_lookups", "v_entities")
def append_entities(spark, sf):
    """What lookups computed through the sink of entities, and read again: a row a key that wasn't stored."""
    path = f"{tables.scratch(spark)}/entities"
    tables.append_entities(_looked(spark, sf), path)
    return spark.read.parquet(path).select("normalized_key", "entity_type", "display_name")


@query(
    _LOOKED + """SELECT k.request_id, 'balance' AS fact, c.balance_json AS value, 'stored' AS provenance FROM k JOIN c USING (normalized_key)
UNION ALL SELECT request_id, 'occupation', CASE WHEN request_id % 5 = 0 THEN '"scholar"' ELSE '"poet"' END, CASE WHEN request_id % 5 = 0 THEN 'admin_text' ELSE 'u1' END FROM m
UNION ALL SELECT request_id, 'practice_lineage', '"taught"', 'admin_text' FROM m WHERE request_id % 5 = 0
UNION ALL SELECT request_id, 'tradition_engagement', 'true', 'u2' FROM m WHERE request_id % 5 <> 0 AND tradition IS NOT NULL""",
    "v_lookups", "v_entities",
)
def lookup_facts(spark, sf):
    """The facts that have a value, with where each comes from."""
    rows = _looked(spark, sf).select("request_id", "fact_provenance", F.explode("facts").alias("fact", "value")).where("value is not null")
    return rows.select("request_id", "fact", "value", F.try_element_at("fact_provenance", F.col("fact")).alias("provenance"))


@query(
    _LOOKED + f"""SELECT request_id, 'author_epistemic_basis' AS field, CASE WHEN request_id % 5 = 0 THEN 'lived_practice|' || {_Q(V.REASON_LINEAGE)} || '|practice_lineage'
  WHEN tradition IS NOT NULL THEN 'mixed|' || {_Q(V.REASON_ENGAGEMENT)} || '|tradition_engagement' ELSE 'unknown|' || {_Q(V.REASON_NO_BASIS)} || '|' END AS suggestion FROM m WHERE entity_type = 'author'
UNION ALL SELECT request_id, 'author_origin', 'unknown|' || {_Q(V.REASON_NO_ORIGIN)} || '|' FROM m WHERE entity_type = 'author' AND tradition IS NOT NULL""",
    "v_lookups", "v_entities",
)
def lookup_suggestions(spark, sf):
    return _looked(spark, sf).select("request_id", F.explode("suggested_values").alias("field", "s")).select("request_id", "field", _flat(F.col("s")).alias("suggestion"))


_RESULTS = """WITH r AS (SELECT entity_id, 1 AS idx, 'https://a.example.org/' || entity_id AS url, 'A' AS title, 'alpha' AS content, NULL AS error FROM v_search_json WHERE entity_id % 4 <> 0
UNION ALL SELECT entity_id, 2, 'https://b.example.org', '', '', NULL FROM v_search_json WHERE entity_id % 4 <> 0 UNION ALL SELECT entity_id, NULL, NULL, NULL, NULL, 'no search results' FROM v_search_json WHERE entity_id % 4 = 0)
"""


def _results(spark, sf):
    return I.search_results(view(spark, sf, "v_search_json"), "entity_id", "payload")


@query(_RESULTS + "SELECT * FROM r", "v_search_json")
def search_results(spark, sf):
    return _results(spark, sf)


_EXCERPTS = "SELECT entity_id, string_agg('[Result ' || idx || '] URL: ' || url || chr(10) || content, chr(10) || chr(10) ORDER BY idx) AS excerpts FROM r WHERE error IS NULL GROUP BY entity_id"


@query(_RESULTS + _EXCERPTS, "v_search_json")
def excerpt_block(spark, sf):
    return I.excerpt_block(_results(spark, sf), "entity_id")


@query(
    _RESULTS + f""", x AS ({_EXCERPTS}) SELECT entity_id, 'Entity type: ' || entity_type || chr(10) || 'Entity name: ' || display_name || chr(10) || CASE WHEN tradition <> '' THEN 'Tradition being classified: ' || tradition || chr(10) ELSE '' END
|| chr(10) || 'Search result excerpts:' || chr(10) || excerpts AS prompt FROM v_plain_json JOIN x USING (entity_id)""",
    "v_search_json", "v_plain_json",
)
def lookup_prompt(spark, sf):
    rows = view(spark, sf, "v_plain_json").join(I.excerpt_block(_results(spark, sf), "entity_id"), "entity_id")
    return rows.select("entity_id", I.lookup_prompt(F.col("entity_type"), F.col("display_name"), F.col("tradition"), F.col("excerpts"), "Search result excerpts").alias("prompt"))


# --- crawl


_ORIGIN_OF = "regexp_extract(url, '^[a-z]+://[^/]+', 0)"


@query(
    f"""SELECT page_id, url, CASE kind WHEN 0 THEN NOT starts_with(path, '/en/') WHEN 1 THEN false ELSE true END AS allowed FROM
(SELECT *, substr(url, length(origin) + 1) AS path, CAST('0x' || substr(md5(origin), 1, 4) AS BIGINT) % 3 AS kind FROM (SELECT page_id, url, {_ORIGIN_OF} AS origin FROM pages UNION ALL SELECT page_id, url, {_ORIGIN_OF} FROM pages))"""
)
def robots_filter(spark, sf):
    """All pages' URLs, each asked for twice; a third of the hosts forbids English pages, a third all to this agent."""
    urls = table(spark, sf, "pages").select("page_id", "url")
    origin = F.expr(_ORIGIN_OF)
    origins = urls.select(origin.alias("origin")).distinct()
    kind = F.conv(F.substring(F.md5(F.col("origin").cast("binary")), 1, 4), 16, 10).cast("long") % 3
    body = F.when(kind == 0, "User-agent: *\nDisallow: /en/\nAllow: /\n").when(kind == 1, "User-agent: cairnbot\nDisallow: /\n\nUser-agent: *\nDisallow:\n")
    return J.robots_filter(urls.unionByName(urls), origins.select("origin", body.alias("body")), "cairnbot/1.0")


@query(
    """SELECT event_id, host, max(t - 2000000 * n) OVER (PARTITION BY host ORDER BY n) + 2000000 * n AS slot_us FROM (SELECT event_id, host, epoch_us(ts) AS t, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS n FROM v_attempts)""",
    "v_attempts",
)
def throttle(spark, sf):
    return J.throttle(view(spark, sf, "v_attempts"), "host", "ts", "event_id").select("event_id", "host", "slot_us")


@query("SELECT source_id, concat_ws(';', 'If-None-Match=' || nullif(etag, ''), 'If-Modified-Since=' || nullif(last_modified, '')) AS headers FROM v_catalog", "v_catalog")
def fetch_plan(spark, sf):
    h = J.conditional_headers(F.col("etag"), F.col("last_modified"))
    parts = [F.concat(F.lit(f"{k}="), F.try_element_at(h, F.lit(k))) for k in ("If-None-Match", "If-Modified-Since")]
    return view(spark, sf, "v_catalog").select("source_id", F.concat_ws(";", *parts).alias("headers"))


@query(
    """SELECT request_id, coalesce(min(tier) FILTER (WHERE status_code NOT IN (429, 404)), max(tier)) AS tier, coalesce(arg_min(status_code, tier) FILTER (WHERE status_code NOT IN (429, 404)), arg_max(status_code, tier)) AS status_code FROM v_attempts GROUP BY request_id""",
    "v_attempts",
)
def resolve_attempts(spark, sf):
    return J.resolve_attempts(view(spark, sf, "v_attempts"))


QUERIES, ORACLES = query.queries, query.oracles
